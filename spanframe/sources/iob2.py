"""IOB2 text files: one word per line, first column the token, last the label, blank lines between sentences."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.operators.curation import prefix_sums
from spanframe.operators.rejects import FormatError
from spanframe.sources.files import exists, numbered_lines

SPLIT_FILES = {"train": "IOB2_train.txt", "validation": "IOB2_valid.txt", "test": "IOB2_test.txt"}


def read_iob2(spark: SparkSession, path: str, strict: bool = True, whole: bool = False) -> DataFrame:
    """``file, sid, idx, word, label``: sentences and words numbered from 0; label ``0`` is read as ``O``.

    Lines of white space end a sentence; repeated and trailing ones make none. LF or CRLF. With ``strict`` a line of one column is an error that names
    the line; else such lines are left out. Sentences are numbered within their file, or, with ``whole``, over all files in order of their paths.
    Files are read in blocks and sentences numbered by sums over ranges of lines: a file of any size is spread over the session.
    """
    lines = numbered_lines(spark, path)
    clean = F.trim(F.regexp_replace("raw", r"(?U)\s+", " "))
    marked = prefix_sums(lines.select("file", "path", "line_no", clean.alias("line")).withColumn("blank", (F.col("line") == "").cast("int")), "blank", ["path", "line_no"], "block")
    rows = marked.filter("blank = 0").withColumn("parts", F.split("line", " "))
    if strict:
        bad = rows.filter(F.size("parts") < 2).orderBy("path", "line_no").select("file", "line_no", "line").first()
        if bad:
            raise FormatError(f"{bad['file']}:{bad['line_no'] + 1}: a token and a label are needed, not {bad['line']!r}")
    rows = rows.filter(F.size("parts") >= 2)
    # one row per sentence: its number over all files, less the file's first one
    sentences = prefix_sums(rows.select("path", "block").distinct().withColumn("one", F.lit(1)), "one", ["path", "block"], "n").drop("one")
    first = sentences.groupBy("path").agg(F.min("n").alias("first"))
    numbered = sentences.join(first, "path").select("path", "block", (F.col("n") - (F.lit(0) if whole else F.col("first"))).cast("long").alias("sid"))
    label = F.element_at("parts", -1)
    idx = F.row_number().over(Window.partitionBy("path", "block").orderBy("line_no")) - 1
    words = rows.withColumn("idx", idx).join(numbered, ["path", "block"])
    return words.select("file", "sid", "idx", F.col("parts")[0].alias("word"), F.when(label == "0", "O").otherwise(label).alias("label"))


def read_splits(spark: SparkSession, folder: str, files: dict[str, str] | None = None) -> DataFrame:
    """``split, sid, idx, word, label`` of a folder's split files; all missing files are named at once."""
    files = files or SPLIT_FILES
    missing = [f for f in files.values() if not exists(spark, f"{folder}/{f}")]
    if missing:
        raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")
    out = None
    for split, name in files.items():
        part = read_iob2(spark, f"{folder}/{name}").withColumn("split", F.lit(split)).drop("file")
        out = part if out is None else out.unionByName(part)
    return out


def write_iob2(words: DataFrame, path: str) -> None:
    """Write ``sid, idx, word, label`` as text, sentences in order of ``sid``; empty tokens and tokens with white space are an error."""
    bad = words.filter(F.col("word").isNull() | (F.col("word") == "") | F.col("word").rlike(r"(?U)\s") | F.col("label").isNull()).select("sid", "idx", "word").first()
    if bad:
        raise FormatError(f"sentence {bad['sid']}, word {bad['idx']}: {bad['word']!r} can't be written")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.concat_ws(" ", "word", "label").alias("l")))), lambda x: x["l"]), "\n")
    sentences = words.groupBy("sid").agg(F.concat(lines, F.lit("\n")).alias("value"))
    sentences.repartitionByRange("sid").sortWithinPartitions("sid").select("value").write.mode("overwrite").text(path)


def arrays(words: DataFrame) -> DataFrame:
    """The nested form: ``sid, tokens, labels`` in word order."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "word", "label")))
    grouped = words.groupBy("sid").agg(ordered.alias("w"))
    return grouped.select("sid", F.transform("w", lambda x: x["word"]).alias("tokens"), F.transform("w", lambda x: x["label"]).alias("labels"))


def class_names(path: str, column: str = "ner_tags") -> list[str]:
    """The class names that a dataset's files carry in their footers (key ``huggingface``), on a local disk; a file without or with others is an error."""
    import pyarrow.parquet as pq

    files = sorted(p for p in Path(path).rglob("*.parquet") if p.is_file()) if Path(path).is_dir() else [Path(path)]
    known: dict[tuple, str] = {}
    for file in files:
        try:
            features = json.loads((pq.read_schema(file).metadata or {})[b"huggingface"])["info"]["features"]
            known.setdefault(tuple(features[column]["feature"]["names"]), file.name)
        except (KeyError, TypeError, ValueError):
            raise FormatError(f"{file.name}: its footer names no classes of {column}") from None
    if len(known) != 1:
        raise FormatError(f"{path}: {len(known)} different lists of class names: {', '.join(known.values())}")
    return list(next(iter(known)))


def tagged_parquet(spark: SparkSession, path: str, names: list[str] | None = None, expected: list[str] | None = None) -> DataFrame:
    """``sid, idx, word, label`` of parquet rows ``tokens array<string>, ner_tags array<int>``, numbered in order of file and row.

    ``names`` are the classes in order; without them they are read from the footers. With ``expected`` another list is an error, so that a changed
    order can't pass. Arrays of unequal length and class numbers out of range are an error.
    """
    names = names if names is not None else class_names(path)
    if expected is not None and list(expected) != list(names):
        raise FormatError(f"{path}: the classes are {', '.join(names)}, not {', '.join(expected)}")
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_r"), "tokens", "ner_tags")
    table = F.array(*(F.lit(n) for n in names))
    checked = F.when(F.size("tokens") != F.size("ner_tags"), F.raise_error(F.lit("tokens and ner_tags differ in length")).cast("array<int>")).otherwise(F.col("ner_tags"))
    zipped = F.arrays_zip(F.col("tokens").alias("t"), checked.alias("g"))
    # a row's number: its place in the file after the rows of the files before, one row per file
    before = Window.partitionBy(F.lit(0)).orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_f").agg(F.max("_r").alias("_last")).withColumn("_start", F.coalesce(F.sum(F.col("_last") + 1).over(before), F.lit(0))).select("_f", "_start")
    each = rows.join(starts, "_f").select((F.col("_start") + F.col("_r")).alias("sid"), F.posexplode(zipped).alias("idx", "x"))
    return each.select("sid", "idx", F.col("x.t").alias("word"), F.element_at(table, (F.col("x.g") + 1).cast("int")).alias("label"))


def entity_counts(words: DataFrame) -> DataFrame:
    """``etype, n``: the ``B-`` tags by type, as a manifest lists them."""
    return words.filter(F.col("label").startswith("B-")).groupBy(F.expr("substr(label, 3)").alias("etype")).agg(F.count("*").alias("n"))
