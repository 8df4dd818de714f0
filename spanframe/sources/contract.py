"""Prediction files: CSV with a fixed set of columns in any order, and two older layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.operators.rejects import CONTRACT_RULES, FormatError, line_body, parsed_lines, split_cells, typed_rows, violations
from spanframe.sources.files import LAST, numbered_lines

COLUMNS = ("sentence_id", "word_idx", "word", "gold", "pred")
OPTIONAL = ("truncated",)
#: Headers of older files: (header, sentence column, word number column or none, token, gold, prediction) (fixed values).
OLDER = {
    ("sentence_id", "token", "true_label", "pred_label"): ("sentence_id", None, "token", "true_label", "pred_label"),
    ("sent_id", "token_id", "token", "gold", "pred"): ("sent_id", "token_id", "token", "gold", "pred"),
}


def csv_lines(spark: SparkSession, path: str, key: str = LAST) -> DataFrame:
    """``line_id, file_name, line_no, raw`` of text files, numbered from 1 within each; files of one ``key`` count as one."""
    lines = numbered_lines(spark, path, key)
    return lines.select(F.xxhash64("path", "line_no").alias("line_id"), F.col("file").alias("file_name"), (F.col("line_no") + 1).alias("line_no"), "raw")


def check_header(names: list[str], where: str) -> None:
    """Missing and unknown columns are errors that name them all."""
    missing = [c for c in COLUMNS if c not in names]
    unknown = [c for c in names if c not in COLUMNS + OPTIONAL]
    if missing:
        raise FormatError(f"{where}: missing columns {', '.join(missing)}")
    if unknown:
        raise FormatError(f"{where}: unknown columns {', '.join(unknown)}")
    if len(set(names)) != len(names):
        raise FormatError(f"{where}: repeated columns")


def _headers(lines: DataFrame) -> dict[str, list[str]]:
    """Header of each file; one row per file. Files that count as one must have the same."""
    first = lines.filter("line_no = 1").select("file_name", split_cells(line_body(F.col("raw"))).alias("h")).groupBy("file_name").agg(F.collect_set("h").alias("h"))
    found = {r[0]: [list(h) for h in r[1]] for r in first.collect()}
    differing = sorted(name for name, headers in found.items() if len(headers) > 1)
    if differing:
        raise FormatError(f"{differing[0]}: its files have different headers")
    return {name: headers[0] for name, headers in found.items()}


def read_predictions(spark: SparkSession, path: str, labels: list[str] | None = None, key: str = LAST) -> DataFrame:
    """``file_name, sentence_id, word_idx, word, gold, pred, truncated`` of valid files; the first fault of any kind is an error.

    Columns may come in any order; no value is ever guessed to be missing: ``NA`` and ``null`` are words. Word numbers must run from 0 without
    gaps or repetition; with ``labels`` tags must be among them. All files are read at once, of any size; ``file_name`` is group 1 of ``key`` in
    the path.
    """
    lines = csv_lines(spark, path, key)
    for name, header in sorted(_headers(lines).items()):
        check_header(header, name)
    parsed = parsed_lines(lines)
    bad = violations(parsed, CONTRACT_RULES).join(lines.select("line_id", "file_name", "line_no"), "line_id").orderBy("file_name", "line_no", "priority").first()
    if bad:
        raise FormatError(f"{bad['file_name']}:{bad['line_no']}: rule {bad['priority']} is broken")
    rows = typed_rows(parsed).drop("line_id")
    if labels is not None:
        unknown = rows.select("file_name", F.explode(F.array("gold", "pred")).alias("label")).filter(~F.col("label").isin(labels)).first()
        if unknown:
            raise FormatError(f"{unknown['file_name']}: unknown label {unknown['label']!r}")
    repeated = rows.groupBy("file_name", "sentence_id", "word_idx").count().filter("count > 1").first()
    if repeated:
        raise FormatError(f"{repeated['file_name']}: sentence {repeated['sentence_id']} has word {repeated['word_idx']} twice")
    gap = rows.groupBy("file_name", "sentence_id").agg(F.max("word_idx").alias("m"), F.count("*").alias("n")).filter("m <> n - 1").first()
    if gap:
        raise FormatError(f"{gap['file_name']}: the word numbers of sentence {gap['sentence_id']} have gaps")
    return rows


def read_older(spark: SparkSession, path: str, gold: DataFrame | None = None) -> DataFrame:
    """Rows of one older file in the contract's columns, the layout found by its exact header; words without numbers are numbered in file order.

    Such files lack the words that were cut off. With ``gold`` (``sid, idx, word, label``) they are added, as ``O`` and truncated; the file's words
    must then be the first gold words of each sentence, and its sentences all of the gold ones.
    """
    lines = csv_lines(spark, path)
    headers = _headers(lines)
    name, header = next(iter(headers.items()))
    if tuple(header) not in OLDER:
        raise FormatError(f"{name}: unknown layout {', '.join(header)}")
    sid, number, token, label, pred = OLDER[tuple(header)]
    at = {c: i for i, c in enumerate(header)}
    body = lines.filter("line_no > 1").select("line_no", line_body(F.col("raw")).alias("b")).filter("b <> ''")
    cells = body.select("line_no", split_cells(F.col("b")).alias("c"))
    rows = cells.select("line_no", *(F.get("c", F.lit(at[c])).alias(n) for n, c in (("sentence_id", sid), ("word", token), ("gold", label), ("pred", pred))), *([F.get("c", F.lit(at[number])).try_cast("int").alias("word_idx")] if number else []))
    rows = rows.withColumn("sentence_id", F.col("sentence_id").try_cast("long"))
    odd = rows.filter("sentence_id is null or word is null or gold is null or pred is null").orderBy("line_no").first()
    if odd:
        raise FormatError(f"{name}:{odd['line_no']}: not the fields of {', '.join(header)}")
    running = F.row_number().over(Window.partitionBy("sentence_id").orderBy("line_no")) - 1
    if number is None:
        rows = rows.withColumn("word_idx", running)
    else:
        wrong = rows.withColumn("_r", running).filter("word_idx is null or _r <> word_idx").first()
        if wrong:
            raise FormatError(f"{name}:{wrong['line_no']}: word {wrong['word_idx']} of sentence {wrong['sentence_id']} is out of order")
    out = rows.select("sentence_id", "word_idx", "word", "gold", "pred", F.lit(False).alias("truncated"))
    return out if gold is None else with_cut_words(out, gold.select(F.col("sid").alias("sentence_id"), F.col("idx").alias("word_idx"), F.col("word").alias("_word"), F.col("label").alias("_label")), name)


def with_cut_words(rows: DataFrame, gold: DataFrame, name: str) -> DataFrame:
    """Contract rows completed by the gold words they lack; ``gold``: ``sentence_id, word_idx, _word, _label``."""
    every = gold.join(rows, ["sentence_id", "word_idx"], "full")
    seen = rows.groupBy("sentence_id").agg(F.max("word_idx").alias("_last"))
    checked = every.join(seen, "sentence_id", "left")
    foreign = F.col("_word").isNull() | (F.col("word") != F.col("_word")) | (F.col("gold") != F.col("_label")) | (F.col("word").isNull() & (F.col("word_idx") <= F.col("_last"))) | F.col("_last").isNull()
    wrong = checked.filter(foreign).orderBy("sentence_id", "word_idx").select("sentence_id").first()
    if wrong:
        raise FormatError(f"{name}: sentence {wrong['sentence_id']} doesn't match the gold file")
    return every.select("sentence_id", "word_idx", F.col("_word").alias("word"), F.col("_label").alias("gold"), F.coalesce("pred", F.lit("O")).alias("pred"), F.col("pred").isNull().alias("truncated"))


def write_predictions(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Write the contract's columns as CSV, sorted by sentence and word within ranges; ``truncated`` as 0 or 1; no value is trimmed or quoted away.

    With ``by`` each value of that column, a run for one, has a folder of its own.
    """
    own = [by] if by else []
    out = rows.select(*own, *COLUMNS, F.col("truncated").cast("int").alias("truncated"))
    ordered = out.repartitionByRange(*own, "sentence_id").sortWithinPartitions(*own, "sentence_id", "word_idx")
    writer = ordered.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")
