"""Text files of any size as numbered lines, and small files written whole or not at all, on whatever file system the session has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What of a path names the file: its last part, or the folder it lies in.
LAST, FOLDER = r"([^/]+)$", r"([^/]+)/[^/]+$"


def numbered_lines(spark: SparkSession, path: str | list[str], key: str = LAST) -> DataFrame:
    """``file, path, line_no, raw``: the lines of text files, numbered from 0 within each path; ``file`` is group 1 of ``key`` in the path.

    Lines end at LF; a CR before it stays. Files are read in blocks: lines are numbered within their block, and the blocks' counts, one row
    each, give where a block begins. No file is ever one row or one task.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("raw"))
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.groupBy("path", "_block").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("path", "_block").orderBy("_at")) - 1
    numbered = lines.withColumn("_in", within).join(starts.select("path", "_block", "_start"), ["path", "_block"])
    return numbered.select(F.regexp_extract("path", key, 1).alias("file"), "path", (F.col("_start") + F.col("_in")).alias("line_no"), "raw")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, line`` of a corpus: its files in order of name are one text, blank lines keep their numbers, CR at line ends is dropped."""
    lines = numbered_lines(spark, path)
    sizes = lines.groupBy("path").agg(F.max("line_no").alias("_last"))
    before = Window.partitionBy(F.lit(0)).orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file
    starts = sizes.withColumn("_start", F.coalesce(F.sum(F.col("_last") + 1).over(before), F.lit(0))).select("path", "_start")
    return lines.join(starts, "path").select((F.col("_start") + F.col("line_no")).alias("line_no"), F.regexp_replace("raw", "\r$", "").alias("line"))


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where, jvm


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, published at once: written under another name beside it, then renamed over what was there."""
    fs, where, jvm = _hadoop(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    fs.delete(where, False)
    if not fs.rename(part, where):
        raise OSError(f"{path} could not be published")


def exists(spark: SparkSession, path: str) -> bool:
    fs, where, _ = _hadoop(spark, path)
    return fs.exists(where)


def found(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern, in order."""
    fs, where, _ = _hadoop(spark, pattern)
    return sorted(s.getPath().toString() for s in (fs.globStatus(where) or []))


def local_paths(spark: SparkSession, path: str) -> list[str]:
    """The Parquet files of a table on a local disk."""
    listed = found(spark, path if exists(spark, path) and not found(spark, f"{path}/*.parquet") else f"{path}/*.parquet")
    return [p.removeprefix("file:") for p in listed]


def checksums(spark: SparkSession, path: str, text: bool = True, key: str = LAST) -> DataFrame:
    """``file, sha256`` of files (``file``: group 1 of ``key`` in the path); of ``text`` with line ends as LF, so that the same content is the same on every system. Files are hashed where they are read."""
    content = F.expr(r"replace(decode(content, 'utf-8'), '\r\n', '\n')") if text else F.col("content")
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", key, 1).alias("file"), F.sha2(F.encode(content, "utf-8") if text else content, 256).alias("sha256"))


def verify(spark: SparkSession, path: str, expected: dict[str, str], text: bool = True) -> None:
    """An error that names the files that are missing or whose digest isn't the expected one."""
    known = {r["file"]: r["sha256"] for r in checksums(spark, path, text).filter(F.col("file").isin(list(expected))).collect()}
    wrong = sorted(f for f, digest in expected.items() if known.get(f) != digest)
    if wrong:
        raise ValueError(f"missing or changed: {', '.join(wrong)}")
