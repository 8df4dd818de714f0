"""Run directories, corpora with row groups, mappings and vocabularies; JSON and CSV reports."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.sources.files import FOLDER, checksums, found, read_lines, write_file

_JSON_FILES = ("config", "metrics", "environment")


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """``run_dir, config, metrics, environment`` (JSON text) of every subfolder with a ``config.json``; missing files are null.

    A run without metrics isn't complete. Fields are read with ``get_json_object`` or ``variant_get``. Each of these files is small: one row.
    """
    out = None
    for name in _JSON_FILES:
        pattern = f"{folder}/*/{name}.json"
        if found(spark, pattern):
            part = spark.read.text(pattern, wholetext=True).select(F.regexp_extract("_metadata.file_path", FOLDER, 1).alias("run_dir"), F.col("value").alias(name))
        else:
            part = spark.createDataFrame([], f"run_dir string, {name} string")
        out = part if out is None else out.join(part, "run_dir", "left")
    return out


def run_fields(runs: DataFrame, paths: dict[str, str]) -> DataFrame:
    """``run_dir`` and the configuration fields of ``paths`` (name: dotted path), null where absent."""
    return runs.select("run_dir", *(F.get_json_object("config", "$." + p).alias(n) for n, p in paths.items()))


def read_run_predictions(spark: SparkSession, folder: str, name: str = "predictions.csv", only: list[str] | None = None) -> DataFrame:
    """The contract rows of all run directories, or those in ``only``, in one read, with ``run_id`` from the path; a missing file of a run is a named error."""
    from spanframe.sources.contract import FormatError, read_predictions

    dirs = {p.split("/")[-2] for p in found(spark, f"{folder}/*/config.json")}
    dirs = dirs if only is None else set(only)
    missing = sorted(dirs - {p.split("/")[-2] for p in found(spark, f"{folder}/*/{name}")})
    if missing:
        raise FormatError(f"no {name} in {', '.join(missing)}")
    paths = [f"{folder}/{d}/{name}" for d in sorted(dirs)]
    return read_predictions(spark, paths, key=FOLDER).withColumnRenamed("file_name", "run_id")


def row_groups(paths: list[str], column: str = "text") -> list[tuple[str, int, int, int]]:
    """(file, row group, rows, compressed bytes of ``column``) from parquet footers only: what a read would cost."""
    import pyarrow.parquet as pq

    out = []
    for path in paths:
        meta = pq.ParquetFile(path).metadata
        at = meta.schema.to_arrow_schema().names.index(column)
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            out.append((Path(path).name, g, group.num_rows, group.column(at).total_compressed_size))
    return out


def ordered_documents(spark: SparkSession, paths: list[str], seed: int, column: str = "text") -> DataFrame:
    """``group_rank, row_index, text`` of parquet files in the order of a seeded permutation of their row groups; one column is read."""
    import numpy as np

    groups = row_groups(paths, column)
    ranks = {int(g): r for r, g in enumerate(np.random.default_rng(seed).permutation(len(groups)))}
    bounds, start = [], {}
    for i, (name, _, rows, _) in enumerate(groups):
        lo = start.get(name, 0)
        bounds.append((name, lo, lo + rows, ranks[i]))
        start[name] = lo + rows
    by_file: dict[str, list] = {}
    for name, lo, hi, rank in bounds:
        by_file.setdefault(name, []).append((lo, hi, rank))
    table = spark.createDataFrame([(n, sorted(b)) for n, b in by_file.items()], "file string, groups array<struct<lo:long,hi:long,rank:int>>")
    docs = spark.read.parquet(*paths).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), F.col(column).alias("text"))
    joined = docs.join(F.broadcast(table), "file")
    own = F.filter("groups", lambda g: (F.col("row") >= g["lo"]) & (F.col("row") < g["hi"]))[0]
    return joined.select(own["rank"].alias("group_rank"), (F.col("row") - own["lo"]).alias("row_index"), "text")


def read_mapping(path: str) -> dict:
    """A label mapping (YAML): ``source, target, target_types, mapping``; unknown or missing keys and targets are errors that name the file."""
    import yaml

    keys = ("source", "target", "target_types", "mapping")
    data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(data, dict) or set(data) != set(keys):
        raise ValueError(f"{path}: exactly the keys {', '.join(keys)} are needed")
    foreign = sorted({str(t) for t in data["mapping"].values()} - {*data["target_types"], "O"})
    if foreign:
        raise ValueError(f"{path}: targets that aren't target types: {', '.join(foreign)}")
    return data


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """``piece, ordinal``: one piece per line in the order of the lines, blank lines left out; ordinals are line numbers."""
    return read_lines(spark, path).filter("line <> ''").select(F.col("line").alias("piece"), F.col("line_no").alias("ordinal"))


def read_head_mapping(path: str) -> dict:
    """A head mapping (YAML): ``source, target, outside, mapping`` from a type to the list of types that start from it; a wrong form is an error."""
    import yaml

    keys = ("source", "target", "outside", "mapping")
    data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(data, dict) or set(data) != set(keys):
        raise ValueError(f"{path}: exactly the keys {', '.join(keys)} are needed")
    if not isinstance(data["outside"], bool) or not isinstance(data["mapping"], dict):
        raise ValueError(f"{path}: outside must be true or false, mapping a mapping")
    for source, targets in data["mapping"].items():
        if not isinstance(targets, list) or not all(isinstance(t, str) for t in targets):
            raise ValueError(f"{path}: {source!r} must list types")
    return data


def canonical_json(value: object) -> str:
    """JSON with sorted keys and no spaces: what ids are made of."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def run_id(config: dict, **identity: str | None) -> str:
    """The first twelve hex digits of SHA-256 over the configuration and the identities that are set (code, data, model ...)."""
    return hashlib.sha256(canonical_json({"config": config} | {k: v for k, v in identity.items() if v is not None}).encode()).hexdigest()[:12]


def data_digest(parts: dict[str, str]) -> str:
    """One digest of named content digests, in order of name."""
    return hashlib.sha256(canonical_json(parts).encode()).hexdigest()


def write_report(rows: DataFrame, path: str, most: int = 100_000) -> None:
    """A small table as indented JSON, non-ASCII kept, published at once; refused beyond ``most`` rows."""
    listed = [r.asDict(recursive=True) for r in rows.limit(most + 1).collect()]
    if len(listed) > most:
        raise ValueError(f"a report has at most {most} rows")
    write_file(rows.sparkSession, path, json.dumps(listed, indent=2, ensure_ascii=False, default=str) + "\n")


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; null is empty."""
    rows.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", escape='"')


def format_table(rows: DataFrame, most: int = 1000) -> str:
    """A small table as aligned text."""
    names = rows.columns
    cells = [names, *([("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r] for r in rows.limit(most).collect())]
    widths = [max(len(c[i]) for c in cells) for i in range(len(names))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(c, widths, strict=True)).rstrip() for c in cells)


def format_report(title: str, sections: dict[str, DataFrame]) -> str:
    """A report as text: a title, then each section's name over its table. Sections without rows say so."""
    blocks = [title, "=" * len(title)]
    for name, rows in sections.items():
        table = format_table(rows)
        blocks += ["", name, "-" * len(name), table if "\n" in table else "(none)"]
    return "\n".join(blocks) + "\n"


def write_extension(extension, path: str) -> dict:
    """An extended vocabulary as a folder: ``vocab.txt`` by id, ``new_pieces.txt`` in their order, and ``extension.json`` with the counts, written last.

    Both lists are bounded as vocabularies are. Returns the manifest.
    """
    spark = extension.vocabulary.sparkSession
    listed = [r["piece"] for r in extension.vocabulary.orderBy("id").collect()]
    new = extension.added.count()
    manifest = {"pieces": len(listed), "new": new, "skipped": {r["skip"]: r["pieces"] for r in extension.skipped().orderBy("skip").collect()}}
    manifest["digest"] = data_digest({"vocabulary": hashlib.sha256("\n".join(listed).encode()).hexdigest()})
    for name, pieces in (("vocab.txt", listed), ("new_pieces.txt", listed[len(listed) - new :])):
        write_file(spark, f"{path}/{name}", "".join(p + "\n" for p in pieces))
    write_file(spark, f"{path}/extension.json", json.dumps(manifest, indent=2, ensure_ascii=False) + "\n")
    return manifest


def write_corpus(kept: DataFrame, path: str, order: list[str]) -> dict:
    """Kept lines as text files in order, with ``manifest.json`` beside them: lines, words, digests of the files and one over them. Returns the manifest."""
    from spanframe.operators import curation

    spark = kept.sparkSession
    curation.write_corpus(kept, f"{path}/corpus", order)
    counts = curation.manifest_digest(kept).first()
    digests = {r["file"]: r["sha256"] for r in checksums(spark, f"{path}/corpus/part-*", text=False).collect()}
    # file names of a write hold a random part; their number gives the order
    named = {f"part-{i:05d}": digests[f] for i, f in enumerate(sorted(digests))}
    manifest = {"lines": counts["lines"], "words": counts["words"] or 0, "files": named, "digest": data_digest(named)}
    write_file(spark, f"{path}/manifest.json", json.dumps(manifest, indent=2) + "\n")
    return manifest
