"""Queries: every reader and sink over files written from the whole test tables, read back and held against the tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from spanframe.operators import registry as R
from spanframe.plans import sql
from spanframe.plans.curation import LINES, ORDER, staged
from spanframe.plans.registry import CORE
from spanframe.plans.runs import RUNS, registered
from spanframe.plans.spans import words
from spanframe.plans.tokens import WORDS, split_words
from spanframe.session import shared_folder, stored, table
from spanframe.sources import contract, files, iob2, runs

#: A word as the formats can hold it: no white space, not empty.
_WORD = r"coalesce(nullif(regexp_replace(word, '[\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', '_', 'g'), ''), '_')"


def _plain(column="word"):
    return F.coalesce(F.nullif(F.regexp_replace(column, r"[\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", "_"), F.lit("")), F.lit("_"))


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _gold_words(spark, sf_dir):
    return split_words(spark, sf_dir).select("split", "sentence_id", F.col("word_idx").alias("idx"), _plain().alias("word"), F.col("gold").alias("label"))


_GOLD = f"{WORDS}, g AS (SELECT split, sentence_id, dense_rank() OVER (PARTITION BY split ORDER BY sentence_id) - 1 AS sid, (row_number() OVER (PARTITION BY sentence_id ORDER BY word_idx) - 1)::INT AS idx, {_WORD} AS word, gold AS label FROM words)"


@CORE.register("iob2_round_trip", f"WITH {_GOLD} SELECT split, sid, idx, word, label FROM g")
def iob2_round_trip(spark, sf_dir):
    """The sentences of every split written as label files and read back, numbered anew from 0 in each split."""
    folder, gold, out = _folder(spark, "iob2"), stored(_gold_words(spark, sf_dir)), None
    for split, name in iob2.SPLIT_FILES.items():
        iob2.write_iob2(gold.filter(F.col("split") == split).withColumnRenamed("sentence_id", "sid"), f"{folder}/{name}")
        part = iob2.read_iob2(spark, f"{folder}/{name}/part-*", whole=True).withColumn("split", F.lit(split)).drop("file")
        out = part if out is None else out.unionByName(part)
    return out


@CORE.register("tagged_manifest", f"WITH {_GOLD} SELECT substr(label, 3) AS etype, count(*) AS n FROM g WHERE split = 'test' AND label LIKE 'B-%' GROUP BY 1")
def tagged_manifest(spark, sf_dir):
    """Entities by type of the test split written as arrays of words and class numbers and read back."""
    gold = stored(_gold_words(spark, sf_dir).filter("split = 'test'"))
    names = sorted(r[0] for r in gold.select("label").distinct().collect())
    number = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("label")).cast("int") - 1
    ordered = gold.groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.struct("idx", "word", number.alias("tag")))).alias("w"))
    path = _folder(spark, "tagged")
    ordered.select(F.transform("w", lambda x: x["word"]).alias("tokens"), F.transform("w", lambda x: x["tag"]).alias("ner_tags")).write.parquet(path)
    return iob2.entity_counts(iob2.tagged_parquet(spark, path, names))


_CONTRACT = f"{sql.CONTRACT}, rows AS (SELECT run_id, sentence_id, (row_number() OVER (PARTITION BY run_id, sentence_id ORDER BY word_idx) - 1)::INT AS word_idx, {_WORD} AS word, gold, pred, truncated FROM contract)"


@CORE.register("contract_round_trip", f"WITH {_CONTRACT} SELECT * FROM rows")
def contract_round_trip(spark, sf_dir):
    """The last loads of all runs written as contract files, a folder for each run, and read back and checked in one read."""
    path = _folder(spark, "contract")
    contract.write_predictions(words(spark, sf_dir).withColumn("word", _plain()), path, by="run_id")
    return contract.read_predictions(spark, f"{path}/*/part-*", key=r"run_id=([^/]+)/[^/]+$").withColumnRenamed("file_name", "run_id")


@CORE.register("older_layouts", f"""WITH {_GOLD}, t AS (SELECT sid AS sentence_id, idx AS word_idx, word, label AS gold, CASE WHEN idx < 5 THEN label ELSE 'O' END AS pred, idx >= 5 AS truncated FROM g WHERE split = 'test')
    SELECT * FROM t""")
def older_layouts(spark, sf_dir):
    """The first five words of the test sentences in an older layout, read back and completed from a gold file."""
    gold = stored(_gold_words(spark, sf_dir).filter("split = 'test'").drop("split").withColumnRenamed("sentence_id", "sid"))
    folder = _folder(spark, "older")
    iob2.write_iob2(gold, f"{folder}/gold")
    full = stored(iob2.read_iob2(spark, f"{folder}/gold/part-*", whole=True).drop("file"))
    old = full.filter("idx < 5").select(F.col("sid").alias("sentence_id"), F.col("idx"), F.col("word").alias("token"), F.col("label").alias("true_label"), F.col("label").alias("pred_label"))
    # one file: this layout numbers words by their order in it
    ordered = old.orderBy("sentence_id", "idx").drop("idx").coalesce(1)
    ordered.write.csv(f"{folder}/old", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return contract.read_older(spark, f"{folder}/old/part-*", full)


@CORE.register("corpus_round_trip", f"WITH {LINES} SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS line_no, line FROM staged WHERE stage = 'kept'")
def corpus_round_trip(spark, sf_dir):
    """The kept lines written as an ordered corpus with its manifest and read back with their numbers."""
    path = _folder(spark, "corpus")
    kept = stored(staged(spark, sf_dir, "kept").select(*ORDER, "line"))
    manifest = runs.write_corpus(kept, path, ORDER)
    lines = files.read_lines(spark, f"{path}/corpus/part-*")
    if lines.count() != manifest["lines"]:
        raise ValueError("the corpus has not the lines of its manifest")
    return lines


@CORE.register("pieces_round_trip", f"WITH {WORDS}, p AS (SELECT DISTINCT {_WORD} AS piece FROM words WHERE split = 'test') SELECT piece, row_number() OVER (ORDER BY piece) - 1 AS ordinal FROM p")
def pieces_round_trip(spark, sf_dir):
    """A list of pieces, one per line, written in order and read back with ordinals."""
    path = _folder(spark, "pieces")
    pieces = _gold_words(spark, sf_dir).filter("split = 'test'").select("word").distinct()
    pieces.repartitionByRange("word").sortWithinPartitions("word").select(F.col("word").alias("value")).write.text(path)
    return runs.read_pieces(spark, f"{path}/part-*")


@CORE.register(
    "run_directories",
    f"""WITH {RUNS} SELECT run_id AS run_dir, config.name AS name, config.seed AS seed, config.method.name AS method, metrics.test_contract.f1 AS f1, metrics IS NOT NULL AS complete FROM reg WHERE config IS NOT NULL""",
)
def run_directories(spark, sf_dir):
    """The registry written as run folders with a configuration each, metrics where there are any, and read back."""
    folder = _folder(spark, "runs")
    # one small file each: the registry of this table
    for r in registered(spark, sf_dir).filter("config is not null").collect():
        for name, value in (("config", r["config"]), ("metrics", r["metrics"])):
            if value is not None:
                files.write_file(spark, f"{folder}/{r['run_id']}/{name}.json", json.dumps(value.asDict(recursive=True), ensure_ascii=False))
    found = runs.read_runs(spark, folder)
    fields = {"name": "name", "seed": "seed", "method": R.ALIASES["method"]}
    configs = runs.run_fields(found, fields).withColumn("seed", F.col("seed").cast("long"))
    metrics = found.select("run_dir", F.get_json_object("metrics", "$.test_contract.f1").cast("double").alias("f1"), F.col("metrics").isNotNull().alias("complete"))
    return configs.join(metrics, "run_dir")


@CORE.register("corpus_checksums", "SELECT source, sha256(string_agg(coalesce(doc_id::VARCHAR, '') || chr(10), '' ORDER BY doc_id)) AS sha256 FROM documents WHERE source IS NOT NULL GROUP BY source")
def corpus_checksums(spark, sf_dir):
    """Digests of files of document ids, a folder for each source."""
    path = _folder(spark, "ids")
    ids = table(spark, sf_dir, "documents").filter("source is not null").select("source", "doc_id").repartition("source").sortWithinPartitions("source", "doc_id")
    ids.select("source", F.col("doc_id").cast("string").alias("value")).write.partitionBy("source").text(path)
    digests = files.checksums(spark, f"{path}/*/part-*", key=r"source=([^/]+)/[^/]+$")
    return digests.select(F.col("file").alias("source"), "sha256")


@CORE.register("row_group_bytes")
def row_group_bytes(spark, sf_dir):
    """Row groups of the documents with rows and compressed bytes of the text column, from footers only."""
    paths = files.local_paths(spark, f"{sf_dir}/documents.parquet")
    return spark.createDataFrame(runs.row_groups(paths), "file string, row_group int, rows long, bytes long")
