"""Command line: the engine's reports over files. ``python -m spanframe COMMAND --help``."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe import __version__
from spanframe.functions import tags
from spanframe.functions import wordpiece as WP
from spanframe.names import TOKENIZERS
from spanframe.operators import align as A
from spanframe.operators import contract as C
from spanframe.operators import fertility as Fe
from spanframe.operators import packing, reports
from spanframe.operators import registry as R
from spanframe.operators import sampling as Sa
from spanframe.operators import spans as S
from spanframe.operators import tables as Tb
from spanframe.operators import vocabulary as V
from spanframe.session import stored
from spanframe.sources import config, contract, files, iob2, runs
from spanframe.stats import bootstrap, intervals


def _save(out: str | None, report: object) -> None:
    text = json.dumps(report, indent=2, ensure_ascii=False, default=str) + "\n"
    if out:
        Path(out).write_text(text, encoding="utf-8")
    sys.stdout.write(text)


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _vocabulary(path: str) -> list[str]:
    return [line for line in Path(path).read_text(encoding="utf-8").splitlines() if line]


def evaluate(spark: SparkSession, a: argparse.Namespace) -> dict:
    labels = None
    if a.labels_from:
        labels = [r[0] for r in iob2.read_iob2(spark, a.labels_from).select("label").distinct().collect()]
    rows = contract.read_predictions(spark, a.predictions, labels).withColumn("run_id", F.lit("run"))
    mappings = {side: runs.read_mapping(path)["mapping"] if path else None for side, path in (("gold", a.map_gold), ("pred", a.map_pred))}
    C.require_common_targets(mappings["gold"], mappings["pred"])
    mapped = {side: m for side, m in mappings.items() if m is not None}
    for side, other in (("gold", "pred"), ("pred", "gold")):
        if mapped and side not in mapped:
            # a side that isn't mapped must have target types already
            own = {r[0] for r in rows.select(tags.tag_type(side).alias("t")).filter("t <> ''").distinct().collect()}
            foreign = sorted(own - set(mapped[other].values()))
            if foreign:
                raise SystemExit(f"types of {side} that the mapping of {other} doesn't end in: {', '.join(foreign)}")
    for side, mapping in mapped.items():
        rows = rows.withColumn(side, tags.map_tag(side, mapping))
    total = S.evaluate(rows).drop("run_id").first().asDict()
    return total | {"per_type": {r.pop("etype"): r for r in _rows(S.prf(rows)) if r["etype"] != S.MICRO}}


def fertility(spark: SparkSession, a: argparse.Namespace) -> list:
    words = iob2.read_splits(spark, a.data)
    counted = Fe.word_counts(words, ["split"])
    return _rows(Fe.fertility(counted, WP.piece_table(counted, WP.wordpiece(counted, _vocabulary(a.vocabulary), a.lowercase)), "split"))


def overlap(spark: SparkSession, a: argparse.Namespace) -> dict:
    source, target = (iob2.read_iob2(spark, p) for p in (a.source, a.target))
    pieces = WP.wordpiece(source, _vocabulary(a.vocabulary))
    return {"all": _rows(Fe.piece_overlap(source, target, pieces))[0], "entities": _rows(Fe.piece_overlap(source, target.filter("label <> 'O'"), pieces))[0]}


def aggregate(spark: SparkSession, a: argparse.Namespace) -> list:
    found = runs.read_runs(spark, a.runs)
    by = {k: R.ALIASES.get(k, k) for k in a.by}
    metrics = {m: f"{a.block}.{m}" for m in ("precision", "recall", "f1", "accuracy")}
    flat = found.filter("metrics is not null").select(
        "run_dir", F.get_json_object("config", "$.seed").cast("long").alias("seed"), *(F.get_json_object("config", "$." + p).alias(k) for k, p in by.items()), *(F.get_json_object("metrics", "$." + p).cast("double").alias(m) for m, p in metrics.items())
    )
    grouped = flat.groupBy(*by).agg(*(f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("sd", F.stddev_samp))), F.count("*").alias("n"), F.array_sort(F.collect_list("seed")).alias("seeds"), F.array_sort(F.collect_list("run_dir")).alias("runs"))
    out = grouped.orderBy(*by)
    if a.csv:
        runs.write_csv(out.withColumns({"seeds": F.array_join(F.transform("seeds", lambda s: s.cast("string")), " "), "runs": F.array_join("runs", " ")}), a.csv)
    return _rows(out)


def _groups(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """``run_id, grp``: completed runs with the values of ``--by`` as text."""
    fields = {k: R.ALIASES.get(k, k) for k in a.by}
    found = runs.run_fields(runs.read_runs(spark, a.runs).filter("metrics is not null"), fields)
    label = F.concat_ws(", ", *(F.concat(F.lit(f"{k}="), F.coalesce(k, F.lit("null"))) for k in fields))
    return found.select(F.col("run_dir").alias("run_id"), label.alias("grp"))


class _TestSet:
    """The runs' common test set with its word and entity tables; runs over another set are an error."""

    def __init__(self, spark: SparkSession, a: argparse.Namespace) -> None:
        self.words = stored(runs.read_run_predictions(spark, a.runs).join(_groups(spark, a), "run_id") if hasattr(a, "by") else runs.read_run_predictions(spark, a.runs))
        C.require_same_set(self.words)
        self.one = stored(self.words.filter(F.col("run_id") == self.words.agg(F.min("run_id")).first()[0]).select("sentence_id", "word_idx", "word", "gold"))
        self.train = iob2.read_iob2(spark, a.train).select(F.col("sid").alias("sentence_id"), F.col("idx").alias("word_idx"), "word", F.col("label").alias("gold"))
        tokenize = TOKENIZERS[a.tokenizer](self.one, _vocabulary(a.vocabulary))
        self.pieces = stored(WP.piece_table(self.one, tokenize))
        self.entities = stored(Tb.entity_table(self.one, self.pieces, Tb.training_entities(self.train, ["sentence_id"])))

    def hits(self) -> DataFrame:
        """Entities with one row per run: ``hit``."""
        own = [c for c in ("grp",) if c in self.words.columns]
        found = S.matched_spans(self.words).filter("in_gold").select("run_id", "sentence_id", "etype", "start", "end", F.col("in_pred").alias("hit"))
        out = self.entities.join(found, ["sentence_id", "etype", "start", "end"])
        return out.join(self.words.select("run_id", *own).distinct(), "run_id") if own else out

    def errors(self) -> DataFrame:
        """Entity words with one row per run: ``error``."""
        table = Tb.word_table(self.one, self.pieces, self.train.select("word")).filter("is_entity").drop("word", "gold")
        wrong = self.words.select("run_id", "grp", "sentence_id", "word_idx", (F.col("gold") != F.col("pred")).cast("int").alias("error"))
        return wrong.join(table, ["sentence_id", "word_idx"])


_ENTITY = ["sentence_id", "start", "end", "etype", "text", "n_words", "mean_pieces", "max_pieces", "has_unk", "seen", "fertility_bin"]


def fragmentation(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Word errors and recall by pieces and frequency, odds ratios with intervals, by groups of runs; the entity file with one column per run."""
    test = _TestSet(spark, a)
    hits = stored(test.hits())
    tables = reports.fragmentation(test.errors(), hits, "grp", a.replicates, a.seed, a.least)
    if a.csv:
        names = sorted(r[0] for r in hits.select("run_id").distinct().collect())
        runs.write_csv(Tb.pivot_hits(hits, _ENTITY, names), a.csv)
    if a.text:
        files.write_file(spark, a.text, runs.format_report("Fragmentation", tables))
    return {"entities": test.entities.count(), "entities_with_unk": test.entities.filter("has_unk").count()} | {k: _rows(v) for k, v in tables.items()}


def _hits_from_file(spark: SparkSession, path: str) -> DataFrame:
    """Entities with one row per run from an entity file: each column ``hit_<run>`` is a run."""
    wide = spark.read.csv(path, header=True, escape='"')
    columns = [c for c in wide.columns if c.startswith("hit_")]
    if not columns:
        raise SystemExit(f"{path} has no hit_ columns")
    typed = wide.select(F.col("sentence_id").cast("long"), F.col("mean_pieces").cast("double"), F.col("has_unk").cast("boolean"), F.col("seen").cast("boolean"), *(F.col(f"`{c}`").cast("boolean").alias(c) for c in columns))
    each = F.array(*(F.struct(F.lit(c.removeprefix("hit_")).alias("run_id"), F.col(f"`{c}`").alias("hit")) for c in columns))
    return typed.withColumn("x", F.explode(each)).select("sentence_id", "mean_pieces", "has_unk", "seen", "x.run_id", "x.hit")


def compare(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Paired comparison of recall by subset of entities, from an entity file or from runs."""
    import yaml

    pairs = [bootstrap.Pair(p["name"], tuple(p["a"]), tuple(p["b"])) for p in yaml.safe_load(Path(a.pairs).read_text(encoding="utf-8"))]
    if not a.entities and not (a.runs and a.train and a.vocabulary):
        raise SystemExit("either --entities or --runs, --train and --vocabulary are needed")
    entities = _hits_from_file(spark, a.entities) if a.entities else _TestSet(spark, a).hits()
    hits = stored(entities.withColumn("subsets", tags.subset_names(F.col("seen"), F.col("mean_pieces"), F.col("has_unk"))))
    known = {r[0] for r in hits.select("run_id").distinct().collect()}
    missing = sorted({r for p in pairs for r in (*p.a, *p.b)} - known)
    if missing:
        raise SystemExit(f"no hits of {', '.join(missing)}")
    names = {r[0] for r in hits.select(F.explode("subsets")).distinct().collect()}
    return bootstrap.compare(hits, pairs, [n for n in tags.SUBSETS if n in names], a.replicates, a.seed)


def paired(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Two named sets of runs with equal seeds: difference of mean F1."""
    fields = runs.run_fields(runs.read_runs(spark, a.runs).filter("metrics is not null"), {"name": "name", "seed": "seed"})
    arms = {n: {int(r["seed"]): r["run_dir"] for r in fields.filter(F.col("name") == n).orderBy("run_dir").collect()} for n in (a.a, a.b)}
    if not arms[a.a] or set(arms[a.a]) != set(arms[a.b]):
        raise SystemExit(f"{a.a} and {a.b} need completed runs of the same seeds")
    if a.types and a.exclude:
        raise SystemExit("give either --types or --exclude")
    words = stored(runs.read_run_predictions(spark, a.runs, only=[r for arm in arms.values() for r in arm.values()]))
    C.require_same_set(words)
    if a.types or a.exclude:
        occurring = {r[0] for r in words.select(tags.tag_type("gold").alias("t")).filter("t <> ''").distinct().collect()}
        foreign = sorted({*a.types, *a.exclude} - occurring)
        if foreign:
            raise SystemExit(f"types that gold doesn't have: {', '.join(foreign)}")
        words = words.withColumns({c: tags.restrict_tag(c, a.types or None, a.exclude or None) for c in ("gold", "pred")})
    cube = bootstrap.cube(S.sentence_counts(words))
    at = {r: i for i, r in enumerate(cube.runs)}
    seeds = sorted(arms[a.a])
    one, two = (cube.counts[[at[arms[n][s]] for s in seeds]] for n in (a.a, a.b))
    found = bootstrap.paired_f1(one, two, a.replicates, a.seed)
    return found | {"seeds": seeds, "sign_flip_p": intervals.sign_flip_share(np.array(found["by_seed"]))}


def transfer(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Scores of the runs as they are, mapped to the target types, and on another set, with subsets of its sentences and recall by pieces."""
    groups = _groups(spark, a)
    source = stored(runs.read_run_predictions(spark, a.runs).join(groups, "run_id"))
    extra = stored(runs.read_run_predictions(spark, a.runs, a.extra).join(groups, "run_id"))
    # the source set may be labelled anew by each run's mapping: its words must agree, the other set's words and labels
    C.require_same_set(source, ("word",))
    C.require_same_set(extra)
    mapping = runs.read_mapping(a.mapping)
    for words in (source, extra.withColumn("gold", F.lit("O"))):
        unlisted = [r[0] for r in C.unmapped_types(words, mapping["mapping"]).collect()]
        if unlisted:
            raise SystemExit(f"the mapping doesn't list {', '.join(sorted(unlisted))}")
    foreign = sorted({r[0] for r in extra.select(tags.tag_type("gold").alias("t")).filter("t <> ''").distinct().collect()} - set(mapping["target_types"]))
    if foreign:
        raise SystemExit(f"gold types that aren't target types: {', '.join(foreign)}")
    pieces = stored(WP.piece_table(extra, TOKENIZERS[a.tokenizer](extra, _vocabulary(a.vocabulary))))
    tables = reports.transfer(source, extra, mapping["mapping"], "grp", pieces, a.replicates, a.seed)
    if a.csv:
        for name, rows in tables.items():
            runs.write_csv(rows, f"{a.csv}/{name}")
    if a.text:
        files.write_file(spark, a.text, runs.format_report("Transfer", tables))
    return {k: _rows(v) for k, v in tables.items()}


def extend_vocab(spark: SparkSession, a: argparse.Namespace) -> dict:
    """A vocabulary extended by the most used of a learner's pieces: skipped pieces, use, pieces per word before and after; a folder with ``--to``."""
    base = _vocabulary(a.vocabulary)
    corpus = files.read_lines(spark, a.corpus).select(F.explode(F.split("line", r"\s+")).alias("word")).filter("word <> ''")
    counted = stored(corpus.groupBy("word").agg(F.count("*").alias("n")))
    learned = runs.read_pieces(spark, a.learned)
    # use under the base vocabulary with all learned pieces
    wide = WP.wordpiece(counted, sorted({*base, *V.collected(learned)}))
    usage = stored(Fe.usage_counts(counted, WP.piece_table(counted, wide)))
    extension = V.extend(V.numbered(spark, base), learned, usage, a.size)
    listed = stored(extension.vocabulary)
    after = WP.wordpiece(counted, V.collected(listed))
    used = Fe.usage_counts(counted, WP.piece_table(counted, after))
    words = iob2.read_splits(spark, a.data).groupBy("word", (F.col("label") != "O").alias("is_entity")).agg(F.count("*").alias("n"))
    report = {
        "skipped": {r["skip"]: r["pieces"] for r in extension.skipped().collect()},
        "usage": _rows(Fe.piece_usage(extension.added, used))[0],
        "pieces_per_word": _rows(Fe.extension_report(words, WP.piece_table(words, WP.wordpiece(words, base)), WP.piece_table(words, after))),
    }
    if a.to:
        report["manifest"] = runs.write_extension(extension, a.to)
    return report


def pretrain(spark: SparkSession, a: argparse.Namespace) -> dict:
    """The input of a pre-training run: its corpus cut into chunks and masked, written as a table; nothing is trained."""
    settings = config.read_pretraining(a.config)
    pieces = _vocabulary(a.vocabulary)
    budget = settings["chunker.max_len"] - A.RESERVED
    lines = files.read_lines(spark, settings["corpus.path"]).select("line_no", F.filter(F.split("line", r"\s+"), lambda w: w != "").alias("words"))
    sized = A.piece_sizes(lines, _vocabulary(a.chunker) if a.chunker else pieces, "words")
    most = a.max_chunks if a.max_chunks is not None else settings["corpus.max_chunks"]
    chunks = stored(packing.packed_text(sized, ["line_no"], "words", "sizes", budget, most))
    encoded = A.tokenized_words(chunks.select("chunk", "words"), pieces, "words", settings["model.max_len"])
    masking = A.Masking(settings["seed"], settings["masking.probability"], settings["masking.mask_share"], settings["masking.random_share"])
    A.masked_examples(encoded, "chunk", pieces.index("[MASK]"), len(pieces), masking).write.mode("overwrite").parquet(a.to)
    core = {k: v for k, v in settings.items() if k not in config.PLACES and v is not None}
    return {"run_id": runs.run_id(core, code=config.code_identity()["code_ref"])} | _rows(packing.packing_report(chunks, most))[0]


def rescore(spark: SparkSession, a: argparse.Namespace) -> list:
    """Scores of stored predictions in an older layout, as they are and completed from a gold file, beside the stored ones."""
    gold = iob2.read_iob2(spark, a.gold)
    out = [{"variant": "stored"} | json.loads(Path(a.metrics).read_text(encoding="utf-8"))] if a.metrics else []
    for variant, completed in (("as it is", None), ("complete", gold)):
        rows = stored(contract.read_older(spark, a.predictions, completed).withColumn("run_id", F.lit("run")))
        out.append({"variant": variant} | {k: v for k, v in S.evaluate(rows).first().asDict().items() if k != "run_id"})
    return out


def subset(spark: SparkSession, a: argparse.Namespace) -> dict:
    """A seeded training subset and a held-out sample that shares no text with it, as label files with a manifest."""
    words = stored(iob2.read_iob2(spark, a.source))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]), " ")
    texts = stored(words.groupBy("sid").agg(text.alias("text")))
    train = stored(Sa.exact_sample(texts, "sid", a.fraction, a.seed))
    held = Sa.heldout_sample(texts.join(train, "sid", "left_anti"), train, "text", "sid", a.heldout, a.heldout_seed)
    report: dict = {"source": {"sentences": texts.count()}, "fraction": a.fraction, "seed": a.seed, "heldout": a.heldout, "heldout_seed": a.heldout_seed, "files": {}}
    for name, chosen in (("train_subset", train), ("heldout", held)):
        iob2.write_iob2(words.join(chosen.select("sid"), "sid", "left_semi"), f"{a.to}/{name}")
        digests = {r["file"]: r["sha256"] for r in files.checksums(spark, f"{a.to}/{name}/part-*").collect()}
        report["files"][name] = {"sentences": chosen.count(), "digest": runs.data_digest({str(i): digests[f] for i, f in enumerate(sorted(digests))})}
    files.write_file(spark, f"{a.to}/manifest.json", json.dumps(report, indent=2) + "\n")
    return report


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanframe", description=__doc__)
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--cores", default="*")
    commands = p.add_subparsers(dest="command", required=True)

    def command(function, *options: tuple, **more) -> None:
        c = commands.add_parser(function.__name__.replace("_", "-"), help=(function.__doc__ or "").split("\n")[0], **more)
        c.add_argument("--out")
        for names, settings in options:
            c.add_argument(names, **settings)
        c.set_defaults(function=function)

    need, many = {"required": True}, {"nargs": "*", "default": []}
    draws = (("--replicates", {"type": int, "default": 10_000}), ("--seed", {"type": int, "default": 42}))
    command(evaluate, ("--predictions", need), ("--labels-from", {}), ("--map-gold", {}), ("--map-pred", {}))
    command(fertility, ("--data", need), ("--vocabulary", need), ("--lowercase", {"action": "store_true"}))
    command(overlap, ("--source", need), ("--target", need), ("--vocabulary", need))
    command(aggregate, ("--runs", need), ("--by", {"nargs": "+", "default": ["model", "method"]}), ("--block", {"default": "test_contract"}), ("--csv", {}))
    by = ("--by", {"nargs": "+", "default": ["model", "method"]})
    tokens = (("--vocabulary", need), ("--tokenizer", {"default": "wordpiece"}))
    command(fragmentation, ("--runs", need), ("--train", need), *tokens, by, ("--csv", {}), ("--text", {}), ("--least", {"type": int, "default": Tb.LEAST_CELL}), ("--replicates", {"type": int, "default": 200}), draws[1])
    command(compare, ("--entities", {}), ("--runs", {}), ("--train", {}), ("--vocabulary", {}), ("--tokenizer", {"default": "wordpiece"}), ("--pairs", need), *draws)
    command(paired, ("--runs", need), ("--a", need), ("--b", need), ("--types", many), ("--exclude", many), *draws)
    command(transfer, ("--runs", need), ("--extra", need), ("--mapping", need), *tokens, by, ("--csv", {}), ("--text", {}), ("--replicates", {"type": int, "default": 1000}), draws[1])
    command(extend_vocab, ("--vocabulary", need), ("--learned", need), ("--corpus", need), ("--data", need), ("--size", {"type": int, "required": True}), ("--to", {}))
    command(pretrain, ("--config", need), ("--vocabulary", need), ("--chunker", {}), ("--max-chunks", {"type": int}), ("--to", need))
    command(rescore, ("--predictions", need), ("--gold", need), ("--metrics", {}))
    command(subset, ("--source", need), ("--to", need), ("--fraction", {"type": float, "default": 0.1}), ("--seed", {"type": int, "default": 42}), ("--heldout", {"type": int, "default": 5000}), ("--heldout-seed", {"type": int, "default": 42}))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    from spanframe.session import local_session

    _save(a.out, a.function(spark or local_session(a.cores), a))
    return 0
