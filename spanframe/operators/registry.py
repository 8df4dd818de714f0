"""The run registry: completed runs, arms, summaries over seeds, and transfer summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short names of configuration fields (fixed values).
ALIASES = {
    "method": "method.name",
    "fraction": "data.train_fraction",
    "model": "model.name",
    "lr": "training.learning_rate",
    "epochs": "training.epochs",
    "r": "method.lora.r",
    "max_len": "model.max_len",
}


def config_field(df: DataFrame, key: str) -> Column:
    """A configuration field by alias or dotted path; an unknown path is an error that names it."""
    path = ALIASES.get(key, key)
    kind = df.schema["config"].dataType
    for part in path.split("."):
        if not hasattr(kind, "fieldNames") or part not in kind.fieldNames():
            raise KeyError(f"config has no field {path!r}")
        kind = kind[part].dataType
    return F.col(f"config.{path}")


def registered(runs: DataFrame) -> DataFrame:
    """One row per run: the last registration counts, of equal or missing times the greatest by its fields."""
    fields = [c for c in runs.columns if c not in ("run_id", "registered_at")]
    last = runs.groupBy("run_id").agg(F.max(F.struct("registered_at", *fields)).alias("x"))
    return last.select("run_id", *(F.col(f"x.{c}") for c in fields))


def completed(runs: DataFrame) -> DataFrame:
    """Runs with a configuration and metrics."""
    return runs.filter("config is not null and metrics is not null")


def skipped(runs: DataFrame) -> DataFrame:
    """Runs with a configuration but no metrics: they are reported, not counted."""
    return runs.filter("config is not null and metrics is null").select("run_id")


def select_arm(runs: DataFrame, name: str) -> DataFrame:
    """``run_id, seed`` of the completed runs of one name; a repeated seed, or no run, is an error."""
    arm = completed(runs).filter(F.col("config.name") == name).select("run_id", F.col("config.seed").alias("seed"))
    counted = arm.groupBy("seed").agg(F.count("*").alias("n"), F.min("run_id").alias("run_id")).orderBy("seed").collect()
    if not counted:
        raise ValueError(f"no completed run is named {name!r}")
    repeated = [r["seed"] for r in counted if r["n"] > 1]
    if repeated:
        raise ValueError(f"{name!r} has several runs of seed {', '.join(map(str, repeated))}")
    return arm


def exact_mean(c: Column | str) -> Column:
    """The mean of values below 10^8, summed as decimals of twelve places: the same in whatever order rows come; null without any value."""
    value = F.col(c) if isinstance(c, str) else c
    total, n = F.sum(value.cast("decimal(20,12)")), F.count(value)
    return (total.cast("decimal(22,12)") / F.nullif(n, F.lit(0)).cast("decimal(10,0)")).cast("double")


def aggregate(runs: DataFrame, by: list[str], block: str = "test_contract", metrics: tuple[str, ...] = ("precision", "recall", "f1", "accuracy")) -> DataFrame:
    """Mean and sample sd (null for one run) of the metrics by configuration fields, with number, seeds and runs.

    Means are of exact decimals of twelve places, so that they don't depend on the order of rows. Seeds and runs are listed in order of seed, then run. ``code_refs`` above 1 means that a group mixes code versions. Groups come by
    the fields' values as text.
    """
    done = completed(runs)
    keys = [config_field(done, k).alias(k) for k in by]
    rows = done.select(*keys, "run_id", F.col("config.seed").alias("_seed"), "code_ref", *(F.col(f"metrics.{block}.{m}").alias(m) for m in metrics))
    members = F.array_sort(F.collect_list(F.struct(F.coalesce("_seed", F.lit(-1)).alias("s"), F.col("run_id").alias("id"))))
    grouped = rows.groupBy(*by).agg(
        *(exact_mean(m).alias(f"{m}_mean") for m in metrics),
        *(F.stddev_samp(m).alias(f"{m}_sd") for m in metrics),
        F.count("*").alias("n"),
        F.array_join(F.transform(members, lambda x: x["s"].cast("string")), " ").alias("seeds"),
        F.array_join(F.transform(members, lambda x: x["id"]), " ").alias("runs"),
        F.count_distinct("code_ref").alias("code_refs"),
    )
    return grouped


def transfer_summary(scores: DataFrame, by: list[str], metrics: tuple[str, ...] = ("f1",)) -> DataFrame:
    """Mean and sample sd of the metrics per group and type over runs; a run without the type counts 0; support is the largest.

    ``scores``: ``*by, run_id, etype, support`` and the metrics. The grid of runs and types of each group is built by a join on the group's key.
    """
    runs = scores.select(*by, "run_id").distinct()
    types = scores.select(*by, "etype").distinct()
    grid = runs.join(types, by) if by else runs.withColumn("_k", F.lit(1)).join(types.withColumn("_k", F.lit(1)), "_k").drop("_k")
    zero = {m: F.coalesce(m, F.lit(0.0)) for m in metrics} | {"support": F.coalesce("support", F.lit(0))}
    filled = grid.join(scores, [*by, "run_id", "etype"], "left").withColumns(zero)
    spread = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    return filled.groupBy(*by, "etype").agg(*spread, F.max("support").alias("support"), F.count("*").alias("runs"))


def subset_summary(scores: DataFrame, by: list[str]) -> DataFrame:
    """Mean and sample sd over runs of the micro scores of each subset: ``scores`` as from :func:`subset_scores`, with the ``by`` columns."""
    spread = [f(m).alias(f"{m}_{n}") for m in ("precision", "recall", "f1") for n, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    return scores.groupBy(*by, "subset").agg(*spread, F.max("sentences").alias("sentences"), F.count("*").alias("runs"))


def sentence_subsets(sentences: DataFrame) -> DataFrame:
    """``sentence_id, subset``: the kinds of sentences, ``all``, and ``other_unique``, the first copy of each distinct other sentence.

    ``sentences``: ``sentence_id, words``.
    """
    from spanframe.functions import tags

    kinds = sentences.select("sentence_id", "words", tags.sentence_kind("words").alias("kind"))
    first = kinds.filter("kind = 'other'").groupBy("words").agg(F.min("sentence_id").alias("sentence_id")).select("sentence_id", F.lit("other_unique").alias("subset"))
    each = kinds.select("sentence_id", F.explode(F.array(F.lit("all"), F.col("kind"))).alias("subset"))
    return each.unionByName(first)


def subset_scores(counts: DataFrame, subsets: DataFrame) -> DataFrame:
    """Micro scores of each run on each subset of sentences, from summed sentence counts."""
    from spanframe.operators.spans import scores

    summed = counts.join(subsets, "sentence_id").groupBy("run_id", "subset").agg(F.count("*").alias("sentences"), *(F.sum(c).alias(c) for c in ("n_correct", "n_pred", "n_gold")))
    return summed.select("run_id", "subset", "sentences", *(v.alias(k) for k, v in scores(F.col("n_correct"), F.col("n_pred"), F.col("n_gold")).items()))


def head_rows(mapping: dict[str, list[str]], outside: bool = True, source_labels: list[str] | None = None, target_labels: list[str] | None = None) -> list[tuple[str, str]]:
    """(source label, target label) pairs of a head mapping: B and I of each type pair, and O to O.

    With label sets, the mapping must list exactly the source's types, and every label of a pair must exist on its side.
    """
    pairs = [("O", "O")] if outside else []
    claimed: dict[str, str] = {}
    if source_labels is not None:
        own = {x[2:] for x in source_labels if x != "O"}
        if own != set(mapping):
            raise ValueError(f"the mapping must list the source's types: {', '.join(sorted(own ^ set(mapping)))} differ")
    for source, targets in mapping.items():
        for target in targets:
            if target in claimed:
                raise ValueError(f"target type {target!r} is taken from {claimed[target]!r} and {source!r}")
            claimed[target] = source
            pairs += [(f"{p}-{source}", f"{p}-{target}") for p in "BI"]
    for side, labels in ((0, source_labels), (1, target_labels)):
        missing = [] if labels is None else sorted({p[side] for p in pairs} - set(labels))
        if missing:
            raise ValueError(f"labels that are missing on the {('source', 'target')[side]} side: {', '.join(missing)}")
    return pairs
