"""Queries: registry, summaries over runs, subset scores, inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe.operators import registry as R
from spanframe.operators import spans as S
from spanframe.plans import sql
from spanframe.plans.registry import CORE
from spanframe.plans.spans import words
from spanframe.plans.tokens import WORDS, split_words, test_contract, word_table_of
from spanframe.session import checkpointed, stored, table
from spanframe.stats import bootstrap, logistic, resample
from spanframe.stats import intervals as T

RUNS = "reg AS (SELECT run_id, x.config AS config, x.metrics AS metrics, x.code_ref AS code_ref FROM (SELECT run_id, arg_max({'config': config, 'metrics': metrics, 'code_ref': code_ref}, registered_at) AS x FROM runs GROUP BY run_id)), done AS (SELECT * FROM reg WHERE config IS NOT NULL AND metrics IS NOT NULL)"


def registered(spark, sf_dir):
    return R.registered(table(spark, sf_dir, "runs"))


_METRICS = ("precision", "recall", "f1", "accuracy")


def _exact_mean(value: str) -> str:
    """The mean rounded to eight places, half up, from whole numbers of 10^-12: no order of rows changes it."""
    total, n = f"sum(CAST(round({value} * 1e12) AS HUGEINT))", f"count({value})"
    return f"((2 * {total} + {n} * 10000) // (2 * nullif({n}, 0) * 10000))::DOUBLE / 1e8"


def _aggregate_sql(by: dict[str, str]) -> str:
    keys = ", ".join(f"{path} AS {name}" for name, path in by.items())
    means = ", ".join(f'{_exact_mean(f"""metrics.test_contract."{m}\"""")} AS {m}_mean, round(stddev_samp(metrics.test_contract."{m}"), 8) AS {m}_sd' for m in _METRICS)
    order = "ORDER BY coalesce(config.seed, -1), run_id"
    return f"WITH {RUNS} SELECT {keys}, {means}, count(*) AS n, string_agg(coalesce(config.seed, -1)::VARCHAR, ' ' {order}) AS seeds, string_agg(run_id, ' ' {order}) AS runs, count(DISTINCT code_ref) AS code_refs FROM done GROUP BY {', '.join(by.values())}"


def _aggregated(df):
    return df.withColumns({f"{m}_{k}": F.round(f"{m}_{k}", 8) for m in _METRICS for k in ("mean", "sd")})


@CORE.register("aggregate_runs", _aggregate_sql({"method": "config.method.name", "model": "config.model.name"}))
def aggregate_runs(spark, sf_dir):
    return _aggregated(R.aggregate(registered(spark, sf_dir), ["method", "model"]))


@CORE.register("aggregate_runs_fraction", _aggregate_sql({"name": "config.name", "fraction": "config.data.train_fraction"}))
def aggregate_runs_fraction(spark, sf_dir):
    return _aggregated(R.aggregate(registered(spark, sf_dir), ["name", "fraction"]))


@CORE.register("skipped_runs", f"WITH {RUNS} SELECT run_id FROM reg WHERE config IS NOT NULL AND metrics IS NULL")
def skipped_runs(spark, sf_dir):
    return R.skipped(registered(spark, sf_dir))


@CORE.register("run_arms", f"WITH {RUNS} SELECT config.name AS name, count(*) AS runs, count(DISTINCT config.seed) AS seeds, count(*) > count(DISTINCT config.seed) AS repeated FROM done GROUP BY 1")
def run_arms(spark, sf_dir):
    done = R.completed(registered(spark, sf_dir))
    n, k = F.count("*"), F.count_distinct("config.seed")
    return done.groupBy(F.col("config.name").alias("name")).agg(n.alias("runs"), k.alias("seeds"), (n > k).alias("repeated"))


@CORE.register("seed_expansion", f"WITH {RUNS} SELECT config.name AS name, unnest(list_sort(list(DISTINCT config.seed))) AS seed FROM reg WHERE config IS NOT NULL GROUP BY 1")
def seed_expansion(spark, sf_dir):
    reg = registered(spark, sf_dir).filter("config is not null")
    return reg.groupBy(F.col("config.name").alias("name")).agg(F.collect_set("config.seed").alias("s")).select("name", F.explode("s").alias("seed"))


METHODS = f"{RUNS}, methods AS (SELECT run_id, coalesce(config.method.name, 'none') AS method, config.seed AS seed FROM done)"
CELLS = f"""{WORDS}, {METHODS}, test_contract AS (SELECT c.* FROM contract c JOIN splits s USING (sentence_id) WHERE s.split = 'test'), {sql.spans("test_contract")},
cells AS (SELECT c.run_id, c.sentence_id, m.method, m.seed, count(*) FILTER (WHERE in_gold AND in_pred) AS n_correct, count(*) FILTER (WHERE in_pred) AS n_pred, count(*) FILTER (WHERE in_gold) AS n_gold
  FROM (SELECT DISTINCT run_id, sentence_id FROM test_contract) c JOIN methods m USING (run_id) LEFT JOIN matched USING (run_id, sentence_id) GROUP BY ALL)"""


def f1_sql(by: str, replicates: int, seed: int) -> str:
    """CTEs from ``cells`` to ``scored``: F1 by ``by`` and replicate."""
    return f"""sums AS (SELECT {by}, sentence_id, sum(n_correct) AS c, sum(n_pred + n_gold) AS t FROM cells GROUP BY ALL), {sql.weights("cells", replicates, seed)},
scored AS (SELECT {by}, rep, coalesce(2 * sum(c * w)::DOUBLE / nullif(sum(t * w), 0), 0) AS f1 FROM sums JOIN weights USING (sentence_id) GROUP BY ALL)"""


_ARMS = f"""{sql.CONTRACT}, {RUNS}, {sql.spans()}, {sql.prf("run_id")}, scored AS (
  SELECT d.config.method.name AS method, p.* FROM prf p JOIN done d USING (run_id) WHERE d.config.method.name IS NOT NULL
)"""


def _scored(spark, sf_dir):
    done = R.completed(registered(spark, sf_dir)).select("run_id", F.col("config.method.name").alias("method")).filter("method is not null")
    return S.prf(words(spark, sf_dir), ["run_id"]).join(done, "run_id")


@CORE.register(
    "transfer_summary",
    f"""WITH {_ARMS}, grid AS (SELECT * FROM (SELECT DISTINCT method, run_id FROM scored) JOIN (SELECT DISTINCT method, etype FROM scored) USING (method))
    SELECT method, etype, round(avg(coalesce(f1, 0)), 8) AS f1_mean, round(stddev_samp(coalesce(f1, 0)), 8) AS f1_sd, max(coalesce(support, 0)) AS support, count(*) AS runs FROM grid LEFT JOIN scored USING (method, run_id, etype) GROUP BY ALL""",
)
def transfer_summary(spark, sf_dir):
    scored = _scored(spark, sf_dir).select("method", "run_id", "etype", "f1", "support")
    return R.transfer_summary(scored, ["method"]).withColumns({"f1_mean": F.round("f1_mean", 8), "f1_sd": F.round("f1_sd", 8)})


@CORE.register(
    "transfer_metrics",
    f"""WITH {_ARMS}, grid AS (SELECT * FROM (SELECT DISTINCT method, run_id FROM scored) JOIN (SELECT DISTINCT method, etype FROM scored) USING (method))
    SELECT method, etype, {", ".join(f'round(avg(coalesce("{m}", 0)), 8) AS {m}_mean, round(stddev_samp(coalesce("{m}", 0)), 8) AS {m}_sd' for m in ("precision", "recall", "f1"))}, max(coalesce(support, 0)) AS support, count(*) AS runs
    FROM grid LEFT JOIN scored USING (method, run_id, etype) GROUP BY ALL""",
)
def transfer_metrics(spark, sf_dir):
    """Mean and sd of precision, recall and F1 by method and type."""
    metrics = ("precision", "recall", "f1")
    out = R.transfer_summary(_scored(spark, sf_dir).select("method", "run_id", "etype", "support", *metrics), ["method"], metrics)
    return out.withColumns({f"{m}_{k}": F.round(f"{m}_{k}", 8) for m in metrics for k in ("mean", "sd")})


_SUBSETS = f"""{WORDS}, sent AS (SELECT sentence_id, list(word ORDER BY word_idx) AS w FROM words GROUP BY ALL), kinds AS (SELECT *, CASE WHEN w[1] = 'АЙДАУ' THEN 'redirect' WHEN w[1] IN ('''', '''''') THEN 'bold_title' ELSE 'other' END AS kind FROM sent),
subsets AS (SELECT sentence_id, unnest(['all', kind]) AS subset FROM kinds UNION ALL SELECT min(sentence_id), 'other_unique' FROM kinds WHERE kind = 'other' GROUP BY w)"""


def subsets_of(spark, sf_dir):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda s: s["word"])
    return R.sentence_subsets(split_words(spark, sf_dir).groupBy("sentence_id").agg(ordered.alias("words")))


@CORE.register("sentence_subsets", f"WITH {_SUBSETS} SELECT * FROM subsets")
def sentence_subsets(spark, sf_dir):
    return subsets_of(spark, sf_dir)


@CORE.register(
    "subset_scores",
    f"""WITH {_SUBSETS}, {sql.spans()}, cube AS (SELECT c.run_id, c.sentence_id, count(*) FILTER (WHERE in_gold AND in_pred) AS n_correct, count(*) FILTER (WHERE in_pred) AS n_pred, count(*) FILTER (WHERE in_gold) AS n_gold
      FROM (SELECT DISTINCT run_id, sentence_id FROM contract) c LEFT JOIN matched m USING (run_id, sentence_id) GROUP BY ALL), s AS (SELECT run_id, subset, count(*) AS sentences, sum(n_correct) AS c, sum(n_pred) AS p, sum(n_gold) AS g FROM cube JOIN subsets USING (sentence_id) GROUP BY ALL)
    SELECT run_id, subset, sentences, coalesce(c::DOUBLE / nullif(p, 0), 0) AS "precision", coalesce(c::DOUBLE / nullif(g, 0), 0) AS recall, coalesce((2 * c)::DOUBLE / nullif(p + g, 0), 0) AS f1 FROM s""",
)
def subset_scores(spark, sf_dir):
    return R.subset_scores(S.sentence_counts(words(spark, sf_dir)), subsets_of(spark, sf_dir))


_SUBSET_CELLS = f"""{CELLS}, {_SUBSETS.removeprefix(WORDS).lstrip(", ")}, in_subset AS (SELECT c.*, s.subset FROM cells c JOIN subsets s USING (sentence_id))"""


@CORE.register(
    "subset_intervals",
    f"""WITH {_SUBSET_CELLS}, sums AS (SELECT subset, run_id, sentence_id, sum(n_correct) AS c, sum(n_pred + n_gold) AS t FROM in_subset WHERE method = 'full' GROUP BY ALL), {sql.weights("sums", 200, 42)},
    scored AS (SELECT subset, run_id, rep, coalesce(2 * sum(c * w)::DOUBLE / nullif(sum(t * w), 0), 0) AS f1 FROM sums JOIN weights USING (sentence_id) GROUP BY ALL), means AS (SELECT subset, rep, avg(f1) AS f1 FROM scored GROUP BY ALL),
    s AS ({sql.summary("subset", "f1", "f1", "means")}), r AS (SELECT subset, run_id, sum(n_correct) AS c, sum(n_pred) AS p, sum(n_gold) AS g, count(*) AS sentences FROM in_subset WHERE method = 'full' GROUP BY ALL),
    m AS (SELECT subset, {", ".join(f"round(avg({x}), 8) AS {n}_mean, round(stddev_samp({x}), 8) AS {n}_sd" for n, x in (("precision", "coalesce(c::DOUBLE / nullif(p, 0), 0)"), ("recall", "coalesce(c::DOUBLE / nullif(g, 0), 0)"), ("f1", "coalesce((2 * c)::DOUBLE / nullif(p + g, 0), 0)")))},
      max(sentences) AS sentences, count(*) AS runs FROM r GROUP BY subset)
    SELECT m.*, round(low, 8) AS low, round(high, 8) AS high FROM m JOIN s USING (subset)""",
)
def subset_intervals(spark, sf_dir):
    """Micro scores of full fine-tuning on each subset of test sentences: mean and sd over runs, and the interval of the mean F1."""
    counts = stored(_arm_counts(spark, sf_dir).filter("method = 'full'"))
    subsets = stored(subsets_of(spark, sf_dir))
    summary = R.subset_summary(R.subset_scores(counts, subsets), [])
    interval = resample.mean_f1(counts.join(subsets, "sentence_id"), ["subset"], 200, 42).select("subset", "low", "high")
    names = [c for c in summary.columns if c.endswith(("_mean", "_sd"))]
    return summary.join(interval, "subset").withColumns({c: F.round(c, 8) for c in (*names, "low", "high")})


@CORE.register(
    "percentile_ci",
    """SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.025), 6) AS low, round(quantile_cont(o_totalprice, 0.975), 6) AS high FROM orders GROUP BY 1""",
)
def percentile_ci(spark, sf_dir):
    low, high = T.interval("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_P = "p AS (SELECT method, etype, least(1.0, 2 * least((1 + count(*) FILTER (WHERE f1 - 0.9 <= 0))::DOUBLE / (1 + count(*)), (1 + count(*) FILTER (WHERE f1 - 0.9 >= 0))::DOUBLE / (1 + count(*)))) AS p FROM scored GROUP BY ALL)"


@CORE.register(
    "holm_adjust",
    f"""WITH {_ARMS}, {_P}, s AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY method) - row_number() OVER (PARTITION BY method ORDER BY p, etype) + 1) * p) AS s FROM p)
    SELECT method, etype, round(p, 8) AS p, round(max(s) OVER (PARTITION BY method ORDER BY p, etype ROWS UNBOUNDED PRECEDING), 8) AS p_holm FROM s""",
)
def holm_adjust(spark, sf_dir):
    """Two-sided p of the runs' F1 against 0.9 by method and type, corrected within each method."""
    p = _scored(spark, sf_dir).groupBy("method", "etype").agg(T.two_sided_p(F.col("f1") - 0.9).alias("p"))
    return T.holm(p, "p", "etype", ["method"]).select("method", "etype", F.round("p", 8).alias("p"), F.round("p_holm", 8).alias("p_holm"))


_FLIP = "d AS (SELECT method, list(f1 - 0.9 ORDER BY run_id)[1:10] AS d FROM scored WHERE etype = 'micro' GROUP BY method)"


@CORE.register(
    "sign_flip",
    f"""WITH {_ARMS}, {_FLIP}, m AS (SELECT method, d, unnest(range(1 << len(d))) AS m FROM d), s AS (SELECT method, len(d)::INT AS k, list_sum(d) AS o, list_sum(list_transform(range(len(d)), lambda i: d[i + 1] * (1 - 2 * ((m >> i) & 1)))) AS s FROM m)
    SELECT method, k, count(*) FILTER (WHERE abs(s) >= abs(o) - 1e-12)::DOUBLE / count(*) AS p FROM s GROUP BY ALL""",
)
def sign_flip(spark, sf_dir):
    """Exact sign-flip test of the first ten runs' F1 against 0.9 by method."""
    from spanframe.operators.sampling import first_k

    micro = _scored(spark, sf_dir).filter("etype = 'micro'").withColumn("d", F.col("f1") - 0.9)
    return T.sign_flip(first_k(micro, ["method"], "run_id", 10), "d", ["method"], "run_id")


@CORE.register("sign_flip_all")
def sign_flip_all(spark, sf_dir):
    """Exact sign-flip test of all runs' F1 against 0.9 by method."""
    micro = _scored(spark, sf_dir).filter("etype = 'micro'").withColumn("d", F.col("f1") - 0.9)
    return T.sign_flip_split(micro, "d", ["method"], "run_id")


@CORE.register(
    "compare_point",
    f"""WITH {_ARMS}, h AS (SELECT method, etype, avg(recall) AS r FROM scored GROUP BY ALL) SELECT b.etype, round(a.r, 8) AS recall_a, round(b.r, 8) AS recall_b, round(b.r - a.r, 8) AS delta FROM h a JOIN h b USING (etype) WHERE a.method = 'lora' AND b.method = 'full'""",
)
def compare_point(spark, sf_dir):
    """Mean recall by type of two methods and their difference."""
    r = _scored(spark, sf_dir).groupBy("method", "etype").agg(F.avg("recall").alias("r"))
    a, b = (r.filter(F.col("method") == m).select("etype", F.col("r").alias(n)) for m, n in (("lora", "recall_a"), ("full", "recall_b")))
    return a.join(b, "etype").select("etype", F.round("recall_a", 8).alias("recall_a"), F.round("recall_b", 8).alias("recall_b"), F.round(F.col("recall_b") - F.col("recall_a"), 8).alias("delta"))


def _arm_counts(spark, sf_dir):
    """Counts of the test sentences by run with ``method``; runs without one are named ``none``."""
    done = R.completed(registered(spark, sf_dir)).select("run_id", F.coalesce("config.method.name", F.lit("none")).alias("method"))
    return S.sentence_counts(test_contract(spark, sf_dir)).join(done, "run_id")


@CORE.register("bootstrap_poisson", f"""WITH {CELLS}, {f1_sql("method", 200, 42)}, s AS ({sql.summary("method", "f1", "f1", "scored")}) SELECT method, round(f1, 8) AS f1, round(low, 8) AS low, round(high, 8) AS high FROM s""")
def bootstrap_poisson(spark, sf_dir):
    found = resample.micro_f1(_arm_counts(spark, sf_dir), ["method"], 200, 42)
    return found.withColumns({c: F.round(c, 8) for c in ("f1", "low", "high")})


@CORE.register("bootstrap_mean_f1")
def bootstrap_mean_f1(spark, sf_dir):
    """Seeded bootstrap interval of the mean F1 of all runs over the test sentences, by method; runs without one are named ``none``."""
    counts = checkpointed(_arm_counts(spark, sf_dir))
    rows = []
    for method in [r[0] for r in counts.select("method").distinct().orderBy("method").collect()]:
        cube = bootstrap.cube(counts.filter(F.col("method") == method))
        rows.append((method, float(bootstrap.f1(cube.counts.sum(axis=1)).mean()), *bootstrap.mean_f1(cube.counts, 1000, 42)))
    return spark.createDataFrame(rows, "method string, f1 double, low double, high double")


@CORE.register("irls_odds_ratios")
def irls_odds_ratios(spark, sf_dir):
    """Odds ratios of a word error per piece, log frequency and character, by method."""
    done = R.completed(registered(spark, sf_dir)).select("run_id", F.coalesce("config.method.name", F.lit("none")).alias("method"))
    errors = test_contract(spark, sf_dir).select("run_id", "sentence_id", "word_idx", (F.col("gold") != F.col("pred")).cast("int").alias("error"))
    table_ = word_table_of(spark, sf_dir).filter("is_entity").select("sentence_id", "word_idx", "pieces", "freq", "chars", "is_begin", "etype")
    return logistic.odds_ratios_by(errors.join(table_, ["sentence_id", "word_idx"]).join(done, "run_id"), "method")


@CORE.register("logistic_patterns", f"""WITH {sql.CONTRACT}, p AS (SELECT least(ceil(length(word) / 4.0)::INT, 8)::DOUBLE AS pieces, length(word)::DOUBLE AS chars, (gold LIKE 'B-%')::INT AS is_begin, substr(gold, 3) AS etype, (gold <> pred)::INT AS error FROM contract WHERE gold <> 'O')
    SELECT pieces, chars, is_begin, etype, count(*) AS n, sum(error)::BIGINT AS errors FROM p GROUP BY ALL""")
def logistic_patterns(spark, sf_dir):
    from spanframe.functions import tags

    w = words(spark, sf_dir).filter("gold <> 'O'").select(
        F.ceil(F.length("word") / 4).cast("int").alias("pieces"), F.lit(0).alias("freq"), F.length("word").alias("chars"), F.col("gold").startswith("B-").alias("is_begin"), tags.tag_type("gold").alias("etype"), (F.col("gold") != F.col("pred")).cast("int").alias("error")
    )
    return logistic.patterns(w, []).drop("log_freq")
