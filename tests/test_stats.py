import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanframe.operators import registry as R
from spanframe.stats import bootstrap as B
from spanframe.stats import intervals as T
from spanframe.stats import logistic as L
from spanframe.stats import resample as Rs

SMALL = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


def test_logistic_closed_form():
    x = np.array([[1.0, 0.0], [1.0, 1.0]])
    beta = L.fit(x, np.array([100.0, 100.0]), np.array([25.0, 40.0]), ridge=0.0)
    assert np.exp(beta[1]) == pytest.approx(40 * 75 / (60 * 25))


def test_aggregated_fit_equals_row_fit():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(400), rng.integers(1, 4, 400), rng.integers(0, 2, 400)]).astype(float)
    y = (rng.random(400) < 0.3).astype(float)
    keys, at = np.unique(x, axis=0, return_inverse=True)
    at = at.ravel()
    grouped = L.fit(keys, np.bincount(at).astype(float), np.bincount(at, y))
    assert np.allclose(grouped, L.fit(x, np.ones(400), y))


def test_separation_stays_finite_and_constant_is_null():
    rows = [{"pieces": 1.0, "log_freq": 0.0, "chars": 2.0, "is_begin": 1, "etype": "A", "n": 5, "errors": 0}, {"pieces": 5.0, "log_freq": 0.0, "chars": 2.0, "is_begin": 1, "etype": "A", "n": 5, "errors": 5}]
    assert np.isfinite(L.odds_ratios(rows)["pieces"])
    assert L.odds_ratios(rows[:1]) == {"pieces": None, "log_freq": None, "chars": None} == L.odds_ratios([])


def test_odds_ratios_by_group(spark):
    rows = [(g, p, f, 3 + p, True, t, (p + i) % 3 == 0) for g in "ab" for i in range(40) for p in (1, 2, 9) for f, t in ((0, "X"), (3, "Y"))]
    df = spark.createDataFrame(rows, "g string, pieces int, freq int, chars int, is_begin boolean, etype string, error boolean")
    out = {(r["g"], r["feature"]): r["odds_ratio"] for r in L.odds_ratios_by(df, "g").collect()}
    want = L.odds_ratios(L.patterns(df.filter("g = 'a'"), []).collect())
    assert len(out) == 6 and out["a", "pieces"] == pytest.approx(want["pieces"])


def test_holm_and_sign_flip(spark):
    assert B.step_down([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06]) and B.step_down([0.6, 0.7]) == [1.0, 1.0]
    df = spark.createDataFrame([("a", 1, 0.01), ("b", 1, 0.04), ("c", 1, 0.03), ("d", 2, 0.6), ("e", 2, 0.7)], "h string, g int, p double")
    got = {r["h"]: r["p_holm"] for r in T.holm(df, "p", "h", ["g"]).collect()}
    assert got == {k: pytest.approx(v) for k, v in {"a": 0.03, "b": 0.06, "c": 0.06, "d": 1.0, "e": 1.0}.items()}
    cases = {"x": ([1.0, -1.0], 1.0), "y": ([1.0, 2.0, 3.0, 4.0], 2 / 16), "z": ([0.5, 0.5, -0.1], 4 / 8)}
    rows = [(k, i, v) for k, (d, _) in cases.items() for i, v in enumerate(d)]
    found = {r["k0"]: r["p"] for r in T.sign_flip(spark.createDataFrame(rows, "k0 string, i int, d double"), "d", ["k0"], "i").collect()}
    assert found == {k: pytest.approx(p) for k, (_, p) in cases.items()}
    assert {k: T.sign_flip_share(np.array(d)) for k, (d, _) in cases.items()} == found
    with pytest.raises(ValueError):
        T.sign_flip_share(np.ones(51))


def test_interval_and_p(spark):
    values = [float(v) for v in np.random.default_rng(2).normal(size=101)]
    df = spark.createDataFrame([(v,) for v in [*values, float("nan")]], "v double")
    low, high = T.interval("v")
    row = df.agg(low.alias("lo"), high.alias("hi")).first()
    assert (row["lo"], row["hi"]) == tuple(pytest.approx(v) for v in np.percentile(values, [2.5, 97.5]))
    p = spark.createDataFrame([(v,) for v in values], "v double").agg(T.two_sided_p("v")).first()[0]
    assert p == pytest.approx(B.Spread.of(np.array(values)).p) and B.Spread.of(np.ones(9)).p == pytest.approx(2 / 10)
    assert B.Spread.of(np.array([np.nan])) == B.Spread(None, None, None)


def test_bootstraps():
    rng = np.random.default_rng(3)
    gold = rng.integers(1, 4, (2, 40))
    a = np.stack([gold // 2, gold, gold], axis=2).astype(float)
    b = np.stack([gold, gold, gold], axis=2).astype(float)
    out = B.paired_f1(a, b, 600, 1)
    assert out["delta"] > 0 and out["low"] > 0 and out["p"] == pytest.approx(2 / 601)
    same = B.paired_f1(a, a, 50, 1)
    assert same["delta"] == 0 and same["p"] == 1.0
    low, high = B.mean_f1(a, 700, 5)
    assert low < B.f1(a.sum(axis=1)).mean() < high and B.mean_f1(a, 700, 5) == (low, high) != B.mean_f1(a, 700, 6)
    with pytest.raises(ValueError, match="same"):
        B.paired_f1(a, b[:1], 10, 1)


#: The ten-row table of FIXTURES F5 (fixed values), hits of a1, a2, b1 last.
HITS = [(0, False, 4.0, False, (1, 0, 1)), (0, False, 3.5, False, (1, 0, 0)), (1, False, 5.0, False, (1, 1, 1)), (1, False, 4.0, False, (0, 1, 0)), (2, False, 1.0, False, (1, 1, 1)),
        (2, False, 2.0, False, (1, 0, 1)), (3, True, 1.0, False, (1, 1, 1)), (3, True, 4.0, False, (1, 1, 0)), (4, False, 4.0, True, (0, 1, 1)), (4, False, 2.5, False, (1, 1, 1))]


def test_compare_points(spark):
    from spanframe.functions import tags

    rows = [(s, run, seen, m, unk, bool(h[i])) for s, seen, m, unk, h in HITS for i, run in enumerate(("a1", "a2", "b1"))]
    df = spark.createDataFrame(rows, "sentence_id long, run_id string, seen boolean, m double, unk boolean, hit boolean")
    df = df.withColumn("subsets", tags.subset_names(F.col("seen"), F.col("m"), F.col("unk")))
    names = ["primary", "specificity", "negative_control", "unseen_with_unk"]
    out = B.compare(df, [B.Pair("p", ("a1", "a2"), ("b1",))], names, 200, 1)
    assert out["sizes"] == dict(zip(names, (4, 2, 2, 1), strict=True)) and out["sentences"] == 5
    want = {}
    for n, keep in {"primary": lambda s, m, u: not s and m > 3 and not u, "specificity": lambda s, m, u: not s and m <= 2 and not u, "negative_control": lambda s, m, u: s and not u, "unseen_with_unk": lambda s, m, u: not s and u}.items():
        own = np.array([h for _, s, m, u, h in HITS if keep(s, m, u)], float)
        want[n] = own[:, 2].mean() - own[:, :2].mean()
    got = out["pairs"]["p"]
    assert {n: got["subsets"][n]["delta"] for n in names} == {n: pytest.approx(v) for n, v in want.items()}
    assert got["did"]["delta"] == pytest.approx(want["primary"] - want["specificity"])
    # the distributed form: the same points, and flags by the same rules
    arms = spark.createDataFrame([("p", "a1", "a"), ("p", "a2", "a"), ("p", "b1", "b")], "pair string, run_id string, arm string")
    spreads = {r["subset"]: r for r in Rs.paired_recall(df, arms, 200, 1).collect()}
    assert {n: spreads[n]["delta"] for n in names} == {n: pytest.approx(v) for n, v in want.items()} and spreads["did"]["delta"] == pytest.approx(got["did"]["delta"])
    assert all(r["low"] <= r["high"] and r["p_holm"] == spreads["primary"]["p"] and r["h1"] == (r["p_holm"] < 0.05) and r["h2"] is False for r in spreads.values())
    with pytest.raises(ValueError, match="share"):
        B.Pair("x", ("a1",), ("a1",))
    with pytest.raises(ValueError, match="distinct"):
        B.compare(df, [], names, 10, 1)
    with pytest.raises(ValueError, match="no entity is in gone"):
        B.compare(df, [B.Pair("p", ("a1",), ("b1",))], names, 10, 1, primary="gone")


def test_draws_are_bounded_and_stay_the_same(monkeypatch):
    import tracemalloc

    cube = np.random.default_rng(4).integers(0, 5, (2, 20_000, 3)).astype(float)
    tracemalloc.start()
    found = B.paired_f1(cube[:1], cube[1:], 600, 1), B.mean_f1(cube, 600, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6  # a whole block of 500 replicates is 160 MB
    monkeypatch.setattr(B, "DRAWN", 10**9)
    assert (B.paired_f1(cube[:1], cube[1:], 600, 1), B.mean_f1(cube, 600, 1)) == found


def test_compared_sums_do_not_grow_with_runs(spark, monkeypatch):
    runs = ("a1", "a2", "b1", "b2", "b3", "b4", "other")
    rows = [(s, r, ["primary"] if s % 2 else ["specificity"], (s + i) % 3 == 0) for s in range(6) for i, r in enumerate(runs)]
    df = spark.createDataFrame([*rows, (6, "other", ["primary"], True)], "sentence_id long, run_id string, subsets array<string>, hit boolean")
    names, pairs = ["primary", "specificity"], [B.Pair("p", runs[:2], runs[2:6])]
    monkeypatch.setattr(B, "MOST_CELLS", 7 * 2 * 3)
    out = B.compare(df, pairs, names, 700, 3)
    assert out["sentences"] == 7 and out["sizes"] == {"primary": 3, "specificity": 3}
    # arms that hit alike: their differences are exactly 0, and count on both sides
    even = df.withColumn("hit", F.col("sentence_id") < 3)
    none = B.compare(even, pairs, names, 700, 3)["pairs"]["p"]
    assert all((x["delta"], x["low"], x["high"], x["p"]) == (0, 0, 0, 1) for x in [*none["subsets"].values(), none["did"]])
    monkeypatch.setattr(B, "DRAWN", 1)
    assert B.compare(df.repartition(3), pairs, names, 700, 3) == out
    monkeypatch.setattr(B, "MOST_CELLS", 7 * 2 * 3 - 1)
    with pytest.raises(ValueError, match="too many"):
        B.compare(df, pairs, names, 10, 3)


def test_bootstrap_of_the_odds_ratio(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(r, s, int(p), 3, 4 + int(p), True, "X", bool(rng.random() < 0.15 * p)) for r in ("r1", "r2") for s in range(80) for p in rng.integers(1, 5, 4)]
    df = spark.createDataFrame(rows, "run_id string, sentence_id long, pieces int, freq int, chars int, is_begin boolean, etype string, error boolean")
    low, high = L.bootstrap_odds_ratio(df, 30, 3)
    assert 0 < low < high and L.bootstrap_odds_ratio(df.repartition(5), 30, 3) == (low, high)
    # a run without any error stays in the mean: its fit is finite
    none = df.withColumn("error", F.col("error") & (F.col("run_id") == "r1"))
    assert all(np.isfinite(L.bootstrap_odds_ratio(none, 5, 3)))
    assert L.bootstrap_odds_ratio(df.limit(0), 5, 3) == (None, None)
    with pytest.raises(ValueError, match="too many"):
        L.bootstrap_odds_ratio(df, 5, 3, most=10)


def test_weights_are_poisson_and_reproducible(spark):
    df = spark.range(200).withColumnRenamed("id", "sentence_id")
    one, two = (sorted(tuple(r) for r in Rs.replicated(d, "sentence_id", 300, 3).select("sentence_id", "rep", "w").collect()) for d in (df, df.repartition(9)))
    assert one == two and [w for s, rep, w in one if rep == 0] == [1] * 200
    drawn = np.array([w for _, rep, w in one if rep])
    n = 200 * 300
    assert len(drawn) == n and drawn.sum() / n == pytest.approx(1, abs=0.02) and (drawn == 0).sum() / n == pytest.approx(np.exp(-1), abs=0.01)
    assert (drawn.astype(float) ** 2).sum() / n == pytest.approx(2, abs=0.05)


def test_resampled_means_agree_with_the_seeded_form(spark):
    rng = np.random.default_rng(3)
    gold = rng.integers(1, 4, (3, 150))
    found = np.minimum(gold, rng.integers(0, 4, (3, 150)))
    rows = [("m", f"r{r}", s, int(found[r, s]), int(gold[r, s]), int(gold[r, s])) for r in range(3) for s in range(150)]
    df = spark.createDataFrame(rows, "method string, run_id string, sentence_id long, n_correct long, n_pred long, n_gold long")
    counts = np.stack([found, gold, gold], axis=2).astype(float)
    low, high = B.mean_f1(counts, 2000, 5)
    got = Rs.mean_f1(df, ["method"], 500, 5).first()
    assert got["f1"] == pytest.approx(B.f1(counts.sum(axis=1)).mean()) and got["low"] == pytest.approx(low, abs=0.01) and got["high"] == pytest.approx(high, abs=0.01)
    assert Rs.micro_f1(df, ["method"], 10, 5).first()["f1"] == pytest.approx(B.f1(counts.sum(axis=(0, 1))))


def test_resampled_pairs(spark):
    # arms of three seeds; b is right more often, seed 9 has no partner
    rows = [(arm, seed, s, 2 if arm == "b" or s % 3 else 1, 2, 2) for arm in "ab" for seed in (1, 2, 3) for s in range(60)] + [("a", 9, 1, 2, 2, 2)]
    df = spark.createDataFrame(rows, "arm string, seed long, sentence_id long, n_correct long, n_pred long, n_gold long")
    got = Rs.paired_f1(df, "a", "b", 300, 7).first()
    assert (got["seeds"], got["f1_b"]) == (3, 1.0) and got["delta"] == pytest.approx(1 / 6) and 0 < got["low"] < 1 / 6 < got["high"] and got["p"] == pytest.approx(2 / 301)
    assert Rs.paired_f1(df.filter("seed = 9"), "a", "b", 10, 7).count() == 0


CONFIG = "struct<seed:long,name:string,method:struct<name:string,lora:struct<r:int>>,data:struct<train_fraction:double>,model:struct<name:string>,training:struct<learning_rate:double>>"
METRICS = "struct<test_contract:struct<precision:double,recall:double,f1:double,accuracy:double>>"


def test_registry(spark):
    def run(i, seed, f1, name="x", version="v"):
        return (f"r{i}", (seed, name, ("full", None), (0.1,), ("m",), (1e-5,)), ((f1, f1, f1, f1),) if f1 is not None else None, version, i)

    runs = spark.createDataFrame([run(1, 1, 0.90), run(2, 2, 0.92), run(3, 3, 0.91, version="w"), run(4, 4, None), run(5, 1, 0.5, "y"), run(6, 1, 0.6, "y"), ("r7", None, None, None, 1)], f"run_id string, config {CONFIG}, metrics {METRICS}, code_ref string, registered_at long")
    out = {r["name"]: r for r in R.aggregate(runs, ["name"]).collect()}
    assert out["x"]["f1_mean"] == pytest.approx(0.91) and out["x"]["f1_sd"] == pytest.approx(0.01) and out["x"]["n"] == 3
    assert out["x"]["seeds"] == "1 2 3" and out["x"]["runs"] == "r1 r2 r3" and out["x"]["code_refs"] == 2
    assert R.aggregate(runs.filter("run_id = 'r5'"), ["fraction"]).first()["f1_sd"] is None
    assert [r[0] for r in R.skipped(runs).collect()] == ["r4"]
    assert R.select_arm(runs, "x").count() == 3
    with pytest.raises(ValueError, match="several runs"):
        R.select_arm(runs, "y")
    with pytest.raises(ValueError, match="no completed"):
        R.select_arm(runs, "z")
    with pytest.raises(KeyError, match="no field"):
        R.config_field(runs, "data.missing")


def test_means_do_not_depend_on_order(spark):
    values = [0.1, 0.2, 0.3, 1e6, 0.7] * 7 + [None]
    one, two = (spark.createDataFrame([(v,) for v in x], "v double").coalesce(1).agg(R.exact_mean("v")).first()[0] for x in (values, values[::-1]))
    assert one == two == pytest.approx(sum(v for v in values if v is not None) / 35)


def test_last_registration_and_load_break_ties(spark):
    from spanframe.operators import contract as C

    rows = [("r", 1, 0, w, "O", "O", False, t) for w, t in (("a", 5), ("b", 5), ("c", None))]
    schema = "run_id string, sentence_id long, word_idx int, word string, gold string, pred string, truncated boolean, loaded_at long"
    assert all(C.latest(spark.createDataFrame(x, schema)).first()["word"] == "b" for x in (rows, rows[::-1]))
    assert C.latest(spark.createDataFrame(rows[2:], schema)).first()["word"] == "c"
    runs = spark.createDataFrame([("r", "x", None), ("r", "y", None)], "run_id string, code_ref string, registered_at long")
    assert R.registered(runs).first()["code_ref"] == "y"


def test_transfer_summary_fills_missing_types(spark):
    df = spark.createDataFrame([("a", "r1", "PER", 0.8, 5), ("a", "r1", "LOC", 0.4, 2), ("a", "r2", "PER", 0.6, 6)], "arm string, run_id string, etype string, f1 double, support long")
    out = {r["etype"]: (r["f1_mean"], r["support"], r["runs"]) for r in R.transfer_summary(df, ["arm"]).collect()}
    assert out == {"PER": (pytest.approx(0.7), 6, 2), "LOC": (pytest.approx(0.2), 2, 2)}


def test_head_rows():
    assert R.head_rows({"PER": ["PERSON", "CHILD"]}) == [("O", "O"), ("B-PER", "B-PERSON"), ("I-PER", "I-PERSON"), ("B-PER", "B-CHILD"), ("I-PER", "I-CHILD")]
    with pytest.raises(ValueError, match="taken from"):
        R.head_rows({"A": ["X"], "B": ["X"]})
    source, target = ["O", "B-PER", "I-PER"], ["O", "B-PERSON", "I-PERSON"]
    assert len(R.head_rows({"PER": ["PERSON"]}, True, source, target)) == 3
    for mapping, message in (({"PER": [], "LOC": []}, "LOC differ"), ({}, "PER differ"), ({"PER": ["CHILD"]}, "target side: B-CHILD")):
        with pytest.raises(ValueError, match=message):
            R.head_rows(mapping, True, source, target)


def plain_sign_flip(d):
    from itertools import product

    sums = [abs(sum(x * s for x, s in zip(d, signs, strict=True))) for signs in product((1, -1), repeat=len(d))]
    return sum(x >= abs(sum(d)) - 1e-12 for x in sums) / len(sums)


def test_sign_flip_of_all_differences(spark):
    rng = np.random.default_rng(5)
    cases = {"one": [0.3], "two": [0.1, -0.1], "ten": list(rng.normal(0.1, 0.3, 10)), "ties": [0.1] * 6 + [-0.1] * 5, "most": list(rng.normal(0.1, 0.3, 16))}
    rows = [(k, i, float(d)) for k, v in cases.items() for i, d in enumerate(v)]
    found = {r["k0"]: (r["k"], r["p"]) for r in T.sign_flip_split(spark.createDataFrame(rows, "k0 string, i int, d double"), "d", ["k0"], "i").collect()}
    assert found == {k: (len(v), pytest.approx(plain_sign_flip(v))) for k, v in cases.items()}
    # more than sixteen: of equal differences only the two patterns of one sign are as large; blocks of the second half
    assert T.sign_flip_share(np.ones(30)) == 2 / 2**30
    assert T.sign_flip_share(np.array([1.0] * 41 + [0.0])) == 2 / 2**41


def test_runs_and_replicates_are_whole(spark, monkeypatch):
    from spanframe.plans import runs as R

    micro = spark.createDataFrame([("full", f"r{i:02}", "micro", 0.91) for i in range(24)], "method string, run_id string, etype string, f1 double")
    monkeypatch.setattr(R, "_scored", lambda *_: micro)
    assert [tuple(r) for r in R.sign_flip_all(spark, "").collect()] == [("full", 24, 2 / 2**24)]

    counts = spark.createDataFrame([("r1", 1, "full", 1, 1, 1)], "run_id string, sentence_id long, method string, n_correct long, n_pred long, n_gold long")
    asked = []
    monkeypatch.setattr(R, "_arm_counts", lambda *_: counts)
    monkeypatch.setattr(B, "mean_f1", lambda _, replicates, seed: asked.append(replicates) or (0.0, 1.0))
    R.bootstrap_mean_f1(spark, "")
    assert asked == [1000]


@needs_data
def test_the_compared_subsets_occur(spark):
    from spanframe.plans import wordpiece as W

    rows = {(r["pair"], r["subset"]): r for r in W.compare_bootstrap(spark, SMALL).collect()}
    resampled = {(r["pair"], r["subset"]): r for r in W.paired_recall(spark, SMALL).collect()}
    assert {p for p, _ in rows} == set(W.PAIRS) and all((p, u) in rows for p in W.PAIRS for u in ("primary", "specificity", "did"))
    assert all(r["h1"] == (rows[p, "primary"]["delta"] > 0 and r["p_holm"] < 0.05) for (p, _), r in rows.items())
    assert set(resampled) >= {(p, "primary") for p in W.PAIRS}
