import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from spanframe.llm import ngrams


def brute(records, max_n):
    occ, held = Counter(), defaultdict(set)
    for r, terms in records.items():
        for i in range(len(terms)):
            for n in range(1, max_n + 1):
                g = terms[i : i + n]
                if len(g) == n and all(g):
                    occ[tuple(g)] += 1
                    held[tuple(g)].add(r)
    return {g: (n, len(held[g])) for g, n in occ.items()}


def counted(df, **kw):
    return {tuple(r["ngram"]): (r["occurrences"], r["records"]) for r in ngrams.ngram_counts(df, **kw).collect()}


def test_against_brute_force(spark):
    rng = random.Random(1)
    records = {r: [rng.choice(["a", "a", "a", "b", "c", None]) for _ in range(rng.randint(1, 30))] for r in range(40)}
    rows = [(r, i, t, "x") for r, ts in records.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows + rows[:100], "record long, pos int, term string, suffix string")
    for n in (1, 2, 4):
        assert counted(df, max_n=n) == brute(records, n)


def test_sums_of_partitions_meet_in_the_stack(spark):
    rows = [(r, i, t) for r in range(300) for i, t in enumerate(["hot", "hot", f"t{r % 7}"])]
    df = spark.createDataFrame(rows, "record long, pos int, term string")
    parts = ngrams.term_sums(df).collect()
    assert len(parts) > 8 and counted(df, max_n=1) == brute({r: ["hot", "hot", f"t{r % 7}"] for r in range(300)}, 1)


def test_blocks_of_long_records(spark, monkeypatch):
    records = {1: ["a", "b"] * 50 + ["c"], 2: ["b", "a", "c"]}
    df = spark.createDataFrame([(r, i, t) for r, ts in records.items() for i, t in enumerate(ts)], "record long, pos int, term string")
    found = ngrams.suffixes(df, 3, block=7)
    again = ngrams.suffixes(df, 3)
    key = ["record", "suffix", "n"]
    assert sorted(map(tuple, found.select(*key).collect())) == sorted(map(tuple, again.select(*key).collect()))


def test_edges(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, ""), (None, 0, "x"), (1, None, "x")], "record long, pos int, term string")
    assert counted(df, max_n=2) == {} and counted(df, max_n=1) == {}
    assert ngrams.ngram_counts(df.limit(0), max_n=3).count() == 0
    one = spark.createDataFrame([(r, 0, "w" * 10_000) for r in range(5)], "record long, pos int, term string")
    assert list(counted(one, max_n=2).values()) == [(5, 5)]
    assert counted(one, max_n=1, min_records=6) == {}


def test_terms_and_marks(spark):
    df = spark.createDataFrame([("\xa0Күн\t",), ("КҮН ",), ("é",), (None,)], "w string")
    assert [r[0] for r in df.select(ngrams.normal_term("w")).collect()] == ["күн", "күн", "é", None]
    marks = spark.createDataFrame([(2,), (3,), (50,), (51,)], "n int").select(ngrams.mark(F.col("n"), 1000)).collect()
    assert [r[0] for r in marks] == ["rare", None, None, "common"]


def test_prediction_tokens_count_once(spark):
    df = spark.createDataFrame([("r1", 1, 0, "A"), ("r2", 1, 0, "a "), ("r1", 1, 1, "b"), ("r1", 2, 0, "a"), ("r1", 3, 0, None)], "run_id string, sentence_id long, word_idx int, word string")
    assert counted(ngrams.prediction_tokens(df), max_n=1) == {("a",): (2, 2), ("b",): (1, 1)}
