import pytest
from pyspark.sql import functions as F

from spanframe.llm import sample


def test_permutation_is_one(spark):
    n = 1 << 12
    df = spark.range(sample.BUCKETS).select(sample.position(F.col("id"), F.lit(-5)).alias("p"))
    row = df.agg(F.count_distinct("p").alias("d"), F.min("p").alias("lo"), F.max("p").alias("hi")).first()
    assert (row["d"], row["lo"], row["hi"]) == (sample.BUCKETS, 0, sample.BUCKETS - 1) and n


def test_share_and_nesting_and_growth(spark):
    df = spark.range(20_000).withColumn("bucket", F.lit("clash"))
    small = {r["id"] for r in sample.nested_sample(df, ["id"], 0.1, 7).collect()}
    large = {r["id"] for r in sample.nested_sample(df.repartition(13), ["id"], 0.3, 7).collect()}
    grown = {r["id"] for r in sample.nested_sample(spark.range(40_000), ["id"], 0.1, 7).collect()}
    other = {r["id"] for r in sample.nested_sample(df, ["id"], 0.1, 8).collect()}
    assert small < large and small == {x for x in grown if x < 20_000}
    assert abs(len(small) - 2000) < 200 and abs(len(large) - 6000) < 300
    assert len(small & other) < 500


def test_null_keys_and_bad_fractions(spark):
    df = spark.createDataFrame([(None,), (None,), (1,)], "k long")
    assert sample.nested_sample(df, ["k"], 1.0).count() == 3
    assert sample.nested_sample(df.limit(0), ["k"], 0.5).count() == 0
    for f in (0.0, -1.0, 1.5, float("nan")):
        with pytest.raises(ValueError, match="fraction"):
            sample.nested_sample(df, ["k"], f)


CONFIG = "struct<data:struct<train_fraction:double,subsample_seed:long,max_train_samples:long>>"


def test_runs(spark, monkeypatch):
    runs = spark.createDataFrame(
        [("a", ((None, None, None),), 1), ("b", None, 1), ("c", ((1.5, 1, None),), 1), ("d", ((0.5, 3, None),), 1), ("d", ((0.25, 3, None),), 2), ("e", ((float("nan"), 3, None),), 1), (None, None, 1)],
        f"run_id string, config {CONFIG}, registered_at long",
    )
    sentences = spark.createDataFrame([(i % 500, s, i) for i, s in enumerate(["train", " Train", "TRAIN "] * 400)] + [(900, "test", 1), (None, "train", 1), (901, None, 1)], "sentence_id long, split string, delivery int")
    settings = {r["run_id"]: (r["fraction"], r["seed"], r["reason"]) for r in sample.run_settings(runs).collect()}
    assert settings["a"] == (1.0, 42, None) and settings["b"] == (1.0, 42, None) and settings["d"] == (0.25, 3, None)
    assert settings["c"][2] and settings["e"][2]
    chosen = {}
    for r in sample.run_samples(sentences, runs).collect():
        chosen.setdefault(r["run_id"], []).append(r["sentence_id"])
    assert sorted(chosen["a"]) == list(range(500)) and set(chosen) == {"a", "b", "d"} and 80 < len(chosen["d"]) < 170
    whole = sorted(map(tuple, sample.run_samples(sentences, runs).collect()))
    monkeypatch.setattr(sample, "RUN_BLOCK", 1)
    assert sorted(map(tuple, sample.run_samples(sentences.repartition(7), runs).collect())) == whole
    assert sample.run_samples(sentences.limit(0), runs).count() == 0
    assert sample.run_samples(sentences, runs.limit(0)).count() == 0
