from pyspark.sql import functions as F

from spanframe.streaming import incremental as I

WORDS = "run_id string, sentence_id long, word_idx int, word string, gold string, pred string"


def batches(df, tmp_path, n=3):
    for i in range(n):
        df.filter(F.col("sentence_id") % n == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_sums_over_batches(spark, tmp_path):
    rows = [("r", s, i, "w", "B-X" if i == 0 else "O", "B-X" if (s + i) % 2 else "O") for s in range(12) for i in range(3)]
    df = spark.createDataFrame(rows, WORDS)
    batches(df, tmp_path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = I.type_errors(stream, ["run_id"]).writeStream.outputMode("complete").format("memory").queryName("errors_of_types").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("errors_of_types").collect())) == sorted(map(tuple, I.type_errors(df, ["run_id"]).collect()))
    parts = {}
    I.span_totals(stream, lambda b, n: parts.update({n: [tuple(r) for r in b.collect()]}), str(tmp_path / "c2")).awaitTermination()
    from spanframe.operators.spans import sentence_counts

    whole = sentence_counts(df).agg(*(F.sum(c) for c in ("n_correct", "n_pred", "n_gold"))).first()
    assert len(parts) == 3 and tuple(whole) == tuple(sum(r[i] for rows in parts.values() for r in rows) for i in (1, 2, 3))


def test_distinct_and_windows(spark, tmp_path):
    rows = [(i % 4, 1.0, i) for i in range(20)]
    df = spark.createDataFrame(rows, "k long, value double, s long").select("k", "value", F.timestamp_seconds(F.col("s") * 60).alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = I.distinct_rows(stream, ["k"], "ts", "1 hour").writeStream.format("memory").queryName("distinct_rows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("distinct_rows").count() == 4
    assert I.windowed_counts(df, "ts", "10 minutes", "1 hour", []).orderBy("start").select("n").collect()[0][0] == 10
    assert I.windowed_counts(df, "ts", "10 minutes", "1 hour", ["k"], slide="5 minutes").agg(F.sum("n")).first()[0] == 40
    assert I.sessions(df, "ts", "5 minutes", "k").count() == 4 and I.sessions(df, "ts", "3 minutes", "k").count() == 20
