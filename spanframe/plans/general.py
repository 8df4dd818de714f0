"""Queries: alignment, chunks, masks, streams, and general SQL over the star schema."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanframe.functions import wordpiece as WP
from spanframe.operators import align as A
from spanframe.operators import fertility as Fe
from spanframe.operators import sampling as Sa
from spanframe.plans.registry import CORE
from spanframe.plans.tokens import WORDS, split_words
from spanframe.session import shared_folder, table
from spanframe.streaming import incremental


def _size(word):
    """Pieces of four characters of a word."""
    return F.greatest(F.ceil(F.length(word) / 4), F.lit(1)).cast("int")


def _sentences(spark, sf_dir, only="split = 'test'"):
    """``sentence_id, words, labels, sizes`` of the sentences of ``only``, in word order."""
    w = split_words(spark, sf_dir).filter(only)
    ordered = F.array_sort(F.collect_list(F.struct("word_idx", "word", "gold")))
    rows = w.groupBy("sentence_id").agg(ordered.alias("w"))
    return rows.select("sentence_id", F.transform("w", lambda x: x["word"]).alias("words"), F.transform("w", lambda x: x["gold"]).alias("labels"), F.transform("w", lambda x: _size(x["word"])).alias("sizes"))


@CORE.register(
    "align_first_subword",
    f"""WITH {WORDS}, p AS (SELECT w.sentence_id, w.word_idx, length(w.gold)::INT AS label, unnest(range(n_pieces)) AS k FROM words w JOIN pieces USING (word) WHERE w.split = 'test')
    SELECT sentence_id, list(CASE WHEN k = 0 THEN label ELSE -100 END ORDER BY word_idx, k) AS labels FROM p GROUP BY sentence_id""",
)
def align_first_subword(spark, sf_dir):
    """Labels of subwords, with pieces of four characters and the label's length as its id."""
    s = _sentences(spark, sf_dir)
    numbered = F.flatten(F.transform("sizes", lambda n, i: F.array_repeat(i, n)))
    return s.select("sentence_id", numbered.alias("word_ids"), F.transform("labels", lambda x: F.length(x)).alias("label_ids")).select("sentence_id", A.align_labels("word_ids", "label_ids").alias("labels"))


@CORE.register("truncated_words", f"""WITH {WORDS}, c AS (SELECT w.sentence_id, w.word_idx, sum(n_pieces) OVER (PARTITION BY w.sentence_id ORDER BY w.word_idx) - n_pieces AS before FROM words w JOIN pieces USING (word) WHERE w.split = 'test')
    SELECT sentence_id, coalesce(list(word_idx ORDER BY word_idx) FILTER (WHERE before >= 20), []) AS cut FROM c GROUP BY sentence_id""")
def truncated_words(spark, sf_dir):
    """Words without any of the first twenty pieces."""
    s = _sentences(spark, sf_dir)
    numbered = F.slice(F.flatten(F.transform("sizes", lambda n, i: F.array_repeat(i, n))), 1, 20)
    return s.select("sentence_id", F.array_sort(A.truncated_words(numbered, F.size("words"))).alias("cut"))


def chunk_pack(spark, sf_dir):
    """Chunks of at most sixteen pieces of all sentences of every split; packing restarts with each sentence."""
    return A.packed_chunks(_sentences(spark, sf_dir, "true"), "sentence_id", "words", "sizes", 16)


@CORE.register("mask_plan")
def mask_plan(spark, sf_dir):
    """Masked examples of the chunks of all sentences, with numbered stand-ins for pieces. ``chunk_id``: the sentence times 2^20, and the chunk's number in it."""
    ids = F.flatten(F.transform("words", lambda x, i: F.array_repeat(i, _size(x))))
    rows = chunk_pack(spark, sf_dir).select((F.col("sentence_id").cast("long") * (1 << 20) + F.col("chunk")).alias("chunk_id"), ids.alias("word_ids"))
    return A.masked_examples(rows.withColumn("input_ids", F.transform("word_ids", lambda x: x + 1000)), "chunk_id", 103, 5000, 42)


@CORE.register("learned_wordpiece_fertility")
def learned_wordpiece_fertility(spark, sf_dir):
    """Fertility under a WordPiece vocabulary of the training words' most used pieces, by greedy matching in Arrow batches over distinct words."""
    w = split_words(spark, sf_dir)
    counted = Fe.word_counts(w.filter("split = 'train'"), [])
    usage = Fe.usage_counts(counted, WP.piece_table(counted, WP.fixed_width_pieces))
    letters = counted.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct()
    singles = letters.select(F.explode(F.array("c", F.concat(F.lit("##"), "c"))).alias("piece"))
    frequent = Fe.top_candidates(usage.withColumn("skip", F.lit(None).cast("string")), 2000).select("piece")
    vocabulary = sorted(r[0] for r in singles.union(frequent).distinct().collect())
    by_split = Fe.word_counts(w, ["split"])
    return Fe.fertility(by_split, WP.piece_table(by_split, WP.wordpiece(by_split, vocabulary)), "split")


@CORE.register("fvt_sources", f"""WITH {WORDS}, n AS (SELECT DISTINCT word AS piece FROM words WHERE split = 'test' AND length(word) > 4), e AS (SELECT piece, unnest(range(ceil(length(piece) / 4.0)::INT)) AS pos FROM n),
    b AS (SELECT piece, (row_number() OVER (ORDER BY piece) - 1)::INT AS id FROM (SELECT DISTINCT CASE WHEN pos > 0 THEN '##' ELSE '' END || substr(piece, pos * 4 + 1, 4) AS piece FROM e))
    SELECT e.piece, e.pos::INT AS pos, b.id AS source_id FROM e JOIN b ON b.piece = CASE WHEN e.pos > 0 THEN '##' ELSE '' END || substr(e.piece, e.pos * 4 + 1, 4)""")
def fvt_sources(spark, sf_dir):
    """Base ids of the parts of new pieces (test words of more than four characters)."""
    new = split_words(spark, sf_dir).filter("split = 'test' and length(word) > 4").select(F.col("word").alias("piece")).distinct()
    base = Sa.numbered(new.select(F.explode(WP.fixed_width_pieces("piece")).alias("piece")).distinct(), ["piece"], "id").select("piece", F.col("id").cast("int").alias("id"))
    return Fe.fvt_sources(new, base, WP.fixed_width_pieces)


@CORE.register(
    "event_windows",
    """SELECT time_bucket(INTERVAL '1 hour', ts) AS "start", time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
)
def event_windows(spark, sf_dir):
    out = incremental.windowed_counts(table(spark, sf_dir, "events"), "ts", "1 hour", "1 day", ["event_type"])
    return out.withColumn("total", F.round("total", 4))


@CORE.register(
    "event_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""",
)
def event_sessions(spark, sf_dir):
    return incremental.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", "user_id").withColumn("total", F.round("total", 4))


def _stream(spark, sf_dir, name):
    import glob
    import os

    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    return reader.parquet(path) if os.path.isdir(path) or not glob.glob(path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@CORE.register(
    "stream_type_errors",
    """SELECT run_id, CASE WHEN coalesce(gold, 'O') = 'O' THEN '' ELSE substr(gold, 3) END AS etype, count(*) AS words, count(*) FILTER (WHERE coalesce(gold, 'O') <> coalesce(pred, 'O')) AS errors FROM predictions GROUP BY ALL""",
)
def stream_type_errors(spark, sf_dir):
    """Word errors by run and type, kept up by a stream over the table's files until all that is there is read; each batch writes the table anew."""
    place = f"{shared_folder(spark)}/type-errors-{uuid.uuid4().hex}"
    out = incremental.type_errors(_stream(spark, sf_dir, "predictions"), ["run_id"])
    written: list[str] = []

    def keep(batch, number):
        path = f"{place}/table-{number}"
        batch.write.mode("overwrite").parquet(path)
        written.append(path)

    query = out.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(written[-1]) if written else spark.createDataFrame([], out.schema)


@CORE.register("events_json", """SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY event_type""")
def events_json(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


@CORE.register(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
)
def pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")
    )


@CORE.register(
    "revenue_by_nation",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT min(r_name) FROM region) GROUP BY n_name""",
)
def revenue_by_nation(spark, sf_dir):
    li, o, c, n, r = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    first = r.orderBy("r_name").limit(1)
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(first, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@CORE.register("top_orders_per_customer", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3""")
def top_orders_per_customer(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@CORE.register("order_cube", """SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def order_cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@CORE.register("customers_without_orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def customers_without_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@CORE.register("shared_nations", "SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def shared_nations(spark, sf_dir):
    c, s = (table(spark, sf_dir, t).select(F.col(k).alias("nationkey")) for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey")))
    return c.intersect(s)


@CORE.register("parts_never_returned", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def parts_never_returned(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").subtract(returned)


@CORE.register("status_pivot", """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def status_pivot(spark, sf_dir):
    pivoted = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return pivoted.select("o_orderpriority", *(F.coalesce(c, F.lit(0)).alias(c) for c in "FOP"))
