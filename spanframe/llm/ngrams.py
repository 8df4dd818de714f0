"""Counts of every term and n-gram, and of the records that hold it, by sorted truncated suffixes.

Only suffixes cut at ``max_n`` terms are moved, not all n-grams: each n-gram is the prefix of the suffixes that begin with
it. Equal suffixes are added up before they move. They are routed by their first term (and a hash bucket of the second, as many as
the session has shuffle partitions, so that a frequent first term doesn't end in one task), sorted in reverse lexicographic order, and read once
with a stack: equal suffixes from different places add up there, and what leaves the stack has its final count and hands it to its prefix.

Sets of records per n-gram would not stay bounded. They are replaced by sums: within a record the sorted suffixes tell, by the common
prefix with their predecessor, from which length on a prefix is new to the record. Counting the suffixes by that length
makes record counts additive, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions.text import nfc

#: Terms of a record that are handled together; longer records are cut, with the following ``max_n - 1`` terms added.
RECORD_BLOCK = 65_536
#: Least number of buckets of the second term.
SECOND_TERM_BUCKETS = 16
_CHUNK = 20_000


def normal_term(word: Column | str) -> Column:
    """NFC, no spaces, tabs or no-break spaces at the ends, lower case."""
    return F.lower(F.trim(nfc(word), F.lit(" \t\xa0")))


def _partitions(df: DataFrame) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def term_sums(tokens: DataFrame) -> DataFrame:
    """``suffix, occ, new1``: suffixes of one term, added up within each partition only: a term has a row per partition that holds it.

    Rows are placed once, by record and term, so that a record of many terms and a term of many records are both spread; repeats, the terms of
    each record and the sums of each term are then found without moving anything again. The stack adds up the partitions' sums.
    """
    n = _partitions(tokens)
    known = tokens.filter("record is not null and pos is not null and term is not null and term <> ''").select("record", "pos", "term")
    placed = known.withColumn("part", F.pmod(F.xxhash64("record", "term"), F.lit(n)).cast("int")).repartitionById(n, "part")
    per_record = placed.groupBy("part", "record", "pos", "term").agg(F.lit(1).alias("one")).groupBy("part", "record", "term").agg(F.count("*").alias("n"))
    return per_record.groupBy("part", "term").agg(F.sum("n").alias("occ"), F.count("*").alias("new1")).select(F.array("term").alias("suffix"), "occ", "new1")


def suffixes(tokens: DataFrame, max_n: int, block: int = RECORD_BLOCK) -> DataFrame:
    """``record, suffix, n``: the truncated suffixes of each record with their number in it.

    ``tokens`` has ``record, pos, term``. A position counts once, with its least term; a missing position ends the n-grams before it.
    """
    known = tokens.filter("record is not null and pos is not null and term is not null and term <> ''").select("record", "pos", "term")
    one = known.groupBy("record", "pos").agg(F.min("term").alias("term"))
    own = F.floor(F.col("pos") / block)
    also_before = (F.col("pos") % block < max_n - 1) & (own > 0)
    spread = one.withColumn("block", F.explode(F.when(also_before, F.array(own, own - 1)).otherwise(F.array(own))))
    w = Window.partitionBy("record", "block").orderBy("pos")
    following = [F.when(F.lead("pos", k).over(w) == F.col("pos") + k, F.lead("term", k).over(w)) for k in range(1, max_n)]
    rows = spread.select("record", "block", "pos", F.array(F.col("term"), *following).alias("s")).filter(F.floor(F.col("pos") / block) == F.col("block"))
    missing = F.array_position(F.transform("s", lambda x: x.isNull()), True)
    cut = F.when(missing > 0, F.slice("s", F.lit(1), missing.cast("int") - 1)).otherwise(F.col("s"))
    return rows.select("record", cut.alias("suffix")).groupBy("record", "suffix").agg(F.count("*").alias("n"))


def _common(a: Column, b: Column, max_n: int) -> Column:
    """Length of the common prefix of two arrays of at most ``max_n`` terms."""
    out = F.lit(0)
    for k in range(max_n, 0, -1):
        same = (F.size(a) >= k) & (F.size(b) >= k) & (F.slice(a, 1, k) == F.slice(b, 1, k))
        out = F.when(F.coalesce(same, F.lit(False)), F.lit(k)) if k == max_n else out.when(F.coalesce(same, F.lit(False)), F.lit(k))
    return out.otherwise(F.lit(0))


def ngram_counts(tokens: DataFrame, max_n: int = 1, min_records: int = 1) -> DataFrame:
    """``ngram array<string>, n int, occurrences long, records long`` of all n-grams of 1 to ``max_n`` terms.

    ``tokens`` has ``record, pos, term``; repeated rows count once; null or empty terms are no terms and end the
    n-grams before them; extra columns are ignored; an empty table gives no rows. With ``max_n`` 1 a position counts once for each of its
    terms, else with its least one. Only n-grams of at least
    ``min_records`` records come out.
    """
    if max_n == 1:
        routed = term_sums(tokens).repartition(F.col("suffix")[0])
    else:
        w = Window.partitionBy("record", F.col("suffix")[0]).orderBy("suffix")
        news = suffixes(tokens, max_n).withColumn("before", F.lag("suffix").over(w)).withColumn("new", _common(F.col("before"), F.col("suffix"), max_n) + 1)
        summed = news.groupBy("suffix").agg(F.sum("n").alias("occ"), *(F.sum((F.col("new") == k).cast("long")).alias(f"new{k}") for k in range(1, max_n + 1)))
        buckets = max(SECOND_TERM_BUCKETS, _partitions(tokens))
        routed = summed.repartition(F.col("suffix")[0], F.pmod(F.xxhash64(F.get("suffix", F.lit(1))), F.lit(buckets)))
    counted = routed.sortWithinPartitions(F.col("suffix").desc()).mapInArrow(_stack_reader(max_n), "ngram array<string>, n int, occurrences long, records long")
    if max_n > 1:
        # a first term's suffixes lie in several buckets: only its own count is still in parts
        single = counted.filter("n = 1").groupBy("ngram", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        counted = counted.filter("n > 1").unionByName(single)
    return counted.filter(F.col("records") >= min_records) if min_records > 1 else counted


def _stack_reader(max_n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: list[str] = []
        counts: list[list[int]] = []  # of each prefix on the stack: occurrences, then suffixes new from length 1, 2, ...
        out: list[tuple[list[str], int, int, int]] = []

        def leave(depth: int) -> None:
            while len(terms) > depth:
                done = counts.pop()
                length = len(terms)
                out.append((terms[:], length, done[0], sum(done[1 : length + 1])))
                terms.pop()
                if counts:
                    parent = counts[-1]
                    for i, v in enumerate(done):
                        parent[i] += v

        def flush() -> pa.RecordBatch:
            grams, ns, occ, records = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(grams, pa.list_(pa.string())), pa.array(ns, pa.int32()), pa.array(occ, pa.int64()), pa.array(records, pa.int64())], ["ngram", "n", "occurrences", "records"])

        for batch in batches:
            numbers = np.stack([np.asarray(batch.column(i)) for i in range(1, max_n + 2)], axis=1).tolist() if batch.num_rows else []
            for suffix, row in zip(batch.column(0).to_pylist(), numbers, strict=True):
                depth = 0
                while depth < len(terms) and depth < len(suffix) and terms[depth] == suffix[depth]:
                    depth += 1
                leave(depth)
                for term in suffix[depth:]:
                    terms.append(term)
                    counts.append([0] * (max_n + 1))
                top = counts[-1]
                for i, v in enumerate(row):
                    top[i] += v
                if len(out) >= _CHUNK:
                    yield flush()
        leave(0)
        if out:
            yield flush()

    return run


def mark(records: Column, total: int, rare_below: int = 3, common_share: int = 20) -> Column:
    """``rare`` if fewer than ``rare_below`` records hold the term, ``common`` if more than one in ``common_share`` does, else null.

    In collections so small that both hold, ``rare`` is given.
    """
    return F.when(records < rare_below, F.lit("rare")).when(records * common_share > total, F.lit("common"))


def prediction_tokens(predictions: DataFrame) -> DataFrame:
    """``record, pos, term`` of a prediction table: the words of all runs in their normal form."""
    words = predictions.filter("sentence_id is not null and word_idx is not null and word is not null")
    return words.select(F.col("sentence_id").alias("record"), F.col("word_idx").alias("pos"), normal_term("word").alias("term"))
