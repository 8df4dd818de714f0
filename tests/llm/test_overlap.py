import random

import pytest
from pyspark.sql import functions as F

from spanframe.llm import overlap
from spanframe.operators.splits import sentence_splits


def brute(rows, num=4, den=5, least=6):
    out = set()
    fit = [(i, s, set(w)) for i, s, w in rows if s and w and len(w) >= least and i is not None]
    for a, sa, wa in fit:
        for b, sb, wb in fit:
            if sa == "train" and sb != "train" and den * len(wa & wb) >= num * len(wa | wb):
                out.add((a, b, len(wa & wb), len(wa | wb)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "id long, split string, words array<string>, key int")


def found(df, **kw):
    return sorted((r["train_id"], r["eval_id"], r["shared"], r["united"]) for r in overlap.cross_split_pairs(df, **kw).collect())


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 14))]
        rows.append((3 * i, "train", words))
        near = list(words)
        for _ in range(rng.randint(0, 3)):
            op, at = rng.randint(0, 2), rng.randrange(len(near))
            if op == 0:
                near[at] = rng.choice(vocabulary)
            elif op == 1:
                near.insert(at, rng.choice(vocabulary))
            elif len(near) > 1:
                near.pop(at)
        rng.shuffle(near)
        rows.append((3 * i + 1, rng.choice(["test", "validation", "train"]), near))
    want = sorted(brute(rows))
    assert len(want) > 30 and found(frame(spark, rows)) == want
    assert found(frame(spark, rows + rows[:50])) == want
    assert found(frame(spark, rows), num=3, den=4, min_words=1) == sorted(brute(rows, 3, 4, 1))
    with pytest.raises(ValueError, match="3/4"):
        found(frame(spark, rows), num=2, den=3)


def test_hot_class_and_edges(spark):
    same = [(i, "train" if i % 2 else "test", list("abcdef")) for i in range(40)]
    rows = [*same, (100, "train", None), (101, None, list("abcdef")), (None, "test", list("abcdef")), (102, "test", ["a"] * 6), (103, "train", ["a"] * 7), (104, "test", list("abcde"))]
    assert len(found(frame(spark, rows))) == 400 + 1
    assert found(frame(spark, rows).limit(0)) == []
    long = [(1, "train", [f"x{i}" for i in range(5000)]), (2, "test", [f"x{i}" for i in range(900, 5000)])]
    assert found(frame(spark, long)) == [(1, 2, 4100, 5000)]


def test_hot_head_is_spread(spark):
    # all records share six words, so three heads hold every one of them; two records of each split differ in one word only
    common = F.array(*(F.lit(f"c{i}") for i in range(6)))
    rows = spark.range(100_020).select("id", F.when(F.col("id") < 100_000, "train").otherwise("test").alias("split"), F.concat(common, F.array(F.concat(F.lit("u"), "id"), F.concat(F.lit("v"), F.col("id") % 100_000))).alias("words"))
    want = [(i, 100_000 + i, 7, 9) for i in range(20)]
    assert found(rows) == [] and sorted(found(rows, num=7, den=9)) == want


def test_coverage_counts_members(spark):
    rows = [(1, "train", list("abcdefgh")), (2, "train", list("hgfedcba")), (3, "train", list("abcdefg")), (4, "test", list("abcdefgh")), (4, "test", list("abcdefgh")), (5, "test", list("abcdefgx")), (6, "test", list("uvwxyz"))]
    got = {r["id"]: (r["train_records"], r["coverage"]) for r in overlap.record_coverage(frame(spark, rows)).collect()}
    assert got == {4: (3, 1.0), 5: (1, 7 / 8)}
    pairs, _ = overlap.overlap(frame(spark, rows))
    assert all(r["covered"] <= r["shared"] for r in pairs.collect())


@pytest.mark.parametrize(("num", "den"), [(3, 4), (4, 5), (7, 8)])
def test_every_small_pair_is_found(spark, num, den):
    # all ways to share i of up to 16 words, in a random global order each time
    rng, rows, n = random.Random(num), [], 0
    for shared in range(3, 14):
        for a in range(3):
            for b in range(3):
                for _ in range(6):
                    words = [f"{rng.random():.9f}" for _ in range(shared + a + b)]
                    rows += [(n, "train", words[: shared + a]), (n + 1, "test", words[:shared] + words[shared + a :])]
                    n += 2
    assert found(frame(spark, rows), num=num, den=den, min_words=1) == sorted(brute(rows, num, den, 1))


def test_splits_and_words(spark):
    s = spark.createDataFrame([(1, "valid", None), (1, None, "b"), (2, " DEV", "a"), (3, "other", "a"), (4, "Train\t", "a")], "sentence_id long, split string, source string")
    assert sorted(map(tuple, sentence_splits(s).collect())) == [(1, "validation", "b"), (2, "validation", "a"), (3, None, "a"), (4, "train", "a")]
    p = spark.createDataFrame([(1, 0, "Ә­А-б", "r"), (1, 0, "ӘА-Б", "q"), (1, 1, None, "r"), (2, 0, "!", "r")], "sentence_id long, word_idx int, word string, run_id string")
    assert sorted((r[0], list(r[1])) for r in overlap.sentence_words(p).collect()) == [(1, ["әа", "б"]), (2, [])]
