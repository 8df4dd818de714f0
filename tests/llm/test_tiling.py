import random

import numpy as np

from spanframe.llm import tiling
from spanframe.llm.words import match_words


def longest(a, b):
    return max((k for i in range(len(a)) for j in range(len(b)) for k in range(1, min(len(a) - i, len(b) - j) + 1) if a[i : i + k] == b[j : j + k]), default=0)


def test_tiles_against_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        a = np.array([rng.randint(1, 4) for _ in range(rng.randint(1, 14))])
        b = np.array([rng.randint(0, 4) for _ in range(rng.randint(1, 30))])
        tiles = tiling.tile(a, b, 3)
        best = longest(a.tolist(), b.tolist())
        assert (tiles[0][2] if tiles else 0) == (best if best >= 3 else 0)
        used_a, used_b = set(), set()
        for i, j, k in tiles:
            assert a[i : i + k].tolist() == b[j : j + k].tolist() and k >= 3
            assert not used_a & set(range(i, i + k)) and not used_b & set(range(j, j + k))
            used_a |= set(range(i, i + k))
            used_b |= set(range(j, j + k))


def test_reordered_parts_are_covered():
    a = np.arange(1, 13)
    b = np.concatenate([[0], a[6:], [0, 0], a[:6]])
    assert sorted(tiling.tile(a, b, 4)) == [(0, 9, 6), (6, 1, 6)]


def frames(spark):
    item = "один два три четыре пять шесть семь восемь девять"
    docs = [
        (1, f"Начало.\n{item.upper()} конец", "x"),
        (2, "два три четыре пять шесть семь восемь девять", "x"),
        (3, "три четыре пять шесть семь восемь девять", "x"),
        (4, None, "x"),
        (5, "", "x"),
        (6, "a b c d e f", "x"),
        (7, "a-b, c­c d e f g", "x"),
        (8, "слово " * 50_000 + item, "x"),
        (1, f"Начало.\n{item.upper()} конец", "x"),
    ]
    items = [(10, item, "z"), (11, "A B cC d e f g", "z"), (12, "a b c d e f", "z"), (13, "a b c d e", "z"), (14, None, "z"), (15, "", "z"), (10, item, "z")]
    return spark.createDataFrame(docs, "doc_id long, text string, longest string"), spark.createDataFrame(items, "item_id long, text string, tiles string")


def test_found(spark):
    docs, items = frames(spark)
    want = [(1, 10), (2, 10), (6, 12), (7, 11), (8, 10)]
    for seed in (4, 6):
        found = tiling.qualifying(tiling.find_leaks(docs, items, seed=seed)).select("doc_id", "item_id")
        assert sorted(map(tuple, found.collect())) == want
    leaks = {(r["doc_id"], r["item_id"]): (r["n_words"], r["longest"], r["covered"]) for r in tiling.find_leaks(docs, items).collect()}
    assert leaks[3, 10] == (9, 7, 7)
    assert tiling.find_leaks(docs.limit(0), items).count() == 0 and tiling.find_leaks(docs, items.limit(0)).count() == 0


def test_full_bit_table_loses_nothing(spark, monkeypatch):
    docs, items = frames(spark)
    want = sorted(map(tuple, tiling.find_leaks(docs, items).collect()))
    monkeypatch.setattr(tiling, "bit_table", lambda _: np.ones(1 << tiling.TABLE_BITS, np.uint8))
    assert sorted(map(tuple, tiling.find_leaks(docs, items).collect())) == want


def test_two_texts_under_one_id(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "x a b c d e f y"), (5, "z z z a b c d z z")], "item_id long, text string")
    assert [(r["item_id"], r["longest"], r["n_words"]) for r in tiling.find_leaks(docs, items, seed=4).collect()] == [(5, 6, 9)]


def test_reordered_passages_are_found(spark):
    # passages cut into parts of four to nine words, put into documents in another order between other words
    rng = random.Random(9)
    word = lambda: f"w{rng.randint(0, 3000)}"
    items, docs, planted = [], [], set()
    for i in range(120):
        words = [word() for _ in range(rng.randint(8, 40))]
        items.append((i, " ".join(words)))
        parts, at = [], 0
        while len(words) - at >= 4:
            n = min(rng.randint(4, 9), len(words) - at)
            parts.append(words[at : at + n])
            at += n
        rng.shuffle(parts)
        body = [word() for _ in range(30)]
        for p in parts:
            body += p + [word() for _ in range(rng.randint(1, 5))]
        docs.append((i, " ".join(body + [word() for _ in range(200)])))
        planted.add((i, i))
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in tiling.covering(tiling.find_leaks(d, t, seed=4, share=0.5)).collect()}
    assert planted <= found and len(found) < len(planted) + 5
    whole = {(r["doc_id"], r["item_id"]) for r in tiling.covering(tiling.find_leaks(d, t, seed=4)).collect()}
    assert found == whole


def test_match_words_equal_both_ways(spark):
    from pyspark.sql import functions as F

    from spanframe.functions.text import match_words as column

    texts = ["İstanbul ΟΔΟΣ", "é​x", "a_b-c", "қазақ²Ⅷ", "", "שלום 12,5", "ﬁ Ǆ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", column(F.col("t")).alias("w")).collect()
    assert all(list(r["w"]) == match_words(r["t"]) for r in rows)
