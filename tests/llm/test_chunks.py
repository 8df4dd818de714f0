import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanframe.llm import chunks


def check(text, setting):
    words = chunks.Words(text)
    assert words.size == chunks.text_size(text)
    pieces = chunks.split(words, setting)
    kept = [text[n:e] for _, n, e in pieces]
    # nothing is lost: what is new in each piece gives the words in order
    assert [c for p in kept for c in p if c not in " \t\r\n"] == [c for c in text if c not in " \t\r\n"]
    for i, (s, n, e) in enumerate(pieces):
        size = chunks.text_size(text[s:e])
        assert s <= n < e and size <= setting.budget
        if i:
            # consecutive pieces share the overlap exactly, or all of a first piece that is smaller
            before = pieces[i - 1]
            assert s >= before[0] and chunks.text_size(text[s : before[2]]) == min(setting.shared, chunks.text_size(text[before[0] : before[2]]))
    return pieces


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet="ab.! \n\tә", max_size=200), budget=st.integers(1, 20), overlap=st.integers(0, 25))
def test_pieces(text, budget, overlap):
    if chunks.text_size(text) > budget:
        assert len(check(text, chunks.Setting("r", budget, overlap))) > 1


@pytest.mark.parametrize(("text", "budget", "overlap"), [("aaaaaaaaaaaaaaaa bbbb " * 200, 126, 8), ("abcdefgh" * 4 + " " + "ijklmnop" * 4 + " " + "x" * 320, 20, 6), ("word " * 300, 20, 15), ("z" * 4001, 30, 7)])
def test_overlap_is_met(text, budget, overlap):
    found = check(text, chunks.Setting("r", budget, overlap))
    assert len(found) > 2 and all(chunks.text_size(text[s:n]) == min(overlap, chunks.text_size(text[:n])) for s, n, _ in found)


def slow(text, core):
    """The plain form: atoms are words, all boundaries in one heap's order by repeated search."""
    words = chunks.Words(text)
    ranges = [[i, i + 1] for i in range(len(words.start))]
    size = lambda r: words.before[r[1]] - words.before[r[0]]
    while True:
        best = min(((words.after[a[1] - 1], size(a) + size(b), k) for k, (a, b) in enumerate(zip(ranges, ranges[1:])) if size(a) + size(b) <= core), default=None)
        if best is None:
            return [(words.start[a], words.end[b - 1]) for a, b in ranges]
        k = best[2]
        ranges[k : k + 2] = [[ranges[k][0], ranges[k + 1][1]]]


def test_collapsed_atoms_change_nothing():
    rng = random.Random(2)
    for _ in range(150):
        text = "".join(rng.choice(["ab", "abcdefgh", "a", ". ", "! ", "\n", " ", " "]) + " " * rng.randint(0, 1) for _ in range(40))
        core = rng.randint(3, 15)
        if all(chunks.word_size(len(w)) <= core for w in text.split()):
            assert [(n, e) for _, n, e in chunks.split(chunks.Words(text), chunks.Setting("r", core))] == slow(text, core)


def test_natural_boundaries():
    text = "one two three.\nfour five six. seven\neight"
    assert [text[s:e] for s, _, e in chunks.split(chunks.Words(text), chunks.Setting("r", 6))] == ["one two three.", "four five six. seven", "eight"]


DOC = "doc_id long, text string, source string, run_id string"
RUN = "run_id string, source string, config struct<corpus:struct<max_chunks:long>,chunker:struct<max_len:int>>, chunk_overlap int, registered_at long"


def test_frames(spark):
    docs = spark.createDataFrame([(1, "ab " * 300, "s", "x"), (2, None, "s", "x"), (3, "", "s", "x"), (4, "ab", "s", "x"), (5, "ab " * 300, None, "x"), (6, "y" * 4000, "s", "x"), (7, "ab " * 130, "s", "x")], DOC)
    runs = spark.createDataFrame([("a", "s", ((None,), (None,)), None, 1), ("a", "s", ((None,), (None,)), 8, 2), ("b", "s", ((3,), (100,)), 10, 1), ("c", "s", ((3,), (2,)), 1, 1), ("d", "t", None, 1, 1), ("e", "s", None, 500, 1), ("f", None, None, 1, 1)], RUN)
    settings_ = chunks.settings_of(runs)
    assert {r["run_id"]: (r["budget"], r["overlap"], r["most"]) for r in settings_.collect()} == {"a": (126, 8, None), "b": (98, 10, 3), "d": (126, 1, None), "e": (126, 500, None)}
    found = {(r["run_id"], r["doc_id"]) for r in chunks.split_oversized(docs, settings_).collect()}
    assert found == {(r, d) for r in "abe" for d in (1, 6, 7)}
    out = chunks.pieces(docs, settings_).collect()
    assert sum(r["run_id"] == "b" for r in out) == 3
    assert all(chunks.text_size(r["text"]) <= {"a": 126, "b": 98, "e": 126}[r["run_id"]] for r in out)
    assert {r["run_id"] for r in settings_.filter("reason is not null").collect()} == {"e"}
    # a limit takes documents in order; copies of one count once
    many = spark.createDataFrame([(i, f"{'ab ' * 150}{i}", "s", "x") for i in (9, 4, 2, 7, 4)], DOC)
    limited = spark.createDataFrame([("l", "s", ((5,), (None,)), 0, 1), ("m", "s", ((0,), (None,)), 0, 1), ("n", "s", ((1000,), (None,)), 0, 1)], RUN)
    got = sorted((r["run_id"], r["doc_id"], r["piece"]) for r in chunks.pieces(many, chunks.settings_of(limited)).collect())
    assert got == [("l", 2, 0), ("l", 2, 1), ("l", 4, 0), ("l", 4, 1), ("l", 7, 0)] + [("n", d, k) for d in (2, 4, 7, 9) for k in (0, 1)]
    assert chunks.pieces(docs.limit(0), settings_).count() == 0 and chunks.split_oversized(docs, settings_.limit(0)).count() == 0


def test_very_long_text():
    text = ("word " * 9 + "end. ") * 20_000
    assert len(check(text, chunks.Setting("r", 126, 16))) > 1000


@pytest.mark.parametrize("budget", [1, 2])
def test_tiny_limits(budget):
    check("abcdefghij kl", chunks.Setting("r", budget, 5))
