import numpy as np
import pytest
from pyspark.sql import functions as F

from spanframe.functions import wordpiece as WP
from spanframe.operators import align as A
from spanframe.operators import fertility as Fe
from spanframe.operators import packing as P
from spanframe.operators import tables as Tb
from spanframe.operators import vocabulary as V

VOCAB = (
    "[PAD] [UNK] [CLS] [SEP] [MASK] . - Асан Бек ##ұлы Алма ##ты ##ға барды Кеше университет кеңесі жиналды Мен кітап оқыдым Қарағанды облыс ##ында жаңа мектеп ашылды Айгүл Астана ##да тұрады Бүгін жаңбыр жауды "
    "Марат Сейітов зауыт ##та жұмыс істейді Ертең Шымкент ##те концерт болады"
).split()
TRAIN = ["Асан/B-PERSON Бекұлы/I-PERSON Алматыға/B-LOCATION барды/O ./O", "Кеше/B-DATE университет/B-ORGANISATION кеңесі/I-ORGANISATION жиналды/O ./O", "Мен/O кітап/O оқыдым/O ./O", "Қарағанды/B-LOCATION облысында/I-LOCATION жаңа/O мектеп/O ашылды/O ./O"]
TEST = ["Марат/B-PERSON Сейітов/I-PERSON зауытта/O жұмыс/O істейді/O ./O", "Ертең/B-DATE Шымкентте/B-LOCATION концерт/O болады/O ./O"]


def words(spark, sentences):
    rows = [(s, i, *x.rsplit("/", 1)) for s, text in enumerate(sentences) for i, x in enumerate(text.split())]
    return spark.createDataFrame(rows, "sentence_id long, word_idx int, word string, gold string")


def test_spell():
    assert WP.spell("##тыға", set(VOCAB)) == ["##ты", "##ға"] and WP.spell("Париж", set(VOCAB)) is None and WP.spell("##", set(VOCAB)) is None
    assert WP.spell("a" * 101, {"a", "##a"}) is None and len(WP.spell("a" * 100, {"a", "##a"})) == 100
    assert WP.tokenize_word("", set(VOCAB)) == ["[UNK]"] == WP.tokenize_word(None, set(VOCAB))


def test_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    model = tokenizers.models.WordPiece({p: i for i, p in enumerate(VOCAB)}, unk_token="[UNK]")
    for w in ("Алматыға", "Асан", "Париж", "облысында", "Бекұлыта", "-", "Астанада"):
        assert WP.tokenize_word(w, set(VOCAB)) == [t.value for t in model.tokenize(w)]


def test_fertility_and_tokenizing_each_word_once(spark, tmp_path):
    w = words(spark, TRAIN).withColumn("split", F.lit("train")).unionByName(words(spark, TEST).withColumn("split", F.lit("test")))
    counted = Fe.word_counts(w, ["split"])
    log = tmp_path / "calls"

    def tokenize(word):
        with log.open("a", encoding="utf-8") as f:
            f.write(word + "\n")
        return WP.tokenize_word(word, set(VOCAB))

    out = {r["split"]: r for r in Fe.fertility(counted, WP.piece_table(counted, WP.pieces_udf(tokenize)), "split").collect()}
    pieces = [len(WP.tokenize_word(x.rsplit("/", 1)[0], set(VOCAB))) for t in TRAIN for x in t.split()]
    assert out["train"]["words"] == 19 + 1 == len(pieces) or out["train"]["words"] == len(pieces)
    assert out["train"]["subwords"] == sum(pieces) and out["train"]["median"] == np.median(pieces) and out["train"]["sd"] == pytest.approx(np.std(pieces))
    assert out[None]["words"] == out["train"]["words"] + out["test"]["words"] and out[None]["subwords"] == out["train"]["subwords"] + out["test"]["subwords"]
    calls = log.read_text(encoding="utf-8").split()
    assert len(calls) == len(set(calls))


def test_entity_and_word_tables(spark):
    train, test = words(spark, TRAIN), words(spark, TEST)
    pieces = WP.piece_table(train.unionByName(test), WP.wordpiece(train, VOCAB))
    e = Tb.entity_table(test, pieces, Tb.training_entities(train, ["sentence_id"]))
    assert sorted((r["text"], r["mean_pieces"], r["seen"]) for r in e.collect()) == [("Ертең", 1.0, False), ("Марат Сейітов", 1.0, False), ("Шымкентте", 2.0, False)]
    again = Tb.entity_table(train, pieces, Tb.training_entities(train, ["sentence_id"]))
    assert all(r["seen"] for r in again.collect())
    w = Tb.word_table(test, pieces, train).collect()
    assert len(w) == 11 and sum(r["is_entity"] for r in w) == 4 and next(r["freq"] for r in w if r["word"] == ".") == 4


def test_overlap_of_vocabularies(spark):
    source = spark.createDataFrame([("ab",), ("cd",), ("??",)], "word string")
    target = spark.createDataFrame([("ab",), ("ab",), ("abcd",), ("zz",), ("??",)], "word string")
    vocabulary = ["[UNK]", "ab", "cd", "##cd", "zz"]
    r = Fe.piece_overlap(source, target, WP.wordpiece(source, vocabulary)).first()
    # pieces of the target: ab 3, ##cd 1, zz 1, [UNK] 1; only ab is shared
    assert (r["words"], r["word_types"], r["piece_tokens"], r["piece_types"]) == (5, 4, 6, 4)
    assert (r["shared_piece_types"], r["shared_piece_tokens"], r["covered_words"], r["word_types_in_source"]) == (25.0, 50.0, 40.0, 50.0)
    assert Fe.piece_overlap(source, target.limit(0), WP.wordpiece(source, vocabulary)).first()["covered_words"] is None


def test_candidates_and_extension(spark):
    learned = spark.createDataFrame([("ab",), ("x",), ("ққ",), ("abcd",), ("cdab",)], "piece string")
    base = spark.createDataFrame([("ab", 0), ("cd", 1), ("##ab", 2), ("##cd", 3)], "piece string, id int")
    usage = spark.createDataFrame([("abcd", 7)], "piece string, n long")
    known = {r[0] for r in base.select("piece").collect()}
    spellable = F.udf(lambda p: WP.spell(p, known) is not None, "boolean")
    found = Fe.candidates(learned, base, usage, spellable)
    assert {r["piece"]: r["skip"] for r in found.collect()} == {"ab": "in_base", "x": "single_character", "ққ": "needs_unk", "abcd": None, "cdab": "unused"}
    e = V.extend(base, learned, usage, 5)
    assert {r["piece"]: r["id"] for r in e.vocabulary.collect()} == {"ab": 0, "cd": 1, "##ab": 2, "##cd": 3, "abcd": 4}
    assert {r["skip"]: r["pieces"] for r in e.skipped().collect()} == {"in_base": 1, "single_character": 1, "needs_unk": 1, "unused": 1}
    assert [tuple(r) for r in e.added.collect()] == [("abcd", 7)]
    for wrong in (["ab"], ["x", "x"]):
        with pytest.raises(ValueError, match="new and distinct"):
            V.append(base, wrong)
    for rows in ([("a", 0), ("b", 2)], [("a", 0), ("a", 1)], [("a", 1), ("b", 2)], [("a", 0), ("b", 0)]):
        with pytest.raises(ValueError, match="without gaps"):
            V.require_contiguous(spark.createDataFrame(rows, "piece string, id int"))
    with pytest.raises(ValueError, match="no vocabulary"):
        V.collected(base, most=3)
    u = Fe.piece_usage(learned, usage).first()
    assert (u["pieces"], u["least"], u["unused"], u["below_100"], u["median"]) == (5, 0, 4, 5, 0.0)


def test_strata(spark):
    rows = [(r, b, e) for r, b, e in [("r1", "1", 1), ("r1", "1", 0), ("r2", "1", 0), ("r2", "1", 0), ("r1", "2", 1), ("r2", "2", 1)]]
    df = spark.createDataFrame(rows, "run_id string, bin string, error int")
    out = {r["bin"]: (r["mean"], r["sd"], r["n"]) for r in Tb.run_strata(df, "run_id", ["bin"], "error").collect()}
    assert out["1"] == (0.25, pytest.approx(np.std([0.5, 0], ddof=1)), 2) and out["2"] == (1.0, 0.0, 1)
    assert [r["bin"] for r in Tb.run_strata(df, "run_id", ["bin"], "error", least=2).collect()] == ["1"]
    bins = {r["bin"]: r["n"] for r in Tb.all_bins(Tb.run_strata(df, "run_id", ["bin"], "error"), "bin", ("1", "2", "3")).collect()}
    assert bins == {"1": 2, "2": 1, "3": 0}
    hits = spark.createDataFrame([(1, "a", True), (1, "b", False)], "e int, run_id string, hit boolean")
    assert Tb.pivot_hits(hits, ["e"], ["a", "b"]).first().asDict() == {"e": 1, "hit_a": True, "hit_b": False}


def test_alignment(spark):
    df = spark.createDataFrame([([None, 0, 0, 0, 1, None], [7, 3], 3), ([], [], 0)], "w array<int>, l array<int>, n int")
    rows = df.select(A.align_labels("w", "l").alias("a"), A.truncated_words("w", "n").alias("t")).collect()
    assert [list(r["a"]) for r in rows] == [[-100, 7, -100, -100, 3, -100], []] and [list(r["t"]) for r in rows] == [[2], []]


def test_tokenized_words(spark):
    df = spark.createDataFrame([(1, ["Алматыға", "барды"]), (2, [])], "sid int, tokens array<string>")
    rows = {r["sid"]: (list(r["input_ids"]), list(r["word_ids"])) for r in A.tokenized_words(df, VOCAB).collect()}
    assert rows[1] == ([2, 10, 11, 12, 13, 3], [None, 0, 0, 0, 1, None]) and rows[2] == ([2, 3], [None, None])
    assert list(A.tokenized_words(df, VOCAB, max_len=4).filter("sid = 1").first()["word_ids"]) == [None, 0, 0, None]


def test_pieces_in_context(spark):
    df = spark.createDataFrame([(1, ["Алматыға", "Париж", "барды"]), (2, []), (3, None)], "sid int, tokens array<string>")
    rows = sorted(tuple(r) for r in V.pieces_in_context(df, VOCAB, "sid", "tokens").collect())
    assert rows == [(1, 0, "Алматыға", 3, False), (1, 1, "Париж", 1, True), (1, 2, "барды", 1, False)]
    assert V.with_marks(["a"]) == ["a", "[CLS]", "[SEP]", "[UNK]"] and V.with_marks(VOCAB) == VOCAB


def test_split_and_running_text(spark):
    tokenizers = pytest.importorskip("tokenizers")
    df = spark.createDataFrame([(1, ["don", "t", "go"]), (2, []), (3, None)], "sid int, tokens array<string>")

    def word_pieces(text):
        model = tokenizers.Tokenizer(tokenizers.models.WordPiece({p: i for i, p in enumerate(["[UNK]", "don", "t", "go"])}, unk_token="[UNK]"))
        model.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
        return model.encode(text)

    def by_byte(text):
        model = tokenizers.Tokenizer(tokenizers.models.BPE({c: i for i, c in enumerate("dontgĠ")}, []))
        model.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False)
        return model.encode(text)

    for encode, want in ((word_pieces, []), (by_byte, [(1, 1, "t"), (1, 2, "go")])):
        found = V.split_mismatches(df, "sid", "tokens", lambda w, e=encode: e(w).ids, lambda t, e=encode: (e(t).ids, e(t).offsets))
        assert sorted(tuple(r) for r in found.collect()) == want
    # a piece that ends in the space goes to the next word, one behind the end to the last
    assert V.pieces_by_word(["ab", "c"], [1, 2, 3, 4], [(0, 2), (2, 3), (3, 4), (4, 4)]) == [[1], [2, 3, 4]]


def test_packing(spark):
    sizes = [1, 2, 3, 1, 1, 1, 1, 1]
    assert A.pack(sizes, 4) == ([(0, 2), (2, 4), (4, 8)], 0)
    assert A.pack([3, 1, 1], 2) == ([(0, 1), (1, 3)], 1) and A.pack([], 2) == ([], 0)
    df = spark.createDataFrame([(1, list("abcdefgh"), sizes), (2, [], []), (3, None, None)], "k long, w array<string>, s array<long>")
    assert [(r["k"], r["chunk"], r["pieces"]) for r in A.packed_chunks(df, "k", "w", "s", 4).orderBy("chunk").collect()] == [(1, 0, 3), (1, 1, 4), (1, 2, 4)]


def chunked(spark, lines, budget, partitions=4, **kw):
    rows = [(i, t, [len(WP.tokenize_word(w, set(VOCAB))) for w in t] if t is not None else None) for i, t in enumerate(lines)]
    df = spark.createDataFrame(rows, "line int, w array<string>, s array<int>").repartition(partitions)
    found = P.packed_text(df, ["line"], "w", "s", budget, **kw)
    return [list(r["words"]) for r in found.orderBy("chunk").collect()], P.packing_report(found, kw.get("max_chunks")).first()


def test_chunks_run_on_from_line_to_line(spark):
    lines = ["Асан Бекұлы Алматыға барды .".split(), None, [], "Кеше барды .".split()]
    chunks, report = chunked(spark, lines, 4)
    assert chunks == [["Асан", "Бекұлы"], ["Алматыға", "барды"], [".", "Кеше", "барды", "."]] and report["oversized"] == 0
    chunks, report = chunked(spark, lines, 2)
    assert ["Алматыға"] in chunks and report["oversized"] == 1 and report["words"] == 8
    # the word that closes the last chunk has been read
    chunks, report = chunked(spark, lines, 2, max_chunks=2)
    assert chunks == [["Асан"], ["Бекұлы"]] and tuple(report) == (2, 2, 3, 1)
    assert chunked(spark, [None], 4)[0] == []


def plain_packing(sizes, budget):
    out, used = [], 0
    for i, n in enumerate(sizes):
        if not out or used + n > budget:
            out.append([])
            used = 0
        out[-1].append(i)
        used += n
    return out


def test_parallel_packing_equals_the_plain_loop(spark):
    rng = np.random.default_rng(4)
    for budget in (1, 7, 30, 500):
        sizes = [rng.integers(0, 9, rng.integers(0, 12)).tolist() for _ in range(150)]
        flat = [max(n, 1) for s in sizes for n in s]
        ids = iter(range(10**6))
        df = spark.createDataFrame([(i, [str(next(ids)) for _ in s], s) for i, s in enumerate(sizes)], "line int, w array<string>, s array<int>")
        want = plain_packing(flat, budget)
        for most in (None, 3):
            found = P.packed_text(df.repartition(5), ["line"], "w", "s", budget, max_chunks=most).orderBy("chunk").collect()
            assert [[int(w) for w in r["words"]] for r in found] == want[:most]
            assert all(r["pieces"] == sum(flat[i] for i in c) for r, c in zip(found, want))


def test_masks(spark):
    plan = A.mask_plan(200, 3, 42)
    assert (plan == A.mask_plan(200, 3, 42)).all() and (plan != A.mask_plan(200, 4, 42)).any() and (plan != A.NOTHING).sum() == 30
    assert (A.mask_plan(1, 0, 1) != 0).sum() == 1 and len(A.mask_plan(0, 0, 1)) == 0
    inputs, labels = A.masked([101, 5, 6, 7, 8, 102], [None, 0, 0, 1, 2, None], np.array([A.MASK, A.NOTHING, A.KEEP]), np.random.default_rng(0), 103, 500)
    assert (inputs, labels) == ([101, 103, 103, 7, 8, 102], [-100, 5, 6, -100, 8, -100])
    df = spark.createDataFrame([(i, [101, *range(5, 25), 102], [None, *range(20), None]) for i in range(6)], "chunk long, input_ids array<int>, word_ids array<int>")
    one, two = (sorted(map(repr, A.masked_examples(d, "chunk", 103, 500, 7).collect())) for d in (df, df.repartition(5)))
    assert one == two


def test_chunks_and_masks_cover_all_splits(spark, monkeypatch):
    from spanframe.plans import general as G

    rows = [(sid, split, i, "abcdefgh", "O") for sid, split in ((1, "train"), (2, "validation"), (3, "test")) for i in range(10)]
    words = spark.createDataFrame(rows, "sentence_id long, split string, word_idx int, word string, gold string")
    monkeypatch.setattr(G, "split_words", lambda *_: words)
    chunks = G.chunk_pack(spark, "").collect()
    assert sorted((r["sentence_id"], r["chunk"], r["pieces"]) for r in chunks) == [(s, c, n) for s in (1, 2, 3) for c, n in ((0, 16), (1, 4))]
    masks = {r["chunk_id"]: len(r["input_ids"]) for r in G.mask_plan(spark, "").collect()}
    assert masks == {(r["sentence_id"] << 20) + r["chunk"]: r["pieces"] for r in chunks}
