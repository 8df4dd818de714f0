import random

import pytest
from pyspark.sql import functions as F

from spanframe.functions import tags
from spanframe.operators import contract as C
from spanframe.operators import spans as S

WORDS = "run_id string, sentence_id long, word_idx int, word string, gold string, pred string, truncated boolean"


def machine(seq):
    """The plain state machine: (type, start, end)."""
    out, start, kind = [], None, None
    for i, tag in enumerate([*seq, "O"]):
        t = tag[2:] if tag != "O" else None
        if kind is not None and (t is None or tag[0] == "B" or t != kind):
            out.append((kind, start, i))
            kind = None
        if t is not None and kind is None:
            kind, start = t, i
    return out


def frame(spark, pairs, run="r"):
    rows = [(run, s, i, f"w{i}", g, p, False) for s, (gold, pred) in enumerate(pairs) for i, (g, p) in enumerate(zip(gold, pred, strict=True))]
    return spark.createDataFrame(rows, WORDS)


def test_spans_equal_the_state_machine(spark):
    rng = random.Random(3)
    tagset = ["O", "O", "B-A", "I-A", "B-B", "I-B", "I-X-Y"]
    pairs = [([rng.choice(tagset) for _ in range(n)], [rng.choice(tagset) for _ in range(n)]) for n in (rng.randint(1, 12) for _ in range(300))]
    found = {(r["sentence_id"], r["side"], r["etype"], r["start"], r["end"]) for r in S.side_spans(frame(spark, pairs)).collect()}
    assert found == {(s, side, *e) for s, p in enumerate(pairs) for side, seq in zip(("gold", "pred"), p, strict=True) for e in machine(seq)}


@pytest.mark.parametrize(
    ("gold", "pred", "f1", "accuracy"),
    [
        (["B-PER I-PER O B-LOC", "B-ORG O"], ["B-PER I-PER O O", "B-ORG B-LOC"], 2 / 3, 4 / 6),
        (["B-PER I-PER O"], ["B-PER O O"], 0.0, 2 / 3),
        (["O B-LOC"], ["O I-LOC"], 1.0, 1 / 2),
        (["O O"], ["O O"], 0.0, 1.0),
    ],
)
def test_scores(spark, gold, pred, f1, accuracy):
    df = frame(spark, [(g.split(), p.split()) for g, p in zip(gold, pred, strict=True)])
    row = S.evaluate(df).first()
    assert row["f1"] == pytest.approx(f1) and row["accuracy"] == pytest.approx(accuracy)


def test_types_only_predicted_and_sentences_without_spans(spark):
    df = frame(spark, [(["B-PER", "O"], ["B-PER", "B-LOC"]), (["O"], ["O"])])
    by_type = {r["etype"]: (r["support"], r["f1"]) for r in S.prf(df).collect()}
    assert by_type == {"PER": (1, 1.0), "LOC": (0, 0.0), "micro": (1, pytest.approx(2 / 3))}
    counts = {r["sentence_id"]: (r["n_correct"], r["n_pred"], r["n_gold"]) for r in S.sentence_counts(df).collect()}
    assert counts == {0: (1, 2, 1), 1: (0, 0, 0)}
    assert S.prf(df.limit(0)).count() == 0


def test_example_contract(spark):
    test = [("Марат/B-PERSON Сейітов/I-PERSON зауытта/O жұмыс/O істейді/O ./O", None), ("Ертең/B-DATE Шымкентте/B-LOCATION концерт/O болады/O ./O", 1)]
    rows = [("x", s, i, w, g, "O" if i == miss else g, False) for s, (text, miss) in enumerate(test) for i, (w, g) in enumerate(x.rsplit("/", 1) for x in text.split())]
    row = S.evaluate(spark.createDataFrame(rows, WORDS)).first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (1.0, pytest.approx(2 / 3), pytest.approx(0.8), pytest.approx(10 / 11))


def test_latest_and_violations(spark):
    rows = [("r", 1, 0, "a", "O", "O", None, 1), ("r", 1, 0, "b", None, "B-X", None, 2), ("r", 1, 2, "c", "bad", "O", True, 1), ("r", 2, 0, "", "O", "O", True, 1)]
    df = spark.createDataFrame(rows, WORDS + ", loaded_at long")
    last = sorted(tuple(r) for r in C.latest(df).collect())
    assert last[0] == ("r", 1, 0, "b", "O", "B-X", False) and len(last) == 3
    found = sorted((r["sentence_id"], r["word_idx"] if r["word_idx"] is not None else -1, r["rule"]) for r in C.violations(df).collect())
    assert found == [(1, -1, "gap"), (1, 0, "duplicate"), (1, 0, "empty"), (1, 2, "label"), (2, 0, "empty")]
    labels = spark.createDataFrame([("O",), ("bad",)], "label string")
    assert [r["word_idx"] for r in C.violations(df, labels).filter("rule = 'label'").collect()] == [0]


def test_truncation_and_prefix(spark):
    gold = spark.createDataFrame([(1, i, f"w{i}", "B-X") for i in range(3)], "sentence_id long, word_idx int, word string, gold string")
    pred = spark.createDataFrame([("r", 1, 0, "w0", "B-X"), ("r", 1, 1, "other", "O")], "run_id string, sentence_id long, word_idx int, word string, pred string")
    out = sorted((r["word_idx"], r["pred"], r["truncated"]) for r in C.restore_truncated(gold, pred).collect())
    assert out == [(0, "B-X", False), (1, "O", False), (2, "O", True)]
    assert [r["word_idx"] for r in C.prefix_mismatches(gold, pred).collect()] == [1]


def test_mapping_and_restriction(spark):
    df = spark.createDataFrame([("B-GPE",), ("I-LOC",), ("O",), ("B-DATE",)], "t string")
    assert [r[0] for r in df.select(tags.map_tag("t", {"GPE": "LOC", "LOC": "LOC", "DATE": "O"})).collect()] == ["B-LOC", "I-LOC", "O", "O"]
    assert [r[0] for r in df.select(tags.restrict_tag("t", exclude=["DATE"])).collect()] == ["B-GPE", "I-LOC", "O", "O"]
    with pytest.raises(Exception, match="not in the mapping"):
        df.select(tags.map_tag("t", {"GPE": "LOC"})).collect()
    with pytest.raises(ValueError, match="either"):
        tags.restrict_tag("t", ["A"], ["B"])


def test_first_subword_predictions(spark):
    sub = spark.createDataFrame([(1, 0, None, [0.1, 0.9], ["O", "B-X"]), (1, 1, 0, [0.2, 0.8], ["O", "B-X"]), (1, 2, 0, [0.9, 0.1], ["O", "B-X"])], "sentence_id long, pos int, word_id int, scores array<double>, labels array<string>")
    words = spark.createDataFrame([(1, 0, "a", "O"), (1, 1, "b", "O")], "sentence_id long, word_idx int, word string, gold string")
    assert sorted((r["word_idx"], r["pred"], r["truncated"]) for r in C.first_subword_predictions(sub, words).collect()) == [(0, "B-X", False), (1, "O", True)]


def test_bins_and_subsets(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (5, 4, 2.0), (9, 5, 3.5)], "p int, f long, m double")
    rows = df.select(tags.piece_bin("p"), tags.frequency_bin("f"), tags.fertility_bin("m")).collect()
    assert [tuple(r) for r in rows] == [("1", "unseen", "1.0"), ("5+", "1-4", "(1,2]"), ("5+", "5+", ">3")]
    e = spark.createDataFrame([(False, 4.0, False), (False, 2.5, False), (True, 4.0, False), (False, 1.0, True)], "seen boolean, m double, unk boolean")
    names = [r[0] for r in e.select(tags.subset_names(F.col("seen"), F.col("m"), F.col("unk"))).collect()]
    assert names == [["primary"], [], ["negative_control"], ["unseen_with_unk"]]


def test_plan_has_one_exchange_before_the_scores(spark, tmp_path):
    df = frame(spark, [(["B-A", "O"], ["B-A", "O"])]).withColumn("loaded_at", F.lit(1))
    df.write.parquet(str(tmp_path / "p"))
    plan = S.matched_spans(C.latest(spark.read.parquet(str(tmp_path / "p"))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_same_sets_and_trainer_view(spark):
    df = frame(spark, [(["B-A", "O"], ["B-A", "O"])]).unionByName(frame(spark, [(["B-A", "O"], ["O", "O"])], "s"))
    C.require_same_set(df)
    other = df.unionByName(frame(spark, [(["O", "O"], ["O", "O"])], "t"))
    assert C.different_sets(other).count() == 2 and C.different_sets(other, ("word",)).count() == 1
    with pytest.raises(ValueError, match="another test set: t"):
        C.require_same_set(other)
    C.require_common_targets({"A": "X", "B": "O"}, {"C": "X"})
    with pytest.raises(ValueError, match="different target types"):
        C.require_common_targets({"A": "X"}, {"C": "Y"})
    aligned = spark.createDataFrame([(1, [-100, 1, -100, 0, 2, -100], [0, 1, 0, 0, 0, 0])], "sentence_id long, label_ids array<int>, pred_ids array<int>")
    micro = S.prf(C.labelled_positions(aligned, ["O", "B-A", "I-B"])).filter("etype = 'micro'").first()
    assert (micro["support"], micro["n_pred"], micro["n_correct"]) == (2, 1, 1)
