import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from spanframe.functions import text as X
from spanframe.operators import curation as Q
from spanframe.operators import sampling as Sa

SEPARATORS = "a\nb\rc\r\nd\x0be\x0cf\x1cg\x1dh\x1ei\x85j k l"


@pytest.mark.parametrize("text", [SEPARATORS, "", "a\n", "\n", "\n\n", "a\r\n\r\nb", "no end"])
def test_split_lines(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(X.split_lines("t").alias("l")).first()
    assert list(row["l"]) == text.splitlines()


def test_split_lines_of_null(spark):
    assert list(spark.createDataFrame([(None,)], "t string").select(X.split_lines("t").alias("l")).first()["l"]) == []


def test_normalize_line_equals_python(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \t\xa0　\x1c\x1f йé") for _ in range(20)) for _ in range(100)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.normalize_line("t")).collect()]
    assert got == [" ".join(unicodedata.normalize("NFC", t).split()) for t in texts]


@pytest.mark.parametrize(("line", "want"), [("Қазақ тілі", True), ("Русский текст", False), ("english", False), ("12 !", False), ("Қ english words here", False), ("", False)])
def test_is_kazakh(spark, line, want):
    assert spark.createDataFrame([(line,)], "l string").select(X.is_kazakh("l")).first()[0] is want


def test_folded_words_equal_python(spark):
    texts = ["Straße ÖL_1", "ӘЛЕМ-дегі е́", "²Ⅷ a‿b"]
    got = [list(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.folded_words("t")).collect()]
    assert got == [re.findall(r"\w+", unicodedata.normalize("NFC", t).casefold()) for t in texts]


KEPT = "Бүгін біз үлкен қалада тұрамыз"
SEQUENCE = [KEPT, "қысқа жол", KEPT, "this is an english line of text", "Ең ұзын сөйлем мұнда бар еді деп айтты ол", "Ең ұзын сөйлем мұнда бар еді деп айтты ол", "Тағы да бір жақсы жаңа әдемі күн болды"]


def lines(spark, seq=SEQUENCE):
    return spark.createDataFrame([(i // 3, i % 3, s) for i, s in enumerate(seq)], "doc_id long, line_no int, line string")


def test_stages(spark):
    index = spark.createDataFrame([("ұзын сөйлем МҰНДА бар еді деп",), ("сөйлем мұнда бар",), (None,)], "text string")
    rows = Q.staged_lines(lines(spark), ["doc_id", "line_no"], index).orderBy("doc_id", "line_no").collect()
    # the second copy is a duplicate although the first is dropped as contaminated
    assert [r["stage"] for r in rows] == ["kept", "too_short", "duplicate", "not_kazakh", "contaminated", "duplicate", "kept"]
    counts = {r["stage"]: r["lines"] for r in Q.stage_counts(Q.staged_lines(lines(spark), ["doc_id", "line_no"], index)).collect()}
    assert counts == {"kept": 2, "too_short": 1, "duplicate": 2, "not_kazakh": 1, "contaminated": 1, "lines": 7}
    assert Q.staged_lines(lines(spark).limit(0), ["doc_id", "line_no"], index).count() == 0


def test_budget(spark):
    df = lines(spark, [KEPT + f" {i}" for i in range(9)]).withColumn("stage", F.lit("kept")).withColumn("n_words", F.lit(6))
    assert Q.until_budget(df, 13, ["doc_id", "line_no"]).count() == 3  # six words each
    assert Q.until_budget(df, 12, ["doc_id", "line_no"]).count() == 2


def test_prefix_sums(spark):
    rng = random.Random(2)
    values = [(i, rng.choice([None, 1, 2, 5])) for i in range(500)]
    got = {r["i"]: r["s"] for r in Q.prefix_sums(spark.createDataFrame(rng.sample(values, 500), "i long, v long"), "v", ["i"], "s").collect()}
    total = 0
    for i, v in values:
        assert got[i] == total
        total += v or 0


def test_documents_to_lines(spark):
    docs = spark.createDataFrame([(1, "a  b\n\n c\t"), (2, None), (3, ""), (4, " \n ")], "doc_id long, text string")
    assert sorted(map(tuple, Q.document_lines(docs, ["doc_id"]).collect())) == [(1, 0, "a b"), (1, 2, "c")]


def test_exact_sample(spark):
    assert len(Sa.sample_indices(90_228, 0.1, 42)) == 9023 and Sa.sample_indices(5, 0.01, 1) == Sa.sample_indices(5, 0.01, 1)
    assert len(Sa.sample_indices(5, 0.01, 1)) == 1 and Sa.sample_indices(7, 1.0, 3) == list(range(7))
    with pytest.raises(ValueError, match="fraction"):
        Sa.sample_indices(5, 0.0, 1)
    df = spark.range(100).withColumnRenamed("id", "ordinal")
    assert sorted(r[0] for r in Sa.exact_sample(df.repartition(7), "ordinal", 0.2, 5).collect()) == Sa.sample_indices(100, 0.2, 5)
    assert Sa.exact_sample(df, "ordinal", 0.2, 5, most=3).count() == 3 and Sa.exact_sample(df.limit(0), "ordinal", 0.5, 1).count() == 0


def test_heldout_refuses_too_many(spark, monkeypatch):
    monkeypatch.setattr(Sa, "EXACT_LIMIT", 5)
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "sid long, text string")
    with pytest.raises(ValueError, match="too many"):
        Sa.heldout_sample(rows, rows.limit(0), "text", "sid", 2, 1)


def test_heldout(spark):
    rows = spark.createDataFrame([(i, f"t{i % 12}") for i in range(40)], "sid long, text string")
    train = spark.createDataFrame([(f"t{i}",) for i in range(4)], "text string")
    assert sorted(r["sid"] for r in Sa.heldout_candidates(rows, train, "text", "sid").collect()) == list(range(4, 12))
    assert Sa.heldout_sample(rows, train, "text", "sid", 5, 1).count() == 5
    with pytest.raises(ValueError, match="only 8"):
        Sa.heldout_sample(rows, train, "text", "sid", 9, 1)
