import csv
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanframe.operators import rejects
from spanframe.sources import contract

HEAD = "sentence_id,word_idx,word,gold,pred,truncated"


def lines(spark, bodies, head=HEAD, file="f"):
    rows = [(i, file, i + 1, raw) for i, raw in enumerate([head, *bodies])]
    return spark.createDataFrame(rows, "line_id long, file_name string, line_no int, raw string")


@pytest.mark.parametrize(
    ("raw", "reason"),
    [
        ("1,0,a,O,O,0", None),
        ("1,0,a,O,O,0\r", None),
        ("1,0,a,O,O,", None),
        ('"1","0","a,b","B-PER","I-X-Y","1"', None),
        ('1,0,"""",O,O,0', None),
        ("", None),
        ("  \t", None),
        ("\r", None),
        (None, None),
        ('1,0,a"b,O,O,0', "quoting"),
        ('1,0,"a,O,O,0', "quoting"),
        ('1,0,"a"b,O,O,0', "quoting"),
        ('1,0,"a" ,O,O,0', "quoting"),
        ("1,0,a,O,O", "field_count"),
        ("1,0,a,O,O,0,", "field_count"),
        ("1,0,,O,O,0", "empty"),
        ('1,0,"",O,O,0', "empty"),
        (",x,a,O,O,0", "empty"),
        ("1,-1,a,O,O,0", "integer"),
        ("1,٣,a,O,O,0", "integer"),
        ("1,0,a,B-,X,0", "gold"),
        ("1,0,a,B-A B,O,0", "gold"),
        ("1,0,a,O,I,0", "pred"),
        ("1,0,a,O,O\r,0", "pred"),
        ("1,0,a,O,O,2", "truncated"),
        ("1,0,\x01a\x01b,O,O,2", "truncated"),
    ],
)
def test_reason(spark, raw, reason):
    found = {r["line_id"]: r["reason"] for r in rejects.faulty_lines(lines(spark, [raw])).collect()}
    assert found == ({1: reason} if reason else {})


def test_clean_rows_are_typed_and_keep_repeats(spark):
    df = lines(spark, ["7,0,a,O,B-X,1", "7,0,a,O,B-X,1", '7,1,"x ""y"", z",O,O,', "bad"])
    rows = sorted(tuple(r)[2:] for r in rejects.clean_rows(df).collect())
    assert rows == [(7, 0, "a", "O", "B-X", True)] * 2 + [(7, 1, 'x "y", z', "O", "O", False)]


def test_columns_in_another_order_and_no_truncated(spark):
    df = lines(spark, ["O,O,a,0,3"], head="pred,gold,word,word_idx,sentence_id\r")
    assert [tuple(r)[2:] for r in rejects.clean_rows(df).collect()] == [(3, 0, "a", "O", "O", False)]


def test_file_without_header_and_empty_table(spark):
    df = lines(spark, ["1,0,a,O,O,0"]).filter("line_no > 1")
    assert [r["reason"] for r in rejects.faulty_lines(df).collect()] == ["field_count"]
    assert rejects.faulty_lines(df.limit(0)).count() == 0
    assert rejects.clean_rows(df.limit(0)).count() == 0


@pytest.mark.parametrize("head", ["sentence_id,word_idx,word,gold,pred,pred", "sentence_id,word_idx,word,gold"])
def test_broken_headers_lose_no_line(spark, head):
    n = head.count(",") + 1
    df = lines(spark, [",".join(["1", "0", "w", "O", "O", "O"][:n]), "x", ""], head=head)
    assert {r["line_id"]: r["reason"] for r in rejects.faulty_lines(df).collect()} == {1: "header", 2: "header"}
    assert rejects.clean_rows(df).count() == 0


def test_very_long_line_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    long = '1,0,"' + '""' * 50_000 + '",O,O,0'
    df = lines(spark, [long, "1,1," + "x" * 500_000 + ",O,O,5"]).withColumn("reason", F.lit("mine")).withColumn("cells", F.lit(1))
    assert [(r["line_id"], r["reason"]) for r in rejects.faulty_lines(df).collect()] == [(2, "truncated")]
    assert rejects.clean_rows(df).first()["word"] == '"' * 50_000


@settings(max_examples=25, deadline=None)
@given(rows=st.lists(st.lists(st.text(alphabet='ab",\x01 é', max_size=6), min_size=1, max_size=4), min_size=1, max_size=20))
def test_cells_round_trip(spark, rows):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    bodies = out.getvalue().split("\n")[:-1]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(enumerate(bodies)), "i int, b string").select("i", rejects.quoting_ok(F.col("b")).alias("ok"), rejects.split_cells(F.col("b")).alias("c"))
    got = {r["i"]: r for r in df.collect()}
    assert all(got[i]["ok"] and list(got[i]["c"]) == row for i, row in enumerate(rows))


def test_contract_file_round_trip(spark, tmp_path):
    words = ["NA", '"', "a,b", "\\", "null", "nan", "#", " x", "😀"]
    df = spark.createDataFrame([(5, i, w, "O", "B-A", i == 2) for i, w in enumerate(words)], "sentence_id long, word_idx int, word string, gold string, pred string, truncated boolean")
    contract.write_predictions(df, str(tmp_path / "out"))
    back = contract.read_predictions(spark, str(tmp_path / "out" / "*.csv")).orderBy("word_idx").collect()
    assert [r["word"] for r in back] == words
    assert [r["truncated"] for r in back] == [i == 2 for i in range(len(words))]


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("sentence_id,word_idx,word,gold\n", "missing columns pred"),
        ("sentence_id,word_idx,word,gold,pred,x\n", "unknown columns x"),
        ("sentence_id,word_idx,word,gold,pred\n0,0,a,O\n", ":2"),
        ("sentence_id,word_idx,word,gold,pred\n0,0,a,O,O\n0,0,a,O,O\n", "twice"),
        ("sentence_id,word_idx,word,gold,pred\n0,1,a,O,O\n", "gaps"),
        ("sentence_id,word_idx,word,gold,pred\n0,0,a,X-PER,O\n", ":2"),
    ],
)
def test_rejected_files(spark, tmp_path, text, message):
    path = tmp_path / "p.csv"
    path.write_text(text, encoding="utf-8")
    with pytest.raises(rejects.FormatError, match=message):
        contract.read_predictions(spark, str(path))


def test_older_layout(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("sentence_id,token,true_label,pred_label\n3,a,O,O\n3,b,B-X,O\n1,c,O,O\n", encoding="utf-8")
    rows = sorted(tuple(r) for r in contract.read_older(spark, str(path)).collect())
    assert rows == [(1, 0, "c", "O", "O", False), (3, 0, "a", "O", "O", False), (3, 1, "b", "B-X", "O", False)]
    gold = [(1, 0, "c", "O"), (1, 1, "d", "B-Y"), (3, 0, "a", "O"), (3, 1, "b", "B-X")]
    schema = "sid long, idx int, word string, label string"
    rows = sorted(tuple(r) for r in contract.read_older(spark, str(path), spark.createDataFrame(gold, schema)).collect())
    assert rows == [(1, 0, "c", "O", "O", False), (1, 1, "d", "B-Y", "O", True), (3, 0, "a", "O", "O", False), (3, 1, "b", "B-X", "O", False)]
    for wrong in ([*gold[:3], (3, 1, "b", "O")], gold[:3], [*gold, (4, 0, "x", "O")]):
        with pytest.raises(rejects.FormatError, match="match the gold file"):
            contract.read_older(spark, str(path), spark.createDataFrame(wrong, schema))
