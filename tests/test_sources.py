import json

import pytest
from pyspark.sql import functions as F

from spanframe.sources import files, iob2, runs

TEXT = "Асан B-PERSON\nБарды x y 0\n\n  \nМен\tO\r\n.  O\n\n"


def test_read_iob2(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_bytes(TEXT.encode())
    rows = [tuple(r)[1:] for r in iob2.read_iob2(spark, str(path)).orderBy("sid", "idx").collect()]
    assert rows == [(0, 0, "Асан", "B-PERSON"), (0, 1, "Барды", "O"), (1, 0, "Мен", "O"), (1, 1, ".", "O")]
    (tmp_path / "b.txt").write_text("ok O\nbroken\n", encoding="utf-8")
    with pytest.raises(iob2.FormatError, match="b.txt:2"):
        iob2.read_iob2(spark, str(tmp_path / "b.txt"))
    assert iob2.read_iob2(spark, str(tmp_path / "b.txt"), strict=False).count() == 1


def test_splits_and_round_trip(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="IOB2_train.txt, IOB2_valid.txt, IOB2_test.txt"):
        iob2.read_splits(spark, str(tmp_path))
    for name in iob2.SPLIT_FILES.values():
        (tmp_path / name).write_text(TEXT, encoding="utf-8")
    df = iob2.read_splits(spark, str(tmp_path))
    assert {r["split"]: r["count"] for r in df.groupBy("split").count().collect()} == {"train": 4, "validation": 4, "test": 4}
    one = df.filter("split = 'test'")
    iob2.write_iob2(one.coalesce(1), str(tmp_path / "out"))
    back = iob2.read_iob2(spark, str(tmp_path / "out" / "*.txt"))
    assert sorted((r["word"], r["label"]) for r in back.collect()) == sorted((r["word"], r["label"]) for r in one.collect())
    with pytest.raises(iob2.FormatError, match="can't be written"):
        iob2.write_iob2(one.withColumn("word", F.lit("a b")), str(tmp_path / "bad"))
    assert [list(r["tokens"]) for r in iob2.arrays(one).orderBy("sid").collect()] == [["Асан", "Барды"], ["Мен", "."]]
    assert [tuple(r) for r in iob2.entity_counts(one).collect()] == [("PERSON", 1)]


def test_tagged_parquet_and_checksum(spark, tmp_path):
    spark.createDataFrame([(["a", "b"], [0, 1]), (["c"], [2])], "tokens array<string>, ner_tags array<int>").coalesce(1).write.parquet(str(tmp_path / "p"))
    rows = sorted(map(tuple, iob2.tagged_parquet(spark, str(tmp_path / "p"), ["O", "B-PER", "I-PER"]).collect()))
    assert rows == [(0, 0, "a", "O"), (0, 1, "b", "B-PER"), (1, 0, "c", "I-PER")]
    for name, text in (("x", b"a\r\nb"), ("y", b"a\nb")):
        (tmp_path / name).write_bytes(text)
    digests = {r["file"]: r["sha256"] for r in files.checksums(spark, str(tmp_path / "[xy]")).collect()}
    assert digests["x"] == digests["y"]
    files.verify(spark, str(tmp_path / "[xy]"), digests)
    with pytest.raises(ValueError, match="missing or changed: x, z"):
        files.verify(spark, str(tmp_path / "[xy]"), digests | {"x": "0", "z": "0"})


def test_class_names_from_footers(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    def write(name, names):
        table = pa.table({"tokens": [["a", "b"]], "ner_tags": [[0, 1]]})
        meta = {} if names is None else {b"huggingface": json.dumps({"info": {"features": {"ner_tags": {"feature": {"names": names}}}}}).encode()}
        pq.write_table(table.replace_schema_metadata(meta), tmp_path / name)

    write("a.parquet", ["O", "B-PER"])
    write("b.parquet", ["O", "B-PER"])
    rows = sorted(map(tuple, iob2.tagged_parquet(spark, str(tmp_path), expected=["O", "B-PER"]).collect()))
    assert rows == [(0, 0, "a", "O"), (0, 1, "b", "B-PER"), (1, 0, "a", "O"), (1, 1, "b", "B-PER")]
    with pytest.raises(iob2.FormatError, match="not B-PER, O"):
        iob2.tagged_parquet(spark, str(tmp_path), expected=["B-PER", "O"])
    write("b.parquet", ["B-PER", "O"])
    with pytest.raises(iob2.FormatError, match="2 different"):
        iob2.class_names(str(tmp_path))
    write("b.parquet", None)
    with pytest.raises(iob2.FormatError, match="b.parquet"):
        iob2.class_names(str(tmp_path))


def test_lines_of_several_blocks(spark, tmp_path):
    lines = [f"line {i}" * (i % 7) for i in range(3000)]
    (tmp_path / "a.txt").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "b.txt").write_text("x\r\n\ny\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = files.numbered_lines(spark, str(tmp_path / "a.txt")).orderBy("line_no").collect()
        assert [r["raw"] for r in found] == lines and [r["line_no"] for r in found] == list(range(3000)) and {r["file"] for r in found} == {"a.txt"}
        whole = files.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
        assert [r["line"] for r in whole] == [*lines, "x", "", "y"] and [r["line_no"] for r in whole] == list(range(3003))
        (tmp_path / "big.txt").write_text("".join(f"w{i} O\nv{i} B-X\n\n" for i in range(900)), encoding="utf-8")
        rows = iob2.read_iob2(spark, str(tmp_path / "big.txt")).orderBy("sid", "idx").collect()
        assert [(r["sid"], r["idx"], r["word"]) for r in rows] == [(i, k, f"{'wv'[k]}{i}") for i in range(900) for k in (0, 1)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_extension_and_corpus_folders(spark, tmp_path):
    from spanframe.operators import vocabulary as V

    base = spark.createDataFrame([("ab", 0), ("cd", 1), ("##ab", 2), ("##cd", 3)], "piece string, id int")
    e = V.extend(base, spark.createDataFrame([("abcd",), ("x",)], "piece string"), spark.createDataFrame([("abcd", 7)], "piece string, n long"), 5)
    manifest = runs.write_extension(e, str(tmp_path / "ext"))
    assert (manifest["pieces"], manifest["new"], manifest["skipped"]) == (5, 1, {"single_character": 1})
    assert [r["piece"] for r in runs.read_pieces(spark, str(tmp_path / "ext" / "new_pieces.txt")).collect()] == ["abcd"]
    assert json.loads((tmp_path / "ext" / "extension.json").read_text()) == manifest
    kept = spark.createDataFrame([(i, f"жол {i}") for i in range(40)], "i int, line string")
    one, two = (runs.write_corpus(kept.repartition(n), str(tmp_path / f"c{n}"), ["i"]) for n in (2, 5))
    assert (one["lines"], one["words"]) == (40, 80) == (two["lines"], two["words"])
    assert [r["line"] for r in files.read_lines(spark, str(tmp_path / "c2" / "corpus")).orderBy("line_no").collect()] == [f"жол {i}" for i in range(40)]


def test_head_mapping(tmp_path):
    path = tmp_path / "h.yaml"
    path.write_text("source: a\ntarget: b\noutside: true\nmapping: {PER: [PERSON, CHILD]}\n", encoding="utf-8")
    assert runs.read_head_mapping(str(path))["mapping"] == {"PER": ["PERSON", "CHILD"]}
    for bad in ("source: a\n", "source: a\ntarget: b\noutside: 1\nmapping: {}\n", "source: a\ntarget: b\noutside: true\nmapping: {PER: X}\n"):
        path.write_text(bad, encoding="utf-8")
        with pytest.raises(ValueError, match="h.yaml"):
            runs.read_head_mapping(str(path))


def test_runs(spark, tmp_path):
    for i in range(3):
        d = tmp_path / f"run{i}"
        d.mkdir()
        (d / "config.json").write_text(json.dumps({"seed": i, "data": {"train_fraction": 0.1}}), encoding="utf-8")
        (d / "predictions.csv").write_text("sentence_id,word_idx,word,gold,pred\n0,0,a,O,O\n", encoding="utf-8")
        if i:
            (d / "metrics.json").write_text("{}", encoding="utf-8")
    df = runs.read_runs(spark, str(tmp_path))
    assert {r["run_dir"]: r["metrics"] for r in df.collect()} == {"run0": None, "run1": "{}", "run2": "{}"}
    fields = {r["run_dir"]: (r["f"], r["x"]) for r in runs.run_fields(df, {"f": "data.train_fraction", "x": "a.b"}).collect()}
    assert fields["run1"] == ("0.1", None)
    assert {r["run_id"] for r in runs.read_run_predictions(spark, str(tmp_path)).collect()} == {"run0", "run1", "run2"}
    (tmp_path / "run2" / "predictions.csv").unlink()
    with pytest.raises(ValueError, match="run2"):
        runs.read_run_predictions(spark, str(tmp_path))


def test_ordered_documents(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    paths = []
    for f in range(2):
        paths.append(str(tmp_path / f"f{f}.parquet"))
        pq.write_table(pa.table({"text": [f"{f}{i}" for i in range(6)], "id": list(range(6))}), paths[-1], row_group_size=2)
    df = runs.ordered_documents(spark, paths, 3)
    got = [r["text"] for r in df.orderBy("group_rank", "row_index").collect()]
    assert sorted(got) == sorted(f"{f}{i}" for f in range(2) for i in range(6)) and all(int(got[i + 1]) == int(got[i]) + 1 for i in range(0, 12, 2))
    assert got != sorted(got) and got == [r["text"] for r in runs.ordered_documents(spark, paths, 3).orderBy("group_rank", "row_index").collect()]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string" in plan and "id:bigint" not in plan.split("ReadSchema")[1].split(">")[0]
    assert [g[2] for g in runs.row_groups(paths)] == [2] * 6


def test_ids_and_reports(spark, tmp_path):
    assert runs.run_id({"b": 1, "a": 2}) == runs.run_id({"a": 2, "b": 1}, data=None) != runs.run_id({"a": 2, "b": 1}, data="x") and len(runs.run_id({})) == 12
    df = spark.createDataFrame([("қ", 1.5), (None, None)], "a string, b double")
    runs.write_report(df, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text(encoding="utf-8")) == [{"a": "қ", "b": 1.5}, {"a": None, "b": None}]
    with pytest.raises(ValueError, match="at most"):
        runs.write_report(df, str(tmp_path / "r.json"), most=1)
    assert runs.format_table(df).splitlines()[1] == "қ  1.5000"
    assert runs.format_report("All", {"one": df.limit(1), "two": df.limit(0)}).splitlines() == ["All", "===", "", "one", "---", "a  b", "қ  1.5000", "", "two", "---", "(none)"]
    assert not (tmp_path / "r.json.part").exists()
    path = tmp_path / "m.yaml"
    path.write_text("source: a\ntarget: b\ntarget_types: [PER]\nmapping: {PERSON: PER, DATE: O}\n", encoding="utf-8")
    assert runs.read_mapping(str(path))["mapping"] == {"PERSON": "PER", "DATE": "O"}
    path.write_text("source: a\ntarget: b\ntarget_types: [PER]\nmapping: {PERSON: LOC}\n", encoding="utf-8")
    with pytest.raises(ValueError, match="LOC"):
        runs.read_mapping(str(path))
    (tmp_path / "pieces.txt").write_text("ab\n\n##c\n", encoding="utf-8")
    assert [r["piece"] for r in runs.read_pieces(spark, str(tmp_path / "pieces.txt")).orderBy("ordinal").collect()] == ["ab", "##c"]
