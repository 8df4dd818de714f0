import json

import pytest

from spanframe import cli
from spanframe.sources import config

CONTRACT = "sentence_id,word_idx,word,gold,pred\n0,0,Марат,B-PERSON,B-PERSON\n0,1,Сейітов,I-PERSON,I-PERSON\n0,2,.,O,O\n1,0,Шымкентте,B-LOCATION,{}\n1,1,болды,O,O\n"
VOCABULARY = "[UNK]\nМарат\nСейітов\n.\nШымкент\n##те\nболды\nАсан"


@pytest.fixture()
def folder(tmp_path):
    for name, pred in (("x", "O"), ("y", "B-LOCATION")):
        for seed in (1, 2):
            d = tmp_path / "runs" / f"{name}{seed}"
            d.mkdir(parents=True)
            (d / "config.json").write_text(json.dumps({"name": name, "seed": seed, "model": {"name": "m"}, "method": {"name": name}}), encoding="utf-8")
            (d / "metrics.json").write_text(json.dumps({"test_contract": {"precision": 1.0, "recall": 0.5 * seed, "f1": 0.4 * seed, "accuracy": 0.9}}), encoding="utf-8")
            (d / "predictions.csv").write_text(CONTRACT.format(pred), encoding="utf-8")
    for split in ("train", "valid", "test"):
        (tmp_path / f"IOB2_{split}.txt").write_text("Марат B-PERSON\nСейітов I-PERSON\n\nболды O\n", encoding="utf-8")
    (tmp_path / "vocab.txt").write_text(VOCABULARY, encoding="utf-8")
    return tmp_path


def run(spark, capsys, *args):
    cli.main([str(a) for a in args], spark)
    return json.loads(capsys.readouterr().out)


def test_commands(spark, folder, capsys):
    runs, train, vocabulary = folder / "runs", folder / "IOB2_train.txt", folder / "vocab.txt"
    out = run(spark, capsys, "evaluate", "--predictions", runs / "x1" / "predictions.csv", "--out", folder / "m.json")
    assert (out["precision"], out["recall"], out["accuracy"]) == (1.0, 0.5, 0.8) and out["per_type"]["LOCATION"]["f1"] == 0.0
    assert json.loads((folder / "m.json").read_text(encoding="utf-8")) == out
    assert {r["split"]: r["words"] for r in run(spark, capsys, "fertility", "--data", folder, "--vocabulary", vocabulary)} == {"train": 3, "validation": 3, "test": 3, None: 9}
    assert run(spark, capsys, "overlap", "--source", train, "--target", train, "--vocabulary", vocabulary)["all"]["covered_words"] == 100.0
    rows = run(spark, capsys, "aggregate", "--runs", runs, "--by", "method", "--csv", folder / "agg")
    assert [(r["method"], r["n"], round(r["f1_mean"], 9), r["seeds"]) for r in rows] == [("x", 2, 0.6, [1, 2]), ("y", 2, 0.6, [1, 2])]
    out = run(spark, capsys, "fragmentation", "--runs", runs, "--train", train, "--vocabulary", vocabulary, "--least", 1, "--replicates", 5, "--csv", folder / "ent", "--text", folder / "f.txt")
    assert out["entities"] == 2 and {(r["grp"], r["seen"], r["mean"]) for r in out["entity_recall_by_fertility"]} == {(g, s, m) for g, m0 in (("model=m, method=x", 0.0), ("model=m, method=y", 1.0)) for s, m in ((True, 1.0), (False, m0))}
    assert len(out["odds_ratios"]) == 12 and {r["odds_ratio"] for r in out["pieces_odds_ratio"] if "=y" in r["grp"]} == {None} and "word_error_by_pieces" in (folder / "f.txt").read_text()
    by_file = folder / "pairs0.yaml"
    by_file.write_text("- {name: p, a: [x1, x2], b: [nobody]}\n", encoding="utf-8")
    with pytest.raises(SystemExit, match="no hits of nobody"):
        run(spark, capsys, "compare", "--entities", folder / "ent", "--pairs", by_file)
    out = run(spark, capsys, "paired", "--runs", runs, "--a", "x", "--b", "y", "--replicates", 50)
    assert out["delta"] == pytest.approx(1 - 2 / 3) and out["sign_flip_p"] == 0.5
    mapping = folder / "map.yaml"
    mapping.write_text("source: a\ntarget: b\ntarget_types: [PER]\nmapping: {PERSON: PER, LOCATION: O}\n", encoding="utf-8")
    predictions = runs / "y1" / "predictions.csv"
    assert run(spark, capsys, "evaluate", "--predictions", predictions, "--map-gold", mapping, "--map-pred", mapping)["per_type"].keys() == {"PER"}
    with pytest.raises(SystemExit, match="types of pred that the mapping of gold doesn't end in: LOCATION, PERSON"):
        run(spark, capsys, "evaluate", "--predictions", predictions, "--map-gold", mapping)
    for d in ("x1", "x2", "y1", "y2"):
        (runs / d / "extra.csv").write_text("sentence_id,word_idx,word,gold,pred\n0,0,Асан,B-PER,B-PERSON\n0,1,болды,O,B-LOCATION\n1,0,АЙДАУ,O,O\n", encoding="utf-8")
    out = run(spark, capsys, "transfer", "--runs", runs, "--extra", "extra.csv", "--mapping", mapping, "--vocabulary", vocabulary, "--by", "model", "--replicates", 20, "--csv", folder / "tr")
    rows = {(r["step"], r["etype"]): r for r in out["steps"]}
    assert rows["source_mapped", "PER"]["f1_mean"] == 1.0 and rows["source", "LOCATION"]["recall_mean"] == 0.5 and rows["extra", "PER"]["precision_mean"] == 1.0
    assert {r["subset"]: (r["f1_mean"], r["sentences"]) for r in out["subsets"]} == {"all": (1.0, 2), "other": (1.0, 1), "other_unique": (1.0, 1), "redirect": (0.0, 1)}
    assert {(r["subset"], r["fertility_bin"]): (r["n"], r["recall"]) for r in out["recall_by_pieces"] if r["n"]} == {("all", "1.0"): (1, 1.0), ("other", "1.0"): (1, 1.0)} and len(out["recall_by_pieces"]) == 8
    pairs = folder / "pairs.yaml"
    pairs.write_text("- {name: p, a: [x1, x2], b: [y1, y2]}\n", encoding="utf-8")
    with pytest.raises(ValueError, match="no entity is in primary"):
        run(spark, capsys, "compare", "--runs", runs, "--train", train, "--vocabulary", vocabulary, "--pairs", pairs, "--replicates", 20)


def test_vocabulary_and_pretraining_commands(spark, folder, capsys):
    (folder / "learned.txt").write_text("болдыМарат\nxy\nболды\nq\n", encoding="utf-8")
    (folder / "corpus.txt").write_text("болдыМарат болды\nболдыМарат . Шымкентте\n", encoding="utf-8")
    base = folder / "base.txt"
    base.write_text("[UNK]\n[CLS]\n[SEP]\n[MASK]\nМарат\nболды\n##Марат\nСейітов\n.\nШымкент\n##те\n", encoding="utf-8")
    out = run(spark, capsys, "extend-vocab", "--vocabulary", base, "--learned", folder / "learned.txt", "--corpus", folder / "corpus.txt", "--data", folder, "--size", 3, "--to", folder / "ext")
    assert out["skipped"] == {"in_base": 1, "single_character": 1, "needs_unk": 1} and out["manifest"]["new"] == 1 and out["usage"]["least"] == 2
    assert (folder / "ext" / "new_pieces.txt").read_text(encoding="utf-8") == "болдыМарат\n"
    (folder / "p.yaml").write_text(f"name: n\ncorpus: {{path: {folder / 'corpus.txt'}}}\nchunker: {{max_len: 5}}\nmasking: {{probability: 0.5}}\n", encoding="utf-8")
    out = run(spark, capsys, "pretrain", "--config", folder / "p.yaml", "--vocabulary", base, "--to", folder / "examples")
    assert (out["chunks"], out["words"], out["pieces"], out["oversized"], len(out["run_id"])) == (3, 5, 8, 0, 12)
    rows = spark.read.parquet(str(folder / "examples")).orderBy("chunk").collect()
    assert [len(r["input_ids"]) for r in rows] == [5, 5, 4] and all(any(x != -100 for x in r["labels"]) for r in rows)
    assert run(spark, capsys, "pretrain", "--config", folder / "p.yaml", "--vocabulary", base, "--max-chunks", 1, "--to", folder / "examples")["chunks"] == 1
    for bad, message in (("masking: {mask_share: 0.9, random_share: 0.2}", "together"), ("masking: {probability: 1}", r"in \(0, 1\)"), ("model: {name: ./m, revision: r}", "named model"), ("masking: {probabilty: 0.1}", "masking.probability")):
        (folder / "bad.yaml").write_text(f"name: n\ncorpus: {{path: c}}\n{bad}\n", encoding="utf-8")
        with pytest.raises(config.ConfigError, match=message):
            config.read_pretraining(str(folder / "bad.yaml"))


def test_rescore_and_subset_commands(spark, folder, capsys):
    (folder / "gold.txt").write_text("a B-X\nb O\n\nc O\nd B-X\n", encoding="utf-8")
    (folder / "old.csv").write_text("sentence_id,token,true_label,pred_label\n0,a,B-X,B-X\n0,b,O,O\n1,c,O,O\n", encoding="utf-8")
    rows = {r["variant"]: r for r in run(spark, capsys, "rescore", "--predictions", folder / "old.csv", "--gold", folder / "gold.txt")}
    assert (rows["as it is"]["recall"], rows["complete"]["recall"], rows["complete"]["truncated_words"]) == (1.0, 0.5, 1)
    (folder / "many.txt").write_text("".join(f"w{i % 15} O\nx O\n\n" for i in range(40)), encoding="utf-8")
    out = run(spark, capsys, "subset", "--source", folder / "many.txt", "--to", folder / "sub", "--fraction", 0.1, "--heldout", 5)
    assert out["files"]["train_subset"]["sentences"] == 4 and out["files"]["heldout"]["sentences"] == 5
    again = run(spark, capsys, "subset", "--source", folder / "many.txt", "--to", folder / "sub2", "--fraction", 0.1, "--heldout", 5)
    assert {k: v["sentences"] for k, v in again["files"].items()} == {k: v["sentences"] for k, v in out["files"].items()}


def test_results_are_made_once(spark, tmp_path):
    run_ = config.expand(config.checked({"name": "n", "data": {"dir": "d"}}))[0]
    made = []
    make = lambda r: made.append(r["run_id"]) or {"f1": len(made)}
    assert [config.results(spark, run_, str(tmp_path), make, force)["f1"] for force in (False, False, True)] == [1, 1, 2]
    one, two = tmp_path / "one", tmp_path / "two"
    for d, end in ((one, "\n"), (two, "\r\n")):
        d.mkdir()
        (d / "a.txt").write_bytes(f"x{end}y".encode())
        (d / ".hidden").write_text(str(d))
        (d / "b.bin").write_bytes(b"\r\n")
    assert config.folder_digest(str(one)) == config.folder_digest(str(two)) != config.folder_digest(str(one), ["a.txt"])
    with pytest.raises(config.ConfigError, match="no folder"):
        config.folder_digest(str(tmp_path / "none"))
    assert config.code_identity(str(tmp_path))["code_ref"].startswith("spanframe==")


def test_names():
    from spanframe.names import TOKENIZERS, Named

    with pytest.raises(KeyError, match="fixed_width, wordpiece"):
        TOKENIZERS["none"]
    things = Named("metric")
    things.register("a")(1)
    with pytest.raises(ValueError, match="twice"):
        things.register("a")(2)


def test_config():
    base = {"name": "n", "data": {"dir": "d"}}
    full = config.checked(base | {"training": {"learning_rate": "5e-5"}, "seeds": [1, 2]})
    assert full["training.learning_rate"] == 5e-5 and full["model.max_len"] == 128
    one, two = config.expand(full)
    assert one["seed"] == 1 and one["run_id"] != two["run_id"] and len(one["run_id"]) == 12
    assert config.expand(config.checked(base | {"output_root": "else", "seeds": [1]}))[0]["run_id"] == config.expand(config.checked(base | {"seeds": [1]}))[0]["run_id"]
    assert config.expand(full, data="x")[0]["run_id"] != one["run_id"] == config.expand(full, data=None)[0]["run_id"]
    for bad, message in [({"name": "n"}, "data.dir"), (base | {"modle": {"name": "x"}}, "model.name"), (base | {"seeds": [1, 1]}, "distinct"), (base | {"training": {"epochs": 0}}, "above 0"), (base | {"training": {"epochs": "many"}}, "can't be")]:
        with pytest.raises(config.ConfigError, match=message):
            config.checked(bad)
    assert config.is_local("./m") and not config.is_local("org/model")
