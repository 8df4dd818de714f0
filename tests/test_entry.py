import importlib.util
import os

import pytest

import __spark_entry__ as E

TINY = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(TINY), reason="no test tables here")


def test_names_and_sql():
    assert set(E.oracle_sql()) <= set(E.queries())
    if importlib.util.find_spec("spanframe.llm") is None:
        assert not any(n.startswith("p") and n[1:2].isdigit() and not n.startswith("p4_") for n in E.queries())
    else:
        # a broken import in the folder must not pass as its absence
        assert {f"p{n}_" for n in range(1, 9)} <= {n[:3] for n in E.queries()}


def test_nothing_imports_the_training_data_package():
    root = os.path.dirname(E.__file__)
    for folder, _, files in os.walk(os.path.join(root, "spanframe")):
        if os.sep + "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f), encoding="utf-8") as h:
                    assert "spanframe.llm" not in h.read(), f


@needs_data
def test_flagship(spark):
    assert E.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", ["prf_by_run", "sentence_counts", "line_stages", "fertility_by_split", "entity_table", "recall_by_fertility", "aggregate_runs", "p4_found", "wordpiece_subset_recall", "wordpiece_overlap", "extension_vocabulary", "chunk_text", "paired_f1", "paired_recall", "iob2_round_trip", "contract_round_trip", "trainer_scores"])
def test_equal_to_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(TINY):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{TINY}/{f}'")
    df = E.queries()[name](spark, TINY)
    names = sorted(df.columns)
    want = con.execute(E.oracle_sql()[name])
    at = [d[0] for d in want.description]
    rows = [tuple(r[at.index(c)] for c in names) for r in want.fetchall()]
    assert sorted(at) == names
    key = lambda r: tuple(round(x, 8) if isinstance(x, float) else x for x in r)
    assert sorted((key(r) for r in rows), key=repr) == sorted((key(tuple(r[c] for c in names)) for r in df.collect()), key=repr)
