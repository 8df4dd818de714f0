"""Queries: contract checks, spans, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe.functions import tags
from spanframe.operators import contract as C
from spanframe.operators import splits as sp
from spanframe.operators import spans as S
from spanframe.plans import sql
from spanframe.plans.registry import CORE
from spanframe.session import table

BASE = f"WITH {sql.CONTRACT}, {sql.spans()}"


def words(spark, sf_dir):
    return C.latest(table(spark, sf_dir, "predictions"))


@CORE.register("contract_latest", f"WITH {sql.CONTRACT} SELECT * FROM contract")
def contract_latest(spark, sf_dir):
    return words(spark, sf_dir)


@CORE.register("span_extract", f'{BASE} SELECT run_id, sentence_id, side, etype, "start", "end" FROM spans')
def span_extract(spark, sf_dir):
    return S.side_spans(words(spark, sf_dir))


@CORE.register("span_match", f'{BASE} SELECT run_id, sentence_id, etype, "start", "end", in_pred AS hit FROM matched WHERE in_gold')
def span_match(spark, sf_dir):
    """Every gold span with whether the run has it exactly."""
    return S.matched_spans(words(spark, sf_dir)).filter("in_gold").select("run_id", "sentence_id", "etype", "start", "end", F.col("in_pred").alias("hit"))


@CORE.register("prf_by_type", f"{BASE}, {sql.prf()} SELECT * FROM prf")
def prf_by_type(spark, sf_dir):
    return S.prf(words(spark, sf_dir))


@CORE.register("prf_by_run", f"{BASE}, {sql.prf('run_id')} SELECT * FROM prf")
def prf_by_run(spark, sf_dir):
    return S.prf(words(spark, sf_dir), ["run_id"])


_ACCURACY = """accuracy AS (
  SELECT run_id, count(DISTINCT sentence_id) AS sentences, count(*) AS words, count(*) FILTER (WHERE truncated) AS truncated_words,
    count(*) FILTER (WHERE gold = pred)::DOUBLE / count(*) AS accuracy FROM contract GROUP BY run_id
)"""


@CORE.register("token_accuracy", f"WITH {sql.CONTRACT}, {_ACCURACY} SELECT * FROM accuracy")
def token_accuracy(spark, sf_dir):
    return S.token_accuracy(words(spark, sf_dir), ["run_id"])


@CORE.register(
    "evaluate_runs",
    f"""{BASE}, {sql.prf("run_id")}, {_ACCURACY} SELECT a.*, coalesce("precision", 0) AS "precision", coalesce(recall, 0) AS recall, coalesce(f1, 0) AS f1,
    coalesce(support, 0) AS gold_spans, coalesce(n_pred, 0) AS pred_spans FROM accuracy a LEFT JOIN prf p ON p.run_id = a.run_id AND p.etype = 'micro'""",
)
def evaluate_runs(spark, sf_dir):
    return S.evaluate(words(spark, sf_dir))


@CORE.register(
    "sentence_counts",
    f"""{BASE} SELECT c.run_id, c.sentence_id, count(*) FILTER (WHERE in_gold AND in_pred) AS n_correct, count(*) FILTER (WHERE in_pred) AS n_pred, count(*) FILTER (WHERE in_gold) AS n_gold
    FROM (SELECT DISTINCT run_id, sentence_id FROM contract) c LEFT JOIN matched m USING (run_id, sentence_id) GROUP BY ALL""",
)
def sentence_counts(spark, sf_dir):
    return S.sentence_counts(words(spark, sf_dir))


@CORE.register(
    "word_errors",
    f"WITH {sql.CONTRACT} SELECT run_id, substr(gold, 3) AS etype, count(*) AS words, count(*) FILTER (WHERE gold <> pred) AS errors FROM contract GROUP BY ALL",
)
def word_errors(spark, sf_dir):
    w = words(spark, sf_dir)
    return w.groupBy("run_id", tags.tag_type("gold").alias("etype")).agg(F.count("*").alias("words"), F.count_if(F.col("gold") != F.col("pred")).alias("errors"))


@CORE.register(
    "contract_violations",
    r"""WITH found AS (
  SELECT run_id, sentence_id, word_idx, 'empty' AS rule FROM predictions WHERE sentence_id IS NULL OR word_idx IS NULL OR coalesce(word, '') = '' OR coalesce(gold, '') = '' OR coalesce(pred, '') = ''
  UNION ALL SELECT DISTINCT run_id, sentence_id, word_idx, 'label' FROM predictions WHERE (gold <> '' AND NOT regexp_full_match(gold, 'O|[BI]-\S+')) OR (pred <> '' AND NOT regexp_full_match(pred, 'O|[BI]-\S+'))
  UNION ALL SELECT run_id, sentence_id, word_idx, 'duplicate' FROM predictions GROUP BY ALL HAVING count(*) > 1
  UNION ALL SELECT run_id, sentence_id, NULL::INT, 'gap' FROM (SELECT DISTINCT run_id, sentence_id, word_idx FROM predictions) GROUP BY run_id, sentence_id HAVING min(word_idx) <> 0 OR max(word_idx) <> count(*) - 1
) SELECT * FROM found""",
)
def contract_violations(spark, sf_dir):
    return C.violations(table(spark, sf_dir, "predictions"))


@CORE.register(
    "truncation_restore",
    f"""WITH {sql.CONTRACT}, kept AS (SELECT * FROM contract WHERE word_idx < 12), seen AS (SELECT DISTINCT run_id, sentence_id FROM kept),
    gold AS (SELECT DISTINCT sentence_id, word_idx, word, gold FROM (SELECT sentence_id, word_idx, min(word) AS word, min(gold) AS gold FROM contract GROUP BY ALL))
    SELECT s.run_id, g.sentence_id, g.word_idx, g.word, g.gold, coalesce(k.pred, 'O') AS pred, k.pred IS NULL AS truncated
    FROM gold g JOIN seen s USING (sentence_id) LEFT JOIN kept k ON k.run_id = s.run_id AND k.sentence_id = g.sentence_id AND k.word_idx = g.word_idx""",
)
def truncation_restore(spark, sf_dir):
    """Predictions of the first twelve words of each sentence, completed from the gold words."""
    w = words(spark, sf_dir)
    gold = w.groupBy("sentence_id", "word_idx").agg(F.min("word").alias("word"), F.min("gold").alias("gold"))
    return C.restore_truncated(gold, w.filter("word_idx < 12"))


#: Types of the test data to coarser ones.
MAPPING = {"PERSON": "PER", "LOCATION": "LOC", "GPE": "LOC", "FACILITY": "LOC", "ORGANISATION": "ORG", "CARDINAL": "O", "DATE": "O", "EVENT": "O", "PROJECT": "O", "LAW": "O"}


def _mapped_sql(column: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MAPPING.items())
    return f"CASE WHEN {column} = 'O' THEN 'O' WHEN (CASE substr({column}, 3) {cases} END) = 'O' THEN 'O' ELSE left({column}, 2) || (CASE substr({column}, 3) {cases} END) END"


@CORE.register(
    "label_map_scores",
    f"WITH {sql.CONTRACT}, mapped AS (SELECT run_id, sentence_id, word_idx, word, {_mapped_sql('gold')} AS gold, {_mapped_sql('pred')} AS pred FROM contract), {sql.spans('mapped')}, {sql.prf()} SELECT * FROM prf",
)
def label_map_scores(spark, sf_dir):
    w = words(spark, sf_dir)
    return S.prf(w.withColumns({"gold": tags.map_tag("gold", MAPPING), "pred": tags.map_tag("pred", MAPPING)}))


@CORE.register(
    "restrict_types_scores",
    f"""WITH {sql.CONTRACT}, kept AS (SELECT run_id, sentence_id, word_idx, word, CASE WHEN substr(gold, 3) IN ('PERSON', 'GPE') THEN gold ELSE 'O' END AS gold,
    CASE WHEN substr(pred, 3) IN ('PERSON', 'GPE') THEN pred ELSE 'O' END AS pred FROM contract), {sql.spans("kept")}, {sql.prf("run_id")} SELECT * FROM prf""",
)
def restrict_types_scores(spark, sf_dir):
    w, types = words(spark, sf_dir), ["PERSON", "GPE"]
    return S.prf(w.withColumns({"gold": tags.restrict_tag("gold", types), "pred": tags.restrict_tag("pred", types)}), ["run_id"])


@CORE.register("unmapped_types", f"""WITH {sql.CONTRACT} SELECT DISTINCT t AS etype FROM (SELECT substr(gold, 3) AS t FROM contract UNION ALL SELECT substr(pred, 3) FROM contract) WHERE t <> '' AND t NOT IN ('PERSON', 'LOCATION')""")
def unmapped_types(spark, sf_dir):
    return C.unmapped_types(words(spark, sf_dir), {"PERSON": "PER", "LOCATION": "LOC"})


@CORE.register("label_ids", "WITH l AS (SELECT DISTINCT gold AS label FROM predictions JOIN (SELECT DISTINCT sentence_id FROM sentences WHERE lower(trim(split)) = 'train') USING (sentence_id) WHERE gold IS NOT NULL) SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS id FROM l")
def label_ids(spark, sf_dir):
    train = sp.sentence_splits(table(spark, sf_dir, "sentences")).filter("split = 'train'").select("sentence_id")
    return C.label_ids(table(spark, sf_dir, "predictions").join(train, "sentence_id", "left_semi"), "gold")


@CORE.register("run_fingerprints")
def run_fingerprints(spark, sf_dir):
    return C.fingerprints(words(spark, sf_dir))


@CORE.register("prf_by_split", f"""WITH {sql.CONTRACT}, {sql.SPLITS}, {sql.spans()}, placed AS (SELECT m.*, s.split FROM matched m JOIN splits s USING (sentence_id)), {sql.prf("split", "placed")} SELECT * FROM prf""")
def prf_by_split(spark, sf_dir):
    w = words(spark, sf_dir).join(sp.sentence_splits(table(spark, sf_dir, "sentences")).select("sentence_id", "split"), "sentence_id")
    return S.prf(w, ["split"])
