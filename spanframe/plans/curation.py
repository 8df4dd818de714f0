"""Queries: curation of documents into lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe.functions import text as X
from spanframe.operators import curation as Q
from spanframe.plans.registry import CORE
from spanframe.session import spread, table

ORDER = ["doc_id", "line_no"]
_SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{000B}\x{001C}-\x{001F}\x{0085}]+"
_BREAK = r"\r\n|[\n\r\x{000B}\x{000C}\x{001C}-\x{001E}\x{0085}\x{2028}\x{2029}]"

LINES = f"""raw_lines AS (
  SELECT doc_id, unnest(l) AS raw, unnest(range(len(l)))::INT AS line_no FROM (
    SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc_id, regexp_split_to_array(text, '{_BREAK}') AS l FROM documents WHERE text <> ''))
), lines AS (
  SELECT doc_id, line_no, trim(regexp_replace(nfc_normalize(raw), '{_SPACE}', ' ', 'g'), ' ') AS line FROM raw_lines WHERE trim(regexp_replace(nfc_normalize(raw), '{_SPACE}', ' ', 'g'), ' ') <> ''
), ruled AS (
  SELECT *, len(string_split(line, ' ')) AS n,
    length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(line, '[^\\x{{0400}}-\\x{{04FF}}]', '', 'g')) - length(regexp_replace(line, '[^\\x{{0482}}-\\x{{0489}}]', '', 'g')) AS cyr FROM lines
), first_rule AS (
  SELECT *, CASE WHEN n < 5 THEN 'too_short' WHEN n > 500 THEN 'too_long'
    WHEN NOT (letters > 0 AND cyr * 2 >= letters AND regexp_matches(line, '[әғқңөұүһіӘҒҚҢӨҰҮҺІ]')) THEN 'not_kazakh' END AS rule FROM ruled
), numbered AS (
  SELECT *, CASE WHEN rule IS NULL THEN row_number() OVER (PARTITION BY rule IS NULL, line ORDER BY doc_id, line_no) END AS copy FROM first_rule
), idx AS (
  SELECT DISTINCT regexp_extract_all(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+') AS iw FROM eval_items
), heads AS (
  SELECT iw, iw[1:6] AS head FROM idx WHERE len(iw) >= 6
), cand AS (
  SELECT DISTINCT line, regexp_extract_all(replace(lower(line), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+') AS w FROM numbered WHERE rule IS NULL
), wins AS (
  SELECT line, w, unnest(range(1, len(w) - 4)) AS i FROM cand WHERE len(w) >= 6
), bad AS (
  SELECT DISTINCT line FROM wins JOIN heads ON w[i:i + 5] = head WHERE w[i:i + len(iw) - 1] = iw
), staged AS (
  SELECT n.doc_id, n.line_no, n.line, n.n, coalesce(rule, CASE WHEN copy > 1 THEN 'duplicate' WHEN b.line IS NOT NULL THEN 'contaminated' ELSE 'kept' END) AS stage
  FROM numbered n LEFT JOIN bad b ON b.line = n.line
)"""


def _lines(spark, sf_dir):
    return Q.document_lines(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"])


def staged(spark, sf_dir, only):
    """The lines of one stage, with their text."""
    return Q.staged_lines(_lines(spark, sf_dir), ORDER, table(spark, sf_dir, "eval_items"), only=only)


def stages(spark, sf_dir):
    """Place, word count and stage of every line."""
    return Q.line_stages(_lines(spark, sf_dir), ORDER, table(spark, sf_dir, "eval_items"))


@CORE.register("normalized_lines", f"WITH {LINES} SELECT doc_id, line_no, line FROM lines")
def normalized_lines(spark, sf_dir):
    return _lines(spark, sf_dir)


@CORE.register("line_stages", f"WITH {LINES} SELECT stage, count(*) AS lines, sum(n)::BIGINT AS words FROM staged GROUP BY stage UNION ALL SELECT 'lines', count(*), sum(n)::BIGINT FROM staged")
def line_stages(spark, sf_dir):
    return Q.stage_counts(stages(spark, sf_dir))


@CORE.register("line_dedup_first", f"WITH {LINES} SELECT doc_id, line_no, line FROM numbered WHERE copy = 1")
def line_dedup_first(spark, sf_dir):
    return Q.staged_lines(_lines(spark, sf_dir), ORDER, only="kept").select("doc_id", "line_no", "line")


@CORE.register("decontaminate_6gram", f"WITH {LINES} SELECT doc_id, line_no, line FROM staged WHERE stage = 'contaminated'")
def decontaminate_6gram(spark, sf_dir):
    return staged(spark, sf_dir, "contaminated").select("doc_id", "line_no", "line")


_BUDGET = 20_000


@CORE.register(
    "corpus_stop_rule",
    f"""WITH {LINES}, summed AS (SELECT *, coalesce(sum(CASE WHEN stage = 'kept' THEN n ELSE 0 END) OVER (ORDER BY doc_id, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM staged)
    SELECT stage, count(*) AS lines, sum(n)::BIGINT AS words FROM summed WHERE before < {_BUDGET} GROUP BY stage UNION ALL SELECT 'lines', count(*), sum(n)::BIGINT FROM summed WHERE before < {_BUDGET}""",
)
def corpus_stop_rule(spark, sf_dir):
    """Stage counts of the lines that a budget of words needs."""
    return Q.stage_counts(Q.until_budget(stages(spark, sf_dir), _BUDGET, ORDER))


@CORE.register(
    "row_groups_used",
    f"""WITH {LINES}, summed AS (SELECT *, coalesce(sum(CASE WHEN stage = 'kept' THEN n ELSE 0 END) OVER (ORDER BY doc_id, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM staged)
    SELECT file_name, row_group, count(DISTINCT doc_id) AS docs FROM summed JOIN documents USING (doc_id) WHERE before < {_BUDGET} GROUP BY ALL""",
)
def row_groups_used(spark, sf_dir):
    """Documents of each row group that were read before the word budget was met."""
    read = Q.until_budget(stages(spark, sf_dir), _BUDGET, ORDER).select("doc_id").distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", "file_name", "row_group").join(read, "doc_id", "left_semi")
    return docs.groupBy("file_name", "row_group").agg(F.count("*").alias("docs"))


@CORE.register("script_share", r"""SELECT doc_id, round(length(regexp_replace(text, '[^\x{0400}-\x{0481}\x{048A}-\x{04FF}]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(text, '[^\p{L}]', '', 'g')), 0), 9) AS share FROM documents""")
def script_share(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(X.script_share("text", X.CYRILLIC), 9).alias("share"))


@CORE.register("row_group_docs", "SELECT file_name, row_group, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ALL")
def row_group_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("file_name", "row_group").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


@CORE.register("seeded_row_groups")
def seeded_row_groups(spark, sf_dir):
    """Documents in the order of a seeded permutation of the row groups."""
    docs = table(spark, sf_dir, "documents")
    order = Q.seeded_group_order(docs, 42)
    return docs.select("doc_id", "file_name", "row_group").join(F.broadcast(order), ["file_name", "row_group"]).select("rank", "doc_id")
