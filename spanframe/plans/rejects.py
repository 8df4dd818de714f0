"""Queries of problem 4: rows that fail to parse."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe.operators import rejects
from spanframe.plans.registry import CORE
from spanframe.session import table

_PARSED = r"""
WITH base AS (
  SELECT line_id, file_name, line_no, regexp_replace(raw, '\r$', '') AS body FROM contract_raw
), headers AS (
  SELECT file_name, string_split(min(body), ',') AS header FROM base WHERE line_no = 1 GROUP BY file_name
), lines AS (
  SELECT b.line_id, b.file_name, b.body, h.header,
         regexp_full_match(b.body, '(?s)(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') AS ok
  FROM base b LEFT JOIN headers h USING (file_name)
  WHERE b.line_no <> 1 AND trim(b.body, ' ' || chr(9) || chr(13) || chr(10)) <> ''
), parsed AS (
  SELECT *, CASE WHEN ok THEN list_transform(regexp_extract_all(body || ',', '(?s)("(?:[^"]|"")*"|[^",]*),', 1),
    lambda c: CASE WHEN starts_with(c, '"') THEN replace(substr(c, 2, length(c) - 2), '""', '"') ELSE c END) END AS cells
  FROM lines
), judged AS (
  SELECT *, header[1:] AS h,
    cells[list_position(header, 'sentence_id')] AS c_sid, cells[list_position(header, 'word_idx')] AS c_idx,
    cells[list_position(header, 'word')] AS c_word, cells[list_position(header, 'gold')] AS c_gold,
    cells[list_position(header, 'pred')] AS c_pred,
    CASE WHEN list_contains(header, 'truncated') THEN cells[list_position(header, 'truncated')] END AS c_trunc
  FROM parsed
), reasons AS (
  SELECT *, CASE
    WHEN NOT ok THEN 'quoting'
    WHEN len(cells) <> len(header) THEN 'field_count'
    WHEN c_sid = '' OR c_idx = '' OR c_word = '' OR c_gold = '' OR c_pred = '' THEN 'empty'
    WHEN NOT regexp_full_match(c_sid, '[0-9]+') OR NOT regexp_full_match(c_idx, '[0-9]+') THEN 'integer'
    WHEN NOT regexp_full_match(c_gold, 'O|[BI]-\S+') THEN 'gold'
    WHEN NOT regexp_full_match(c_pred, 'O|[BI]-\S+') THEN 'pred'
    WHEN c_trunc IS NOT NULL AND NOT regexp_full_match(c_trunc, '[01]?') THEN 'truncated' END AS reason
  FROM judged
)
"""


@CORE.register("p4_found", _PARSED + "SELECT line_id, reason FROM reasons WHERE reason IS NOT NULL")
def p4_found(spark, sf_dir):
    return rejects.faulty_lines(table(spark, sf_dir, "contract_raw"))


@CORE.register(
    "p4_clean_rows",
    _PARSED
    + """SELECT line_id, file_name, c_sid::BIGINT AS sentence_id, c_idx::INT AS word_idx, c_word AS word, c_gold AS gold,
    c_pred AS pred, coalesce(c_trunc = '1', false) AS truncated FROM reasons WHERE reason IS NULL""",
)
def p4_clean_rows(spark, sf_dir):
    return rejects.clean_rows(table(spark, sf_dir, "contract_raw"))


@CORE.register("p4_reasons", _PARSED + "SELECT reason, count(*) AS lines FROM reasons WHERE reason IS NOT NULL GROUP BY reason")
def p4_reasons(spark, sf_dir):
    found = rejects.faulty_lines(table(spark, sf_dir, "contract_raw"))
    return found.groupBy("reason").agg(F.count("*").alias("lines"))
