"""SQL shared by the queries' counterparts."""

from spanframe.stats.resample import PLACES, PRIME, poisson_steps

CONTRACT = """contract AS (
  SELECT run_id, sentence_id, word_idx, x.word AS word, coalesce(x.gold, 'O') AS gold, coalesce(x.pred, 'O') AS pred, coalesce(x.truncated, false) AS truncated
  FROM (SELECT run_id, sentence_id, word_idx, arg_max({'word': word, 'gold': gold, 'pred': pred, 'truncated': truncated}, loaded_at) AS x FROM predictions GROUP BY ALL)
)"""

SPLITS = """splits AS (
  SELECT sentence_id, min(CASE lower(trim(split)) WHEN 'train' THEN 'train' WHEN 'test' THEN 'test' WHEN 'validation' THEN 'validation' WHEN 'valid' THEN 'validation' WHEN 'dev' THEN 'validation' END) AS split,
    min(source) AS source FROM sentences GROUP BY sentence_id
)"""


def spans(words: str = "contract", keys: str = "run_id, sentence_id", gold: str = "gold", pred: str = "pred") -> str:
    """CTEs from words to ``spans`` (both sides) and ``matched``."""
    return f"""tagged AS (
  SELECT {keys}, word_idx, word, 'gold' AS side, {gold} AS tag FROM {words} UNION ALL SELECT {keys}, word_idx, word, 'pred', {pred} FROM {words}
), lagged AS (
  SELECT *, lag(tag) OVER (PARTITION BY {keys}, side ORDER BY word_idx) AS prev FROM tagged
), numbered AS (
  SELECT *, sum(CASE WHEN tag <> 'O' AND (tag LIKE 'B-%' OR prev IS NULL OR prev = 'O' OR substr(prev, 3) <> substr(tag, 3)) THEN 1 ELSE 0 END)
    OVER (PARTITION BY {keys}, side ORDER BY word_idx) AS n FROM lagged
), spans AS (
  SELECT {keys}, side, substr(tag, 3) AS etype, n, min(word_idx) AS "start", max(word_idx) + 1 AS "end", string_agg(word, ' ' ORDER BY word_idx) AS text
  FROM numbered WHERE tag <> 'O' GROUP BY {keys}, side, substr(tag, 3), n
), matched AS (
  SELECT {keys}, etype, "start", "end", bool_or(side = 'gold') AS in_gold, bool_or(side = 'pred') AS in_pred FROM spans GROUP BY {keys}, etype, "start", "end"
)"""


def prf(by: str = "", matched: str = "matched") -> str:
    """A CTE ``prf`` of scores by type and micro."""
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""per_type AS (
  SELECT {key}etype, count(*) FILTER (WHERE in_gold AND in_pred) AS n_correct, count(*) FILTER (WHERE in_pred) AS n_pred, count(*) FILTER (WHERE in_gold) AS n_gold FROM {matched} GROUP BY {key}etype
), both_levels AS (
  SELECT {key}etype, n_correct, n_pred, n_gold FROM per_type
  UNION ALL SELECT {key}'micro', sum(n_correct)::BIGINT, sum(n_pred)::BIGINT, sum(n_gold)::BIGINT FROM per_type {group}
), prf AS (
  SELECT {key}etype, n_gold AS support, n_pred, n_correct, coalesce(n_correct::DOUBLE / nullif(n_pred, 0), 0) AS "precision",
    coalesce(n_correct::DOUBLE / nullif(n_gold, 0), 0) AS recall, coalesce((2 * n_correct)::DOUBLE / nullif(n_pred + n_gold, 0), 0) AS f1 FROM both_levels
)"""


def _steps(u: str) -> str:
    return " + ".join(f"({u} > {step!r})::INT" for step in poisson_steps())


def uniform(key: str, rep: str, seed: int) -> str:
    """The number in (0, 1) of :func:`spanframe.stats.resample.with_uniform`; ``key`` isn't negative."""
    p = PRIME
    own = f"({key} % {p})"
    first = f"(({own} * 48271 + {rep} * 69621 + {seed} * 16807) % {p})"
    second = f"list_transform([{first}], lambda x: (x * x + x * 12345 + {rep}) % {p})"
    return f"(list_transform({second}, lambda x: (x * x + x * 6789 + {own}) % {p})[1] + 0.5) / {float(p)!r}"


def weights(ids: str, replicates: int, seed: int) -> str:
    """A CTE ``weights(sentence_id, rep, w)`` over the ``sentence_id`` column of ``ids``."""
    return f"""weights AS (SELECT sentence_id, rep, CASE WHEN rep = 0 THEN 1 ELSE {_steps("u")} END AS w FROM (
      SELECT sentence_id, rep, {uniform("sentence_id", "rep", seed)} AS u FROM (SELECT sentence_id::BIGINT AS sentence_id, unnest(range({replicates + 1})) AS rep FROM (SELECT DISTINCT sentence_id FROM {ids}))))"""


def summary(by: str, value: str, name: str, source: str) -> str:
    """Replicate 0, interval and two-sided p of the others, rounded."""
    v, others = f"round({value}, {PLACES})", "FILTER (WHERE rep > 0)"
    tail = f"least((1 + count(*) FILTER (WHERE rep > 0 AND {v} <= 0))::DOUBLE / (1 + count({value}) {others}), (1 + count(*) FILTER (WHERE rep > 0 AND {v} >= 0))::DOUBLE / (1 + count({value}) {others}))"
    keys = f"{by}, " if by else ""
    return f"""SELECT {keys}max({value}) FILTER (WHERE rep = 0) AS {name}, quantile_cont({v}, 0.025) {others} AS low, quantile_cont({v}, 0.975) {others} AS high, least(1.0, 2 * {tail}) AS p FROM {source} {"GROUP BY " + by if by else ""}"""
