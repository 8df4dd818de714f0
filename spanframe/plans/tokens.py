"""Queries: sampling, tokenizer analytics, word and entity tables, strata."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe.functions import tags
from spanframe.functions import wordpiece as WP
from spanframe.operators import contract as C
from spanframe.operators import fertility as Fe
from spanframe.operators import sampling as Sa
from spanframe.operators import spans as S
from spanframe.operators import splits as sp
from spanframe.operators import tables as Tb
from spanframe.plans import sql
from spanframe.plans.registry import CORE
from spanframe.session import stored, table

#: One row per sentence and word, any run: spelling without stray blanks.
_CLEAN = "trim(x.word, ' ' || chr(9) || chr(160))"
WORDS = f"""{sql.CONTRACT}, {sql.SPLITS}, words AS (
  SELECT c.sentence_id, s.split, c.word_idx, min(trim(nfc_normalize(c.word), ' ' || chr(9) || chr(160))) AS word, min(c.gold) AS gold
  FROM contract c JOIN splits s USING (sentence_id) WHERE s.split IS NOT NULL GROUP BY ALL
), pieces AS (
  SELECT DISTINCT word, greatest(ceil(length(word) / 4.0), 1)::INT AS n_pieces, false AS unk FROM words
)"""


def split_words(spark, sf_dir):
    """``sentence_id, split, word_idx, word, gold``: the corpus behind the predictions."""
    from spanframe.functions.text import nfc

    splits = sp.sentence_splits(table(spark, sf_dir, "sentences")).filter("split is not null").select("sentence_id", "split")
    clean = C.latest(table(spark, sf_dir, "predictions"), ("sentence_id",)).select("sentence_id", "word_idx", F.trim(nfc("word"), F.lit(" \t\xa0")).alias("word"), "gold")
    one = clean.groupBy("sentence_id", "word_idx").agg(F.min("word").alias("word"), F.min("gold").alias("gold"))
    return one.join(splits, "sentence_id")


def test_contract(spark, sf_dir):
    """The last loads of the test sentences, placed by sentence: the other sentences' rows never move."""
    test = sp.sentence_splits(table(spark, sf_dir, "sentences")).filter("split = 'test'").select("sentence_id")
    return C.latest(table(spark, sf_dir, "predictions").join(test, "sentence_id", "left_semi"), ("sentence_id",))


def pieces_of(words):
    return WP.piece_table(words, WP.fixed_width_pieces)


@CORE.register(
    "fertility_by_split",
    f"""WITH {WORDS}, w AS (SELECT split, n_pieces AS p FROM words JOIN pieces USING (word))
    SELECT split, count(*) AS words, sum(p)::BIGINT AS subwords, round(avg(p), 8) AS mean, count(*) FILTER (WHERE p = 1)::BIGINT AS single_words, count(*) FILTER (WHERE p > 1)::BIGINT AS split_words,
      round(count(*) FILTER (WHERE p > 1)::DOUBLE / count(*), 8) AS split_rate, round(coalesce(avg(p) FILTER (WHERE p > 1), 0), 8) AS mean_of_split, median(p) AS median, round(stddev_pop(p), 8) AS sd,
      max(p) AS max_pieces, 0::BIGINT AS unknown, 0.0::DOUBLE AS unknown_rate FROM w GROUP BY GROUPING SETS ((split), ())""",
)
def fertility_by_split(spark, sf_dir):
    w = split_words(spark, sf_dir)
    counted = Fe.word_counts(w, ["split"])
    out = Fe.fertility(counted, pieces_of(counted), "split")
    return out.withColumns({c: F.round(c, 8) for c in ("mean", "split_rate", "mean_of_split", "sd")})


@CORE.register(
    "fertility_by_lang",
    """WITH w AS (SELECT coalesce(lang, 'none') AS lang, unnest(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS word FROM documents), p AS (SELECT lang, ceil(length(word) / 4.0)::INT AS p FROM w)
    SELECT lang, count(*) AS words, sum(p)::BIGINT AS subwords, round(avg(p), 8) AS mean, median(p) AS median, max(p) AS max_pieces FROM p GROUP BY GROUPING SETS ((lang), ())""",
)
def fertility_by_lang(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = docs.select(F.coalesce("lang", F.lit("none")).alias("lang"), F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t\r\n]+"), F.lit(0))).alias("word"))
    counted = Fe.word_counts(words, ["lang"])
    out = Fe.fertility(counted, pieces_of(counted), "lang")
    return out.select("lang", "words", "subwords", F.round("mean", 8).alias("mean"), "median", "max_pieces")


@CORE.register(
    "piece_overlap_splits",
    f"""WITH {WORDS}, each_word AS (SELECT split, word, count(*) AS n FROM words GROUP BY ALL), exploded AS (
      SELECT split, word, n, unnest(list_transform(range(greatest(ceil(length(word) / 4.0), 1)::INT), lambda i: CASE WHEN i > 0 THEN '##' ELSE '' END || substr(word, i * 4 + 1, 4))) AS piece FROM each_word
    ), src AS (SELECT DISTINCT piece FROM exploded WHERE split = 'train'), tgt AS (SELECT e.*, s.piece IS NOT NULL AS shared FROM exploded e LEFT JOIN src s USING (piece) WHERE split = 'test'),
    by_piece AS (SELECT piece, shared, sum(n) AS n FROM tgt GROUP BY ALL), cov AS (SELECT word, max(n) AS n, bool_and(shared) AS covered FROM tgt GROUP BY word),
    w AS (SELECT c.*, c.word IN (SELECT word FROM words WHERE split = 'train') AS known FROM cov c)
    SELECT (SELECT sum(n)::BIGINT FROM w) AS words, (SELECT count(*) FROM w) AS word_types, (SELECT sum(n)::BIGINT FROM by_piece) AS piece_tokens, (SELECT count(*) FROM by_piece) AS piece_types,
      round((SELECT 100 * count(*) FILTER (WHERE shared)::DOUBLE / count(*) FROM by_piece), 8) AS shared_piece_types, round((SELECT 100 * (sum(n) FILTER (WHERE shared))::DOUBLE / sum(n) FROM by_piece), 8) AS shared_piece_tokens,
      round((SELECT 100 * (sum(n) FILTER (WHERE covered))::DOUBLE / sum(n) FROM w), 8) AS covered_words, round((SELECT 100 * count(*) FILTER (WHERE known)::DOUBLE / count(*) FROM w), 8) AS word_types_in_source""",
)
def piece_overlap_splits(spark, sf_dir):
    # read several times: made once
    w = stored(split_words(spark, sf_dir).select("split", "word"))
    out = Fe.piece_overlap(w.filter("split = 'train'"), w.filter("split = 'test'"), WP.fixed_width_pieces)
    return out.withColumns({c: F.round(c, 8) for c in ("shared_piece_types", "shared_piece_tokens", "covered_words", "word_types_in_source")})


@CORE.register("topk_pieces", f"""WITH {WORDS}, e AS (SELECT unnest(list_transform(range(greatest(ceil(length(word) / 4.0), 1)::INT), lambda i: CASE WHEN i > 0 THEN '##' ELSE '' END || substr(word, i * 4 + 1, 4))) AS piece FROM words WHERE split = 'train')
    SELECT piece, count(*) AS n FROM e GROUP BY piece ORDER BY n DESC, piece LIMIT 200""")
def topk_pieces(spark, sf_dir):
    counted = Fe.word_counts(split_words(spark, sf_dir).filter("split = 'train'"), [])
    usage = Fe.usage_counts(counted, pieces_of(counted))
    return Fe.top_candidates(usage.withColumn("skip", F.lit(None).cast("string")), 200)


@CORE.register("piece_usage", f"""WITH {WORDS}, e AS (SELECT split, unnest(list_transform(range(greatest(ceil(length(word) / 4.0), 1)::INT), lambda i: CASE WHEN i > 0 THEN '##' ELSE '' END || substr(word, i * 4 + 1, 4))) AS piece FROM words),
    new_pieces AS (SELECT DISTINCT piece FROM e WHERE split <> 'train'), usage AS (SELECT piece, count(*) AS n FROM e WHERE split = 'train' GROUP BY piece), u AS (SELECT coalesce(n, 0) AS n FROM new_pieces LEFT JOIN usage USING (piece))
    SELECT count(*) AS pieces, min(n) AS least, quantile_cont(n, 0.1) AS p10, quantile_cont(n, 0.5) AS median, count(*) FILTER (WHERE n < 100) AS below_100, count(*) FILTER (WHERE n = 0) AS unused FROM u""")
def piece_usage(spark, sf_dir):
    w = split_words(spark, sf_dir)
    counted, other = Fe.word_counts(w.filter("split = 'train'"), []), Fe.word_counts(w.filter("split <> 'train'"), [])
    new = pieces_of(other).select(F.explode("pieces").alias("piece")).distinct()
    return Fe.piece_usage(new, Fe.usage_counts(counted, pieces_of(counted)))


_FREQ = "freq AS (SELECT word, count(*) AS freq FROM words WHERE split = 'train' GROUP BY word)"
_WORD_TABLE = f"""{WORDS}, {_FREQ}, word_table AS (
  SELECT w.sentence_id, w.word_idx, w.word, w.gold, p.n_pieces AS pieces, p.unk, length(w.word)::INT AS chars, coalesce(f.freq, 0) AS freq, CASE WHEN gold = 'O' THEN '' ELSE substr(w.gold, 3) END AS etype,
    w.gold <> 'O' AS is_entity, w.gold LIKE 'B-%' AS is_begin, CASE WHEN p.n_pieces >= 5 THEN '5+' ELSE p.n_pieces::VARCHAR END AS piece_bin, CASE WHEN f.freq IS NULL THEN 'unseen' WHEN f.freq < 5 THEN '1-4' ELSE '5+' END AS freq_bin
  FROM words w JOIN pieces p USING (word) LEFT JOIN freq f USING (word) WHERE w.split = 'test'
)"""


def word_table_of(spark, sf_dir):
    w = split_words(spark, sf_dir)
    return Tb.word_table(w.filter("split = 'test'"), pieces_of(w), w.filter("split = 'train'"))


@CORE.register("word_table", f"WITH {_WORD_TABLE} SELECT * FROM word_table")
def word_table(spark, sf_dir):
    return word_table_of(spark, sf_dir)


_ENTITIES = f"""{WORDS}, sided AS (SELECT sentence_id, split, word_idx, word, gold, 'O' AS pred FROM words), {sql.spans("sided", "sentence_id, split")}, bounds AS (SELECT * FROM spans WHERE side = 'gold'),
known AS (SELECT DISTINCT text, etype FROM bounds WHERE split = 'train'), entities AS (
  SELECT b.sentence_id, b."start", b."end", b.etype, b.text, count(*)::INT AS n_words, avg(p.n_pieces) AS mean_pieces, max(p.n_pieces) AS max_pieces, false AS has_unk, k.text IS NOT NULL AS seen,
    CASE WHEN avg(p.n_pieces) <= 1 THEN '1.0' WHEN avg(p.n_pieces) <= 2 THEN '(1,2]' WHEN avg(p.n_pieces) <= 3 THEN '(2,3]' ELSE '>3' END AS fertility_bin
  FROM bounds b JOIN words w ON w.sentence_id = b.sentence_id AND w.word_idx >= b."start" AND w.word_idx < b."end" JOIN pieces p USING (word) LEFT JOIN known k ON k.text = b.text AND k.etype = b.etype
  WHERE b.split = 'test' GROUP BY ALL
)"""


def entities_of(spark, sf_dir):
    w = stored(split_words(spark, sf_dir))
    return Tb.entity_table(w.filter("split = 'test'"), pieces_of(w), Tb.training_entities(w.filter("split = 'train'"), ["sentence_id"]))


@CORE.register("entity_table", f"WITH {_ENTITIES} SELECT * REPLACE (round(mean_pieces, 8) AS mean_pieces) FROM entities")
def entity_table(spark, sf_dir):
    return entities_of(spark, sf_dir).withColumn("mean_pieces", F.round("mean_pieces", 8))


@CORE.register("training_entities", f"WITH {WORDS}, sided AS (SELECT sentence_id, split, word_idx, word, gold, 'O' AS pred FROM words WHERE split = 'train'), {sql.spans('sided', 'sentence_id, split')} SELECT text, etype, count(*) AS n FROM spans GROUP BY ALL")
def training_entities(spark, sf_dir):
    return Tb.training_entities(split_words(spark, sf_dir).filter("split = 'train'"), ["sentence_id"])


@CORE.register(
    "error_by_pieces",
    f"""WITH {_WORD_TABLE}, r AS (SELECT c.run_id, w.piece_bin, avg((c.gold <> c.pred)::INT) AS rate, count(*) AS n FROM contract c JOIN word_table w USING (sentence_id, word_idx) WHERE w.is_entity GROUP BY ALL)
    SELECT piece_bin, round(avg(rate), 8) AS mean, round(stddev_samp(rate), 8) AS sd, max(n) AS n, count(*) AS runs FROM r GROUP BY piece_bin""",
)
def error_by_pieces(spark, sf_dir):
    errors = _word_errors(spark, sf_dir).filter("is_entity")
    return _rounded(Tb.run_strata(errors, "run_id", ["piece_bin"], "error"))


@CORE.register(
    "error_strata",
    f"""WITH {_WORD_TABLE}, r AS (SELECT c.run_id, w.freq_bin, w.piece_bin, avg((c.gold <> c.pred)::INT) AS rate, count(*) AS n FROM contract c JOIN word_table w USING (sentence_id, word_idx) WHERE w.is_entity GROUP BY ALL)
    SELECT freq_bin, piece_bin, round(avg(rate), 8) AS mean, round(stddev_samp(rate), 8) AS sd, max(n) AS n, count(*) AS runs FROM r GROUP BY ALL HAVING max(n) >= 3""",
)
def error_strata(spark, sf_dir):
    errors = _word_errors(spark, sf_dir).filter("is_entity")
    return _rounded(Tb.run_strata(errors, "run_id", ["freq_bin", "piece_bin"], "error", least=3))


def _word_errors(spark, sf_dir):
    preds = test_contract(spark, sf_dir).select("run_id", "sentence_id", "word_idx", (F.col("gold") != F.col("pred")).cast("int").alias("error"))
    return preds.join(word_table_of(spark, sf_dir).select("sentence_id", "word_idx", "piece_bin", "freq_bin", "is_entity"), ["sentence_id", "word_idx"])


def _rounded(df):
    return df.withColumns({"mean": F.round("mean", 8), "sd": F.round("sd", 8)})


_HITS = f"""{_ENTITIES}, pred_spans AS (
  SELECT DISTINCT run_id, sentence_id, etype, "start", "end" FROM (
    SELECT run_id, sentence_id, substr(tag, 3) AS etype, n, min(word_idx) AS "start", max(word_idx) + 1 AS "end" FROM (
      SELECT *, sum(CASE WHEN tag <> 'O' AND (tag LIKE 'B-%' OR prev IS NULL OR prev = 'O' OR substr(prev, 3) <> substr(tag, 3)) THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, sentence_id ORDER BY word_idx) AS n
      FROM (SELECT run_id, sentence_id, word_idx, pred AS tag, lag(pred) OVER (PARTITION BY run_id, sentence_id ORDER BY word_idx) AS prev FROM contract)) WHERE tag <> 'O' GROUP BY ALL)
), hits AS (
  SELECT r.run_id, e.*, p.run_id IS NOT NULL AS hit FROM entities e JOIN (SELECT DISTINCT run_id, sentence_id FROM contract) r USING (sentence_id)
  LEFT JOIN pred_spans p ON p.run_id = r.run_id AND p.sentence_id = e.sentence_id AND p.etype = e.etype AND p."start" = e."start" AND p."end" = e."end"
)"""


def hits_of(spark, sf_dir):
    """``run_id`` and the entity columns with ``hit``, for every run that has the sentence."""
    w = test_contract(spark, sf_dir)
    found = S.side_spans(w, S.SENTENCE, {"pred": "pred"}).select("run_id", "sentence_id", "etype", "start", "end").withColumn("found", F.lit(True))
    runs = w.select("run_id", "sentence_id").distinct()
    return entities_of(spark, sf_dir).join(runs, "sentence_id").join(found, ["run_id", "sentence_id", "etype", "start", "end"], "left").withColumn("hit", F.coalesce("found", F.lit(False))).drop("found")


@CORE.register("entity_hits", f'WITH {_HITS} SELECT run_id, sentence_id, "start", "end", etype, hit FROM hits')
def entity_hits(spark, sf_dir):
    return hits_of(spark, sf_dir).select("run_id", "sentence_id", "start", "end", "etype", "hit")


@CORE.register(
    "recall_by_fertility",
    f"""WITH {_HITS}, r AS (SELECT run_id, seen, fertility_bin, avg(hit::INT) AS rate, count(*) AS n FROM hits GROUP BY ALL)
    SELECT seen, fertility_bin, round(avg(rate), 8) AS mean, round(stddev_samp(rate), 8) AS sd, max(n) AS n, count(*) AS runs FROM r GROUP BY ALL HAVING max(n) >= 3""",
)
def recall_by_fertility(spark, sf_dir):
    return _rounded(Tb.run_strata(hits_of(spark, sf_dir).withColumn("hit", F.col("hit").cast("int")), "run_id", ["seen", "fertility_bin"], "hit", least=3))


@CORE.register(
    "subset_recall",
    f"""WITH {_HITS}, s AS (SELECT run_id, hit, unnest(list_filter([CASE WHEN NOT seen AND mean_pieces > 3 THEN 'primary' END, CASE WHEN NOT seen AND mean_pieces <= 2 THEN 'specificity' END, CASE WHEN seen THEN 'negative_control' END], lambda x: x IS NOT NULL)) AS subset FROM hits)
    SELECT run_id, subset, count(*) AS entities, count(*) FILTER (WHERE hit) AS hits FROM s GROUP BY ALL""",
)
def subset_recall(spark, sf_dir):
    h = hits_of(spark, sf_dir)
    each = h.withColumn("subset", F.explode(tags.subset_names(F.col("seen"), F.col("mean_pieces"), F.col("has_unk"))))
    return each.groupBy("run_id", "subset").agg(F.count("*").alias("entities"), F.count_if("hit").alias("hits"))


@CORE.register(
    "recall_by_pieces_all_bins",
    f"""WITH {_HITS}, b AS (SELECT unnest(['1.0', '(1,2]', '(2,3]', '>3']) AS fertility_bin), c AS (SELECT fertility_bin, count(*) AS n, avg(hit::INT) AS recall FROM hits WHERE etype = 'PERSON' GROUP BY 1)
    SELECT fertility_bin, coalesce(n, 0) AS n, round(recall, 8) AS recall FROM b LEFT JOIN c USING (fertility_bin)""",
)
def recall_by_pieces_all_bins(spark, sf_dir):
    """Persons only, as its SQL; every bin comes out, empty ones with null. ``wordpiece_recall_by_bins`` is the form over all types."""
    bins = spark.createDataFrame([(b,) for b in ("1.0", "(1,2]", "(2,3]", ">3")], "fertility_bin string")
    found = hits_of(spark, sf_dir).filter("etype = 'PERSON'").groupBy("fertility_bin").agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("int")).alias("recall"))
    return bins.join(found, "fertility_bin", "left").select("fertility_bin", F.coalesce("n", F.lit(0)).alias("n"), F.round("recall", 8).alias("recall"))


@CORE.register("sample_hash_fraction", "SELECT sentence_id FROM (SELECT DISTINCT sentence_id FROM sentences) WHERE ((sentence_id % 1000003 + 42) * 2654435761) % 4294967296 < 429496729")
def sample_hash_fraction(spark, sf_dir):
    return Sa.hash_sample(table(spark, sf_dir, "sentences").select("sentence_id").distinct(), "sentence_id", 0.1, 42)


@CORE.register("sample_exact")
def sample_exact(spark, sf_dir):
    """A tenth of the train sentences by the exact seeded draw over their order of ids."""
    train = sp.sentence_splits(table(spark, sf_dir, "sentences")).filter("split = 'train'").select("sentence_id")
    return Sa.exact_sample(Sa.numbered(train, ["sentence_id"]), "ordinal", 0.1, 42)


_SENTENCE_TEXT = f"{WORDS}, texts AS (SELECT sentence_id, split, string_agg(word, ' ' ORDER BY word_idx) AS text FROM words GROUP BY ALL)"


def sentence_texts(spark, sf_dir):
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda s: s["word"]), " ")
    return split_words(spark, sf_dir).groupBy("sentence_id", "split").agg(text.alias("text"))


@CORE.register(
    "heldout_antijoin",
    f"WITH {_SENTENCE_TEXT} SELECT min(sentence_id) AS sentence_id, text FROM texts WHERE split <> 'train' AND text NOT IN (SELECT text FROM texts WHERE split = 'train') GROUP BY text",
)
def heldout_antijoin(spark, sf_dir):
    t = sentence_texts(spark, sf_dir)
    return Sa.heldout_candidates(t.filter("split <> 'train'"), t.filter("split = 'train'"), "text", "sentence_id").select("sentence_id", "text")


@CORE.register("fvt_mean_vectors", "WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings), m AS (SELECT label, pos, avg(x) AS m FROM e GROUP BY ALL) SELECT label, list(round(m, 6) ORDER BY pos) AS mean FROM m GROUP BY label")
def fvt_mean_vectors(spark, sf_dir):
    return Fe.mean_vectors(table(spark, sf_dir, "embeddings"), "label").withColumn("mean", F.transform("mean", lambda x: F.round(x, 6)))
