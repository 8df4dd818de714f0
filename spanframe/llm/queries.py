"""The pN_ queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from spanframe.llm import bpe, chunks, ngrams, overlap, sample, subjects, tiling
from spanframe.operators.splits import sentence_splits
from spanframe.plans.registry import Registry
from spanframe.session import spread, table

LLM = Registry()

#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("SPANFRAME_TOKENIZERS", "/opt/tokenizers")


def _documents(spark, sf_dir, *columns):
    """Columns of the documents; a table in fewer pieces than the session has cores is spread over them."""
    return spread(table(spark, sf_dir, "documents").select(*columns))


@LLM.register("p6_ids")
def p6_ids(spark, sf_dir):
    return bpe.encode_texts(_documents(spark, sf_dir, "doc_id", "text"), f"{TOKENIZERS}/byte_bpe_50k.json")


@LLM.register("p6_token_counts")
def p6_token_counts(spark, sf_dir):
    """Tokens and tokens per code point of the corpus by source."""
    docs = _documents(spark, sf_dir, "doc_id", "text", "source", "n_chars")
    ids = bpe.encode_texts(docs, f"{TOKENIZERS}/byte_bpe_50k.json").select("doc_id", F.size("ids").cast("long").alias("n"))
    counts = ids.join(docs.select("doc_id", "source", "n_chars"), "doc_id").groupBy("source")
    return counts.agg(F.sum("n").alias("tokens"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("chars"))


_P7_FOUND = r"""
WITH m AS (
  SELECT 'd' AS kind, doc_id AS id, lower(nfc_normalize(regexp_replace(text, '[\x{00AD}\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]', '', 'g'))) AS t FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'i', item_id, lower(nfc_normalize(regexp_replace(text, '[\x{00AD}\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]', '', 'g'))) FROM eval_items WHERE text IS NOT NULL
), w AS (SELECT kind, id, regexp_extract_all(t, '[\p{L}\p{N}_]+') AS w FROM m),
item_grams AS (SELECT DISTINCT id AS item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, least(len(w), 8) AS n, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS i FROM w WHERE kind = 'i' AND len(w) >= 6)),
doc_grams AS (SELECT id AS doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, unnest([6, 7, 8]) AS n FROM w WHERE kind = 'd') WHERE len(w) >= n))
SELECT DISTINCT doc_id, item_id FROM doc_grams JOIN item_grams USING (n, g)
"""


@LLM.register("p7_found", _P7_FOUND)
def p7_found(spark, sf_dir):
    found = tiling.find_leaks(_documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "eval_items"))
    return tiling.qualifying(found).select("doc_id", "item_id")


@LLM.register("p7_leaks")
def p7_leaks(spark, sf_dir):
    """Leaked items with the documents they stand in and how much of them is covered, reordered parts included."""
    return tiling.covering(tiling.find_leaks(_documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "eval_items"), seed=4, share=0.5))


_P2_TOKENS = r"""
WITH tokens AS (
  SELECT DISTINCT sentence_id, word_idx, lower(trim(nfc_normalize(word), ' ' || chr(9) || chr(160))) AS term
  FROM predictions WHERE word IS NOT NULL
), terms AS (
  SELECT term, count(*) AS occurrences, count(DISTINCT sentence_id) AS sentences FROM tokens WHERE term <> '' GROUP BY term
), marked AS (
  SELECT *, CASE WHEN sentences < 3 THEN 'rare'
                 WHEN sentences * 20 > (SELECT count(DISTINCT sentence_id) FROM predictions) THEN 'common' END AS mark FROM terms
)
"""


def _p2_marked(spark, sf_dir):
    predictions = table(spark, sf_dir, "predictions")
    total = predictions.select("sentence_id").filter("sentence_id is not null").distinct().count()
    counted = ngrams.ngram_counts(ngrams.prediction_tokens(predictions), max_n=1)
    return counted.select(F.col("ngram")[0].alias("term"), "occurrences", F.col("records").alias("sentences"), ngrams.mark(F.col("records"), total).alias("mark"))


@LLM.register("p2_found", _P2_TOKENS + "SELECT term, mark FROM marked WHERE mark IS NOT NULL")
def p2_found(spark, sf_dir):
    return _p2_marked(spark, sf_dir).filter("mark is not null").select("term", "mark")


@LLM.register("p2_terms", _P2_TOKENS + "SELECT * FROM marked")
def p2_terms(spark, sf_dir):
    return _p2_marked(spark, sf_dir)


@LLM.register(
    "p2_ngrams",
    _P2_TOKENS
    + """, one AS (SELECT sentence_id, word_idx, min(term) AS t FROM tokens WHERE term <> '' GROUP BY ALL),
grams AS (
  SELECT sentence_id, [t] AS g FROM one
  UNION ALL SELECT a.sentence_id, [a.t, b.t] FROM one a JOIN one b ON b.sentence_id = a.sentence_id AND b.word_idx = a.word_idx + 1
  UNION ALL SELECT a.sentence_id, [a.t, b.t, c.t] FROM one a JOIN one b ON b.sentence_id = a.sentence_id AND b.word_idx = a.word_idx + 1
    JOIN one c ON c.sentence_id = a.sentence_id AND c.word_idx = a.word_idx + 2)
SELECT array_to_string(g, ' ') AS ngram, len(g)::INT AS n, count(*) AS occurrences, count(DISTINCT sentence_id) AS sentences
FROM grams GROUP BY g HAVING count(DISTINCT sentence_id) >= 2""",
)
def p2_ngrams(spark, sf_dir):
    """All n-grams of up to three terms that at least two sentences hold."""
    counted = ngrams.ngram_counts(ngrams.prediction_tokens(table(spark, sf_dir, "predictions")), max_n=3, min_records=2)
    return counted.select(F.array_join("ngram", " ").alias("ngram"), "n", "occurrences", F.col("records").alias("sentences"))


_P3_PAIRS = r"""
WITH splits AS (
  SELECT sentence_id, min(CASE s WHEN 'train' THEN 'train' WHEN 'test' THEN 'test' WHEN 'validation' THEN 'validation' WHEN 'valid' THEN 'validation' WHEN 'dev' THEN 'validation' END) AS split, min(source) AS source
  FROM (SELECT sentence_id, source, lower(trim(split)) AS s FROM sentences) GROUP BY sentence_id
), one AS (
  SELECT sentence_id, word_idx, min(word) AS word FROM predictions WHERE word IS NOT NULL GROUP BY ALL
), w AS (
  SELECT sentence_id, unnest(regexp_extract_all(lower(nfc_normalize(regexp_replace(word, '[\x{00AD}\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]', '', 'g'))), '[\p{L}\p{N}_]+')) AS w FROM one
), fit AS (
  SELECT sentence_id FROM w GROUP BY sentence_id HAVING count(*) >= 6
), bag AS (
  SELECT DISTINCT w.sentence_id, w.w, s.split = 'train' AS is_train, s.split, s.source FROM w SEMI JOIN fit USING (sentence_id) JOIN splits s USING (sentence_id) WHERE s.split IS NOT NULL
), size AS (SELECT sentence_id, count(*) AS n FROM bag GROUP BY sentence_id),
shared AS (
  SELECT a.sentence_id AS t, b.sentence_id AS e, b.split, b.source, count(*) AS i FROM bag a JOIN bag b ON a.w = b.w AND a.is_train AND NOT b.is_train GROUP BY ALL
), pairs AS (
  SELECT t, e, split, source, i, x.n + y.n - i AS u FROM shared JOIN size x ON x.sentence_id = t JOIN size y ON y.sentence_id = e WHERE 5 * i >= 4 * (x.n + y.n - i)
)
"""


def _p3_records(spark, sf_dir):
    splits = sentence_splits(table(spark, sf_dir, "sentences"))
    words = overlap.sentence_words(table(spark, sf_dir, "predictions")).join(splits, "sentence_id")
    return words.select(F.col("sentence_id").alias("id"), "split", "words"), splits


@LLM.register("p3_found", _P3_PAIRS + "SELECT least(t, e) AS sentence_id_a, greatest(t, e) AS sentence_id_b FROM pairs")
def p3_found(spark, sf_dir):
    pairs = overlap.cross_split_pairs(_p3_records(spark, sf_dir)[0])
    return pairs.select(F.least("train_id", "eval_id").alias("sentence_id_a"), F.greatest("train_id", "eval_id").alias("sentence_id_b"))


@LLM.register(
    "p3_by_split_source",
    _P3_PAIRS + "SELECT split, coalesce(source, 'unknown') AS source, count(*) AS pairs, count(DISTINCT e) AS sentences, count(*) FILTER (WHERE i = u) AS same FROM pairs GROUP BY 1, 2",
)
def p3_by_split_source(spark, sf_dir):
    """The overlapping pairs, and evaluation sentences in them, by split and source of the evaluation sentence: counted by classes, no pair is listed."""
    records, splits = _p3_records(spark, sf_dir)
    pairs, members = overlap.overlap(records)
    train = members.filter("is_train").groupBy(F.col("key").alias("train_key")).agg(F.count("*").alias("n_train"))
    by_class = pairs.join(train, "train_key").groupBy(F.col("eval_key").alias("key")).agg(F.sum("n_train").alias("n"), F.sum(F.when(F.col("shared") == F.col("united"), F.col("n_train")).otherwise(0)).alias("n_same"))
    named = members.filter("not is_train").join(splits.select(F.col("sentence_id").alias("id"), "split", "source"), "id").join(by_class, "key")
    grouped = named.groupBy("split", F.coalesce("source", F.lit("unknown")).alias("source"))
    return grouped.agg(F.sum("n").alias("pairs"), F.count("*").alias("sentences"), F.sum("n_same").alias("same"))


@LLM.register("p3_coverage", _P3_PAIRS + "SELECT e AS sentence_id, count(*) AS train_sentences, max(i::DOUBLE / n) AS coverage FROM pairs JOIN size ON size.sentence_id = e GROUP BY e")
def p3_coverage(spark, sf_dir):
    """The evaluation sentences that overlap training sentences, how many, and the largest share of their words in one."""
    found = overlap.record_coverage(_p3_records(spark, sf_dir)[0])
    return found.select(F.col("id").alias("sentence_id"), F.col("train_records").alias("train_sentences"), "coverage")


@LLM.register("p1_sample")
def p1_sample(spark, sf_dir):
    return sample.run_samples(table(spark, sf_dir, "sentences"), table(spark, sf_dir, "runs"))


@LLM.register("p1_shares")
def p1_shares(spark, sf_dir):
    """Chosen and all train sentences of each run, and the reason of the runs that get no sample."""
    sentences, runs = table(spark, sf_dir, "sentences"), table(spark, sf_dir, "runs")
    chosen = sample.run_samples(sentences, runs).groupBy("run_id").agg(F.count("*").alias("chosen"))
    total = sample.train_sentences(sentences).count()
    return sample.run_settings(runs).join(chosen, "run_id", "left").select("run_id", "fraction", "seed", "reason", F.coalesce("chosen", F.lit(0)).alias("chosen"), F.lit(total).alias("sentences"))


_P5_FOUND = r"""
WITH spec AS (
  SELECT DISTINCT run_id, source, coalesce(config.chunker.max_len, 128) AS lim FROM pretrain_runs
), size AS (
  SELECT doc_id, source, list_sum(list_transform(regexp_extract_all(text, '[^ \t\r\n]+'), lambda w: (length(w) + 3) // 4)) AS n FROM documents
)
SELECT DISTINCT run_id, doc_id FROM size JOIN spec USING (source) WHERE lim > 2 AND n > lim - 2
"""


@LLM.register("p5_found", _P5_FOUND)
def p5_found(spark, sf_dir):
    found = chunks.split_oversized(_documents(spark, sf_dir, "doc_id", "text", "source"), chunks.settings_of(table(spark, sf_dir, "pretrain_runs")))
    return found.filter(F.size("starts") > 1).select("run_id", "doc_id")


@LLM.register("p5_pieces")
def p5_pieces(spark, sf_dir):
    return chunks.pieces(_documents(spark, sf_dir, "doc_id", "text", "source"), chunks.settings_of(table(spark, sf_dir, "pretrain_runs")))


def _p8_subjects(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text")
    return subjects.assign(docs, subjects.fit(docs, table(spark, sf_dir, "subject_labels")))


@LLM.register("p8_found")
def p8_found(spark, sf_dir):
    known = table(spark, sf_dir, "subjects").select("subject").distinct()
    return _p8_subjects(spark, sf_dir).join(F.broadcast(known), "subject", "left_semi").select("doc_id", "subject")


@LLM.register("p8_composition")
def p8_composition(spark, sf_dir):
    """Documents and code points of the corpus by subject; a document of two subjects counts for each by its share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    found = _p8_subjects(spark, sf_dir).join(docs, "doc_id")
    return found.groupBy("subject").agg(F.count("*").alias("docs"), F.sum(F.col("share") * F.col("n_chars")).alias("chars"))
