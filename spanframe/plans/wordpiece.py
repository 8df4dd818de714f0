"""Queries under a real WordPiece vocabulary with unknown pieces: fertility, overlap, tables, strata, subsets, vocabulary extension.

The vocabulary is made by a rule that both engines follow: words that training has often, endings of many words, and frequent letters. Nothing is
learned. A word with a letter that isn't frequent can't be spelt and is unknown. The SQL spells by a recursive longest match.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from spanframe.functions import tags
from spanframe.functions import wordpiece as WP
from spanframe.operators import align as A
from spanframe.operators import fertility as Fe
from spanframe.operators import packing
from spanframe.operators import registry as R
from spanframe.operators import sampling as Sa
from spanframe.operators import spans as S
from spanframe.operators import tables as Tb
from spanframe.operators import vocabulary as V
from spanframe.plans import sql
from spanframe.plans.registry import CORE
from spanframe.plans.runs import CELLS, METHODS, f1_sql, registered
from spanframe.plans.tokens import WORDS, split_words, test_contract
from spanframe.session import stored
from spanframe.stats import bootstrap, intervals, logistic, resample

#: The rule: least count of a whole word and its most letters, least number of words with an ending and its most letters, least count of a letter.
LEAST_WORD, WORD_LETTERS, LEAST_ENDING, ENDING_LETTERS, LEAST_LETTER = 5, 12, 10, 5, 20


def _spelled(name: str, words: str, vocabulary: str) -> str:
    """CTEs that spell the ``word`` column of ``words``: ``name(word, pieces, n_pieces, unk)``; an unspellable word is one unknown piece."""
    return f"""{name}_steps(word, rest, mark, pieces) AS (
  SELECT DISTINCT word, word, '', []::VARCHAR[] FROM {words} WHERE length(word) BETWEEN 1 AND 100
  UNION ALL
  SELECT word, substr(rest, best + 1), '##', list_append(pieces, mark || substr(rest, 1, best)) FROM (
    SELECT s.word, s.rest, s.mark, s.pieces, max(k.k) AS best FROM {name}_steps s JOIN (SELECT unnest(range(1, {WORD_LETTERS + 8})) AS k) k ON k.k <= length(s.rest)
    JOIN {vocabulary} v ON v.piece = s.mark || substr(s.rest, 1, k.k) WHERE s.rest <> '' GROUP BY ALL)
), {name} AS (
  SELECT w.word, coalesce(s.pieces, ['[UNK]']) AS pieces, len(coalesce(s.pieces, ['[UNK]']))::INT AS n_pieces, s.pieces IS NULL AS unk
  FROM (SELECT DISTINCT word FROM {words}) w LEFT JOIN {name}_steps s ON s.word = w.word AND s.rest = ''
)"""


VOCABULARY = f"""{WORDS}, train AS (SELECT word FROM words WHERE split = 'train'), train_words AS (SELECT DISTINCT word FROM train), vocabulary AS (
  SELECT word AS piece FROM train WHERE length(word) BETWEEN 1 AND {WORD_LETTERS} GROUP BY word HAVING count(*) >= {LEAST_WORD}
  UNION SELECT '##' || substr(word, length(word) - k + 1) FROM (SELECT word, unnest(range(1, {ENDING_LETTERS + 1})) AS k FROM train_words) WHERE length(word) > k GROUP BY 1 HAVING count(*) >= {LEAST_ENDING}
  UNION SELECT unnest([c, '##' || c]) FROM (SELECT c FROM (SELECT substr(word, i, 1) AS c FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM train_words)) GROUP BY c HAVING count(*) >= {LEAST_LETTER})
)"""
SPELLED = f"{VOCABULARY}, {_spelled('wp', 'words', 'vocabulary')}"


def vocabulary_of(words):
    """``piece`` of the rule's vocabulary from ``split, word``."""
    train = words.filter("split = 'train'").select("word")
    counted = train.groupBy("word").agg(F.count("*").alias("n"))
    whole = counted.filter((F.col("n") >= LEAST_WORD) & F.length("word").between(1, WORD_LETTERS)).select(F.col("word").alias("piece"))
    ending = F.explode(F.transform(F.sequence(F.lit(1), F.lit(ENDING_LETTERS)), lambda k: F.when(F.length("word") > k, F.substring("word", F.length("word") - k + 1, k))))
    endings = counted.select(ending.alias("e")).filter("e is not null").groupBy("e").count().filter(F.col("count") >= LEAST_ENDING).select(F.concat(F.lit("##"), "e").alias("piece"))
    letters = counted.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").groupBy("c").count().filter(F.col("count") >= LEAST_LETTER)
    return whole.union(endings).union(letters.select(F.explode(F.array("c", F.concat(F.lit("##"), "c"))).alias("piece"))).distinct()


class Base:
    """The words of all splits, written once, with the vocabulary and the pieces of each distinct word."""

    def __init__(self, spark, sf_dir) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.words = stored(split_words(spark, sf_dir))
        self.vocabulary = V.collected(vocabulary_of(self.words))
        self.tokenize = WP.wordpiece(self.words, self.vocabulary)
        self.pieces = stored(WP.piece_table(self.words, self.tokenize))

    def of(self, split: str):
        return self.words.filter(F.col("split") == split)

    def word_table(self):
        return Tb.word_table(self.of("test"), self.pieces, self.of("train"))

    def entities(self):
        return Tb.entity_table(self.of("test"), self.pieces, Tb.training_entities(self.of("train"), ["sentence_id"]))

    def hits(self):
        """``run_id`` and the entity columns with ``hit``, for every run that has the sentence."""
        w = test_contract(self.spark, self.sf_dir)
        found = S.side_spans(w, S.SENTENCE, {"pred": "pred"}).select("run_id", "sentence_id", "etype", "start", "end").withColumn("found", F.lit(True))
        each = self.entities().join(w.select("run_id", "sentence_id").distinct(), "sentence_id")
        return each.join(found, ["run_id", "sentence_id", "etype", "start", "end"], "left").withColumn("hit", F.coalesce("found", F.lit(False))).drop("found")

    def errors(self):
        """The word table with ``run_id, error`` of every run that has the word."""
        wrong = test_contract(self.spark, self.sf_dir).select("run_id", "sentence_id", "word_idx", (F.col("gold") != F.col("pred")).cast("int").alias("error"))
        return wrong.join(self.word_table(), ["sentence_id", "word_idx"])


@CORE.register("wordpiece_vocabulary", f"WITH {VOCABULARY} SELECT piece, (row_number() OVER (ORDER BY piece) - 1)::INT AS id FROM vocabulary")
def wordpiece_vocabulary(spark, sf_dir):
    """The vocabulary with ids from 0 without gaps, which is checked."""
    listed = V.numbered(spark, V.collected(vocabulary_of(split_words(spark, sf_dir))))
    V.require_contiguous(listed)
    return listed


@CORE.register("wordpiece_pieces", f"WITH RECURSIVE {SPELLED} SELECT word, array_to_string(pieces, ' ') AS pieces, n_pieces, unk AS is_unk, unk AS any_unk FROM wp")
def wordpiece_pieces(spark, sf_dir):
    return Base(spark, sf_dir).pieces.withColumn("pieces", F.array_join("pieces", " "))


@CORE.register(
    "wordpiece_fertility",
    f"""WITH RECURSIVE {SPELLED}, w AS (SELECT split, n_pieces AS p, unk FROM words JOIN wp USING (word))
    SELECT split, count(*) AS words, sum(p)::BIGINT AS subwords, round(avg(p), 8) AS mean, count(*) FILTER (WHERE p = 1)::BIGINT AS single_words, count(*) FILTER (WHERE p > 1)::BIGINT AS split_words,
      round(count(*) FILTER (WHERE p > 1)::DOUBLE / count(*), 8) AS split_rate, round(coalesce(avg(p) FILTER (WHERE p > 1), 0), 8) AS mean_of_split, median(p) AS median, round(stddev_pop(p), 8) AS sd,
      max(p) AS max_pieces, count(*) FILTER (WHERE unk)::BIGINT AS unknown, round(count(*) FILTER (WHERE unk)::DOUBLE / count(*), 8) AS unknown_rate FROM w GROUP BY GROUPING SETS ((split), ())""",
)
def wordpiece_fertility(spark, sf_dir):
    b = Base(spark, sf_dir)
    out = Fe.fertility(Fe.word_counts(b.words, ["split"]), b.pieces, "split")
    return out.withColumns({c: F.round(c, 8) for c in ("mean", "split_rate", "mean_of_split", "sd", "unknown_rate")})


_OVERLAP = """tgt_{0} AS (SELECT word, count(*) AS n FROM words WHERE split = 'test' AND {1} GROUP BY word),
each_{0} AS (SELECT word, n, piece, piece IN (SELECT piece FROM shared) AS shared FROM (SELECT t.word, t.n, unnest(wp.pieces) AS piece FROM tgt_{0} t JOIN wp USING (word))),
pieces_{0} AS (SELECT piece, shared, sum(n) AS n FROM each_{0} GROUP BY ALL),
words_{0} AS (SELECT word, max(n) AS n, bool_and(shared) AS covered, word IN (SELECT word FROM train) AS known FROM each_{0} GROUP BY word),
out_{0} AS (SELECT '{0}' AS grp, (SELECT sum(n)::BIGINT FROM words_{0}) AS words, (SELECT count(*) FROM words_{0}) AS word_types, (SELECT sum(n)::BIGINT FROM pieces_{0}) AS piece_tokens, (SELECT count(*) FROM pieces_{0}) AS piece_types,
  round((SELECT 100 * count(*) FILTER (WHERE shared)::DOUBLE / count(*) FROM pieces_{0}), 8) AS shared_piece_types, round((SELECT 100 * coalesce(sum(n) FILTER (WHERE shared), 0)::DOUBLE / sum(n) FROM pieces_{0}), 8) AS shared_piece_tokens,
  round((SELECT 100 * coalesce(sum(n) FILTER (WHERE covered), 0)::DOUBLE / sum(n) FROM words_{0}), 8) AS covered_words, round((SELECT 100 * count(*) FILTER (WHERE known)::DOUBLE / count(*) FROM words_{0}), 8) AS word_types_in_source)"""


@CORE.register(
    "wordpiece_overlap",
    f"""WITH RECURSIVE {SPELLED}, shared AS (SELECT DISTINCT unnest(pieces) AS piece FROM wp WHERE word IN (SELECT word FROM train) AND NOT unk), {_OVERLAP.format("all", "true")}, {_OVERLAP.format("entity", "gold <> 'O'")}
    SELECT * FROM out_all UNION ALL SELECT * FROM out_entity""",
)
def wordpiece_overlap(spark, sf_dir):
    """What the pieces of training cover of the test words, all and those of entities; the unknown piece is never shared."""
    b = Base(spark, sf_dir)
    groups = (("all", b.of("test")), ("entity", b.of("test").filter("gold <> 'O'")))
    parts = [Fe.piece_overlap(b.of("train"), target, b.tokenize).withColumn("grp", F.lit(name)) for name, target in groups]
    return parts[0].unionByName(parts[1]).withColumns({c: F.round(c, 8) for c in ("shared_piece_types", "shared_piece_tokens", "covered_words", "word_types_in_source")})


_WORD_TABLE = f"""{SPELLED}, freq AS (SELECT word, count(*) AS freq FROM train GROUP BY word), word_table AS (
  SELECT w.sentence_id, w.word_idx, w.word, w.gold, p.n_pieces AS pieces, p.unk, length(w.word)::INT AS chars, coalesce(f.freq, 0) AS freq, CASE WHEN gold = 'O' THEN '' ELSE substr(w.gold, 3) END AS etype,
    w.gold <> 'O' AS is_entity, w.gold LIKE 'B-%' AS is_begin, CASE WHEN p.n_pieces >= 5 THEN '5+' ELSE p.n_pieces::VARCHAR END AS piece_bin, CASE WHEN f.freq IS NULL THEN 'unseen' WHEN f.freq < 5 THEN '1-4' ELSE '5+' END AS freq_bin
  FROM words w JOIN wp p USING (word) LEFT JOIN freq f USING (word) WHERE w.split = 'test'
)"""


@CORE.register("wordpiece_words", f"WITH RECURSIVE {_WORD_TABLE} SELECT * FROM word_table")
def wordpiece_words(spark, sf_dir):
    return Base(spark, sf_dir).word_table()


_ENTITIES = f"""{SPELLED}, sided AS (SELECT sentence_id, split, word_idx, word, gold, 'O' AS pred FROM words), {sql.spans("sided", "sentence_id, split")}, bounds AS (SELECT * FROM spans WHERE side = 'gold'),
known AS (SELECT DISTINCT text, etype FROM bounds WHERE split = 'train'), entities AS (
  SELECT b.sentence_id, b."start", b."end", b.etype, b.text, count(*)::INT AS n_words, avg(p.n_pieces) AS mean_pieces, max(p.n_pieces) AS max_pieces, bool_or(p.unk) AS has_unk, k.text IS NOT NULL AS seen,
    CASE WHEN avg(p.n_pieces) <= 1 THEN '1.0' WHEN avg(p.n_pieces) <= 2 THEN '(1,2]' WHEN avg(p.n_pieces) <= 3 THEN '(2,3]' ELSE '>3' END AS fertility_bin
  FROM bounds b JOIN words w ON w.sentence_id = b.sentence_id AND w.word_idx >= b."start" AND w.word_idx < b."end" JOIN wp p USING (word) LEFT JOIN known k ON k.text = b.text AND k.etype = b.etype
  WHERE b.split = 'test' GROUP BY b.sentence_id, b."start", b."end", b.etype, b.text, k.text
)"""


@CORE.register("wordpiece_entities", f"WITH RECURSIVE {_ENTITIES} SELECT * REPLACE (round(mean_pieces, 8) AS mean_pieces) FROM entities")
def wordpiece_entities(spark, sf_dir):
    return Base(spark, sf_dir).entities().withColumn("mean_pieces", F.round("mean_pieces", 8))


_HITS = f"""{_ENTITIES}, pred_spans AS (
  SELECT DISTINCT run_id, sentence_id, etype, "start", "end" FROM (
    SELECT run_id, sentence_id, substr(tag, 3) AS etype, n, min(word_idx) AS "start", max(word_idx) + 1 AS "end" FROM (
      SELECT *, sum(CASE WHEN tag <> 'O' AND (tag LIKE 'B-%' OR prev IS NULL OR prev = 'O' OR substr(prev, 3) <> substr(tag, 3)) THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, sentence_id ORDER BY word_idx) AS n
      FROM (SELECT run_id, sentence_id, word_idx, pred AS tag, lag(pred) OVER (PARTITION BY run_id, sentence_id ORDER BY word_idx) AS prev FROM contract)) WHERE tag <> 'O' GROUP BY ALL)
), hits AS (
  SELECT r.run_id, e.*, p.run_id IS NOT NULL AS hit FROM entities e JOIN (SELECT DISTINCT run_id, sentence_id FROM contract) r USING (sentence_id)
  LEFT JOIN pred_spans p ON p.run_id = r.run_id AND p.sentence_id = e.sentence_id AND p.etype = e.etype AND p."start" = e."start" AND p."end" = e."end"
), in_subsets AS (SELECT *, unnest(list_filter([CASE WHEN NOT seen AND mean_pieces > 3 AND NOT has_unk THEN 'primary' END, CASE WHEN NOT seen AND mean_pieces <= 2 AND NOT has_unk THEN 'specificity' END,
  CASE WHEN seen AND NOT has_unk THEN 'negative_control' END, CASE WHEN NOT seen AND has_unk THEN 'unseen_with_unk' END], lambda x: x IS NOT NULL)) AS subset FROM hits)"""


def _with_subsets(hits):
    return hits.withColumn("subsets", tags.subset_names(F.col("seen"), F.col("mean_pieces"), F.col("has_unk")))


@CORE.register("wordpiece_subset_recall", f"WITH RECURSIVE {_HITS} SELECT run_id, subset, count(*) AS entities, count(*) FILTER (WHERE hit) AS hits FROM in_subsets GROUP BY ALL")
def wordpiece_subset_recall(spark, sf_dir):
    """Entities and hits of each run by subset, all four subsets."""
    each = _with_subsets(Base(spark, sf_dir).hits()).withColumn("subset", F.explode("subsets"))
    return each.groupBy("run_id", "subset").agg(F.count("*").alias("entities"), F.count_if("hit").alias("hits"))


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 8) for c in names or ("mean", "sd")})


@CORE.register(
    "wordpiece_error_strata",
    f"""WITH RECURSIVE {_WORD_TABLE}, r AS (SELECT c.run_id, w.freq_bin, w.piece_bin, avg((c.gold <> c.pred)::INT) AS rate, count(*) AS n FROM contract c JOIN word_table w USING (sentence_id, word_idx) WHERE w.is_entity GROUP BY ALL),
    p AS (SELECT c.run_id, 'all' AS freq_bin, w.piece_bin, avg((c.gold <> c.pred)::INT) AS rate, count(*) AS n FROM contract c JOIN word_table w USING (sentence_id, word_idx) WHERE w.is_entity GROUP BY ALL)
    SELECT freq_bin, piece_bin, round(avg(rate), 8) AS mean, round(stddev_samp(rate), 8) AS sd, max(n) AS n, count(*) AS runs FROM (SELECT * FROM r UNION ALL SELECT * FROM p) GROUP BY ALL HAVING max(n) >= {Tb.LEAST_CELL} OR freq_bin = 'all'""",
)
def wordpiece_error_strata(spark, sf_dir):
    """Word errors of entity words by piece bin, over all (``all``) and within frequency strata of thirty words or more."""
    errors = stored(Base(spark, sf_dir).errors().filter("is_entity").select("run_id", "freq_bin", "piece_bin", "error"))
    whole = Tb.run_strata(errors, "run_id", ["piece_bin"], "error").withColumn("freq_bin", F.lit("all"))
    return _rounded(Tb.run_strata(errors, "run_id", ["freq_bin", "piece_bin"], "error", least=Tb.LEAST_CELL).unionByName(whole))


_BINS = "('1.0', '(1,2]', '(2,3]', '>3')"


@CORE.register(
    "wordpiece_recall",
    f"""WITH RECURSIVE {_HITS}, r AS (SELECT run_id, seen, fertility_bin, avg(hit::INT) AS rate, count(*) AS n FROM hits GROUP BY ALL)
    SELECT seen, fertility_bin, round(avg(rate), 8) AS mean, round(stddev_samp(rate), 8) AS sd, max(n) AS n, count(*) AS runs FROM r GROUP BY ALL""",
)
def wordpiece_recall(spark, sf_dir):
    hits = Base(spark, sf_dir).hits().select("run_id", "seen", "fertility_bin", F.col("hit").cast("int").alias("hit"))
    return _rounded(Tb.run_strata(hits, "run_id", ["seen", "fertility_bin"], "hit"))


@CORE.register(
    "wordpiece_recall_by_bins",
    f"""WITH RECURSIVE {_HITS}, b AS (SELECT unnest(['1', '2', '3', '4', '5+']) AS piece_bin), h AS (SELECT run_id, CASE WHEN max_pieces >= 5 THEN '5+' ELSE max_pieces::VARCHAR END AS piece_bin, hit FROM hits),
    r AS (SELECT run_id, piece_bin, avg(hit::INT) AS rate, count(*) AS n FROM h GROUP BY ALL), m AS (SELECT piece_bin, avg(rate) AS mean, stddev_samp(rate) AS sd, max(n) AS n FROM r GROUP BY 1)
    SELECT piece_bin, round(mean, 8) AS mean, round(sd, 8) AS sd, coalesce(n, 0) AS n FROM b LEFT JOIN m USING (piece_bin)""",
)
def wordpiece_recall_by_bins(spark, sf_dir):
    """Recall by the most pieces a word of the entity has; every bin comes out, empty ones with null."""
    hits = Base(spark, sf_dir).hits().select("run_id", tags.piece_bin("max_pieces").alias("piece_bin"), F.col("hit").cast("int").alias("hit"))
    return _rounded(Tb.all_bins(Tb.run_strata(hits, "run_id", ["piece_bin"], "hit"), "piece_bin", tags.PIECE_BINS)).select("piece_bin", "mean", "sd", "n")


@CORE.register(
    "wordpiece_patterns",
    f"""WITH RECURSIVE {_WORD_TABLE} SELECT least(w.pieces, 8)::DOUBLE AS pieces, round(ln(1 + w.freq::DOUBLE), 8) AS log_freq, w.chars::DOUBLE AS chars, w.is_begin::INT AS is_begin, w.etype, count(*) AS n, sum((c.gold <> c.pred)::INT)::BIGINT AS errors
    FROM contract c JOIN word_table w USING (sentence_id, word_idx) WHERE w.is_entity GROUP BY ALL""",
)
def wordpiece_patterns(spark, sf_dir):
    """Distinct covariates of entity words with words and errors: the input of the logistic fit."""
    return logistic.patterns(Base(spark, sf_dir).errors().filter("is_entity"), []).withColumn("log_freq", F.round("log_freq", 8))


@CORE.register("odds_ratio_interval")
def odds_ratio_interval(spark, sf_dir):
    """The pieces' odds ratio of a word error by method: geometric mean over runs, with its seeded bootstrap interval (200 replicates)."""
    done = R.completed(registered(spark, sf_dir)).select("run_id", F.coalesce("config.method.name", F.lit("none")).alias("method"))
    errors = stored(Base(spark, sf_dir).errors().filter("is_entity").join(done, "run_id").select("method", "run_id", "sentence_id", "pieces", "freq", "chars", "is_begin", "etype", "error"))
    ratios = logistic.odds_ratios_by(errors, "run_id").filter("feature = 'pieces' and odds_ratio is not null").join(done, "run_id")
    means = {r["method"]: r["geometric_mean"] for r in logistic.geometric_mean(ratios, ["method"], "odds_ratio").collect()}
    rows = [(m, means.get(m), *logistic.bootstrap_odds_ratio(errors.filter(F.col("method") == m), 200, 42)) for m in sorted(r[0] for r in errors.select("method").distinct().collect())]
    return spark.createDataFrame(rows, "method string, odds_ratio double, low double, high double")


#: Pairs of methods that are compared, first and second arm.
PAIRS = {"lora_full": ("lora", "full"), "frozen_full": ("frozen", "full")}
REPLICATES, SEED = 1_000, 42


def _cells(spark, sf_dir):
    """Counts of the test sentences by run with ``method, seed``; runs without a method are named ``none``."""
    done = R.completed(registered(spark, sf_dir)).select("run_id", F.coalesce("config.method.name", F.lit("none")).alias("method"), F.col("config.seed").alias("seed"))
    return S.sentence_counts(test_contract(spark, sf_dir)).join(done, "run_id")


@CORE.register("resampled_f1", f"""WITH {CELLS}, {f1_sql("method", REPLICATES, SEED)}, s AS ({sql.summary("method", "f1", "f1", "scored")}) SELECT method, round(f1, 8) AS f1, round(low, 8) AS low, round(high, 8) AS high FROM s""")
def resampled_f1(spark, sf_dir):
    """F1 over all test rows of a method with its 95 % interval, sentences resampled by arithmetic weights."""
    return _rounded(resample.micro_f1(_cells(spark, sf_dir), ["method"], REPLICATES, SEED), "f1", "low", "high")


@CORE.register(
    "resampled_mean_f1",
    f"""WITH {CELLS}, {f1_sql("method, run_id", REPLICATES, SEED)}, means AS (SELECT method, rep, avg(f1) AS f1 FROM scored GROUP BY ALL), s AS ({sql.summary("method", "f1", "f1", "means")})
    SELECT method, round(f1, 8) AS f1, round(low, 8) AS low, round(high, 8) AS high FROM s""",
)
def resampled_mean_f1(spark, sf_dir):
    """The mean F1 of a method's runs with its 95 % interval."""
    return _rounded(resample.mean_f1(_cells(spark, sf_dir), ["method"], REPLICATES, SEED), "f1", "low", "high")


@CORE.register(
    "paired_f1",
    f"""WITH {CELLS}, {f1_sql("method, seed", REPLICATES, SEED)}, wide AS (SELECT seed, rep, max(f1) FILTER (WHERE method = 'lora') AS a, max(f1) FILTER (WHERE method = 'full') AS b FROM scored WHERE seed IS NOT NULL GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL),
    named AS (SELECT seed, row_number() OVER (ORDER BY seed) - 1 AS place, count(*) OVER () AS seeds FROM wide WHERE rep = 0), gains AS (SELECT rep, place, seeds, a, b, b - a AS gain FROM wide JOIN named USING (seed)),
    draws AS (SELECT rep, seeds, unnest(range(seeds)) AS j FROM (SELECT DISTINCT rep, seeds FROM gains)), picked AS (SELECT rep, CASE WHEN rep = 0 THEN j ELSE floor(({sql.uniform("(j + 1)", "rep", SEED + 1)}) * seeds)::BIGINT END AS place FROM draws),
    means AS (SELECT rep, avg(gain) AS gain FROM picked JOIN gains USING (rep, place) GROUP BY rep), s AS ({sql.summary("", "gain", "delta", "means")}), o AS (SELECT count(*) AS seeds, avg(a) AS f1_a, avg(b) AS f1_b FROM gains WHERE rep = 0)
    SELECT seeds, round(f1_a, 8) AS f1_a, round(f1_b, 8) AS f1_b, round(delta, 8) AS delta, round(low, 8) AS low, round(high, 8) AS high, round(p, 8) AS p FROM o, s WHERE seeds > 0""",
)
def paired_f1(spark, sf_dir):
    """Difference of the mean F1 of two methods over their common seeds, sentences and seeds resampled."""
    counts = _cells(spark, sf_dir).filter("seed is not null").withColumnRenamed("method", "arm")
    return _rounded(resample.paired_f1(counts, *PAIRS["lora_full"], REPLICATES, SEED), "f1_a", "f1_b", "delta", "low", "high", "p")


_ARMS_SQL = " UNION ALL ".join(f"SELECT '{p}' AS pair, run_id, CASE method WHEN '{a}' THEN 'a' ELSE 'b' END AS arm FROM methods WHERE method IN ('{a}', '{b}')" for p, (a, b) in PAIRS.items())


@CORE.register(
    "paired_recall",
    f"""WITH RECURSIVE {_HITS}, {METHODS}, arms AS ({_ARMS_SQL}), sums AS (SELECT run_id, subset, sentence_id, count(*) AS n, sum(hit::INT) AS h FROM in_subsets GROUP BY ALL), {sql.weights("sums", REPLICATES, SEED)},
    by_run AS (SELECT run_id, subset, rep, sum(h * w)::DOUBLE / nullif(sum(n * w), 0) AS recall FROM sums JOIN weights USING (sentence_id) GROUP BY ALL),
    sides AS (SELECT pair, subset, rep, avg(recall) FILTER (WHERE arm = 'b') - avg(recall) FILTER (WHERE arm = 'a') AS delta FROM by_run JOIN arms USING (run_id) GROUP BY ALL HAVING delta IS NOT NULL),
    did AS (SELECT pair, 'did' AS subset, rep, max(delta) FILTER (WHERE subset = 'primary') - max(delta) FILTER (WHERE subset = 'specificity') AS delta FROM sides GROUP BY pair, rep HAVING delta IS NOT NULL),
    every AS (SELECT * FROM sides UNION ALL SELECT * FROM did), s AS ({sql.summary("pair, subset", "delta", "delta", "every")}),
    scaled AS (SELECT pair, p, delta, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, pair) + 1) * p) AS x FROM s WHERE subset = 'primary'),
    corrected AS (SELECT pair, delta > 0 AS better, max(x) OVER (ORDER BY p, pair ROWS UNBOUNDED PRECEDING) AS p_holm FROM scaled), second AS (SELECT pair, delta > 0 AND low > 0 AS h2 FROM s WHERE subset = 'did')
    SELECT s.pair, s.subset, round(s.delta, 8) AS delta, round(low, 8) AS low, round(high, 8) AS high, round(s.p, 8) AS p, round(p_holm, 8) AS p_holm, better AND p_holm < 0.05 AS h1, h2 FROM s LEFT JOIN corrected USING (pair) LEFT JOIN second USING (pair)""",
)
def paired_recall(spark, sf_dir):
    """Differences of mean recall of two pairs of methods by subset, the difference in differences, corrected p-values and decisions."""
    hits = stored(_with_subsets(Base(spark, sf_dir).hits()).select("run_id", "sentence_id", "hit", "subsets"))
    return _rounded(resample.paired_recall(hits, _arms(spark, sf_dir), REPLICATES, SEED), "delta", "low", "high", "p", "p_holm")


def _arms(spark, sf_dir):
    """``pair, run_id, arm`` of the compared methods' completed runs."""
    done = R.completed(registered(spark, sf_dir)).select("run_id", F.col("config.method.name").alias("method"))
    sides = F.array(*(F.struct(F.lit(p).alias("pair"), F.when(F.col("method") == a, "a").when(F.col("method") == b, "b").alias("arm")) for p, (a, b) in PAIRS.items()))
    return done.select("run_id", F.explode(sides).alias("x")).filter("x.arm is not null").select("x.pair", "run_id", "x.arm")


@CORE.register("compare_bootstrap")
def compare_bootstrap(spark, sf_dir):
    """The seeded paired recall comparison of the same pairs: 10,000 replicates, all four subsets that have entities, decisions."""
    hits = stored(_with_subsets(Base(spark, sf_dir).hits()).select("run_id", "sentence_id", "hit", "subsets"))
    occurring = hits.select("run_id", F.explode("subsets").alias("subset")).distinct().collect()
    known, present = {r["run_id"] for r in occurring}, {r["subset"] for r in occurring}
    arms = [r for r in _arms(spark, sf_dir).orderBy("pair", "run_id").collect() if r["run_id"] in known]
    sides = {p: [tuple(r["run_id"] for r in arms if (r["pair"], r["arm"]) == (p, side)) for side in "ab"] for p in PAIRS}
    schema = "pair string, subset string, delta double, low double, high double, p double, p_holm double, h1 boolean, h2 boolean"
    if not {"primary", "specificity"} <= present or not all(all(x) for x in sides.values()):
        return spark.createDataFrame([], schema)  # nothing to compare in so little data
    pairs = [bootstrap.Pair(p, *x) for p, x in sides.items()]
    found = bootstrap.compare(hits, pairs, [u for u in tags.SUBSETS if u in present], 10_000, SEED)
    rows = []
    for pair, x in found["pairs"].items():
        rows += [(pair, u, v["delta"], v["low"], v["high"], v["p"], x["p_holm"], bool(x["h1"]), bool(x["h2"])) for u, v in [*x["subsets"].items(), (resample.DID, x["did"])]]
    return spark.createDataFrame(rows, schema)


@CORE.register("paired_f1_seeded")
def paired_f1_seeded(spark, sf_dir):
    """The seeded form of ``paired_f1`` with 10,000 replicates and the exact sign-flip p of the seeds' differences."""
    pooled = _cells(spark, sf_dir).filter("seed is not null").groupBy("method", "seed", "sentence_id").agg(*(F.sum(c).alias(c) for c in resample.COUNTS))
    a, b = PAIRS["lora_full"]
    cube = bootstrap.cube(stored(pooled.filter(F.col("method").isin(a, b)).select(F.concat_ws("/", "method", "seed").alias("run_id"), "sentence_id", *resample.COUNTS)))
    at = {r: i for i, r in enumerate(cube.runs)}
    seeds = sorted({r.split("/")[1] for r in cube.runs if f"{a}/{r.split('/')[1]}" in at and f"{b}/{r.split('/')[1]}" in at}, key=int)
    found = bootstrap.paired_f1(*(cube.counts[[at[f"{m}/{s}"] for s in seeds]] for m in (a, b)), 10_000, SEED)
    sign = intervals.sign_flip_share(np.array(found["by_seed"]))
    return spark.createDataFrame([(len(seeds), found["f1_a"], found["f1_b"], found["delta"], found["low"], found["high"], found["p"], sign)], "seeds int, f1_a double, f1_b double, delta double, low double, high double, p double, sign_flip_p double")


# vocabulary extension: the most used whole words of all splits, as a learner would give them, against the base vocabulary

_LEARNED = f"""{SPELLED}, learned AS (SELECT word AS piece FROM words WHERE length(word) <= 100 AND word NOT LIKE '##%' GROUP BY word HAVING count(*) >= 2), usage AS (SELECT word AS piece, count(*) AS n FROM train GROUP BY word),
spelled_ok AS (SELECT word AS piece FROM wp WHERE NOT unk), candidates AS (SELECT l.piece, coalesce(u.n, 0) AS n, CASE WHEN l.piece IN (SELECT piece FROM vocabulary) THEN 'in_base' WHEN length(l.piece) <= 1 THEN 'single_character'
  WHEN l.piece NOT IN (SELECT piece FROM spelled_ok) THEN 'needs_unk' WHEN u.n IS NULL THEN 'unused' END AS skip FROM learned l LEFT JOIN usage u USING (piece)),
added AS (SELECT piece, n FROM candidates WHERE skip IS NULL ORDER BY n DESC, piece LIMIT 300), base AS (SELECT piece, (row_number() OVER (ORDER BY piece) - 1)::INT AS id FROM vocabulary),
extended AS (SELECT * FROM base UNION ALL SELECT piece, ((SELECT count(*) FROM base) + row_number() OVER (ORDER BY n DESC, piece) - 1)::INT FROM added)"""
MOST_ADDED = 300


def _extension(b: Base) -> V.Extension:
    counted = b.words.groupBy("word").agg(F.count("*").alias("n"))
    learned = counted.filter((F.col("n") >= 2) & (F.length("word") <= 100) & ~F.col("word").startswith("##")).select(F.col("word").alias("piece"))
    usage = b.of("train").groupBy(F.col("word").alias("piece")).agg(F.count("*").alias("n"))
    return V.extend(V.numbered(b.spark, b.vocabulary), learned, usage, MOST_ADDED)


@CORE.register("extension_candidates", f"WITH RECURSIVE {_LEARNED} SELECT * FROM candidates")
def extension_candidates(spark, sf_dir):
    """Learned pieces with their use in training and the first reason to skip them."""
    return _extension(Base(spark, sf_dir)).candidates


@CORE.register("extension_vocabulary", f"WITH RECURSIVE {_LEARNED} SELECT piece, id FROM extended")
def extension_vocabulary(spark, sf_dir):
    """The base vocabulary with the most used candidates appended; old ids stay."""
    return _extension(Base(spark, sf_dir)).vocabulary


@CORE.register(
    "extension_report",
    f"""WITH RECURSIVE {_LEARNED}, wider AS (SELECT piece FROM extended), {_spelled("wide", "words", "wider")}, t AS (SELECT w.gold <> 'O' AS is_entity, b.n_pieces AS b, a.n_pieces AS a, b.unk AS bu, a.unk AS au FROM words w JOIN wp b USING (word) JOIN wide a USING (word) WHERE w.split = 'test'),
    g AS (SELECT *, unnest(list_filter(['all', CASE WHEN is_entity THEN 'entity' END, CASE WHEN is_entity AND b >= 4 THEN 'fragmented' END], lambda x: x IS NOT NULL)) AS grp FROM t)
    SELECT grp, count(*) AS words, round(avg(b), 8) AS before, round(avg(a), 8) AS after, round(avg(bu::INT), 8) AS unk_before, round(avg(au::INT), 8) AS unk_after FROM g GROUP BY grp""",
)
def extension_report(spark, sf_dir):
    """Pieces per test word before and after the extension, for all, entity and fragmented words, with unknown shares."""
    b = Base(spark, sf_dir)
    after = WP.piece_table(b.words, WP.wordpiece(b.words, V.collected(_extension(b).vocabulary)))
    counted = b.of("test").groupBy("word", (F.col("gold") != "O").alias("is_entity")).agg(F.count("*").alias("n"))
    return _rounded(Fe.extension_report(counted, b.pieces, after), "before", "after", "unk_before", "unk_after")


@CORE.register("extension_usage", f"WITH RECURSIVE {_LEARNED}, u AS (SELECT coalesce(u.n, 0) AS n FROM added a LEFT JOIN usage u USING (piece)) SELECT count(*) AS pieces, min(n) AS least, quantile_cont(n, 0.1) AS p10, quantile_cont(n, 0.5) AS median, count(*) FILTER (WHERE n < 100) AS below_100, count(*) FILTER (WHERE n = 0) AS unused FROM u")
def extension_usage(spark, sf_dir):
    e = _extension(Base(spark, sf_dir))
    return Fe.piece_usage(e.added, e.added)


@CORE.register(
    "extension_sources",
    f"WITH RECURSIVE {_LEARNED}, s AS (SELECT a.piece, unnest(wp.pieces) AS source, unnest(range(len(wp.pieces)))::INT AS pos FROM added a JOIN wp ON wp.word = a.piece) SELECT s.piece, s.pos, b.id AS source_id FROM s JOIN base b ON b.piece = s.source",
)
def extension_sources(spark, sf_dir):
    """The base ids whose vectors make up each added piece's first vector."""
    b = Base(spark, sf_dir)
    return Fe.fvt_sources(_extension(b).added, V.numbered(spark, b.vocabulary), b.tokenize)


@CORE.register(
    "pieces_in_context",
    f"WITH RECURSIVE {SPELLED} SELECT w.sentence_id, w.word_idx, w.word, p.n_pieces AS pieces, p.unk FROM words w JOIN wp p USING (word) WHERE w.split = 'validation'",
)
def pieces_in_context(spark, sf_dir):
    """Pieces of each validation word, found in its whole sentence."""
    b = Base(spark, sf_dir)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"])
    sentences = b.of("validation").groupBy("sentence_id").agg(ordered.alias("tokens"))
    return V.pieces_in_context(sentences, V.with_marks(b.vocabulary), "sentence_id", "tokens")


@CORE.register("heldout_draw")
def heldout_draw(spark, sf_dir):
    """Fifty validation or test sentences whose text no training sentence has, by the seeded draw, numbered anew from 0."""
    from spanframe.plans.tokens import sentence_texts

    texts = stored(sentence_texts(spark, sf_dir))
    drawn = Sa.heldout_sample(texts.filter("split <> 'train'"), texts.filter("split = 'train'"), "text", "sentence_id", 50, 42)
    return Sa.renumbered(drawn, ["sentence_id"]).select("ordinal", "sentence_id", "text")


BUDGET = 126
_CHUNKS = f"""{SPELLED}, seq AS (SELECT row_number() OVER (ORDER BY w.sentence_id, w.word_idx) AS i, w.word, p.n_pieces::BIGINT AS n FROM words w JOIN wp p USING (word)), cum AS (SELECT *, sum(n) OVER (ORDER BY i)::BIGINT AS c FROM seq),
nxt AS MATERIALIZED (SELECT a.i, greatest(b.i, a.i + 1) AS j FROM cum a ASOF JOIN cum b ON a.c - a.n + {BUDGET} < b.c), starts(chunk, i) AS (SELECT 0::BIGINT, min(i) FROM seq HAVING min(i) IS NOT NULL UNION ALL SELECT chunk + 1, j FROM starts JOIN nxt USING (i)),
placed AS (SELECT s.i, s.word, s.n, t.chunk FROM seq s ASOF JOIN starts t ON s.i >= t.i)"""


def _chunks(spark, sf_dir):
    """Chunks of the whole corpus: its sentences in order of id, sizes in pieces."""
    b = Base(spark, sf_dir)
    sized = b.words.join(b.pieces.select("word", "n_pieces"), "word")
    ordered = sized.groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.struct("word_idx", "word", "n_pieces"))).alias("w"))
    lines = ordered.select("sentence_id", F.transform("w", lambda x: x["word"]).alias("words"), F.transform("w", lambda x: x["n_pieces"]).alias("sizes"))
    return packing.packed_text(lines, ["sentence_id"], "words", "sizes", BUDGET), b


@CORE.register("chunk_text", f"WITH RECURSIVE {_CHUNKS} SELECT chunk, string_agg(word, ' ' ORDER BY i) AS words, sum(n)::BIGINT AS pieces, count(*) FILTER (WHERE n > {BUDGET})::INT AS oversized FROM placed GROUP BY chunk")
def chunk_text(spark, sf_dir):
    """The corpus packed into chunks of at most 126 pieces that run on from sentence to sentence."""
    return _chunks(spark, sf_dir)[0].select("chunk", F.array_join("words", " ").alias("words"), "pieces", "oversized")


@CORE.register("chunk_report", f"WITH RECURSIVE {_CHUNKS} SELECT count(DISTINCT chunk) AS chunks, count(*) AS words, sum(n)::BIGINT AS pieces, count(*) FILTER (WHERE n > {BUDGET}) AS oversized FROM placed")
def chunk_report(spark, sf_dir):
    return packing.packing_report(_chunks(spark, sf_dir)[0])


@CORE.register("mask_text")
def mask_text(spark, sf_dir):
    """Masked examples of the chunks of the whole corpus under the vocabulary with its marks."""
    chunks, b = _chunks(spark, sf_dir)
    listed = V.with_marks(b.vocabulary)
    encoded = A.tokenized_words(chunks.select("chunk", "words"), listed, "words")
    return A.masked_examples(encoded, "chunk", listed.index(WP.UNK), len(listed), SEED)
