"""Queries: checks of predictions against gold and of runs against each other, alignment under WordPiece, set equality, samples numbered anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe.operators import align as A
from spanframe.operators import contract as C
from spanframe.operators import registry as R
from spanframe.operators import sampling as Sa
from spanframe.operators import spans as S
from spanframe.operators import vocabulary as V
from spanframe.plans import sql
from spanframe.plans.registry import CORE
from spanframe.plans.runs import RUNS, registered
from spanframe.plans.spans import words
from spanframe.plans.tokens import WORDS, split_words, test_contract
from spanframe.plans.wordpiece import SPELLED, Base
from spanframe.session import table


@CORE.register(
    "prefix_mismatches",
    f"""WITH {sql.CONTRACT}, gold AS (SELECT sentence_id, word_idx, min(word) AS gold_word FROM contract WHERE word_idx < 8 GROUP BY ALL)
    SELECT c.run_id, c.sentence_id, c.word_idx, c.word, g.gold_word FROM contract c LEFT JOIN gold g USING (sentence_id, word_idx) WHERE g.gold_word IS NULL OR g.gold_word <> c.word""",
)
def prefix_mismatches(spark, sf_dir):
    """Predicted words that aren't the gold word of their place, the gold sentences cut at eight words."""
    w = words(spark, sf_dir)
    gold = w.filter("word_idx < 8").groupBy("sentence_id", "word_idx").agg(F.min("word").alias("word"))
    return C.prefix_mismatches(gold, w)


@CORE.register(
    "same_test_sets",
    f"""WITH {sql.CONTRACT}, SETS AS (SELECT run_id, count(*) AS words, string_agg(sentence_id || ' ' || word_idx || ' ' || coalesce(word, chr(1)) || ' ' || gold, chr(2) ORDER BY sentence_id, word_idx) AS s FROM contract GROUP BY run_id)
    SELECT words, list(run_id ORDER BY run_id) AS runs FROM sets GROUP BY words, s""",
)
def same_test_sets(spark, sf_dir):
    """The distinct test sets of all runs, by words and gold labels, with the runs over each."""
    return C.different_sets(words(spark, sf_dir)).select("words", "runs")


@CORE.register(
    "set_differences",
    """WITH a AS (SELECT DISTINCT sentence_id FROM predictions WHERE coalesce(gold, 'O') <> 'O'), b AS (SELECT DISTINCT sentence_id FROM predictions WHERE coalesce(pred, 'O') <> 'O')
    SELECT sentence_id, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT sentence_id, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def set_differences(spark, sf_dir):
    """Sentences with gold entities only, or predicted ones only: empty if the two sets were equal."""
    p = table(spark, sf_dir, "predictions")
    a, b = (p.filter(F.coalesce(c, F.lit("O")) != "O").select("sentence_id") for c in ("gold", "pred"))
    return C.set_differences(a, b)


@CORE.register(
    "sample_renumbered",
    """SELECT sentence_id, row_number() OVER (ORDER BY sentence_id) - 1 AS ordinal FROM (SELECT DISTINCT sentence_id FROM sentences) WHERE ((sentence_id % 1000003 + 7) * 2654435761) % 4294967296 < 858993459""",
)
def sample_renumbered(spark, sf_dir):
    """A fifth of the sentences by the arithmetic hash, numbered anew from 0."""
    every = table(spark, sf_dir, "sentences").select("sentence_id").distinct()
    return Sa.renumbered(Sa.hash_sample(every, "sentence_id", 0.2, 7), ["sentence_id"]).select("sentence_id", "ordinal")


@CORE.register(
    "best_epoch",
    f"WITH {RUNS}, e AS (SELECT config.method.name AS method, config.seed AS epoch, max(metrics.test_contract.f1) AS f1 FROM done GROUP BY ALL) SELECT method, arg_max(epoch, f1 - coalesce(epoch, 0) * 1e-9)::BIGINT AS epoch, max(f1) AS f1 FROM e WHERE method IS NOT NULL AND epoch IS NOT NULL GROUP BY method",
)
def best_epoch(spark, sf_dir):
    """The best of each method's numbered results (seeds stand for epochs), the first of equals."""
    done = R.completed(registered(spark, sf_dir)).select(F.col("config.method.name").alias("method"), F.col("config.seed").alias("epoch"), F.col("metrics.test_contract.f1").alias("f1"))
    rows = done.filter("method is not null and epoch is not null").groupBy("method", "epoch").agg(F.max("f1").alias("f1"))
    return Sa.best_epoch(rows, ["method"])


#: Positions of an encoded sentence, marks included.
MAX_LEN = 24
_ENCODED = f"""{SPELLED}, labels AS (SELECT gold AS label, row_number() OVER (ORDER BY gold) - 1 AS id FROM (SELECT DISTINCT gold FROM words)),
parts AS (SELECT w.sentence_id, w.word_idx, l.id AS label, unnest(range(p.n_pieces)) AS k FROM words w JOIN wp p USING (word) JOIN labels l ON l.label = w.gold),
placed AS (SELECT *, row_number() OVER (PARTITION BY sentence_id ORDER BY word_idx, k) AS pos FROM parts), kept AS (SELECT * FROM placed WHERE pos <= {MAX_LEN - A.RESERVED})"""


def _encoded(spark, sf_dir):
    """``sentence_id, labels, n_words, word_ids`` of all sentences, encoded and cut."""
    b = Base(spark, sf_dir)
    names = sorted(r[0] for r in b.words.select("gold").distinct().collect())
    number = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("gold")).cast("int") - 1
    rows = b.words.groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.struct("word_idx", "word", number.alias("id")))).alias("w"))
    tokens = rows.select("sentence_id", F.transform("w", lambda x: x["word"]).alias("tokens"), F.transform("w", lambda x: x["id"]).alias("labels"))
    return A.tokenized_words(tokens, V.with_marks(b.vocabulary), "tokens", MAX_LEN), names


@CORE.register(
    "aligned_labels",
    f"WITH RECURSIVE {_ENCODED} SELECT sentence_id, list_concat([-100], list((CASE WHEN k = 0 THEN label ELSE -100 END)::INT ORDER BY pos), [-100]) AS labels FROM kept GROUP BY sentence_id",
)
def aligned_labels(spark, sf_dir):
    """Label ids of every position of all sentences under the WordPiece vocabulary, cut at 24 positions."""
    encoded, _ = _encoded(spark, sf_dir)
    return encoded.select("sentence_id", A.align_labels("word_ids", "labels").alias("labels"))


@CORE.register("first_positions", f"WITH RECURSIVE {_ENCODED} SELECT sentence_id, word_idx, min(pos)::INT AS pos FROM kept GROUP BY ALL")
def first_positions(spark, sf_dir):
    """The first position of each word that has one."""
    encoded, _ = _encoded(spark, sf_dir)
    return A.first_positions(encoded, "sentence_id")


@CORE.register(
    "words_cut_off",
    f"WITH RECURSIVE {_ENCODED} SELECT w.sentence_id, list(w.word_idx ORDER BY w.word_idx) AS cut FROM words w ANTI JOIN kept k ON k.sentence_id = w.sentence_id AND k.word_idx = w.word_idx GROUP BY w.sentence_id",
)
def words_cut_off(spark, sf_dir):
    """The words of all sentences that have no position."""
    encoded, _ = _encoded(spark, sf_dir)
    return encoded.select("sentence_id", F.array_sort(A.truncated_words("word_ids", F.size("tokens"))).alias("cut")).filter("size(cut) > 0")


@CORE.register(
    "first_subword_predictions",
    f"""WITH RECURSIVE {_ENCODED}, first AS (SELECT sentence_id, word_idx, min(pos) AS pos FROM kept GROUP BY ALL), best AS (SELECT sentence_id, word_idx, ['O', 'B-PERSON', 'I-PERSON'][1 + (sentence_id + pos) % 3] AS pred FROM first)
    SELECT w.sentence_id, w.word_idx, w.word, w.gold, coalesce(pred, 'O') AS pred, pred IS NULL AS truncated FROM words w LEFT JOIN best USING (sentence_id, word_idx)""",
)
def first_subword_predictions(spark, sf_dir):
    """Word predictions from scores of positions: that of a word's first subword counts; words cut off are ``O`` and truncated."""
    encoded, _ = _encoded(spark, sf_dir)
    scores = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.when(k == (F.col("sentence_id") + F.col("pos")) % 3, F.lit(1.0)).otherwise(0.0))
    each = encoded.select("sentence_id", F.posexplode("word_ids").alias("pos", "word_id"))
    labels = F.array(*(F.lit(x) for x in ("O", "B-PERSON", "I-PERSON")))
    return C.first_subword_predictions(each.select("sentence_id", "pos", "word_id", scores.alias("scores"), labels.alias("labels")), split_words(spark, sf_dir).select("sentence_id", "word_idx", "word", "gold"))


@CORE.register(
    "trainer_scores",
    f"""WITH RECURSIVE {_ENCODED}, contract2 AS (SELECT 'trainer' AS run_id, k.sentence_id, k.pos AS word_idx, '' AS word, l.label AS gold, CASE WHEN (k.sentence_id + k.pos) % 4 = 0 THEN 'O' ELSE l.label END AS pred FROM kept k JOIN labels l ON l.id = k.label WHERE k.k = 0),
    {sql.spans("contract2")}, {sql.prf()} SELECT * FROM prf""",
)
def trainer_scores(spark, sf_dir):
    """Scores in a trainer's view: positions with a label only, words cut off are missing. Every fourth position is predicted as ``O``."""
    encoded, names = _encoded(spark, sf_dir)
    aligned = encoded.select("sentence_id", A.align_labels("word_ids", "labels").alias("label_ids"))
    outside = names.index("O")
    predicted = F.transform("label_ids", lambda x, i: F.when((F.col("sentence_id") + i) % 4 == 0, F.lit(outside)).otherwise(x))
    return S.prf(C.labelled_positions(aligned.withColumn("pred_ids", predicted), names))


@CORE.register(
    "chunk_pack",
    f"""WITH RECURSIVE {WORDS}, cum AS (SELECT sentence_id, word_idx, word, n_pieces::BIGINT AS n, row_number() OVER (PARTITION BY sentence_id ORDER BY word_idx) AS i, sum(n_pieces) OVER (PARTITION BY sentence_id ORDER BY word_idx)::BIGINT AS c FROM words JOIN pieces USING (word)),
    nxt AS MATERIALIZED (SELECT a.sentence_id, a.i, greatest(b.i, a.i + 1) AS j FROM cum a ASOF JOIN cum b ON a.sentence_id = b.sentence_id AND a.c - a.n + 16 < b.c),
    starts(sentence_id, chunk, i) AS (SELECT DISTINCT sentence_id, 0, 1::BIGINT FROM cum UNION ALL SELECT sentence_id, chunk + 1, j FROM starts JOIN nxt USING (sentence_id, i)),
    placed AS (SELECT c.*, s.chunk FROM cum c ASOF JOIN starts s ON c.sentence_id = s.sentence_id AND c.i >= s.i)
    SELECT sentence_id, chunk::INT AS chunk, list(word ORDER BY i) AS words, sum(n)::BIGINT AS pieces FROM placed GROUP BY sentence_id, chunk""",
)
def chunk_pack(spark, sf_dir):
    """Chunks of at most sixteen pieces of all sentences of every split; this packing restarts with each sentence (``chunk_text`` runs on)."""
    from spanframe.plans.general import chunk_pack as packed

    return packed(spark, sf_dir)


@CORE.register("truncated_share", f"WITH {WORDS}, t AS (SELECT c.* FROM contract c JOIN splits s USING (sentence_id) WHERE s.split = 'test') SELECT run_id, count(DISTINCT sentence_id) AS sentences, count(*) AS words, count(*) FILTER (WHERE truncated) AS truncated_words, count(*) FILTER (WHERE gold = pred)::DOUBLE / count(*) AS accuracy FROM t GROUP BY run_id")
def truncated_share(spark, sf_dir):
    """Word counts and accuracy of each run over the test sentences."""
    return S.token_accuracy(test_contract(spark, sf_dir), ["run_id"])
