"""Same and near-same records across splits, by a partitioned suffix array.

Each record's text is its distinct words in one global order, rare words first. The texts' suffixes are partitioned by their first words (the
head) and sorted; where suffixes of both splits share a head, their common prefix is a span that both texts have. Spans of a pair of
texts are merged into the coverage of the record, and what the spans leave open is counted exactly.

Which pairs can be missed? None. Let the sets have Jaccard similarity ``num/den`` or more, i words in common and D words that only one has:
D <= i(den - num)/num. In the global order the D words break the i common ones into at most D + 1 runs, so among the first 2D + 3 common words
three follow each other in both texts, and among the first D + 2 two do. Heads have three words wherever there are 2D + 3 common words,
else two (at 4/5 that is only the pair of four words inside five). Only as many suffixes as this needs are made. Before a pair is looked at,
lengths, places and 64-bit signatures of the two sets must allow so few differing words; these tests only leave out what can't qualify.

Records with equal word sets are one class: search and counts run over classes, members are joined back only where a list of pairs is
asked for. Words are compared through 62-bit codes until the last, exact count, which compares the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions.text import match_words
from spanframe.session import stored

#: Words that come last in the global order, because they are in most texts. Any choice gives the same result.
FREQUENT_WORDS = 1_000
#: Heads of more suffixes than this are spread over ``SALTS`` tasks.
HOT_HEAD, SALTS = 4_096, 32
_CODE_BITS = 62


def sentence_words(predictions: DataFrame) -> DataFrame:
    """``sentence_id, words``: the match words of each sentence in order, repeats kept.

    Runs write a word differently only in ways that match words ignore; else the least spelling of a position is taken. Words are put in
    normal form once per sentence: no blank composes with what follows it.
    """
    words = predictions.filter("word is not null and sentence_id is not null").select("sentence_id", F.struct("word_idx", "word").alias("x"))
    ordered = words.groupBy("sentence_id").agg(F.array_sort(F.collect_set("x")).alias("x"))
    first = F.filter("x", lambda e, i: (i == 0) | ~e["word_idx"].eqNullSafe(F.get("x", i - 1)["word_idx"]))
    # a column of its own: the text is joined once, however often the normal form looks at it
    joined = ordered.select("sentence_id", F.array_join(F.transform(first, lambda e: e["word"]), " ").alias("text"))
    return joined.select("sentence_id", match_words("text").alias("words"))


def classes(records: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(classes, members): ``key, words, size, in_train, in_eval`` and ``key, id, is_train``.

    ``records`` has ``id, split, words``; those of fewer than ``min_words`` words or of no known split are left out. A class is the records of
    one word set; its key is a 128-bit digest of the set.
    """
    fit = records.filter((F.size("words") >= min_words) & F.col("split").isNotNull() & F.col("id").isNotNull())
    keyed = fit.select("id", (F.col("split") == "train").alias("is_train"), F.array_sort(F.array_distinct("words")).alias("words"))
    # read several times, by column: written once
    keyed = stored(keyed.withColumn("key", F.unhex(F.md5(F.array_join("words", " ")))))
    grouped = keyed.groupBy("key").agg(F.first("words").alias("words"), F.max("is_train").alias("in_train"), F.max(~F.col("is_train")).alias("in_eval"))
    return stored(grouped.withColumn("size", F.size("words"))), keyed.select("key", "id", "is_train")


def _code(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND((1 << _CODE_BITS) - 1)


def frequent_codes(grouped: DataFrame) -> list[int]:
    """Codes of the most frequent words: at most :data:`FREQUENT_WORDS`, whatever the corpus."""
    counted = grouped.select(F.explode(F.transform("words", _code)).alias("c")).groupBy("c").count()
    return [r[0] for r in counted.orderBy(F.desc("count"), "c").limit(FREQUENT_WORDS).collect()]


def two_word_sizes(num: int, den: int) -> tuple[list[int], int]:
    """(set sizes that need heads of two words, least size that needs heads of three) for similarities of at least num/den."""

    def differing(shared: int) -> int:
        return shared * (den - num) // num

    # from 3 · 3 common words on 2D + 3 <= i holds for every threshold of 3/4 and above
    short = [i for i in range(1, 12) if differing(i) and 2 * differing(i) + 3 > i]
    two = sorted({i + own for i in short for own in range(differing(i) + 1)})
    # at similarity 1 no two different sets match
    three = next((a for a in range(1, 4 * den) if any(differing(a - own) >= max(1, own) and a - own not in short for own in range(a))), (1 << 31) - 1)
    return two, three


def text(words: Column | str, frequent: list[int]) -> Column:
    """The codes of a word set in the global order: rare words first."""

    def ordered(word: Column) -> Column:
        code = _code(word)
        return F.when(code.isin(frequent), code + (1 << _CODE_BITS)).otherwise(code) if frequent else code

    return F.array_sort(F.transform(words, ordered))


def suffixes(grouped: DataFrame, frequent: list[int], num: int, den: int) -> DataFrame:
    """``key, size, in_train, in_eval, bits, head, pos``: the suffixes at the positions where a shared head must lie; what follows the head stays in the text."""
    two, three = two_word_sizes(num, den)
    a = F.col("size")
    own = F.floor(a * (den - num) / F.lit(den)).cast("int")
    # own words that may stand between, then 2D + 3 common ones with D for a - own common words; more positions do no harm
    needed = F.floor(2 * (a - own) * (den - num) / F.lit(num)).cast("int") + 3 + own
    texts = grouped.select("key", "size", "in_train", "in_eval", text("words", frequent).alias("codes"), needed.alias("needed"))

    def heads(width: int, last: Column) -> Column:
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.xxhash64(F.slice("codes", i + 1, F.lit(width))).alias("head"), i.alias("pos")))

    none = F.array().cast("array<struct<head:bigint,pos:int>>")
    each = F.concat(F.when(a >= three, heads(3, F.least(a, F.col("needed")) - 3)).otherwise(none), F.when(a.isin(two), heads(2, a - 2)).otherwise(none))
    bits = F.aggregate("codes", F.lit(0).cast("long"), lambda x, c: x.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(c, F.lit(64)).cast("int"))))
    return texts.select("key", "size", "in_train", "in_eval", bits.alias("bits"), F.explode(each).alias("x")).select("key", "size", "in_train", "in_eval", "bits", "x.*")


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    differs = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    at = F.array_position(differs, F.lit(True)).cast("int")
    return F.when(at == 0, F.size(differs)).otherwise(at - 1)


def seeds(grouped: DataFrame, frequent: list[int], num: int, den: int) -> DataFrame:
    """``train_key, eval_key, t_pos, e_pos``: where suffixes of both splits share their head; pairs that can't qualify are left out."""
    every = suffixes(grouped, frequent, num, den)
    # flags by head collapse before they move, however many suffixes a head has
    heads = every.groupBy("head").agg(F.max("in_train").alias("_t"), F.max("in_eval").alias("_e"), F.count("*").alias("n")).filter("_t and _e").select("head", (F.col("n") > HOT_HEAD).alias("hot"))
    # few heads stand in both splits: with their true size known, a small table of them is broadcast and a large one merged;
    # what is left is written once and read for either side
    crossing = stored(every.join(stored(heads), "head"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left, right = (crossing.filter(side).select("head", *(F.col(c).alias(p + c) for c in ("key", "size", "bits", "pos")), s.alias("salt")) for side, p, s in (("in_train", "t_", salt), ("in_eval", "e_", F.explode(salts))))
    both = F.col("t_size") + F.col("e_size")
    tail = (F.col("t_size") - F.col("t_pos")) - (F.col("e_size") - F.col("e_pos"))
    # words that only one text has: before and after the shared head, and by the signatures
    least = F.greatest(F.abs(F.col("t_pos") - F.col("e_pos")) + F.abs(tail), F.bit_count(F.col("t_bits").bitwiseXOR(F.col("e_bits"))))
    pairs = left.join(right, ["head", "salt"]).filter((F.col("t_key") != F.col("e_key")) & (least * (den + num) <= both * (den - num)))
    return pairs.select(F.col("t_key").alias("train_key"), F.col("e_key").alias("eval_key"), "t_pos", "e_pos")


def class_pairs(grouped: DataFrame, frequent: list[int], num: int = 4, den: int = 5) -> DataFrame:
    """``train_key, eval_key, shared, united, covered``: the pairs of different classes, one with training and one with evaluation records.

    ``covered``: words of the evaluation text in merged shared spans; ``shared`` adds the common words that stand alone.
    """
    found = seeds(grouped, frequent, num, den).groupBy("train_key", "eval_key").agg(F.collect_set(F.struct("t_pos", "e_pos")).alias("at"))
    words = grouped.select("key", "words")
    both = found.join(words.select(F.col("key").alias("eval_key"), F.col("words").alias("ew")), "eval_key").join(words.select(F.col("key").alias("train_key"), F.col("words").alias("tw")), "train_key")
    counted = both.withColumn("shared", F.size(F.array_intersect("ew", "tw"))).withColumn("united", F.size("ew") + F.size("tw") - F.col("shared"))
    similar = counted.filter(F.col("shared") * den >= F.col("united") * num).withColumns({"tt": text("tw", frequent), "et": text("ew", frequent)})

    def span(seed: Column) -> Column:
        rest = [F.slice(t, seed[p] + 1, F.size(t)) for t, p in (("tt", "t_pos"), ("et", "e_pos"))]
        return F.sequence(seed["e_pos"], seed["e_pos"] + common_prefix(*rest) - 1)

    covered = F.size(F.array_distinct(F.flatten(F.transform("at", span))))
    return similar.select("train_key", "eval_key", "shared", "united", covered.alias("covered"))


def overlap(records: DataFrame, num: int = 4, den: int = 5, min_words: int = 6) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): ``train_key, eval_key, shared, united, covered`` of all overlapping classes, a class with itself too, and ``key, id, is_train``.

    The compact form of :func:`cross_split_pairs`: copies aren't expanded. A pair of classes stands for every pair of their members.
    """
    if 4 * num < 3 * den:
        raise ValueError("the search is exact for thresholds of 3/4 and above")
    grouped, members = classes(records, min_words)
    size = F.col("size")
    same = grouped.filter("in_train and in_eval").select(F.col("key").alias("train_key"), F.col("key").alias("eval_key"), size.alias("shared"), size.alias("united"), size.alias("covered"))
    return class_pairs(grouped, frequent_codes(grouped), num, den).unionByName(same), members


def cross_split_pairs(records: DataFrame, num: int = 4, den: int = 5, min_words: int = 6) -> DataFrame:
    """``train_id, eval_id, shared, united``: all pairs across splits with den·shared ≥ num·united over their word sets.

    ``records`` has ``id, split, words`` (``words`` with repeats); ``split`` is ``train`` or any other known name. Records with fewer than
    ``min_words`` words, null ids, splits or words give no pairs; equal rows give one pair; extra columns are ignored; an
    empty table gives none. Every member of a class is paired: the result is as large as the overlap is.
    """
    pairs, members = overlap(records, num, den, min_words)
    train = members.filter("is_train").select(F.col("key").alias("train_key"), F.col("id").alias("train_id")).distinct()
    evaluation = members.filter("not is_train").select(F.col("key").alias("eval_key"), F.col("id").alias("eval_id")).distinct()
    return pairs.join(evaluation, "eval_key").join(train, "train_key").select("train_id", "eval_id", "shared", "united")


def record_coverage(records: DataFrame, num: int = 4, den: int = 5, min_words: int = 6) -> DataFrame:
    """``id, train_records, coverage``: the evaluation records that overlap training records, how many, and the largest share of their words in one.

    Counted over classes: no pair of members is made. Inputs as for :func:`cross_split_pairs`.
    """
    pairs, members = overlap(records, num, den, min_words)
    train = members.filter("is_train").groupBy(F.col("key").alias("train_key")).agg(F.count_distinct("id").alias("n"))
    # sizes from the two counts: united = both sizes less shared; the evaluation text's own size comes with its pairs
    found = pairs.join(train, "train_key").groupBy("eval_key").agg(F.sum("n").alias("train_records"), F.max("shared").alias("shared"))
    evaluation = members.filter("not is_train").select(F.col("key").alias("eval_key"), "id").distinct()
    sizes = records.select("id", F.size(F.array_distinct("words")).alias("size")).groupBy("id").agg(F.max("size").alias("size"))
    return found.join(evaluation, "eval_key").join(sizes, "id").select("id", "train_records", (F.col("shared") / F.col("size")).alias("coverage"))
