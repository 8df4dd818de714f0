"""Subject areas of documents by class-association rules.

Transactions are the sentences of hand-labelled documents: the stems of their words and the document's subject. Stems that lean to
no subject are dropped after a first count; parallel FP-growth then finds the frequent sets of what is left. A set with a subject and the
same set without it give a rule; its confidence is taken with the subjects weighted alike, and smoothed. A rule is redundant if a more general one is as sure
within a margin. Its evidence is the log-odds of its confidence.

A sentence goes to the subject with the most evidence among the rules it matches; one of more than some tens of words, as in texts without
punctuation, is cut into windows of words that are scored one by one. Menu lines (lines that recur over the whole corpus),
quotations (of a line, the quoted span only) and lines in another language than the document's are no running text. A document has the subjects whose sentences make up a share of its
running text; as sentences without any matching rule lower all shares, the share asked for is calibrated on labelled documents.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spanframe.functions.text import nfc, without_invisible
from spanframe.llm.batches import slices
from spanframe.llm.words import normal
from spanframe.session import checkpointed

NONE = "none"
#: Most labelled documents the rules are fitted on (a bounded sample by hash of the id).
LABELLED_LIMIT = 20_000
STEM = 6
#: Latin letters of Cyrillic ones (fixed values), so that romanised texts share their stems with Cyrillic ones.
ROMAN = str.maketrans({
    "а": "a", "ә": "ae", "б": "b", "в": "v", "г": "g", "ғ": "gh", "д": "d", "е": "e", "ё": "e", "ж": "j", "з": "z", "и": "i", "й": "i", "к": "k",
    "қ": "q", "л": "l", "м": "m", "н": "n", "ң": "ng", "о": "o", "ө": "oe", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ұ": "u", "ү": "ue",
    "ф": "f", "х": "h", "һ": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sh", "ъ": "", "ы": "y", "і": "i", "ь": "", "э": "e", "ю": "iu", "я": "ia",
})
#: A stem or set must occur in so many sentences, or in this share of them.
LEAST_COUNT, LEAST_SHARE = 3, 1 / 20_000
#: Confidence that a single stem needs to enter the transactions, and a rule to be kept; what a longer rule must gain.
LEANING, CONFIDENCE, GAIN = 0.4, 0.5, 0.05
LONGEST_RULE = 3  # what scoring looks up, too
#: Shares tried in calibration; the one used when there are too few labelled documents to calibrate.
SHARES = tuple(x / 100 for x in range(16, 37, 2))
DEFAULT_SHARE, CALIBRATION_LEAST = 0.26, 200
#: A line is boilerplate if at least so many distinct texts, and this share of them, have it; most such lines.
MENU_LEAST, MENU_SHARE, MOST_MENU = 5, 1 / 500, 200_000
_UNSIGNED = (1 << 64) - 1
#: What ``str.strip`` takes off the ends of a line.
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Most words of a unit: longer runs without sentence ends are cut into even windows of words.
LONGEST_UNIT = 30
QUOTES = ("«", ">", "“", "„", '"')
_CLOSED_BY = {"«": "»", "„": "“”", "“": "”", '"': '"'}
_MARKS = re.compile('[«»„“”"]').finditer
_SENTENCES = re.compile(r"[.!?…]+(?:\s+|$)").split
_WORDS = re.compile(r"\w+").findall
_KAZAKH = "әғқңөұүһі"



def language(line: str) -> str:
    """A coarse language of a lower-case line by its letters: ``kk``, ``ru``, ``tr`` or ``en``.

    Letters outside ASCII are counted from the encoded length. Names with Kazakh letters stand in Russian lines too, and
    single letters beyond ASCII in English ones: the share decides.
    """
    beyond = len(line.encode("utf-8", "surrogatepass")) - len(line)
    if beyond * 10 >= len(line) * 4:
        return "kk" if sum(map(line.count, _KAZAKH)) >= 0.09 * beyond else "ru"
    return "tr" if beyond >= 0.025 * len(line) else "en"


def unquoted(line: str) -> str:
    """A line without its quotations: spans from a quote mark to its closing one, nested ones too, wherever they stand.

    A mark without its partner is no quotation, except one that the line begins with: the whole line is quoted then, as after ``>``.
    A straight mark right after a word only closes, and ``“`` closes ``„`` unless a space stands before it. Linear in the line.
    """
    if line.startswith(">"):
        return ""
    # one search for each mark is faster than one for all of them
    if not ("«" in line or "»" in line or '"' in line or "“" in line or "”" in line or "„" in line):
        return line.strip()
    spans: list[tuple[int, int]] = []
    opened: list[tuple[int, str]] = []
    count = dict.fromkeys(_CLOSED_BY, 0)
    for found in _MARKS(line):
        mark, at = found[0], found.start()
        nested = mark == "“" and (not at or line[at - 1].isspace())
        if not nested and any(count[o] for o, closing in _CLOSED_BY.items() if mark in closing):
            while True:
                start, last = opened.pop()
                count[last] -= 1
                if mark in _CLOSED_BY[last]:
                    break
            while spans and spans[-1][0] > start:
                spans.pop()
            spans.append((start, at + 1))
        elif mark in _CLOSED_BY and not (mark == '"' and at and line[at - 1].isalnum()):
            opened.append((at, mark))
            count[mark] += 1
    if line.startswith(QUOTES) and not (spans and spans[0][0] == 0):
        return ""
    kept, end = [], 0
    for start, stop in spans:
        kept.append(line[end:start])
        end = stop
    return " ".join([*kept, line[end:]]).strip()


def running_text(text: str, menu: frozenset[int]) -> list[list[str]]:
    """The units, as words, of what counts in a text: sentences, and consecutive windows of longer ones. ``menu`` holds codes of lines in normal form."""
    lines = [u for line in normal(text).split("\n") if (s := line.strip()) and line_code(s) not in menu and (u := unquoted(s))]
    if len(lines) > 1:
        # a line in another language than most of the text is a quotation; short lines are too short to tell
        tongue = [language(s) if len(s) >= 25 else "" for s in lines]
        weight: dict[str, int] = {}
        for t, s in zip(tongue, lines, strict=True):
            if t:
                weight[t] = weight.get(t, 0) + len(s)
        if len(weight) > 1:
            main = max(weight, key=lambda t: (weight[t], t))
            lines = [s for t, s in zip(tongue, lines, strict=True) if t in ("", main)]
    units = []
    for s in lines:
        for part in _SENTENCES(s):
            words = _WORDS(part)
            if len(words) > LONGEST_UNIT:
                units += windows(words)
            elif words:
                units.append(words)
    return units


def windows(words: list[str]) -> list[list[str]]:
    """Consecutive windows, as even as can be, of at most :data:`LONGEST_UNIT` words that together are ``words``."""
    if len(words) <= LONGEST_UNIT:
        return [words] if words else []
    n = -(-len(words) // LONGEST_UNIT)
    return [words[len(words) * i // n : len(words) * (i + 1) // n] for i in range(n)]


def stem(word: str) -> str:
    """The first letters of a lower-case word, in Latin script."""
    return word[: STEM + 2].translate(ROMAN)[:STEM]


class _Known(dict):
    """Words and their stem if some rule has it, else None. Emptied when full: a table of results only."""

    def __init__(self, stems: frozenset[str]) -> None:
        super().__init__()
        self.stems = stems

    def __missing__(self, word: str) -> str | None:
        s = stem(word)
        value = s if s in self.stems else None
        if len(word) <= 40:
            if len(self) >= 200_000:
                self.clear()
            self[word] = value
        return value


@dataclass
class Model:
    """Rules by their sets of stems: subject and evidence; codes of the boilerplate lines; the calibrated share."""

    rules: dict[tuple[str, ...], tuple[str, float]]
    menu: frozenset[int]
    share: float = DEFAULT_SHARE
    stems: frozenset[str] = field(default=frozenset())
    longest: int = 1

    def __post_init__(self) -> None:
        self.stems = frozenset(s for r in self.rules for s in r)
        self.longest = max((len(r) for r in self.rules), default=1)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _tables(self) -> tuple[_Known, dict, dict]:
        """Per worker: stems of known words, rules of one stem, and for longer ones by first and second stem their rule and those by the third."""
        tables = self.__dict__.get("_made")
        if tables is None:
            following: dict[str, dict[str, list]] = {}
            for stems, rule in self.rules.items():
                if len(stems) > 1:
                    entry = following.setdefault(stems[0], {}).setdefault(stems[1], [None, {}])
                    if len(stems) == 2:
                        entry[0] = rule
                    else:
                        entry[1][stems[2]] = rule
            tables = self._made = _Known(self.stems), {r[0]: x for r, x in self.rules.items() if len(r) == 1}, following
        return tables

    def shares(self, text: str | None) -> dict[str, float]:
        """Each subject's share of the running text; empty for a text without any."""
        if not text:
            return {}
        found: dict[str, int] = defaultdict(int)
        total = 0
        known_stem, single, following = self._tables()
        for words in running_text(text, self.menu):
            total += len(words)
            known = sorted({s for w in words if (s := known_stem[w]) is not None})
            if not known:
                continue
            matched = [single[s] for s in known if s in single]
            third = []
            for i, a in enumerate(known):
                after = following.get(a)
                if after is None:
                    continue
                for j in range(i + 1, len(known)):
                    entry = after.get(known[j])
                    if entry is not None:
                        if entry[0] is not None:
                            matched.append(entry[0])
                        if entry[1]:
                            third += [entry[1][c] for c in known[j + 1 :] if c in entry[1]]
            evidence: dict[str, float] = {}
            for subject, weight in matched + third:
                evidence[subject] = evidence.get(subject, 0.0) + weight
            if evidence:
                best = max(evidence, key=lambda s: (evidence[s], s))
                if best != NONE:
                    found[best] += len(words)
        return {s: n / total for s, n in found.items()}

    def subjects(self, text: str | None, share: float | None = None) -> list[str]:
        least = self.share if share is None else share
        return sorted(s for s, x in self.shares(text).items() if x >= least)


def line_code(line: str) -> int:
    """The 64-bit code of a line in normal form, equal to ``xxhash64`` of the JVM."""
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)


def menu_lines(docs: DataFrame, text: str = "text") -> frozenset[int]:
    """Codes of the lines, in normal form, that recur over the distinct texts of the corpus: copies of a text, by its hash, count once, however many ids they have.

    Only codes are shuffled, in one pass: a code that every text has counts the texts. As texts have a bounded number of lines on average, the lines
    that a share of all texts have are bounded by 1 / MENU_SHARE times that; more than :data:`MOST_MENU` are an error, none is left out.
    """
    plain = F.lower(nfc(without_invisible(text)))
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x, F.lit(SPACES))), lambda x: x != "")
    codes = F.array_append(F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x))), F.lit(None).cast("long"))
    each = docs.filter(F.col(text).isNotNull()).select(F.xxhash64(text).alias("id"), F.explode(codes).alias("line")).distinct()
    counted = each.groupBy("line").count().filter(F.col("count") >= MENU_LEAST)
    found = counted.orderBy(F.desc("count"), F.asc_nulls_first("line")).limit(MOST_MENU + 1).collect()
    # all texts have the first one
    total = found[0][1] if found else 0
    least = max(MENU_LEAST, math.ceil(total * MENU_SHARE))
    heavy = frozenset(r[0] & _UNSIGNED for r in found if r[0] is not None and r[1] >= least)
    if len(heavy) >= MOST_MENU:
        raise ValueError(f"more than {MOST_MENU} lines recur: these texts aren't pages with menus")
    return heavy


def label_sets(labels: DataFrame, limit: int = LABELLED_LIMIT) -> DataFrame:
    """``doc_id, subjects``: at most ``limit`` labelled documents, by hash of the id."""
    known = labels.filter("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("subjects"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def _transactions(labelled: DataFrame, menu: frozenset[int]) -> DataFrame:
    """``subject, stems`` of the sentences of labelled documents; of a document with several subjects they count for each, as nothing tells which one they are about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_stem = lru_cache(200_000)(stem)
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                subject, stems = [], []
                for labels, text in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist(), strict=True):
                    for words in running_text(text, menu) if text else ():
                        own = sorted(set(map(known_stem, words)))
                        for label in labels:
                            subject.append(label)
                            stems.append(own)
                if subject:
                    yield pa.RecordBatch.from_arrays([pa.array(subject, pa.string()), pa.array(stems, pa.list_(pa.string()))], ["subject", "stems"])

    return labelled.select("subjects", "text").mapInArrow(run, "subject string, stems array<string>")


def mine_rules(transactions: DataFrame) -> dict[tuple[str, ...], tuple[str, float]]:
    """Class-association rules of ``subject, stems`` transactions: {stems: (subject, evidence)}."""
    sizes = {r[0]: r[1] for r in transactions.groupBy("subject").count().collect()}
    total = sum(sizes.values())
    if not total:
        return {}
    least = max(LEAST_COUNT, math.ceil(total * LEAST_SHARE))

    def confidence(counts: dict[str, int]) -> tuple[str, float]:
        """(subject, share) of the leaning subject when all subjects have equally many sentences, smoothed by one half of a typical sentence."""
        rate = {s: (counts.get(s, 0) + 0.5 / len(sizes)) / n for s, n in sizes.items()}
        best = max(rate, key=lambda s: (rate[s], s))
        return best, rate[best] / sum(rate.values())

    # first count, as for the header of the tree: stems that are frequent and lean to a subject
    counted = transactions.select("subject", F.explode("stems").alias("stem")).groupBy("stem", "subject").count()
    by_stem: dict[str, dict[str, int]] = defaultdict(dict)
    for stem, subject, n in counted.collect():
        by_stem[stem][subject] = n
    leaning = {s for s, c in by_stem.items() if sum(c.values()) >= least and confidence(c)[1] >= LEANING}
    if not leaning:
        return {}
    spark = transactions.sparkSession
    keep = spark.sparkContext.broadcast(leaning)

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[*own, "\x00" + subject] for subject, stems in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (own := [s for s in stems if s in keep.value])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], ["items"])

    items = transactions.select("subject", "stems").mapInArrow(narrowed, "items array<string>")
    mined = FPGrowth(itemsCol="items", minSupport=least / total, minConfidence=1.0, numPartitions=spark.sparkContext.defaultParallelism).fit(items)
    counts: dict[tuple[str, ...], dict[str, int]] = defaultdict(dict)
    frequent = mined.freqItemsets.filter((F.size("items") <= LONGEST_RULE + 1) & F.exists("items", lambda x: x.startswith("\x00")) & (F.size("items") > 1))
    for found, n in frequent.collect():
        subject = next(x for x in found if x[0] == "\x00")[1:]
        counts[tuple(sorted(x for x in found if x[0] != "\x00"))][subject] = n
    rules: dict[tuple[str, ...], tuple[str, float]] = {}
    sure: dict[tuple[str, ...], tuple[str, float]] = {}
    for stems in sorted(counts, key=lambda s: (len(s), s)):
        # single stems have their full counts, below the frequent ones too
        best, conf = sure[stems] = confidence(by_stem[stems[0]] if len(stems) == 1 else counts[stems])
        general = [sure[g] for n in range(1, len(stems)) for g in combinations(stems, n) if g in sure]
        if conf >= CONFIDENCE and all(g[0] != best or conf >= g[1] + GAIN for g in general):
            rules[stems] = best, math.log(conf / (1 - conf + 1e-3))
    return rules


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED_LIMIT) -> Model:
    """The rules and the calibrated share from labelled documents. Without labels the model has no rules."""
    menu = menu_lines(docs)
    chosen = label_sets(labels, limit)
    # bounded by the limit, read several times: the corpus is scanned for it once
    labelled = checkpointed(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "subjects"))
    model = Model(mine_rules(checkpointed(_transactions(labelled, menu))), menu)
    if model.rules:
        model.share = calibrate(labelled, model)
    return model


def calibrate(labelled: DataFrame, model: Model) -> float:
    """The share of :data:`SHARES` with the best F1 against the labels, middle one of ties; the default where labels are few."""
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [[0, 0, 0] for _ in SHARES]
        rows = 0
        for batch in batches:
            for text, subjects in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += 1
                gold, shares = set(subjects) - {NONE}, shared.value.shares(text)
                for i, least in enumerate(SHARES):
                    found = {s for s, x in shares.items() if x >= least}
                    counts[i][0] += len(found & gold)
                    counts[i][1] += len(found)
                    counts[i][2] += len(gold)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([rows] * len(SHARES)), pa.array(range(len(SHARES))), *(pa.array([c[k] for c in counts]) for k in range(3))], ["docs", "i", "hit", "found", "gold"])

    sums = labelled.select("text", "subjects").mapInArrow(run, "docs long, i long, hit long, found long, gold long").groupBy("i").agg(*(F.sum(c) for c in ("docs", "hit", "found", "gold"))).collect()
    if not sums or sums[0][1] < CALIBRATION_LEAST:
        return DEFAULT_SHARE
    f1 = {r[0]: 2 * r[2] / max(1, r[3] + r[4]) for r in sums}
    best = sorted(i for i in f1 if f1[i] >= max(f1.values()) - 1e-9)
    return SHARES[best[len(best) // 2]]


def assign(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, subject, share``: the subjects of each document; documents about none give no row.

    Null and empty texts, and texts without running text, give no row. Repeated documents give repeated rows; extra columns are ignored. One
    narrow pass over whole texts; the model is bounded by the labelled sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("subject", T.StringType()), T.StructField("share", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                rows = [(k, s, x) for k, t in zip(*(c.slice(lo, hi - lo).to_pylist() for c in batch.columns), strict=True) for s, x in sorted(m.shares(t).items()) if x >= m.share]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return docs.select(doc_id, text).mapInArrow(run, schema)
