"""Oversized documents cut into pieces at natural boundaries, with overlap, by agglomerative merging.

The atoms of a text are its words (a word larger than a piece is cut between code points). Between neighbours lies a
boundary of known strength: inside a word, between words, sentences, lines. Adjacent pairs wait in a heap; the weakest boundary,
and among equals the one of the smallest union, then the first, is merged while union and overlap fit the limit. What can't grow any more is
a piece; it is extended to the left by the overlap, which is met exactly: whole words first, then the end of the word before them.

A sentence or line that fits as a whole always ends up merged before any stronger boundary is looked at, so it enters as one atom: the same
result with a much smaller heap.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spanframe.llm.batches import slices
from spanframe.operators.curation import prefix_sums
from spanframe.session import stored

DEFAULT_LIMIT = 128
#: Places in a piece that belong to the model's own marks.
RESERVED = 2
#: Runs whose settings one pass over the documents carries.
RUN_BLOCK = 5_000
_WORD = re.compile(r"[^ \t\r\n]+")
_WORDS = _WORD.findall
_SENTENCE_END = re.compile(r"[.!?…؟。]+[\"'»”’)\]]*$").search
IN_WORD, WORDS, SENTENCES, LINES = range(4)


def word_size(length: int) -> int:
    """The size of a word of ``length`` code points: one per four, rounded up."""
    return (length + 3) // 4


def text_size(text: str) -> int:
    return sum([(len(w) + 3) >> 2 for w in _WORDS(text)])


@dataclass(frozen=True)
class Setting:
    """A run's limit of a piece (without the model's marks), wanted overlap, and most pieces (None: any number)."""

    run: str
    budget: int
    overlap: int = 0
    most: int | None = None

    @property
    def shared(self) -> int:
        """The overlap in use: the one asked for. One that leaves a piece no room can't be met: half of the piece then (:func:`settings_of` names such runs)."""
        return self.budget // 2 if self.overlap >= self.budget else max(0, self.overlap)

    @property
    def core(self) -> int:
        return self.budget - self.shared


class Words:
    """The words of a text: bounds, running size, and the strength of the boundary after each."""

    def __init__(self, text: str) -> None:
        self.start: list[int] = []
        self.end: list[int] = []
        self.after: list[int] = []
        before = [0]
        size = 0
        base = 0
        for line in re.split(r"[\r\n]", text):
            for m in _WORD.finditer(line):
                s, e = m.span()
                self.start.append(base + s)
                self.end.append(base + e)
                size += (e - s + 3) >> 2
                before.append(size)
                self.after.append(SENTENCES if _SENTENCE_END(m.group()) else WORDS)
            if self.after:
                self.after[-1] = LINES
            base += len(line) + 1
        self.before = before  # size of all words before each
        self.size = size

    def atoms(self, core: int) -> tuple[list[tuple[int, int]], list[int], list[int]]:
        """(bounds, sizes, strengths after) of the atoms: lines and sentences that fit ``core``, else their words, cut if need be."""
        bounds: list[tuple[int, int]] = []
        sizes: list[int] = []
        after: list[int] = []

        def add(lo: int, hi: int) -> None:
            bounds.append((self.start[lo], self.end[hi - 1]))
            sizes.append(self.before[hi] - self.before[lo])
            after.append(self.after[hi - 1])

        def parts(lo: int, hi: int, level: int) -> None:
            """Words ``lo`` to ``hi`` as atoms: whole if they fit, else by the boundaries of ``level``."""
            if self.before[hi] - self.before[lo] <= core:
                add(lo, hi)
            elif level == WORDS:
                for i in range(lo, hi):
                    if self.before[i + 1] - self.before[i] <= core:
                        add(i, i + 1)
                    else:
                        cut(i)
            else:
                at = lo
                for i in range(lo, hi):
                    if i == hi - 1 or self.after[i] >= level:
                        parts(at, i + 1, level - 1)
                        at = i + 1

        def cut(i: int) -> None:
            for s in range(self.start[i], self.end[i], 4 * core):
                e = min(s + 4 * core, self.end[i])
                bounds.append((s, e))
                sizes.append(word_size(e - s))
                after.append(IN_WORD)
            after[-1] = self.after[i]

        at = 0
        for i, strength in enumerate(self.after):
            if strength == LINES:
                parts(at, i + 1, SENTENCES)
                at = i + 1
        return bounds, sizes, after

    def reach(self, start: int, shared: int) -> int:
        """Where a piece begins that takes over ``shared`` of what stands before ``start``, or all of it if that is less.

        Sizes go by four code points: the part of a word that is taken over, and what is cut off before ``start``, have whole sizes.
        """
        i = bisect_left(self.start, start)
        if i and self.end[i - 1] > start:
            i -= 1  # the piece begins inside this word
            inside = (start - self.start[i]) >> 2
            if inside >= shared:
                return start - 4 * shared
            shared -= inside
            start = self.start[i]
        j = bisect_left(self.before, self.before[i] - shared)
        rest = shared - (self.before[i] - self.before[j])
        if rest and j:
            return self.end[j - 1] - 4 * rest
        return self.start[j] if j < i else start


def merge(sizes: list[int], after: list[int], core: int) -> list[tuple[int, int]]:
    """Ranges of atoms after merging the weakest boundaries first, unions of at most ``core``."""
    n = len(sizes)
    size, following, before = sizes[:], list(range(1, n + 1)), list(range(-1, n - 1))
    last = list(range(n))  # the last atom of the range that begins at each
    heap = [(after[i], size[i] + size[i + 1], i, i + 1) for i in range(n - 1) if size[i] + size[i + 1] <= core]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, union, i, j = heapq.heappop(heap)
        if not alive[i] or following[i] != j or size[i] + size[j] != union:
            continue  # one side has been merged since
        size[i], last[i], alive[j] = union, last[j], False
        k = following[i] = following[j]
        if k < n:
            before[k] = i
            if union + size[k] <= core:
                heapq.heappush(heap, (after[last[i]], union + size[k], i, k))
        h = before[i]
        if h >= 0 and size[h] + union <= core:
            heapq.heappush(heap, (after[last[h]], size[h] + union, h, i))
    return [(i, last[i] + 1) for i in range(n) if alive[i]]


def split(words: Words, setting: Setting) -> list[tuple[int, int, int]]:
    """(start, first new code point, end) of the pieces of a text larger than the setting's budget."""
    bounds, sizes, after = words.atoms(setting.core)
    pieces = []
    for lo, hi in merge(sizes, after, setting.core):
        new, end = bounds[lo][0], bounds[hi - 1][1]
        pieces.append((words.reach(new, setting.shared) if pieces and setting.shared else new, new, end))
    return pieces


def settings_of(runs: DataFrame) -> DataFrame:
    """``run_id, source, budget, overlap, most, reason``, one row per run: the last registration counts.

    The limit is the chunker's ``max_len`` (128 where null) less the two reserved places; runs whose limit leaves none are left
    out. A missing or negative overlap is 0; a missing ``max_chunks`` means any number, one below 1 none. ``reason`` names what can't be met,
    an overlap that isn't smaller than a piece, else it is null.
    """
    limit = F.coalesce("config.chunker.max_len", F.lit(DEFAULT_LIMIT))
    fields = F.struct("source", (limit - RESERVED).alias("budget"), F.greatest(F.coalesce("chunk_overlap", F.lit(0)), F.lit(0)).alias("overlap"), F.col("config.corpus.max_chunks").alias("most"))
    last = runs.filter("run_id is not null and source is not null").groupBy("run_id").agg(F.max_by(fields, F.struct("registered_at", fields)).alias("x"))
    unmet = F.when(F.col("overlap") >= F.col("budget"), F.lit("overlap not below the size of a piece: half a piece is used"))
    return last.select("run_id", "x.*").filter("budget > 0").withColumn("reason", unmet)


def split_oversized(docs: DataFrame, settings: DataFrame, with_text: bool = False, doc_id: str = "doc_id", only_sizes: bool = False) -> DataFrame:
    """Each oversized document of each run's source with its pieces, one row per run and document.

    Columns: ``run_id, doc_id, size, starts, news, ends`` (code points: where each piece, and what is new in it, begins and
    where it ends) and, with ``with_text``, ``texts``; with ``only_sizes`` nothing is split and the arrays are null. ``docs`` has ``doc_id, text, source``; ``settings`` as from :func:`settings_of`. Documents that fit,
    null and empty texts and null sources give no rows; repeated documents give repeated rows; extra columns are
    ignored. Documents are neither shuffled nor repeated per run; the settings (bounded blocks) go to the workers.
    """
    rows = settings.select("run_id", "source", "budget", "overlap", "most").orderBy("run_id")
    listed = rows.collect()
    out = None
    for lo in range(0, max(1, len(listed)), RUN_BLOCK):
        part = _split_pass(docs, listed[lo : lo + RUN_BLOCK], with_text, doc_id, only_sizes)
        out = part if out is None else out.unionByName(part)
    return out


def _split_pass(docs: DataFrame, rows: list, with_text: bool, doc_id: str, only_sizes: bool) -> DataFrame:
    by_source: dict[str, list[Setting]] = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(Setting(r["run_id"], r["budget"], r["overlap"], r["most"]))
    number = T.ArrayType(T.IntegerType())
    fields = [T.StructField("run_id", T.StringType()), T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("size", T.LongType()), *(T.StructField(c, number) for c in ("starts", "news", "ends"))]
    schema = T.StructType(fields + [T.StructField("texts", T.ArrayType(T.StringType()))] * with_text)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                out = []
                for key, text, source in zip(*(c.slice(lo, hi - lo).to_pylist() for c in batch.columns), strict=True):
                    own = by_source.get(source)
                    # a word of n code points has size n at most: short texts can't be oversized
                    if not own or not text or len(text) <= min(s.budget for s in own):
                        continue
                    size = text_size(text)
                    large = [s for s in own if size > s.budget]
                    if large and only_sizes:
                        out += [(s.run, key, size, None, None, None) for s in large]
                    elif large:
                        words = Words(text)
                        for s in large:
                            pieces = split(words, s)
                            row = (s.run, key, size, *([p[i] for p in pieces] for i in range(3)))
                            out.append((*row, [text[p[0] : p[2]] for p in pieces]) if with_text else row)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    chosen = docs.select(doc_id, "text", "source").filter(F.col("source").isin(list(by_source)) if len(by_source) < 200 else F.col("source").isNotNull())
    return chosen.mapInArrow(run, schema)


def _before_in_run(rows: DataFrame, value: str, order: list[str], out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the run's rows before, in ``order``: running sums over ranges of (run, order), less the run's start."""
    summed = prefix_sums(rows, value, ["run_id", *order], "_all")
    starts = summed.groupBy("run_id").agg(F.min("_all").alias("_start"))
    return summed.join(starts, "run_id").withColumn(out, F.col("_all") - F.col("_start")).drop("_all", "_start")


def pieces(docs: DataFrame, settings: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``run_id, doc_id, piece, start, new, end, text``: the pieces, at most the run's ``most`` of them in order of document and piece.

    An oversized document has two pieces or more, so a run's first ``most / 2 + 1`` oversized documents suffice: they are found from sizes and ids
    alone, by sums over ranges of ids, and only they are split. Copies of a document (same id and text) count once under a limit; several
    texts of one id all count.
    """
    free = split_oversized(docs, settings.filter("most is null"), True, doc_id).withColumn("room", F.lit(None).cast("long"))
    capped = settings.filter("most is not null and most > 0")
    if capped.limit(1).count():
        sizes = split_oversized(docs, capped, False, doc_id, only_sizes=True).select("run_id", doc_id).distinct().withColumn("_one", F.lit(1))
        ranked = _before_in_run(sizes, "_one", [doc_id], "_rank").join(capped.select("run_id", "most"), "run_id")
        first = stored(ranked.filter(F.col("_rank") <= F.floor(F.col("most") / 2)).select("run_id", doc_id, "most"))
        last = first.agg(F.max(doc_id)).first()[0]
        # the first documents of each run: an upper bound of the id reaches the scan
        few = docs.filter(F.col(doc_id) <= F.lit(last)).join(first.select(doc_id).distinct(), doc_id, "left_semi")
        split_ = split_oversized(few, capped, True, doc_id).join(first, ["run_id", doc_id]).withColumn("_text", F.xxhash64("texts"))
        split_ = stored(split_.dropDuplicates(["run_id", doc_id, "_text"]))
        counted = _before_in_run(split_.select("run_id", doc_id, "_text", F.size("starts").alias("_n")), "_n", [doc_id, "_text"], "_earlier").drop("_n")
        with_room = split_.join(counted, ["run_id", doc_id, "_text"]).withColumn("room", F.col("most") - F.col("_earlier")).filter("room > 0")
        free = free.unionByName(with_room.select(*free.columns))
    each = free.select("run_id", doc_id, "room", F.posexplode(F.arrays_zip("starts", "news", "ends", "texts")).alias("piece", "x"))
    return each.filter("room is null or piece < room").select("run_id", doc_id, "piece", F.col("x.starts").alias("start"), F.col("x.news").alias("new"), F.col("x.ends").alias("end"), F.col("x.texts").alias("text"))
