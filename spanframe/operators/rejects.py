"""Rows that fail to parse: faulty lines of delimited files with the reason, and the clean lines as typed rows.

The lines are split into cells on the JVM, the cells exploded into (line, column, value), joined to a small rule table,
evaluated, and the violations aggregated to the first reason that applies. Clean lines are what an anti-join leaves.

No line goes through a backtracking regular expression: quoting is decided from the pieces between double quotes, so a
line of any length costs linear time and constant stack.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32


class FormatError(ValueError):
    """A file isn't in the format it should have; the message names the place."""


@dataclass(frozen=True)
class Rule:
    """``pattern`` must match the whole value of ``column``; ``priority`` orders the reasons of a line."""

    column: str
    reason: str
    priority: int
    pattern: str


#: Rules of the prediction contract (fixed values of the test data's statement).
CONTRACT_RULES = (
    *(Rule(c, "empty", 3, r"(?s).+") for c in ("sentence_id", "word_idx", "word", "gold", "pred")),
    Rule("sentence_id", "integer", 4, r"[0-9]+"),
    Rule("word_idx", "integer", 4, r"[0-9]+"),
    Rule("gold", "gold", 5, r"(?U)O|[BI]-[^\s\x1C-\x1F]+"),
    Rule("pred", "pred", 6, r"(?U)O|[BI]-[^\s\x1C-\x1F]+"),
    Rule("truncated", "truncated", 7, r"[01]?"),
)
#: Faults of the line as a whole come as one cell of this name, whose value is the fault.
LINE = "<line>"
LINE_RULES = (Rule(LINE, "header", 0, "quoting|field_count"), Rule(LINE, "quoting", 1, "header|field_count"), Rule(LINE, "field_count", 2, "header|quoting"))
CONTRACT_TYPES = {"sentence_id": "bigint", "word_idx": "int", "word": "string", "gold": "string", "pred": "string", "truncated": "boolean"}

#: Marks used inside :func:`split_cells`: U+0001 and a letter; U+0001 in the data is escaped, so they can't collide.
_MARK = "\x01"


def line_body(raw: Column) -> Column:
    """The line without one final CR."""
    return F.when(raw.endswith("\r"), F.substring(raw, F.lit(1), F.length(raw) - 1)).otherwise(raw)


def quoting_ok(body: Column) -> Column:
    """True where every field that begins with a quote ends with one before the next comma or the end, and no other has any.

    With the line cut at its quotes, pieces of even position lie outside quotes. Each must be empty (a doubled quote) or
    touch the neighbouring fields by commas; the number of quotes must be even.
    """
    pieces = F.split(body, '"')
    count = F.size(pieces)
    first, last = F.element_at(pieces, 1), F.element_at(pieces, -1)
    # the array is named once per lambda, never inside: each piece is looked at once
    middle = F.transform(F.slice(pieces, F.lit(2), F.greatest(count - 2, F.lit(0))), lambda p, i: (i % 2 == 0) | (p == "") | (p.startswith(",") & p.endswith(",")))
    ends = ((first == "") | first.endswith(",")) & ((last == "") | last.startswith(","))
    return (count == 1) | ((count % 2 == 1) & ends & F.forall(middle, lambda x: x))


def split_cells(body: Column) -> Column:
    """The unquoted values of a line whose quoting is right, as an array."""
    escaped = F.replace(body, F.lit(_MARK), F.lit(_MARK + "a"))
    pieces = F.transform(F.split(escaped, '"'), lambda p, i: F.when(i % 2 == 0, F.replace(p, F.lit(","), F.lit(_MARK + "b"))).otherwise(p))
    marked = F.split(F.array_join(pieces, _MARK + "c"), _MARK + "b")

    def plain(cell: Column) -> Column:
        inner = F.when(cell.startswith(_MARK + "c"), F.substring(cell, F.lit(3), F.length(cell) - 4)).otherwise(cell)
        return F.replace(F.replace(inner, F.lit(_MARK + "c" + _MARK + "c"), F.lit('"')), F.lit(_MARK + "a"), F.lit(_MARK))

    return F.transform(marked, plain)


def parsed_lines(lines: DataFrame, salts: int = SALTS) -> DataFrame:
    """``line_id, file_name, cells, header, quoting_ok`` of every data line: no headers, no blank lines.

    ``lines`` has ``line_id, file_name, line_no, raw``; extra columns are ignored. Line 1 of a file is its header. Each
    header is repeated for ``salts`` and joined on (file, salt): a file that holds a third of all lines is spread over
    many tasks. Lines of a file without a header are kept with a null header.
    """
    base = lines.select("line_id", "file_name", "line_no", line_body(F.col("raw")).alias("body"))
    headers = base.filter(F.col("line_no") == 1).groupBy("file_name").agg(F.min("body").alias("head"))
    headers = headers.select("file_name", F.transform(split_cells(F.col("head")), lambda c: F.trim(c)).alias("header"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    data = base.filter(((F.col("line_no") != 1) | F.col("line_no").isNull()) & F.col("body").isNotNull() & (F.trim(F.regexp_replace("body", r"[ \t\r]+", " ")) != ""))
    data = data.withColumn("salt", F.pmod(F.xxhash64("line_id", "body"), F.lit(salts)).cast("int"))
    joined = data.join(headers, ["file_name", "salt"], "left")
    ok = quoting_ok(F.col("body"))
    return joined.select("line_id", "file_name", "header", ok.alias("quoting_ok"), F.when(ok, split_cells(F.col("body"))).alias("cells"))


def header_broken(header: Column, required: list[str]) -> Column:
    """True where a header repeats a name or lacks a required one: no line below it can be read by name."""
    return (F.size(F.array_distinct(header)) != F.size(header)) | (F.size(F.array_except(F.array(*(F.lit(c) for c in required)), header)) > 0)


def cells(parsed: DataFrame, required: list[str] | None = None) -> DataFrame:
    """One row per cell: ``line_id, column, value``; a line with a fault of its own gives the one cell that names it."""
    zipped = F.transform(F.arrays_zip(F.col("header").alias("c"), F.col("cells").alias("v")), lambda x: F.struct(x["c"].alias("column"), x["v"].alias("value")))

    def fault(reason: str) -> Column:
        return F.array(F.struct(F.lit(LINE).alias("column"), F.lit(reason).alias("value")))

    each = F.when(header_broken(F.col("header"), required or []), fault("header")).when(~F.col("quoting_ok"), fault("quoting")).when(F.col("header").isNull() | (F.size("cells") != F.size("header")), fault("field_count")).otherwise(zipped)
    return parsed.select("line_id", F.explode(each).alias("cell")).select("line_id", F.col("cell.column").alias("column"), F.col("cell.value").alias("value"))


def rule_table(parsed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The rules as a table: a handful of rows, fixed by the program."""
    return parsed.sparkSession.createDataFrame([(r.column, r.reason, r.priority, r.pattern) for r in rules], "column string, reason string, priority int, pattern string")


def violations(parsed: DataFrame, rules: tuple[Rule, ...] = CONTRACT_RULES) -> DataFrame:
    """``line_id, priority`` of everything that is wrong; a line may have several."""
    rules = LINE_RULES + rules
    # one literal per distinct pattern: each is compiled once, not per row
    holds = F.lit(None).cast("boolean")
    for pattern in dict.fromkeys(r.pattern for r in rules):
        holds = F.when(F.col("pattern") == pattern, F.col("value").rlike(f"^(?:{pattern})\\z")).otherwise(holds)
    # what must not be empty must be there
    required = list(dict.fromkeys(r.column for r in rules if r.reason == "empty"))
    judged = cells(parsed, required).join(F.broadcast(rule_table(parsed, rules)), "column")
    return judged.filter(~holds).select("line_id", "priority")


def faulty_lines(lines: DataFrame, rules: tuple[Rule, ...] = CONTRACT_RULES) -> DataFrame:
    """``line_id, reason``: each faulty line once, with the first reason that applies.

    Headers, blank lines (null, empty, only spaces or tabs) and repetition are no faults. A line of a file that has no
    header has the reason ``field_count``, every line below a header that repeats a name or lacks a required one the reason ``header``. Only violations are shuffled, pre-aggregated by line. An empty table gives no
    rows; a repeated ``line_id`` gives one row.
    """
    first = violations(parsed_lines(lines), rules).groupBy("line_id").agg(F.min("priority").alias("priority"))
    reason = F.lit(None).cast("string")
    for rule in LINE_RULES + rules:
        reason = F.when(F.col("priority") == rule.priority, rule.reason).otherwise(reason)
    return first.select("line_id", reason.alias("reason"))


def clean_rows(lines: DataFrame, rules: tuple[Rule, ...] = CONTRACT_RULES, types: dict[str, str] | None = None) -> DataFrame:
    """The lines without fault as typed rows: ``line_id, file_name`` and the contract's columns.

    A missing or empty ``truncated`` is false; whole numbers beyond the type's range give null. Repeated lines stay.
    """
    parsed = parsed_lines(lines)
    bad = violations(parsed, rules).select("line_id").distinct()
    return typed_rows(parsed.join(bad, "line_id", "left_anti"), types)


def typed_rows(parsed: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Cells of parsed lines as typed columns, by the names of their header; of a repeated name the first cell counts."""
    types = types or CONTRACT_TYPES
    out = parsed.select("line_id", "file_name", "header", "cells")
    # position 0, for a name the header lacks, gives null
    value = {c: F.get("cells", F.array_position("header", c).cast("int") - 1) for c in types}
    typed = [F.coalesce(value[c] == "1", F.lit(False)).alias(c) if t == "boolean" else value[c].try_cast(t).alias(c) for c, t in types.items()]
    return out.select("line_id", "file_name", *typed)
