"""Tables in delimited text: detection, cleaning, validation, Markdown.

All of it works on a document's array of lines, so nothing is shuffled: islands of one
kind come from the places where the kind changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import is_blank, let, normalize_whitespace, splitlines, strip

#: Where a table without a place of its own sorts.
TABLE_ORDER = 1_000_000
ROWS = "array<array<string>>"


def filled(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda c: ~is_blank(c)))


def _inner(line: Column) -> Column:
    return F.split(F.regexp_replace(F.regexp_replace(line, r"^\|+", ""), r"\|+$", ""), r"\|")


def line_kind(line: Column) -> Column:
    """pipe, tab, csv, or null."""

    def kind(s: Column) -> Column:
        return (
            F.when(s == "", F.lit(None).cast("string"))
            .when(F.contains(s, F.lit("|")) & (filled(_inner(s)) >= 2), "pipe")
            .when(F.contains(s, F.lit("\t")) & (filled(F.split(s, "\t")) >= 2), "tab")
            .when(~s.rlike(r"^[-*+](?U)\s+") & ~F.contains(s, F.lit(", ")) & F.contains(s, F.lit(",")) & (filled(F.split(s, ",")) >= 2), "csv")
        )

    return let(strip(line), kind)


def column_count(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))


def clean_cell(cell: Column) -> Column:
    return normalize_whitespace(F.replace(F.coalesce(cell, F.lit("")), F.lit("\x00"), F.lit(":")))


def clean_rows(rows: Column) -> Column:
    """Cells cleaned, rows padded to the widest, empty rows dropped."""

    def padded(r: Column) -> Column:
        return let(column_count(r), lambda n: F.transform(r, lambda row: F.concat(F.transform(row, clean_cell), F.array_repeat(F.lit(""), n - F.size(row)))))

    return F.filter(let(rows, padded), lambda r: F.exists(r, lambda c: c != ""))


def parse_rows(lines: Column, kind: Column) -> Column:
    def cells(line: Column) -> Column:
        return F.transform(let(strip(line), lambda s: F.when(kind == "pipe", _inner(s)).when(kind == "tab", F.split(s, "\t")).otherwise(F.split(s, ","))), strip)

    def rule(row: Column) -> Column:  # the line of dashes under a pipe table's header
        return (kind == "pipe") & F.forall(row, lambda c: (c == "") | c.rlike(r"\A:?-{3,}:?\z"))

    return clean_rows(F.filter(F.transform(lines, cells), lambda r: ~rule(r)))


def is_valid(rows: Column) -> Column:

    def valid(r: Column) -> Column:
        cells = F.aggregate(r, F.lit(0), lambda s, row: s + F.size(F.filter(row, lambda c: c != "")))
        return (F.size(r) >= 2) & let(column_count(r), lambda n: (n >= 2) & (cells >= F.greatest(F.lit(4), n + 1)))

    return let(rows, valid)


def islands(text: Column) -> Column:
    """array<struct<kind, first, last, rows, valid>>: runs of lines of one kind, by line numbers from 1."""

    def of_lines(lines: Column) -> Column:
        marked = F.transform(lines, lambda x, i: F.struct((i + 1).alias("i"), line_kind(x).alias("kind")))
        return let(marked, lambda m: of_marked(lines, m))

    def of_marked(lines: Column, marked: Column) -> Column:
        kinds = F.transform(marked, lambda x: x["kind"])
        none = F.array(F.lit(None).cast("string"))
        starts = F.filter(F.zip_with(marked, F.concat(none, kinds), lambda x, b: F.when(x["kind"].isNotNull() & ~x["kind"].eqNullSafe(b), x)), lambda x: x.isNotNull())
        ends = F.filter(F.zip_with(marked, F.concat(F.slice(kinds, F.lit(2), F.greatest(F.size(marked), F.lit(1))), none), lambda x, a: F.when(x["kind"].isNotNull() & ~x["kind"].eqNullSafe(a), x["i"])), lambda x: x.isNotNull())
        return F.transform(F.zip_with(starts, ends, lambda s, e: F.struct(s["kind"].alias("kind"), s["i"].alias("first"), e.alias("last"))), lambda r: parsed(lines, r))

    def parsed(lines: Column, r: Column) -> Column:
        rows = parse_rows(F.slice(lines, r["first"], r["last"] - r["first"] + 1), r["kind"])
        return let(rows, lambda x: F.struct(r["kind"].alias("kind"), r["first"].alias("first"), r["last"].alias("last"), x.alias("rows"), is_valid(x).alias("valid")))

    return let(splitlines(text), of_lines)


def tables(runs: Column) -> Column:
    """array<struct<table_index, format, rows, sort_order>> of the valid runs."""
    return F.transform(F.filter(runs, lambda r: r["valid"]), lambda r, i: F.struct((i + 1).alias("table_index"), r["kind"].alias("format"), r["rows"].alias("rows"), (i + TABLE_ORDER).cast("double").alias("sort_order")))


def without_tables(text: Column, runs: Column) -> Column:
    """The text less the lines of valid runs."""

    def kept(valid: Column) -> Column:
        return F.filter(splitlines(text), lambda _, i: ~F.exists(valid, lambda r: (i + 1 >= r["first"]) & (i + 1 <= r["last"])))

    return strip(F.array_join(let(F.filter(runs, lambda r: r["valid"]), kept), "\n"))


def to_markdown(rows: Column) -> Column:

    def made(r: Column, n: Column) -> Column:
        def line(row: Column) -> Column:
            cells = F.transform(F.concat(row, F.array_repeat(F.lit(""), n - F.size(row))), lambda c: F.replace(c, F.lit("|"), F.lit("\\|")))
            return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), n), " | "), F.lit(" |"))
        body = F.transform(F.slice(r, F.lit(2), F.greatest(F.size(r), F.lit(1))), line)
        return F.when(F.size(r) == 0, "").otherwise(F.array_join(F.concat(F.array(line(r[0]), rule), body), "\n"))

    return let(rows, lambda r: let(column_count(r), lambda n: made(r, n)))


def from_markdown(text: Column) -> Column:
    """Rows of a Markdown table: escaped bars restored, rules dropped, padded to the widest."""
    lines = F.filter(F.transform(splitlines(text), strip), lambda x: x.startswith("|") & x.endswith("|"))
    rows = F.transform(lines, lambda x: F.transform(F.split(F.substring(x, F.lit(2), F.length(x) - 2), r"(?<!\\)\|"), lambda c: F.replace(strip(c), F.lit("\\|"), F.lit("|"))))
    rows = F.filter(rows, lambda r: ~F.forall(r, lambda c: c.rlike(r"\A:?-{3,}:?\z")))
    return let(rows, lambda x: let(column_count(x), lambda n: F.transform(x, lambda r: F.concat(r, F.array_repeat(F.lit(""), n - F.size(r))))))


def header_names(rows: Column) -> Column:
    return F.transform(rows[0], lambda c, i: F.when(strip(c) == "", F.concat(F.lit("Column "), (i + 1).cast("string"))).otherwise(c))


# What is said of a table in a chunk's context.


def looks_like_key_values(rows: Column) -> Column:
    two = F.forall(rows, lambda r: (F.size(r) == 2) & F.exists(r, lambda c: ~is_blank(c)) & ~is_blank(r[0]))
    values = F.size(F.filter(rows, lambda r: ~is_blank(F.get(r, F.lit(1)))))
    return (F.size(rows) >= 2) & two & (values >= F.greatest(F.lit(1), F.size(rows) - 1))


def row_summary(rows: Column, limit: int = 4) -> Column:
    return let(F.transform(rows[0], strip), lambda heads: _summary(rows, heads, limit))


def _summary(rows: Column, heads: Column, limit: int) -> Column:
    def one(r: Column) -> Column:
        pairs = F.zip_with(F.slice(heads, 1, F.least(F.size(heads), F.size(r))), F.slice(r, 1, F.least(F.size(heads), F.size(r))), lambda h, c: F.when((h != "") & (strip(c) != ""), F.concat(h, F.lit(": "), strip(c))))
        return F.array_join(F.filter(pairs, lambda p: p.isNotNull()), "; ")

    said = F.filter(F.transform(F.slice(rows, 2, limit), one), lambda x: x != "")
    return let(said, lambda x: F.when((F.size(rows) >= 2) & (F.size(x) > 0), F.concat(F.lit("Table sample rows: "), F.array_join(x, " | "))))


def table_context(rows: Column) -> Column:
    """array<string> of what precedes a table's text in its chunk."""
    pairs = F.filter(F.transform(F.slice(rows, 1, 6), lambda r: F.when((strip(r[0]) != "") & (strip(F.get(r, F.lit(1))) != ""), F.concat(strip(r[0]), F.lit(" = "), strip(F.get(r, F.lit(1)))))), lambda p: p.isNotNull())
    heads = F.filter(rows[0], lambda c: strip(c) != "")
    parts = F.array(F.when(F.size(heads) > 0, F.concat(F.lit("Table columns: "), F.array_join(heads, ", "))), row_summary(rows))
    return (
        F.when(F.coalesce(F.size(rows), F.lit(0)) < 1, F.array().cast("array<string>"))
        .when(looks_like_key_values(rows), F.filter(F.array(F.when(F.size(pairs) > 0, F.concat(F.lit("Key-value table: "), F.array_join(pairs, " | ")))), lambda p: p.isNotNull()))
        .otherwise(F.filter(parts, lambda p: p.isNotNull()))
    )
