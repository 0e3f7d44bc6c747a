"""Text expressions: Column in, Column out, with the string semantics of Python 3."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes that agree with Python's str methods and `re`.
WS = r"(?U)[\s\x1c-\x1f]"
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"

# File suffixes and the kind of document each stands for.
SUFFIX_TYPES = {
    ".pdf": "PDF", ".docx": "DOCX", ".txt": "TXT", ".md": "Markdown", ".markdown": "Markdown", ".html": "HTML", ".htm": "HTML",
    ".py": "Code", ".js": "Code", ".ts": "Code", ".tsx": "Code", ".jsx": "Code", ".java": "Code", ".go": "Code", ".rs": "Code",
    ".cpp": "Code", ".c": "Code", ".h": "Code", ".cs": "Code", ".php": "Code", ".rb": "Code",
}

# Words that carry no search meaning.
STOPWORDS = "a an and are as at be by for from in is it of on or the this to what when where who why how".split()


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


#: Items that `scan` walks before it puts their results away.
SCAN = 256


def scan(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """array<kind> of what `step` gives along an array: it makes the next state and an array of
    results from a state and an item. A fold copies all it holds at each step, so results are
    gathered by stretches of `SCAN` items, and best are numbers that tell places in other
    arrays. The state is a struct."""
    none = F.expr(f"cast(array() as array<{kind}>)")

    def one(s: Column, x: Column) -> Column:
        state, out = step(s["state"], x)
        return F.struct(state.alias("state"), F.concat(s["out"], out).alias("out"))

    def stretch(s: Column, some: Column) -> Column:
        walked = F.aggregate(some, F.struct(s["state"].alias("state"), none.alias("out")), one)
        return let(walked, lambda w: F.struct(w["state"].alias("state"), F.concat(s["out"], F.array(w["out"])).alias("out")))

    def walk(all_: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / SCAN).cast("int")), lambda i: F.slice(all_, (i * SCAN + 1).cast("int"), SCAN))
        begin = F.struct(start.alias("state"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("out"))
        return F.when(F.size(all_) > 0, F.aggregate(cut, begin, stretch, lambda s: F.flatten(s["out"]))).otherwise(none)

    return let(items, walk)


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, rf"\A{WS}+", ""), rf"{WS}+\z", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)[^\s\x1c-\x1f]")


def normalize_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"{WS}+", " "))


def splitlines(c: Column) -> Column:
    """Lines without their ends; no last line after a final line end."""
    return let(F.split(c, _LINE_END), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def non_blank(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def split_sentences(c: Column) -> Column:
    return non_blank(F.split(strip(c), rf"(?<=[.!?]){WS}+"))


def estimate_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(c, F.lit(r"[\p{L}\p{N}_]+|(?U)[^\p{L}\p{N}_\s\x1c-\x1f]"))).cast("bigint")


def words(c: Column) -> Column:
    """Python's str.split(): runs of anything but white space."""
    return let(normalize_whitespace(c), lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " ")))


def all_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0))


def tokenize(c: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(all_tokens(c), lambda t: ~F.array_contains(stop, t))


def expanded_terms(c: Column) -> Column:
    """Distinct tokens and, for those ending in s, the token without it."""

    def both(t: Column) -> Column:
        singular = F.transform(F.filter(t, lambda x: x.endswith("s") & (F.length(x) > 3)), lambda x: F.substring(x, F.lit(1), F.length(x) - 1))
        return F.array_union(t, singular)

    return let(F.array_distinct(tokenize(c)), both)


def important_terms(c: Column) -> Column:
    return F.filter(expanded_terms(c), lambda t: (F.length(t) > 1) & ~t.rlike(r"\A[0-9]+\z"))


def suffix(name: Column) -> Column:
    """Like pathlib's suffix of the last part, in lower case."""
    last = F.regexp_extract(F.regexp_replace(name, "/+$", ""), "([^/]*)$", 1)
    return F.lower(F.regexp_extract(last, r"^.+(\.[^.]+)$", 1))


def document_type(name: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in SUFFIX_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, suffix(name)), F.lit("Unknown"))


def human_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", F.bround(n / F.lit(1024.0), 1)))
        .otherwise(F.format_string("%.1f MB", F.bround(n / F.lit(1048576.0), 1)))
    )


def markdown_headers(c: Column) -> Column:
    """array<struct<level, title, line>> of the lines that are Markdown headings."""
    lines = F.transform(splitlines(c), lambda x, i: F.struct(i.alias("line"), x.alias("text")))
    heads = F.filter(lines, lambda x: x["text"].rlike(rf"^#{{1,6}}{WS}+.+$"))
    return F.transform(heads, lambda x: F.struct(F.length(F.regexp_extract(x["text"], "^(#{1,6})", 1)).alias("level"), strip(F.regexp_extract(x["text"], rf"^#{{1,6}}{WS}+(.+)$", 1)).alias("title"), x["line"].alias("line")))


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, m>> of an expression's matches, start counted from 0: what lies
    between matches gives the places."""

    def placed(t: Column) -> Column:
        def walk(found: Column) -> Column:
            return F.zip_with(found, starts(F.split(t, pattern), found), lambda m, at: F.struct(at.alias("start"), m.alias("m")))

        return let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), walk)

    return let(text, placed)


def starts(between: Column, found: Column) -> Column:
    """array<int>: where each match starts, from the texts before, between and after matches."""

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        at = s["at"] + x["p"]
        return F.struct((at + x["m"]).alias("at")), F.array(at)

    sizes = let(found, lambda f: F.zip_with(f, F.slice(between, F.lit(1), F.size(f)), lambda m, p: F.struct(F.length(p).alias("p"), F.length(m).alias("m"))))
    return scan(sizes, F.struct(F.lit(0).alias("at")), step, "int")


def cut_at(text: Column, marks: Column) -> Column:
    """The text from each mark (ascending array<int> of starts) to the next or the end."""

    def parts(m: Column) -> Column:
        ends = F.concat(F.slice(m, F.lit(2), F.greatest(F.size(m), F.lit(1))), F.array(F.length(text)))
        return F.when(F.size(m) > 0, F.zip_with(m, ends, lambda a, b: F.substring(text, a + 1, b - a))).otherwise(F.array().cast("array<string>"))

    return let(marks, parts)
