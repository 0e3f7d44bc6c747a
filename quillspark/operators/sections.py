"""Section and heading detection on text, as expressions over a document's lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import WS, cut_at, is_blank, let, normalize_whitespace, spans, splitlines, strip, words

SECTION = "array<struct<unit_id:string,title:string,level:int,section:int,text:string,reason:string>>"
#: Longest heading in characters and words, and shortest line that may follow one.
LONGEST, MOST_WORDS, NEXT_LEAST = 90, 8, 25


def looks_like_footer(s: Column) -> Column:
    """A stripped line that repeats on pages: numbers, versions, anything that ends in a number."""
    return s.rlike(r"\A[0-9]+\z") | s.rlike(r"(?i)\APage\s+[0-9]+\z") | s.rlike(r"\A.+\s+[0-9]+\z") | s.rlike(r"(?i)\AVersion\s+[0-9.]+\z") | (F.lower(s) == "internal")


def derived_title(text: Column) -> Column:
    lines = F.filter(F.transform(splitlines(text), normalize_whitespace), lambda x: (x != "") & ~looks_like_footer(x))
    return F.coalesce(F.substring(F.get(lines, F.lit(0)), 1, LONGEST), F.lit("Document Start"))


def is_list_or_table(s: Column) -> Column:
    return s.rlike(r"\A[-*+]\s+") | s.rlike(r"\A[0-9]+[.)]\s+") | s.rlike(r"\A[-*_]{3,}\z") | s.startswith("|")


def numbered_title(s: Column) -> Column:
    return strip(F.regexp_extract(s, rf"\A[0-9]+(?:\.[0-9]+)*[.)]?{WS}+(.{{3,}})\z", 1))


def is_numbered(s: Column, following: Column) -> Column:
    """s is a stripped line, following the next line with text."""
    return s.rlike(rf"\A[0-9]+(?:\.[0-9]+)*[.)]?{WS}+.{{3,}}\z") & let(numbered_title(s), lambda t: (
        ~(t.startswith("**") | F.contains(t, F.lit(" - ")) | F.contains(t, F.lit(" – ")) | F.contains(t, F.lit(" — ")))
        & (F.length(t) <= LONGEST) & (F.size(words(t)) <= MOST_WORDS)
        & ~t.rlike(r"[.!?;:]\z") & (F.length(F.coalesce(following, F.lit(""))) >= NEXT_LEAST)
    ))


def is_inferred(s: Column, following: Column) -> Column:
    def ratio(found: Column) -> Column:
        return F.size(F.filter(found, lambda w: w.rlike("^[A-Z]"))).cast("double") / F.greatest(F.size(found), F.lit(1))

    return (
        s.rlike("[A-Za-z]") & ~is_list_or_table(s) & (F.length(s) <= LONGEST) & (F.size(words(s)) <= MOST_WORDS)
        & ~s.rlike(r"[.!?;:]\z") & (F.length(F.coalesce(following, F.lit(""))) >= NEXT_LEAST)
        & (let(F.regexp_extract_all(s, F.lit("[A-Za-z][A-Za-z/&-]*"), F.lit(0)), ratio) >= 0.65)
    )


def _joined(lines: Column, first: Column, last: Column) -> Column:
    """Lines first to last, counted from 0."""
    return strip(F.array_join(F.slice(lines, first + 1, F.greatest(last - first + 1, F.lit(0))), "\n"))


def _scanned(text: Column) -> Column:
    """Headings by a fold over the lines that have text, each with the next one."""
    return let(splitlines(text), lambda lines: let(_with_text(lines), lambda rows: _folded(text, lines, rows)))


def _with_text(lines: Column) -> Column:
    return F.filter(F.transform(lines, lambda x, i: F.struct(i.cast("int").alias("i"), x.alias("line"), strip(x).alias("s"))), lambda x: x["s"] != "")


def _folded(text: Column, lines: Column, with_text: Column) -> Column:
    following = F.concat(F.slice(F.transform(with_text, lambda x: x["s"]), 2, F.greatest(F.size(with_text), F.lit(1))), F.array(F.lit(None).cast("string")))

    def flagged(x: Column, n: Column) -> Column:
        md = x["line"].rlike(rf"\A#{{1,6}}{WS}+.+\z")
        return let(md, lambda m: let(is_numbered(x["s"], n), lambda k: described(x, n, m, k)))

    def described(x: Column, n: Column, md: Column, numbered: Column) -> Column:
        level = F.when(md, F.length(F.regexp_extract(x["line"], "^(#{1,6})", 1))).when(numbered, F.length(F.regexp_replace(F.regexp_extract(x["s"], r"\A([0-9]+(?:\.[0-9]+)*)", 1), "[0-9]", "")) + 1).otherwise(1)
        title = F.when(md, strip(F.regexp_extract(x["line"], rf"\A#{{1,6}}{WS}+(.+)\z", 1))).when(numbered, numbered_title(x["s"])).otherwise(x["s"])
        return F.struct(x["i"].alias("i"), (md | numbered).alias("sure"), is_inferred(x["s"], n).alias("inferred"), level.cast("int").alias("level"), title.alias("title"))

    rows = F.zip_with(with_text, following, flagged)
    piece = "struct<title:string,level:int,first:int,last:int>"
    start = F.struct(F.lit(0).alias("first"), F.lit(False).alias("body"), F.lit(None).cast("string").alias("title"), F.lit(1).alias("level"), F.expr(f"cast(array() as array<{piece}>)").alias("out"))

    def emitted(s: Column, last: Column) -> Column:
        one = F.struct(s["title"].alias("title"), s["level"].alias("level"), s["first"].alias("first"), last.cast("int").alias("last"))
        return F.when(s["first"] <= last, F.concat(s["out"], F.array(one))).otherwise(s["out"])

    def step(s: Column, x: Column) -> Column:
        # under a heading that has no body yet, a line that only looks like a heading is the body
        return let(x["inferred"] & ~x["sure"] & ~s["body"] & (F.size(s["out"]) > 0), lambda as_body: next_state(s, x, as_body))

    def next_state(s: Column, x: Column, as_body: Column) -> Column:
        heading = (x["sure"] | x["inferred"]) & ~as_body
        return F.struct(
            F.when(as_body, x["i"]).when(heading, x["i"] + 1).otherwise(s["first"]).alias("first"),
            F.when(heading, F.lit(False)).otherwise(F.lit(True)).alias("body"),
            F.when(heading, x["title"]).otherwise(s["title"]).alias("title"),
            F.when(heading, x["level"]).otherwise(s["level"]).alias("level"),
            F.when(heading, emitted(s, x["i"] - 1)).otherwise(s["out"]).alias("out"),
        )

    pieces = F.aggregate(rows, start, step, lambda s: emitted(s, F.size(lines) - 1))

    def unit(p: Column, i: Column) -> Column:
        return let(_joined(lines, p["first"], p["last"]), lambda body: described_unit(p, i, body))

    def described_unit(p: Column, i: Column, body: Column) -> Column:
        titled = p["title"].isNotNull() & (p["title"] != "")
        return F.struct(
            F.concat(F.lit("section-"), (i + 1).cast("string")).alias("unit_id"), F.when(titled, p["title"]).otherwise(derived_title(body)).alias("title"), p["level"].alias("level"),
            (i + 1).cast("int").alias("section"), body.alias("text"), F.when(titled, "text_heading").otherwise("before_first_heading").alias("reason"),
        )

    whole = F.array(F.struct(F.lit("section-1").alias("unit_id"), derived_title(text).alias("title"), F.lit(1).alias("level"), F.lit(None).cast("int").alias("section"), text.alias("text"), F.lit("whole_document").alias("reason")))
    return let(pieces, lambda p: F.when(F.size(p) > 0, F.transform(p, unit)).otherwise(whole))


_TOP = rf"(?m)^Section{WS}+[0-9]+{WS}*:{WS}*[^\n]+$"


def _top_level(text: Column) -> Column:
    """Sections that the text itself numbers: "Section N: title"."""
    return let(spans(text, _TOP), lambda marks: let(strip(F.substring(text, F.lit(1), marks[0]["start"])), lambda front: _numbered_sections(text, marks, front)))


def _numbered_sections(text: Column, marks: Column, front: Column) -> Column:
    parts = cut_at(text, F.transform(marks, lambda m: m["start"]))
    has_front = front != ""

    def unit(m: Column, part: Column) -> Column:
        return let(strip(part), lambda body: described(m, body))

    def described(m: Column, body: Column) -> Column:
        n = F.regexp_extract(m["m"], "([0-9]+)", 1)
        more = F.transform(F.slice(splitlines(body), 2, 3), strip)
        stop = lambda x: x.rlike(rf"\A(?:Section|Page){WS}+[0-9]+\b") | F.regexp_like(x, F.concat(F.lit(r"\A"), n.cast("int").cast("string"), F.lit(r"\.[0-9]+\b")))
        # title lines go on until one that starts something else
        more = let(more, lambda x: let(F.coalesce(F.array_position(F.transform(x, stop), True), F.lit(0)), lambda e: F.when(e > 0, F.slice(x, F.lit(1), (e - 1).cast("int"))).otherwise(x)))
        title = F.array_join(F.concat(F.array(strip(F.regexp_extract(m["m"], rf":{WS}*([^\n]+)\z", 1))), F.filter(more, lambda x: x != "")), " ")
        return F.struct(
            F.concat(F.lit("section-"), n.cast("int").cast("string")).alias("unit_id"), normalize_whitespace(title).alias("title"), F.lit(1).alias("level"),
            (n.cast("int") + has_front.cast("int")).alias("section"), body.alias("text"), F.lit(None).cast("string").alias("reason"),
        )

    before = F.array(F.struct(F.lit("front-matter").alias("unit_id"), derived_title(front).alias("title"), F.lit(1).alias("level"), F.lit(1).alias("section"), front.alias("text"), F.lit("before_first_heading").alias("reason")))
    return F.concat(F.when(has_front, before).otherwise(F.expr(f"cast(array() as {SECTION})")), F.zip_with(marks, parts, unit).cast(SECTION))


def sections(text: Column) -> Column:
    """array<struct<unit_id, title, level, section, text, reason>> in order."""
    return let(text, lambda t: F.when(t.rlike(_TOP), _top_level(t).cast(SECTION)).otherwise(_scanned(t).cast(SECTION)))


def has_text(c: Column) -> Column:
    return ~is_blank(c)
