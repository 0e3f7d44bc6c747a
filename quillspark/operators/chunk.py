"""Chunkers: a document's units to its chunks, one row per chunk.

Like extraction, chunking is an expression over one document's arrays: chunks are numbered,
then copies dropped, before anything leaves the row. Splits are folds over a text's parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, cut_at, is_blank, let, scan, spans, splitlines, strip
from . import extract as X
from .tables import table_context

FIELDS = {
    "chunk_id": "string", "strategy_id": "string", "text": "string", "parent_id": "string", "children": "array<string>", "overlap": "int",
    "source_unit": "string", "unit_type": "string", "title": "string", "section_path": "string", "section": "int", "page": "int", "rows": "array<array<string>>",
    "start": "int", "end": "int", "sentence_start": "int", "sentence_end": "int", "clause": "int", "symbol": "string", "role": "string", "fallback": "boolean", "is_table": "boolean",
}
CHUNK = "struct<" + ",".join(f"`{k}`:{v}" for k, v in FIELDS.items()) + ">"
NONE = f"cast(array() as array<{CHUNK}>)"
#: Text splits are tried in this order, the last resort being slices.
SEPARATORS = ("\n\n", "\n", ". ", " ")
CODE = ("code_symbol", "code_context")

# Settings of the strategies; the same names as `chunk` takes.
DEFAULTS = {
    "fixed_size": {"chunk_size": 1000, "overlap": 100},
    "recursive": {"chunk_size": 1200, "overlap": 150},
    "ocr_aware": {"chunk_size": 800, "overlap": 80},
    "parent_child": {"child_size": 500, "child_overlap": 60},
    "semantic": {"sentences_per_chunk": 5},
    "adaptive": {"target_chars": 900},
}


def piece(u: Column | None = None, **values: Column) -> Column:
    """A chunk; what a unit says of it unless told otherwise."""
    if u is not None:
        own = {"source_unit": u["unit_id"], **{k: u[k] for k in ("unit_type", "title", "section_path", "section", "page", "rows")}}
        values = {**own, **values}
    values = {"overlap": F.lit(0), "children": F.array(), **values}
    return F.struct(*[(values[k] if k in values else F.lit(None)).cast(t).alias(k) for k, t in FIELDS.items()])


def changed(c: Column, **values: Column) -> Column:
    return F.struct(*[(values[k].cast(t) if k in values else c[k]).alias(k) for k, t in FIELDS.items()])


def numbered(chunks: Column, strategy: str) -> Column:
    return F.transform(chunks, lambda c, i: changed(c, chunk_id=F.concat(F.lit(strategy + "-"), (i + 1).cast("string")), strategy_id=F.lit(strategy), text=strip(c["text"])))


def deduped(chunks: Column) -> Column:
    """The first of those that say the same; all that say nothing."""

    def keep(cs: Column, keys: Column) -> Column:
        kept = F.zip_with(cs, F.transform(keys, lambda k, i: (k == "") | (F.array_position(keys, k) == i + 1)), lambda c, ok: F.when(ok, c))
        return F.filter(kept, lambda c: c.isNotNull())

    key = lambda c: strip(F.regexp_replace(F.lower(c["text"]), r"[^\p{L}\p{N}_]+", " "))
    return let(chunks, lambda cs: let(F.transform(cs, key), lambda keys: keep(cs, keys)))


def or_else(chunks: Column, other: Column) -> Column:
    return let(chunks, lambda c: F.when(F.size(c) > 0, c).otherwise(other))


# Text pieces.


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """array<struct<start, part>> of character windows that aren't blank."""
    step = max(1, size - min(overlap, size - 1))

    def windows(t: Column) -> Column:
        starts = F.when(F.length(t) > 0, F.sequence(F.lit(0), F.length(t) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        cut = F.transform(starts, lambda s: F.struct(s.cast("int").alias("start"), F.substring(t, s + 1, F.lit(size)).alias("part")))
        return F.filter(cut, lambda w: ~is_blank(w["part"]))

    return let(text, windows)


def _refill(text: Column, separator: str, size: int) -> Column:
    """Parts put together again as long as they fit: a walk along their lengths says which."""

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        empty = s["long"] == 0
        both = F.when(empty, x["n"]).otherwise(s["long"] + len(separator) + x["n"])
        fits = both <= size
        spill = F.when(fits | empty, F.array().cast("array<struct<first:int,n:int>>")).otherwise(F.array(F.struct(s["first"].alias("first"), (x["i"] - s["first"]).alias("n"))))
        return F.struct(F.when(fits, both).otherwise(x["n"]).cast("int").alias("long"), F.when(empty | ~fits, x["i"]).otherwise(s["first"]).alias("first")), spill

    def joined(parts: Column) -> Column:
        sizes = F.transform(parts, lambda p, i: F.struct(F.length(p).alias("n"), i.alias("i")))
        # a last part that never fits pushes the rest out, and is dropped itself
        sizes = F.concat(sizes, F.array(F.struct(F.lit(size + 1).alias("n"), F.size(parts).alias("i"))))
        runs = scan(sizes, F.struct(F.lit(0).alias("long"), F.lit(0).alias("first")), step, "struct<first:int,n:int>")
        return F.transform(runs, lambda r: F.array_join(F.slice(parts, r["first"] + 1, r["n"]), separator))

    return let(F.split(text, "\\Q" + separator + "\\E"), joined)


def recursive_pieces(text: Column, size: int) -> Column:
    pieces = F.array(text)
    for separator in SEPARATORS:
        pieces = F.flatten(F.transform(pieces, _splitter(separator, size)))
    slices = lambda p: F.transform(F.sequence(F.lit(0), F.length(p) - 1, F.lit(size)), lambda s: F.substring(p, s + 1, F.lit(size)))
    return F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(slices(p))))


def _splitter(separator: str, size: int) -> Callable[[Column], Column]:
    return lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(_refill(p, separator, size))


def recursive_split(text: Column, size: int, overlap: int) -> Column:
    """Pieces, each after the first led by the end of the one before."""
    if overlap <= 0:
        return recursive_pieces(text, size)

    def step(s: Column, p: Column) -> tuple[Column, Column]:
        t = strip(F.concat(s["tail"], p))
        return F.struct(F.when(t == "", s["tail"]).otherwise(F.right(t, F.lit(overlap))).alias("tail")), F.filter(F.array(t), lambda x: x != "")

    return scan(recursive_pieces(text, size), F.struct(F.lit("").alias("tail")), step, "string")


# What a unit's chunk says besides its text.


def without_title(text: Column, title: Column) -> Column:
    fold = lambda c: F.replace(F.lower(strip(c)), F.lit("ß"), F.lit("ss"))

    def cut(content: Column) -> Column:
        def rest(lines: Column) -> Column:
            first = F.array_position(F.transform(lines, lambda x: ~is_blank(x)), True).cast("int")
            same = (first > 0) & (fold(F.get(lines, first - 1)) == fold(title))
            return F.when(F.coalesce(same, F.lit(False)), strip(F.array_join(F.slice(lines, first + 1, F.size(lines)), "\n"))).otherwise(content)

        return F.when(F.coalesce(strip(title), F.lit("")) == "", content).otherwise(let(splitlines(content), rest))

    return let(strip(text), cut)


def contextual_text(u: Column) -> Column:
    place = F.when(F.coalesce(u["section_path"], F.lit("")) != "", F.concat(F.lit("Section path: "), u["section_path"])).when(F.coalesce(u["title"], F.lit("")) != "", F.concat(F.lit("Section: "), u["title"]))
    page = F.when(F.coalesce(u["page"], F.lit(0)) != 0, F.concat(F.lit("Page: "), u["page"].cast("string")))
    about = F.when(u["unit_type"] == "table", table_context(u["rows"])).otherwise(F.array().cast("array<string>"))
    parts = F.concat(F.array(place, page), about, F.array(without_title(u["text"], u["title"])))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n\n")


def _contextual(u: Column, **values: Column) -> Column:
    return piece(u, text=contextual_text(u), **values)


def _from_units(units: Column, text: Column, whole: Callable[[Column, Column], Column], tail: Callable[[Column], Column]) -> Column:
    """Table units whole and other units by `whole`, if any unit is a table; else the text."""
    some = F.exists(units, lambda u: u["unit_type"] == "table")
    parts = F.flatten(F.transform(units, lambda u: F.when(u["unit_type"] == "table", F.array(piece(u, text=u["text"]))).when(is_blank(u["text"]), F.expr(NONE)).otherwise(whole(u["text"], u))))
    chunks = F.when(some, parts).otherwise(tail(text))
    # the very first chunk overlaps with nothing
    return F.transform(chunks, lambda c, i: changed(c, overlap=F.when(i == 0, 0).otherwise(c["overlap"])))


def fixed_size(units: Column, text: Column, chunk_size: int, overlap: int) -> Column:
    overlap = min(overlap, chunk_size - 1)
    window = lambda w: {"text": w["part"], "start": w["start"], "end": w["start"] + F.length(w["part"]), "overlap": F.lit(overlap)}
    whole = lambda t, u: F.transform(fixed_windows(t, chunk_size, overlap), lambda w: piece(u, **window(w)))
    return numbered(_from_units(units, text, whole, lambda t: F.transform(fixed_windows(t, chunk_size, overlap), lambda w: piece(**window(w)))), "fixed_size")


def recursive(units: Column, text: Column, chunk_size: int, overlap: int, strategy: str = "recursive") -> Column:
    overlap = min(overlap, chunk_size - 1)

    def cut(t: Column, lead: int, u: Column | None) -> Column:
        kept = F.filter(F.transform(recursive_split(t, chunk_size, lead), strip), lambda p: p != "")
        return F.transform(kept, lambda p: piece(u, text=p, overlap=F.lit(lead)))

    whole = lambda t, u: F.when(u["unit_type"].isin(*CODE), cut(t, 0, u)).otherwise(cut(t, overlap, u))
    return numbered(_from_units(units, text, whole, lambda t: cut(t, overlap, None)), strategy)


def section_aware(units: Column, text: Column, strategy: str = "section_aware") -> Column:
    kept = F.filter(F.transform(F.filter(units, lambda u: u["unit_type"].isin("section", "table")), lambda u: _contextual(u)), lambda c: c["text"] != "")
    return or_else(deduped(numbered(kept, strategy)), numbered(F.array(piece(text=text, fallback=F.lit(True))), strategy))


def header_aware(units: Column, text: Column) -> Column:
    return section_aware(units, text, "header_aware")


def layout_aware(units: Column, text: Column) -> Column:
    kept = F.transform(F.filter(units, lambda u: ~is_blank(u["text"])), lambda u: _contextual(u))
    return or_else(deduped(numbered(kept, "layout_aware")), recursive(units, text, **DEFAULTS["recursive"]))


def dom_aware(units: Column, text: Column) -> Column:
    return or_else(deduped(numbered(F.transform(units, lambda u: _contextual(u)), "dom_aware")), recursive(units, text, **DEFAULTS["recursive"]))


def parent_child(units: Column, text: Column, child_size: int, child_overlap: int) -> Column:
    def children(u: Column, said: Column) -> Column:
        def cut(lead: int) -> Column:
            return F.filter(F.transform(recursive_split(said, child_size, min(lead, child_size - 1)), strip), lambda p: p != "")

        short = u["unit_type"].isin(*CODE) | (F.length(u["text"]) < child_size)
        # a table's child is its own text, not what is said of it
        texts = F.when(u["unit_type"] == "table", F.array(strip(u["text"]))).when(short, cut(0)).otherwise(cut(child_overlap))
        lead = F.when(short | (u["unit_type"] == "table"), 0).otherwise(min(child_overlap, child_size - 1))
        return F.transform(texts, lambda p, i: piece(u, text=p, overlap=F.when(i == 0, 0).otherwise(lead), role=F.lit("child")))

    def group(u: Column) -> Column:
        return let(contextual_text(u), lambda said: F.struct(piece(u, text=said, role=F.lit("parent")).alias("parent"), children(u, said).alias("children")))

    whole = F.array(X.unit(unit_id=F.lit("doc"), unit_type=F.lit("document"), text=text))
    groups = F.transform(let(units, lambda u: F.when(F.size(u) > 0, u).otherwise(whole)), group)
    start = F.struct(F.lit(1).alias("n"), F.expr(NONE).alias("out"))

    def step(s: Column, g: Column) -> Column:
        pid = F.concat(F.lit("parent_child-"), s["n"].cast("string"))
        kids = F.transform(g["children"], lambda c, i: changed(c, chunk_id=F.concat(pid, F.lit("-child-"), (i + 1).cast("string")), strategy_id=F.lit("parent_child"), parent_id=pid))
        parent = changed(g["parent"], chunk_id=pid, strategy_id=F.lit("parent_child"), text=strip(g["parent"]["text"]), children=F.transform(kids, lambda k: k["chunk_id"]))
        return F.struct((s["n"] + 1 + F.size(g["children"])).cast("int").alias("n"), F.concat(s["out"], F.array(parent), kids).alias("out"))

    return deduped(F.aggregate(groups, start, step, lambda s: s["out"]))


def _with_tables(chunks: Column, units: Column, strategy: str) -> Column:
    tables = F.filter(units, lambda u: (u["unit_type"] == "table") & ~is_blank(u["text"]))
    return numbered(F.concat(chunks, F.transform(tables, lambda u: _contextual(u))), strategy)


def semantic(units: Column, text: Column, sentences_per_chunk: int) -> Column:
    n = sentences_per_chunk
    groups = F.transform(X.sentence_groups(text, n), lambda g, i: piece(text=g, sentence_start=i * n + 1, sentence_end=i * n + n))
    return or_else(_with_tables(groups, units, "semantic"), recursive(units, text, **DEFAULTS["recursive"]))


def adaptive(units: Column, text: Column, target_chars: int) -> Column:
    return F.when(F.size(units) > 2, layout_aware(units, text)).otherwise(recursive(units, text, target_chars, int(target_chars * 0.1)))


def clause_aware(units: Column, text: Column) -> Column:
    return _with_tables(F.transform(X.clauses(text, colons=False), lambda c, i: piece(text=c, clause=i + 1)), units, "clause_aware")


def ocr_aware(units: Column, text: Column, chunk_size: int, overlap: int) -> Column:
    return F.transform(recursive(units, text, chunk_size, overlap), lambda c: changed(c, strategy_id=F.lit("ocr_aware")))


def table_aware(units: Column, text: Column) -> Column:
    explicit = F.exists(units, lambda u: u["unit_type"] == "table")
    is_table = lambda u: (u["unit_type"] == "table") | ~explicit & F.contains(u["text"], F.lit("|"))
    kept = F.filter(units, lambda u: is_table(u) | ~is_blank(u["text"]))
    return or_else(deduped(numbered(F.transform(kept, lambda u: _contextual(u, is_table=is_table(u))), "table_aware")), layout_aware(units, text))


_DEFINES = rf"(?m)^{WS}*(?:async{WS}+)?(?:def|class|function){WS}+[A-Za-z_][\p{{L}}\p{{N}}_]*"


def code_function(units: Column, text: Column) -> Column:
    own = F.filter(units, lambda u: u["unit_type"].isin(*CODE, "table"))
    chunks = F.transform(own, lambda u: F.when(u["unit_type"] == "table", _contextual(u)).otherwise(piece(u, text=u["text"], symbol=u["symbol"])))
    found = let(spans(text, _DEFINES), lambda m: F.zip_with(m, cut_at(text, F.transform(m, lambda x: x["start"])), lambda x, part: piece(text=part, symbol=F.regexp_extract(x["m"], r"([A-Za-z_][\p{L}\p{N}_]*)\z", 1))))
    return or_else(numbered(chunks, "code_function"), or_else(numbered(found, "code_function"), recursive(units, text, **DEFAULTS["recursive"])))


def multi_modal(units: Column, text: Column) -> Column:
    return layout_aware(units, text)


CHUNKERS: dict[str, tuple[str, Callable[..., Column]]] = {
    "fixed_size": ("Fixed-size Chunking", fixed_size),
    "recursive": ("Recursive Chunking", recursive),
    "header_aware": ("Header-aware Chunking", header_aware),
    "section_aware": ("Section-aware Chunking", section_aware),
    "layout_aware": ("Layout-aware Chunking", layout_aware),
    "dom_aware": ("DOM-aware Chunking", dom_aware),
    "parent_child": ("Parent-Child Chunking", parent_child),
    "semantic": ("Semantic Chunking", semantic),
    "adaptive": ("Adaptive Chunking", adaptive),
    "clause_aware": ("Clause-aware Chunking", clause_aware),
    "ocr_aware": ("OCR-aware Chunking", ocr_aware),
    "table_aware": ("Table-aware Chunking", table_aware),
    "code_function": ("Code Function-aware Chunking", code_function),
    "multi_modal": ("Multi-modal Chunking", multi_modal),
}


def get_chunker(strategy: str) -> tuple[str, Callable[..., Column]]:
    if strategy not in CHUNKERS:
        raise KeyError(strategy)
    return CHUNKERS[strategy]


def chunk(docs: DataFrame, method: str, strategy: str, **config: int) -> DataFrame:
    """docs (doc_id, name, text) -> one row per chunk: doc_id, method_id, requested_strategy,
    chunk_ord from 1, FIELDS."""
    _, make = get_chunker(strategy)
    settings = {**DEFAULTS.get(strategy, {}), **config}
    d = X.extracted(docs, method)
    chunks = make(F.col("units"), F.col("text"), **settings)
    out = d.select("doc_id", F.posexplode(chunks).alias("p", "c"))
    return out.select("doc_id", F.lit(method).alias("method_id"), F.lit(strategy).alias("requested_strategy"), (F.col("p") + 1).alias("chunk_ord"), *[F.col(f"c.{k}").alias(k) for k in FIELDS])
