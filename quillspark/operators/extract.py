"""Extractors: documents to units, one row per unit in reading order.

A document is (doc_id, name, text). Each extractor is an expression that makes an array
of units from one row, so extraction is narrow whatever the method; context is carried
along the array. A document is never split over tasks, nor are two brought together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.code import python_spans
from ..functions.html import html_table_rows, html_to_text, html_without_tables
from ..functions.text import WS, cut_at, let, normalize_whitespace, non_blank, spans, split_sentences, splitlines, strip, suffix
from . import tables as T
from .sections import sections

#: k1, k2 and n order the units: place, tables after texts, then as made.
FIELDS = {
    "k1": "double", "k2": "int", "n": "int", "unit_id": "string", "unit_type": "string", "text": "string", "title": "string", "level": "int", "section": "int", "reason": "string",
    "page": "int", "block": "int", "clause": "int", "segment": "int", "symbol": "string", "kind": "string", "line_start": "int", "line_end": "int",
    "table_index": "int", "format": "string", "rows": "array<array<string>>", "row_count": "int", "column_count": "int",
    "parent_section_id": "string", "parent_section_title": "string", "section_path": "string",
}
UNIT = "struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">"
#: The order of a unit without a place of its own.
LAST = 1e9
#: Sentences in a semantic segment.
SEGMENT = 5


def unit(**values: Column) -> Column:
    values = {"k1": F.lit(LAST), "k2": F.lit(1), **values}
    return F.struct(*[(values[k] if k in values else F.lit(None)).cast(t).alias(k) for k, t in FIELDS.items()])


def changed(u: Column, **values: Column) -> Column:
    return F.struct(*[(values[k].cast(t) if k in values else u[k]).alias(k) for k, t in FIELDS.items()])


def units_of(parts: Column, prefix: str, unit_type: str, **extra: Callable[[Column], Column]) -> Column:
    """Units of an array of texts, numbered from 1."""
    return F.transform(parts, lambda p, i: unit(unit_id=F.concat(F.lit(prefix + "-"), (i + 1).cast("string")), unit_type=F.lit(unit_type), text=p, **{k: f(i + 1) for k, f in extra.items()}))


def section_units(text: Column) -> Column:
    return F.transform(sections(text), lambda s: unit(k1=F.coalesce(s["section"].cast("double"), F.lit(LAST)), k2=F.when(s["section"].isNull(), 1).otherwise(0), unit_id=s["unit_id"], unit_type=F.lit("section"), text=s["text"], title=s["title"], level=s["level"], section=s["section"], reason=s["reason"]))


def table_units(found: Column) -> Column:
    return F.transform(
        found,
        lambda t: unit(k1=t["sort_order"], unit_id=F.concat(F.lit("table-"), t["table_index"].cast("string")), unit_type=F.lit("table"), text=T.to_markdown(t["rows"]), table_index=t["table_index"], format=t["format"], rows=t["rows"], row_count=F.size(t["rows"]), column_count=T.column_count(t["rows"])),
    )


def html_tables(page: Column) -> Column:
    """array<struct<table_index, format, rows, sort_order>>: order counts all tables, index the valid ones."""
    every = F.transform(html_table_rows(page), lambda rows, i: F.struct(T.clean_rows(rows).alias("rows"), (i + T.TABLE_ORDER + 1).cast("double").alias("sort_order")))
    good = F.filter(every, lambda t: T.is_valid(t["rows"]))
    return F.transform(good, lambda t, i: F.struct((i + 1).alias("table_index"), F.lit("html").alias("format"), t["rows"].alias("rows"), t["sort_order"].alias("sort_order")))


# Order and context along a document's units.


def ordered(units: Column) -> Column:
    numbered = F.transform(units, lambda u, i: changed(u, n=i))
    return F.array_sort(numbered)  # k1, k2 and n come first


def with_context(units: Column) -> Column:
    """Carries the last section's id, title and path on to the units after it; tables before
    any section take the next one's."""
    start = F.struct(F.lit("").alias("id"), F.lit("").alias("title"), F.array().cast("array<string>").alias("path"), F.expr(f"cast(array() as array<{UNIT}>)").alias("out"))

    def step(s: Column, u: Column) -> Column:
        title = strip(F.coalesce(u["title"], F.lit("")))
        return let(title, lambda t: let(new_path(s, u, t), lambda p: next_state(s, u, t, p)))

    def new_path(s: Column, u: Column, title: Column) -> Column:
        level = F.greatest(F.lit(1), F.coalesce(F.nullif(u["level"], F.lit(0)), F.lit(1)))
        kept = F.slice(s["path"], F.lit(1), F.least(level - 1, F.size(s["path"])))
        path = F.concat(kept, F.when(title != "", F.array(title)).otherwise(F.array().cast("array<string>")))
        return F.when(u["unit_type"] == "section", path).otherwise(s["path"])

    def next_state(s: Column, u: Column, title: Column, path: Column) -> Column:
        is_section = u["unit_type"] == "section"
        known = ~is_section & (s["id"] != "")
        placed = changed(
            u,
            parent_section_id=F.coalesce(u["parent_section_id"], F.when(known, s["id"])),
            parent_section_title=F.coalesce(u["parent_section_title"], F.when(known, s["title"])),
            section_path=F.when(is_section, F.array_join(path, " > ")).otherwise(F.coalesce(u["section_path"], F.when(known, F.array_join(path, " > ")))),
        )
        return F.struct(F.when(is_section, u["unit_id"]).otherwise(s["id"]).alias("id"), F.when(is_section, title).otherwise(s["title"]).alias("title"), path.alias("path"), F.concat(s["out"], F.array(placed)).alias("out"))

    def settled(out: Column) -> Column:
        return F.transform(out, lambda u, i: F.when((u["unit_type"] == "table") & (F.coalesce(u["parent_section_id"], F.lit("")) == ""), let(F.get(F.filter(F.slice(out, i + 1, F.size(out)), lambda x: x["unit_type"] == "section"), F.lit(0)), lambda later: under(u, later))).otherwise(u))

    def under(u: Column, later: Column) -> Column:
        return changed(u, parent_section_id=F.coalesce(later["unit_id"], u["parent_section_id"]), parent_section_title=F.when(later.isNotNull(), strip(F.coalesce(later["title"], F.lit("")))).otherwise(u["parent_section_title"]), section_path=F.coalesce(later["section_path"], u["section_path"]))

    return let(F.aggregate(units, start, step, lambda s: s["out"]), settled)


# One expression for each method. d holds the document's text, its table-free text, and its tables.


def _whole(d: DataFrame) -> Column:
    return F.concat(F.array(unit(unit_id=F.lit("doc"), unit_type=F.lit("document"), text=F.col("text"))), table_units(F.col("found")))


def _pages(d: DataFrame) -> Column:
    return F.concat(F.filter(F.array(unit(k1=F.lit(10_000.0), k2=F.lit(0), unit_id=F.lit("page-1"), unit_type=F.lit("page"), text=strip(F.col("text")), page=F.lit(1))), lambda u: u["text"] != ""), table_units(F.col("found")))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, rf"\n{WS}*\n"), normalize_whitespace), lambda p: p != "")


def _blocks(d: DataFrame) -> Column:
    return F.concat(units_of(paragraphs(F.col("text")), "block", "paragraph", block=lambda i: i), table_units(F.col("found")))


def _sections(d: DataFrame) -> Column:
    return F.concat(section_units(F.col("plain")), table_units(F.col("found")))


def sentence_groups(text: Column, size: int) -> Column:
    """Every `size` sentences as one text."""

    def groups(said: Column) -> Column:
        starts = F.filter(F.transform(said, lambda _, i: i), lambda i: i % size == 0)
        return F.transform(starts, lambda i: F.array_join(F.slice(said, i + 1, size), " "))

    return let(split_sentences(text), groups)


def _segments(d: DataFrame) -> Column:
    whole = F.array(unit(unit_id=F.lit("semantic-1"), unit_type=F.lit("semantic_segment"), text=F.col("text")))

    def grouped(g: Column) -> Column:
        return F.when(F.size(g) > 0, units_of(g, "semantic", "semantic_segment", segment=lambda i: i)).otherwise(whole)

    return F.concat(let(sentence_groups(F.col("text"), SEGMENT), grouped), table_units(F.col("found")))


#: The enumerator stands first among the alternatives, so that it is found where a text can also be cut without length.
ENUMERATOR = rf"\n{WS}*(?:\([a-z0-9]+\)|[a-z0-9]+\.){WS}+"


def clauses(text: Column, colons: bool = True) -> Column:
    return non_blank(F.split(text, f"{ENUMERATOR}|(?<=;)" + "|(?<=:)" * colons))


def _clauses(d: DataFrame) -> Column:
    return F.concat(units_of(clauses(F.col("text")), "clause", "clause", clause=lambda i: i), table_units(F.col("found")))


_SYMBOL = rf"(?m)^{WS}*(?:async{WS}+)?(?:(?:def|class|function){WS}+[A-Za-z_][\p{{L}}\p{{N}}_]*|(?:const|let|var){WS}+[A-Za-z_][\p{{L}}\p{{N}}_]*{WS}*=|(?:public|private|protected){WS}+(?:static{WS}+)?[\p{{L}}\p{{N}}_<>\[\],]+{WS}+[A-Za-z_][\p{{L}}\p{{N}}_]*{WS}*\()"


def symbols(text: Column) -> Column:
    """Units from each line that defines a symbol to the next such line."""
    return let(spans(text, _SYMBOL), lambda marks: _symbol_units(marks, cut_at(text, F.transform(marks, lambda m: m["start"]))))


def _symbol_units(marks: Column, parts: Column) -> Column:
    def one(m: Column, part: Column) -> Column:
        head = strip(m["m"])
        keyword = F.regexp_extract(head, r"\A(?:async\s+)?(\w+)", 1)
        kind = F.when(head.startswith("async") & (keyword == "def"), "async def").otherwise(keyword)
        name = F.regexp_extract(F.regexp_replace(head, rf"{WS}*[=(]\z", ""), r"([A-Za-z_][\p{L}\p{N}_]*)\z", 1)
        return F.struct(strip(part).alias("text"), kind.alias("kind"), name.alias("symbol"))

    return F.transform(F.zip_with(marks, parts, one), lambda s, i: unit(unit_id=F.concat(F.lit("code-"), (i + 1).cast("string")), unit_type=F.lit("code_symbol"), text=s["text"], symbol=s["symbol"], kind=s["kind"]))


def _code(d: DataFrame) -> Column:
    return let(splitlines(F.col("text")), _code_units)


def _code_units(lines: Column) -> Column:
    py = F.col("py")  # no Python function may stand inside a lambda
    spanned = F.transform(py, lambda s: F.struct(F.regexp_replace(F.regexp_replace(F.array_join(F.slice(lines, s["line_start"], s["line_end"] - s["line_start"] + 1), "\n"), r"\A\n+", ""), r"\n+\z", "").alias("text"), s.alias("s")))
    own = F.transform(F.filter(spanned, lambda x: strip(x["text"]) != ""), lambda x, i: unit(unit_id=F.concat(F.lit("code-"), (i + 1).cast("string")), unit_type=x["s"]["unit_type"], text=x["text"], symbol=x["s"]["symbol"], kind=x["s"]["kind"], line_start=x["s"]["line_start"], line_end=x["s"]["line_end"]))
    by_line = symbols(F.col("text"))
    base = let(own, lambda o: F.when(F.coalesce(F.size(o), F.lit(0)) > 0, o).otherwise(let(by_line, lambda b: F.when(F.size(b) > 0, b).otherwise(section_units(F.col("text"))))))
    return F.concat(base, table_units(F.col("found")))


def _ocr(d: DataFrame) -> Column:
    return F.array(unit(unit_id=F.lit("ocr-layer-1"), unit_type=F.lit("ocr_text"), text=F.col("text")))


def _idp(d: DataFrame) -> Column:
    return F.concat(section_units(F.col("text")), table_units(F.col("found")))


EXTRACTORS: dict[str, tuple[str, Callable[[DataFrame], Column]]] = {
    "whole_text": ("Whole Text Extraction", _whole),
    "page_wise": ("Page-wise Extraction", _pages),
    "block_wise": ("Block-wise Extraction", _blocks),
    "section_wise": ("Section-wise Extraction", _sections),
    "hierarchical": ("Hierarchical Extraction", _sections),
    "layout_aware": ("Layout-aware Extraction", _sections),
    "table_aware": ("Table-aware Extraction", _sections),
    "semantic_segmentation": ("Semantic Segmentation", _segments),
    "clause_aware": ("Clause-aware Extraction", _clauses),
    "code_aware": ("Code-aware Extraction", _code),
    "ocr": ("OCR-based Extraction", _ocr),
    "handwritten_ocr": ("Handwritten OCR", _ocr),
    "idp": ("Intelligent Document Processing", _idp),
}


def get_extractor(method: str) -> tuple[str, Callable[[DataFrame], Column]]:
    if method not in EXTRACTORS:
        raise KeyError(method)
    return EXTRACTORS[method]


def read_text(docs: DataFrame) -> DataFrame:
    """(…, text, plain, found): a document's text, the same without its tables, and the tables.
    HTML goes through a parser; all else stays in expressions."""
    kind = suffix(F.col("name"))
    is_html, strips = kind.isin(".html", ".htm"), kind.isin(".txt", ".md", ".markdown")
    raw = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("raw", raw).withColumn("text", F.when(is_html, html_to_text("raw")).otherwise(F.col("raw")))
    d = d.withColumn("runs", T.islands(F.col("text")))
    plain = F.when(is_html, html_without_tables("raw")).when(strips, T.without_tables(F.col("text"), F.col("runs"))).otherwise(F.col("text"))
    return d.withColumn("plain", plain).withColumn("found", F.when(is_html, html_tables(F.col("raw"))).otherwise(T.tables(F.col("runs")))).drop("raw", "runs")


def _ready(docs: DataFrame, method: str) -> DataFrame:
    d = read_text(docs.select("doc_id", "name", "text"))
    if method == "code_aware":
        d = d.withColumn("py", F.when(suffix(F.col("name")) == ".py", python_spans(F.col("text"))))
    return d


def extract(docs: DataFrame, method: str) -> DataFrame:
    """docs (doc_id, name, text) -> one row per unit: doc_id, method_id, unit_ord from 1, UNIT's fields."""
    _, make = get_extractor(method)
    d = _ready(docs, method)
    units = with_context(ordered(make(d)))
    return d.select("doc_id", F.lit(method).alias("method_id"), F.posexplode(units).alias("p", "u")).select("doc_id", "method_id", (F.col("p") + 1).alias("unit_ord"), *[F.col(f"u.{k}").alias(k) for k in FIELDS if k != "n"])


def extracted(docs: DataFrame, method: str) -> DataFrame:
    """(doc_id, text, units): a method's result text and its units, one row per document."""
    _, make = get_extractor(method)
    d = _ready(docs, method)
    d = d.withColumn("units", with_context(ordered(make(d))))
    texts = lambda of: F.transform(of, lambda u: u["text"])
    text = F.col("text")
    if method in ("section_wise", "hierarchical", "layout_aware"):
        found = F.filter("units", lambda u: u["unit_type"] == "table")
        text = strip(F.array_join(F.filter(F.concat(F.array(F.col("plain")), texts(found)), lambda x: x != ""), "\n\n"))
    elif method == "table_aware":
        text = strip(F.array_join(texts(F.col("units")), "\n\n"))
    return d.select("doc_id", text.alias("text"), "units")


def extraction_texts(docs: DataFrame, method: str) -> DataFrame:
    """(doc_id, method_id, method_name, text, unit_count, character_count, tables_detected)."""
    d = extracted(docs, method)
    found = F.size(F.filter("units", lambda u: u["unit_type"] == "table"))
    return d.select("doc_id", F.lit(method).alias("method_id"), F.lit(get_extractor(method)[0]).alias("method_name"), "text", F.size("units").alias("unit_count"), F.length("text").alias("character_count"), found.alias("tables_detected"))


def hierarchy(units: DataFrame) -> DataFrame:
    """Adds parent_unit_id, depth and the path by actual ancestors: each unit hangs on the last
    section before it of a lesser level (any section, for what is none)."""
    rows = units.groupBy("doc_id", "method_id").agg(F.array_sort(F.collect_list(F.struct("unit_ord", "unit_id", "unit_type", F.greatest(F.lit(1), F.coalesce("level", F.lit(1))).alias("level"), F.coalesce("title", F.lit("")).alias("title")))).alias("us"))
    node = "struct<unit_id:string,level:int,title:string>"
    start = F.struct(F.expr(f"cast(array() as array<{node}>)").alias("stack"), F.expr("cast(array() as array<struct<unit_ord:int,parent:string,parent_title:string,depth:int,path:string>>)").alias("out"))

    def step(s: Column, u: Column) -> Column:
        is_section = u["unit_type"] == "section"
        stack = F.when(is_section, F.filter(s["stack"], lambda x: x["level"] < u["level"])).otherwise(s["stack"])
        up = F.get(stack, F.size(stack) - 1)
        titles = F.filter(F.concat(F.transform(stack, lambda x: strip(x["title"])), F.when(is_section, F.array(strip(u["title"]))).otherwise(F.array().cast("array<string>"))), lambda t: t != "")
        one = F.struct(u["unit_ord"].cast("int").alias("unit_ord"), up["unit_id"].alias("parent"), up["title"].alias("parent_title"), F.size(stack).cast("int").alias("depth"), F.array_join(titles, " > ").alias("path"))
        own = F.array(F.struct(u["unit_id"].alias("unit_id"), u["level"].cast("int").alias("level"), u["title"].alias("title")))
        return F.struct(F.when(is_section, F.concat(stack, own)).otherwise(stack).alias("stack"), F.concat(s["out"], F.array(one)).alias("out"))

    placed = rows.select("doc_id", "method_id", F.explode(F.aggregate("us", start, step, lambda s: s["out"])).alias("x"))
    placed = placed.select("doc_id", "method_id", F.col("x.unit_ord").alias("unit_ord"), F.col("x.parent").alias("parent_unit_id"), F.col("x.depth").alias("depth"), F.col("x.path").alias("__path"), F.col("x.parent_title").alias("__title"))
    joined = units.join(placed, ["doc_id", "method_id", "unit_ord"])
    return joined.withColumn("parent_section_id", F.col("parent_unit_id")).withColumn("parent_section_title", F.col("__title")).withColumn("section_path", F.when(F.col("__path") != "", F.col("__path"))).drop("__path", "__title")
