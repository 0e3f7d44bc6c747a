"""Units of Word files: expressions over the items that sources.docx reads.

Every unit keeps its place in the body. Numbers of pages come from one walk over lengths;
sections are the stretches between headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, let, scan, strip
from ..sources.docx import docx_items
from . import tables as T
from .extract import FIELDS, changed, ordered, unit, with_context
from .sections import derived_title, is_inferred, is_numbered, numbered_title

#: Characters of an estimated page; characters by which a table's page is looked up.
PAGE, PROBE = 2600, 120


def _paragraphs(items: Column) -> Column:
    return F.filter(F.transform(items, lambda x: x.withField("text", strip(x["text"]))), lambda x: x["text"] != "")


def _later(items: Column) -> Column:
    """Each item beside the one after it."""
    after = F.concat(F.slice(items, F.lit(2), F.greatest(F.size(items), F.lit(1))), F.array(F.lit(None)))
    return F.zip_with(items, after, lambda x, y: F.struct(x.alias("p"), y["text"].alias("next")))


def whole_text(items: Column) -> Column:
    """Paragraphs, then all tables as lines of cells."""
    rows = lambda t: F.transform(t["cells"], lambda r: F.array_join(F.transform(r, strip), " | "))
    found = F.transform(F.filter(items, lambda x: x["cells"].isNotNull()), lambda t: F.array_join(rows(t), "\n"))
    return F.array_join(F.concat(F.transform(_paragraphs(items), lambda p: p["text"]), found), "\n\n")


def _tables(items: Column, places: bool) -> Column:
    """Units of the valid tables. places: in body order, else behind all texts."""
    every = F.transform(F.filter(items, lambda x: x["cells"].isNotNull()), lambda x, i: F.struct(T.clean_rows(x["cells"]).alias("rows"), (x["place"] if places else i + 1_000_001).cast("double").alias("k1")))
    return F.transform(
        F.filter(every, lambda t: T.is_valid(t["rows"])),
        lambda t, i: unit(k1=t["k1"], unit_id=F.concat(F.lit("table-"), (i + 1).cast("string")), unit_type=F.lit("table"), text=T.to_markdown(t["rows"]), table_index=i + 1, format=F.lit("docx"), rows=t["rows"], row_count=F.size(t["rows"]), column_count=T.column_count(t["rows"])),
    )


def table_units(items: Column) -> Column:
    return _tables(items, False)


def block_units(items: Column) -> Column:
    """Paragraphs and valid tables in body order."""
    texts = F.transform(_paragraphs(items), lambda p, i: unit(k1=p["place"], k2=F.lit(0), unit_id=F.concat(F.lit("paragraph-"), (i + 1).cast("string")), unit_type=F.lit("paragraph"), text=p["text"]))
    return ordered(F.concat(texts, _tables(items, True)))


def joined(units: Column) -> Column:
    return strip(F.array_join(F.transform(units, lambda u: u["text"]), "\n\n"))


def page_units(items: Column) -> Column:
    """Pages by the file's own breaks, without any by length; tables beside them."""
    return let(block_units(items), lambda units: _paged(items, units))


def _paged(items: Column, units: Column) -> Column:
    breaks = F.transform(F.filter(items, lambda x: x["breaks"]), lambda x: x["place"].cast("double"))
    explicit = F.exists(breaks, lambda b: b >= F.coalesce(F.get(units, F.lit(0))["k1"], F.lit(1e18)))
    # places and lengths alone; a break follows the unit at its own place, and has no length
    marks = F.transform(breaks, lambda b: F.struct(b.alias("k"), F.lit(1).alias("after"), F.lit(0).alias("size")))
    walked = F.array_sort(F.concat(F.transform(units, lambda u: F.struct(u["k1"].alias("k"), F.lit(0).alias("after"), F.length(u["text"]).alias("size"))), marks))

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        is_break = x["after"] == 1
        full = ~s["breaks"] & (s["size"] > 0) & (s["size"] + 2 + x["size"] > PAGE)
        ends = (s["size"] > 0) & (is_break | full)
        page = s["page"] + ends.cast("int")
        size = F.when(is_break, 0).when(ends | (s["size"] == 0), x["size"]).otherwise(s["size"] + 2 + x["size"])
        return F.struct(page.alias("page"), size.alias("size"), s["breaks"].alias("breaks")), F.when(is_break, F.array().cast("array<int>")).otherwise(F.array(page))

    numbers = scan(walked, F.struct(F.lit(1).alias("page"), F.lit(0).alias("size"), F.coalesce(explicit, F.lit(False)).alias("breaks")), step, "int")
    reason = F.when(explicit, "explicit_break").otherwise("estimated_docx_page")

    def made(placed: Column) -> Column:
        def page(n: Column) -> Column:
            own = F.transform(F.filter(placed, lambda x: x["page"] == n), lambda x: x["u"])
            return let(own, lambda o: unit(k1=o[0]["k1"], k2=F.lit(0), unit_id=F.concat(F.lit("page-"), n.cast("string")), unit_type=F.lit("page"), text=joined(o), page=n, reason=reason))

        return let(F.transform(F.array_distinct(F.transform(placed, lambda x: x["page"])), page), with_tables)

    def with_tables(pages: Column) -> Column:
        def on(t: Column) -> Column:
            return F.get(F.filter(pages, lambda p: F.contains(p["text"], F.substring(t["text"], 1, PROBE))), F.lit(0))["page"]

        return ordered(F.concat(pages, F.transform(F.filter(units, lambda u: u["unit_type"] == "table"), lambda t: changed(t, page=on(t)))))

    return let(F.zip_with(units, numbers, lambda u, n: F.struct(u.alias("u"), n.alias("page"))), made)


def _heading(x: Column) -> Column:
    """struct<title, level> of a paragraph beside the next one, null if it is no heading."""
    p, after = x["p"], F.coalesce(x["next"], F.lit(""))
    text, style = p["text"], F.coalesce(p["style"], F.lit(""))
    named = F.regexp_extract(style, rf"(?i)heading{WS}*([0-9]+)", 1)
    level = (
        F.when(p["outline"].isNotNull(), p["outline"]).when(named != "", named.cast("int")).when(style.rlike(r"(?i)\b(title|subtitle|section|chapter)\b"), 1)
        .when(is_numbered(text, after), F.size(F.split(F.regexp_extract(text, r"\A([0-9]+(?:\.[0-9]+)*)", 1), r"\."))).when(is_inferred(text, after), 1)
    )
    by_style = p["outline"].isNotNull() | (named != "") | style.rlike(r"(?i)\b(title|subtitle|section|chapter)\b")
    title = F.when(~by_style & is_numbered(text, after), numbered_title(text)).otherwise(text)
    return F.when(level.isNotNull(), F.struct(title.alias("title"), level.cast("int").alias("level")))


def section_units(items: Column) -> Column:
    """Sections from heading to heading, and the valid tables, each under the heading before it."""
    marked = F.transform(_later(_paragraphs(items)), lambda x, i: F.struct(i.cast("int").alias("i"), x["p"]["place"].alias("place"), x["p"]["text"].alias("text"), _heading(x).alias("h")))
    return let(marked, lambda ps: let(F.filter(ps, lambda p: p["h"].isNotNull() | (p["i"] == 0)), lambda starts: _sectioned(items, ps, starts)))


def _sectioned(items: Column, ps: Column, starts: Column) -> Column:
    def section(s: Column, k: Column) -> Column:
        until = F.coalesce(F.get(starts, k + 1)["i"], F.size(ps))
        text = strip(F.array_join(F.transform(F.slice(ps, s["i"] + 1, until - s["i"]), lambda p: p["text"]), "\n\n"))
        known = s["h"].isNotNull()
        return let(text, lambda t: unit(k1=s["place"], k2=F.lit(0), unit_id=F.concat(F.lit("section-"), (k + 1).cast("string")), unit_type=F.lit("section"), text=t, title=F.when(known, s["h"]["title"]).otherwise(derived_title(t)), level=F.coalesce(s["h"]["level"], F.lit(1)), section=k + 1, reason=F.when(known, "docx_heading").otherwise("before_first_heading")))

    def placed(t: Column) -> Column:
        above = F.filter(starts, lambda s: (s["place"] < t["k1"]) & s["h"].isNotNull())
        return let(F.get(above, F.size(above) - 1)["h"]["title"], lambda title: changed(t, parent_section_title=title, section_path=title))

    return ordered(F.concat(F.transform(starts, section), F.transform(_tables(items, True), placed)))


DOCX_EXTRACTORS = {"page_wise": page_units, "block_wise": block_units, "layout_aware": block_units, "section_wise": section_units, "hierarchical": section_units, "table_aware": table_units}


def extract_docx(files: DataFrame, method: str) -> DataFrame:
    """files (doc_id, content) -> one row per unit, as extract() gives; files that can't be read have none."""
    if method not in DOCX_EXTRACTORS:
        raise KeyError(method)
    d = files.select("doc_id", docx_items("content").alias("items")).where("items is not null")
    d = d.select("doc_id", F.posexplode(with_context(DOCX_EXTRACTORS[method](F.col("items")))).alias("p", "u"))
    return d.select("doc_id", F.lit(method).alias("method_id"), (F.col("p") + 1).alias("unit_ord"), *[F.col(f"u.{k}").alias(k) for k in FIELDS if k != "n"])
