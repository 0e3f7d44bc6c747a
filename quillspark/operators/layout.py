"""Geometry and headings of page blocks: (doc_id, block_ord, text, page, x0, y0, x1, y1, max_size, is_table)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_whitespace, strip, words
from .sections import looks_like_footer
from .tables import column_count, is_valid

#: Share of a block inside a table that makes it part of the table, and tallest table.
OVERLAP, TALLEST = 0.15, 520


def overlap_ratio(a: list[Column], b: list[Column]) -> Column:
    """Intersection over the area of a, which counts as 1 at least."""
    width = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return width * height / F.greatest(F.lit(1.0), (a[2] - a[0]) * (a[3] - a[1]))


def position_order(page: Column, y0: Column) -> Column:
    return page * 10_000 + y0


def _inside(blocks: DataFrame, areas: DataFrame, how: str) -> DataFrame:
    box = lambda df: [df[c] for c in ("x0", "y0", "x1", "y1")]
    same = (blocks["doc_id"] == areas["doc_id"]) & (blocks["page"] == areas["page"])
    return blocks.join(areas, same & (overlap_ratio(box(blocks), box(areas)) > OVERLAP), how)


def blocks_in_tables(blocks: DataFrame, areas: DataFrame) -> DataFrame:
    return _inside(blocks, areas, "left_semi")


def blocks_outside_tables(blocks: DataFrame, areas: DataFrame) -> DataFrame:
    return _inside(blocks, areas, "left_anti")


def dominant_body_size(blocks: DataFrame) -> DataFrame:
    """(doc_id, body_size): the commonest rounded size of at least 8, the first seen among equals; 12 if none."""
    sized = blocks.select("doc_id", "block_ord", F.bround("max_size").alias("size")).where("size >= 8")
    n = sized.groupBy("doc_id", "size").agg(F.count(F.lit(1)).alias("n"), F.min("block_ord").alias("first"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")
    best = n.withColumn("r", F.row_number().over(w)).where("r = 1").select("doc_id", F.col("size").alias("body_size"))
    return blocks.select("doc_id").distinct().join(best, "doc_id", "left").withColumn("body_size", F.coalesce("body_size", F.lit(12.0)))


def repeated_texts(blocks: DataFrame, pages: int = 3, longest: int = 80) -> DataFrame:
    """Texts that stand on several pages of a document."""
    t = blocks.select("doc_id", "page", strip(F.col("text")).alias("text")).where((F.col("text") != "") & (F.length("text") <= longest))
    return t.groupBy("doc_id", "text").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= pages)


def normalized_heading(text: Column) -> Column:
    return F.replace(F.lower(normalize_whitespace(text)), F.lit("ß"), F.lit("ss"))


def is_structural_heading(text: Column, page: Column, x0: Column, y0: Column) -> Column:
    letters = F.regexp_extract_all(text, F.lit("[A-Za-z]"), F.lit(0))
    capital = F.size(F.filter(letters, lambda c: c.rlike("[A-Z]"))).cast("double") / F.greatest(F.lit(1), F.size(letters))
    shape = text.rlike(r"\A\(?[A-Z]\)\s+[A-Z][A-Z\s-]+\z") | text.rlike(r"\A[0-9]+[.)]?\s+[A-Z][A-Z\s/&-]+\z") | ((capital >= 0.85) & (F.size(words(text)) <= 7))
    return (page > 2) & (x0 <= 90) & (y0 >= 70) & (y0 <= 720) & shape


def is_heading(text: Column, page: Column, x0: Column, y0: Column, max_size: Column, body_size: Column) -> Column:
    s = strip(text)
    large = F.when(max_size >= body_size + 3, s.rlike("[A-Za-z]")).otherwise(is_structural_heading(s, page, x0, y0))
    return ~looks_like_footer(s) & (F.length(s) <= 90) & (F.size(words(s)) <= 8) & ~s.rlike(r"[.!?]\z") & (F.upper(s).isin("INDEX", "TABLE OF CONTENTS") | large)


def heading_sections(blocks: DataFrame) -> DataFrame:
    """(doc_id, section, title, text): blocks gathered under the heading before them, without
    footers, table blocks and texts that repeat over pages."""
    b = blocks.join(dominant_body_size(blocks), "doc_id")
    b = b.withColumn("heading", is_heading(F.col("text"), F.col("page"), F.col("x0"), F.col("y0"), F.col("max_size"), F.col("body_size")) & ~F.col("is_table"))
    b = b.withColumn("section", F.sum(F.col("heading").cast("int")).over(Window.partitionBy("doc_id").orderBy("block_ord")))
    titles = b.where("heading").select("doc_id", "section", F.col("text").alias("title"))
    body = b.where(~F.col("heading") & ~F.col("is_table") & ~looks_like_footer(strip(F.col("text"))))
    rep = repeated_texts(blocks).select("doc_id", F.col("text").alias("stripped"))
    body = body.withColumn("stripped", strip(F.col("text"))).join(rep, ["doc_id", "stripped"], "left_anti")
    texts = body.groupBy("doc_id", "section").agg(F.array_sort(F.collect_list(F.struct("block_ord", "text"))).alias("x"))
    texts = texts.select("doc_id", "section", F.array_join(F.transform("x", lambda t: t["text"]), "\n").alias("text"))
    return texts.join(titles, ["doc_id", "section"], "full_outer")


def _cells(rows: Column) -> Column:
    return F.filter(F.transform(F.flatten(rows), strip), lambda c: c != "")


def _share(cells: Column, rule) -> Column:
    return F.size(F.filter(cells, rule)).cast("double") / F.greatest(F.lit(1), F.size(cells))


def fragments(cells: Column) -> Column:
    return _share(cells, lambda c: c.rlike(r"\A[A-Za-z]{1,3}\z") | c.rlike(r"\A[a-z]{4,8}\z"))


def looks_like_prose(rows: Column) -> Column:
    cells = _cells(rows)
    generic = F.size(F.filter(rows[0], lambda c: strip(c).rlike(r"(?i)\AColumn\s+[0-9]+\z")))
    short = _share(cells, lambda c: (F.size(words(c)) <= 3) & c.rlike("[A-Za-z]"))
    broken = (_share(cells, lambda c: c.rlike(r"\A\p{Ll}")) > 0.25) | (_share(cells, lambda c: c.rlike(r"[.!?:;]\z")) > 0.25)
    named = F.array_join(rows[0], " ").rlike(r"(?i)\b(sr\.?\s*no|metric|target|shift|timing|break|contents)\b")
    return (column_count(rows) >= 4) & (F.size(rows) >= 8) & (F.size(cells) > 0) & ((generic >= 2) | ((short > 0.7) & broken & ~named))


def is_valid_pdf_table(rows: Column, top: Column | None = None, bottom: Column | None = None) -> Column:
    cells = _cells(rows)
    fits = (bottom - top <= TALLEST) if top is not None else F.lit(True)
    first = F.array_join(F.filter(rows[0], lambda c: strip(c) != ""), " ")
    prose_head = first.rlike(r"\A\p{Ll}") & (F.size(words(first)) > 5)
    long_cells = _share(cells, lambda c: F.size(words(c)) > 16)
    return is_valid(rows) & fits & ~((column_count(rows) >= 6) & (F.size(rows) >= 10)) & (fragments(cells) <= 0.25) & ~looks_like_prose(rows) & ~prose_head & (long_cells <= 0.2)


def is_valid_text_strategy_table(rows: Column) -> Column:
    n = column_count(rows)
    dense = _share(rows, lambda r: F.size(F.filter(r, lambda c: strip(c) != "")) >= F.greatest(F.lit(2), n - 1))
    head = F.filter(F.transform(rows[0], strip), lambda c: c != "")
    telling = F.exists(head, lambda c: (F.size(words(c)) > 1) | (F.length(c) >= 6))
    return is_valid_pdf_table(rows) & (n <= 5) & (dense >= 0.55) & (fragments(_cells(rows)) <= 0.35) & (F.size(head) >= 2) & telling


def join_fragments(parts: Column) -> Column:
    """Cells glued where a word was cut: capitals to capitals, a capitalised start to a short lower-case rest."""

    def step(text: Column, part: Column) -> Column:
        head, tail = F.regexp_extract(part, r"\A(\S+)", 1), F.regexp_extract(part, r"\A\S+ (.*)\z", 1)
        last = F.regexp_extract(text, "([A-Za-z]{1,8})$", 1)
        upper = last.rlike(r"\A[A-Z]+\z") & head.rlike("[A-Z]") & ~head.rlike("[a-z]") & ((F.length(head) == 1) | (F.length(last) <= 3))
        lower = last.rlike(r"\A[A-Z]") & head.rlike("[a-z]") & ~head.rlike("[A-Z]") & F.length(head).between(2, 5) & (F.length(last) <= 6)
        glued = F.concat(text, head, F.when(tail != "", F.concat(F.lit(" "), tail)).otherwise(""))
        return F.when(text == "", part).when((last != "") & (upper | lower), glued).otherwise(F.concat(text, F.lit(" "), part))

    return F.aggregate(F.filter(F.transform(parts, strip), lambda p: p != ""), F.lit(""), step)


def repair_rows(rows: Column) -> Column:
    """Three-column numbered tables as number and content; other rows as they are."""
    numbers = F.size(F.filter(rows, lambda r: r[0].rlike(r"\A\s*[0-9]+\b")))
    is_three = (column_count(rows) == 3) & (numbers >= F.greatest(F.lit(3), F.floor(F.size(rows) / 3).cast("int")))

    def fixed(r: Column) -> Column:
        first, rest = strip(r[0]), F.filter(F.transform(F.slice(r, F.lit(2), F.size(r)), strip), lambda c: c != "")
        head = F.array_join(F.filter(r, lambda c: strip(c) != ""), " ")
        named = F.array(F.lit("SR. NO."), F.coalesce(F.nullif(strip(F.regexp_replace(head, r"(?i)\bsr\.?\s*no\.?\b", "")), F.lit("")), F.lit("CONTENTS")))
        number = F.regexp_extract(first, r"\A([0-9]+)\s*(.*)\z", 1)
        after = F.when(number != "", strip(F.regexp_extract(first, r"\A([0-9]+)\s*(.*)\z", 2))).otherwise(first)
        return F.when(head.rlike(r"(?i)\bsr\.?\s*no\.?\b"), named).otherwise(F.array(number, join_fragments(F.concat(F.array(after), rest))))

    return F.when(is_three, F.filter(F.transform(rows, fixed), lambda r: F.exists(r, lambda c: c != ""))).otherwise(rows)
