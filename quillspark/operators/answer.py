"""Extractive answers: from a question and a retrieved chunk (its parent, for a child) to a
cited answer, as expressions over (question, chunk) rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, all_tokens, expanded_terms, important_terms, let, normalize_whitespace, split_sentences, splitlines, strip, words
from . import scoring
from .chunk import without_title
from .metrics import source_label
from .retrieve import ASKS_ACRONYM, acronyms, hash_dims

# What an answer says where there is none.
NOTHING_RETRIEVED = "I could not retrieve any chunks yet. Generate chunks and build the retrieval index first."
NO_EXPANSION = "Answer: I could not find an explicit full-form expansion in the retrieved chunks."
NO_SUPPORT = "Answer: I could not find this answer in the retrieved chunks. Try a different chunking/extraction method or ask with terms that appear in the document."
_EXPANSION = "([A-Z][A-Za-z&.,'’/ -]{3,120}"


def clean_line(line: Column) -> Column:
    """A candidate line without bullets, labels of context, and arrows' leftovers."""
    s = F.regexp_replace(F.regexp_replace(line, r"\A[ \-*•\t]+", ""), r"[ \-*•\t]+\z", "")
    s = strip(F.regexp_replace(s, rf"(?i)\Asection{WS}+path:{WS}*.*?{WS}+page:{WS}*[0-9]+{WS}*", ""))
    s = strip(F.regexp_replace(s, rf"(?i)\Apage:{WS}*[0-9]+{WS}*", ""))

    def rest(x: Column) -> Column:
        y = F.regexp_replace(F.regexp_replace(F.replace(x, F.lit("↓"), F.lit(" -> ")), r"\s*;\s*->\s*;?\s*", " -> "), r"\s*->\s*\z", "")
        return F.when(x.rlike(r"(?i)\A(section path|source|chunk id|score):"), "").otherwise(normalize_whitespace(y))

    return let(s, rest)


def is_heading_only(text: Column) -> Column:
    def judge(s: Column) -> Column:
        def by_words(w: Column) -> Column:
            capital = F.size(F.filter(w, lambda x: x.rlike("^[A-Z]"))).cast("double") / F.greatest(F.lit(1), F.size(w))
            return F.when((F.size(w) == 0) | (F.size(w) > 6), False).when(F.forall(w, lambda x: x.rlike(r"\A[A-Z]+\z")), True).otherwise((capital >= 0.65) & ~s.rlike("[.!?;]"))

        short = s.endswith(":") & (F.size(words(s)) <= 6)
        return F.when(s == "", True).when(short, True).otherwise(let(F.regexp_extract_all(s, F.lit("[A-Za-z]+"), F.lit(0)), by_words))

    return let(strip(text), judge)


def answer_units(text: Column) -> Column:
    """Sentences of lines and bullets, titles before names unbroken, headings left out."""
    kept = F.regexp_replace(text, r"(Mrs|Mr|Ms|Dr)\.", "$1<dot>")
    parts = F.flatten(F.transform(splitlines(kept), lambda x: splitlines(F.regexp_replace(strip(x), r"\s*•\s*", "\n"))))
    parts = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(strip(p), r"\A[ \-*\t]+", ""), r"[ \-*\t]+\z", ""))
    said = F.flatten(F.transform(F.filter(parts, lambda p: (p != "") & ~is_heading_only(p)), split_sentences))
    return F.filter(F.transform(said, lambda s: strip(F.replace(s, F.lit("<dot>"), F.lit(".")))), lambda s: s != "")


def answerable_text(text: Column, title: Column) -> Column:
    lines = F.transform(splitlines(without_title(text, title)), clean_line)
    return strip(F.array_join(F.filter(lines, lambda x: x != ""), "\n"))


def support_text(text: Column, title: Column, rows: Column) -> Column:
    cells = F.coalesce(F.transform(rows, lambda r: F.array_join(r, " ")), F.array().cast("array<string>"))
    parts = F.concat(F.array(F.coalesce(title, F.lit("")), answerable_text(text, title)), cells)
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n")


def _product(a: Column, b: Column) -> Column:
    each = lambda s, x: s + F.aggregate(F.filter(b, lambda y: y["dim"] == x["dim"]), F.lit(0), lambda t, y: t + x["sign"] * y["sign"])
    return F.aggregate(a, F.lit(0), each)


def question_vector(question: Column) -> Column:
    """struct<dims, norm2>: a question's hashing vector, worked out once for all sentences."""
    return let(hash_dims(all_tokens(question)), lambda a: F.struct(a.alias("dims"), _product(a, a).alias("norm2")))


def sentence_similarity(vector: Column, sentence: Column) -> Column:
    """Cosine of hashing vectors, for a text as short as a sentence."""
    def cosine(b: Column) -> Column:
        norm = F.sqrt(vector["norm2"].cast("double")) * F.sqrt(_product(b, b).cast("double"))
        return F.when(norm > 0, _product(b, vector["dims"]).cast("double") / norm).otherwise(0.0)

    return let(hash_dims(all_tokens(sentence)), cosine)


def best_sentences(vector: Column, terms: Column, sentences: Column) -> Column:
    """The best sentence and a neighbour nearly as good, in the text's order."""
    def scored(s: Column, i: Column) -> Column:
        def build(own: Column, sem: Column) -> Column:
            shared = F.size(F.array_intersect(terms, own)).cast("double")
            coverage = shared / F.greatest(F.lit(1), F.size(terms))
            total = 0.70 * sem + 0.20 * coverage + 0.10 * (shared / F.greatest(F.lit(1), F.size(own)))
            return F.struct((-total).alias("k"), (-sem).alias("m"), (-coverage).alias("c"), F.length(s).alias("n"), i.alias("i"), s.alias("s"))

        return let(expanded_terms(s), lambda own: let(sentence_similarity(vector, s), lambda sem: build(own, sem)))

    def pick(x: Column) -> Column:
        best = x[0]
        near = F.filter(F.slice(x, F.lit(2), F.size(x)), lambda y: (F.abs(y["i"] - best["i"]) == 1) & (-y["k"] >= -best["k"] * 0.92))
        chosen = F.concat(F.array(best), F.slice(near, 1, 1))
        return F.transform(F.array_sort(F.transform(chosen, lambda y: F.struct(y["i"].alias("i"), y["s"].alias("s")))), lambda y: y["s"])

    none = F.array().cast("array<string>")
    return F.when(F.size(sentences) > 0, let(F.array_sort(F.transform(sentences, scored)), pick)).otherwise(none)


def markdown_table(rows: Column) -> Column:
    width = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    escape = lambda c: strip(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, escape), " | "), F.lit(" |"))

    def made(x: Column, n: Column) -> Column:
        p = F.transform(x, lambda r: F.concat(F.transform(r, normalize_whitespace), F.array_repeat(F.lit(""), n - F.size(r))))
        head = F.transform(p[0], lambda c, i: F.when(c == "", F.concat(F.lit("Column "), (i + 1).cast("string"))).otherwise(c))
        body = F.transform(F.filter(F.slice(p, F.lit(2), F.size(p)), lambda r: F.exists(r, lambda c: c != "")), line)
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), n), " | "), F.lit(" |"))
        return F.array_join(F.concat(F.array(line(head), rule), body), "\n")

    return let(width, lambda n: F.when((n < 2) | (F.size(rows) < 2), "").otherwise(made(rows, n)))


def _row_terms(rows: Column) -> Column:
    return expanded_terms(F.array_join(F.flatten(rows), " "))


def table_answer(question: Column, title: Column, rows: Column) -> Column:
    q = important_terms(question)
    known = F.array_union(expanded_terms(F.coalesce(title, F.lit(""))), _row_terms(rows))
    fits = (F.size(q) == 0) | F.arrays_overlap(q, known)
    head = F.when(F.coalesce(strip(title), F.lit("")) != "", F.concat(F.lit("Answer: "), strip(title))).otherwise("Answer")
    return F.when((F.coalesce(F.size(rows), F.lit(0)) >= 2) & fits, let(markdown_table(rows), lambda t: F.when(t == "", "").otherwise(F.concat(head, F.lit(":\n\n"), t)))).otherwise("")


def table_items(question: Column, rows: Column, most: int = 8) -> Column:
    heads = F.transform(rows[0], lambda c, i: F.coalesce(F.nullif(strip(c), F.lit("")), F.concat(F.lit("Column "), (i + 1).cast("string"))))

    def item(r: Column) -> Column:
        cells = F.transform(r, strip)
        n = F.least(F.size(heads), F.size(r)) - 1
        pairs = F.filter(F.zip_with(F.slice(heads, F.lit(2), n), F.slice(cells, F.lit(2), n), lambda h, c: F.when(c != "", F.concat(h, F.lit(": "), c))), lambda p: p.isNotNull())
        plain = F.array_join(F.filter(cells, lambda c: c != ""), " - ")
        return F.when((cells[0] != "") & (F.size(pairs) > 0), F.concat(cells[0], F.lit(" - "), F.array_join(pairs, ", "))).otherwise(plain)

    fits = (F.coalesce(F.size(rows), F.lit(0)) >= 2) & F.arrays_overlap(important_terms(question), _row_terms(rows))
    found = F.filter(F.transform(F.slice(rows, F.lit(2), F.size(rows)), item), lambda x: x != "")
    return F.when(fits, F.slice(found, 1, most)).otherwise(F.array().cast("array<string>"))


def list_items(question: Column, title: Column, text: Column, most: int = 8) -> Column:
    q, t = important_terms(question), expanded_terms(F.coalesce(title, F.lit("")))
    asked = F.arrays_overlap(q, F.array(*[F.lit(w) for w in ("list", "show", "name", "names")])) | F.arrays_overlap(q, t)

    def keep(line: Column) -> Column:
        return (line != "") & (F.array_sort(expanded_terms(line)) != F.array_sort(t)) & ~is_heading_only(line) & (F.size(words(line)) <= 18)

    return F.when(asked, F.slice(F.filter(F.transform(splitlines(text), clean_line), keep), 1, most)).otherwise(F.array().cast("array<string>"))


def direct_answer(question: Column, vector: Column, terms: Column, title: Column, text: Column, rows: Column) -> Column:
    """A directive, a table, its rows, list lines, or the best sentences, whichever there is first."""
    body = answerable_text(text, title)
    named = F.coalesce(strip(title), F.lit(""))
    directive = normalize_whitespace(F.regexp_extract(normalize_whitespace(body), r"(Strategic Mandate Directive:\s*.+?)(?:\s+Section\s+[0-9]+:|\z)", 1))
    asked = F.arrays_overlap(terms, F.array(*[F.lit(w) for w in ("strategic", "mandate", "directive")]))

    def sentences(units: Column) -> Column:
        def more(s: Column) -> Column:
            at = F.array_position(units, s[0]).cast("int")
            following = F.get(units, at)
            add = (F.size(s) == 1) & is_heading_only(s[0]) & following.isNotNull() & ~is_heading_only(F.coalesce(following, F.lit("")))
            return F.when(F.size(s) == 0, F.slice(units, 1, 3)).when(add, F.concat(s, F.array(following))).otherwise(s)

        said = strip(F.array_join(let(best_sentences(vector, terms, units), more), " "))
        return F.concat(F.lit("Answer: "), F.when(named != "", F.concat(named, F.lit(": "))).otherwise(""), said)

    joined = lambda items: F.when(F.size(items) > 0, F.concat(F.lit("Answer: "), F.array_join(items, "; ")))
    return F.coalesce(
        F.when((directive != "") & asked, F.concat(F.lit("Answer: "), directive)),
        F.nullif(table_answer(question, title, rows), F.lit("")),
        let(table_items(question, rows), joined),
        let(list_items(question, title, text), joined),
        let(answer_units(body), sentences),
    )


def acronym_answer(question: Column, support: Column) -> Column:
    """ABC: its words, by the first acronym that the text spells out; else empty."""
    def one(a: Column) -> Column:
        def group(*pattern: Column) -> Column:
            return F.call_function("regexp_extract", support, F.concat(*pattern), F.lit(1))

        before = group(F.lit(_EXPANSION + r"?)\s*\(\s*"), a, F.lit(r"\s*\)"))
        after = group(F.lit(r"(?i)\b"), a, F.lit(r"\b\s*(?:means|stands for|[:=-])\s*" + _EXPANSION + ")"))
        return F.when(before != "", F.concat(a, F.lit(": "), normalize_whitespace(before))).when(after != "", F.concat(a, F.lit(": "), normalize_whitespace(after)))

    found = F.filter(F.transform(acronyms(question), one), lambda x: x.isNotNull())
    return F.when(question.rlike(ASKS_ACRONYM), F.coalesce(F.get(found, F.lit(0)), F.lit(""))).otherwise("")


def _labelled(text: Column) -> Column:
    """Whether `clean_line` may take more from a text than marks and white space."""
    return let(F.lower(text), lambda t: reduce(or_, [F.contains(t, F.lit(x)) for x in ("page", "section", "source:", "chunk id:", "score:")]))


def support_terms(chunks: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(term, df) over all chunks (text, title, rows): in how many of them a term stands; only
    of those in `among` (term), if that is given. Lines are cleaned only where this can take terms."""
    text, title, rows = F.col("text"), F.col("title"), F.col("rows")
    bare = title.isNull() & rows.isNull() & ~_labelled(text)
    said = F.when(bare, text).otherwise(support_text(text, title, rows))
    if among is None:
        return chunks.select(F.explode(expanded_terms(said)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    names = [r["term"] for r in among.collect()]  # the questions' terms
    places = {t: i for i, t in enumerate(dict.fromkeys(names + [t + "s" for t in names]))}
    shared = chunks.sparkSession.sparkContext.broadcast((names, places))

    def count(batches):
        names, places = shared.value
        _, _, df = scoring.frequencies((b.column(0) for b in batches), places, singulars=True)
        found = [t for t in names if df[places[t]]]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([df[places[t]] for t in found], pa.int64())], names=["term", "n"])

    counts = chunks.select(F.lower(F.coalesce(said, F.lit(""))).alias("said")).mapInArrow(count, "term string, n bigint")
    return counts.groupBy("term").agg(F.sum("n").alias("df"))


def _variant(t: Column) -> Column:
    """A term's plural or singular."""
    return F.when(t.endswith("s") & (F.length(t) > 3), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(F.concat(t, F.lit("s")))


def asked_terms(questions: DataFrame) -> DataFrame:
    """(term) that `question_terms` looks up: the questions' terms, their plurals and singulars."""
    t = questions.select(F.explode(important_terms(F.col("question"))).alias("t"))
    return t.select(F.explode(F.array("t", _variant(F.col("t")))).alias("term")).distinct()


def question_terms(questions: DataFrame, df: DataFrame, indexed: int) -> DataFrame:
    """questions with anchor terms (rare ones, else present ones, else all) and whether each
    anchor, or its plural or singular, stands anywhere. `indexed` counts retrieval chunks."""
    q = questions.withColumn("important", important_terms(F.col("question")))
    each = q.select("query_id", F.explode("important").alias("t")).withColumn("v", _variant(F.col("t")))
    d1, d2 = df.select(F.col("term").alias("t"), F.col("df").alias("n")), df.select(F.col("term").alias("v"), F.col("df").alias("m"))
    each = each.join(d1, "t", "left").join(d2, "v", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sets = each.groupBy("query_id").agg(
        F.collect_set(F.when((F.col("n") > 0) & (F.col("n") / F.greatest(F.lit(1), F.lit(indexed)) <= 0.35), F.col("t"))).alias("rare"),
        F.collect_set(F.when(F.col("n") > 0, F.col("t"))).alias("present"),
        F.collect_set(F.when((F.col("n") == 0) & F.col("m").isNull(), F.col("t"))).alias("missing"),
    )
    out = q.join(sets, "query_id", "left")
    anchors = F.when(F.size("rare") > 0, F.col("rare")).when(F.size("present") > 0, F.col("present")).otherwise(F.col("important")) if indexed else F.col("important")
    out = out.withColumn("anchors", anchors)
    lost = F.arrays_overlap("anchors", "missing") if indexed else F.lit(False)
    return out.select(*questions.columns, "important", "anchors", F.coalesce(lost, F.lit(False)).alias("unseen"))


def answers(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """questions as question_terms returns them; hits (query_id, rank, score, chunk_id, text,
    title, section_path, source_unit, page, rows), the context chunk of each hit ->
    (query_id, question, answer, source)."""
    q = F.col("question")
    h = questions.withColumn("vector", question_vector(q)).join(hits, "query_id", "left")
    support = support_text(F.col("text"), F.col("title"), F.col("rows"))
    h = h.withColumn("support", F.when(F.col("text").isNotNull(), support))
    own = expanded_terms(F.col("support"))
    overlap = F.size(F.array_intersect("anchors", own)).cast("double")
    enough = (F.size("important") == 0) | (~F.col("unseen") & (overlap > 0) & (overlap / F.greatest(F.lit(1), F.size("anchors")) >= 0.5))
    semantic = F.array_max(F.transform(answer_units(answerable_text(F.col("text"), F.col("title"))), lambda s: sentence_similarity(F.col("vector"), s)))
    coverage = overlap / F.greatest(F.lit(1), F.size("anchors"))
    answerable = F.when(semantic.isNull(), 0.0).otherwise(0.65 * semantic + 0.30 * coverage + F.when(F.col("rows").isNotNull(), 0.10).otherwise(0.0))
    h = h.withColumn("supported", enough).withColumn("fit", answerable + 0.10 * F.col("score") + F.when(F.col("supported"), 0.15).otherwise(0.0))
    h = h.withColumn("expansion", acronym_answer(q, F.col("support"))).withColumn("asks", q.rlike(ASKS_ACRONYM))
    h = h.withColumn("source", source_label(F.col("title"), F.col("section_path"), F.col("source_unit"), F.col("chunk_id"), F.col("page")))
    first = Window.partitionBy("query_id").orderBy(F.when(F.col("asks"), (F.col("expansion") == "").cast("double")).otherwise(-F.col("fit")), "rank")
    best = h.withColumn("r", F.row_number().over(first)).where("r = 1")
    closest = F.concat(F.lit("\n\nClosest source: "), F.col("source"))
    said = (
        F.when(F.col("chunk_id").isNull(), NOTHING_RETRIEVED)
        .when(F.col("asks") & (F.col("expansion") != ""), F.concat(F.lit("Answer: "), F.col("expansion"), F.lit("\n\nSource: "), F.col("source")))
        .when(F.col("asks"), F.concat(F.lit(NO_EXPANSION), closest))
        .when(~F.col("supported"), F.concat(F.lit(NO_SUPPORT), closest))
        .otherwise(F.concat(direct_answer(q, F.col("vector"), F.col("anchors"), F.col("title"), F.col("text"), F.col("rows")), F.lit("\n\nSource: "), F.col("source")))
    )
    return best.select("query_id", "question", said.alias("answer"), "source")
