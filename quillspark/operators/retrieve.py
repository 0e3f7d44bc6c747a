"""Index and hybrid retrieval: hashing vectors, BM25, lexical overlap and intent, fused and ranked.

Questions are a DataFrame. Single signals meet in equi-joins on postings, summed by pair. Whole
scores are worked out where the chunks are (`scoring`), for every chunk and question, as exact
search asks; of these only the best of each task leave it. Frequencies are counted for the
questions' terms only."""

from __future__ import annotations

import time
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import all_tokens, is_blank, let, strip, tokenize
from . import scoring
from .scoring import DIM, K1, B

# Expressions that ask for an acronym's meaning, and for a definition.
ASKS_ACRONYM = r"(?i)\b(full\s*form|stands?\s+for|meaning\s+of)\b"
ASKS_DEFINITION = r"(?i)\b(?:what\s+is|define|definition\s+of|explain)\s+(.+)"
_WORDS = "[A-Za-z&.,'’/ -]"


def searchable_text(text: Column, source_unit: Column | None = None, title: Column | None = None, section: Column | None = None, page: Column | None = None, rows: Column | None = None) -> Column:
    """What is known of a chunk, its text, and its table's cells."""
    about = F.concat_ws(" ", *[c.cast("string") for c in (source_unit, title, section, page) if c is not None])
    cells = F.lit("") if rows is None else F.coalesce(F.array_join(F.transform(rows, lambda r: F.array_join(r, " ")), " "), F.lit(""))
    return strip(F.concat_ws("\n", about, text, cells))


def hash_dims(tokens: Column) -> Column:
    """array<struct<dim, sign>>: a token's place and sign by its SHA-256."""

    def one(h: Column) -> Column:
        dim = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % DIM
        return F.struct(dim.cast("int").alias("dim"), F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1).alias("sign"))

    return F.transform(tokens, lambda t: let(F.sha2(t.cast("binary"), 256), one))


def hash_vectors(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, vec map<dim, value>, norm2): integer sums, so that no order of adding matters."""
    flat = rows.select(key, F.explode(hash_dims(all_tokens(F.col(text)))).alias("h"))
    sums = flat.groupBy(key, F.col("h.dim").alias("dim")).agg(F.sum("h.sign").cast("bigint").alias("v")).where("v <> 0")
    return sums.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dim", "v")))).alias("vec"), F.sum(F.col("v") * F.col("v")).alias("norm2"))


def count_in(tokens: Column, term: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t == term))


def lexical_similarity(q: Column, t: Column) -> Column:
    """Of two token arrays, for single pairs; `score` works it out from postings."""
    overlap = F.aggregate(F.array_distinct(q), F.lit(0), lambda s, x: s + F.least(count_in(q, x), count_in(t, x)))
    phrase = F.when(F.contains(F.array_join(t, " "), F.array_join(q, " ")), 0.35).otherwise(0.0)
    title = F.when(F.startswith(F.array_join(t, " "), q[0]), 0.15).otherwise(0.0)
    return F.when((F.size(q) == 0) | (F.size(t) == 0), 0.0).otherwise(F.least(F.lit(1.0), overlap.cast("double") / F.size(q) + phrase + title))


def bm25_part(tf: Column, df: Column, doc_len: Column, n: Column, avg_len: Column) -> Column:
    """One term's share of a chunk's BM25 score; all are doubles."""
    idf = F.log(1.0 + ((n - df + 0.5) / (df + 0.5)))
    return idf * ((tf * (K1 + 1)) / (tf + K1 * (1 - B + B * (doc_len / F.greatest(F.lit(1.0), avg_len)))))


def acronyms(question: Column) -> Column:
    return F.regexp_extract_all(question, F.lit(r"\b[A-Z]{2,}\b"), F.lit(0))


def has_acronym_expansion(text: Column, acronym: Column) -> Column:
    before = F.concat(F.lit(rf"[A-Z]{_WORDS}{{3,120}}?\s*\(\s*"), acronym, F.lit(r"\s*\)"))
    after = F.concat(F.lit(r"(?i)\b"), acronym, F.lit(rf"\b\s*(?:means|stands for|[:=-])\s*[A-Z]{_WORDS}{{3,120}}"))
    return F.regexp_like(text, before) | F.regexp_like(text, after)


def acronym_worth(text: Column, acronym: Column) -> Column:
    """What a text is worth to a question for one acronym's meaning."""
    return F.when(has_acronym_expansion(text, acronym), 2.0).when(F.regexp_like(text, F.concat(F.lit(r"\b"), acronym, F.lit(r"\b"))), 0.05).otherwise(0.0)


def acronym_boost(question: Column, text: Column) -> Column:
    """The worth of the best acronym; for single pairs, `score` works it out for many."""
    best = F.coalesce(F.array_max(F.transform(acronyms(question), lambda a: acronym_worth(text, a))), F.lit(0.0))
    return F.when(question.rlike(ASKS_ACRONYM), best).otherwise(0.0)


def definition_terms(question: Column) -> Column:
    """Tokens of what a question asks to define; empty if it asks for none."""
    return tokenize(F.regexp_extract(question, ASKS_DEFINITION, 1))


def retrieval_chunks(chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Children with a parent and some text where an index, named by the columns in `by`, has
    any; else all its chunks. The flags are aggregated first, so a large index isn't one task."""
    child = F.coalesce((F.col("role") == "child") & F.col("parent_id").isNotNull() & ~is_blank(F.col("text")), F.lit(False))
    keys = [F.col(c).alias(f"__{i}") for i, c in enumerate(by or [])]
    any_child = chunks.groupBy(*keys).agg(F.max(child).alias("__any"))
    same = F.lit(True)
    for i, c in enumerate(by or []):
        same &= F.col(c).eqNullSafe(F.col(f"__{i}"))
    flagged = chunks.join(any_child, same, "left") if by else chunks.crossJoin(any_child)  # one row
    return flagged.where(child | ~F.coalesce("__any", F.lit(False))).select(*chunks.columns)


def build_index(chunks: DataFrame, key: str = "chunk_key", text: str = "text", order: str | None = None) -> DataFrame:
    """(key, ord, text, tokens) of the chunks that have text. Where chunks have source_unit,
    title, section, page or rows, these are searched as well."""
    about = {c: F.col(c) for c in ("source_unit", "title", "section", "page", "rows") if c in chunks.columns}
    rows = chunks.where(~is_blank(F.col(text)))
    searched = searchable_text(F.col(text), **about) if about else F.col(text)
    rows = rows.select(F.col(key).alias("key"), F.col(order or key).alias("ord"), searched.alias("text"))
    return rows.select("*", tokenize(F.col("text")).alias("tokens"))


def postings(index: DataFrame) -> DataFrame:
    """(key, term, tf, first, doc_len): a term's count and first place in a chunk."""
    flat = index.select("key", F.size("tokens").alias("doc_len"), F.posexplode("tokens").alias("p", "term"))
    return flat.groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"), F.min("p").alias("first"), F.first("doc_len").alias("doc_len"))


def index_stats(index: DataFrame) -> DataFrame:
    return index.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.size("tokens").cast("double")).alias("avg_len"))


def vector_scores(questions: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, key, vector): cosines of hashing vectors that share a place."""
    dims = lambda v, key, *more: v.select(key, *more, F.explode("vec").alias("dim", "v"))
    a = dims(hash_vectors(questions, "query_id", "question").withColumnRenamed("norm2", "qn"), "query_id", "qn").withColumnRenamed("v", "qv")
    b = dims(hash_vectors(index, "key", "text"), "key", "norm2")
    dot = b.join(a, "dim").groupBy("query_id", "key").agg(F.sum(F.col("qv") * F.col("v")).alias("dot"), F.first("qn").alias("qn"), F.first("norm2").alias("norm2"))
    return dot.select("query_id", "key", (F.col("dot").cast("double") / (F.sqrt(F.col("qn").cast("double")) * F.sqrt(F.col("norm2").cast("double")))).alias("vector"))


def term_scores(questions: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, key, bm25, overlap, present, lo, hi, subject): what postings say of a question and a chunk."""
    q = questions.select("query_id", tokenize(F.col("question")).alias("q"), F.array_distinct(definition_terms(F.col("question"))).alias("s"))
    terms = q.select("query_id", "s", F.explode("q").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"), F.max(F.array_contains("s", F.col("term")).cast("int")).alias("is_subject"))
    post = postings(index).join(terms.select("term").distinct(), "term", "left_semi")
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    met = post.join(df, "term").join(terms, "term").crossJoin(index_stats(index))  # one row
    double = lambda c: F.col(c).cast("double")
    return met.groupBy("query_id", "key").agg(
        F.sum(bm25_part(double("tf"), double("df"), double("doc_len"), F.col("n"), F.col("avg_len"))).alias("raw"),
        F.sum(F.least("tf", "qtf")).alias("overlap"), F.count(F.lit(1)).alias("present"), F.min("first").alias("lo"), F.max("first").alias("hi"), F.sum("is_subject").alias("subject"),
    ).withColumn("bm25", F.when(F.col("raw") > 0, F.col("raw") / (F.col("raw") + 3.0)).otherwise(0.0)).drop("raw")


def _asked(questions: DataFrame) -> tuple[pa.Array, list[scoring.Question]]:
    """The questions, on the driver: ids, and what scores need of them."""
    q, none = F.coalesce("question", F.lit("")), F.array().cast("array<string>")
    got = questions.select("query_id", all_tokens(q), tokenize(q), definition_terms(q), F.when(q.rlike(ASKS_ACRONYM), acronyms(q)).otherwise(none)).toArrow()
    ids = got.column(0).combine_chunks()
    return ids, [scoring.Question(*row) for row in zip(range(len(ids)), *[c.to_pylist() for c in got.columns[1:]])]


def _corpus(questions: list[scoring.Question], rows: DataFrame) -> scoring.Corpus:
    """Frequencies of the questions' terms in rows (text)."""
    terms = {t: i for i, t in enumerate(dict.fromkeys(t for q in questions for t in q.tokens))}
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def count(batches):
        n, total, df = scoring.frequencies((b.column(0) for b in batches), shared.value)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *range(len(df))]), pa.array([n, total, *df.tolist()])], names=["term", "n"])

    counts = rows.mapInArrow(count, "term bigint, n bigint").where("n > 0").groupBy("term").agg(F.sum("n"))
    found = dict(map(tuple, counts.collect()))  # no more rows than terms
    n = found.get(-2, 0)
    return scoring.Corpus(n, found.get(-1, 0) / max(1, n), {t: found[i] for t, i in terms.items() if i in found})


#: Kinds of `ord` that Python orders as Spark does.
_ORDERED = (T.IntegralType, T.StringType, T.DateType, T.BooleanType)


def _scored(questions: DataFrame, index: DataFrame, keep: dict[str, int] | None = None) -> DataFrame:
    """(query_id, key, ord, vector, bm25, lexical, intent, score) of every question and chunk. With
    `keep` at least the so many best of each question by each signal named, and few more."""
    if not isinstance(index.schema["ord"].dataType, _ORDERED):
        keep = None
    ids, asked = _asked(questions)
    corpus = _corpus(asked, index.select(F.lower("text").alias("text"))) if asked else None
    kinds = [T.StructField(c, d.schema[c].dataType) for c, d in (("query_id", questions), ("key", index), ("ord", index))]
    schema = T.StructType(kinds + [T.StructField(c, T.DoubleType()) for c in scoring.SIGNALS])

    def one(some: list[scoring.Question]) -> DataFrame:
        words = list(dict.fromkeys(a for q in some for a in q.acronyms))
        boosts = F.transform(F.lit(words), lambda a: acronym_worth(F.col("text"), a)) if words else F.array().cast("array<double>")
        terms = {t for q in some for t in q.tokens}
        mine = scoring.Corpus(corpus.n, corpus.avg_len, {t: n for t, n in corpus.df.items() if t in terms})
        shared = index.sparkSession.sparkContext.broadcast((some, mine, words, ids.slice(some[0].id, len(some))))

        def run(batches):
            some, mine, words, ids = shared.value
            return scoring.search(batches, scoring.Scorer(some, mine, words), ids, keep)

        return index.select("key", "ord", F.lower("text").alias("lower"), boosts.alias("boosts")).mapInArrow(run, schema)

    found = [one(some) for some in scoring.passes(asked)]
    return reduce(DataFrame.unionAll, found) if found else index.sparkSession.createDataFrame([], schema)


def score(questions: DataFrame, index: DataFrame) -> DataFrame:
    """Every question with every chunk: (query_id, key, ord, vector, bm25, lexical, intent, score)."""
    return _scored(questions, index)


def top(scored: DataFrame, by: str, k: int) -> DataFrame:
    """The k best of each question, ties in the order of the chunks."""
    w = Window.partitionBy("query_id").orderBy(F.desc(by), "ord")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hybrid_search(questions: DataFrame, index: DataFrame, k: int = 5) -> DataFrame:
    return top(_scored(questions, index, {"score": k}), "score", k)


def merged_search(questions: DataFrame, index: DataFrame, k: int = 5) -> DataFrame:
    """Vector and hybrid candidates, five times k of each, joined: a hybrid hit gains by its
    vector rank, a hit by vector alone comes in with its plain cosine."""
    many = max(5 * k, k)
    rank = lambda by: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "ord"))
    ranked = _scored(questions, index, {"vector": many, "score": many}).select("*", rank("score").alias("h_rank"), rank("vector").alias("v_rank"))
    both = ranked.where((F.col("h_rank") <= many) | (F.col("v_rank") <= many)).withColumns({r: F.when(F.col(r) <= many, F.col(r)) for r in ("h_rank", "v_rank")})
    final = F.when(F.col("h_rank").isNull(), F.col("vector")).otherwise(F.col("score") + F.when(F.col("v_rank").isNotNull(), 0.05 / F.greatest(F.lit(1), F.col("v_rank"))).otherwise(0.0))
    both = both.select("query_id", "key", final.alias("score"), "h_rank", "v_rank", F.when(F.col("h_rank").isNull(), "vector").otherwise("hybrid").alias("index"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("h_rank"), "v_rank")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Retrieved(NamedTuple):
    results: list[Row]
    latency_ms: float


class Retriever:
    """An index of chunks, and the answers to questions from it."""

    def __init__(self, chunks: DataFrame, key: str = "chunk_key", order: str | None = None):
        self.chunks, self.key = chunks, key
        roles = {"role", "parent_id"} <= set(chunks.columns)
        self.index = build_index(retrieval_chunks(chunks) if roles else chunks, key, order=order)

    def search(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """(query_id, rank, score, signals and the chunk's columns), k rows at most a question."""
        found = merged_search(questions, self.index, k).select("query_id", "rank", "score", F.col("index").alias("found_by"), F.col("key").alias("__key"))
        return found.join(self.chunks, F.col("__key") == F.col(self.key)).drop("__key")

    def retrieve(self, question: str, k: int = 5) -> Retrieved:
        """The k best chunks for one question, and how long that took."""
        begun = time.perf_counter()
        asked = self.chunks.sparkSession.createDataFrame([(0, question)], "query_id long, question string")
        rows = self.search(asked, k).drop("query_id").orderBy("rank").collect()  # k rows
        return Retrieved(rows, (time.perf_counter() - begun) * 1000)
