"""Cases worked out by hand for the operators that keep the reference's habits."""

import random
import re

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import answer as A
from quillspark.operators import chunk as C
from quillspark.operators import extract as X
from quillspark.operators import layout as L
from quillspark.operators import metrics as M
from quillspark.operators import retrieve as R
from quillspark.operators import scoring
from quillspark.operators import tables as TB
from quillspark.plans import queries as Q
from quillspark.plans import registry

ODD = ["", " a  b c \x1c", "One. Two!  Three?four", "a\r\nb\x0bc d\n", "été_1 — naïve, (ok)", "x\n\n\ny\n", "…", "A.B. C"]


def docs(spark, *rows):
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(rows, 1)], "doc_id long, name string, text string")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_functions_agree_with_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    c = F.col("t")
    rows = df.select("t", T.strip(c).alias("strip"), T.splitlines(c).alias("lines"), T.split_sentences(c).alias("said"), T.estimate_tokens(c).alias("n"), T.words(c).alias("words")).collect()
    for r in rows:
        t = r["t"]
        assert r["strip"] == t.strip() and r["lines"] == t.splitlines() and r["words"] == t.split()
        assert r["said"] == [p.strip() for p in re.split(r"(?<=[.!?])\s+", t.strip()) if p.strip()]
        assert r["n"] == max(1, len(re.findall(r"\w+|[^\w\s]", t)))


def test_names_and_sizes(spark):
    df = spark.createDataFrame([("A.PDF", 10), ("x/y.tar.gz", 2000), (".py", 234_496), ("no", 3_000_000), ("m.Markdown", 0)], "n string, s long")
    got = [tuple(r) for r in df.select(T.document_type(F.col("n")), T.human_size(F.col("s"))).collect()]
    assert got == [("PDF", "10 B"), ("Unknown", "2.0 KB"), ("Unknown", "229.0 KB"), ("Unknown", "2.9 MB"), ("Markdown", "0 B")]


def test_fixed_windows_keep_a_tail_inside_the_last_one(spark):
    w = value(spark, C.fixed_windows(F.lit("abcdefghij"), 6, 2))
    assert [(x["start"], x["part"]) for x in w] == [(0, "abcdef"), (4, "efghij"), (8, "ij")]


def test_recursive_split(spark):
    text = "para one\n\npara two is longer. It has words\n\nx"
    assert value(spark, C.recursive_pieces(F.lit(text), 20)) == ["para one", "para two is longer", "It has words", "x"]
    got = value(spark, C.recursive_split(F.lit(text), 20, 3))
    assert got == ["para one", "onepara two is longer", "gerIt has words", "rdsx"]
    assert all(len(p) <= 20 for p in value(spark, C.recursive_pieces(F.lit("y" * 95), 20)))


def test_whole_text_and_its_table_are_both_chunked(spark):
    d = docs(spark, ("a.md", "intro\n| a | b |\n|---|---|\n| 1 | 2 |"))
    got = C.chunk(d, "whole_text", "fixed_size").orderBy("chunk_ord").collect()
    assert [r["unit_type"] for r in got] == ["table", "document"] and got[0]["rows"] == [["a", "b"], ["1", "2"]]


def test_sections(spark):
    body = "a body line that is long enough here."
    text = f"front\n# One\n## Two\n{body}\n2.1 Deep Title\n{body}\n# Empty\n\n# Last\n{body}\n"
    rows = X.extract(docs(spark, ("a.md", text)), "section_wise").orderBy("unit_ord").collect()
    assert [(r["title"], r["level"], r["section_path"]) for r in rows] == [("front", 1, "front"), ("Two", 2, "front > Two"), ("Deep Title", 2, "front > Deep Title"), ("Empty", 1, "Empty"), ("Last", 1, "Last")]
    assert rows[-2]["text"] == ""  # a body of blank lines is a section still
    # right under a heading, what only looks like one is body
    text = f"# One\n{body}\n# Two\nLooks Like Heading\n{body}\n"
    rows = X.extract(docs(spark, ("a.md", text)), "section_wise").orderBy("unit_ord").collect()
    assert [(r["title"], r["text"]) for r in rows] == [("One", body), ("Two", f"Looks Like Heading\n{body}")]


def test_footer_rule_takes_any_line_that_ends_in_a_number(spark):
    from quillspark.operators.sections import derived_title

    assert value(spark, derived_title(F.lit("Chapter 1\nPage 2\nReal title\n"))) == "Real title"


def test_table_before_any_section_takes_the_next(spark):
    d = docs(spark, ("a.txt", "x")).withColumn("units", F.array(X.unit(unit_id=F.lit("t"), unit_type=F.lit("table"), text=F.lit("x")), X.unit(unit_id=F.lit("s"), unit_type=F.lit("section"), title=F.lit("T"), level=F.lit(1))))
    t, s = d.select(X.with_context(F.col("units"))).first()[0]
    assert (t["parent_section_id"], t["section_path"], s["section_path"]) == ("s", "T", "T")


def test_context_path_and_ancestor_path_differ_where_levels_skip(spark):
    text = "# A\nbody body body body body body\n### C\nmore more more more more more\n## B\nlast last last last last last\n"
    flat = X.extract(docs(spark, ("a.md", text)), "hierarchical")
    assert [r["section_path"] for r in flat.orderBy("unit_ord").collect()] == ["A", "A > C", "A > B"]
    deep = X.hierarchy(flat).orderBy("unit_ord").collect()
    assert [(r["parent_unit_id"], r["depth"], r["section_path"]) for r in deep] == [(None, 0, "A"), ("section-1", 1, "A > C"), ("section-1", 1, "A > B")]


def test_clauses_find_the_enumerator_after_a_semicolon(spark):
    assert value(spark, X.clauses(F.lit("a: b;\n(x) c;d"), colons=False)) == ["a: b;", "c;", "d"]
    assert value(spark, X.clauses(F.lit("a: b;\n(x) c;d"))) == ["a:", "b;", "c;", "d"]


def test_semantic_end_counts_a_full_group(spark):
    got = C.chunk(docs(spark, ("a.txt", "One. Two. Three.")), "whole_text", "semantic", sentences_per_chunk=2).orderBy("chunk_ord").collect()
    assert [(r["text"], r["sentence_start"], r["sentence_end"]) for r in got] == [("One. Two.", 1, 2), ("Three.", 3, 4)]


def test_parent_lists_a_child_that_was_dropped(spark):
    d = docs(spark, ("a.txt", "short text"))
    rows = C.chunk(d, "whole_text", "parent_child").collect()
    assert [(r["chunk_id"], r["children"]) for r in rows] == [("parent_child-1", ["parent_child-1-child-1"])]


def test_chunks_without_words_are_all_kept(spark):
    cs = F.array(*[C.piece(text=F.lit(t)) for t in ("--", "Ab c", "ab, C", "!!")])
    assert [c["text"] for c in value(spark, C.deduped(cs))] == ["--", "Ab c", "!!"]


def test_tokens_are_ascii(spark):
    assert value(spark, T.tokenize(F.lit("The naïve user_1 was HERE"))) == ["na", "ve", "user_1", "was", "here"]


def test_markdown_tables_come_back(spark):
    rows = [["a|b", "c"], ["1", ""], ["2", "3"]]
    made = TB.to_markdown(F.array(*[F.array(*map(F.lit, r)) for r in rows]))
    assert value(spark, TB.from_markdown(made)) == rows


def test_search(spark):
    chunks = spark.createDataFrame([(1, "Portable Network Graphics (PNG) is a raster format"), (2, "A vector format"), (3, "cooking rice with salt"), (4, " ")], "chunk_key long, text string")
    qs = spark.createDataFrame([(1, "what is the full form of PNG"), (2, "what is a vector format")], "query_id long, question string")
    index = R.build_index(chunks)
    best = {r["query_id"]: r for r in R.hybrid_search(qs, index, 3).where("rank = 1").collect()}
    assert best[1]["key"] == 1 and best[1]["intent"] == 0.35 and best[2]["key"] == 2 and best[2]["lexical"] == 1.0
    every = R.score(qs, index).collect()
    assert len(every) == 6 and {r["key"] for r in every} == {1, 2, 3}
    merged = R.merged_search(qs, index, 2).collect()
    assert sorted(r["rank"] for r in merged if r["query_id"] == 1) == [1, 2]


def many_chunks(spark, n=400):
    """Chunks with copies, over several tasks, and questions of all kinds."""
    rng, words = random.Random(7), [f"w{i}" for i in range(60)] + ["vector", "format", "the", "PNG", "Größe"]
    said = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(n // 2)]
    said = said + said[::-1] + [" ", "--", "Portable Network Graphics (PNG)"]
    asked = ["what is vector format", "w1 w2 w2 w3", "the of", None, "stands for PNG", "define w4 w5", "unknownword"] + [" ".join(rng.choices(words, k=12)) for _ in range(5)]
    chunks = spark.createDataFrame(list(enumerate(said)), "chunk_key long, text string").repartition(5)
    return spark.createDataFrame(list(enumerate(asked)), "query_id int, question string"), R.build_index(chunks)


def test_search_sends_only_the_best_of_each_task(spark):
    qs, index = many_chunks(spark)
    for found in (R.hybrid_search(qs, index, 3), R.merged_search(qs, index, 3)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "MapInArrow" in plan
    kept = R._scored(qs, index, {"score": 3})
    assert kept.count() <= 12 * 3 * index.rdd.getNumPartitions() < R.score(qs, index).count()


def test_search_finds_what_all_scores_say(spark, monkeypatch):
    qs, index = many_chunks(spark)
    every = R.score(qs, index).cache()
    assert every.count() == 12 * 402
    monkeypatch.setattr(scoring, "QUESTIONS", 5)  # three passes
    place = lambda df: {(r["query_id"], r["rank"]): (r["key"], r["score"]) for r in df.collect()}
    assert place(R.hybrid_search(qs, index, 7)) == place(R.top(every, "score", 7))
    v, h = ({(r["query_id"], r["key"]): r for r in R.top(every, by, 20).collect()} for by in ("vector", "score"))
    got = R.merged_search(qs, index, 4).collect()
    for q in range(12):
        want = {k: h[q, k]["score"] + (0.05 / v[q, k]["rank"] if (q, k) in v else 0) if (q, k) in h else v[q, k]["vector"] for k in range(403) if (q, k) in h or (q, k) in v}
        order = sorted(want, key=lambda k: (-want[k], h[q, k]["rank"] if (q, k) in h else 99, v[q, k]["rank"] if (q, k) in v else 99))
        assert [r["key"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == order[:4]


def test_scores_are_the_single_signals(spark):
    qs, index = many_chunks(spark, 60)
    pairs = R.score(qs, index).join(index.select("key", "text", "tokens"), "key").join(qs, "query_id")
    pairs = pairs.join(R.term_scores(qs, index).select("query_id", "key", F.col("bm25").alias("b")), ["query_id", "key"], "left")
    pairs = pairs.join(R.vector_scores(qs, index).select("query_id", "key", F.col("vector").alias("v")), ["query_id", "key"], "left").fillna(0.0, ["b", "v"])
    lex = F.coalesce(R.lexical_similarity(T.tokenize(F.coalesce("question", F.lit(""))), F.col("tokens")), F.lit(0.0))
    rows = pairs.select("query_id", "vector", "v", "bm25", "b", "lexical", lex.alias("l"), "intent", R.acronym_boost(F.col("question"), F.col("text")).alias("a")).collect()
    assert len(rows) == 12 * 62
    for r in rows:
        assert r["vector"] == r["v"] and abs(r["bm25"] - r["b"]) < 1e-12 and abs(r["lexical"] - r["l"]) < 1e-12
        assert r["intent"] >= min(0.35, r["a"] or 0.0)


def test_index_has_titles_pages_and_cells_and_prefers_children(spark):
    kind = "chunk_key long, text string, role string, parent_id string, source_unit string, title string, section int, page int, rows array<array<string>>"
    rows = [
        (1, "plain body", "child", "p", "section-1", "Zebra habits", 1, 7, None),
        (2, "a table", "child", "p", "table-1", None, None, None, [["okapi", None], ["x", "y"]]),
        (3, "zebra okapi", "parent", None, None, None, None, None, None),
        (4, " ", "child", "p", None, None, None, None, None),
    ]
    chunks = spark.createDataFrame(rows, kind)
    index = {r["key"]: r["text"] for r in R.build_index(chunks).collect()}
    assert index == {1: "section-1 Zebra habits 1 7\nplain body", 2: "table-1\na table\nokapi x y", 3: "zebra okapi"}
    key = lambda df: sorted(r["chunk_key"] for r in df.collect())
    assert key(R.retrieval_chunks(chunks)) == [1, 2] and key(R.retrieval_chunks(chunks, ["page"])) == [1, 2]
    assert key(R.retrieval_chunks(chunks.where("chunk_key > 2"))) == [3, 4]
    got = R.Retriever(chunks).retrieve("okapi", 1)
    assert [(r["chunk_key"], r["rank"]) for r in got.results] == [(2, 1)] and got.latency_ms > 0


def test_answers(spark):
    none = F.lit(None)
    chunks = spark.createDataFrame([("c1", "The reactor is cooled by water. Its walls are steel."), ("c2", "Gardens need light.")], "chunk_id string, text string")
    chunks = chunks.withColumns({"title": none.cast("string"), "section_path": none.cast("string"), "source_unit": none.cast("string"), "page": F.lit(3), "rows": none.cast("array<array<string>>")})
    qs = spark.createDataFrame([(1, "how is the reactor cooled"), (2, "what about zebras"), (3, "nothing found")], "query_id long, question string")
    asked = A.question_terms(qs, A.support_terms(chunks), 2)
    hits = chunks.where("chunk_id = 'c1'").select(F.explode(F.expr("array(1L, 2L)")).alias("query_id"), F.lit(1).alias("rank"), F.lit(0.5).alias("score"), *chunks.columns)
    got = {r["query_id"]: r["answer"] for r in A.answers(asked, hits).collect()}
    assert got[1] == "Answer: The reactor is cooled by water.\n\nSource: c1, page 3"
    assert got[2].startswith(A.NO_SUPPORT) and got[3] == A.NOTHING_RETRIEVED


def test_support_terms_of_questions(spark):
    """Counted for the questions' terms alone, they are as counted over all terms."""
    rows = [
        (1, "Page: 3 zebras graze\nsource: okapi\nthes lion", None, None), (2, None, "Zebra", None), (3, None, None, None), (4, "section path: lions page: 2 gnus", None, None),
        (5, "The bus has gas\n* lion; -> zebra", None, [["okapi", None], ["gnu", "x"]]), (6, "ß LIONS lion's", "ss", None), (7, "Score: zebra\nzebras\nabs ab as", "", None), (8, "zebras", None, None),
    ]
    chunks = spark.createDataFrame(rows, "doc_id long, text string, title string, rows array<array<string>>").repartition(3)
    qs = spark.createDataFrame([(1, "zebra okapis graze"), (2, "the lions of gnu bus gas"), (3, "thes ab as unknown"), (4, "")], "query_id long, question string")
    terms = lambda df: {r["term"]: r["df"] for r in df.collect()}
    among, plain = {r["term"] for r in A.asked_terms(qs).collect()}, A.support_text(F.col("text"), F.col("title"), F.col("rows"))
    every = terms(chunks.select(F.explode(T.expanded_terms(plain)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    assert terms(A.support_terms(chunks)) == every
    got = A.support_terms(chunks, A.asked_terms(qs))
    assert terms(got) == {t: n for t, n in every.items() if t in among} and "the" in among
    key = lambda df: {r["query_id"]: (set(r["important"]), set(r["anchors"]), r["unseen"]) for r in df.collect()}
    assert key(A.question_terms(qs, got, 8)) == key(A.question_terms(qs, A.support_terms(chunks), 8))


def test_answers_move_no_texts_but_those_found(spark):
    plan = Q.extractive_answer(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "collect_list" not in plan and not re.search("Join (Cross|FullOuter)", plan)


def test_page_rules(spark):
    box = lambda *v: [F.lit(float(x)) for x in v]
    assert value(spark, L.overlap_ratio(box(0, 0, 10, 10), box(5, 0, 20, 10))) == 0.5
    assert value(spark, L.join_fragments(F.array(*map(F.lit, ["Intro", "duc", "the AB", "C x"])))) == "Introduc the ABC x"
    rows = F.array(*[F.array(*map(F.lit, r)) for r in (["Metric", "Target"], ["Speed of the line", "10"], ["Waste share", "2"])])
    assert value(spark, L.is_valid_pdf_table(rows)) and value(spark, L.is_valid_text_strategy_table(rows))
    assert not value(spark, L.is_valid_pdf_table(rows, F.lit(0), F.lit(600)))


def test_views(spark):
    assert value(spark, M.relationship(F.array(*map(F.lit, "abcdef")), F.lit(None).cast("string"))) == "Children: a, b, c, d +2 more"
    assert registry.compatible_chunkers("nothing") == ["recursive"] and value(spark, registry.compatible(F.lit("hierarchical"))) == registry.COMPATIBLE["hierarchical"]
    assert all(s in C.CHUNKERS for some in registry.COMPATIBLE.values() for s in some) and all(m in X.EXTRACTORS for m in registry.COMPATIBLE)
