"""Queries over whole tables, each with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..operators import answer as A
from ..operators import chunk as C
from ..operators import extract as X
from ..operators import layout as L
from ..operators import metrics as M
from ..operators import retrieve as R
from ..operators import tables as TB
from . import registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str, suffix: str = ".txt") -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(suffix)).alias("name"), "text")


# The documents' lines and sentences in SQL. What \s means is spelled out, for it differs.
WS_SQL = r"[\s\x{a0}\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}\x{1c}-\x{1f}]"


def stripped(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS_SQL}+', ''), '{WS_SQL}+$', '')"


TOKENS = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9_]+'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "))"
SENTENCES = f"list_filter(list_transform(string_split(regexp_replace({stripped('text')}, '([.!?]){WS_SQL}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {stripped('s')}), lambda s: s <> '')"


@query("""SELECT doc_id, CAST(s AS INTEGER) AS start, substr(text, CAST(s + 1 AS BIGINT), 1000) AS part
FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 900)) AS s FROM documents WHERE length(text) > 0)
WHERE regexp_matches(substr(text, CAST(s + 1 AS BIGINT), 1000), '\\S')""")
def fixed_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(C.fixed_windows(F.col("text"), 1000, 100)).alias("w")).select("doc_id", "w.start", "w.part")


@query(f"SELECT doc_id, CAST(i AS INTEGER) AS grp, array_to_string(list_slice(s, 5 * i + 1, 5 * i + 5), ' ') AS text FROM (SELECT doc_id, s, unnest(generate_series(0, (len(s) - 1) // 5)) AS i FROM (SELECT doc_id, {SENTENCES} AS s FROM documents) WHERE len(s) > 0)")
def sentence_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(X.sentence_groups(F.col("text"), 5)).alias("grp", "text"))


@query(rf"SELECT doc_id, greatest(1, len(regexp_extract_all(text, '[\pL\pN_]+|[^\pL\pN_\s\x{{a0}}\x{{85}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{0b}}\x{{1c}}-\x{{1f}}]'))) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


_NAMES = [".PDF", ".docx", ".txt", ".md", ".html", ".py", ".tar.gz", "", ".Go", ".h"]


@query("SELECT p_partkey, name, CASE lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.SUFFIX_TYPES.items()) + " ELSE 'Unknown' END AS doc_type FROM (SELECT p_partkey, 'file' || p_partkey || [" + ", ".join(f"'{n}'" for n in _NAMES) + "][CAST(p_partkey % 10 + 1 AS INTEGER)] AS name FROM part)")
def doc_types(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.concat(F.lit("file"), F.col("p_partkey").cast("string"), F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % 10 + 1).cast("int")))
    return p.select("p_partkey", name.alias("name")).withColumn("doc_type", T.document_type(F.col("name")))


@query("SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) ELSE printf('%.1f MB', n / 1048576.0) END AS size FROM (SELECT doc_id, n_chars * (doc_id % 1000) AS n FROM documents)")
def human_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.human_size(F.col("n_chars") * (F.col("doc_id") % 1000)).alias("size"))


@query(f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def tokenize_df(spark, sf_dir):
    index = R.build_index(table(spark, sf_dir, "documents"), "doc_id")
    return R.postings(index).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


VECTORS = """SELECT {key}, dim, sum(CASE WHEN CAST('0x' || substr(h, 9, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS v FROM
(SELECT {key}, h, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 384 AS dim FROM (SELECT {key}, sha256(unnest(regexp_extract_all(lower({text}), '[a-z0-9_]+'))) AS h FROM {frm})) GROUP BY ALL HAVING v <> 0"""


@query(f"SELECT doc_id, CAST(dim AS INTEGER) AS dim, CAST(v AS BIGINT) AS v FROM ({VECTORS.format(key='doc_id', text='text', frm='documents')})")
def hash_embed(spark, sf_dir):
    return R.hash_vectors(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.explode("vec").alias("dim", "v"))


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _index(spark, sf_dir):
    return R.build_index(table(spark, sf_dir, "documents"), "doc_id")


BM25 = f"""WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY ALL),
dl AS (SELECT doc_id, len({TOKENS.format('text')}) AS n FROM documents WHERE regexp_matches(text, '\\S')),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(avg(CAST(n AS DOUBLE)) AS DOUBLE) AS avg_len FROM dl),
df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM p GROUP BY term),
qt AS (SELECT DISTINCT item_id, unnest({TOKENS.format('text')}) AS term FROM benchmark),
s AS (SELECT item_id AS query_id, p.doc_id, sum(ln(1.0::DOUBLE + ((st.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * ((tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (1.0::DOUBLE - 0.75::DOUBLE + 0.75::DOUBLE * (dl.n / greatest(1.0::DOUBLE, avg_len)))))) AS raw
FROM qt JOIN p USING (term) JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY ALL)"""


@query(BM25 + " SELECT query_id, doc_id, round(raw / (raw + 3.0::DOUBLE), 6) AS bm25 FROM s")
def bm25_scores(spark, sf_dir):
    t = R.term_scores(_questions(spark, sf_dir), _index(spark, sf_dir))
    return t.select("query_id", F.col("key").alias("doc_id"), F.round("bm25", 6).alias("bm25"))


@query(f"""WITH q AS ({VECTORS.format(key='item_id', text='text', frm='benchmark')}), d AS ({VECTORS.format(key='doc_id', text='text', frm='documents')}),
qn AS (SELECT item_id, sum(v * v) AS n FROM q GROUP BY ALL), dn AS (SELECT doc_id, sum(v * v) AS n FROM d GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(q.v * d.v) AS dot FROM q JOIN d USING (dim) GROUP BY ALL),
r AS (SELECT item_id, doc_id, CAST(dot AS DOUBLE) / (sqrt(CAST(qn.n AS DOUBLE)) * sqrt(CAST(dn.n AS DOUBLE))) AS c FROM s JOIN qn USING (item_id) JOIN dn USING (doc_id))
SELECT query_id, rank, doc_id, round(c, 6) AS vector FROM (SELECT item_id AS query_id, doc_id, c, CAST(row_number() OVER (PARTITION BY item_id ORDER BY c DESC, doc_id) AS INTEGER) AS rank FROM r) WHERE rank <= 10""")
def hash_vector_topk(spark, sf_dir):
    s = R.vector_scores(_questions(spark, sf_dir), _index(spark, sf_dir)).withColumn("ord", F.col("key"))
    return R.top(s, "vector", 10).select("query_id", "rank", F.col("key").alias("doc_id"), F.round("vector", 6).alias("vector"))


@query()
def hybrid_topk(spark, sf_dir):
    return R.hybrid_search(_questions(spark, sf_dir), _index(spark, sf_dir), 5).select("query_id", "rank", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query()
def merged_topk(spark, sf_dir):
    return R.merged_search(_questions(spark, sf_dir), _index(spark, sf_dir), 5).select("query_id", "rank", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), "index")


@query("""SELECT doc_id, source, text_key FROM (SELECT doc_id, source, lower(regexp_replace(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), '^ | $', '', 'g')) AS text_key,
row_number() OVER (PARTITION BY source, lower(regexp_replace(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), '^ | $', '', 'g')) ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def dedupe_keep_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    key = F.lower(F.regexp_replace(F.regexp_replace("text", "[^A-Za-z]+", " "), "^ | $", ""))
    first = d.select("doc_id", "source", key.alias("text_key")).groupBy("source", "text_key").agg(F.min("doc_id").alias("doc_id"))
    return first.select("doc_id", "source", "text_key")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{m}', {i}, '{s}')" for m, some in registry.COMPATIBLE.items() for i, s in enumerate(some, 1)) + ") AS t(method_id, pos, strategy_id)")
def compat_edges(spark, sf_dir):
    return registry.edges(spark)


KIND = """CASE WHEN s = '' THEN NULL WHEN contains(s, '|') AND len(list_filter(string_split(trim(s, '|'), '|'), lambda c: trim(c) <> '')) >= 2 THEN 'pipe'
WHEN contains(s, chr(9)) AND len(list_filter(string_split(s, chr(9)), lambda c: trim(c) <> '')) >= 2 THEN 'tab'
WHEN NOT regexp_matches(s, '^[-*+]\\s+') AND NOT contains(s, ', ') AND contains(s, ',') AND len(list_filter(string_split(s, ','), lambda c: trim(c) <> '')) >= 2 THEN 'csv' END"""


@query(f"SELECT doc_id, CAST(line AS INTEGER) AS line, {KIND} AS kind FROM (SELECT doc_id, generate_subscripts(x, 1) - 1 AS line, {stripped('unnest(x)')} AS s FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS x FROM documents WHERE text <> ''))")
def delimited_kind(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.splitlines(F.col("text"))).alias("line", "x"))
    return lines.select("doc_id", "line", TB.line_kind(F.col("x")).alias("kind"))


# A Markdown table of each region's nations, rendered alike on both sides.
def _region_tables(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name")
    row = F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), F.col("n_name"), F.lit(" |"))
    body = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("x")))).alias("xs"))
    text = F.concat(F.lit("# Nations\nThese are the nations of one region of the world.\n| key | name |\n|---|---|\n"), F.array_join(F.transform("xs", lambda x: x["x"]), "\n"), F.lit("\nThat was all."))
    return body.select(F.col("n_regionkey").cast("bigint").alias("doc_id"), F.concat(F.col("n_regionkey").cast("string"), F.lit(".md")).alias("name"), text.alias("text"))


@query("SELECT CAST(n_regionkey AS BIGINT) AS doc_id, 'pipe' AS kind, 3 AS first, CAST(count(*) + 4 AS INTEGER) AS last, true AS valid FROM nation GROUP BY n_regionkey")
def table_islands(spark, sf_dir):
    return _region_tables(spark, sf_dir).select("doc_id", F.explode(TB.islands(F.col("text"))).alias("r")).select("doc_id", "r.kind", "r.first", "r.last", "r.valid")


@query("SELECT CAST(n_regionkey AS BIGINT) AS doc_id, '# Nations' || chr(10) || 'These are the nations of one region of the world.' || chr(10) || 'That was all.' AS plain, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey")
def table_markdown(spark, sf_dir):
    t = _region_tables(spark, sf_dir).withColumn("runs", TB.islands(F.col("text")))
    return t.select("doc_id", TB.without_tables(F.col("text"), F.col("runs")).alias("plain"), TB.to_markdown(TB.tables(F.col("runs"))[0]["rows"]).alias("markdown"))


@query("SELECT CAST(n_regionkey AS BIGINT) AS doc_id, 'Key-value table: key = name | ' || array_to_string(list_slice(list(n_nationkey || ' = ' || n_name ORDER BY n_nationkey), 1, 5), ' | ') AS said FROM nation GROUP BY n_regionkey")
def table_context(spark, sf_dir):
    t = _region_tables(spark, sf_dir).select("doc_id", TB.tables(TB.islands(F.col("text")))[0]["rows"].alias("rows"))
    return t.select("doc_id", TB.table_context(F.col("rows"))[0].alias("said"))


# Sections of each customer's orders, as the text itself numbers them.
def _order_sections(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = o.withColumn("n", F.row_number().over(w))
    part = F.concat(F.lit("Section "), F.col("n").cast("string"), F.lit(": "), F.col("o_orderpriority"), F.lit("\n\n\n\nOrder "), F.col("o_orderkey").cast("string"), F.lit(" has the status "), F.col("o_orderstatus"), F.lit("."))
    d = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("n", part.alias("x")))).alias("xs"))
    return d.select(F.col("o_custkey").alias("doc_id"), F.concat(F.col("o_custkey").cast("string"), F.lit(".txt")).alias("name"), F.array_join(F.transform("xs", lambda x: x["x"]), "\n").alias("text"))


@query("""SELECT o_custkey AS doc_id, CAST(n AS INTEGER) AS unit_ord, 'section-' || n AS unit_id, o_orderpriority AS title, o_orderpriority AS section_path,
'Section ' || n || ': ' || o_orderpriority || repeat(chr(10), 4) || 'Order ' || o_orderkey || ' has the status ' || o_orderstatus || '.' AS text
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)""")
def sections_numbered(spark, sf_dir):
    return X.extract(_order_sections(spark, sf_dir), "section_wise").select("doc_id", "unit_ord", "unit_id", "title", "section_path", "text")


@query("""SELECT o_custkey AS doc_id, CAST(n AS INTEGER) AS chunk_ord, 'section_aware-' || n AS chunk_id, 'Section path: ' || o_orderpriority || chr(10) || chr(10) || 'Section ' || n || ': ' || o_orderpriority || repeat(chr(10), 4) || 'Order ' || o_orderkey || ' has the status ' || o_orderstatus || '.' AS text
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)""")
def section_chunks(spark, sf_dir):
    return C.chunk(_order_sections(spark, sf_dir), "section_wise", "section_aware").select("doc_id", "chunk_ord", "chunk_id", "text")


# Regions and nations as Markdown headings of two levels.
def _atlas(spark, sf_dir):
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    line = F.concat(F.lit("## "), F.col("n_name"), F.lit("\nThe nation with the key "), F.col("n_nationkey").cast("string"), F.lit(" lies here."))
    parts = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("x")))).alias("xs"))
    j = r.join(parts, r["r_regionkey"] == parts["n_regionkey"])
    text = F.concat(F.lit("# "), F.col("r_name"), F.lit("\nAn overview of all the nations follows.\n"), F.array_join(F.transform("xs", lambda x: x["x"]), "\n"))
    return j.select(F.col("r_regionkey").cast("bigint").alias("doc_id"), F.concat(F.col("r_regionkey").cast("string"), F.lit(".md")).alias("name"), text.alias("text"))


ATLAS = """SELECT CAST(r_regionkey AS BIGINT) AS doc_id, 1 AS unit_ord, r_name AS title, 1 AS level, r_name AS section_path, CAST(NULL AS VARCHAR) AS parent FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
UNION ALL SELECT CAST(n_regionkey AS BIGINT), CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + 1 AS INTEGER), n_name, 2, r_name || ' > ' || n_name, 'section-1' FROM nation JOIN region ON n_regionkey = r_regionkey"""


@query(f"SELECT doc_id, unit_ord, title, level, section_path FROM ({ATLAS})")
def section_fill(spark, sf_dir):
    return X.extract(_atlas(spark, sf_dir), "section_wise").select("doc_id", "unit_ord", "title", "level", "section_path")


@query(f"SELECT doc_id, unit_ord, parent AS parent_unit_id, level - 1 AS depth, section_path FROM ({ATLAS})")
def hierarchy_path(spark, sf_dir):
    return X.hierarchy(X.extract(_atlas(spark, sf_dir), "hierarchical")).select("doc_id", "unit_ord", "parent_unit_id", "depth", "section_path")


@query(f"SELECT doc_id, level, title, CAST(CASE WHEN level = 1 THEN 0 ELSE 2 * unit_ord - 2 END AS INTEGER) AS line FROM ({ATLAS})")
def markdown_headings(spark, sf_dir):
    return _atlas(spark, sf_dir).select("doc_id", F.explode(T.markdown_headers(F.col("text"))).alias("h")).select("doc_id", "h.level", "h.title", "h.line")


# Clauses from parts.
def _contracts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit("Terms for brand "), F.col("p_brand"), F.lit(";\n(a) The type is "), F.col("p_type"), F.lit("\n(b) The size is "), F.col("p_size").cast("string"), F.lit("; nothing else holds"))
    return p.select(F.col("p_partkey").alias("doc_id"), F.concat(F.col("p_partkey").cast("string"), F.lit(".txt")).alias("name"), text.alias("text"))


@query("""SELECT p_partkey AS doc_id, clause, text FROM (SELECT p_partkey, unnest([1, 2, 3, 4]) AS clause,
unnest(['Terms for brand ' || p_brand || ';', 'The type is ' || p_type, 'The size is ' || p_size || ';', 'nothing else holds']) AS text FROM part)""")
def clause_units(spark, sf_dir):
    return X.extract(_contracts(spark, sf_dir), "clause_aware").select("doc_id", "clause", "text")


@query("""SELECT s_suppkey AS doc_id, CAST(b AS INTEGER) AS block, CASE b WHEN 1 THEN 'Supplier ' || s_name ELSE 'Nation ' || s_nationkey || ' is home.' END AS text FROM (SELECT *, unnest([1, 2]) AS b FROM supplier)""")
def paragraph_blocks(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    text = F.concat(F.lit("Supplier\n"), F.col("s_name"), F.lit("\n \n\nNation  "), F.col("s_nationkey").cast("string"), F.lit(" is home.\n"))
    d = s.select(F.col("s_suppkey").alias("doc_id"), F.lit("s.txt").alias("name"), text.alias("text"))
    return X.extract(d, "block_wise").select("doc_id", "block", "text")


@query()
def recursive_chunks(spark, sf_dir):
    return C.chunk(docs(spark, sf_dir), "whole_text", "recursive").select("doc_id", "chunk_ord", "chunk_id", "text", "overlap")


@query()
def parent_child_chunks(spark, sf_dir):
    return C.chunk(_atlas(spark, sf_dir), "section_wise", "parent_child").select("doc_id", "chunk_ord", "chunk_id", "parent_id", "children", "text")


@query("""SELECT doc_id, count(*) AS chunk_count, round(avg(n), 6) AS avg_chars, min(n) AS min_chars, max(n) AS max_chars FROM
(SELECT doc_id, CAST(length(regexp_replace(regexp_replace(substr(text, CAST(s + 1 AS BIGINT), 1000), '^\\s+', ''), '\\s+$', '')) AS INTEGER) AS n FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 900)) AS s FROM documents WHERE length(text) > 0)) WHERE n > 0 GROUP BY doc_id""")
def chunk_metrics(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(C.fixed_windows(F.col("text"), 1000, 100)).alias("w"))
    chunks = d.select("doc_id", T.strip(F.col("w.part")).alias("text"), F.array().cast("array<string>").alias("children"), F.lit(None).cast("string").alias("parent_id"))
    return M.chunk_metrics(chunks, ["doc_id"]).select("doc_id", "chunk_count", F.round("avg_chars", 6).alias("avg_chars"), "min_chars", "max_chars")


@query("""SELECT count(*) AS queries, round(avg(value), 6) AS avg_latency_ms, round(arg_max(value, event_id), 6) AS last_latency_ms FROM events""")
def retrieval_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("turn_ord"), F.col("value").alias("latency_ms"), F.array(F.col("event_type")).alias("retrieved"))
    return M.retrieval_metrics(e).select("queries", F.round("avg_latency_ms", 6).alias("avg_latency_ms"), F.round("last_latency_ms", 6).alias("last_latency_ms"))


# Page blocks made from line items; table areas from the third lines.
def _blocks(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    return i.select(
        F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("block_ord"), F.concat(F.lit("Item "), F.col("l_returnflag"), F.col("l_linestatus")).alias("text"),
        (F.col("l_orderkey") % 50).cast("int").alias("page"), (F.col("l_partkey") % 100).cast("double").alias("x0"), (F.col("l_linenumber") * 100).cast("double").alias("y0"),
        (F.col("l_partkey") % 100 + 150).cast("double").alias("x1"), (F.col("l_linenumber") * 100 + 60).cast("double").alias("y1"), F.col("l_quantity").alias("max_size"),
    )


BLOCKS = "SELECT l_suppkey AS doc_id, l_orderkey AS o, l_linenumber AS n, l_orderkey * 10 + l_linenumber AS block_ord, 'Item ' || l_returnflag || l_linestatus AS text, l_orderkey % 50 AS page, CAST(l_partkey % 100 AS DOUBLE) AS x0, CAST(l_linenumber * 100 AS DOUBLE) AS y0, CAST(l_partkey % 100 + 150 AS DOUBLE) AS x1, CAST(l_linenumber * 100 + 60 AS DOUBLE) AS y1, l_quantity AS max_size FROM lineitem"


@query(f"""WITH b AS ({BLOCKS}), a AS (SELECT doc_id, page, x0 + 90 AS x0, y0 + 10 AS y0, x1 + 90 AS x1, y1 + 10 AS y1 FROM b WHERE n = 3)
SELECT doc_id, block_ord FROM b WHERE EXISTS (SELECT 1 FROM a WHERE a.doc_id = b.doc_id AND a.page = b.page AND
greatest(0, least(b.x1, a.x1) - greatest(b.x0, a.x0)) * greatest(0, least(b.y1, a.y1) - greatest(b.y0, a.y0)) / greatest(1, (b.x1 - b.x0) * (b.y1 - b.y0)) > 0.15)""")
def bbox_overlap_join(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    a = b.where("n = 3").select("doc_id", "page", (F.col("x0") + 90).alias("x0"), (F.col("y0") + 10).alias("y0"), (F.col("x1") + 90).alias("x1"), (F.col("y1") + 10).alias("y1"))
    return L.blocks_in_tables(b, a).select("doc_id", "block_ord")


@query(f"SELECT doc_id, text, count(DISTINCT page) AS pages FROM ({BLOCKS}) GROUP BY ALL HAVING count(DISTINCT page) >= 3")
def repeated_headers(spark, sf_dir):
    return L.repeated_texts(_blocks(spark, sf_dir))


@query(f"""WITH s AS (SELECT doc_id, round_even(max_size, 0) AS size, block_ord FROM ({BLOCKS})), c AS (SELECT doc_id, size, count(*) AS n, min(block_ord) AS first FROM s WHERE size >= 8 GROUP BY ALL)
SELECT DISTINCT d.doc_id, coalesce(b.size, 12.0) AS body_size FROM (SELECT DISTINCT l_suppkey AS doc_id FROM lineitem) d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS r FROM c) b ON d.doc_id = b.doc_id AND r = 1""")
def dominant_body_size(spark, sf_dir):
    return L.dominant_body_size(_blocks(spark, sf_dir))


@query()
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.html_to_text("html").alias("text"))


@query()
def html_units(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit("p.html").alias("name"), F.col("html").alias("text"))
    return X.extract(p, "table_aware").select("doc_id", "unit_ord", "unit_type", "title", "text")


@query("SELECT p_partkey AS doc_id, CAST(n AS INTEGER) AS unit_ord, CASE n WHEN 1 THEN 'code_context' ELSE 'code_symbol' END AS unit_type, CASE n WHEN 1 THEN 'module' WHEN 2 THEN 'f' || p_partkey ELSE 'C' || p_size END AS symbol, CASE n WHEN 1 THEN 'import os' WHEN 2 THEN 'def f' || p_partkey || '(x):' || chr(10) || '    return ' || p_size ELSE 'class C' || p_size || ':' || chr(10) || '    pass' END AS text FROM (SELECT *, unnest([1, 2, 3]) AS n FROM part)")
def python_units(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.concat(F.lit("import os\n\ndef f"), k, F.lit("(x):\n    return "), s, F.lit("\nclass C"), s, F.lit(":\n    pass\n"))
    d = p.select(F.col("p_partkey").alias("doc_id"), F.lit("m.py").alias("name"), text.alias("text"))
    return X.extract(d, "code_aware").select("doc_id", "unit_ord", "unit_type", "symbol", "text")


@query("SELECT p_partkey AS doc_id, CAST(n AS INTEGER) AS unit_ord, CASE n WHEN 1 THEN 'const' ELSE 'function' END AS kind, CASE n WHEN 1 THEN 'a' ELSE 'f' || p_size END AS symbol, CASE n WHEN 1 THEN 'const a = ' || p_partkey || ';' ELSE 'function f' || p_size || '() {' || chr(10) || '}' END AS text FROM (SELECT *, unnest([1, 2]) AS n FROM part)")
def code_symbols(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit("// head\nconst a = "), F.col("p_partkey").cast("string"), F.lit(";\nfunction f"), F.col("p_size").cast("string"), F.lit("() {\n}\n"))
    d = p.select(F.col("p_partkey").alias("doc_id"), F.lit("m.js").alias("name"), text.alias("text"))
    return X.extract(d, "code_aware").select("doc_id", "unit_ord", "kind", "symbol", "text")


# Acronyms from part names' first letters.
def _glossary(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    parts = F.split("p_name", " ")
    cap = F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 50))), " ")
    short = F.concat(F.array_join(F.transform(parts, lambda w: F.upper(F.substring(w, 1, 1))), ""), F.lit("X"))
    return p.select(F.col("p_partkey").alias("key"), cap.alias("words"), short.alias("acronym")).withColumn("text", F.concat("words", F.lit(" ("), "acronym", F.lit(") is sold by the piece.")))


@query("""SELECT key, acronym, regexp_matches(words, '^[A-Z][A-Za-z&.,'' /-]{3,}') AS known, CASE WHEN regexp_matches(words, '^[A-Z][A-Za-z&.,'' /-]{3,}') THEN acronym || ': ' || words ELSE '' END AS answer FROM
(SELECT p_partkey AS key, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS words, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1))), '') || 'X' AS acronym FROM part)""")
def acronym_expansion(spark, sf_dir):
    g = _glossary(spark, sf_dir).withColumn("question", F.concat(F.lit("what is the full form of "), "acronym"))
    return g.select("key", "acronym", R.has_acronym_expansion(F.col("text"), F.col("acronym")).alias("known"), A.acronym_answer(F.col("question"), F.col("text")).alias("answer"))


EXPANDED = f"list_distinct(list_concat({TOKENS.format('text')}, list_transform(list_filter({TOKENS.format('text')}, lambda w: w LIKE '%s' AND length(w) > 3), lambda w: w[:-2])))"


@query(f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest({EXPANDED}) AS term FROM documents) GROUP BY term")
def support_terms(spark, sf_dir):
    terms = table(spark, sf_dir, "documents").select(F.explode(T.expanded_terms(F.col("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _document_chunks(spark, sf_dir):
    none = lambda t: F.lit(None).cast(t)
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("chunk_id"), "text", none("string").alias("title"), none("string").alias("section_path"), none("string").alias("source_unit"), none("int").alias("page"), none("array<array<string>>").alias("rows"))


@query()
def extractive_answer(spark, sf_dir):
    chunks, questions = _document_chunks(spark, sf_dir), _questions(spark, sf_dir)
    found = R.hybrid_search(questions, _index(spark, sf_dir), 3).select("query_id", "rank", "score", F.col("key").alias("doc_id"))
    hits = chunks.join(F.broadcast(found), "doc_id")  # three rows a question
    df = A.support_terms(chunks, A.asked_terms(questions))
    asked = A.question_terms(questions, df, table(spark, sf_dir, "documents").count())
    return A.answers(asked, hits).select("query_id", "answer", "source")


@query("SELECT doc_id, CASE WHEN title <> '' THEN title WHEN path <> '' THEN path ELSE 'chunk-' || doc_id END || CASE WHEN page <> 0 THEN ', page ' || page ELSE '' END AS label FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END AS title, CASE WHEN doc_id % 3 = 1 THEN lang ELSE NULL END AS path, doc_id % 4 AS page FROM documents)")
def source_labels(spark, sf_dir):
    i = F.col("doc_id")
    label = M.source_label(F.when(i % 3 == 0, F.col("source")).otherwise(""), F.when(i % 3 == 1, F.col("lang")), F.lit(None).cast("string"), F.concat(F.lit("chunk-"), i.cast("string")), i % 4)
    return table(spark, sf_dir, "documents").select("doc_id", label.alias("label"))


@query("""SELECT o_orderkey, sort_key, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY sort_key, is_table, o_orderkey) AS INTEGER) AS pos FROM (SELECT o_custkey, o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey % 7 AS DOUBLE) WHEN 1 THEN 10000.0 * (o_orderkey % 5) + 72.5 WHEN 2 THEN 1000000.0 + o_orderkey % 3 ELSE 1000000000.0 END AS sort_key, CASE WHEN o_orderkey % 4 >= 2 THEN 1 ELSE 0 END AS is_table FROM orders)""")
def unit_order(spark, sf_dir):
    k = F.col("o_orderkey")
    key = F.when(k % 4 == 0, (k % 7).cast("double")).when(k % 4 == 1, L.position_order(k % 5, F.lit(72.5))).when(k % 4 == 2, TB.TABLE_ORDER + (k % 3).cast("double")).otherwise(X.LAST)
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", key.alias("sort_key"), F.when(k % 4 >= 2, 1).otherwise(0).alias("is_table"))
    return o.select("o_orderkey", "sort_key", F.row_number().over(Window.partitionBy("o_custkey").orderBy("sort_key", "is_table", "o_orderkey")).alias("pos"))


@query("""WITH c AS (SELECT conv_id, turn, role, text FROM conversations), p AS (SELECT conv_id, min(turn) AS t FROM c GROUP BY conv_id)
SELECT c.conv_id, c.turn, coalesce(q.text, c.text) AS context_text FROM c JOIN p USING (conv_id) LEFT JOIN c q ON q.conv_id = c.conv_id AND q.turn = p.t AND c.turn > p.t""")
def parent_expand(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    first = F.min("turn").over(Window.partitionBy("conv_id"))
    child = c.select("conv_id", "turn", "text", F.col("turn").cast("string").alias("chunk_id"), F.when(F.col("turn") > first, first.cast("string")).alias("parent_id"), F.array().cast("array<string>").alias("children"))
    return M.expand_parents(child, child.where("parent_id IS NULL"), ["conv_id"]).select("conv_id", "turn", "context_text")
