"""Rollups and views over chunks and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens


def round1(c: Column) -> Column:
    return F.round(c, 1)


def chunk_metrics(chunks: DataFrame, by: list[str]) -> DataFrame:
    n, tokens = F.length("text"), estimate_tokens(F.col("text"))
    return chunks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("chunk_count"), F.avg(n.cast("double")).alias("avg_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"),
        F.avg(tokens.cast("double")).alias("avg_tokens_est"), F.sum((F.size("children") > 0).cast("bigint")).alias("parent_chunks"), F.sum(F.col("parent_id").isNotNull().cast("bigint")).alias("child_chunks"),
    )


def retrieval_metrics(turns: DataFrame) -> DataFrame:
    """turns (turn_ord, latency_ms, retrieved array<string>) -> one row; the last ten of each turn's first three."""
    return turns.agg(
        F.count(F.lit(1)).alias("queries"), F.avg("latency_ms").alias("avg_latency_ms"), F.max_by("latency_ms", "turn_ord").alias("last_latency_ms"),
    ).crossJoin(
        turns.orderBy(F.desc("turn_ord")).limit(10).agg(F.array_sort(F.collect_list(F.struct("turn_ord", F.slice("retrieved", 1, 3).alias("r")))).alias("x")).select(F.flatten(F.transform("x", lambda t: t["r"])).alias("r")).select(F.slice("r", F.greatest(F.lit(1), F.size("r") - 9), F.lit(10)).alias("top_retrieved_chunks"))
    )


def chunk_role(role: Column, parent_id: Column, children: Column) -> Column:
    return F.when(F.coalesce(role, F.lit("")) != "", F.lower(role)).when(parent_id.isNotNull(), "child").when(F.size(children) > 0, "parent").otherwise("chunk")


def source_label(title: Column, section_path: Column, source_unit: Column, chunk_id: Column, page: Column) -> Column:
    name = F.coalesce(F.nullif(title, F.lit("")), F.nullif(section_path, F.lit("")), F.nullif(source_unit, F.lit("")), chunk_id)
    return F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(name, F.lit(", page "), page.cast("string"))).otherwise(name)


def relationship(children: Column, parent_id: Column, most: int = 4) -> Column:
    more = F.size(children) - most
    listed = F.concat(F.array_join(F.slice(children, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(""))
    return F.when(F.size(children) > 0, F.concat(F.lit("Children: "), listed)).when(parent_id.isNotNull(), F.concat(F.lit("Parent: "), parent_id)).otherwise("")


def chunk_table(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "doc_id", "chunk_ord", "chunk_id", "strategy_id", chunk_role(F.col("role"), F.col("parent_id"), F.col("children")).alias("role"),
        F.length("text").alias("chars"), estimate_tokens(F.col("text")).alias("tokens"), "parent_id", F.array_join("children", ", ").alias("children"), relationship(F.col("children"), F.col("parent_id")).alias("relationship"),
    )


def expand_parents(hits: DataFrame, chunks: DataFrame, by: list[str]) -> DataFrame:
    """hits with their chunk's columns, a child's parent beside it."""
    parents = chunks.select(*by, F.col("chunk_id").alias("parent_id"), F.col("text").alias("parent_text"), F.size("children").alias("parent_children"))
    return hits.join(parents, [*by, "parent_id"], "left").withColumn("context_text", F.coalesce("parent_text", "text"))


def shown(hits: DataFrame) -> DataFrame:
    """Hits without those that are parents, ranked anew."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return hits.where(F.coalesce(F.col("role"), F.lit("")) != "parent").withColumn("rank", F.row_number().over(w))
