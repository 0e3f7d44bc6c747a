"""Which chunkers suit which extractor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Strategies by extraction method, in the order they are offered.
COMPATIBLE = {
    "whole_text": ["fixed_size", "recursive", "semantic", "adaptive"],
    "page_wise": ["fixed_size", "recursive", "semantic", "ocr_aware"],
    "block_wise": ["recursive", "layout_aware", "semantic", "adaptive"],
    "section_wise": ["section_aware", "header_aware", "parent_child", "semantic"],
    "hierarchical": ["header_aware", "section_aware", "parent_child"],
    "layout_aware": ["layout_aware", "table_aware", "multi_modal", "adaptive"],
    "table_aware": ["table_aware", "layout_aware", "parent_child"],
    "semantic_segmentation": ["semantic", "adaptive", "parent_child"],
    "clause_aware": ["clause_aware", "semantic", "recursive"],
    "code_aware": ["code_function", "recursive", "fixed_size"],
}
DEFAULT = ["recursive"]


def compatible_chunkers(method: str) -> list[str]:
    return COMPATIBLE.get(method, DEFAULT)


def edges(spark: SparkSession) -> DataFrame:
    rows = [(m, i, s) for m, some in COMPATIBLE.items() for i, s in enumerate(some, 1)]
    return spark.createDataFrame(rows, "method_id string, pos int, strategy_id string")


def compatible(method: Column) -> Column:
    """array<string> of the strategies for a method's id."""
    known = F.create_map(*[x for m, some in COMPATIBLE.items() for x in (F.lit(m), F.array(*map(F.lit, some)))])
    return F.coalesce(F.try_element_at(known, method), F.array(*map(F.lit, DEFAULT)))
