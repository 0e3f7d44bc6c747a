"""Documents from files and tables; chunks to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import utf8_or_drop
from ..functions.text import document_type, let, suffix
from ..operators.word import whole_text
from .docx import docx_items

#: Files that an upload may be.
ACCEPTED = ("pdf", "docx", "txt", "md", "markdown", "html", "py")


def describe(rows: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """Adds suffix, doc_type and size_bytes to rows of a name and its bytes."""
    return rows.withColumns({"suffix": suffix(F.col(name)), "doc_type": document_type(F.col(name)), "size_bytes": F.length(content).cast("bigint")})


def accepted(rows: DataFrame, name: str = "name") -> DataFrame:
    return rows.where(F.substring(suffix(F.col(name)), 2, 20).isin(*ACCEPTED))


def file_text(content: str, kind: Column) -> Column:
    """A file's text by its suffix: Word files are unpacked, all else is UTF-8."""
    word = let(docx_items(F.when(kind == ".docx", F.col(content))), whole_text)
    return F.coalesce(word, utf8_or_drop(content))


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(doc_id, name, suffix, doc_type, size_bytes, text) of the text and Word files below a path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    rows = describe(files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content", "path"))
    return rows.select(F.xxhash64("path").alias("doc_id"), "name", "suffix", "doc_type", "size_bytes", file_text("content", F.col("suffix")).alias("text"))


def read_table(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", name: str = ".txt") -> DataFrame:
    """(doc_id, name, text) of a Parquet table of texts; names are the ids with one suffix."""
    rows = spark.read.parquet(path)
    return rows.select(F.col(id_col).alias("doc_id"), F.concat(F.col(id_col).cast("string"), F.lit(name)).alias("name"), F.col(text_col).alias("text"))


def write_chunks(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet, a folder for each method and strategy."""
    chunks.write.mode(mode).partitionBy("method_id", "requested_strategy").parquet(path)
