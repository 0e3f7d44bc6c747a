"""Documents as a stream: extraction and chunking keep no state, so the batch code serves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.chunk import chunk


def read_stream(spark: SparkSession, path: str, schema: StructType | str, name: str = ".txt") -> DataFrame:
    """(doc_id, name, text) of Parquet files as they arrive."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(name)).alias("name"), "text")


def chunk_stream(docs: DataFrame, method: str, strategy: str, out: str, checkpoint: str, **config: int) -> StreamingQuery:
    """Chunks all that has arrived and stops; a later call goes on from the checkpoint."""
    chunks = chunk(docs, method, strategy, **config)
    return chunks.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
