"""Shared helpers: reading tables, cutting lineage in the shared folder, keys."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Hashable
from contextlib import contextmanager
from typing import Any

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that a worker hands on at once.
ROWS = 250


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is set and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("quillspark.scratch", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("quillspark.scratch", root)
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no more
    than the stage at hand. `cut` writes and rereads, `drop` deletes."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.base, self.n = spark, f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}", 0

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Within it, Arrow batches hold at most `rows` rows, on both sides of the pipe. Only for
    work that ends within, for a plan takes the setting when it runs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of the id's decimal text; null ids count as 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(0))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


_state: tuple[Hashable, Any] | None = None


def worker_state(key: Hashable, make: Callable[[], Any] = lambda: None) -> Any:
    """What a Python worker keeps from task to task: the state of one operator at a time.
    Workers are reused by all stages, so another operator's state is given back first."""
    global _state
    if _state is None or _state[0] != key:
        _state = None
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass
        _state = key, make()
    return _state[1]


def keep_rows(docs: DataFrame, make: Callable[[], Callable[[str], bool]], text_col: str = "text") -> DataFrame:
    """The rows whose text a decider keeps, all columns as they were; null texts count as
    empty. `make` is called once in a task. Rows leave in small batches."""

    def run(batches):
        decide = make()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for k in range(0, batch.num_rows, ROWS):
                some = batch.slice(k, ROWS)
                yield some.filter(pa.array([decide(t.as_py() or "") for t in some.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
