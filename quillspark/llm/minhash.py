"""Near-duplicate documents by circulant MinHash (operator 1).

A document is the set of its distinct word shingles. One permutation places a shingle
on a circle of `CIRCLE` positions; a second permutation, shifted round the circle by
k places, gives the k-th signature coordinate, so all coordinates come from two
permutations and a shingle's values are one contiguous stretch of a table. Bands of
coordinates are hashed into buckets. Equal sets are one class throughout. In each bucket
every class is compared with the bucket's least class. Members of a bucket that are then
still in different components are compared as well, in blocks of bounded size, by
signature and then by full set, so that no candidate pair is passed over, while pairs of a
group never leave a block. Links are confirmed on the full sets.

Defined results: letters A-Z are lower-cased, words are runs of anything but ASCII white
space; a text with fewer words than a shingle is one shingle; a text that is null or
without words has an empty set, no link, and is its own component; repeated rows are
copies of one another; a null id can belong to a component but never names one. Columns
other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty, worker_state
from .graph import components

#: Positions on the circle.
CIRCLE = 1 << 20
#: Chance that a pair right at the threshold meets in no band.
MISS = 1e-6
#: Distinct words whose hashes a worker remembers; a full memo starts anew.
MEMO = 200_000
#: Rows in a block of a bucket, and deviations that a signature's agreement may fall short of the threshold.
BLOCK, SIGMAS = 256, 5.0
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def bands_for(threshold: float, rows: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**rows))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, words: int):
        self.words, self.memo = words, {}

    def set_of(self, text: str) -> np.ndarray:
        found = text.encode("utf-8", "surrogatepass").lower().split()  # both know ASCII only
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        hashes = []
        for w in found:
            h = memo.get(w)
            if h is None:
                h = memo[w] = xxhash.xxh3_64_intdigest(w)
            hashes.append(h)
        h = np.array(hashes, np.uint64)
        k = min(self.words, len(h))
        if not k:
            return h
        out = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            out = _mix(out) * _M3 + h[i : len(h) - k + 1 + i]
        return np.unique(_mix(out + np.uint64(k)))


class Circulant:
    """Signatures of sets of 64-bit hashes."""

    def __init__(self, size: int, seed: int = 1):
        second = np.random.RandomState(seed).permutation(CIRCLE).astype(np.uint32)
        self.size = size
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: size - 1]]), size)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> np.uint64(64 - CIRCLE.bit_length() + 1)).astype(np.int64)
        sig = self.windows[at[:512]].min(axis=0)
        for i in range(512, len(at), 512):
            np.minimum(sig, self.windows[at[i : i + 512]].min(axis=0), out=sig)
        return sig


def _circulant(size: int) -> Circulant:
    """A worker's table, kept from task to task."""
    return worker_state(("circulant", size), lambda: Circulant(size))


def fingerprint(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, ref, text): ref is the id, or a number made from the text where the id is null."""
    doc, text = F.col(id_col).cast("bigint"), text_or_empty(text_col)
    return docs.select(doc.alias("doc"), F.coalesce(doc, F.xxhash64(text)).alias("ref"), text.alias("text"))


def signatures(docs: DataFrame, words: int, rows: int, bands: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, ref, fp, n, keys): fp names the set, keys are its buckets; both null for an empty set."""

    def run(batches):
        shingler, circulant = Shingler(words), _circulant(rows * bands)
        salt = np.arange(1, bands + 1, dtype=np.uint64) * _M2
        for batch in batches:
            fps, ns, keys = [], [], []
            for text in batch.column(1):
                s = shingler.set_of(text.as_py())
                ns.append(len(s))
                if not len(s):
                    fps.append(None)
                    keys.append(None)
                    continue
                fps.append(fingerprint(s))
                sig = circulant.signature(s).astype(np.uint64).reshape(bands, rows)
                key = salt.copy()
                for i in range(rows):
                    key = _mix(key + sig[:, i]) * _M3
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.binary()), pa.array(ns, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc", "ref", "fp", "n", "keys"])

    return _texts(docs, id_col, text_col).select("doc", "text", "ref").mapInArrow(run, "doc bigint, ref bigint, fp binary, n bigint, keys array<bigint>")


def _sets(docs: DataFrame, sigs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(fp, s): the sets named in `wanted`, made again from one document of each."""
    one = sigs.select("fp", "ref").join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("ref").alias("ref"))

    def run(batches):
        shingler = Shingler(words)
        for batch in batches:
            fps, sets = [], []
            for fp, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingler.set_of(text.as_py())
                if len(s) and fingerprint(s) == fp:  # another row may have the same id
                    fps.append(fp)
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["fp", "s"])

    return _texts(docs, id_col, text_col).join(one, "ref").select("fp", "text").mapInArrow(run, "fp binary, s array<bigint>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = pairs.join(sets.select(F.col("fp").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("fp").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), shared.alias("i")).where(F.col("i") * 100 >= (F.col("na") + F.col("nb") - F.col("i")) * percent).select("a", "b")


def _stars(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b")


def _open(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, fp, n, root) of the buckets that reach over more than one component."""
    r = buckets.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("key", "fp", "n", F.coalesce("root", "fp").alias("root"))
    mixed = r.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi and size > 2").select("key")
    return r.join(mixed, "key")


def _linked_in_blocks(open_: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): links between components, as many as join what the members of a pair of blocks
    join. A pair's signatures must agree in as many coordinates as those of any pair at the
    threshold do, but for `SIGMAS` deviations; its full sets then decide."""
    t = percent / 100
    least = size * (t - SIGMAS * math.sqrt(t * (1 - t) / size))
    blocks = open_.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k"))
    dealt = open_.join(blocks, "key").join(sets, "fp").withColumn("b", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    # a row goes to every pair of blocks that its own is part of
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("key", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "fp", "root", "s")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        circulant = _circulant(size)
        side, fps = pdf["b"].to_numpy(), pdf["fp"].to_list()
        every = [np.asarray(s).view(np.uint64) for s in pdf["s"]]
        sig = np.array([circulant.signature(s) for s in every])
        n = np.array([len(s) for s in every])
        names = {r: i for i, r in enumerate(dict.fromkeys(pdf["root"]))}
        root = np.array([names[r] for r in pdf["root"]])
        found: list[tuple] = []
        for i in np.flatnonzero(side == key[1]):
            other = (side == key[2]) & (root != root[i]) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * percent)
            at = np.flatnonzero(other)
            at = at[at > i] if key[1] == key[2] else at
            for j in at[(sig[at] == sig[i]).sum(axis=1) >= least]:
                if root[j] == root[i]:
                    continue
                where = np.minimum(np.searchsorted(every[i], every[j]), n[i] - 1)
                shared = int((every[i][where] == every[j]).sum())
                if shared * 100 >= (n[i] + n[j] - shared) * percent:
                    found.append((max(fps[i], fps[j]), min(fps[i], fps[j])))
                    root[root == root[j]] = root[i]
        return pd.DataFrame(found, columns=["a", "b"], dtype=object)

    return dealt.groupBy("key", "i", "j").applyInPandas(compare, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rows: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per document."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "minhash")
    rows = rows or (7 if percent >= 85 else 6)
    bands = bands_for(percent / 100, rows)
    sigs = scratch.cut(signatures(docs, words, rows, bands, id_col, text_col), "signatures")

    classes = sigs.where("fp is not null").groupBy("fp").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    members = classes.select("fp", "n", F.explode("keys").alias("key"))
    least = members.groupBy("key").agg(F.min("fp").alias("leader"), F.min(F.struct("fp", "n"))["n"].alias("leader_n"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    buckets = scratch.cut(members.join(least, "key"), "buckets")  # only those that are shared

    fits = lambda x, y: (F.least(x, y) * 100 >= F.greatest(x, y) * percent)  # noqa: E731  sizes alone allow the similarity
    sets = scratch.cut(_sets(docs, sigs, buckets.select("fp").distinct(), words, id_col, text_col), "sets")
    first = buckets.where("fp <> leader").where(fits(F.col("n"), F.col("leader_n"))).select(F.col("fp").alias("a"), F.col("leader").alias("b")).distinct()
    links = scratch.cut(_confirmed(first, sets, percent), "links")
    roots = scratch.cut(components(links, scratch), "roots")

    # What the leaders leave open: members of one bucket in different components. Their
    # signatures are compared in blocks of bounded size, and full sets where those agree.
    open_ = scratch.cut(_open(buckets, roots), "open")
    scratch.drop(buckets)
    more = scratch.cut(_linked_in_blocks(open_, sets, rows * bands, percent), "links")
    for used in (sets, open_):
        scratch.drop(used)
    if not more.isEmpty():
        roots = scratch.cut(components(_stars(roots).union(more), scratch), "roots")

    own = sigs.where("fp is not null").groupBy("fp").agg(F.min("doc").alias("least"))
    joined = own.join(roots.select(F.col("node").alias("fp"), "root"), "fp")
    named = joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    by_class = own.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    linked = sigs.where("fp is not null").join(by_class, "fp").select("doc", "n", "component_id")
    out = linked.unionByName(sigs.where("fp is null").select("doc", "n", F.col("doc").alias("component_id")))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, all columns as they were; texts without
    words all stay. Where ids are null or repeated, rows are numbered and told apart by that."""
    scratch = Scratch(docs.sparkSession, "keep-one")
    found = scratch.cut(near_duplicates(docs, words, percent, id_col=id_col, text_col=text_col), "near")
    c = found.agg(F.count(F.lit(1)).alias("n"), F.count(id_col).alias("ids"), F.count_distinct(id_col).alias("distinct")).first()
    if c["n"] == c["ids"] == c["distinct"]:
        return docs.join(found.where("kept").select(F.col(id_col).cast(docs.schema[id_col].dataType).alias(id_col)), id_col, "left_semi").select(*docs.columns)
    numbered = scratch.cut(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered, words, percent, id_col="__row", text_col=text_col)
    return numbered.join(found.where("kept").select("__row"), "__row", "left_semi").select(*docs.columns)
