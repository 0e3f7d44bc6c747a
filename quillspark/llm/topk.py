"""Exact top-k search by inner product (operator 10).

Components become integers. Candidates lie in blocks, and each block gets an
impact-ordered index: a posting segment holds the candidates that have one quantised
impact (a power of `BASE`) in one dimension, with their components. Segments are processed
score at a time in descending impact for a block of queries together: a segment adds to
the scores of its own candidates only, zeros have no postings. After each impact the rest
of a candidate's score is bounded by the product of the query's length and the length of
what the candidate has left in segments to come. A query stops once few candidates can
still be among its k best by that proof; those are rescored exactly, and so are the
possible members of queries that came to the end.

Candidates are moved once, to their block; the stated queries are copied to each block of
candidates and stream by it, so a task holds one block and a few queries.

Defined results: vectors that are null or empty or hold null or non-finite components
take no part, nor do rows without an id; vectors of unequal length are padded with
zeros; ties go to the smaller id; a query is never its own candidate; repeated rows are
candidates each; a score beyond 64 bits is an error; columns other than id and vector are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidates in a block at most, and numbers in it; queries that meet an index at once; candidates in an index.
BLOCK, NUMBERS, QUERIES, INDEX = 1 << 15, 1 << 22, 256, 4096
#: A segment's impacts are within this factor of each other.
BASE = 1.5
#: A query stops when at most this share of the candidates is possible; possible members rescored at once.
SHARE, RESCORED = 0.02, 1 << 14
#: What sums of 32-bit floats may be off by, in shares of the lengths' product, for each of their terms.
SLACK = 1.2e-7


class Index:
    """Posting segments of a block of candidates, by descending quantised impact."""

    def __init__(self, x: np.ndarray):
        self.x = x
        size = np.abs(x)
        c, j = np.nonzero(x)
        level = np.floor(np.log(size[c, j].astype(float)) / np.log(BASE)).astype(np.int64)
        order = np.lexsort((c, j, -level))
        c, j, level = c[order], j[order], level[order]
        cut = np.flatnonzero((np.diff(level) != 0) | (np.diff(j) != 0)) + 1
        starts = np.concatenate([[0], cut]) if len(c) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(c))
        values = x[c, j]
        #: impact -> segments (dimension, candidates, components)
        self.segments: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        #: impact -> length of what each candidate has in lesser impacts
        self.left: dict[int, np.ndarray] = {}
        rest = (x.astype(float) ** 2).sum(axis=1)
        self.length = np.sqrt(rest)
        self.postings: dict[int, int] = {}
        for s, e in zip(starts, ends):
            self.segments.setdefault(int(level[s]), []).append((int(j[s]), c[s:e], values[s:e].astype(np.float32)[:, None]))
        for impact, some in self.segments.items():  # inserted in descending order
            for _, cs, v in some:
                rest[cs] -= v[:, 0].astype(float) ** 2  # a segment has each candidate once
            self.left[impact] = np.sqrt(np.maximum(rest, 0.0))
            self.postings[impact] = sum(len(cs) for _, cs, _ in some)


def best_of_index(q: np.ndarray, qid: np.ndarray, index: Index, xid: np.ndarray, k: int, said: dict | None = None) -> list[tuple[np.ndarray, np.ndarray, list]]:
    """(query rows, candidate rows, scores), in parts, of the k best of each query.
    said: gets the numbers of postings processed and in all, for each query together."""
    nq, nx = len(q), len(xid)
    qlen = np.sqrt((q.astype(float) ** 2).sum(axis=1))
    slack = SLACK * (q.shape[1] + 10) * index.length
    own = qid[:, None] == xid[None, :]
    partial = np.zeros((nx, nq), np.float32)  # a segment's candidates are rows
    active = np.arange(nq)
    possible: list[tuple[np.ndarray, np.ndarray]] = []
    done, total = 0, sum(index.postings.values())
    impacts = list(index.segments)
    # a proof is tried where what is left has become a fifth smaller since the last one
    last = float(np.sqrt((index.length**2).mean())) if nx else 0.0
    for n, impact in enumerate(impacts):
        qt = np.ascontiguousarray(q[active].T, dtype=np.float32)
        for j, cs, v in index.segments[impact]:
            some = partial.take(cs, axis=0)
            some += v * qt[j]
            partial[cs] = some
        done += index.postings[impact] * len(active)
        left, end = index.left[impact], n == len(impacts) - 1
        now = float(np.sqrt((left**2).mean()))
        if not end and (nx <= k or now > 0.8 * last):
            continue
        last = now
        s = partial.T
        bound = qlen[active][:, None] * ((0.0 if end else left * (1 + 1e-6)) + slack)[None, :]
        may = _possible(s, bound, own[active], k)
        stop = np.ones(len(active), bool) if end else may.sum(axis=1) <= max(4 * k, SHARE * nx)
        if stop.any():
            r, c = np.nonzero(may[stop])
            possible.append((active[stop][r], c))
            active = active[~stop]
            if not len(active):
                break
            partial = np.ascontiguousarray(partial[:, ~stop])
    if not impacts:  # no component but zeros
        possible.append(np.nonzero(~own))
    if said is not None:
        said["done"] = said.get("done", 0) + done
        said["all"] = said.get("all", 0) + total * nq
    return [part for r, c in possible for part in _rescored(q, index.x, r, c, xid, k)]


def _possible(s: np.ndarray, bound: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Whether a candidate may be among a query's k best: its score may reach the k-th best that is proven."""
    if s.shape[1] <= k:
        return ~own
    proven = np.where(own, -np.inf, s - bound)
    floor = np.partition(proven, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    return (s + bound >= floor[:, None]) & ~own


def _rescored(q: np.ndarray, x: np.ndarray, r: np.ndarray, c: np.ndarray, xid: np.ndarray, k: int):
    """The k best of each query among its possible members, by exact scores; some queries at a time."""
    wide = max(int(np.abs(q).max(initial=0)), 1) * max(int(np.abs(x).max(initial=0)), 1) * max(1, x.shape[1]) >= 2**62
    order = np.argsort(r, kind="stable")
    r, c = r[order], c[order]
    step = max(1, RESCORED * 64 // max(1, x.shape[1]))
    score = np.empty(len(r), object if wide else np.int64)
    for i in range(0, len(r), step):
        a, b = q[r[i : i + step]], x[c[i : i + step]]
        score[i : i + step] = (a.astype(object) * b).sum(axis=1) if wide else np.einsum("ij,ij->i", a, b)
    by = np.lexsort((xid[c], -score, r)) if not wide else np.array(sorted(range(len(r)), key=lambda i: (r[i], -score[i], xid[c[i]])), np.int64)
    r, c, score = r[by], c[by], score[by]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    if keep.any():
        yield r[keep], c[keep], [int(y) for y in score[keep]]


def _matrix(rows: pa.ListArray | list, width: int) -> np.ndarray:
    m = np.zeros((len(rows), width), np.int64)
    for i, v in enumerate(rows):
        v = np.asarray(v, np.int64)
        m[i, : len(v)] = v
    return m


def _met(batches, k: int):
    """Blocks of a partition, one after another: candidates first, then the queries that stream by."""
    names = ["query_id", "vec_id", "score"]
    block, ids, vectors, indexes = None, [], [], None

    def build():
        width = max(map(len, vectors))
        step = max(1, min(INDEX, NUMBERS // width))
        out = [(Index(_matrix(vectors[i : i + step], width)), np.array(ids[i : i + step], np.int64)) for i in range(0, len(ids), step)]
        ids.clear()
        vectors.clear()
        return out

    for batch in batches:
        xb, side, vid, vec = (batch.column(i) for i in range(4))
        xb, side, vid = (a.to_numpy(zero_copy_only=False) for a in (xb, side, vid))
        edges = np.flatnonzero((np.diff(xb) != 0) | (np.diff(side) != 0)) + 1
        for s, e in zip([0, *edges], [*edges, len(xb)]):
            if s == e:
                continue
            if xb[s] != block:
                block, indexes = xb[s], None
                ids.clear()
                vectors.clear()
            if side[s] == 0:
                ids += vid[s:e].tolist()
                vectors += [np.array(v.as_py(), np.int64) for v in vec[s:e]]
                continue
            if indexes is None:
                indexes = build() if ids else []
            for a in range(s, e, QUERIES):
                b = min(e, a + QUERIES)
                rows, qid = [v.as_py() for v in vec[a:b]], vid[a:b].astype(np.int64)
                for index, xid in indexes:
                    width = max(index.x.shape[1], max(map(len, rows)))
                    q = _matrix(rows, width)[:, : index.x.shape[1]]  # beyond it candidates are zero
                    for r, c, score in best_of_index(q, qid, index, xid, k):
                        yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(xid[c]), pa.array(score, pa.int64())], names=names)


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query row's k best candidates."""
    spark = vectors.sparkSession
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"), is_query.alias("q")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(~bad)
    rows = rows.select("id", "q", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    # as many candidates in a block as memory allows, but enough blocks for all cores
    most = max(1, min(BLOCK, NUMBERS // int(size["width"] or 1)))
    nx = max(-(-int(size["n"]) // most), min(2 * spark.sparkContext.defaultParallelism, -(-int(size["n"]) // 1024)), 1)
    # rows of one id and rows that are alike are dealt to all blocks
    xs = rows.select(F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(nx)).cast("int").alias("xb"), F.lit(0).alias("side"), "id", "v")
    qs = rows.where("q").select(F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("xb"), F.lit(1).alias("side"), "id", "v")
    met = xs.unionByName(qs).repartitionById(nx, F.col("xb")).sortWithinPartitions("xb", "side")
    found = met.mapInArrow(lambda batches: _met(batches, k), "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
