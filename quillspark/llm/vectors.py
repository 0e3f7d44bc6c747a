"""Embedding near-dedup by spherical k-means cells (operator 7).

Centroids are learned from a bounded sample and kept at unit length. Each vector has a
home cell, the one of nearest centroid. A label's vectors, in the order of their cells, fall
into blocks of bounded size. A vector meets every block that holds a cell it may have a
link to: a vector at home with centroid d is at least (x.c - x.d) / |c - d| away from an x at
home with c, as the plane between c and d parts them. The bound is exact, so no link is
lost whatever the number of cells; vectors without clusters meet all of their label. A pair
of blocks is compared by one matrix product. Equal vectors are one class throughout. A
block pair returns how many vectors each one is linked to, and a spanning forest of its
links, so a large group never leaves pair by pair.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and those without a label, have no links and are their own component; vectors
link with those of their own length only, and those of other lengths than the commonest
form one cell for each label and length; equal cosines need no tie rule; repeated rows with one id count as copies of
one another; columns other than id, vector and label are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .graph import components

#: Vectors the centroids are learned from, at most; vectors a cell should hold; centroids at most.
SAMPLE, CELL, CELLS = 20_000, 1000, 1024
#: Vectors in a block, and rows of a product at once.
BLOCK, ROWS = 4096, 1024


def usable(vec: Column) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & ~bad & F.exists(vec, lambda x: x != 0)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at unit length, scaled first so that no square overflows or vanishes."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means: assign by cosine, recentre, bring back to unit length."""
    rng = np.random.RandomState(seed)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        at = np.concatenate([(sample[i : i + 2048] @ c.T).argmax(axis=1) for i in range(0, len(sample), 2048)])
        total = np.zeros_like(c)
        np.add.at(total, at, sample)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def in_chain(center: np.ndarray) -> np.ndarray:
    """The centroids, each followed by the nearest of those left, so that blocks hold neighbours."""
    near = center @ center.T
    order, left = [0], np.ones(len(center), bool)
    left[0] = False
    while left.any():
        order.append(int(np.where(left, near[order[-1]], -np.inf).argmax()))
        left[order[-1]] = False
    return center[order]


def reachable(x: np.ndarray, center: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Each unit vector's home, and the cells whose vectors may have a cosine of `threshold` with it."""
    near = x @ center.T
    home = near.argmax(axis=1)
    sq = (center * center).sum(axis=1)
    apart = np.sqrt(np.maximum(0.0, sq[:, None] + sq[None] - 2 * center @ center.T))
    far = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    return home, near.max(axis=1, keepdims=True) - near <= far * apart[home] + 1e-6


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges (a, b) among n nodes thinned to one from each node to the least of its component."""
    root = np.arange(n)
    while len(a):
        u, v = root[a], root[b]
        apart = u != v
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
    at = np.flatnonzero(root != np.arange(n))
    return list(zip(at.tolist(), root[at].tolist()))


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept), one row per vector."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "vectors")
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), vec.alias("v"), F.col(label_col).cast("string").alias("label"))
    good = usable(F.col("v")) & F.col("label").isNotNull()
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    # the dtype-independent text of the vector names its class within the label
    rows = rows.withColumn("cls", F.when(F.col("good"), F.sha2(F.concat_ws("|", "label", F.array_join(F.transform("v", lambda x: (x + 0.0).cast("string")), ",")).cast("binary"), 256)))
    rows = scratch.cut(rows, "rows")
    classes = rows.where("good").groupBy("cls").agg(F.first("v").alias("v"), F.first("label").alias("label"), F.count(F.lit(1)).alias("copies"))
    classes = scratch.cut(classes, "classes")
    n = classes.count()
    if n:
        found = _linked(spark, scratch, classes, n, threshold)
        counts, edges = (scratch.cut(x, "found") for x in (found.where("other is null").groupBy("cls").agg(F.sum("links").alias("links")), found.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")).distinct()))
        roots = components(edges, scratch)
        least = rows.where("good").groupBy("cls").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
        full = least.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").join(counts, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        named = full.join(full.groupBy("root").agg(F.min("least").alias("component_id")), "root")
        named = named.select("cls", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        linked = rows.where("good").join(named, "cls").select("id", "n_links", "component_id")
    else:
        linked = spark.createDataFrame([], "id bigint, n_links bigint, component_id bigint")
    out = linked.unionByName(rows.where("not good").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("bigint").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _linked(spark, scratch: Scratch, classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(cls, other, links): counts of links with other null, and forest edges with links null."""
    sizes = classes.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim = sizes[0]["dim"]
    picked = classes.where(F.size("v") == dim).orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).select("v").toPandas()
    sample = unit(np.array(picked["v"].tolist(), float))
    center = in_chain(centroids(sample, max(1, min(CELLS, n // CELL))))

    def place(frames):
        for pdf in frames:
            if len(pdf):
                for n, some in pdf.groupby(pdf["v"].map(len)):
                    x = unit(np.array(some["v"].tolist(), float))
                    usual = n == dim
                    cell = (x @ center.T).argmax(axis=1) if usual else np.zeros(len(x))
                    yield pd.DataFrame({"label": some["label"] if usual else f"{n}|" + some["label"], "cell": cell.astype("int32"), "cls": some["cls"], "u": list(x), "copies": some["copies"]})

    # a label is led by 0 for the commonest length, which no vector has, else by its own
    classes = classes.withColumn("label", F.when(F.size("v") == dim, F.concat(F.lit("0|"), "label")).otherwise(F.col("label")))
    placed = classes.mapInPandas(place, "label string, cell int, cls string, u array<double>, copies bigint")
    placed = scratch.cut(placed, "placed")
    # Blocks: a label's cells in order, cut every BLOCK rows; a cell across a cut is dealt by hash.
    size = placed.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("n"))
    until = F.sum("n").over(Window.partitionBy("label").orderBy("cell"))
    size = size.withColumn("until", until).select("label", "cell", F.floor((F.col("until") - F.col("n")) / BLOCK).cast("int").alias("first"), F.floor((F.col("until") - 1) / BLOCK).cast("int").alias("last"))
    size = scratch.cut(size, "cells")
    ranges = size.select("label", "cell", F.explode(F.sequence("first", "last")).alias("block")).groupBy("label", "block").agg(F.min("cell").alias("lo"), F.max("cell").alias("hi"))
    # one row a label, and a pair of numbers for every BLOCK rows in all
    ranges = ranges.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("block", "lo", "hi"))).alias("r")).select("label", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))
    own = F.col("first") + F.pmod(F.xxhash64("cls"), F.col("last") - F.col("first") + 1).cast("int")
    dealt = placed.join(size, ["label", "cell"]).withColumn("own", own).join(ranges, "label").select("label", "own", "lo", "hi", "cls", "u", "copies")

    def meet(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            may = np.ones((len(pdf), len(center)), bool)  # a vector of another length meets all blocks of its own
            usual = np.flatnonzero(pdf["u"].map(len) == dim)
            if len(usual):
                _, may[usual] = reachable(np.array(pdf["u"].iloc[usual].tolist()), center, threshold)
            upto = np.concatenate([np.zeros((len(pdf), 1), np.int64), may.cumsum(axis=1)], axis=1)
            to = [np.flatnonzero(c[h + 1] - c[l] > 0).tolist() for c, l, h in zip(upto, pdf["lo"], pdf["hi"])]
            yield pd.DataFrame({"label": pdf["label"], "own": pdf["own"], "to": [sorted({o, *t}) for o, t in zip(pdf["own"].tolist(), to)], "cls": pdf["cls"], "u": pdf["u"], "copies": pdf["copies"]})

    sent = dealt.mapInPandas(meet, "label string, own int, to array<int>, cls string, u array<double>, copies bigint")
    sent = sent.select("label", "own", F.explode("to").alias("to"), "cls", "u", "copies")
    # Two blocks meet once, the lesser at the left; a block meets itself.
    tasks = sent.select("label", F.least("own", "to").alias("i"), F.greatest("own", "to").alias("j"), "own", "cls", "u", "copies")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        alone = key[1] == key[2]
        a, b = (pdf, pdf) if alone else (pdf[pdf["own"] == key[1]], pdf[pdf["own"] == key[2]])
        ka, kb = a["cls"].to_numpy(), b["cls"].to_numpy()
        none = pd.DataFrame({"cls": pd.Series([], dtype=str), "other": pd.Series([], dtype=str), "links": pd.Series([], dtype="int64")})
        if not len(ka) or not len(kb):
            return none
        xa, xb = np.array(a["u"].tolist()), np.array(b["u"].tolist())
        parts: list[tuple[int, int]] = []
        ca, cb = a["copies"].to_numpy(), b["copies"].to_numpy()
        na, nb = np.zeros(len(ka), "int64"), np.zeros(len(kb), "int64")
        for s in range(0, len(ka), ROWS):
            r, c = np.nonzero(xa[s : s + ROWS] @ xb.T >= threshold)
            r += s
            if alone:
                r, c = r[r != c], c[r != c]
            na += np.bincount(r, cb[c], len(ka)).astype("int64")
            if not alone:
                nb += np.bincount(c, ca[r], len(kb)).astype("int64")
            parts += _forest(r, c + (0 if alone else len(ka)), len(ka) + len(kb))
        if not parts:
            return none
        names = ka if alone else np.concatenate([ka, kb])
        f = _forest(*np.array(parts).T, len(ka) + len(kb))
        return pd.DataFrame(
            {
                "cls": [*ka[na > 0], *kb[nb > 0], *[names[x] for x, _ in f]],
                "other": [None] * int((na > 0).sum() + (nb > 0).sum()) + [names[y] for _, y in f],
                "links": [*na[na > 0], *nb[nb > 0], *[0] * len(f)],
            }
        )

    return scratch.cut(tasks.groupBy("label", "i", "j").applyInPandas(compare, "cls string, other string, links bigint"), "blocks")
