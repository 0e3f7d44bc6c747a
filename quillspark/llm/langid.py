"""Language identification by rank-order profiles (operator 5).

A language's profile is its most frequent letter n-grams (one to three letters, word
edges marked) in order, counted over every training document. A document's own most
frequent n-grams are compared with each profile by out-of-place distance: the sum of
rank differences, n-grams absent from a profile counting as its full length.

Defined results: a text that is null, empty or without letters is `und` with score 0;
ties go to the language first in order; equal counts rank by n-gram; whole texts are
counted, however long a word is; repeated rows count and are predicted each; columns other
than id, text and language are ignored, whatever their names. Without any training row
every text is `und`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_rows, text_or_empty, worker_state

#: N-grams in a language's profile, and in a document's.
PROFILE, TOP = 500, 300
#: A text further than this from every profile is in no language that is known.
LEAST = 0.25
#: Code points scanned at once, which bounds a worker's memory; and distinct n-grams summed before they are merged.
STRETCH, MERGE = 1 << 16, 1 << 18

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether a code point is a letter, for all code points."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of some counts, and their sums."""
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)


def grams(text: str, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, each packed into 64 bits, and their counts. A stretch counts the
    n-grams that end in it; the last two places are carried on, so no cut is seen."""
    low, parts, size = text.lower(), [], 0
    carry, was = np.array([32], np.int64), False
    for i in range(0, len(low), stretch):
        codes = np.frombuffer(low[i : i + stretch].encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters()[codes]
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        keep[0] |= was
        was = bool(is_letter[-1])
        new = np.where(is_letter, codes, 32).astype(np.int64)[keep]
        if i + stretch >= len(low):
            new = np.append(new, 32)
        seq = np.concatenate([carry, new])
        two = seq[:-1] << 21 | seq[1:]
        three = two[:-1] << 21 | seq[2:]
        three = three[seq[1:-1] != 32]  # no n-gram reaches over a word's edge
        two = two[len(carry) - 1 :]
        carry = seq[-2:]
        parts.append(np.unique(np.concatenate([new[new != 32], two[two != (32 << 21 | 32)], three]), return_counts=True))
        size += len(parts[-1][0])
        if size > MERGE:
            parts = [summed(parts)]
            size = len(parts[0][0])
    return summed(parts)


def count_grams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, n): summed within each task before anything is shuffled."""

    def run(batches):
        worker_state("languages")
        sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting: dict[str, list[str]] = {}
        chars: dict[str, int] = {}

        def count(lang):
            sums.setdefault(lang, []).append(grams(" ".join(waiting.pop(lang))))
            chars[lang] = 0
            if sum(len(k) for k, _ in sums[lang]) > MERGE:
                sums[lang] = [summed(sums[lang])]

        def out():
            for lang, parts in sums.items():
                k, n = summed(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])
            sums.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang, text = lang.as_py(), text.as_py()
                waiting.setdefault(lang, []).append(text)
                chars[lang] = chars.get(lang, 0) + len(text)
                if chars[lang] >= STRETCH:
                    count(lang)
            if sum(len(k) for parts in sums.values() for k, _ in parts) > 8 * MERGE:
                yield from out()
        for lang in list(waiting):
            count(lang)
        yield from out()

    parts = docs.select(F.col(lang_col).cast("string"), text_or_empty(text_col)).mapInArrow(run, "lang string, gram bigint, n bigint")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, the sorted union of their profiles' n-grams, and each one's rank by
    language (`size` if absent). `size` n-grams a language reach the driver."""
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = count_grams(docs.where(F.col(lang_col).isNotNull()), text_col, lang_col).withColumn("r", F.row_number().over(best)).where(F.col("r") <= size).collect()
    langs = sorted({r["lang"] for r in rows})
    keys = np.unique(np.array([r["gram"] for r in rows], np.int64))
    ranks = np.full((len(langs), len(keys) + 1), size, np.int32)
    for r in rows:
        ranks[langs.index(r["lang"]), np.searchsorted(keys, r["gram"])] = r["r"] - 1
    return langs, keys, ranks


def rank_text(text: str, langs: list[str], keys: np.ndarray, ranks: np.ndarray, top: int, size: int) -> tuple[str, float]:
    own, n = grams(text)
    if not len(own) or not langs:
        return "und", 0.0
    if len(own) > top:  # all that may be among the first, then in order
        least = np.partition(n, len(n) - top)[len(n) - top]
        own, n = own[n >= least], n[n >= least]
    own = own[np.lexsort((own, -n))[:top]]
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    at = np.where(keys[at] == own, at, len(keys))
    found = ranks[:, at]
    far = np.where(found < size, np.minimum(np.abs(found - np.arange(len(own))), size), size).sum(axis=1)
    best = int(far.argmin())
    return langs[best], float(1 - far[best] / (size * len(own)))


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", carry: list[Column] | None = None, top: int = TOP, size: int = PROFILE) -> DataFrame:
    """(id, lang_pred, score) per document, with the columns in `carry`."""
    langs, keys, ranks = model
    carry = carry or []
    shape = docs.select(F.col(id_col).cast("bigint").alias(id_col), text_or_empty(text_col).alias("__text"), *carry)
    kept = [f for f in shape.schema.fields if f.name != "__text"]

    def run(batches):
        for batch in batches:
            got = [rank_text(t.as_py(), langs, keys, ranks, top, size) for t in batch.column("__text")]
            cols = [batch.column(f.name) for f in kept] + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in kept] + ["lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return shape.mapInArrow(run, f"{fields}, lang_pred string, score double")


def keep_known(docs: DataFrame, model, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The rows in a known language; all rows where no language is known at all."""
    langs, keys, ranks = model
    if not langs:
        return docs

    def make():
        worker_state("languages")

        def decide(text: str) -> bool:
            lang, score = rank_text(text, langs, keys, ranks, TOP, PROFILE)
            return lang != "und" and score >= least

        return decide

    return keep_rows(docs, make, text_col)
