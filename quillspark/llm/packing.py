"""Best-fit-decreasing packing of token sequences (operator 4).

Pieces of one length are interchangeable, so the whole packing follows from how many
pieces each length has: at most `capacity` numbers, whatever the corpus size. The plan
is made from that histogram. A segment tree over remaining capacities says which is the
tightest that still has an open sequence and fits, in logarithmic time; equal pieces
that would meet equal sequences one after another are placed as one run. Each piece
then finds its place from its length and its rank among the pieces of that length.

Defined results: a null or empty text is the single end id; only documents longer than
`capacity` are cut, into full pieces and a rest; ties among equal lengths are broken by
the order of the pieces table; the text of a special token is that token's id, as the
tokenizer has it by default; repeated rows are packed each on their own; columns other
than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty, worker_state

CAPACITY = 4096
END_ID = 1
#: Distinct words and parts of words remembered by a worker; a full memo starts anew.
MEMO = 600_000
#: Texts tokenized together.
TEXTS = 500

#: Words of letters and signs below U+0100, without apostrophes or other white space, fall apart as here.
_PLAIN = re.compile(r"[!-&(-~\xA1-\xFF]+").fullmatch
_ONE = re.compile(r"[a-z\xDF-\xF6\xF8-\xFF]+|[0-9]").fullmatch
_PARTS = re.compile(r"[A-Za-z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-\xFF]+|[0-9\xB2\xB3\xB9\xBC-\xBE]|[^A-Za-z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-\xFF0-9\xB2\xB3\xB9\xBC-\xBE]+")


class CapacityTree:
    """Counts of open sequences by remaining capacity; tightest(n) is the least capacity
    of at least n that has one."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, least: int) -> int | None:
        i = least + self.size
        if self.count[i]:
            return least
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first rank, first sequence, pieces in each sequence, offset of the
    first), ordered by length and rank. A run starts at its rank and ends at the next."""
    tree = CapacityTree(capacity)
    spans: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> (first sequence, how many)
    runs, opened = [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            spans.setdefault(left, []).append((first, n))
            tree.add(left, n)

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                each = room // length
                first, n = opened, -(-todo // each)
                opened += n
            else:
                first, n = spans[room].pop()
                tree.add(room, -n)
                each = room // length
                if (need := -(-todo // each)) < n:
                    put(room, first + need, n - need)
                    n = need
            runs.append((length, rank, first, each, capacity - room))
            placed = min(todo, n * each)
            full, rest = divmod(placed, each)
            put(room - each * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            rank += placed
            todo -= placed
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


class WordTokenizer:
    """Ids of texts by a tokenizers file whose pre-tokens are words, single digits and runs
    of other signs, white space parting them. Words are remembered; new pre-tokens are
    encoded many at a time, told apart by the mark on each one's last token. What is not
    sure to part this way is encoded by itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Special tokens' own texts stand for their ids; a text that holds one is encoded as a whole.
        self.special = [getattr(t, "content", str(t)) for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: list[str]) -> None:
        known, split, new = self.words, [], {}
        for w in words:
            if w.isascii() and w.isalpha() and w.islower():
                new[w] = None
                continue
            # other scripts' letters and marks, and apostrophes, may join or change; those words stay whole
            parts = _PARTS.findall(w) if _PLAIN(w) else [w]
            if len(parts) > 1:
                split.append((w, parts))
                new.update(dict.fromkeys(filterfalse(known.__contains__, parts)))
            elif _ONE(w):
                new[w] = None
            else:
                known[w] = self._encode(w).tobytes()
        todo = list(new)
        for k in range(0, len(todo), 1000):
            some = todo[k : k + 1000]
            ids = self._encode(" ".join(some))
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) == len(some) and stops[-1] == len(ids):
                raw, at = ids.tobytes(), 0
                for p, stop in zip(some, stops):
                    known[p] = raw[4 * at : 4 * stop]
                    at = stop
            else:
                for p in some:
                    known[p] = self._encode(p).tobytes()
        for w, parts in split:
            known[w] = b"".join([known[p] for p in parts])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit numbers."""
        if len(self.words) >= MEMO:
            self.words.clear()
        cut, new, known, whole = [], {}, self.words, {}
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                whole[i] = self._encode(text).tobytes()
                cut.append([])
                continue
            try:
                text.encode("latin-1")
                text = text.lower()  # for these letters the same as the tokenizer's own lowering
            except UnicodeEncodeError:
                pass
            parts = text.replace("\n", " ").split(" ")
            cut.append(parts)
            new.update(dict.fromkeys(filterfalse(known.__contains__, parts)))
        if new:
            self._learn(list(new))
        return [whole[i] if i in whole else b"".join(map(known.__getitem__, parts)) for i, parts in enumerate(cut)]


def word_tokenizer(path: str) -> WordTokenizer:
    """A worker's tokenizer, kept from task to task."""
    return worker_state(("words", path), lambda: WordTokenizer(path))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, chunk, nth): nth numbers the pieces of one
    length within the task `chunk` that made them. Write it before using it twice."""

    def run(batches):
        words, seen, chunk = word_tokenizer(tokenizer), {}, TaskContext.get().partitionId()
        last = int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows, ids_of = [], []
            for k in range(0, batch.num_rows, TEXTS):
                ids_of += words.encode_batch(batch.column(1).slice(k, TEXTS).to_pylist())
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of):
                ids += last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    nth = seen[n] = seen.get(n, -1) + 1
                    rows.append((doc, k, at // 4, n, zlib.crc32(part), chunk, nth))
            names = [id_col, "piece", "start", "length", "ids_crc32", "chunk", "nth"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 7, kinds)], names=names)

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), text_or_empty(text_col).alias("text")).mapInArrow(run, f"`{id_col}` bigint, piece int, start bigint, length bigint, ids_crc32 bigint, chunk int, nth bigint")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    spark = docs.sparkSession
    made = Scratch(spark, "packing").cut(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    counts = made.groupBy("chunk", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `capacity` rows at most
    runs = plan(histogram, capacity)
    key = runs[:, 0] << 44 | runs[:, 1] if len(runs) else np.zeros(0, np.int64)
    shared = spark.sparkContext.broadcast((key, runs))  # bounded by the capacity, not by the corpus

    def place(batches):
        key, runs = shared.value
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            run = runs[np.searchsorted(key, length << 44 | rank, "right") - 1]
            k = rank - run[:, 1]
            sequence, offset = run[:, 2] + k // run[:, 3], run[:, 4] + k % run[:, 3] * length
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    ranked = made.join(firsts.drop("n"), ["chunk", "length"]).select(id_col, "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, f"`{id_col}` bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
