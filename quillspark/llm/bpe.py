"""Byte-level BPE encoding and decoding (operator 6).

The merge loop keeps candidate pairs in one bucket per merge rank. A three-level
bitmap tells which buckets are non-empty, so the next rank comes from three
find-first-set steps whatever the pre-token's length; a bucket is a heap of
linked-list positions, which keeps equal ranks leftmost first; entries whose pair
has changed meanwhile are stale and are skipped when popped.

Defined results: a null or empty text has no tokens and decodes to no bytes; texts
of any length are encoded whole; repeated rows are encoded alike; columns other
than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Distinct pre-tokens, and runs of them, remembered by a worker; a full memo starts anew.
MEMO = 500_000
#: Pre-tokens of more bytes than this are merged by themselves.
LONG = 256
#: Texts encoded together.
TEXTS = 500

_RARE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]").search


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankQueue:
    """Ranks with waiting positions; pop() gives the leftmost position of the least rank."""

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, at)
            return
        self.buckets[rank] = [at]
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        word = self.mid[b]
        a = b << 6 | (word & -word).bit_length() - 1
        word = self.low[a]
        rank = a << 6 | (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        at = heappop(bucket)
        if not bucket:
            self.low[a] &= self.low[a] - 1
            if not self.low[a]:
                self.mid[b] &= self.mid[b] - 1
                if not self.mid[b]:
                    self.top &= self.top - 1
        return rank, at


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here
    prev = list(range(-1, n - 1))
    queue = RankQueue()
    pair = [-1] * n  # the rank under which this start now waits
    get = ranks.get

    def offer(i: int) -> None:
        j = end[i]
        r = get(piece[i : end[j]], -1) if j < n else -1
        pair[i] = r
        if r >= 0:
            queue.push(r, i)

    for i in range(n - 1):
        offer(i)
    while (got := queue.pop()) is not None:
        rank, i = got
        if pair[i] != rank:
            continue
        j = end[i]
        end[i] = end[j]
        pair[j] = -1
        if end[i] < n:
            prev[end[i]] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def merge_many(pieces: list[bytes], pairs: dict[int, int], singles: list[int]) -> list[list[int]]:
    """Ids of many pre-tokens at once: one linked list with a barrier after each, so that a
    bucket holds the positions of all of them. From one pre-token only the leftmost position
    of a bucket is merged before the next rank is looked for; the others wait in the bucket."""
    buf = b"".join(pieces)
    n = len(buf)
    tok = [singles[c] for c in buf]
    tok.append(-1)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    owner: list[int] = []
    at = 0
    for w, piece in enumerate(pieces):
        owner += [w] * len(piece)
        if piece:
            prv[at] = n
            nxt[at + len(piece) - 1] = n
        at += len(piece)
    nxt.append(n)
    prv.append(n)
    pair = [-1] * (n + 1)
    buckets: dict[int, list[int]] = {}
    low, mid, top = [0] * 1024, [0] * 16, 0
    get = pairs.get
    for i in range(n):
        r = get(tok[i] << 20 | tok[nxt[i]], -1) if nxt[i] < n else -1
        if r >= 0:
            pair[i] = r
            if r in buckets:
                buckets[r].append(i)
            else:
                buckets[r] = [i]
                low[r >> 6] |= 1 << (r & 63)
    for a, word in enumerate(low):
        if word:
            mid[a >> 6] |= 1 << (a & 63)
            top |= 1 << (a >> 6)
    while top:
        b = (top & -top).bit_length() - 1
        a = b << 6 | (mid[b] & -mid[b]).bit_length() - 1
        rank = a << 6 | (low[a] & -low[a]).bit_length() - 1
        bucket = buckets.pop(rank)
        low[a] &= low[a] - 1
        if not low[a]:
            mid[b] &= mid[b] - 1
            if not mid[b]:
                top &= top - 1
        if len(bucket) > 1:
            bucket.sort()
        last, new = -1, []
        for i in bucket:
            if pair[i] != rank:
                continue
            if owner[i] == last:
                new.append((rank, i))
                continue
            last = owner[i]
            j = nxt[i]
            k = nxt[j]
            tok[i] = rank
            tok[j] = pair[j] = -1
            nxt[i] = k
            prv[k] = i
            pair[i] = -1
            if k < n:
                r = get(rank << 20 | tok[k], -1)
                if r >= 0:
                    pair[i] = r
                    new.append((r, i))
            h = prv[i]
            if h < n:
                pair[h] = r = get(tok[h] << 20 | rank, -1)
                if r >= 0:
                    new.append((r, h))
        for r, i in new:
            if r in buckets:
                buckets[r].append(i)
            else:
                buckets[r] = [i]
                a = r >> 6
                low[a] |= 1 << (r & 63)
                mid[a >> 6] |= 1 << (a & 63)
                top |= 1 << (a >> 6)
    out: list[list[int]] = [[] for _ in pieces]
    for t, w in zip(tok, owner):
        if t >= 0:
            out[w].append(t)
    return out


class ByteBPE:
    """Encoder and decoder for one rank file (of at most 65,536 ranks) and one pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, r in self.ranks.items():
            self.bytes[r] = token
        self.decimal = [str(i) for i in range(len(self.bytes))]
        self.singles = [self.ranks[bytes([c])] for c in range(256)]
        self.pairs = {}
        for token, r in self.ranks.items():
            for k in range(1, len(token)):
                x, y = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if x is not None and y is not None:
                    self.pairs[x << 20 | y] = r
        self.find = regex.compile(pattern).findall
        self.tokens: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _learn(self, parts: list[str]) -> None:
        """Encodes parts not met before: their new pre-tokens together, by the queue."""
        if len(self.tokens) >= MEMO:
            self.tokens.clear()
        split = [self.find(p) for p in parts]
        todo: list[str] = []
        tokens = self.tokens
        for pre in split:
            for t in pre:
                if t not in tokens:
                    b = t.encode("utf-8")
                    if (whole := self.ranks.get(b)) is not None:
                        tokens[t] = whole.to_bytes(2, "little")
                    elif len(b) > LONG:
                        tokens[t] = array("H", merge(b, self.ranks)).tobytes()
                    else:
                        tokens[t] = b""
                        todo.append(t)
        for k in range(0, len(todo), 20_000):
            some = todo[k : k + 20_000]
            for t, ids in zip(some, merge_many([t.encode("utf-8") for t in some], self.pairs, self.singles)):
                tokens[t] = array("H", ids).tobytes()
        for p, pre in zip(parts, split):
            self.parts[p] = tokens[pre[0]] if len(pre) == 1 else b"".join([tokens[t] for t in pre])

    def encode_batch(self, texts: list[str]) -> list[array]:
        """A text is cut before each space that stands alone between visible characters;
        the pattern never matches across such a cut, so the parts can be encoded one by one
        and remembered. Any other text goes to the pattern whole."""
        if len(self.parts) >= MEMO:
            self.parts.clear()
        cut, new = [], {}
        known = self.parts
        for text in texts:
            if " " in text and not ("  " in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or _RARE(text)):
                parts = text.split(" ")
                first = parts[0]
                parts = [" " + p for p in parts]
                parts[0] = first
            else:
                parts = self.find(text)
            cut.append(parts)
            for p in parts:
                if p not in known:
                    new[p] = None
        if new:
            self._learn(list(new))
        out = []
        for parts in cut:
            ids = array("H")
            ids.frombytes(b"".join(map(known.__getitem__, parts)))
            out.append(ids)
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ByteBPE:
    """A worker's encoder, kept from task to task."""
    return ByteBPE(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(id, ids array<int> unless keep_ids is off, n_tokens, ids_sha256, decoded_sha256), one row per document."""
    schema = f"`{id_col}` bigint, " + "ids array<int>, " * keep_ids + "n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        bpe = encoder(path, pattern)
        for batch in batches:
            rows = []
            for k in range(0, batch.num_rows, TEXTS):
                for ids in bpe.encode_batch(batch.column(1).slice(k, TEXTS).to_pylist()):
                    rows.append((ids if keep_ids else None, len(ids), hashlib.sha256(" ".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            cols = [batch.column(0)] + [pa.array([r[0] for r in rows], pa.list_(pa.int32()))] * keep_ids
            cols += [pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int64()), (2, pa.string()), (3, pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, *["ids"] * keep_ids, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)
