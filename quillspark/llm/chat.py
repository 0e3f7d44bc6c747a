"""Chat formatting with offset-aligned loss masks (operator 8).

A conversation is rendered whole: each turn is a control string, the role, the control
string, the text; one more control string ends it. It is encoded once with offsets, and
the sorted spans of assistant texts are intersected with the sorted token spans by binary
search. Control strings inside roles and texts are escaped reversibly, and the control
string is a token of its own, so a token never reaches over a turn's edge.

Defined results: rows are ordered by turn (null first), then role, then text; null roles
and texts are empty; repeated rows are turns of their own; rows without an id are one
conversation without an id; columns other than the four named are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = "<|endoftext|>"
LEARNED_ROLE = "assistant"
#: Conversations encoded together.
BATCH = 64


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|])", r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans of the texts to learn from."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{CONTROL}{escape(role)}{CONTROL}", escape(text)
        if role == LEARNED_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body]
        at += len(head) + len(body)
    return "".join(out) + CONTROL, spans


def mask_tokens(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tokens that lie within a span. All three are sorted."""
    mask = np.zeros(len(starts), bool)
    if spans:
        a, b = np.array(spans).T
        for lo, hi in zip(np.searchsorted(starts, a, "left"), np.searchsorted(ends, b, "right")):
            mask[lo:hi] = True
    return mask


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def format_conversations(rows: DataFrame, tokenizer: str, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, n_turns, formatted, ids, mask), one row per conversation."""
    slim = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(turn_col).alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    dealt = slim.repartition("id").sortWithinPartitions(F.asc_nulls_first("id"), F.asc_nulls_first("turn"), "role", "text")

    def run(batches):
        tok = _tokenizer(tokenizer)
        ready: list[tuple] = []
        now: list = [None, None]  # the id and turns at hand, which may go on in the next batch

        def out():
            made = [render(turns) for _, turns in ready]
            got = tok.encode_batch([text for text, _ in made], add_special_tokens=False)
            ids, masks = [], []
            for e, (_, spans) in zip(got, made):
                offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
                ids.append(np.array(e.ids, np.int32))
                masks.append(mask_tokens(offsets[:, 0], offsets[:, 1], spans))
            cols = [pa.array([i for i, _ in ready], pa.int64()), pa.array([len(t) for _, t in ready], pa.int64()), pa.array([t for t, _ in made], pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array([m.tolist() for m in masks], pa.list_(pa.bool_()))]
            ready.clear()
            return pa.RecordBatch.from_arrays(cols, names=[id_col, "n_turns", "formatted", "ids", "mask"])

        for batch in batches:
            for conv, role, text in zip(batch.column("id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                if now[1] is None or now[0] != conv:
                    if now[1] is not None:
                        ready.append(tuple(now))
                    now = [conv, []]
                    if len(ready) >= BATCH:
                        yield out()
                now[1].append((role, text))
        if now[1] is not None:
            ready.append(tuple(now))
        if ready:
            yield out()

    return dealt.mapInArrow(run, f"`{id_col}` bigint, n_turns bigint, formatted string, ids array<int>, mask array<boolean>")


def read_turns(formatted: str) -> list[tuple[str, str]]:
    parts = formatted.split(CONTROL)[1:-1]
    return [(unescape(r), unescape(t)) for r, t in zip(parts[::2], parts[1::2])]


def read_back(formatted: DataFrame, tokenizer: str, id_col: str = "conv_id") -> DataFrame:
    """(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read from the output."""

    def run(batches):
        tok = _tokenizer(tokenizer)
        for batch in batches:
            rows = []
            for text, ids, mask in zip(batch.column("formatted"), batch.column("ids"), batch.column("mask")):
                text, ids, mask = text.as_py(), ids.values.to_numpy(), mask.values.to_numpy(zero_copy_only=False)
                turns = read_turns(text)
                edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).reshape(-1, 2)
                loss = "".join(unescape(tok.decode(ids[a:b].tolist(), skip_special_tokens=False)) for a, b in edges.tolist())
                rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(id_col)] + [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[id_col, *[n for n, _ in kinds]])

    return formatted.select(id_col, "formatted", "ids", "mask").mapInArrow(run, f"`{id_col}` bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
