"""Toxicity of texts after noisy-channel deobfuscation (operator 3).

Words that may be disguised (symbols for letters, letters doubled or repeated, letters
parted by signs or white space) become character lattices. A Viterbi search finds the
reading that a character trigram model, counted over every document, and the channel's
costs together make likeliest. Words whose lattice has a single path are that path. What
to do with a doubled letter hangs on its two neighbours alone, so for words whose only
choices are such letters the search is a look into a table. Words without a letter, @ or
$$ are numbers, and brackets around a word are brackets. The restored words'
beginnings and the words themselves are the features of a logistic model, fitted on at
most `SAMPLE` labelled rows.

Defined results: a null or empty text has the model's base score; several labels for one
id count as toxic if any does; rows without a label are scored alike; without any label,
or with one class only, every score is 0. Whole texts are read, and columns other than
id, text and label are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROWS, Scratch, keep_rows, small_batches, text_or_empty, worker_state

#: Labelled rows that the model is fitted on, at most, and features that it keeps.
SAMPLE, FEATURES = 20_000, 4096
#: Characters of words that a worker remembers, an entry's own cost included; a full memo starts anew.
MEMO = 8_000_000
#: Code points counted at once, which bounds a worker's memory.
STRETCH = 1 << 16
#: Letters that a symbol may stand for.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Log costs of the channel: a symbol for a letter, a letter repeated, a letter spaced out.
SWAP, REPEAT, SPACE = -1.5, -1.0, -0.5
#: Letters drawn with several symbols; log cost of a letter written twice.
DRAWN, DOUBLE = {"|_|": "u", "|-|": "h", "()": "o", "/\\": "a", "\\/": "v", "|)": "d", "|<": "k"}, -3.0
#: Letters that a star within a word may hide.
VOWELS = "aeiou"
#: Classes of characters: space, a to z, 24 for other letters, digits, all else.
CLASSES = 53

_WORD = re.compile(r"[^\W_]+")
_SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+€£])(?:[\s._*/\-]++(?:[^\W_]|[@$!|+(€£])){2,}(?!\S)")
_LETTER = re.compile(r"[^\W\d_]")
_TWICE = re.compile(r"([^\W\d_])\1")
_REPEATED = re.compile(r"([^\W\d_])\1\1")
_SINGLE = re.compile(r"^[^\W_](?:[^\w\s]+[^\W_]){2,}$")
_SEPARATOR = re.compile(r"[\s._*/\-,;:~^=#%&\\`\"'<>\[\]{}?)·•–—…]+")
_MAYBE = re.compile(r"[^\W\d_]|@|\$\$")
#: Checksums and the like, whose letters stand for nothing else.
_DIGEST = re.compile(r"(?=[^0-9]*[0-9])[0-9a-f-]{12,}")
_DECORATION = re.compile(r"([^\w\s])\1{2,}")

_class_of: np.ndarray | None = None


def char_classes() -> np.ndarray:
    global _class_of
    if _class_of is None:
        table = np.full(0x110000, CLASSES - 1, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isspace():
                table[i] = 0
            elif "a" <= c <= "z":
                table[i] = i - 96
            elif c.isalpha():
                table[i] = 27 + i % 24
            elif c.isdigit():
                table[i] = CLASSES - 2
        _class_of = table
    return _class_of


def count_trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of class trigrams over all texts: one row of each kind from a task, and a
    fixed number of kinds in all."""

    def run(batches):
        worker_state("toxicity counts")
        total = np.zeros(CLASSES**3, np.int64)

        def count(texts):
            text = " ".join(texts).lower()
            for k in range(0, len(text), STRETCH):
                c = char_classes()[np.frombuffer(text[max(0, k - 2) : k + STRETCH].encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
                if len(c) > 2:
                    total[:] += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)

        waiting, chars = [], 0
        for batch in batches:
            for text in batch.column(0):
                waiting.append(text.as_py())
                chars += len(waiting[-1])
                if chars >= STRETCH:
                    count(waiting)
                    waiting, chars = [], 0
        count(waiting)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    rows = docs.select(text_or_empty(text_col)).mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CLASSES**3)
    for r in rows:
        counts[r["gram"]] = r["n"]
    return counts.reshape(CLASSES, CLASSES, CLASSES)


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log P(c | a, b), the trigram estimate resting on the bigram's and that on the character's."""
    uni = (counts.sum(axis=(0, 1)) + 1) / (counts.sum() + CLASSES)
    two = counts.sum(axis=0)
    bi = (two + 5 * uni) / (two.sum(axis=1, keepdims=True) + 5)
    return np.log((counts + 5 * bi[None]) / (counts.sum(axis=2, keepdims=True) + 5)).astype(np.float32)


class Channel:
    """restore() of disguised words by Viterbi search over a lattice."""

    def __init__(self, model: np.ndarray):
        self.memo, self.room, self.classes = {}, MEMO, {}
        self.model = model.tolist()
        # whether a letter c written twice after a and before b is likelier meant once, by [a, c, b]
        c = np.arange(CLASSES)
        self.once = (model[:, c, c][:, :, None] + model[c, c][None] < model + np.float32(DOUBLE)).tolist()

    def _class(self, c: str) -> int:
        k = self.classes.get(c)
        if k is None:
            k = self.classes[c] = int(char_classes()[ord(c)])
        return k

    def undouble(self, word: str) -> str:
        """The likeliest path of a word of letters none of which stands three times in a row."""
        out, at = [], 0
        for m in _TWICE.finditer(word):
            i, j = m.span()
            a = self._class(word[i - 1]) if i else 0
            b = self._class(word[j]) if j < len(word) else 0
            c = word[i]
            if c.islower() and self.once[a][self._class(c)][b]:
                out.append(word[at : i + 1])
                at = j
        return "".join(out) + word[at:]

    def decode(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The likeliest path; a state is the classes of the last two characters."""
        model, states = self.model, {(0, 0): (0.0, None)}
        for options in [*lattice, [(" ", 0.0)]]:
            new: dict = {}
            for (a, b), (score, path) in states.items():
                for out, cost in options:
                    x, y, s = a, b, score + cost
                    for c in out:
                        k = self._class(c)
                        s += model[x][y][k]
                        x, y = y, k
                    if (x, y) not in new or s > new[x, y][0]:
                        new[x, y] = (s, (out, path))
            states = new
        _, path = max(states.values(), key=lambda v: v[0])
        out = []
        while path:
            out.append(path[0])
            path = path[1]
        return "".join(reversed(out))[:-1]

    def lattice(self, word: str, spaced: bool = False) -> list[list[tuple[str, float]]]:
        """Each place's readings with their costs. spaced: an apostrophe may part letters too."""
        out, i = [], 0
        end = len(word.rstrip("!"))
        while i < len(word):
            c = word[i]
            drawn = next((d for d in DRAWN if word.startswith(d, i)), None)
            if drawn and (i or i + len(drawn) < len(word)):
                out.append([(" ", 0.0), (DRAWN[drawn], SWAP)])
                i += len(drawn)
                continue
            m = _SEPARATOR.match(word, i)
            if m:
                fixed = m.group() == "'" and not spaced or not i or m.end() == len(word)
                hidden = VOWELS if m.group() in ("*", "#") and not fixed else ""
                out.append([(" ", 0.0)] if fixed else [(" ", 0.0), ("", SPACE), *[(x, SWAP) for x in hidden]])
                i = m.end()
                continue
            n = 1
            while i + n < len(word) and word[i + n] == c:
                n += 1
            if n >= 3 and c.isalpha():
                out.append([(c, REPEAT), (c * 2, REPEAT), (c * n, 0.0)])
                i += n
                continue
            if n == 2 and c.islower():
                out.append([(c * 2, 0.0), (c, DOUBLE)])
                i += n
                continue
            if n >= 4 and c in STANDS_FOR:
                out.append([(c * n, 0.0), *[(x * k, SWAP + REPEAT) for x in STANDS_FOR[c] for k in (1, 2)]])
                i += n
                continue
            if i >= end:  # a mark at the end is none of the word's letters, or one
                out.append([("", 0.0), ("i", SWAP)])
                i += 1
                continue
            out.append([(c, 0.0), *[(x, SWAP) for x in STANDS_FOR.get(c, "")]])
            i += 1
        return out

    def restore(self, word: str) -> str:
        """A lower-case word without white space."""
        core = _DECORATION.sub(" ", word).strip(" .,;:?\"'()[]{}<>")
        if core.isalpha():
            if not _TWICE.search(core):
                return core
            return self.decode(self.lattice(core)) if _REPEATED.search(core) else self.undouble(core)
        if not core or not _MAYBE.search(core) or _DIGEST.fullmatch(core):
            return core
        return self.decode(self.lattice(core, _SINGLE.match(core) is not None))

    def read(self, text: str, make) -> set:
        """What `make` says of the words restored from each token and from each run of spaced
        letters; said once for each as long as it is remembered."""
        text = text.lower()
        out: set = set()
        memo = self.memo
        for m in _SPACED.finditer(text):
            run = m.group()
            if not _LETTER.search(run):
                continue
            got = memo.get(run)
            if got is None:
                got = self._keep(run, make(_WORD.findall(self.decode(self.lattice(run, True)))))
            out.update(got)
        for token in set(text.split()):
            got = memo.get(token)
            if got is None:
                got = self._keep(token, make(_WORD.findall(self.restore(token))))
            if got:
                out.update(got)
        return out

    def words(self, text: str) -> set[str]:
        """Distinct restored words of a text, those read from spaced letters among them."""
        return self.read(text, tuple)

    def _keep(self, key: str, value: tuple) -> tuple:
        self.room -= len(key) * (2 if value else 1) + 80
        if self.room < 0:
            self.memo.clear()
            self.room = MEMO
        self.memo[key] = value
        return value


def features(word: str) -> list[str]:
    return ["=" + word, *["^" + word[:n] for n in (4, 5, 6) if len(word) >= n]]


class Learned(NamedTuple):
    """Character model, weights by feature, bias; the name tells models apart in a worker."""

    model: np.ndarray
    weights: dict[str, float]
    bias: float
    name: str


def _features_of(rows: DataFrame, known: Learned) -> DataFrame:
    """(y, f): distinct features of each text."""

    def run(batches):
        channel = _scorer(known).channel
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                some = batch.slice(k, ROWS)
                out = [sorted({f for w in channel.words(text.as_py()) for f in features(w)}) for text in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(out, pa.list_(pa.string()))], names=["y", "f"])

    return rows.select("y", "text").mapInArrow(run, "y int, f array<string>")


def _picked(words: DataFrame, pick: dict[str, int]) -> DataFrame:
    """(y, f): each text's picked features as 16-bit numbers in a row."""

    def run(batches):
        worker_state("picked features")
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                some = batch.slice(k, ROWS)
                out = [np.array(sorted(pick[f] for f in found.as_py() if f in pick), "<u2").tobytes() for found in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(out, pa.binary())], names=["y", "f"])

    return words.select("y", "f").mapInArrow(run, "y int, f binary")


def _fit(y: np.ndarray, at: np.ndarray, row: np.ndarray, n: int, steps: int = 500, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch gradient steps scaled to each weight (AdaGrad)."""
    w, gw = np.zeros(n), np.full(n, 1e-8)
    b, gb = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)), 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at], len(y)) + b, -40, 40)))
        d = (p - y) / len(y)
        g = np.bincount(at, d[row], n) + l2 * w / 10
        gw += g * g
        gb += d.sum() ** 2
        w -= 0.3 * g / np.sqrt(gw)
        b -= 0.1 * d.sum() / math.sqrt(gb)
    return w, b


def learn(docs: DataFrame, labels: DataFrame, use: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Learned:
    """The model of texts and labels. `use` selects label rows."""
    with small_batches(docs.sparkSession):  # all work on rows ends within
        return _learn(docs, labels, use, id_col, text_col, label_col)


def _learn(docs: DataFrame, labels: DataFrame, use: Column | None, id_col: str, text_col: str, label_col: str) -> Learned:
    scratch = Scratch(docs.sparkSession, "toxicity")
    model = log_model(count_trigrams(docs, text_col))
    known = labels.where(use) if use is not None else labels
    known = known.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("__id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    some = scratch.cut(known.orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE), "sample")
    rows = docs.select(F.col(id_col).cast("bigint").alias("__id"), text_or_empty(text_col).alias("text")).join(F.broadcast(some), "__id")  # SAMPLE rows at most
    rows = scratch.cut(rows.select("y", "text").repartition(max(1, docs.sparkSession.sparkContext.defaultParallelism * 2)), "texts")
    name = uuid.uuid4().hex
    words = scratch.cut(_features_of(rows, Learned(model, {}, 0.0, name)), "features")
    per = {r["y"]: r["n"] for r in words.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(per) < 2:
        return Learned(model, {}, -40.0, name)
    df = words.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where("a + b >= 3")
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (per[1] + 1.0)) - F.log(b / (per[0] + 1.0))
    best = df.orderBy(F.desc(F.abs(odds) / F.sqrt(1 / a + 1 / b)), "f").limit(FEATURES).collect()
    pick = {r["f"]: i for i, r in enumerate(best)}
    got = _picked(words, pick).collect()  # SAMPLE rows, 2 bytes for each of FEATURES at most
    y = np.array([r["y"] for r in got], float)
    found = [np.frombuffer(r["f"], "<u2") for r in got]
    row = np.repeat(np.arange(len(got)), [len(f) for f in found])
    w, bias = _fit(y, np.concatenate(found).astype(np.int64), row, len(pick))
    for used in (some, rows, words):
        scratch.drop(used)
    return Learned(model, {f: float(w[i]) for f, i in pick.items()}, float(bias), uuid.uuid4().hex)


class Scorer:
    """Scores of texts, with what a worker's tokens say remembered."""

    def __init__(self, learned: Learned):
        self.channel, self.weights, self.bias = Channel(learned.model), learned.weights, learned.bias

    def _said(self, words: list[str]) -> tuple[str, ...]:
        return tuple(f for w in words for f in features(w) if f in self.weights)

    def score(self, text: str) -> float:
        if not self.weights:
            return 0.0
        found, weights = self.channel.read(text, self._said), self.weights
        z = self.bias + sum(weights[f] for f in sorted(found))
        return 1 / (1 + math.exp(-min(40.0, max(-40.0, z))))


def _scorer(learned: Learned) -> Scorer:
    """A worker's scorer, kept from task to task as long as the model is the same."""
    return worker_state(("toxicity", learned.name), lambda: Scorer(learned))


def keep_clean(docs: DataFrame, learned, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores below the threshold."""

    def make():
        scorer = _scorer(learned)
        return lambda text: scorer.score(text) < threshold

    return keep_rows(docs, make, text_col)


def score(docs: DataFrame, learned, id_col: str = "doc_id", text_col: str = "text", carry: list[Column] | None = None) -> DataFrame:
    """(id, score, predicted), with the columns in `carry`."""
    shape = docs.select(F.col(id_col).cast("bigint").alias(id_col), text_or_empty(text_col).alias("__text"), *(carry or []))
    kept = [f for f in shape.schema.fields if f.name != "__text"]

    def run(batches):
        scorer = _scorer(learned)
        for batch in batches:
            scores = [scorer.score(t.as_py()) for t in batch.column("__text")]
            cols = [batch.column(f.name) for f in kept] + [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in kept] + ["score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return shape.mapInArrow(run, f"{fields}, score double, predicted int")
