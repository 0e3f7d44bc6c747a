"""Scores of chunks for a batch of questions in one worker, by tables of chunks and terms.

A score needs nothing of other chunks but document frequencies and the mean length. So each
task scores its own chunks and keeps the best of each question; what leaves it is k rows a
question, not one for each pair. Sums are of whole numbers (shares of BM25 are rounded to a
fixed fraction), so that no order of adding matters and equal texts have equal scores."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa

from ..functions.text import STOPWORDS

#: Length of a hashing vector; BM25's constants; weights of the signals.
DIM, K1, B = 384, 1.5, 0.75
WEIGHTS = {"vector": 0.65, "bm25": 0.20, "lexical": 0.10, "intent": 0.08}
#: Questions of one pass over the chunks, and their tokens; a longer question has its own.
QUESTIONS, TOKENS = 500, 20_000
#: Chunks scored together; their characters; cells of a table of them.
CHUNKS, CHARS, CELLS = 250, 1_000_000, 1_000_000
#: Distinct tokens remembered by a worker; a full memo starts anew.
MEMO = 300_000
#: Shares of BM25 are whole numbers of 1 / UNIT: sums under 32,768 (700 rare terms at least) are exact.
UNIT = 2.0**38
SIGNALS = ["vector", "bm25", "lexical", "intent", "score"]

_STOP = frozenset(STOPWORDS)
_tokens = re.compile("[a-z0-9_]+").findall
_NEVER = np.iinfo(np.int64).max


class Question(NamedTuple):
    id: Any
    all_tokens: list[str]
    tokens: list[str]
    subject: list[str]
    acronyms: list[str]  # of a question for an acronym's meaning


class Corpus(NamedTuple):
    """What scores need of all chunks: how many, the mean length, frequencies of terms."""

    n: int
    avg_len: float
    df: dict[str, int]


def passes(questions: list[Question]) -> list[list[Question]]:
    out, size = [], 0
    for q in questions:
        n = len(q.all_tokens)
        if not out or len(out[-1]) == QUESTIONS or size + n > TOKENS:
            out.append([])
            size = 0
        out[-1].append(q)
        size += n
    return out


class Codes(dict):
    """token -> term's number, place in a vector, whether a stop word, and sign, in one number."""

    def __init__(self, terms: dict[str, int]):
        self.terms = terms

    def __missing__(self, token: str) -> int:
        h = hashlib.sha256(token.encode()).digest()
        code = self.terms.get(token, -1) + 1 << 11 | int.from_bytes(h[:4], "big") % DIM << 2 | (token in _STOP) << 1 | h[4] & 1
        self[token] = code
        return code

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Codes of all tokens, the text each is from, and each text's first token that is no stop word."""
        if len(self) > MEMO:
            self.clear()
        found = [_tokens(t) for t in texts]
        codes = np.concatenate([np.fromiter(map(self.__getitem__, f), np.int64, len(f)) for f in found])
        return codes, np.repeat(np.arange(len(texts)), [len(f) for f in found]), [next((t for t in f if t not in _STOP), "") for f in found]


def groups(column: pa.Array, wide: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts): runs of rows that fit a table `wide` columns wide."""
    most, begin, texts, chars = max(1, min(CHUNKS, CELLS // max(1, wide))), 0, [], 0
    for i in range(len(column)):
        text = column[i].as_py()
        if texts and (len(texts) == most or chars + len(text) > CHARS):
            yield begin, texts
            begin, texts, chars = i, [], 0
        texts.append(text)
        chars += len(text)
    if texts:
        yield begin, texts


def frequencies(columns: Iterator[pa.Array], terms: dict[str, int], singulars: bool = False) -> tuple[int, int, np.ndarray]:
    """(chunks, tokens that are no stop words, chunks with each term) of a task's texts. With
    `singulars` a term of three letters or more also stands where its plural in `terms` does."""
    plural = np.array([terms.get(t + "s", i) if len(t) > 2 else i for t, i in terms.items()], np.int64)
    codes, n, total, df = Codes(terms), 0, 0, np.zeros(len(terms), np.int64)
    for column in columns:
        for _, texts in groups(column, len(terms)):
            code, at, _ = codes.read(texts)
            kept = code & 2 == 0
            term, at = (code[kept] >> 11) - 1, at[kept]
            n, total = n + len(texts), total + len(term)
            seen = np.zeros((len(texts), len(terms)), bool)
            seen[at[term >= 0], term[term >= 0]] = True
            df += (seen | seen[:, plural] if singulars else seen).sum(0)
    return n, total, df


class Scorer:
    """One pass's questions, ready to score chunks."""

    def __init__(self, questions: list[Question], corpus: Corpus, acronyms: list[str]):
        self.terms: dict[str, int] = {}
        for q in questions:
            for t in q.tokens:
                self.terms.setdefault(t, len(self.terms))
        nt, nq = len(self.terms), len(questions)
        self.codes, self.avg = Codes(self.terms), max(1.0, corpus.avg_len)
        df = np.array([corpus.df.get(t, 0) for t in self.terms], float)
        self.idf = np.log(1.0 + (corpus.n - df + 0.5) / (df + 0.5))
        self.cols = [np.array([self.terms[t] for t in dict.fromkeys(q.tokens)], np.int64) for q in questions]
        many = np.zeros((nt, nq), np.float32)
        self.subject = np.zeros((nt, nq), np.float32)
        for j, q in enumerate(questions):
            for t in q.tokens:
                many[self.terms[t], j] += 1
            self.subject[[self.terms[t] for t in set(q.subject)], j] = 1
        self.has = (many > 0).astype(np.float32)
        self.held = self.has.astype(float)
        self.again, which = np.nonzero(many > 1)  # terms that stand more than once in a question
        self.times = many[self.again, which].astype(np.int64)
        self.back = (which[:, None] == np.arange(nq)).astype(float)
        self.size, self.distinct = (np.array([len(f(q.tokens)) for q in questions], float) for f in (list, set))
        self.subjects = np.array([len(set(q.subject)) for q in questions], float)
        self.vectors = np.zeros((nq, DIM))
        for j, q in enumerate(questions):
            code = np.array([self.codes[t] for t in q.all_tokens], np.int64)
            self.vectors[j] = np.bincount(code >> 2 & 511, 1 - 2 * (code & 1), DIM)
        self.norm = np.sqrt((self.vectors * self.vectors).sum(1))
        self.phrases = [" ".join(q.tokens) for q in questions]
        self.subject_phrases = [" ".join(q.subject) for q in questions]
        self.heads: dict[str, list[int]] = {}
        for j, q in enumerate(questions):
            if q.tokens:
                self.heads.setdefault(q.tokens[0], []).append(j)
        self.longest = max(map(len, self.heads), default=0)
        self.asked = [(j, [acronyms.index(a) for a in q.acronyms]) for j, q in enumerate(questions) if q.acronyms]

    def score(self, texts: list[str], boosts: list[list[float]]) -> dict[str, np.ndarray]:
        """Each signal and the score: tables of texts (in lower case) and questions. `boosts`
        has a text's worth for each acronym."""
        n, nt, nq = len(texts), len(self.terms), len(self.size)
        code, at, heads = self.codes.read(texts)
        vectors = np.bincount(at * DIM + (code >> 2 & 511), 1 - 2 * (code & 1), n * DIM).reshape(n, DIM)
        norm = np.sqrt((vectors * vectors).sum(1))[:, None] * self.norm
        vector = np.divide(vectors @ self.vectors.T, norm, out=np.zeros((n, nq)), where=norm > 0)

        kept = code & 2 == 0
        term, at = (code[kept] >> 11) - 1, at[kept]
        length = np.bincount(at, minlength=n)
        place = np.arange(len(at)) - (np.cumsum(length) - length)[at]
        met = term >= 0
        cell, place = at[met] * nt + term[met], place[met]
        tf = np.bincount(cell, minlength=n * nt)
        first = np.full(n * nt, _NEVER)
        first[cell[::-1]] = place[::-1]  # of equal cells the last is written last, which is the first place
        share, some = np.zeros(n * nt), np.flatnonzero(tf)
        f, where = tf[some].astype(float), some % max(1, nt)
        share[some] = np.rint(self.idf[where] * ((f * (K1 + 1)) / (f + K1 * (1 - B + B * (length[some // max(1, nt)] / self.avg)))) * UNIT)
        tf, first = tf.reshape(n, nt), first.reshape(n, nt)
        raw = share.reshape(n, nt) @ self.held / UNIT
        bm25 = np.where(raw > 0, raw / (raw + 3.0), 0.0)

        there = (tf > 0).astype(np.float32)
        present = (there @ self.has).astype(float)
        overlap = present + np.maximum(0, np.minimum(tf[:, self.again], self.times) - 1).astype(float) @ self.back
        subject = (there @ self.subject).astype(float) if self.subjects.any() else np.zeros((n, nq))
        phrase, defined, title, acronym = (np.zeros((n, nq)) for _ in range(4))
        full, about = (self.distinct > 0) & (present == self.distinct), (self.subjects > 0) & (subject == self.subjects)
        for i in np.flatnonzero((full | about).any(1)):
            said = " ".join([t for t in _tokens(texts[i]) if t not in _STOP])
            for j in np.flatnonzero(full[i]):
                phrase[i, j] = 0.35 * (self.phrases[j] in said)
            for j in np.flatnonzero(about[i]):
                defined[i, j] = 0.5 * (self.subject_phrases[j] in said)
        for i, head in enumerate(heads):
            for k in range(1, min(len(head), self.longest) + 1):
                title[i, self.heads.get(head[:k], [])] = 0.15
        for j, which in self.asked:
            acronym[:, j] = [max(b[a] for a in which) for b in boosts]

        words = (self.size > 0) & (length > 0)[:, None]
        lexical = np.where(words, np.minimum(1.0, overlap / np.maximum(1, self.size) + phrase + title), 0.0)
        coverage = present / np.maximum(1, self.distinct)
        near = np.zeros((n, nq))
        close = (self.size >= 2) & (present > 0) & (coverage >= 0.5)
        for j in np.flatnonzero(close.any(0)):
            i = np.flatnonzero(close[:, j])
            places = first[np.ix_(i, self.cols[j])]
            window = np.where(places == _NEVER, -1, places).max(1) - places.min(1) + 1
            near[i, j] = np.minimum(0.4, coverage[i, j] * (present[i, j] / window))
        about = np.where(defined > 0, defined, np.where((self.subjects > 0) & (subject / np.maximum(1, self.subjects) >= 0.75), 0.25, 0.0))
        intent = np.minimum(0.35, acronym + about + near)
        score = WEIGHTS["vector"] * vector + WEIGHTS["bm25"] * bm25 + WEIGHTS["lexical"] * lexical + WEIGHTS["intent"] * intent
        return dict(zip(SIGNALS, (vector, bm25, lexical, intent, score)))


class Best:
    """The k best rows of each question by one signal, ties in the order of `ord`."""

    def __init__(self, questions: int, k: int):
        self.k, self.least = k, np.full(questions, -np.inf)
        self.rows: list[list[tuple]] = [[] for _ in range(questions)]

    def add(self, by: np.ndarray, orders: list[tuple], places: np.ndarray, row) -> None:
        """`places` are the chunks' places by `orders`; row(i, j) makes what is kept of a pair."""
        able = by >= self.least
        for j in np.flatnonzero(able.any(0)):
            i, rows = np.flatnonzero(able[:, j]), self.rows[j]
            i = i[np.lexsort((places[i], -by[i, j]))[: self.k]]
            if len(rows) == self.k:
                last = rows[-1][:2]
                i = [x for x in i if (-by[x, j], orders[x]) < last]
            if len(i):
                rows += [(-float(by[x, j]), orders[x], row(x, j)) for x in i]
                rows.sort(key=lambda r: r[:2])
                del rows[self.k :]
                if len(rows) == self.k:
                    self.least[j] = -rows[-1][0]


def search(batches: Iterator[pa.RecordBatch], scorer: Scorer, ids: pa.Array, keep: dict[str, int] | None) -> Iterator[pa.RecordBatch]:
    """(query_id, key, ord, signals and score) of batches (key, ord, text, boosts): of every
    pair, or of those among the best of their question in this task by a signal in `keep`."""
    nq, kinds, seen = len(ids), None, 0
    best = {by: Best(nq, k) for by, k in (keep or {}).items()}

    def made(q, keys, orders, values) -> pa.RecordBatch:
        columns = [ids.take(pa.array(q, pa.int64())), keys, orders, *[pa.array(v, pa.float64()) for v in values]]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "key", "ord", *SIGNALS])

    for batch in batches:
        kinds = [batch.schema.field(c).type for c in (0, 1)]
        for begin, texts in groups(batch.column(2), max(len(scorer.terms), nq)):
            keys, orders, boosts = (batch.column(c).slice(begin, len(texts)) for c in (0, 1, 3))
            got = scorer.score(texts, boosts.to_pylist() if scorer.asked else [])
            if keep is None:
                each = pa.array(np.repeat(np.arange(len(texts)), nq))
                yield made(np.tile(np.arange(nq), len(texts)), keys.take(each), orders.take(each), [got[s].ravel() for s in SIGNALS])
                continue
            by = [(x is not None, x) for x in orders.to_pylist()]  # nulls first
            places = np.empty(len(by), np.int64)
            places[sorted(range(len(by)), key=by.__getitem__)] = np.arange(len(by))
            row = lambda i, j: (seen + i, keys[i].as_py(), orders[i].as_py(), [float(got[s][i, j]) for s in SIGNALS])  # noqa: B023, E731
            for name, b in best.items():
                b.add(got[name], by, places, row)
            seen += len(texts)
    if kinds:
        for j in range(nq):
            rows = list({r[2][0]: r[2] for b in best.values() for r in b.rows[j]}.values())
            if rows:
                yield made([j] * len(rows), pa.array([r[1] for r in rows], kinds[0]), pa.array([r[2] for r in rows], kinds[1]), zip(*[r[3] for r in rows]))
