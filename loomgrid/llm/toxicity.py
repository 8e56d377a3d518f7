"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are lower-cased words and word beginnings of 5 letters. At most ``LABELLED`` labelled rows (smallest
seeded hash) are examples. All their terms are in the index; document frequencies come from all documents. A term's
weight is (1 + log count) * log(N / df), times FLOOR plus the strength of the term's association with the label among the
examples (phi coefficient), so that words of topics do not drown those that tell the labels apart.

The examples lie in blocks. Postings of a term are kept by block, each with the greatest weight in it. Terms that many
examples hold are kept as a dense matrix instead, whose product with a batch of texts is a first part of all cosines. A
block's best first part, and the greatest weights of the text's other terms there, bound what the block can reach: blocks
that cannot reach the k-th best first part are left out, exactly, and the postings of the others are added.

The neighbours' votes, weighted by squared similarity and smoothed by the examples' base rate, are calibrated by a
logistic curve fitted to the examples' own leave-one-out votes. The nearest examples are the evidence.

What is sent to executors is bounded by LABELLED, not by the corpus. Defined results: a text's vector has those of its
terms that an example holds; null and empty texts and texts without such a term get the examples' base rate and no
evidence; very long texts count whole; similarities are rounded to six places, equal ones are ordered by example number;
repeated rows get equal scores; without usable labels of both kinds all scores are 0.5; an empty table gives an empty
result; extra columns pass through, but columns named like the results are an error.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import prepared
from .common import refuse
from .quality_classifier import labelled

#: Labelled rows that may be examples.
LABELLED = 2_000
NEIGHBOURS = 25
SMOOTH = 0.02
#: Weight of a term without any association with the label.
FLOOR = 0.05
BLOCK = 64
#: Share of the examples from which on a term is common.
COMMON = 0.03
START = 5
LETTERS = re.compile(r"[^\W\d_]+")
#: Texts that are scored together.
BATCH = 64

EVIDENCE = T.ArrayType(T.StructType([T.StructField("example", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("label", T.IntegerType())]))


def terms_of(word: str) -> list[str]:
    return [word, f"{word[:START]}~"] if len(word) > START else [word]


def words_of(text: str) -> Counter:
    """How often each run of letters occurs; only what holds other characters needs the pattern."""
    out = Counter(text.lower().split())
    for mixed in [w for w in out if not w.isalpha()]:
        n = out.pop(mixed)
        for w in LETTERS.findall(mixed):
            out[w] += n
    return out


def term_counts(text: str) -> Counter:
    out: Counter = Counter()
    for word, n in words_of(text).items():
        for t in terms_of(word):
            out[t] += n
    return out


class Vocabulary:
    """Numbers of the counted terms: words, and word beginnings by their letters."""

    def __init__(self, terms: list[str]):
        self.words = {t: i for i, t in enumerate(terms) if not t.endswith("~")}
        self.starts = {t[:-1]: i for i, t in enumerate(terms) if t.endswith("~")}

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The number of each word, then that of its beginning; -1 where it has none."""
        word, start = self.words.get, self.starts.get
        own = [word(w, -1) for w in words]
        own += [start(w[:START], -1) if len(w) > START else -1 for w in words]
        return np.array(own, np.int64)

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers in ascending order and how often each occurs."""
        words = words_of(text)
        at = self._numbers(list(words))
        n = np.fromiter(words.values(), np.float64, len(words))
        known = at >= 0
        at, back = np.unique(at[known], return_inverse=True)
        return at, np.bincount(back, np.concatenate([n, n])[known], len(at))

    def present(self, text: str) -> np.ndarray:
        at = np.unique(self._numbers(list(words_of(text))))
        return at[at >= 0]


def _ranges(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places low, low + 1, ... of each range, one range after another."""
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Index:
    """Examples (id, label, term numbers, counts) as an inverted index in blocks, with the calibration of the votes."""

    def __init__(self, terms: list[str], weight: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]], base: float):
        self.words, self.term_weight, self.base = Vocabulary(terms), weight, base
        vectors = [(i, y, at, self.weights(at, n)) for i, y, at, n in examples if len(at)]
        # examples that share their weightiest term lie in one block, which keeps upper bounds tight
        vectors.sort(key=lambda e: (int(e[2][np.argmax(e[3])]), e[0]))
        self.ids = np.array([e[0] for e in vectors], np.int64)
        self.labels = np.array([e[1] for e in vectors], np.int64)
        self.size, self.blocks = len(vectors), -(-len(vectors) // BLOCK)
        at = np.concatenate([e[2] for e in vectors]) if vectors else np.zeros(0, np.int64)
        who = np.repeat(np.arange(len(vectors)), [len(e[2]) for e in vectors])
        value = np.concatenate([e[3] for e in vectors]) if vectors else np.zeros(0)
        df = np.bincount(at, minlength=len(terms))
        common = np.flatnonzero(df > max(BLOCK, COMMON * len(vectors)))
        self.column = np.full(len(terms), -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), max(1, self.blocks) * BLOCK), np.float32)
        often = self.column[at] >= 0
        self.dense[self.column[at[often]], who[often]] = value[often]
        at, who, value = at[~often], who[~often], value[~often]
        order = np.lexsort((who, at))
        self.who, self.value, at = who[order].astype(np.int32), value[order].astype(np.float32), at[order]
        # a cell holds a term's postings in a block
        cell = at * max(1, self.blocks) + self.who // BLOCK
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        self.cell_low, self.cell_n = first.astype(np.int32), np.diff(np.append(first, len(cell))).astype(np.int32)
        self.cell_block = (self.who[first] // BLOCK).astype(np.int32)
        self.cell_most = np.maximum.reduceat(self.value, first) if len(first) else np.zeros(0, np.float32)
        self.term_cells = np.searchsorted(at[first], np.arange(len(terms) + 1)).astype(np.int32)
        self.slope, self.shift = 1.0, 0.0
        if vectors:
            self._calibrate([(e[2], e[3]) for e in vectors])

    def weights(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (1 + np.log(n)) * self.term_weight[at]
        return w / max(1e-12, float(np.sqrt((w**2).sum())))

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the k most similar examples and their cosines, most similar first, ties by number. Exact."""
        if not self.size:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        often = np.zeros((len(queries), len(self.dense)), np.float32)
        for i, (at, w) in enumerate(queries):
            c = self.column[at]
            often[i, c[c >= 0]] = w[c >= 0]
        firsts = (often @ self.dense)[:, : self.size]
        return [self._finish(at[self.column[at] < 0], w[self.column[at] < 0], part, k) for (at, w), part in zip(queries, firsts, strict=True)]

    def _finish(self, at: np.ndarray, w: np.ndarray, part: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        low, n = self.term_cells[at].astype(np.int64), (self.term_cells[at + 1] - self.term_cells[at]).astype(np.int64)
        cells, weight = _ranges(low, n), np.repeat(w, n)
        least = np.partition(part, -k)[-k] if len(part) > k else 0.0
        best = np.maximum.reduceat(part, np.arange(0, self.size, BLOCK))
        reach = best + np.bincount(self.cell_block[cells], weight * self.cell_most[cells], self.blocks)
        open_ = reach >= least - 1e-5
        ask = open_[self.cell_block[cells]]
        cells, weight = cells[ask], weight[ask]
        n = self.cell_n[cells].astype(np.int64)
        at = _ranges(self.cell_low[cells].astype(np.int64), n)
        score = np.round(part + np.bincount(self.who[at], np.repeat(weight, n) * self.value[at], self.size), 6)
        score[~np.repeat(open_, BLOCK)[: self.size]] = 0
        if len(score) > k:
            found = np.flatnonzero((score >= np.partition(score, -k)[-k]) & (score > 0))
        else:
            found = np.flatnonzero(score > 0)
        found = found[np.lexsort((found, -score[found]))][:k]
        return found, score[found]

    def vote(self, who: np.ndarray, s: np.ndarray) -> float:
        w = s**2
        return float(((w * self.labels[who]).sum() + SMOOTH * self.base) / (w.sum() + SMOOTH))

    def _calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Logistic curve from leave-one-out votes, held near the identity by a weak penalty; Newton's steps."""
        votes = []
        for low in range(0, len(vectors), BATCH):
            for i, (who, s) in enumerate(self.nearest(vectors[low : low + BATCH], NEIGHBOURS + 1), low):
                others = who != i
                votes.append(self.vote(who[others][:NEIGHBOURS], s[others][:NEIGHBOURS]))
        v = np.clip(np.array(votes), 1e-4, 1 - 1e-4)
        x, y = np.log(v / (1 - v)), self.labels.astype(float)
        theta = np.array([0.0, 1.0])
        z = np.column_stack([np.ones(len(x)), x])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
            slope = z.T @ (p - y) + 2 * (theta - [0, 1])
            theta = theta - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 2 * np.eye(2), slope)
        if np.isfinite(theta).all() and theta[1] > 0.1:
            self.shift, self.slope = float(theta[0]), float(theta[1])

    def score(self, texts: list[str]) -> list[tuple[float, list[dict]]]:
        counted = [self.words.counts(t) for t in texts]
        out = []
        for (at, _), (who, s) in zip(counted, self.nearest([(at, self.weights(at, n)) for at, n in counted], NEIGHBOURS), strict=True):
            if not len(at) or not len(who):
                out.append((self.base, []))
                continue
            v = min(max(self.vote(who, s), 1e-4), 1 - 1e-4)
            p = 1 / (1 + np.exp(-np.clip(self.shift + self.slope * np.log(v / (1 - v)), -30, 30)))
            out.append((float(p), [{"example": int(self.ids[j]), "similarity": float(c), "label": int(self.labels[j])} for j, c in zip(who[:3].tolist(), s[:3].tolist(), strict=True)]))
        return out


def association(size: int, at: np.ndarray, y: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """FLOOR plus the phi coefficient of each term's presence and the label, 0 to 1. at, y: terms of the examples and their labels."""
    a, b = np.bincount(at[y == 1], minlength=size).astype(float), np.bincount(at[y == 0], minlength=size).astype(float)
    n = n0 + n1
    chi = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / np.maximum((a + b) * (n - a - b) * n0 * n1, 1e-9)
    return FLOOR + np.sqrt(np.where(a + b < n, chi, 0) / n)


def document_frequencies(docs: DataFrame, text: str, terms: list[str]) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and the number of documents."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(sent.value)
        df, rows = np.zeros(len(sent.value), np.int64), 0
        for b in batches:
            for x in b.column(0).to_pylist():
                rows += 1
                df[known.present(x or "")] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], rows), pa.int64())], names=["t", "n"])

    got = docs.select(F.col(f"`{text}`")).mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    at, n = got["t"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(len(terms), np.int64)
    df[at[at >= 0]] = n[at >= 0]
    return df, int(n[at < 0].sum())


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", id_col: str = "doc_id", text: str = "text") -> Index | None:
    """usable: condition on the label table's rows that may be learnt from. None without both labels."""
    prepared(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [term_counts(x or "") for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([list(g) for g in got], pa.list_(pa.string())), pa.array([list(g.values()) for g in got], pa.list_(pa.int32()))], names=["h", "id", "y", "terms", "n"])

    rows = labelled(docs, labels, usable, label, LABELLED, id_col, text).mapInArrow(run, "h long, id long, y int, terms array<string>, n array<int>")
    got = rows.orderBy("h", "id", F.xxhash64("terms", "n")).limit(LABELLED).toArrow().combine_chunks()
    ids, y = got["id"].to_numpy(), got["y"].to_numpy()
    positive = int(y.sum())
    if positive in (0, len(y)):
        return None
    every = pa.concat_arrays(got["terms"].chunks).flatten().dictionary_encode()
    terms, at = every.dictionary.to_pylist(), every.indices.to_numpy().astype(np.int64)
    counts = pa.concat_arrays(got["n"].chunks).flatten().to_numpy().astype(np.float64)
    lengths = pa.concat_arrays(got["terms"].chunks).value_lengths().to_numpy()
    del got, every
    df, n = document_frequencies(docs, text, terms)
    weight = np.log((n + 1) / np.maximum(df, 1)) * association(len(terms), at, np.repeat(y, lengths), positive, len(y) - positive)
    stop = np.cumsum(lengths)
    examples = []
    for i, label_, low, high in zip(ids.tolist(), y.tolist(), (stop - lengths).tolist(), stop.tolist(), strict=True):
        order = low + np.argsort(at[low:high])
        examples.append((i, label_, at[order], counts[order]))
    return Index(terms, weight, examples, positive / len(y))


def score(docs: DataFrame, index: Index | None, text: str = "text") -> DataFrame:
    """The input's other columns, score and evidence (nearest examples)."""
    spark = prepared(docs)
    refuse(docs, "score", "evidence")
    rest = [c for c in docs.columns if c != text]
    sent = spark.sparkContext.broadcast(index)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("example", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))
        for b in batches:
            texts = [x or "" for x in b.column(0).to_pylist()]
            got = [s for low in range(0, len(texts), BATCH) for s in (sent.value.score(texts[low : low + BATCH]) if sent.value else [(0.5, [])] * len(texts[low : low + BATCH]))]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], kind)], names=[*rest, "score", "evidence"])

    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField("score", T.DoubleType()), T.StructField("evidence", EVIDENCE)])
    return docs.select(F.col(f"`{text}`"), *(F.col(f"`{c}`") for c in rest)).mapInArrow(run, schema)
