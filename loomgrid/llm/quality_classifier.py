"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

score = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2): all pairwise interactions of a text's
features, in time linear in their number. Inputs come from the text alone: hashed lower-cased words and word shapes
(log counts, unit length), and shares of symbols, capitals, digits, repeated lines and the like.

The model is fitted on at most ``LABELLED`` labelled rows, those of smallest seeded hash, by Adagrad on the logistic
loss; its parameters are a few megabytes whatever the corpus's size, and every document is scored where it lies.
The loss makes the score a probability.

Defined results: null and empty texts get the score of a text without words; very long texts and words count whole;
rows of equal sample hash are ordered by id and features; repeated rows get equal scores; a label table without usable
rows (or an empty one) gives the score 0.5 to all; an empty table gives an empty result; extra columns pass through, but
a column named like the score is an error.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import prepared
from .common import refuse, texts_of

#: Labelled rows that the fit may use.
LABELLED = 12_000
BUCKETS = 1 << 15
RANK = 8
EPOCHS = 6
#: Least number of steps, for small label tables.
STEPS = 600
RATE = 0.15
SEED = 5

STATS = 12
SHAPE = re.compile(rb"[A-Z]+|[a-z]+|[0-9]+|[\x80-\xff]+|[^A-Za-z0-9\x80-\xff]+")
CODES = {**{c: b"A" for c in range(65, 91)}, **{c: b"a" for c in range(97, 123)}, **{c: b"0" for c in range(48, 58)}, **{c: b"u" for c in range(128, 256)}}


class _Hashed(dict):
    """Word -> (bucket of the word, bucket of its shape). Bounded, as texts hold any number of different words."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        shape = b"".join(CODES.get(m[0][0], m[0]) for m in SHAPE.finditer(word))
        found = (STATS + zlib.crc32(word.lower()) % BUCKETS, STATS + zlib.crc32(b"\x00" + shape) % BUCKETS)
        if len(self) < 100_000 and len(word) < 32:
            self[word] = found
        return found


hashed = _Hashed()


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values; the word part has unit length, statistics have places 0 to STATS - 1."""
    words = text.split()
    n = len(words)
    index: dict[int, int] = {}
    for w, k in Counter(words).items():
        a, b = hashed[w]
        index[a] = index.get(a, 0) + k
        index[b] = index.get(b, 0) + k
    raw = np.frombuffer(text, np.uint8)
    kinds = np.bincount(raw, minlength=256) if len(raw) else np.zeros(256)
    size = max(1, len(raw))
    lines = [x for x in text.split(b"\n") if x.strip()]
    stats = np.array(
        [
            1.0,
            np.log1p(n) / 10,
            min(len(raw) / max(1, n), 40) / 10,
            kinds[65:91].sum() / size,
            kinds[48:58].sum() / size,
            kinds[[35, 42, 36, 37, 38, 124, 60, 62]].sum() / size * 4,
            kinds[33] / size * 4,
            kinds[[44, 46, 59, 58, 63]].sum() / size * 4,
            1 - len(set(lines)) / max(1, len(lines)),
            len(set(words)) / max(1, n),
            np.log1p(len(lines)) / 10,
            1 - len({(a, b) for a, b in zip(words, words[1:], strict=False)}) / max(1, n - 1) if n > 1 else 0.0,
        ]
    )
    at = np.fromiter(index.keys(), np.int64, len(index))
    values = np.log1p(np.fromiter(index.values(), np.float64, len(index)))
    values /= max(1e-9, float(np.sqrt((values**2).sum())))
    return np.concatenate([np.arange(STATS), at]), np.concatenate([stats, values])


class Machine:
    """Parameters of a factorisation machine over STATS + BUCKETS features."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = STATS + BUCKETS
        self.w0, self.w, self.v = 0.0, np.zeros(size, np.float32), (rng.normal(0, 0.05, (size, RANK))).astype(np.float32)
        self.fitted = False

    def raw(self, at: np.ndarray, x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of rows that lie one after another, bounds their starts; and each row's sums of v x."""
        vx = self.v[at] * x[:, None]
        sums = np.add.reduceat(vx, bounds)
        pairs = (sums**2 - np.add.reduceat(vx**2, bounds)).sum(axis=1) / 2
        return self.w0 + np.add.reduceat(self.w[at] * x, bounds) + pairs, sums

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        if not self.fitted:
            return np.full(len(rows), 0.5)
        lengths = np.array([len(a) for a, _ in rows])
        raw, _ = self.raw(np.concatenate([a for a, _ in rows]), np.concatenate([x for _, x in rows]), np.cumsum(lengths) - lengths)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, batch: int = 128, seed: int = SEED) -> Machine:
        rng = np.random.default_rng(seed)
        gw, gv, g0 = np.full_like(self.w, 1e-2), np.full_like(self.v, 1e-2), 1e-2
        share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
        self.w0 = float(np.log(share / (1 - share)))
        for _ in range(max(EPOCHS, -(-STEPS * batch // max(1, len(rows))))):
            order = rng.permutation(len(rows))
            for low in range(0, len(order), batch):
                own = order[low : low + batch]
                lengths = np.array([len(rows[i][0]) for i in own])
                at, x = np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own]).astype(np.float32)
                raw, sums = self.raw(at, x, np.cumsum(lengths) - lengths)
                error = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[own]) / len(own)).astype(np.float32)
                e = np.repeat(error, lengths)
                used, back = np.unique(at, return_inverse=True)
                dw = np.bincount(back, e * x) + 1e-5 * self.w[used]
                dv_rows = (e * x)[:, None] * (np.repeat(sums, lengths, axis=0) - self.v[at] * x[:, None])
                dv = np.stack([np.bincount(back, dv_rows[:, f]) for f in range(RANK)], axis=1) + 1e-4 * self.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                g0 += float(error.sum()) ** 2
                self.w[used] -= (RATE * dw / np.sqrt(gw[used])).astype(np.float32)
                self.v[used] -= (RATE * dv / np.sqrt(gv[used])).astype(np.float32)
                self.w0 -= RATE * float(error.sum()) / float(np.sqrt(g0))
        self.fitted = len(rows) > 0
        return self


def labelled(docs: DataFrame, labels: DataFrame, usable: Column, label: str, most: int, id_col: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """h, id, y, t: rows of docs with a usable label, of the ``most`` ids of smallest seeded hash h; one label an id.

    Where ids repeat in docs these are more than ``most`` rows: who gathers them takes the ``most`` first by h.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & usable).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    chosen = rows.withColumn("h", F.xxhash64(F.lit(seed), "id")).orderBy("h", "id").limit(most)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t"))
    return texts.join(F.broadcast(chosen), "id").select("h", "id", "y", "t")


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", id_col: str = "doc_id", text: str = "text") -> Machine:
    """usable: condition on the label table's rows that may be learnt from."""
    prepared(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t) for t in texts_of(b.column(3))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([a.astype(np.int32).tobytes() for a, _ in got], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in got], pa.binary())], names=["h", "id", "y", "at", "x"])

    rows = labelled(docs, labels, usable, label, LABELLED, id_col, text).mapInArrow(run, "h long, id long, y int, at binary, x binary")
    got = rows.orderBy("h", "id", "at", "x").limit(LABELLED).toArrow()
    examples = [(np.frombuffer(a, np.int32).astype(np.int64), np.frombuffer(x, np.float32)) for a, x in zip(got["at"].to_pylist(), got["x"].to_pylist(), strict=True)]
    return Machine().fit(examples, np.array(got["y"].to_pylist(), np.float64))


def score(docs: DataFrame, machine: Machine, text: str = "text", out: str = "score") -> DataFrame:
    """The input's other columns and ``out``."""
    spark = prepared(docs)
    refuse(docs, out)
    rest = [c for c in docs.columns if c != text]
    sent = spark.sparkContext.broadcast(machine)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            texts = texts_of(b.column(0))
            found = np.concatenate([m.score([features(t) for t in texts[low : low + 200]]) for low in range(0, len(texts), 200)]) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(found, pa.float64())], names=[*rest, out])

    return docs.select(F.col(f"`{text}`"), *(F.col(f"`{c}`") for c in rest)).mapInArrow(run, T.StructType([docs.schema[c] for c in rest] + [T.StructField(out, T.DoubleType())]))
