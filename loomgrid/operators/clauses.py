"""Lexical search by clauses: words, "phrases", +required and -excluded ones, each in one field or in all.

A query is a list of clauses: ``word``, ``"some words"``, ``+clause``, ``-clause``, ``field:clause``; a backslash takes the next
character as it is. Clauses are matched on the places of terms, which a stored index keeps beside its postings. A place is the
number of a run of letters and digits; an identifier and its parts share one.

Defined results: a word without a sign finds any of its parts; a phrase, a required or an excluded clause means its runs as
written, one after another. With a required clause the others only add to the score; without one, any clause without a sign must
match; only excluded clauses find nothing. A phrase scores like a word that occurs as often, with the sum of its terms' inverse
frequencies. Each distinct sequence counts once. Clauses without letters or digits say nothing. Null texts are empty ones. Open
quotes, a sign or field without a clause, other fields, parentheses and the words AND, OR, NOT are a ``QueryError``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .search import K1, B
from .store import Store

CLAUSE = re.compile(r'([+-]?)(?:([A-Za-z_]+):)?(?:"((?:[^"\\]|\\.)*)"|((?:[^\s"\\()]|\\.)+))(?=\s|$)')
Sequence = tuple[str, ...]


class QueryError(ValueError):
    """The query cannot be read."""


@dataclass(frozen=True)
class Clause:
    """sign: '+' required, '-' excluded, '' neither. field: None for all."""

    text: str
    sign: str = ""
    field: str | None = None
    phrase: bool = False

    @property
    def plain(self) -> bool:
        return not (self.sign or self.field or self.phrase)


def parse(query: str, fields: tuple[str, ...]) -> list[Clause]:
    out, left = [], query.strip()
    while left:
        m = CLAUSE.match(left)
        if m is None or m[4] in ("AND", "OR", "NOT", "+", "-") or (m[4] or "").endswith(":"):
            raise QueryError(f"cannot read {left!r}")
        if m[2] is not None and m[2] not in fields:
            raise QueryError(f"{m[2]!r} is no field; known: {', '.join(fields)}")
        body = m[3] if m[3] is not None else m[4]
        out.append(Clause(re.sub(r"\\(.)", r"\1", body), m[1], m[2], m[3] is not None))
        left = left[m.end() :].lstrip()
    return out


@dataclass(frozen=True)
class _Asked:
    """What a clause means: sequences of terms, of which one must occur in one of the fields."""

    sign: str
    sequences: tuple[Sequence, ...]
    fields: tuple[str, ...]


def _asked(chunks: DataFrame, clauses: list[Clause], analyse: Callable[[Column], Column], fields: tuple[str, ...]) -> list[_Asked]:
    if not clauses:
        return []
    rows = chunks.sparkSession.range(1).select(*(T.placed(F.lit(c.text), analyse).alias(f"c{i}") for i, c in enumerate(clauses))).first()
    out = []
    for c, terms in zip(clauses, rows, strict=True):
        if c.phrase or c.sign:
            whole: dict[int, str] = {}
            for t in terms:
                whole.setdefault(t["place"], t["term"])
            sequences = [tuple(whole.values())] if whole else []
        else:
            sequences = sorted({(t["term"],) for t in terms})
        if sequences:
            out.append(_Asked(c.sign, tuple(sequences), (c.field,) if c.field else fields))
    return out


def _occurrences(sequence: Sequence, places: list[Column]) -> Column:
    """How often the terms follow one another, from the places of each."""
    if len(sequence) == 1:
        return F.size(places[0])
    return F.size(reduce(F.array_intersect, [_back(p, i) for i, p in enumerate(places)]))


def _back(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def _places_of(words: Column, term: str) -> Column:
    return F.transform(F.filter(words, lambda w: w["term"] == term), lambda w: w["place"])


def search(chunks: DataFrame, clauses: list[Clause], boosts: dict[str, float], analyse: Callable[[Column], Column], index: Store | None = None) -> DataFrame:
    """id, score of the chunks that the clauses find. index: a stored version with the same chunks; no text is read then."""
    fields = list(boosts)
    asked = _asked(chunks, clauses, analyse if index is None else index.analyse, tuple(fields))
    if all(a.sign == "-" for a in asked):
        return chunks.sparkSession.createDataFrame([], "id long, score double")
    pairs = sorted({(t, f) for a in asked for s in a.sequences for t in s for f in a.fields})
    number = {p: i for i, p in enumerate(pairs)}
    rows, n, means, df = _stored(index, pairs, fields) if index is not None else _scanned(chunks, pairs, fields, analyse)

    def tf(sequence: Sequence, f: str) -> Column:
        return F.col(f"tf_{counted[sequence, f]}")

    counted: dict[tuple[Sequence, str], int] = {}
    for a in asked:
        for s in a.sequences:
            for f in a.fields:
                counted.setdefault((s, f), len(counted))
    places = {p: F.coalesce(F.col(f"p{i}"), F.array().cast("array<int>")) for p, i in number.items()}
    rows = rows.select("id", *(f"dl_{f}" for f in fields), *(_occurrences(s, [places[t, f] for t in s]).alias(f"tf_{i}") for (s, f), i in counted.items()))

    def found(a: _Asked) -> Column:
        return reduce(lambda x, y: x | y, [tf(s, f) > 0 for s in a.sequences for f in a.fields])

    required, other = [a for a in asked if a.sign == "+"], [a for a in asked if a.sign == ""]
    keep = reduce(lambda x, y: x & y, map(found, required)) if required else reduce(lambda x, y: x | y, map(found, other))
    for a in asked:
        if a.sign == "-":
            keep = keep & ~found(a)
    score = F.lit(0.0)
    for s, f in sorted({(s, f) for a in asked if a.sign != "-" for s in a.sequences for f in a.fields}):
        rare = sum(math.log(1 + (n - df.get((t, f), 0) + 0.5) / (df.get((t, f), 0) + 0.5)) for t in s)
        length = F.coalesce(F.col(f"dl_{f}"), F.lit(0))
        score = score + boosts[f] * rare * tf(s, f) * (K1 + 1) / (tf(s, f) + K1 * (1 - B + B * length / (means.get(f) or 1.0)))
    return rows.where(keep).select("id", score.alias("score"))


def _stored(index: Store, pairs: list[tuple[str, str]], fields: list[str]):
    """One row for each chunk that holds one of the terms: one shuffle, of these terms' places alone."""
    df = {(r["term"], r["field"]): r["df"] for r in index.terms(sorted({t for t, _ in pairs})).collect()}
    these = [(F.col("term") == t) & (F.col("field") == f) for t, f in pairs]
    blocks = index.of_segments("blocks").where(reduce(lambda a, b: a | b, these))
    places = blocks.select("term", "field", "segment", F.inline(F.arrays_zip("postings", "places"))).select("term", "field", "segment", "postings.id", "postings.dl", "places")
    columns = [F.max(F.when(c, F.col("places"))).alias(f"p{i}") for i, c in enumerate(these)]
    lengths = [F.max(F.when(F.col("field") == f, F.col("dl"))).alias(f"dl_{f}") for f in fields]
    return index.live(places, "id").groupBy("segment", "id").agg(*columns, *lengths), index.meta["n"], index.meta["means"], df


def _scanned(chunks: DataFrame, pairs: list[tuple[str, str]], fields: list[str], analyse: Callable[[Column], Column]):
    """One row a chunk, from its texts; counts and lengths are one aggregation before."""

    def of_field(f: str) -> Column:
        words = F.array(T.placed(F.coalesce(F.col(f), F.lit("")), analyse))
        mine = [(i, t) for i, (t, g) in enumerate(pairs) if g == f]
        return F.transform(words, lambda ws: F.struct(F.size(ws).alias(f"dl_{f}"), *(_places_of(ws, t).alias(f"p{i}") for i, t in mine)))[0]

    rows = chunks.select(F.col("chunk_id").alias("id"), *(of_field(f).alias(f"_{f}") for f in fields)).select("id", *(f"_{f}.*" for f in fields))
    sums = [F.count(F.lit(1)).alias("n"), *(F.avg(f"dl_{f}").alias(f"mean_{f}") for f in fields)]
    sums += [F.count(F.when(F.size(f"p{i}") > 0, 1)).alias(f"df{i}") for i in range(len(pairs))]
    told = rows.agg(*sums).first()
    return rows, told["n"], {f: told[f"mean_{f}"] for f in fields}, {p: told[f"df{i}"] for i, p in enumerate(pairs)}
