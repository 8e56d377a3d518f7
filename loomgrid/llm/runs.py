"""Periodic runs of words, found in a grammar of each text.

A run is a stretch of words with smallest period q (words q apart are equal) and length >= max(6, 4 q) that no neighbouring
word extends. Each text's word ids are replaced by a Re-Pair grammar: again and again, pairs that occur twice or more in the
text get a rule, the more frequent ones (by the power of two) first where occurrences overlap. What is left is paired
neighbour by neighbour up to one start symbol, so every text is one binary derivation tree.

A run lies in a lowest tree node that holds it whole, and crosses the boundary between that node's two children. So for each
rule, once, at one of its occurrences, the runs across its boundary are computed: of a run of length 4 q, at least 2 q words
lie on one side, so the period is seen as an equality of words next to the boundary; equal stretches are then extended both
ways with prefix hashes (two primes). The rules' runs are translated to all places where the derivations use the rule, and
intervals of one period that overlap by a period are merged; what a rule's end cut short is covered by the rule above it.
Of intervals that agree in both ends the smallest period stays.

Texts are worked on in lots, as arrays; symbols are never shared between texts. Memory is some hundred bytes a word of a
lot or of its longest text.

Defined results: null and empty texts and texts without words have no runs and an empty collapsed text; texts are read whole,
however long; repeated rows, and rows that share an id or have none, get results of their own each; empty tables give
empty results; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepared
from .common import texts_of

#: Least length of a run, in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Equality tests, and bytes of text, that are worked on together; a longer text is worked on alone.
TESTS, LOT_BYTES = 1 << 19, 1 << 20
#: Primes and bases of the prefix hashes.
HASHES = ((2147483647, 1_000_003), (2147483629, 998_244_353))
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


@dataclass
class Grammar:
    """Rule r, of symbol ``first + r``, is (left[r], right[r]); it derives the words from ``at[r]`` on. size is by symbol.

    rounds: ends of the groups of rules that do not depend on each other. starts: each text's symbol and place.
    """

    first: int
    left: np.ndarray
    right: np.ndarray
    at: np.ndarray
    size: np.ndarray
    rounds: list[int]
    starts: tuple[np.ndarray, np.ndarray]


def _twice(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs at ``at`` those that occur twice or more: places, distinct pairs, number of the own pair, its count."""
    key = s[at] << 31 | s[at + 1]
    bits = max(10, int(len(at)).bit_length())
    slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    may = np.bincount(slot.astype(np.int64), minlength=1 << bits)[slot.astype(np.int64)] > 1
    at, key = at[may], key[may]
    pairs, own, count = np.unique(key, return_inverse=True, return_counts=True)
    keep = count[own] > 1
    return at[keep], pairs, own[keep], count[own[keep]]


def _chosen(at: np.ndarray, pairs: np.ndarray, own: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places in ``at`` that get replaced: no two overlap, and each pair is replaced twice at least."""
    n = len(at)
    rank = (np.log2(count).astype(np.uint64) << np.uint64(58)) | ((pairs[own].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(6))
    touches = np.r_[False, at[1:] == at[:-1] + 1]
    head = ~touches | np.r_[True, own[1:] != own[:-1]]
    # a stretch of one pair, as in a a a a, is replaced at every other place
    stretch = np.cumsum(head) - 1
    begin = np.flatnonzero(head)
    end = np.r_[begin[1:], n] - 1
    low = np.uint64(0)
    before = np.where(touches[begin], rank[begin - 1], low)
    after = np.where(np.r_[touches[1:], False][end], rank[np.minimum(end + 1, n - 1)], low)
    wins = (rank[begin] > before) & (rank[begin] > after)
    take = wins[stretch] & ((np.arange(n) - begin[stretch]) % 2 == 0)
    return np.flatnonzero(take & (np.bincount(own[take], minlength=len(pairs))[own] > 1))


def grammar(words: np.ndarray, text: np.ndarray, n_symbols: int) -> Grammar:
    """The grammar of all texts. words: symbols under ``n_symbols``, none of them in two texts. text: each word's text."""
    s, t, place = words.astype(np.int64), text, np.arange(len(words))
    left, right, at_, sizes, rounds, top = [], [], [], [np.ones(n_symbols, np.int64)], [], n_symbols
    size = sizes[0]

    def add(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        nonlocal top, size
        new = np.arange(top, top + len(a))
        left.append(a), right.append(b), at_.append(at)
        size = np.concatenate([size, size[a] + size[b]])
        top += len(a)
        rounds.append(top - n_symbols)
        return new

    live = np.ones(len(s), bool)
    while len(s) > 1:
        at, pairs, own, count = _twice(s, np.flatnonzero(live[:-1]))
        pick = _chosen(at, pairs, own, count) if len(at) else at
        if not len(pick):
            break
        live = np.zeros(len(s), bool)
        live[at] = True
        used, which = np.unique(own[pick], return_index=True)
        number = np.zeros(len(pairs), np.int64)
        number[used] = add(pairs[used] >> 31, pairs[used] & 0x7FFFFFFF, place[at[pick[which]]])
        put = at[pick]
        s[put] = number[own[pick]]
        live[put] = True
        live[np.maximum(put - 1, 0)] = True
        stay = np.ones(len(s), bool)
        stay[put + 1] = False
        # the symbol before a removed one is the new one, so its pair is looked at again
        s, t, place, live = s[stay], t[stay], place[stay], live[stay]
    while True:
        head = np.r_[True, t[1:] != t[:-1]] if len(t) else np.zeros(0, bool)
        if head.all():
            break
        begin = np.flatnonzero(head)
        odd = (np.arange(len(t)) - begin[np.cumsum(head) - 1]) % 2 == 1
        put = np.flatnonzero(odd) - 1
        s[put] = add(s[put], s[put + 1], place[put])
        s, t, place = s[~odd], t[~odd], place[~odd]
    none = [np.zeros(0, np.int64)]
    return Grammar(n_symbols, *(np.concatenate(none + x) for x in (left, right, at_)), size, rounds, (s, place))


class _Equal:
    """How far two places of the words agree, forwards and backwards, by prefix hashes."""

    def __init__(self, words: np.ndarray):
        rng = np.random.default_rng(12)
        n = len(words)
        self.parts = []
        for prime, base in HASHES:
            value = rng.integers(1, prime, int(words.max()) + 1 if n else 1)[words]
            power = np.ones(n + 1, np.int64)
            done = 1
            while done <= n:
                more = min(done, n + 1 - done)
                power[done : done + more] = power[:more] * pow(base, done, prime) % prime
                done += more
            self.parts.append((prime, power, np.concatenate([[0], np.cumsum(value * power[:n] % prime) % prime])))

    def _same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.ones(len(i), bool)
        for prime, power, upto in self.parts:
            out &= (upto[i + length] - upto[i]) % prime * power[j - i] % prime == (upto[j + length] - upto[j]) % prime
        return out

    def _longest(self, most: np.ndarray, same) -> np.ndarray:
        low, high = np.zeros(len(most), np.int64), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            ok = same(middle)
            low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
        return low

    def after(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and from j on (i < j)."""
        return self._longest(most, lambda m: self._same(i, j, m))

    def before(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words that end before i and before j (i < j)."""
        return self._longest(most, lambda m: self._same(i - m, j - m, m))


def _tests(many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, number from 1 on) for ``many[owner]`` tests of each owner, in slices; an owner's tests may be several slices."""
    ends = np.cumsum(many)
    total = int(ends[-1]) if len(many) else 0
    for begin in range(0, total, TESTS):
        number = np.arange(begin, min(begin + TESTS, total))
        first, last = np.searchsorted(ends, (number[0], number[-1]), "right")
        inside = ends[first : last + 1]
        owner = np.repeat(np.arange(first, last + 1), np.diff(np.minimum(np.r_[begin, inside], number[-1] + 1)))
        yield owner, number - (ends - many)[owner] + 1


def boundary_runs(words: np.ndarray, g: Grammar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs across the boundary of each rule, once a rule: rule, start and end in the words, smallest period."""
    rule = np.flatnonzero(g.size[g.first :] >= LEAST_WORDS)
    low = g.at[rule]
    mid, high = low + g.size[g.left[rule]], low + g.size[g.first + rule]
    most = (high - low) // LEAST_PERIODS
    equal = None
    found = []
    for right in (True, False):
        for k, q in _tests(np.minimum((high - mid if right else mid - low) // 2, most)):
            m = mid[k]
            near = words[m] == words[m + q] if right else words[m - 1] == words[m - 1 - q]
            k, q, m = k[near], q[near], m[near]
            near = words[m + q - 1] == words[m + 2 * q - 1] if right else words[m - q] == words[m - 2 * q]
            k, q, m = k[near], q[near], m[near]
            if not len(k):
                continue
            equal = equal or _Equal(words)
            i = m if right else m - q
            begin = i - equal.before(i, i + q, i - low[k])
            end = i + q + equal.after(i, i + q, high[k] - i - q)
            ok = (begin < m) & (end > m) & (end - begin >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q))
            found.append(np.stack([rule[k[ok]], begin[ok], end[ok], q[ok]]))
    return _least_period(*np.concatenate([np.zeros((4, 0), np.int64), *found], axis=1))


def _least_period(*rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of rows that agree in all but the last column the one where it is least."""
    order = np.lexsort(rows[::-1])
    rows = [r[order] for r in rows]
    new = np.ones(len(rows[0]), bool)
    new[1:] = np.any([r[1:] != r[:-1] for r in rows[:-1]], axis=0)
    return tuple(r[new] for r in rows)


def _uses(g: Grammar, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rules with ``wanted`` at all places of the derivations: rule, place."""
    below = np.zeros(len(g.size), bool)
    below[g.first :][wanted] = True
    begin = 0
    for end in g.rounds:
        below[g.first + begin : g.first + end] |= below[g.left[begin:end]] | below[g.right[begin:end]]
        begin = end
    own = np.zeros(len(g.left), bool)
    own[wanted] = True
    symbol, place = g.starts
    rules, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while True:
        keep = below[symbol]
        rule, place = symbol[keep] - g.first, place[keep]
        if not len(rule):
            return np.concatenate(rules), np.concatenate(places)
        rules.append(rule[own[rule]])
        places.append(place[own[rule]])
        symbol, place = np.concatenate([g.left[rule], g.right[rule]]), np.concatenate([place, place + g.size[g.left[rule]]])


def all_runs(words: np.ndarray, text: np.ndarray, n_symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All maximal runs: start, end, period, by start and period. Places count through all texts."""
    g = grammar(words, text, n_symbols)
    rule, begin, end, q = boundary_runs(words, g)
    if not len(rule):
        return rule, rule, rule
    used, first, many = np.unique(rule, return_index=True, return_counts=True)
    at_rule, place = _uses(g, used)
    row = np.searchsorted(used, at_rule)
    times = many[row]
    pick = np.repeat(first[row] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    move = np.repeat(place - g.at[at_rule], times)
    begin, end, q = begin[pick] + move, end[pick] + move, q[pick]
    order = np.lexsort((end, begin, q))
    begin, end, q = begin[order], end[order], q[order]
    span = np.int64(len(words) + 1)
    reach = np.maximum.accumulate(end + q * span) - q * span
    new = np.r_[True, (q[1:] != q[:-1]) | (begin[1:] > reach[:-1] - q[1:])]
    at = np.flatnonzero(new)
    begin, end, q = _least_period(begin[at], reach[np.r_[at[1:], len(q)] - 1], q[at])
    order = np.lexsort((q, begin))
    return begin[order], end[order], q[order]


def _lots(texts: list[bytes]) -> Iterator[list[bytes]]:
    own, held = [], 0
    for t in texts:
        if own and held + len(t) > LOT_BYTES:
            yield own
            own, held = [], 0
        own.append(t)
        held += len(t)
    if own:
        yield own


def _batch(texts: list[bytes]) -> tuple[list[list[dict]], list[bytes]]:
    """Runs and collapsed text of each text."""
    split = [_WORDS.findall(t) for t in texts]
    ids: list[int] = []
    base = 0
    for words in split:
        own: dict[bytes, int] = {}
        ids += [own.setdefault(w, base + len(own)) for w in words]
        base += len(own)
    lengths = np.array([len(w) for w in split], np.int64)
    offset = np.concatenate([[0], np.cumsum(lengths)])
    symbols = np.array(ids, np.int64)
    begin, end, q = all_runs(symbols, np.repeat(np.arange(len(split)), lengths), base)
    step = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(step, begin + q, 1)
    np.add.at(step, end, -1)
    keep = np.cumsum(step[:-1]) == 0
    owner = np.searchsorted(offset, begin, "right") - 1
    runs: list[list[dict]] = [[] for _ in split]
    for i, b, e, p in zip(owner.tolist(), begin.tolist(), end.tolist(), q.tolist(), strict=True):
        runs[i].append({"start": b - int(offset[i]), "length": e - b, "period": p})
    collapsed = []
    for i, words in enumerate(split):
        mine = keep[offset[i] : offset[i + 1]]
        collapsed.append(b" ".join(words if not runs[i] else [w for w, k in zip(words, mine.tolist(), strict=True) if k]))
    return runs, collapsed


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row an input row: the id, runs (by start and period) and collapsed: the text without what repeats a run's first period."""
    prepared(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs, collapsed = [], []
            for lot in _lots(texts_of(b.column(1))):
                some = _batch(lot)
                runs += some[0]
                collapsed += some[1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(runs, _RUNS), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["id", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(run, f"id {kind}, runs {RUNS}, collapsed string").withColumnRenamed("id", id_col)
