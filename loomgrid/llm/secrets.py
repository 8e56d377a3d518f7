"""Secret scans by one combined deterministic automaton.

All rules' regular expressions become one non-deterministic automaton, then by subset construction and minimisation
one deterministic automaton over byte classes whose states carry the set of rules that accept there. A batch of texts
is scanned in a single byte pass for all rules: texts are cut into lanes at bytes that lead every state back to the
start, and all lanes step through the transition array together.

The pass yields where matches end. A small reverse automaton for the rule finds the leftmost start of a reported end,
a forward one extends it to the longest end, and the next match of the rule begins after it. A rule's value
(its last group) can have a least length, tested on the match found.

Defined results: a null text counts as empty, an empty text has no spans; offsets are code points; repeated rows and
null ids are rows like others; very long texts are scanned whole; the input's other columns pass through, but one named
like the result is an error; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import prepared
from .common import refuse, texts_of


@dataclass(frozen=True)
class Rule:
    """One kind of secret. No match of a rule may start before and end after another match of the same rule begins and
    ends (a match is found by the first end that is reported).

    kind; pattern of literals, classes, groups, ``|`` and ``? * + {m} {m,} {m,n}``; least length of the last group and of the match.

    Lengths are tested on matches, as counters in the pattern multiply the automaton's states. A pattern that nearly
    any text matches for a few bytes should count itself all the same.
    """

    kind: str
    pattern: str
    least: int = 0
    least_whole: int = 0


def either_case(words: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in words)


#: The base rules.
BASE = (
    Rule("assign", "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    Rule("access", "AKIA[A-Z0-9]+", least_whole=20),
    Rule("hex", "[0-9a-f]{24,}"),
)
MORE = (
    Rule("forge", "gh[pousr]_[A-Za-z0-9]+", least_whole=24),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", least_whole=15),
    Rule("private_key", r"-----BEGIN ([A-Z]+ )?PRIVATE KEY-----"),
)

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


class _Nfa:
    """States with edges on byte sets and empty edges."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


class _Reader:
    """Reads a pattern and builds its states; ``backwards`` builds those of the reversed language."""

    def __init__(self, nfa: _Nfa, pattern: str, backwards: bool = False):
        self.nfa, self.p, self.i, self.backwards = nfa, pattern, 0, backwards

    def build(self) -> tuple[int, int]:
        node = self._either()
        if self.i != len(self.p):
            raise ValueError(f"cannot read {self.p[self.i :]!r}")
        return self._states(node)

    def _either(self):
        options = [self._sequence()]
        while self.p[self.i : self.i + 1] == "|":
            self.i += 1
            options.append(self._sequence())
        return ("either", options)

    def _sequence(self):
        parts = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            item = self._item()
            while m := re.compile(r"[?*+]|\{(\d+)(,?)(\d*)\}").match(self.p, self.i):
                self.i = m.end()
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(m[0]) or (int(m[1]), int(m[3]) if m[3] else None if m[2] else int(m[1]))
                item = ("repeat", item, low, high)
            parts.append(item)
        return ("sequence", parts)

    def _item(self):
        c = self.p[self.i]
        self.i += 1
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            node = self._either()
            self.i += 1
            return node
        if c == "[":
            return ("bytes", self._klass())
        return ("bytes", frozenset([self._escaped() if c == "\\" else ord(c)]))

    def _escaped(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def _klass(self) -> frozenset[int]:
        out: set[int] = set()
        negated = self.p[self.i] == "^"
        self.i += negated
        while (c := self.p[self.i]) != "]":
            self.i += 1
            low = self._escaped() if c == "\\" else ord(c)
            high = low
            if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                c = self.p[self.i]
                self.i += 1
                high = self._escaped() if c == "\\" else ord(c)
            out |= set(range(low, high + 1))
        self.i += 1
        return frozenset(set(range(255)) - out if negated else out)

    def _states(self, node) -> tuple[int, int]:
        n, kind = self.nfa, node[0]
        a, z = n.state(), n.state()
        if kind == "bytes":
            n.edges[a].append((node[1], z))
        elif kind == "either":
            for option in node[1]:
                s, e = self._states(option)
                n.empty[a].append(s)
                n.empty[e].append(z)
        elif kind == "sequence":
            at = a
            for part in reversed(node[1]) if self.backwards else node[1]:
                s, e = self._states(part)
                n.empty[at].append(s)
                at = e
            n.empty[at].append(z)
        else:
            _, inner, low, high = node
            at = a
            for _ in range(low):
                s, e = self._states(inner)
                n.empty[at].append(s)
                at = e
            if high is None:
                s, e = self._states(inner)
                n.empty[at] += [s, z]
                n.empty[e] += [s, z]
            else:
                n.empty[at].append(z)
                for _ in range(high - low):
                    s, e = self._states(inner)
                    n.empty[at].append(s)
                    n.empty[e].append(z)
                    at = e
        return a, z


class Automaton:
    """table[state, class of byte] -> state; accepts[state]: bit set of rules; state 0 is the start.

    dead: the state that nothing leaves, for an anchored automaton; -1 otherwise.
    """

    def __init__(self, patterns: list[str], anchored: bool = False, backwards: bool = False):
        nfa = _Nfa()
        ends: dict[int, int] = {}
        starts = []
        for i, p in enumerate(patterns):
            a, z = _Reader(nfa, p, backwards).build()
            starts.append(a)
            ends[z] = 1 << i
        marks = np.zeros((256, sum(map(len, nfa.edges))), bool)
        for k, (on, _) in enumerate(e for edges in nfa.edges for e in edges):
            marks[list(on), k] = True
        _, first, klass = np.unique(marks, axis=0, return_index=True, return_inverse=True)
        self.klass = klass.reshape(-1).astype(np.uint8)
        # sets of states are bit masks; moves[s][c] is what state s reaches by a byte of class c
        mask = [sum(1 << t for t in nfa.closure([s])) for s in range(len(nfa.edges))]
        moves = [[0] * len(first) for _ in nfa.edges]
        for s, edges in enumerate(nfa.edges):
            for on, t in edges:
                for c, byte in enumerate(first.tolist()):
                    if byte in on:
                        moves[s][c] |= mask[t]
        useful = sum(1 << s for s in range(len(nfa.edges)) if nfa.edges[s] or s in ends)
        mask = [m & useful for m in mask]
        moves = [[m & useful for m in row] for row in moves]
        start = 0
        for s in starts:
            start |= mask[s]
        always = 0 if anchored else start
        number, table, todo, accepts = {start: 0}, [], [start], []
        for states in todo:
            row, accepted, left = [always] * len(first), 0, states
            while left:
                s = (left & -left).bit_length() - 1
                left &= left - 1
                accepted |= ends.get(s, 0)
                row = list(map(int.__or__, row, moves[s]))
            for to in row:
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
            table.append([number[to] for to in row])
            accepts.append(accepted)
        self._minimise(np.array(table), np.array(accepts))
        self.dead = -1
        if anchored:
            stuck = [s for s in range(len(self.table)) if not self.accepts[s] and (self.table[s] == s).all()]
            self.dead = stuck[0] if stuck else -1

    def _minimise(self, table: np.ndarray, accepts: np.ndarray) -> None:
        """Moore's refinement: states stay together while their blocks' transitions agree."""
        _, block = np.unique(accepts, return_inverse=True)
        while True:
            _, first, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_index=True, return_inverse=True)
            finer = finer.reshape(-1)
            if len(first) == block.max() + 1:
                break
            block = finer
        order = np.argsort(first)  # the start state comes first
        name = np.empty(len(first), np.int64)
        name[order] = np.arange(len(first))
        self.table = name[finer[table[first[order]]]].astype(np.uint16)
        self.accepts = accepts[first[order]].astype(np.uint32)

    def longest(self, data: bytes, at: int, step: int, stop: int) -> int:
        """Anchored run from ``at``: the farthest position with acceptance, or -1. step -1 reads backwards."""
        rows, klass, accepts, dead = self.rows, self.lookup, self.accepting, self.dead
        state, best = 0, -1
        while at != stop:
            state = rows[state][klass[data[at if step > 0 else at - 1]]]
            if state == dead:
                break
            at += step
            if accepts[state]:
                best = at
        return best

    def ready(self) -> Automaton:
        self.rows, self.lookup, self.accepting = self.table.tolist(), self.klass.tolist(), self.accepts.tolist()
        return self


LANE = 1024


class Scanner:
    """The combined automaton of all rules, with each rule's forward and reverse automata."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.all = Automaton([r.pattern for r in rules])
        self.forward = [Automaton([r.pattern], anchored=True).ready() for r in rules]
        self.reverse = [Automaton([r.pattern], anchored=True, backwards=True).ready() for r in rules]
        self.resets = (self.all.table == 0).all(axis=0)[self.all.klass]
        self.values = [re.compile(r.pattern.encode()) if r.least else None for r in rules]

    def ends(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One pass over bytes that end in a reset byte: positions behind accepting bytes, and their rule sets."""
        resets = np.flatnonzero(self.resets[data])
        cuts = np.unique(np.searchsorted(resets, np.arange(LANE, len(data) + LANE, LANE)).clip(max=len(resets) - 1))
        bounds = np.concatenate([[0], resets[cuts] + 1])
        starts, lengths = bounds[:-1], np.diff(bounds)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        classes = self.all.klass[data]
        width = self.all.table.shape[1]
        table = (self.all.table.astype(np.int32) * width).reshape(-1)
        accepts = self.all.accepts
        accepting = accepts != 0
        state = np.zeros(len(starts), np.int32)
        active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left") if len(lengths) else []
        at, got = [], []
        for i, n in enumerate(active):
            state = table[state[:n] + classes[starts[:n] + i]]
            if (hit := np.flatnonzero(accepting[state // width])).size:
                at.append(starts[hit] + i + 1)
                got.append(accepts[state[hit] // width])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        at, got = np.concatenate(at), np.concatenate(got)
        order = np.argsort(at)
        return at[order], got[order]

    def spans(self, texts: list[bytes]) -> list[list[dict]]:
        joined = b"\xff".join(texts) + b"\xff"
        data = np.frombuffer(joined, np.uint8)
        at, got = self.ends(data)
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        where = np.searchsorted(offsets, at, side="left") - 1
        out: list[list[dict]] = [[] for _ in texts]
        for doc in np.unique(where).tolist():
            low, high = np.searchsorted(where, [doc, doc + 1])
            out[doc] = self._located(texts[doc], at[low:high] - offsets[doc], got[low:high])
        return out

    def _located(self, text: bytes, at: np.ndarray, got: np.ndarray) -> list[dict]:
        found = []
        for k, rule in enumerate(self.rules):
            ends = at[(got >> k & 1).astype(bool)].tolist()
            done, i = 0, 0
            while i < len(ends):
                start = self.reverse[k].longest(text, ends[i], -1, done)
                if start < 0:
                    i += 1
                    continue
                end = self.forward[k].longest(text, start, 1, len(text))
                value = self.values[k].fullmatch(text, start, end) if rule.least else None
                if end - start >= rule.least_whole and (not rule.least or len(value[value.re.groups]) >= rule.least):
                    found.append((start, k, end))
                done, i = end, bisect.bisect_right(ends, end)
        if not found:
            return []
        points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        return [{"kind": self.rules[k].kind, "start": int(points[s]), "end": int(points[e])} for s, k, e in sorted(found)]


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE + MORE, out: str = "spans") -> DataFrame:
    """The input's other columns and ``out``: array of (kind, start, end) by start, then by the rules' order."""
    prepared(docs)
    refuse(docs, out)
    rest = [c for c in docs.columns if c != text]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(out, SPAN)])
    scanner = Scanner(rules)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            spans = pa.array(scanner.spans(texts_of(b.column(0))), kind)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], spans], names=[*rest, out])

    return docs.select(F.col(f"`{text}`"), *(F.col(f"`{c}`") for c in rest)).mapInArrow(run, schema)
