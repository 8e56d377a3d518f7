"""The trie of conversation prefixes, by z-fast tries inside tasks whose nodes are merged by prefix hash.

A conversation is the sequence of its turns (role, text); a node of the trie is a distinct sequence of first turns, the root
is the textless one. Every turn becomes a 128-bit hash with its place, and the exclusive or of those so far is the prefix's
hash, so prefixes of conversations in different tasks meet by value and texts are never carried along.

In a task a compacted trie takes conversations in batches. A compacted node has an extent (a path and its depth) and is
found by its handle: the prefix hash at the two-fattest depth of its edge, the one that is divisible by the largest power
of two. The exit node of a conversation is located by fat binary search over depths, with one hash lookup a step; there the
edge is split or a leaf is hung on. Weights lie at the nodes where conversations end and are summed towards the root when
the edges are expanded to one row a depth. A task gives its trie away and begins another one after ``MOST_NODES`` nodes, so
memory does not grow with the corpus; the rows of all tries are added up by prefix hash in Spark. A first turn of a third of
all conversations is one row a trie there.

Two passes are made. The first counts each node's conversations and finds the smallest one, which owns the node. A
conversation shares with smaller ones a first stretch of its path and owns the rest. The second pass takes these stretches:
a node's saved tokens are the sum over stretches through its subtree, and leaves are counted where the owners of childless
nodes end. Sums over a subtree are linear, so partial tries add up.

Defined results: turns are in order of ``turn`` (null first), then role and text, so ties and repeated turns keep a fixed
order; null roles and texts are empty ones; very long texts count whole; rows without a conv_id belong to no
conversation and are left out; an empty table gives an empty result (the root has members or there is none); extra columns
are not read. A conversation's hashes (20 bytes a turn) are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import prepared, staged
from .common import n_words

#: Compacted nodes of one trie before it is given away.
MOST_NODES = 100_000
#: Children of a node from which on it is looked up by broadcast, and how many such nodes are broadcast at most.
MANY_CHILDREN, MOST_BROADCAST = 5_000, 50_000
#: Bytes of joined ids that are handed on as one piece.
PIECE = 1 << 16
KEY = ["depth", "h1", "h2"]


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that is divisible by the largest power of two."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class ZFastTrie:
    """Compacted trie over paths. A path is its prefix hashes, 16 bytes a depth, and its turns' words.

    Node 0 is the root. Of node v: path[v] and deep[v] are its extent, high[v] is the depth of its parent's.
    """

    def __init__(self, n_weights: int):
        self.n_weights = n_weights
        self.path, self.words = [b""], [np.zeros(0, np.int64)]
        self.deep, self.high, self.parent = [0], [-1], [-1]
        self.weights, self.least = [[0] * n_weights], [None]
        self.handles: dict[bytes, int] = {}
        self.first: dict[bytes, int] = {}

    def __len__(self) -> int:
        return len(self.deep)

    @staticmethod
    def _hash(path: bytes, depth: int) -> bytes:
        return path[16 * depth - 16 : 16 * depth]

    def locate(self, path: bytes) -> tuple[int, int]:
        """Exit node of a path, and the depth up to which they agree."""
        node, low, high = 0, 0, len(path) // 16
        length = high
        while low < high:
            f = two_fattest(low, high)
            v = self.handles.get(self._hash(path, f))
            if v is None:
                high = f - 1
            elif self.deep[v] <= length and self._hash(path, self.deep[v]) == self._hash(self.path[v], self.deep[v]):
                node, low = v, self.deep[v]
            else:
                return v, self._agree(v, path, f, min(self.deep[v], length))
        below = self.first.get(self._hash(path, low + 1)) if low < length else None
        if below is None:
            return node, low
        return below, self._agree(below, path, low + 1, min(self.deep[below], length))

    def _agree(self, v: int, path: bytes, low: int, high: int) -> int:
        other = self.path[v]
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self._hash(path, middle) == self._hash(other, middle) else (low, middle - 1)
        return low

    def _new(self, path: bytes, words: np.ndarray, deep: int, parent: int) -> int:
        v = len(self.deep)
        for store, value in ((self.path, path), (self.words, words), (self.deep, deep), (self.high, self.deep[parent]), (self.parent, parent), (self.weights, [0] * self.n_weights), (self.least, None)):
            store.append(value)
        self._name(v)
        return v

    def _name(self, v: int) -> None:
        self.handles[self._hash(self.path[v], two_fattest(self.high[v], self.deep[v]))] = v
        self.first[self._hash(self.path[v], self.high[v] + 1)] = v

    def _split(self, v: int, depth: int) -> int:
        """A node within the edge to v."""
        del self.handles[self._hash(self.path[v], two_fattest(self.high[v], self.deep[v]))]
        m = self._new(self.path[v], self.words[v], depth, self.parent[v])
        self.parent[v], self.high[v] = m, depth
        self._name(v)
        return m

    def insert(self, path: bytes, words: np.ndarray, weights: list[int], least: int) -> None:
        v, agree = self.locate(path)
        if agree < self.deep[v]:
            v = self._split(v, agree)
        if agree < len(path) // 16:
            v = self._new(path, words.copy(), len(path) // 16, v)
        self.weights[v] = [a + b for a, b in zip(self.weights[v], weights, strict=True)]
        self.least[v] = least if self.least[v] is None else min(least, self.least[v])

    def insert_batch(self, batch: Iterable[tuple[bytes, np.ndarray, list[int], int]]) -> None:
        """Equal paths of a batch are one insertion; paths that share a beginning follow each other."""
        merged: dict[bytes, tuple[np.ndarray, list[int], int]] = {}
        for path, words, weights, least in batch:
            was = merged.get(path)
            merged[path] = (words, weights, least) if was is None else (words, [a + b for a, b in zip(was[1], weights, strict=True)], min(least, was[2]))
        for path in sorted(merged):
            self.insert(path, *merged[path])

    def expand(self) -> Iterator[tuple[int, bytes, bytes, int, list[int], int, int]]:
        """One row a depth of each edge: depth, hash, parent's hash, words, weights and sum of words times first weight in the subtree, least."""
        inside = [0] * len(self)
        for v in sorted(range(1, len(self)), key=lambda x: -self.deep[x]):
            path, words, weights, least = self.path[v], self.words[v], self.weights[v], self.least[v]
            total = inside[v]
            for d in range(self.deep[v], self.high[v], -1):
                total += weights[0] * int(words[d - 1])
                yield d, self._hash(path, d), self._hash(path, d - 1) if d > 1 else bytes(16), int(words[d - 1]), weights, total, least
            p = self.parent[v]
            inside[p] += total
            self.weights[p] = [a + b for a, b in zip(self.weights[p], weights, strict=True)]
            self.least[p] = least if self.least[p] is None else min(least, self.least[p])
        if self.least[0] is not None:
            yield 0, bytes(16), bytes(16), 0, self.weights[0], inside[0], self.least[0]


def _halves(keys: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
    return pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())


def _rows_of(trie: ZFastTrie, names: list[str], least: str) -> Iterator[pa.RecordBatch]:
    got = list(trie.expand())
    for k in range(0, len(got), 10_000):
        some = got[k : k + 10_000]
        weights = [pa.array([r[4][j] for r in some], pa.int64()) for j in range(len(names))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in some], pa.int64()), *_halves([r[1] for r in some]), *_halves([r[2] for r in some]), pa.array([r[3] for r in some], pa.int64()), *weights, pa.array([r[5] for r in some], pa.int64()), pa.array([r[6] for r in some], pa.int64())],
            names=["depth", "h1", "h2", "p1", "p2", "words", *names, "saved", least],
        )


def _tries(paths: DataFrame, weighted, names: list[str]) -> DataFrame:
    """Rows of the tasks' tries. weighted gives the insertions of one conversation: (depth of its end, weights)."""
    held = MOST_NODES

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ZFastTrie(len(names))
        for b in batches:
            h1, h2, words = (c.values.to_numpy(zero_copy_only=False) for c in b.columns[1:4])
            ends = b.column(1).offsets.to_numpy()
            hashes = np.stack([h1[: ends[-1]], h2[: ends[-1]]], axis=1).tobytes()
            batch = []
            for i, (c, *extra) in enumerate(zip(b.column(0).to_pylist(), *(x.to_pylist() for x in b.columns[4:]), strict=True)):
                own = words[ends[i] : ends[i + 1]]
                for depth, weights in weighted(len(own), *extra):
                    batch.append((hashes[16 * ends[i] : 16 * (ends[i] + depth)], own, weights, c))
            trie.insert_batch(batch)
            if len(trie) > held:
                yield from _rows_of(trie, names, "least")
                trie = ZFastTrie(len(names))
        yield from _rows_of(trie, names, "least")

    longs = ["depth", "h1", "h2", "p1", "p2", "words", *names, "saved", "least"]
    return paths.mapInArrow(run, ", ".join(f"{x} long" for x in longs))


def digested(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1 on), t1, t2 (hashes of role and text), words. One row a turn of a named conversation."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = turns.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    hashes = {"t1": F.xxhash64("role", "text"), "t2": F.xxhash64(F.lit("second"), "text", "role")}
    return rows.withColumn("place", F.row_number().over(order)).select("conv_id", "place", *(v.alias(k) for k, v in hashes.items()), n_words(F.col("text")).alias("words"))


def _paths(digests: DataFrame, everyone: DataFrame) -> DataFrame:
    """conv_id, h1, h2, words: arrays over depths."""
    by_place, by_depth = (Window.partitionBy("conv_id").orderBy(c) for c in ("place", "depth"))
    upto = by_depth.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = digests.select("conv_id", F.row_number().over(by_place).alias("depth"), "t1", "t2", "words")
    rows = placed.select("conv_id", "depth", F.xxhash64("depth", "t1", "t2").alias("one"), F.xxhash64("t2", "depth", "t1").alias("two"), "words")
    rolled = rows.select("conv_id", "depth", F.bit_xor("one").over(upto).alias("h1"), F.bit_xor("two").over(upto).alias("h2"), "words")
    told = rolled.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "h1", "h2", "words"))).alias("p"))
    found = everyone.select("conv_id").distinct().join(told, "conv_id", "left")
    none = F.array().cast("array<bigint>")
    return found.select("conv_id", *(F.coalesce(F.col(f"p.{c}").cast("array<bigint>"), none).alias(c) for c in ("h1", "h2", "words")))


def _ends_digest(ends: DataFrame) -> DataFrame:
    """KEY, ends_sha256: SHA-256 of each node's sorted ids, comma-joined.

    Ids are sorted across tasks by range, so those of one node may lie in several; each joins its own to pieces. Pieces, a few
    rows even of a node where a third of all conversations end, are hashed in order.
    """

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, least, own, held = None, None, [], 0

        def row():
            return (*key, least, ",".join(own))

        for b in batches:
            out = []
            for *k, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if k != key or held > PIECE:
                    if own:
                        out.append(row())
                    key, least, own, held = k, c, [], 0
                own.append(str(c))
                held += len(own[-1]) + 1
            yield _batch_of(out)
        if own:
            yield _batch_of([row()])

    def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=[*KEY, "least", "ids"])

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for b in batches:
            out = []
            for *k, ids in zip(*(x.to_pylist() for x in b.columns[:3]), b.column(4).to_pylist(), strict=True):
                if k != key:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            yield _hashed(out)
        if key:
            yield _hashed([(*key, sha.hexdigest())])

    def _hashed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.string() if j == 3 else pa.int64()) for j in range(4)], names=[*KEY, "ends_sha256"])

    by_range = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    joined = by_range.select(*KEY, "conv_id").mapInArrow(pieces, "depth long, h1 long, h2 long, least long, ids string")
    return joined.repartition(*KEY).sortWithinPartitions(*KEY, "least").mapInArrow(digests, "depth long, h1 long, h2 long, ends_sha256 string")


def _with_parent(nodes: DataFrame) -> DataFrame:
    """Adds parent_conv_id. Parents of very many children are looked up by broadcast while they are few."""
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    parents = parents.where("n_children > 0")
    crowded = F.col("n_children") >= MANY_CHILDREN
    on = ["depth", "p1", "p2"]
    hot = parents.where(crowded)
    if hot.limit(MOST_BROADCAST + 1).count() > MOST_BROADCAST:
        return nodes.join(parents.drop("n_children"), on, "left")
    near = nodes.join(F.broadcast(hot.select(*on, F.col("parent_conv_id").alias("hot"))), on, "left")
    # children of crowded parents are spread by their own hash; they find nothing in the other join
    left = near.withColumn("by", F.when(F.col("hot").isNotNull(), F.col("h1")).otherwise(F.col("p1")))
    rest = parents.where(~crowded).select("depth", F.col("p1").alias("by"), "p2", F.col("parent_conv_id").alias("cold"))
    joined = left.join(rest, ["by", "depth", "p2"], "left")
    return joined.select(*nodes.columns, F.coalesce("hot", "cold").alias("parent_conv_id"))


def trie(digests: DataFrame, everyone: DataFrame) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    digests: conv_id, place, t1, t2, words as of ``digested``. everyone: conv_id of all conversations, those without turns too;
    repeated ids do no harm.
    """
    prepared(digests)
    paths = staged(_paths(digests, everyone), "trie-paths")
    counted = _tries(paths, lambda n: [(n, [1])], ["n"])
    nodes = counted.groupBy(*KEY, "p1", "p2").agg(F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"))
    nodes = staged(nodes, "trie-nodes")
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(F.count(F.lit(1)).alias("n_children"))
    full = staged(nodes.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "trie-full")
    owners = full.groupBy("conv_id").agg((F.min("depth") - 1).alias("shared"), F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf"))
    stretches = paths.join(owners, "conv_id", "left").select("conv_id", "h1", "h2", "words", F.coalesce("shared", F.size("words").cast("long")).alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf"))

    def weighted(n: int, shared: int, leaf: int) -> list[tuple[int, list[int]]]:
        return ([(shared, [1, 0])] if shared >= 0 else []) + ([(n, [0, 1])] if leaf else [])

    sums = _tries(stretches, weighted, ["copies", "leaves"])
    last = F.size("h1")
    ends = paths.select(last.cast("long").alias("depth"), *(F.when(last > 0, F.element_at(h, -1)).otherwise(F.lit(0)).cast("long").alias(h) for h in ("h1", "h2")), "conv_id")
    parts = full.select(*KEY, "p1", "p2", "conv_id", "n_convs", "n_children")
    parts = parts.unionByName(sums.select(*KEY, "leaves", "saved"), True).unionByName(_ends_digest(ends), True)
    whole = parts.groupBy(*KEY).agg(*(F.max(c).alias(c) for c in ("p1", "p2", "conv_id", "n_convs", "n_children", "ends_sha256")), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    named = _with_parent(staged(whole, "trie-whole"))
    empty = hashlib.sha256(b"").hexdigest()
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def of_conversations(turns: DataFrame) -> DataFrame:
    """The trie of a table of turns (conv_id, turn, role, text)."""
    return trie(digested(turns), turns.where("conv_id is not null").select("conv_id"))


def shared_beginnings(digests: DataFrame, group: Column, taken: Column, most: int) -> DataFrame:
    """Digests in which each conversation's first ``taken`` turns are those of conversation ``group`` (fewer if it has fewer).

    Places keep their order, not their numbers. group and taken are columns over conv_id; taken is at most ``most``.
    """
    rest = digests.where(F.col("place") > taken)
    takers = digests.where("place = 1").select("conv_id", group.alias("from"), taken.alias("taken")).where("taken > 0")
    given = digests.where(F.col("place") <= most).select(F.col("conv_id").alias("from"), "place", "t1", "t2", "words")
    begun = takers.join(given, "from").where("place <= taken").select("conv_id", "place", "t1", "t2", "words")
    return begun.unionByName(rest)
