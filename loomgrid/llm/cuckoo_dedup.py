"""Exact deduplication on a cuckoo-filter index.

A document's digest is the SHA-256 of its text. Every index shard keeps a cuckoo filter of 16-bit fingerprints
(four slots a bucket, two candidate buckets) beside the full keys of what lies in each slot. A probe that finds no
fingerprint is certainly new; a fingerprint hit is verified against the keys stored in that bucket (digest and byte
length). When an insertion finds no free slot after a bounded number of moves the filter doubles and is refilled from
the stored keys. Deletion removes the slot of a digest whose last live copy went.

Work is spread in two levels, so that no group of copies meets in one task: each map task folds its own rows into a
filter and passes on one row for each digest it has seen; shards of the digest space then fold those rows. A group of
any size reaches its shard as a few rows for each map task at most. A map task passes its rows on and starts anew once its
filter holds FLUSH keys. A shard works in PARTS, one after another, so its memory is a small part of its keys.

Defined results: a null text counts as empty. Of equal texts the largest doc_id stays; null ids lose to any id, and a
group of null ids alone keeps one of its rows. Repeated rows (same id, same text): one of them stays. Very long texts are
hashed whole. Extra columns pass through ``keep_one_copy``; columns named ``_cx_*`` are an error. Empty tables give empty
results.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepared, staged
from .common import refuse

SLOTS = 4
MAX_MOVES = 200
LOAD = 0.9
#: Keys that a map task holds before it passes them on; parts of a shard, each with an index of its own.
FLUSH = 100_000
PARTS = 64

PARTIAL = "_cx_digest binary, _cx_octets long, _cx_keep long, _cx_copies long, _cx_top long"


class CuckooIndex:
    """Filter and stored keys of one shard. A key's number is its place in ``keys``; -1 marks a free slot."""

    def __init__(self, expected: int = 1024):
        self.keys: list[tuple[bytes, int] | None] = []
        self.free: list[int] = []
        self.live = 0
        self.resizes = -1
        self._allot(max(64, int(expected / LOAD / SLOTS)))

    def _allot(self, buckets: int) -> None:
        self.mask = (1 << max(1, (buckets - 1).bit_length())) - 1
        size = (self.mask + 1) * SLOTS
        self.prints = array("H", bytes(2 * size))
        self.refs = array("q", b"\xff" * (8 * size))
        self.resizes += 1

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        home = int.from_bytes(digest[2:10], "little") & self.mask
        return mark, home, self._other(home, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995 >> 3) & self.mask)

    def find(self, key: tuple[bytes, int]) -> int:
        """Number of the stored key, or -1. A fingerprint hit alone decides nothing."""
        mark, one, two = self._places(key[0])
        for bucket in (one, two):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[at] == mark and self.refs[at] >= 0 and self.keys[self.refs[at]] == key:
                    return self.refs[at]
        return -1

    def insert(self, key: tuple[bytes, int]) -> int:
        """Store a key that ``find`` does not know; returns its number."""
        ref = self.free.pop() if self.free else len(self.keys)
        if ref == len(self.keys):
            self.keys.append(key)
        else:
            self.keys[ref] = key
        self.live += 1
        if not self._place(key[0], ref):
            self._resize()
        return ref

    def _place(self, digest: bytes, ref: int) -> bool:
        mark, bucket, two = self._places(digest)
        for b in (bucket, two):
            for at in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.refs[at] < 0:
                    self.prints[at], self.refs[at] = mark, ref
                    return True
        for move in range(MAX_MOVES):
            at = bucket * SLOTS + (mark + move) % SLOTS
            self.prints[at], mark = mark, self.prints[at]
            self.refs[at], ref = ref, self.refs[at]
            bucket = self._other(bucket, mark)
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.refs[at] < 0:
                    self.prints[at], self.refs[at] = mark, ref
                    return True
        return False

    def _resize(self) -> None:
        while True:
            self._allot(2 * (self.mask + 1))
            if all(self._place(k[0], i) for i, k in enumerate(self.keys) if k is not None):
                return

    def delete(self, key: tuple[bytes, int]) -> bool:
        """Forget a live key; False if it is not stored."""
        mark, one, two = self._places(key[0])
        for bucket in (one, two):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                ref = self.refs[at]
                if self.prints[at] == mark and ref >= 0 and self.keys[ref] == key:
                    self.prints[at], self.refs[at] = 0, -1
                    self.keys[ref] = None
                    self.free.append(ref)
                    self.live -= 1
                    return True
        return False


class _Groups:
    """Copy groups of the keys of one index."""

    def __init__(self):
        self.index, self.keep, self.copies, self.top = CuckooIndex(), [], [], []

    def add(self, digest: bytes, octets: int, one: int | None, n: int, t: int) -> None:
        ref = self.index.find((digest, octets))
        if ref < 0:
            self.index.insert((digest, octets))
            self.keep.append(one)
            self.copies.append(n)
            self.top.append(t)
            return
        self.copies[ref] += n
        if self.keep[ref] == one:
            self.top[ref] += t
        elif self.keep[ref] is None or (one is not None and one > self.keep[ref]):
            self.keep[ref], self.top[ref] = one, t

    def rows(self) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(self.keep), 20_000):
            part = slice(low, low + 20_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in self.index.keys[part]], pa.binary()), pa.array([k[1] for k in self.index.keys[part]], pa.int64())]
                + [pa.array(x[part], pa.int64()) for x in (self.keep, self.copies, self.top)],
                names=["_cx_digest", "_cx_octets", "_cx_keep", "_cx_copies", "_cx_top"],
            )


def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PARTIAL in, one row for each distinct key out (or a few, beyond FLUSH); keys meet through a cuckoo index."""
    groups = _Groups()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            groups.add(*row)
        if groups.index.live >= FLUSH:
            yield from groups.rows()
            groups = _Groups()
    yield from groups.rows()


def fold_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PARTIAL with their part, part by part; exactly one row for each distinct key."""
    at, groups = None, _Groups()
    for batch in batches:
        for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != at:
                yield from groups.rows()
                at, groups = part, _Groups()
            groups.add(*row)
    yield from groups.rows()


#: Rows of equal text and id that one task numbers at a time.
RUN = 1 << 16


def with_digest(docs: DataFrame, text: str = "text") -> DataFrame:
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.withColumns({"_cx_digest": F.unhex(F.sha2(body, 256)), "_cx_octets": F.octet_length(body).cast("long")})


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each distinct text: _cx_digest, _cx_octets, _cx_keep, _cx_copies, _cx_top (rows that hold _cx_keep)."""
    prepared(docs)
    rows = with_digest(docs, text).select("_cx_digest", "_cx_octets", F.col(id_col).cast("long").alias("_cx_keep"), F.lit(1).cast("long").alias("_cx_copies"), F.lit(1).cast("long").alias("_cx_top"))
    local = rows.mapInArrow(fold, PARTIAL)
    part = F.pmod(F.xxhash64(F.lit(7), "_cx_digest"), F.lit(PARTS)).cast("int").alias("_cx_part")
    shards = local.select(part, "*").repartition("_cx_digest").sortWithinPartitions("_cx_part")
    return staged(shards.mapInArrow(fold_parts, PARTIAL), "copy-groups")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = copy_groups(docs, id_col, text)
    rows = with_digest(docs, text).select(F.col(f"`{id_col}`").alias("doc_id"), "_cx_digest")
    marked = rows.join(groups, "_cx_digest").withColumn("_cx_kept", F.col("doc_id").eqNullSafe(F.col("_cx_keep")))
    if not groups.where("_cx_top > 1").isEmpty():
        # rows that agree in all that is returned: one for each group, and the others by number
        many = groups.where("_cx_top > 1").withColumn("doc_id", F.col("_cx_keep")).withColumn("_cx_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_cx_top") - 1) / RUN)))).repartition("_cx_digest", "_cx_run")
        numbers = F.sequence(F.col("_cx_run") * RUN + 1, F.least("_cx_top", (F.col("_cx_run") + 1) * RUN))
        several = many.withColumn("_cx_n", F.explode(numbers)).withColumn("_cx_kept", F.col("_cx_n") == 1)
        marked = marked.where("_cx_top = 1 or not _cx_kept").unionByName(several.select(marked.columns))
    return marked.select("doc_id", F.col("_cx_keep").alias("keep_id"), F.col("_cx_copies").alias("group_size"), F.col("_cx_kept").alias("kept"), F.lower(F.hex("_cx_digest")).alias("text_sha256"))


def keep_one_copy(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The input rows that stay, with all their columns."""
    refuse(docs, "_cx_")
    groups = copy_groups(docs, id_col, text)
    joined = with_digest(docs, text).join(groups.drop("_cx_octets"), "_cx_digest").where(F.col(f"`{id_col}`").eqNullSafe(F.col("_cx_keep")))
    stay = joined if groups.where("_cx_top > 1").isEmpty() else joined.where("_cx_top = 1").unionByName(joined.where("_cx_top > 1").dropDuplicates(["_cx_digest"]))
    return stay.select(*(F.col(f"`{c}`") for c in docs.columns))


def apply_changes(live: DataFrame, changes: DataFrame, shards: int = 64) -> DataFrame:
    """Bring an index up to date.

    live: digest binary, octets long, copies long. changes: seq long, text string, change string ('insert' or
    'delete'). Returns the live digests after all changes, applied in the order of seq: digest, octets, copies.
    Deleting an absent text changes nothing; null texts count as empty; changes of equal seq are ordered insertions first;
    empty changes give the live digests. Shards work on their own; a digest's changes are first summed up to their
    order-free net effect where none of them is a deletion.
    """
    prepared(live)

    def shard(d):
        return F.pmod(F.xxhash64(d), F.lit(shards)).cast("int").alias("shard")

    was = live.select(shard(F.col("digest")), "digest", "octets", F.col("copies").cast("long").alias("n"), F.lit(-1).cast("long").alias("seq"))
    told = with_digest(changes).select(F.col("_cx_digest").alias("digest"), F.col("_cx_octets").alias("octets"), F.when(F.col("change") == "delete", -1).otherwise(1).cast("long").alias("n"), F.col("seq").cast("long"))
    only_in = told.groupBy("digest", "octets").agg(F.min("n").alias("least"), F.sum("n").alias("n"), F.min("seq").alias("seq"))
    merged = only_in.where("least > 0").select("digest", "octets", "n", "seq").unionByName(told.join(only_in.where("least < 0").select("digest"), "digest", "left_semi"))
    rows = was.unionByName(merged.select(shard(F.col("digest")), "digest", "octets", "n", "seq"))

    def replay(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, count = CuckooIndex(), {}
        for batch in batches:
            for _, digest, octets, n, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ref = index.find((digest, octets))
                if ref < 0 and n > 0:
                    count[index.insert((digest, octets))] = n
                elif ref >= 0:
                    count[ref] += n
                    if count[ref] <= 0:
                        index.delete((digest, octets))
                        del count[ref]
        found = [(index.keys[r], n) for r, n in count.items()]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in found], pa.binary()), pa.array([k[1] for k, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], names=["digest", "octets", "copies"])

    return rows.repartition("shard").sortWithinPartitions("seq", F.desc("n")).mapInArrow(replay, "digest binary, octets long, copies long")


def digest_of(text: str | None) -> bytes:
    return hashlib.sha256((text or "").encode()).digest()
