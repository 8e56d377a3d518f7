"""Harmonic packing of tokenised documents into sequences.

Of a document's ids (and one end id) whole capacities C are cut off first. The remainder, of n ids, is of the harmonic class
k = floor(C / n), and a bin of class k takes exactly k whole remainders. The gap that they leave is filled by the documents
that come next; only the last of these is cut, and what stays of it is classed by its own length. So full bins have no
padding, and each worker fills the bins of its own partition with no word to others. Remainders still waiting at a
partition's end (fewer than k a class) are joined from long to short and cut at capacities; what is left at the end is
closed at powers of two, which need no padding either.

Sequence numbers are ``partition << 32 | count``. The input's partitions must not change when a task runs again: read
it from a table (``staged`` makes one), as the registered queries do.

Defined results: a null text counts as empty and still has its end id; very long texts are tokenised whole; a null
doc_id stays null; repeated rows are documents of their own; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepared

END_ID = 1
CACHE_UNITS = 150_000
#: Fixed value: the characters of the pre-tokeniser's \s.
WHITE = "\t-\r \x85\xa0  -     　"
UNIT = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class _Units(dict):
    """Ids (little-endian unsigned 32-bit) of text units that tokenise on their own: a blank and what follows, or white space."""

    def __init__(self, json_path: str, ranks_path: str, special: tuple[str, ...]):
        import base64

        import tiktoken
        from public_tokenizers import PATTERN

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special, self.json_path, self.whole = special, json_path, None

    def __missing__(self, unit: str) -> bytes:
        ids = array("I", self.encode(unit)).tobytes()
        if len(self) < CACHE_UNITS and len(unit) < 32:
            self[unit] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.json_path)
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, UNIT.findall(text)))


@lru_cache(maxsize=2)
def units(json_path: str, ranks_path: str, special: tuple[str, ...]) -> _Units:
    """One for each Python worker; workers serve many tasks."""
    return _Units(json_path, ranks_path, special)


@lru_cache(maxsize=2)
def special_tokens(json_path: str) -> tuple[str, ...]:
    """Strings that the tokenizer takes as one token wherever they occur."""
    with open(json_path, "rb") as f:
        return tuple(t["content"] for t in json.load(f)["added_tokens"])


def vocabulary_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def fill(documents: Iterable[tuple[int | None, bytes]], capacity: int, first: int) -> Iterator[tuple]:
    """Pieces of (doc_id, ids) in closed sequences, as rows of PIECES. first: number of the first sequence."""
    number = first
    waiting: dict[int, list[tuple]] = {}
    #: the bin that has its k remainders and still a gap
    bin_, gap = [], 0

    def close(pieces: list[tuple]) -> Iterator[tuple]:
        nonlocal number
        at = 0
        for p in pieces:
            yield (*p, number, at)
            at += p[2]
        number += 1

    def parted(piece: tuple, n: int) -> tuple[tuple, tuple]:
        doc_id, start, length, ids, total = piece
        return (doc_id, start, n, ids[: 4 * n], total), (doc_id, start + n, length - n, ids[4 * n :], total)

    for doc_id, ids in documents:
        total = len(ids) // 4
        left = (doc_id, 0, total, ids, total)
        while left[2] >= capacity:
            whole, left = parted(left, capacity)
            yield from close([whole])
        if left[2] and gap:
            own, left = parted(left, min(gap, left[2]))
            bin_.append(own)
            gap -= own[2]
            if not gap:
                yield from close(bin_)
                bin_ = []
        if left[2]:
            k = capacity // left[2]
            same = waiting.setdefault(k, [])
            same.append(left)
            if len(same) == k:
                bin_, gap = same, capacity - sum(p[2] for p in same)
                waiting[k] = []
                if not gap:
                    yield from close(bin_)
                    bin_ = []
    rest = sorted((p for same in waiting.values() for p in same), key=lambda p: p[2])
    rest += bin_[::-1]
    left_ids = sum(p[2] for p in rest)
    while rest:
        want = capacity if left_ids >= capacity else 1 << (left_ids.bit_length() - 1)
        left_ids -= want
        pieces = []
        while want:
            own, after = parted(rest.pop(), want) if rest[-1][2] > want else (rest.pop(), None)
            if after:
                rest.append(after)
            pieces.append(own)
            want -= own[2]
        yield from close(pieces)


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = END_ID, files: tuple[str, str] | None = None) -> DataFrame:
    """One row for each piece, with its ids. capacity: a power of two. files: the vocabulary as json and as ranks, on every executor."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    prepared(docs)
    files = files or vocabulary_files()
    end = array("I", [end_id]).tobytes()
    special = special_tokens(files[0])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = units(*files, special)

        def documents():
            for b in batches:
                for doc_id, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    yield doc_id, known.ids(t or "") + end

        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        rows: list[tuple] = []
        for row in fill(documents(), capacity, TaskContext.get().partitionId() << 32):
            rows.append(row)
            if len(rows) == 4000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(run, PIECES)


def crc_of(ids: list[int]) -> int:
    return zlib.crc32(array("I", ids).tobytes())
