"""Repeated passages by prefix-free parsing.

A rolling hash over GRAM bytes picks triggers: in every window of WIDTH bytes, the place of the smallest hash is one. So
equal windows have equal triggers at equal places, wherever they lie. Consecutive windows with the same trigger form a
phrase: the bytes that these windows cover. Phrases overlap by WIDTH - 1 bytes, no window lies in two, and the text is
its phrases in order: its parse. Windows that start at two places of equal phrases need no further look.

Two windows are equal exactly if they lie in phrases around equal triggers, at the same distance from them. So the
dictionary of distinct phrases is parted by trigger: each phrase goes, as hashes, to the bucket of its trigger. There
equal phrases settle all their windows at once. Every window holds at least half of WIDTH - GRAM bytes on one side of its
trigger, so a phrase can share single windows only with phrases that agree with it in so many bytes on the left or on
the right. All others are new; those that have such a neighbour, at the ends of passages, stay open.

The bytes of open phrases go to buckets once more, where the suffix array of this part of the dictionary is built by
prefix doubling over the bytes (8, 16, 32, 64, then WIDTH). Neighbours in that order with a common prefix of WIDTH bytes
are equal windows, whose phrases' places in the corpus follow from the parse: in each run all but the earliest start is
a repeat. The order ends at WIDTH bytes and phrases overlap by WIDTH - 1, so the order of what follows a phrase in the
parse is never asked for: the parse's own suffix array is needed to the depth of one phrase, which is the phrases' rank.

Map tasks settle phrases that they have seen before themselves, so that a passage which a third of all texts share
reaches its bucket about once for each map task.

A trigger that many different phrases share (more than HOT by a sample of documents) would be one large group. Its
phrases are cut into parts by the distance of the windows from the trigger, and what all windows of a part have in common
(WIDTH bytes less the part's length) becomes the part's trigger. Parts whose trigger is still shared so often, at the
edges of a passage, are cut into single windows, whose trigger is the whole window: equal triggers are then equal
phrases. Equal windows have equal distances, so they still meet.

Phrases count as equal if their 64-bit hashes, their triggers and the 32-bit hashes of their sides agree. Windows of
different phrases are compared by their bytes.

Defined results: matches never cross documents; a null text counts as empty; texts shorter than WIDTH keep all; very long
texts are parsed whole. Order is by doc_id (null last), then by a 64-bit hash of the text, which tells rows that share an
id apart. Repeated rows (same id, same text) are one document. Extra columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepared, staged
from .common import texts_of

WIDTH = 100
GRAM = 16
#: Bytes of distinct text that one bucket should stand for.
BUCKET_BYTES = 4 << 20
#: Texts that a map task parses at a time, in bytes.
PARSE_BYTES = 2 << 20

#: Different phrases that may share one trigger: up to 4 MB of their bytes.
HOT = 20_000
#: One document in so many is looked at for such triggers.
SAMPLE = 64
#: Windows of a part, cut once and once more.
PARTS = (8, 1)

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_B), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class _Roller:
    """Hashes of all byte ranges of one array: prefix sums of byte * B^i, brought back to B^0."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_B, n), out=self.sums[1:])
        self.back = _powers(_INV, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start])

    def every(self, length: int) -> np.ndarray:
        """Hash of each range of that length."""
        return _mixed((self.sums[length:] - self.sums[:-length]) * self.back[: len(self.back) - length])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _sliding(x: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each run of ``span`` values, by doubling."""
    done = 1
    while done < span:
        step = min(done, span - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def phrases(texts: list[np.ndarray], width: int = WIDTH, hot: Sequence[np.ndarray] = ()) -> tuple[np.ndarray, ...]:
    """For the joined texts: text number, first window, number of windows, hash of the trigger, of the phrase, of its sides.

    Window places count within their text. Phrases of a text come in order. hot: triggers to be cut, for each of PARTS.
    Sides: the trigger with half a window's other bytes on the left (high 32 bits) and on the right, 0 where the phrase
    has fewer, 1 for all parts of a cut phrase.
    """
    grams = width - GRAM + 1
    side = (width - GRAM) // 2
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.concatenate(texts) if len(texts) else np.zeros(0, np.uint8)
    if len(data) < width:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    roller = _Roller(data)
    gram = roller.every(GRAM)
    # the leftmost smallest: hash first, place second
    place = np.arange(len(gram), dtype=np.uint64)
    trigger = (_sliding((gram & np.uint64(0xFFFFFFFF00000000)) | place, grams) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    offsets = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(texts)), np.maximum(lengths - width + 1, 0))
    window = np.arange(len(text)) - np.repeat(np.cumsum(np.maximum(lengths - width + 1, 0)) - np.maximum(lengths - width + 1, 0), np.maximum(lengths - width + 1, 0))
    at = trigger[offsets[text] + window]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])])) if len(at) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(at)))
    name, cut = gram[at[first]], np.zeros(len(first), bool)
    for size, known in zip(PARTS, hot, strict=False):
        hit = np.isin(name, known)
        if not hit.any():
            break
        n = count[hit]
        who = np.repeat(np.arange(len(n)), n)
        own = first[hit][who] + np.arange(len(who)) - (np.cumsum(n) - n)[who]
        apart = (at[own] - offsets[text[own]] - window[own]) // size
        lead = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (apart[1:] != apart[:-1])]))
        core = at[own[lead]] - apart[lead] * size
        parts = _mixed(roller.of(core, core - size + 1 + width) + (apart[lead] + 1).astype(np.uint64) * _B)
        first = np.concatenate([first[~hit], own[lead]])
        count = np.concatenate([count[~hit], np.diff(np.append(lead, len(own)))])
        name = np.concatenate([name[~hit], parts])
        cut = np.concatenate([cut[~hit], np.ones(len(lead), bool)])
        order = np.argsort(first, kind="stable")
        first, count, name, cut = first[order], count[order], name[order], cut[order]
    start = offsets[text[first]] + window[first]
    end, mid = start + count - 1 + width, at[first]
    whole = roller.of(start, end)
    left = _short(roller.of(np.maximum(mid - side, 0), mid + GRAM), mid - start >= side, cut)
    right = _short(roller.of(mid, np.minimum(mid + GRAM + side, len(data))), end - mid - GRAM >= side, cut)
    return text[first], window[first], count, name, _mixed(whole + (mid - start).astype(np.uint64) * _B), (left << np.uint64(32)) | right


def _short(h: np.ndarray, present: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """32 bits of a side's hash, over 1."""
    return np.where(cut, np.uint64(1), np.where(present, np.maximum(h >> np.uint64(32), np.uint64(2)), np.uint64(0)))


def _hot_triggers(texts: DataFrame, width: int, most: float) -> list[np.ndarray]:
    """For each of PARTS the triggers that more than ``most`` different phrases of these texts share."""
    found: list[np.ndarray] = []

    def named(hot: list[np.ndarray]):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, _, _, trigger, phrase, _ = phrases([np.frombuffer(x, np.uint8) for x in texts_of(b.column(0))], width, hot)
                yield pa.RecordBatch.from_arrays([pa.array(trigger.view(np.int64)), pa.array(phrase.view(np.int64))], names=["trigger", "phrase"])

        return run

    for _ in PARTS:
        counted = texts.mapInArrow(named(list(found)), "trigger long, phrase long").distinct().groupBy("trigger").count()
        many = [r["trigger"] for r in counted.where(F.col("count") > most).select("trigger").collect()]
        if not many:
            break
        found.append(np.array(many, np.int64).view(np.uint64))
    return found


#: A phrase as a bucket gets it. Triggers are cut to 23 bits beside the bucket: phrases that only seem to share one are left open for nothing.
ROW = np.dtype([("trigger", "<u4"), ("phrase", "<u8"), ("doc", "<i8"), ("first", "<u4"), ("tie", "<i8"), ("sides", "<u8"), ("count", "u1")])
#: Windows known to be repeats: (doc, tie) and a code.
FOUND = np.dtype([("doc", "<i8"), ("tie", "<i8"), ("code", "<i8")])
#: Phrases whose fate a task remembers for those that follow; others go to their bucket, which settles them all the same.
MEMORY = 100_000
SENT = "bucket int, rows binary, extra binary"
CODES = "doc long, tie long, code long"


def _code(first: np.ndarray, count: np.ndarray, trigger: np.ndarray | int = 0, left_open: int = 0) -> np.ndarray:
    """23 bits of trigger, 32 of the first window, 7 of the number of windows, 1: open."""
    return (np.asarray(trigger, np.int64) << 40) | (first.astype(np.int64) << 8) | (count.astype(np.int64) << 1) | left_open


def _flat(found: np.ndarray) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(found), 50_000):
        part = found[low : low + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part["doc"].copy()), pa.array(part["tie"].copy()), pa.array(part["code"].copy())], names=["doc", "tie", "code"])


def _dealt(bucket: np.ndarray, rows: np.ndarray, extra: list[bytes] | np.ndarray, sizes: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows by bucket, packed; extra: bytes of each row (with sizes), or one value a bucket."""
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    stop = np.append(cut[1:], len(bucket)).astype(np.int64)
    at = None if sizes is None else np.concatenate([[0], np.cumsum(sizes)])
    for low in range(0, len(cut), 500):
        a, z = cut[low : low + 500].tolist(), stop[low : low + 500].tolist()
        more = [b""] * len(a) if at is None else [extra[at[i] : at[j]].tobytes() for i, j in zip(a, z, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[a], pa.int32()), pa.array([rows[i:j].tobytes() for i, j in zip(a, z, strict=True)], pa.binary()), pa.array(more, pa.binary())], names=["bucket", "rows", "extra"])


def _parse(buckets: int, width: int, hot: Sequence[np.ndarray]):
    """Texts to phrases by bucket. Phrases seen before in the task are settled at once; they travel as extra."""

    def send(docs: np.ndarray, ties: np.ndarray, texts: list[np.ndarray], seen: dict[int, tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        text, first, count, trigger, phrase, sides = phrases(texts, width, hot)
        if not len(text):
            return
        doc, tie = docs[text], ties[text]
        order = np.lexsort((first, tie, doc, sides, phrase))
        lead = np.concatenate([[True], (phrase[order][1:] != phrase[order][:-1]) | (sides[order][1:] != sides[order][:-1])])
        go = np.zeros(len(text), bool)
        go[order[lead]] = True
        # a row that comes twice is no repeat of itself
        leader = order[lead][np.cumsum(lead) - 1]
        own = (doc[order] == doc[leader]) & (tie[order] == tie[leader]) & (first[order] == first[leader])
        settled = np.zeros(len(text), bool)
        settled[order[~own]] = True
        for i in order[lead].tolist():
            key, mine = (int(phrase[i]) << 64) | int(sides[i]), (int(doc[i]), int(tie[i]), int(first[i]))
            had = seen.get(key)
            if had is not None and had <= mine:
                go[i] = False
                settled[i] = had < mine
            elif had is not None or len(seen) < MEMORY:
                seen[key] = mine
        found = np.zeros(int(settled.sum()), FOUND)
        found["doc"], found["tie"], found["code"] = doc[settled], tie[settled], _code(first[settled], count[settled])
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array([int(phrase[0] % np.uint64(buckets))], pa.int32()), pa.array([b""], pa.binary()), pa.array([found.tobytes()], pa.binary())], names=["bucket", "rows", "extra"])
        keep = np.flatnonzero(go)
        bucket = (trigger[keep] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        keep, bucket = keep[order], bucket[order]
        rows = np.zeros(len(keep), ROW)
        for name, x in (("trigger", trigger >> np.uint64(41)), ("phrase", phrase), ("doc", doc), ("tie", tie), ("first", first), ("sides", sides), ("count", count)):
            rows[name] = x[keep]
        yield from _dealt(bucket, rows, [])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, int, int]] = {}
        docs, ties, texts, held = [], [], [], 0
        for b in batches:
            for d, t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), strict=True):
                docs.append(d)
                ties.append(t)
                texts.append(np.frombuffer(x, np.uint8))
                held += len(x)
                if held >= PARSE_BYTES:
                    yield from send(np.array(docs), np.array(ties), texts, seen)
                    docs, ties, texts, held = [], [], [], 0
        if texts:
            yield from send(np.array(docs), np.array(ties), texts, seen)

    return run


def _each_bucket(work):
    """Gathers the rows of a bucket, which come one after another, and runs ``work`` on them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, extra = None, [], []
        for b in batches:
            for bucket, r, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if bucket != current:
                    if current is not None:
                        yield from _flat(work(np.frombuffer(b"".join(rows), ROW), b"".join(extra)))
                    current, rows, extra = bucket, [], []
                rows.append(r)
                extra.append(x)
        if current is not None:
            yield from _flat(work(np.frombuffer(b"".join(rows), ROW), b"".join(extra)))

    return run


def _settle(rows: np.ndarray, extra: bytes) -> np.ndarray:
    """Codes of repeated phrases and of open ones: firsts of a phrase that agrees with another one on a side of the trigger."""
    rows = rows[np.lexsort((rows["first"], rows["tie"], rows["doc"], rows["sides"], rows["phrase"], rows["trigger"]))]
    same = np.zeros(len(rows), bool)
    same[1:] = True
    for name in ("trigger", "phrase", "sides"):
        same[1:] &= rows[name][1:] == rows[name][:-1]
    leader = np.flatnonzero(~same)[np.cumsum(~same) - 1] if len(rows) else np.zeros(0, np.int64)
    later = same & ((rows["doc"] != rows["doc"][leader]) | (rows["tie"] != rows["tie"][leader]) | (rows["first"] != rows["first"][leader]))
    firsts = np.flatnonzero(~same)
    trigger, sides = rows["trigger"][firsts].astype(np.uint64), rows["sides"][firsts]
    shared = np.zeros(len(firsts), bool)
    for half in (sides >> np.uint64(32), sides & np.uint64(0xFFFFFFFF)):
        key = (trigger << np.uint64(32)) | half
        order = np.argsort(key, kind="stable")
        again = (key[order][1:] == key[order][:-1]) & (half[order][1:] > 0)
        shared[order[1:][again]] = True
        shared[order[:-1][again]] = True
    opened = firsts[shared]
    out = np.zeros(int(later.sum()) + len(opened), FOUND)
    n = int(later.sum())
    for name in ("doc", "tie"):
        out[name][:n], out[name][n:] = rows[name][later], rows[name][opened]
    out["code"][:n] = _code(rows["first"][later], rows["count"][later])
    out["code"][n:] = _code(rows["first"][opened], rows["count"][opened], rows["trigger"][opened], 1)
    return np.concatenate([out, np.frombuffer(extra, FOUND)])


def _reopen(buckets: int, width: int):
    """Bytes of open phrases by bucket of their trigger: doc, tie, text and codes in."""

    def send(rows: list[np.ndarray], pieces: list[bytes]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(rows)
        sizes = every["count"].astype(np.int64) - 1 + width
        start = np.cumsum(sizes) - sizes
        bucket = every["trigger"].astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        data = np.frombuffer(b"".join(pieces), np.uint8)
        z = sizes[order]
        joined = data[np.repeat(start[order] - (np.cumsum(z) - z), z) + np.arange(int(z.sum()))]
        yield from _dealt(bucket[order], every[order], joined, z)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, pieces, held = [], [], 0
        for b in batches:
            for doc, tie, text, codes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), b.column(3).to_pylist(), strict=True):
                c = np.array(codes, np.int64)
                c = c[(c & 1) == 1]
                if not len(c):
                    continue
                own = np.zeros(len(c), ROW)
                own["trigger"], own["doc"], own["tie"], own["first"], own["count"] = c >> 40, doc, tie, (c >> 8) & 0xFFFFFFFF, (c >> 1) & 127
                rows.append(own)
                got = [text[f : f + n - 1 + width] for f, n in zip(own["first"].tolist(), own["count"].tolist(), strict=True)]
                pieces += got
                held += sum(map(len, got))
                if held >= PARSE_BYTES:
                    yield from send(rows, pieces)
                    rows, pieces, held = [], [], 0
        if rows:
            yield from send(rows, pieces)

    return run


def suffix_ranks(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Place of each start among the distinct suffixes of ``data``, cut at ``width`` bytes: equal for equal windows.

    The suffix array by prefix doubling over bytes, from eight on; the last step joins two overlapping halves. Starts lie
    ``width`` bytes before the end or more.
    """
    depth = min(8, width)
    head = np.zeros(len(data), np.uint64)
    for k in range(depth):
        head[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(8 * (7 - k))

    def ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(key), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])]) if len(key) else 0
        return rank

    rank = ranked(head if depth < width else head[starts])
    del head
    while depth < width:
        step = min(depth, width - depth)
        at = starts if depth + step == width else np.arange(len(data))
        rank = ranked(rank[at] * (len(data) + 1) + rank[np.minimum(at + step, len(data) - 1)])
        depth += step
    return rank


def _orderer(width: int):
    """Repeated windows among the open phrases of a bucket."""

    def work(rows: np.ndarray, extra: bytes) -> np.ndarray:
        data = np.frombuffer(extra, np.uint8)
        sizes = rows["count"].astype(np.int64) - 1 + width
        start = np.cumsum(sizes) - sizes
        order = np.argsort(rows["trigger"], kind="stable")
        rows, sizes, start = rows[order], sizes[order], start[order]
        out = [np.zeros(0, FOUND)]
        for low, high in _lots(rows["trigger"], sizes):
            own, z = rows[low:high], sizes[low:high]
            n = own["count"].astype(np.int64)
            who = np.repeat(np.arange(len(own)), n)
            step = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
            dictionary = data[np.repeat(start[low:high] - (np.cumsum(z) - z), z) + np.arange(int(z.sum()))]
            suffix = suffix_ranks(dictionary, (np.cumsum(z) - z)[who] + step, width)
            doc, tie, place = own["doc"][who], own["tie"][who], own["first"][who].astype(np.int64) + step
            rank = np.lexsort((place, tie, doc, suffix))
            lead = np.concatenate([[True], suffix[rank][1:] != suffix[rank][:-1]])
            leader = rank[lead][np.cumsum(lead) - 1]
            again = (doc[rank] != doc[leader]) | (tie[rank] != tie[leader]) | (place[rank] != place[leader])
            hit = np.sort(rank[again])
            if len(hit):
                # runs of windows of one phrase
                new = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (who[hit[1:]] != who[hit[:-1]])]))
                found = np.zeros(len(new), FOUND)
                found["doc"], found["tie"] = doc[hit[new]], tie[hit[new]]
                found["code"] = _code(place[hit[new]], np.diff(np.append(new, len(hit))))
                out.append(found)
        return np.concatenate(out)

    return work


def _lots(trigger: np.ndarray, size: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of about ``most`` bytes that do not part a trigger."""
    ends = np.append(np.flatnonzero(trigger[1:] != trigger[:-1]) + 1, len(trigger)) if len(trigger) else []
    low, held, before = 0, 0, 0
    total = np.concatenate([[0], np.cumsum(size)])
    for end in ends:
        held += int(total[end] - total[before])
        before = int(end)
        if held >= most:
            yield low, before
            low, held = before, 0
    if low < len(trigger):
        yield low, len(trigger)


LAST = (1 << 63) - 1


def _by_bucket(sent: DataFrame, work) -> DataFrame:
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_each_bucket(work), CODES)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, hot: int = HOT, sample: int = SAMPLE) -> DataFrame:
    """One row for each input row: doc_id, n_bytes, kept (binary: the bytes that stay), spans (array of start, end).

    hot: phrases that may share a trigger before it is cut, as one document in ``sample`` shows. Results are the same.
    """
    prepared(docs)
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.lit(29), body).alias("tie")
    rows = docs.select(*key, body.alias("t"))
    total = rows.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + total // BUCKET_BYTES)

    # so many different phrases take at least as many bytes
    shared = _hot_triggers(rows.where(F.pmod("tie", F.lit(sample)) == 0).select("t"), width, hot / sample) if total > hot else []

    def grouped(codes: DataFrame) -> DataFrame:
        return codes.groupBy("doc", "tie").agg(F.collect_list("code").alias("codes"))

    settled = staged(grouped(_by_bucket(rows.mapInArrow(_parse(buckets, width, shared), SENT), _settle)), "phrases")
    opened = settled.where(F.exists("codes", lambda c: c.bitwiseAND(F.lit(1)) == 1))
    texts = docs.select(F.col(id_col).alias("doc_id"), *key, body.alias("t"))
    late = _by_bucket(texts.join(opened, ["doc", "tie"]).select("doc", "tie", "t", "codes").mapInArrow(_reopen(buckets, width), SENT), _orderer(width))
    ranges = grouped(settled.select("doc", "tie", F.explode("codes").alias("code")).where("code & 1 = 0").unionByName(late))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            kept, spans = [], []
            for t, codes in zip(texts_of(b.column(1)), b.column(2).to_pylist(), strict=True):
                found: list[list[int]] = []
                for c in sorted(codes or []):
                    low, high = c >> 8, (c >> 8) + ((c >> 1) & 127) - 1 + width
                    if found and low <= found[-1][1]:
                        found[-1][1] = max(found[-1][1], high)
                    else:
                        found.append([low, high])
                at, out = 0, []
                for low, high in found:
                    out.append(t[at:low])
                    at = high
                kept.append(b"".join([*out, t[at:]]))
                spans.append([{"start": a, "end": z} for a, z in found])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(kept, pa.binary()), pa.array(spans, kind)], names=["doc_id", "n_bytes", "kept", "spans"])

    mine = texts.join(ranges, ["doc", "tie"], "left")
    return mine.select("doc_id", "t", "codes", F.octet_length("t").cast("long").alias("n")).mapInArrow(run, "doc_id long, n_bytes long, kept binary, spans array<struct<start: long, end: long>>")
