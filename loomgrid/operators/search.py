"""Retrieval operators as DataFrame plans: BM25 over postings, exact vector search, rank fusion, and what follows them."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import cosine, overlap, plain_terms
from ..session import prepared

K1, B = 1.2, 0.75
RRF_K = 60
#: Queries that are sent to every task at most; vectors that meet a block of more queries in one task; queries of one product.
QUERY_BLOCK, VECTOR_TILE, TILE = 4096, 1 << 17, 256
#: Words that open a code query, and words of natural-language queries.
CODE_WORDS = ("fn", "func", "function", "def", "class", "struct", "enum", "impl", "trait", "interface", "module", "use", "import", "pub", "async", "const", "static", "type", "var", "let", "val")
PROSE_WORDS = ("how", "what", "which", "where", "when", "why", "does", "that", "this", "the", "for", "with", "from", "is", "are", "can", "should", "would")


def postings(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """term, id, tf, dl: one row for each term of each document. Terms are counted inside the row's array first."""
    words = docs.select(F.col(id_col).alias("id"), plain_terms(F.coalesce(F.col(text), F.lit(""))).alias("ws"))
    return words.select("id", F.size("ws").alias("dl"), F.explode("ws").alias("term")).groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, query: list[str], id_col: str = "doc_id", text: str | dict[str, float] = "text", analyse: Callable[[Column], Column] = plain_terms) -> DataFrame:
    """id, score for every document with a query term. One pass: only the query's terms are counted, no postings are built.

    ``text`` may be several columns with the boost of each; every column has its own counts and mean length.
    """
    terms, fields = sorted(set(query)), {text: 1.0} if isinstance(text, str) else text
    if not terms:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).where("false")

    def counts(field: str) -> Column:
        words = F.array(analyse(F.coalesce(F.col(field), F.lit(""))))
        return F.transform(words, lambda ws: F.struct(F.size(ws).alias("dl"), *((F.size(ws) - F.size(F.array_remove(ws, t))).alias(f"tf{i}") for i, t in enumerate(terms))))[0]

    counted = docs.select(F.col(id_col).alias("id"), *(counts(f).alias(f"c{k}") for k, f in enumerate(fields)))
    sums = [F.count(F.lit(1)).alias("n")]
    for k in range(len(fields)):
        sums += [F.avg(f"c{k}.dl").alias(f"avgdl{k}"), *(F.sum(F.when(F.col(f"c{k}.tf{i}") > 0, 1).otherwise(0)).alias(f"df{k}_{i}") for i in range(len(terms)))]
    stats = counted.agg(*sums).first()
    n, score = stats["n"] or 0, F.lit(0.0)
    for k, boost in enumerate(fields.values()):
        for i in range(len(terms)):
            df = stats[f"df{k}_{i}"] or 0
            tf = F.col(f"c{k}.tf{i}")
            score = score + boost * F.log(F.lit(1 + (n - df + 0.5) / (df + 0.5))) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col(f"c{k}.dl") / (stats[f"avgdl{k}"] or 1.0)))
    return counted.select("id", score.alias("score")).where("score > 0")


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best by score, ties by id. k = 0 gives none."""
    return scored.orderBy(F.desc("score"), "id").limit(k)


def vector_scores(vectors: DataFrame, query: list[float], id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id, score: cosine with the query, both of unit length. Vectors of another dimension are an error."""
    q = F.array(*(F.lit(float(x)) for x in query))
    sized = F.when(F.size(column) != len(query), F.raise_error(F.lit("vector and query differ in dimension"))).otherwise(cosine(F.col(column), q))
    return vectors.select(F.col(id_col).alias("id"), sized.alias("score"))


def _nearest(k: int):
    """Folds vectors into the k best of a block of queries: ids, matrix and batches in, (query, id, score) out.

    A matrix product tells which vectors may be among the k best; their scores are summed once more in the order of the
    dimensions, as ``cosine`` does, so ties are ties whatever the blocks.
    """

    class Best:
        def __init__(self, ids: np.ndarray, matrix: np.ndarray):
            self.ids, self.matrix = ids, matrix
            self.q, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

        def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
            if vectors.shape[1] != self.matrix.shape[1]:
                raise ValueError("vector and query differ in dimension")
            reached = np.full(len(self.ids), -np.inf)
            full = np.bincount(self.q, minlength=len(self.ids)) >= k
            np.minimum.at(least := np.full(len(self.ids), np.inf), self.q, self.score)
            reached[full] = least[full]
            found = [(self.q, self.id, self.score)]
            for low in range(0, len(self.ids), TILE):
                about = self.matrix[low : low + TILE] @ vectors.T
                about[self.ids[low : low + TILE, None] == ids[None, :]] = -np.inf
                own = np.partition(about, -k, axis=1)[:, -k] if about.shape[1] > k else np.full(len(about), -np.inf)
                q, v = np.nonzero((about >= np.maximum(own, reached[low : low + TILE])[:, None] - 1e-9) & np.isfinite(about))
                exact = np.zeros(len(q))
                for d in range(vectors.shape[1]):
                    exact += self.matrix[low + q, d] * vectors[v, d]
                found.append((low + q, ids[v], exact))
            q, i, s = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((i, -s, q))
            q, i, s = q[order], i[order], s[order]
            first = np.searchsorted(q, q, "left")
            keep = np.arange(len(q)) - first < k
            self.q, self.id, self.score = q[keep], i[keep], s[keep]

        def rows(self) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(self.ids[self.q]), pa.array(self.id), pa.array(self.score)], names=["query", "id", "score"])

    return Best


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles; other lengths are an error."""
    lengths = np.diff(column.offsets.to_numpy())
    if column.null_count or len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vector and query differ in dimension")
    values = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    return values.astype(np.float64).reshape(len(lengths), -1) if len(lengths) else np.zeros((0, 0))


def knn(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query, id, rank, score: k nearest of each row of ``queries``, itself excepted; ties by id. Rows without a vector are left out.

    A task keeps the k best of each query over all vectors that it reads, so at most k rows a query and task are shuffled.
    Up to ``QUERY_BLOCK`` queries are sent to every task; more are dealt in blocks and meet tiles of ``VECTOR_TILE`` vectors.
    """
    prepared(vectors)
    q = queries.where(F.col(column).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(column).alias("v"))
    rows = vectors.where(F.col(column).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(column).alias("v"))
    n, best = q.count(), _nearest(k)
    out = "query long, id long, score double"
    if n == 0 or k < 1:
        scored = vectors.sparkSession.createDataFrame([], out)
    elif n <= QUERY_BLOCK:
        told = q.collect()
        ids, matrix = np.array([r["id"] for r in told]), np.array([r["v"] for r in told], np.float64)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = best(ids, matrix)
            for b in batches:
                if b.num_rows:
                    held.add(b.column(0).to_numpy(), _matrix(b.column(1)))
            yield held.rows()

        scored = rows.mapInArrow(run, out)
    else:
        blocks, tiles = -(-n // QUERY_BLOCK), max(1, -(-rows.count() // VECTOR_TILE))

        def dealt(df: DataFrame, own: str, own_n: int, other: str, other_n: int, kind: int) -> DataFrame:
            copies = F.explode(F.sequence(F.lit(0), F.lit(other_n - 1)))
            return df.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(own_n)).cast("int").alias(own), copies.alias(other)).select("block", "tile", F.lit(kind).alias("kind"), "id", "v")

        both = dealt(q, "block", blocks, "tile", tiles, 0).unionByName(dealt(rows, "tile", tiles, "block", blocks, 1))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, asked, held = None, [], None
            for b in batches:
                keys = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()], axis=1)
                cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
                for low, high in zip(cuts, cuts[1:], strict=False):
                    if high == low:
                        continue
                    part = b.slice(low, high - low)
                    if (now := tuple(keys[low, :2])) != key:
                        if held:
                            yield held.rows()
                        key, asked, held = now, [], None
                    if keys[low, 2] == 0:
                        asked.append((part.column(3).to_numpy(), _matrix(part.column(4))))
                    elif asked:
                        held = held or best(np.concatenate([x for x, _ in asked]), np.concatenate([x for _, x in asked]))
                        held.add(part.column(3).to_numpy(), _matrix(part.column(4)))
            if held:
                yield held.rows()

        # of each pair of a block and a tile the queries come first
        scored = both.repartition("block", "tile").sortWithinPartitions("block", "tile", "kind").mapInArrow(run, out)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k).select("query", "id", "rank", "score")


def ranked(top: DataFrame) -> DataFrame:
    """Adds the place, from 0. The input is a top-k result, so one task orders it."""
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1)


def fuse(semantic: DataFrame, lexical: DataFrame, k: int = RRF_K, weight: float = 0.5, floor: bool = True) -> DataFrame:
    """Weighted reciprocal-rank fusion of two top-k results: id, score; scores under 0.3 / (k + 1) go."""
    one = ranked(semantic).select("id", (F.lit(weight) / (k + F.col("place") + 1)).alias("s"))
    two = ranked(lexical).select("id", (F.lit(1 - weight) / (k + F.col("place") + 1)).alias("s"))
    out = one.unionByName(two).groupBy("id").agg(F.sum("s").alias("score"))
    return out.where(F.col("score") >= 0.3 / (k + 1)) if floor else out


def query_class(q: Column) -> Column:
    """identifier, phrase or prose."""
    words = F.array_remove(F.split(F.lower(F.trim(q)), r"\s+"), "")
    return (
        F.when(F.size(words) <= 1, "identifier")
        .when(words[0].isin(*CODE_WORDS), "identifier")
        .when((F.size(words) > 3) | F.arrays_overlap(words, F.array(*map(F.lit, PROSE_WORDS))), "prose")
        .otherwise("phrase")
    )


#: Weight of the semantic list by class of query.
SEMANTIC_WEIGHT = {"identifier": 0.3, "phrase": 0.45, "prose": 0.7}


class _Stairs:
    """Of ranges seen so far (end, rank) those that no other one beats in both: the best rank among ends from some end on."""

    def __init__(self) -> None:
        self.ends: list = []
        self.ranks: list = []

    def best(self, end):
        i = bisect_left(self.ends, end)
        return self.ranks[i] if i < len(self.ends) else None

    def add(self, end, rank) -> None:
        i = bisect_left(self.ends, end)
        if i < len(self.ends) and self.ranks[i] <= rank:
            return
        high = i + (i < len(self.ends) and self.ends[i] == end)
        low = i
        while low and self.ranks[low - 1] >= rank:
            low -= 1
        self.ends[low:high], self.ranks[low:high] = [end], [rank]


def drop_contained(ranked_chunks: DataFrame) -> DataFrame:
    """Rows (file, start, end, rank, and others) that lie in no better-ranked row of the same file; rows with a null stay.

    One sweep a file in the order of starts: of the ranges that began before, those that no other one beats in end and rank
    are held, so a row is one search among them and no pair of ranges is formed.
    """
    prepared(ranked_chunks)
    names = ["file", "start", "end", "rank"]
    keyed = ranked_chunks.select(*(F.col(c).alias(f"_{c}") for c in names), F.struct("*").alias("_all"))
    whole = keyed.where(" AND ".join(f"_{c} IS NOT NULL" for c in names))
    n = len(names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, seen = None, _Stairs()
        for b in batches:
            keep = []
            for f, _, end, rank in zip(*(c.to_pylist() for c in b.columns[:n]), strict=True):
                if f != file:
                    file, seen = f, _Stairs()
                better = seen.best(end)
                keep.append(better is None or better >= rank)
                seen.add(end, rank)
            yield pa.RecordBatch.from_arrays([b.column(n)], names=["all"]).filter(pa.array(keep, pa.bool_()))

    kind = ranked_chunks.schema.simpleString()
    swept = whole.repartition("_file").sortWithinPartitions("_file", "_start", "_rank").select(*(f"_{c}" for c in names), "_all").mapInArrow(run, f"all {kind}")
    return swept.select("all.*").unionByName(keyed.where(" OR ".join(f"_{c} IS NULL" for c in names)).select("_all.*"))


def within_budget(ranked_rows: DataFrame, budget: int, tokens: str = "tokens", rank: str = "rank") -> DataFrame:
    """Rows of a result in order of rank while their running token sum fits; the first always stays."""
    w = Window.orderBy(rank)
    return ranked_rows.withColumns({"_upto": F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_place": F.row_number().over(w)}).where((F.col("_place") == 1) | (F.col("_upto") <= budget)).drop("_upto", "_place")


def query_terms(query: str) -> list[str]:
    """Words of over two bytes, in lower case; repeated ones count again."""
    return [t.lower() for t in re.split(r"[^\w]+", query) if len(t.encode()) > 2]


def rerank(results: DataFrame, query: str, content: str = "text", alpha: float = 0.25) -> DataFrame:
    """confidence * (1 - alpha) + alpha * share of query terms found, for queries of two terms or more."""
    terms = query_terms(query)
    if len(terms) < 2:
        return results
    return results.withColumn("confidence", (1 - alpha) * F.col("confidence") + alpha * overlap(F.col(content), terms))


def ending(term: Column) -> Column:
    """Key of a term: its length and its second half."""
    n = F.length(term)
    return F.concat(n, F.lit(">"), F.substring(term, F.floor(n / 2).cast("int") + 1, n))


def near_halves(word: str) -> tuple[set[tuple[int, str]], set[str]]:
    """Lengths with first halves, and keys as ``ending`` makes them: every term at distance 1 at most has one of these, since
    its other half is as in the word, or the two letters in its middle are exchanged."""
    n, firsts, endings = len(word), set(), set()
    for m in range(max(1, n - 1), n + 2):
        firsts.add((m, word[: m // 2]))
        endings.add(f"{m}>{word[max(0, n - (m - m // 2)) :]}")
    if n > 1:
        firsts.add((n, word[: n // 2 - 1] + word[n // 2]))
    return firsts, endings


def fuzzy_terms(dictionary: DataFrame, *words: str, term: str = "term") -> DataFrame:
    """Terms at Damerau-Levenshtein distance 1 at most of one of the words; an exchange of neighbours counts 1."""
    near = F.lit(False)
    for word in words:
        swaps = [word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)]
        near = near | F.levenshtein(F.col(term), F.lit(word), 1).between(0, 1)
        near = near | F.col(term).isin(*swaps) if swaps else near
    return dictionary.where(near)


def overlaps_hunk(chunks: DataFrame, hunks: DataFrame) -> DataFrame:
    """Chunks (file, start, end) that a hunk (file, start, end) touches, files equal.

    One sweep a file: of the hunks that begin up to a chunk's end the greatest end tells, so no pair is formed.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in chunks.columns))
    c = chunks.where("file is not null").select(F.col("file").alias("_file"), F.col("end").cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_reach"), row.alias("_row"))
    h = hunks.where("file is not null").select(F.col("file").alias("_file"), F.col("start").cast("long").alias("_at"), F.lit(0).alias("_kind"), F.col("end").cast("long").alias("_reach"), F.lit(None).cast(chunks.schema).alias("_row"))
    upto = Window.partitionBy("_file").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = c.unionByName(h).withColumn("_reach", F.max("_reach").over(upto))
    return swept.where((F.col("_kind") == 1) & (F.col("_reach") >= F.col("_row.start"))).select("_row.*")


def class_of(spark: SparkSession, query: str) -> str:
    """``query_class`` of one query that the caller holds."""
    return spark.range(1).select(query_class(F.lit(query))).first()[0]


def hybrid(docs: DataFrame, vectors: DataFrame, query: str, vector: list[float], top_n: int = 10, k: int = RRF_K, weight: float | None = None) -> DataFrame:
    """id, text, score, confidence: 2n candidates of each list, fused, joined to their text."""
    words = query.lower().split()
    semantic = vector_scores(vectors, vector)
    lexical = bm25(docs, words)
    fused = fuse(top_k(semantic, 2 * top_n), top_k(lexical, 2 * top_n), k, SEMANTIC_WEIGHT[class_of(docs.sparkSession, query)] if weight is None else weight)
    best = F.broadcast(top_k(fused, top_n))
    scored = best.join(semantic.select(F.col("id").alias("v"), F.col("score").alias("confidence")), F.col("id") == F.col("v"), "left").drop("v")
    return docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(scored), "id")
