"""Search over chunks as one plan: candidates, fusion, containment, filters, confidence, budget, reranking, context.

``chunks`` has chunk_id, file, start, end, language, scope, content; ``vectors`` has chunk_id, embedding. Only the
candidates, at most four times ``top_n`` rows, are ordered in one task or broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import clauses as C
from . import search as S
from .chunking import context
from .store import Store, best_of, bm25_of

#: Boost of a match in the scope, and of one in the content.
BOOSTS = {"content": 1.0, "scope": 3.0}
RESULT = "id long, file string, start int, end int, language string, scope string, content string, score double, confidence double, tokens int, matched_lines array<int>"


@dataclass(frozen=True)
class Options:
    """What a search may set. ``weight`` of the semantic list: by the query's class if None. ``excludes`` are globs on
    path or base name; ``text_weight`` multiplies scores of chunks of language 'text' before containment.
    ``syntax``: phrases, signs and fields of the query are read, as in ``clauses``; they act on the lexical list."""

    mode: str = "hybrid"
    top_n: int = 10
    rrf_k: int = S.RRF_K
    weight: float | None = None
    language: str | None = None
    excludes: tuple[str, ...] = ()
    threshold: float = 0.3
    budget: int | None = None
    rerank: bool = False
    text_weight: float = 0.5
    analyse: Callable[[Column], Column] = T.analyse
    syntax: bool = False

    def __post_init__(self) -> None:
        if self.mode not in ("hybrid", "semantic", "lexical"):
            raise ValueError(f"mode {self.mode!r}: not hybrid, semantic or lexical")
        for name in ("threshold", "weight"):
            v = getattr(self, name)
            if v is not None and not 0 <= v <= 1:
                raise ValueError(f"{name} {v}: not between 0 and 1")


def lexical(chunks: DataFrame, query: str, o: Options, index: Store | None = None, k: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """id, score by BM25 over content and scope; the k best if k is given. Where no term of the query occurs, terms at edit
    distance 1 stand in, unless the query has phrases, signs or fields.

    index: a stored version with the same chunks; its analyser is used and no text is read. only: chunk_id of the chunks that
    may be found; counts and lengths are those of all chunks.
    """
    clauses = C.parse(query, tuple(BOOSTS)) if o.syntax else []
    signed = any(not c.plain for c in clauses)
    if clauses and not signed:
        query = " ".join(c.text for c in clauses)
    analyse = o.analyse if index is None else index.analyse
    terms = chunks.sparkSession.range(1).select(analyse(F.lit(query))).first()[0]
    long = sorted({t for t in terms if len(t.encode()) > 2})

    def best(scored: DataFrame) -> DataFrame:
        some = scored if only is None else scored.join(only.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_semi")
        return some if k is None else S.top_k(some, k)

    if signed:
        return best(C.search(chunks, clauses, BOOSTS, analyse, index))
    if index is not None:
        asked = terms
        if long and index.terms(terms).isEmpty():
            asked = [n for t in long for n in index.near_terms(t)]
        return best_of(index, asked, BOOSTS, k) if only is None and k is not None else best(bm25_of(index, asked, BOOSTS))
    found = S.bm25(chunks, terms, "chunk_id", BOOSTS, analyse)
    if not long or not found.isEmpty():
        return best(found)
    # one pass for all terms of the query
    words = [chunks.select(F.explode(analyse(F.coalesce(f, F.lit("")))).alias("term")) for f in BOOSTS]
    every = words[0].unionByName(words[1])
    near = [r[0] for r in S.fuzzy_terms(every, *long).distinct().collect()]
    return best(S.bm25(chunks, near, "chunk_id", BOOSTS, analyse)) if near else best(found)


def _weighted(scored: DataFrame, chunks: DataFrame, weight: float) -> DataFrame:
    if weight == 1:
        return scored
    rows = chunks.select(F.col("chunk_id").alias("id"), F.lower("language").alias("_l")).join(F.broadcast(scored), "id", "right")
    return rows.select("id", (F.col("score") * F.when(F.col("_l") == "text", weight).otherwise(1.0)).alias("score"))


def search_chunks(chunks: DataFrame, query: str, vectors: DataFrame | None = None, vector: list[float] | None = None, o: Options = Options(), index: Store | None = None, only: DataFrame | None = None) -> DataFrame:
    """Rows of RESULT for one query, best first. A blank query or ``top_n`` 0 gives none; exclude globs that cannot be read
    are ignored. index, only: as in ``lexical``."""
    if not query.strip() or o.top_n < 1:
        return chunks.sparkSession.createDataFrame([], RESULT)
    n, cosines = 2 * o.top_n, None
    if o.mode != "lexical":
        cosines = S.vector_scores(vectors if only is None else vectors.join(only.select("chunk_id").distinct(), "chunk_id", "left_semi"), vector, "chunk_id")
    if o.mode == "lexical":
        found = lexical(chunks, query, o, index, n, only)
    elif o.mode == "semantic":
        found = _weighted(S.top_k(cosines, n), chunks, o.text_weight)
    else:
        weight = S.SEMANTIC_WEIGHT[S.class_of(chunks.sparkSession, query)] if o.weight is None else o.weight
        found = _weighted(S.fuse(S.top_k(cosines, n), lexical(chunks, query, o, index, n, only), o.rrf_k, weight), chunks, o.text_weight)
    columns = [F.col("chunk_id").alias("id"), "file", "start", "end", "language", "scope", "content"]
    rows = chunks.select(*columns).join(F.broadcast(found), "id")
    ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    kept = S.drop_contained(ranked)
    if cosines is None:
        top = F.max("score").over(Window.partitionBy())
        kept = kept.withColumn("confidence", F.col("score") / F.greatest(top, F.lit(2.0**-23)))
    else:
        near = cosines.withColumnRenamed("score", "cosine").join(F.broadcast(found.select("id")), "id")
        kept = kept.join(F.broadcast(near), "id", "left").withColumn("confidence", F.coalesce("cosine", "score")).drop("cosine")
    kept = kept.where(F.col("confidence") >= o.threshold)
    if o.language is not None:
        kept = kept.where(F.lower("language") == T.language_named(o.language))
    for glob in T.valid_globs(o.excludes):
        kept = kept.where(~(F.col("file").rlike(T.glob_regex(glob)) | F.element_at(F.split("file", "/"), -1).rlike(T.glob_regex(glob))))
    kept = kept.orderBy("rank").limit(o.top_n).withColumn("tokens", T.n_tokens(F.col("content")))
    if o.budget is not None:
        kept = S.within_budget(kept, o.budget)
    if o.rerank:
        kept = S.rerank(kept, query, "content")
    out = kept.withColumn("matched_lines", T.matched_lines(F.col("content"), query, F.col("start")))
    by = ("rank",) if o.rerank and len(S.query_terms(query)) < 2 else (F.desc("confidence"), "id")
    return out.orderBy(*by).drop("rank")


def enrich(results: DataFrame, files: DataFrame, n: int = 0, whole: bool = False) -> DataFrame:
    """Adds context_before, context_after and display_start from files (file, content); without the file, the chunk stays
    as stored. ``whole``: the content is the file's."""
    if n == 0 and not whole:
        return results.withColumns({"display_start": F.col("start"), "context_before": F.lit(""), "context_after": F.lit("")})
    lines = F.split(F.regexp_replace("_text", r"\n$", ""), "\n")
    rows = files.select(F.col("file").alias("_file"), F.col("content").alias("_text"))
    both = rows.join(F.broadcast(results), F.col("_file") == F.col("file"), "right")
    known = F.col("_text").isNotNull()
    if whole:
        return both.withColumns({"display_start": F.when(known, 1).otherwise(F.col("start")), "content": F.coalesce("_text", "content"), "context_before": F.lit(""), "context_after": F.lit("")}).drop("_file", "_text")
    before, after = context(lines, F.col("start"), F.least(F.col("end"), F.size(lines)), n)
    body = F.array_join(F.slice(lines, F.col("start"), F.greatest(F.col("end") - F.col("start") + 1, F.lit(0))), "\n")
    new = {"display_start": F.when(known, F.greatest(F.col("start") - n, F.lit(1))).otherwise(F.col("start")), "context_before": F.coalesce(before, F.lit("")), "context_after": F.coalesce(after, F.lit("")), "content": F.coalesce(body, "content")}
    return both.withColumns(new).drop("_file", "_text")


def as_json_lines(results: DataFrame) -> DataFrame:
    """One JSON text a row, for ``write.text``."""
    return results.select(F.to_json(F.struct("*")).alias("value"))


def with_meta(results: DataFrame) -> DataFrame:
    """``as_json_lines`` in order of rank, then one line with the number of results and the sum of their tokens."""
    rows = results.coalesce(1).select(F.monotonically_increasing_id().alias("place"), F.to_json(F.struct("*")).alias("value"))
    told = results.agg(F.count(F.lit(1)).alias("total_results"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"))
    meta = told.select(F.lit((1 << 63) - 1).alias("place"), F.to_json(F.struct(F.struct("*").alias("_meta"))).alias("value"))
    return rows.unionByName(meta).orderBy("place").select("value")


def ad_hoc_chunks(docs: DataFrame) -> DataFrame:
    """Chunks of texts that have no index (file, content), with ids from 0."""
    from .code_chunks import chunk_files
    from .index import with_ids

    return with_ids(chunk_files(docs.select("file", "content", T.language_of(F.col("file")).alias("language"))), 0)
