"""Search inside changed lines: hunks by file, chunks that they touch, and searches over those alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_path
from .retrieve import Options, search_chunks
from .search import overlaps_hunk


def hunks_by_file(hunks: DataFrame) -> DataFrame:
    """file, ranges (sorted by start, end; repeated ones stay)."""
    return hunks.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))


def _endings(path: Column) -> Column:
    """The path and what follows each of its slashes."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def touched(chunks: DataFrame, hunks: DataFrame) -> DataFrame:
    """Chunks (file, start, end) that a hunk (file, start, end) touches. Files are equal or one path ends with '/' and the other.

    Paths meet by equality of their endings, so no pair of files is compared that does not match.
    """
    c = chunks.select("file", normal_path(F.col("file")).alias("c")).distinct()
    h = hunks.select(normal_path(F.col("file")).alias("h")).distinct()
    one = c.select("file", F.explode(_endings(F.col("c"))).alias("h")).join(h, "h").select("file", "h")
    two = c.join(h.select("h", F.explode(_endings(F.col("h"))).alias("c")), "c").select("file", "h")
    ranges = one.union(two).distinct().join(hunks.select(normal_path(F.col("file")).alias("h"), "start", "end"), "h").select("file", "start", "end")
    return overlaps_hunk(chunks, ranges)


def search_changes(chunks: DataFrame, hunks: DataFrame, query: str, vectors: DataFrame | None = None, vector: list[float] | None = None, o: Options = Options(), index=None) -> DataFrame:
    """``search_chunks`` among the chunks that a hunk touches, with the counts and lengths of all chunks; each of them can be found."""
    return search_chunks(chunks, query, vectors, vector, o, index, touched(chunks, hunks))
