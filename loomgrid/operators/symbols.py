"""Definitions in source files as rows, from the nodes of ``syntax``.

Defined results: null and empty contents give no rows; files of other languages than those of ``syntax.LANGUAGES`` neither;
strings and comments hold no definitions; nodes without a name (statements, bodies) do not count as a level.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import language_named
from ..session import prepared
from . import syntax

SYMBOL = "file string, line int, end_line int, depth int, kind string, name string"


def definitions(files: DataFrame, max_depth: int = 3, language: str | None = None) -> DataFrame:
    """file, line, end_line, depth (from 0), kind, name for files (file, language, content), to ``max_depth`` levels.

    kind is the word that opens the definition, or 'function'. language: of these files alone, by any of its names.
    """
    prepared(files)
    wanted = F.lower("language").isin(list(syntax.LANGUAGES))
    known = files.where(wanted & (F.lower("language") == language_named(language)) if language else wanted)
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    names = [c.split(" ")[0] for c in SYMBOL.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(file, *r) for file, kind, text in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in syntax.symbol_rows((text or "").replace("\r", ""), kind, max_depth)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return known.select("file", F.lower("language").alias("language"), F.col("content").cast("string").alias("content")).mapInArrow(run, SYMBOL)


def outline(symbols: DataFrame) -> DataFrame:
    """file, symbols (in the order of lines), count: one row a file."""
    return symbols.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "end_line", "depth", "kind", "name"))).alias("symbols"), F.count(F.lit(1)).alias("count"))


def omitted_files(files: DataFrame, symbols: DataFrame) -> int:
    """Number of files without any symbol."""
    return files.select("file").distinct().join(symbols.select("file").distinct(), "file", "left_anti").count()
