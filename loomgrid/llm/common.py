"""Small helpers that several of these operators use."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a maximal run of anything but these ASCII characters.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, whatever the optimiser inlines."""
    return F.transform(F.array(value), body)[0]


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def own_columns(docs: DataFrame) -> list[str]:
    """Input columns that an operator passes on."""
    return list(docs.columns)


def refuse(docs: DataFrame, *prefixes: str) -> None:
    """Names that an operator needs for itself are an error in its input: prefixes (with a leading _) and whole names."""
    taken = [c for c in docs.columns if c.lower().startswith(tuple(x for x in prefixes if x.startswith("_"))) or c.lower() in prefixes]
    if taken:
        raise ValueError(f"reserved column names: {taken}")
