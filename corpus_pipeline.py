"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing, packing. Part of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet in the shared folder and
reads it back for the next. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm import cuckoo_dedup, mixing, near_dedup, packing, quality_rules
from loomgrid.session import staged


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and short texts go; equal rows share a verdict, so all of them stay or go; an empty table gives an empty one;
    other columns pass through, names that begin with _qr_ are an error.
    """
    return quality_rules.keep_good(docs)


def one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id.

    A null text is an empty one; rows without a doc_id come last, and of rows that agree in text and doc_id one stays; an empty
    table gives an empty one; other columns pass through, names that begin with _cx_ are an error.
    """
    return cuckoo_dedup.keep_one_copy(docs)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the row with the smallest doc_id.

    Texts without words and rows without a doc_id stay; rows that share a doc_id are one document and stay or go together; an
    empty table gives an empty one; other columns pass through, names that begin with _nd_ are an error.
    """
    return near_dedup.keep_one_of_each(docs, size=5)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: rows repeat as often as the mix takes them.

    Null sources are one source, the last; null and empty texts have no size and are not taken; rows of equal hash keep a fixed
    order; an empty table gives an empty one; other columns pass through, names that begin with _mx_ are an error.
    """
    return mixing.repeated(mixing.mix(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences: doc_id and the place of each piece, whatever other columns there are.

    A null text is an empty one and has one id; repeated rows are packed each; an empty table gives no piece.
    """
    pieces = packing.pack(docs)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", good_documents),
    ("exact_dedup", one_copy),
    ("near_dedup", one_of_similar),
    ("source_mix", mixed),
    ("packing", packed),
]

#: Tokenisation, seeded hashes and the iterative stages have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
