"""Mixing sources to target weights by capped water-filling.

Sources share the corpus's size by weight. A source is clamped once its share exceeds ``max_epochs`` times its own
size; what it cannot take goes to the others by weight, round by round, until none is above its cap. Each round is one
aggregate over the table of sources (a row each); a round that clamps no further source is the last.

Each source then takes every document ``floor(target / size)`` times whole, and a seeded sample of its documents once
more for the fraction. The sample is a prefix of the source's documents in the order of a seeded hash. To find where
the prefix ends, sizes are summed over hash ranges; only the one range of a source in which it ends is sorted (ranges
are ``1 / RANGES`` of a source, so a source with a third of all rows does not meet in one task). ``mix`` takes the
document on the boundary in part, so that the taken size meets the target to the word; ``repeated``, which makes the
mixed corpus, takes it whole or not at all, whichever is nearer, since no text is cut.

Defined results: a null text has size 0 and takes 0; very long texts count whole; a null source is a source of its own,
sorted last; equal sizes, null ids and repeated rows are ordered by hash of id and text, and rows that agree in both are
interchangeable. A source without words has target 0. An empty table gives an empty result. Extra columns pass through;
columns named ``_mx_*`` are an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .common import n_words, refuse

RANGES = 1 << 18
#: Fine ranges in a coarse one.
STEP = 1 << 9
SEED = 20_011


def _sized(docs: DataFrame, id_col: str, text: str, source: str, seed: int) -> DataFrame:
    refuse(docs, "_mx_")
    order = F.xxhash64(F.lit(seed), F.col(id_col), F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text))))
    return docs.withColumns({"_mx_size": n_words(F.col(text)), "_mx_hash": order, "_mx_source": F.col(source)}).withColumn("_mx_range", F.pmod(F.shiftright("_mx_hash", 40), F.lit(RANGES)).cast("int"))


def _with_weights(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Adds _mx_weight by the place of each source in code point order, null last: place in its range plus the range's offset."""
    name = F.col("_mx_source").cast("binary").asc_nulls_last()
    ranged = staged(sizes.orderBy(name).withColumn("_mx_part", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("_mx_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = ranged.groupBy("_mx_part").agg(F.count(F.lit(1)).alias("n")).select("_mx_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_mx_off"))
    place = F.row_number().over(Window.partitionBy("_mx_part").orderBy(name)) - 1 + F.col("_mx_off")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    return ranged.join(offset, "_mx_part").withColumn("_mx_weight", weight).drop("_mx_part", "_mx_off")


def water_fill(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 3.0) -> DataFrame:
    """sizes: _mx_source, _mx_source_size, a row a source. Adds _mx_target, the capped share of the total."""
    t = staged(_with_weights(sizes, weights).withColumn("_mx_cap", max_epochs * F.col("_mx_source_size")), "mix-weights")
    # the water a unit of weight stands at; sources below it are clamped
    level, clamped = 0.0, -1
    while True:
        over = F.col("_mx_cap") < F.col("_mx_weight") * level
        r = t.agg(F.sum("_mx_source_size").alias("total"), F.count_if(over).alias("n"), F.sum(F.when(over, F.col("_mx_cap"))).alias("held"), F.sum(F.when(~over, F.col("_mx_weight"))).alias("free")).first()
        if r["n"] == clamped or not r["free"]:
            break
        clamped, level = r["n"], (r["total"] - (r["held"] or 0.0)) / r["free"]
    target = F.col("_mx_cap") if not r["free"] else F.least("_mx_cap", F.col("_mx_weight") * level)
    return t.select("_mx_source", "_mx_source_size", target.cast("double").alias("_mx_target"))


def _plan(sized: DataFrame, weights, max_epochs) -> DataFrame:
    """A row for each source: its target, whole epochs, range in which the sample ends, and words wanted from it."""
    ranges = staged(sized.groupBy("_mx_source", "_mx_range").agg(F.sum("_mx_size").alias("_mx_words")), "mix-ranges")
    targets = water_fill(ranges.groupBy("_mx_source").agg(F.sum("_mx_words").alias("_mx_source_size")), weights, max_epochs)
    whole = F.when(F.col("_mx_source_size") > 0, F.floor(F.round("_mx_target") / F.col("_mx_source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("_mx_whole", whole).withColumn("_mx_rest", F.round("_mx_target").cast("long") - F.col("_mx_whole") * F.col("_mx_source_size"))

    def reached(sums: DataFrame, at: str, wanted: DataFrame) -> DataFrame:
        """Per source the first ``at`` at which the words so far exceed ``want``, and what is wanted from it."""
        upto = F.sum("_mx_words").over(Window.partitionBy("_mx_source").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        met = sums.withColumn("_mx_upto", upto).join(wanted, F.col("_mx_source").eqNullSafe(F.col("_mx_s"))).where("_mx_upto > want")
        return met.groupBy("_mx_s").agg(F.min_by(F.struct(F.col(at).alias("at"), (F.col("want") - F.col("_mx_upto") + F.col("_mx_words")).alias("want")), at).alias("c")).select("_mx_s", "c.*")

    # coarse ranges first, then the fine ones of the coarse range where the sample ends: no window holds more than STEP rows
    step = F.floor(F.col("_mx_range") / STEP).cast("int")
    coarse = ranges.groupBy("_mx_source", step.alias("_mx_step")).agg(F.sum("_mx_words").alias("_mx_words"))
    end = staged(reached(coarse, "_mx_step", targets.select(F.col("_mx_source").alias("_mx_s"), F.col("_mx_rest").alias("want"))), "mix-ends")
    inside = ranges.withColumn("_mx_step", step).join(end.select(F.col("_mx_s").alias("_mx_own"), F.col("at").alias("_mx_at")), F.col("_mx_source").eqNullSafe(F.col("_mx_own")) & (F.col("_mx_step") == F.col("_mx_at")))
    first = reached(inside.select("_mx_source", "_mx_range", "_mx_words"), "_mx_range", end.select("_mx_s", "want"))
    return staged(targets.join(first, F.col("_mx_s").eqNullSafe(F.col("_mx_source")), "left").select("_mx_source", "_mx_source_size", "_mx_target", "_mx_whole", F.coalesce("at", F.lit(RANGES)).alias("_mx_end"), F.coalesce("want", F.lit(0)).cast("long").alias("_mx_want")), "mix-plan")


#: Sources up to which the plan (under 100 bytes a source) is sent to every executor.
BROADCAST_SOURCES = 100_000


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 3.0, seed: int = SEED) -> DataFrame:
    """All input rows and columns with _mx_size, _mx_source_size, _mx_target, _mx_whole (whole repetitions), _mx_part (words of one more)."""
    sized = _sized(docs, id_col, text, source, seed)
    plan = _plan(sized, weights, max_epochs)
    few = plan.count() <= BROADCAST_SOURCES
    right = plan.withColumnRenamed("_mx_source", "_mx_s")
    rows = sized.join(F.broadcast(right) if few else right, F.col("_mx_source").eqNullSafe(F.col("_mx_s")))
    off = rows.where("_mx_range <> _mx_end").withColumn("_mx_part", F.when(F.col("_mx_range") < F.col("_mx_end"), F.col("_mx_size")).otherwise(0).cast("long"))
    w = Window.partitionBy("_mx_source").orderBy("_mx_hash", F.xxhash64(F.col(text)), "_mx_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = rows.where("_mx_range = _mx_end").withColumn("_mx_part", F.greatest(F.lit(0), F.least("_mx_size", F.col("_mx_want") - F.sum("_mx_size").over(w) + F.col("_mx_size"))).cast("long"))
    return off.unionByName(on)


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mixed corpus: each row as often as the mix takes it, always whole."""
    copies = F.expr("_mx_whole + if(_mx_part > 0 and 2 * _mx_part >= _mx_size, 1, 0)").cast("int")
    return mixed.withColumn("_mx_copy", F.explode(F.array_repeat(F.lit(0), copies))).select(*(F.col(f"`{c}`") for c in columns))
