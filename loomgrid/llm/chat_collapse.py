"""Chat formatting with cumulative-snapshot collapse, with DataFrame functions only.

Chat logs often hold the same conversation several times, each snapshot longer than the one before. Every turn gets
the rolling hash of its conversation's turns so far: the exclusive or of 64-bit hashes of (place, role, text), in two
independent versions. A conversation is a snapshot if another one has, at the same place and not at its end, the same
rolling hash; anti-joins on (length, hashes) leave the maximal conversations. Equal conversations collapse to the
smallest conv_id. The survivors are rendered to one text each.

Prefix keys are made distinct before the join, so a first turn that a third of all conversations share is one row
there. Defined results: turns are ordered by turn (null first), then role and text (null as empty, and before it), so ties and repeated turns keep a
fixed order; null roles and texts differ from empty ones in the hashes and render as empty; very long texts render
whole; turns whose conv_id is null belong to no common conversation: each is one of its own (an unbounded group would meet
in one task otherwise), and a named one of equal turns stands for them; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged


def _hashes(place: Column) -> dict[str, Column]:
    body = (F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))
    return {"one": F.xxhash64(place, *body), "two": F.xxhash64(F.lit("second"), *reversed(body), place)}


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place, h1, h2 (rolling hashes up to that place), last."""
    empty = [F.coalesce(c, F.lit("")) for c in ("role", "text")]
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), *empty, F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = turns.where("conv_id is not null").select("conv_id", "turn", "role", "text", F.row_number().over(order).alias("place"))
    rows = rows.withColumns(_hashes(F.col("place")))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = rows.select("conv_id", "place", F.bit_xor("one").over(upto).alias("h1"), F.bit_xor("two").over(upto).alias("h2"), F.lead("place").over(order).isNull().alias("last"))
    single = turns.where("conv_id is null").withColumn("place", F.lit(1)).withColumns(_hashes(F.col("place")))
    return named.unionByName(single.select("conv_id", "place", F.col("one").alias("h1"), F.col("two").alias("h2"), F.lit(True).alias("last")))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id of each conversation that stays, its n_turns, n_copies (equal conversations, itself included) and hashes."""
    rows = staged(prefixes(turns), "chat-prefixes")
    whole = rows.where("last").groupBy(F.col("place").alias("n_turns"), "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    inner = rows.where("not last").select(F.col("place").alias("n_turns"), "h1", "h2").distinct()
    return whole.join(inner, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies", "h1", "h2")


def collapse(conversations: DataFrame) -> DataFrame:
    """One row for each maximal conversation: conv_id, n_turns, n_copies, rendered."""
    turns = conversations.select("conv_id", "turn", "role", "text")
    kept = maximal(turns).withColumnRenamed("conv_id", "_ch_id")
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    by = (F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    told = F.array_sort(F.collect_list(F.struct("turn", *by, line.alias("line"))))
    mine = turns.join(kept, F.col("conv_id") == F.col("_ch_id"))
    named = mine.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_join(F.transform(told, lambda t: t["line"]), "").alias("rendered"))
    alone = turns.where("conv_id is null").withColumns(_hashes(F.lit(1))).select(F.col("one").alias("h1"), F.col("two").alias("h2"), line.alias("rendered")).dropDuplicates(["h1", "h2"])
    single = kept.where("_ch_id is null").join(alone, ["h1", "h2"]).select(F.col("_ch_id").alias("conv_id"), "n_turns", "n_copies", "rendered")
    return named.unionByName(single)
