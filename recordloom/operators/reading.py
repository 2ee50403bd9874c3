"""The reader's side: timed blocks, the block that is active at a time, and the map of what is timed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import precision_rank

# How exact a player's time is, and how far back a block may have begun.
EPSILON, LOOK_BACK = 0.25, 1800.0


def timed_blocks(blocks: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """blocks with their entry's timing, those that have one; of several entries of a block the last by ord counts."""
    last = entries.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in entries.columns if c not in keys]), "ord").alias("timing"))
    return blocks.join(last, keys).select(*blocks.columns, "timing.*").drop("ord")


def is_specific() -> Column:
    return (F.col("review_state") == "manual_reviewed") | (F.col("precision") == "approximate_dialogue_turn")


def merge_ranges(ranges: DataFrame, keys: list[str], gap: float = 1.0) -> DataFrame:
    """(keys, start, end) of ranges that have a length, joined where one begins at most gap after the end so far."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = ranges.where("end > start").withColumn("__new", F.when(F.col("start") <= reach + gap, 0).otherwise(1))
    rows = rows.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def timeline_map(ranges: DataFrame, duration: Column) -> DataFrame:
    """ranges with left and width in percent of the duration, inside 0 to 100."""
    left = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("start") / duration * 100))
    rows = ranges.withColumn("left", left)
    return rows.withColumn("width", F.greatest(F.lit(0.0), F.least(100 - F.col("left"), (F.col("end") - F.col("start")) / duration * 100)))


def active_block_at(probes: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """probes (keys, probe, t) with the block (keys, block_id, sequence, start, end, precision) active at t, or null.

    Active is what began at most half an hour before and has not ended, both by the player's exactness; of those the
    most exact, then the latest, then the first in the record. Both sides are cut into spans of the look-back, so this is
    an equality join: a block is in one span and a probe in up to three."""
    spans = blocks.withColumn("__span", F.floor(F.col("start") / LOOK_BACK))
    asked = probes.withColumn("__span", F.explode(F.sequence(F.floor((F.col("t") - LOOK_BACK) / LOOK_BACK), F.floor((F.col("t") + EPSILON) / LOOK_BACK))))
    hits = asked.join(spans, [*keys, "__span"]).where((F.col("start") <= F.col("t") + EPSILON) & (F.col("start") >= F.col("t") - LOOK_BACK) & (F.col("end") >= F.col("t") - EPSILON))
    best = hits.groupBy(*keys, "probe").agg(F.min(F.struct((-precision_rank(F.col("precision"))).alias("a"), (-F.col("start")).alias("b"), F.col("sequence").alias("c"), "block_id")).alias("x"))
    return probes.join(best.select(*keys, "probe", F.col("x.block_id").alias("block_id")), [*keys, "probe"], "left")


def range_distance(value: Column, start: Column, end: Column) -> Column:
    """How far value is from a range; 0 inside."""
    return F.greatest(F.lit(0.0), start - value, value - end)
