"""Operators over speech segments (keys..., start, end, normalized_text, and an order within equal starts).

Windows are by the caller's keys, such as a session: a task holds one at a time, and runs, quality and merging need
one shuffle by them. A whole day of one global timeline is cut by plan_windows and owned_segments first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What recognisers write for non-speech, and the limits of the quality rules.
NON_SPEECH = ["", "blank_audio", "music", "applause", "audience applauding", "speaking in foreign language", "speaks in foreign language"]
RUN_COUNT, RUN_SECONDS, LOOP_SECONDS = 3, 45.0, 20.0


def _before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def numbered_runs(segments: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """segments with run: which run of equal neighbouring texts, from 1, a segment is in."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fresh = F.when(F.col("normalized_text").eqNullSafe(F.lag("normalized_text").over(w)) & F.lag("start").over(w).isNotNull(), 0).otherwise(1)
    return segments.withColumn("__fresh", fresh).withColumn("run", F.sum("__fresh").over(w)).drop("__fresh")


def consecutive_runs(segments: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, run, normalized_text, count, duration): duration is from the first start to the last end, 0 at least."""
    rows = numbered_runs(segments, keys, order)
    ends = F.max_by("end", F.struct(*order)) - F.min_by("start", F.struct(*order))
    return rows.groupBy(*keys, "run").agg(F.first("normalized_text").alias("normalized_text"), F.count("*").alias("count"), F.greatest(F.lit(0.0), ends).alias("duration"))


def _low(runs: DataFrame) -> DataFrame:
    return runs.where(~F.col("normalized_text").isin(NON_SPEECH) & (F.col("count") >= RUN_COUNT))


def drop_repetition(segments: DataFrame, keys: list[str], order: list[str], least: float = RUN_SECONDS) -> DataFrame:
    """segments without runs of three or more equal texts that last at least so many seconds."""
    rows = numbered_runs(segments, keys, order)
    w = Window.partitionBy(*keys, "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lasts = F.last("end").over(w) - F.first("start").over(w)
    rows = rows.withColumn("__n", F.count("*").over(w)).withColumn("__d", lasts)
    loop = ~F.col("normalized_text").isin(NON_SPEECH) & (F.col("__n") >= RUN_COUNT) & (F.col("__d") >= least)
    return rows.where(~loop).drop("run", "__n", "__d")


def transcript_quality(segments: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Figures of each group of segments: counts, diversity, and seconds of speech, loops and markers."""
    spoken, lasts = ~F.col("normalized_text").isin(NON_SPEECH), F.greatest(F.lit(0.0), F.col("end") - F.col("start"))
    words = F.size(F.filter(F.split("normalized_text", " "), lambda t: t != ""))
    base = segments.groupBy(*keys).agg(
        F.count("*").alias("segment_count"),
        F.count_if(spoken).alias("lexical_segment_count"),
        F.coalesce(F.round(F.count_distinct(F.when(spoken, F.col("normalized_text"))) / F.nullif(F.count_if(spoken), F.lit(0)), 4), F.lit(0.0)).alias("lexical_unique_ratio"),
        F.round(F.sum(F.when(spoken, lasts).otherwise(0.0)), 3).alias("lexical_seconds"),
        F.round(F.sum(F.when(~spoken, lasts).otherwise(0.0)), 3).alias("non_speech_marker_seconds"),
        F.max(words).alias("__words"),
    )
    loops = _low(consecutive_runs(segments, keys, order)).groupBy(*keys).agg(F.round(F.max("duration"), 3).alias("__max"), F.round(F.sum(F.when(F.col("duration") >= LOOP_SECONDS, F.col("duration")).otherwise(0.0)), 3).alias("__sum"))
    out = base.join(loops, keys, "left")
    return out.withColumn("max_repeated_phrase_seconds", F.coalesce("__max", F.lit(0.0))).withColumn("repeated_phrase_seconds", F.coalesce("__sum", F.lit(0.0))).withColumn("max_words", F.col("__words")).drop("__max", "__sum", "__words")


def findings(seconds: Column) -> Column:
    """The findings of a window of so many seconds from its transcript_quality columns; no segments are null columns."""
    n, ratio = F.col("lexical_segment_count"), F.col("lexical_unique_ratio")
    half = F.least(F.lit(60.0), seconds * 0.5)
    long = F.col("lexical_seconds") >= half
    poor = ((n >= 12) & (ratio < 0.25)) | ((n >= 3) & (ratio <= 0.34) & long) | ((n > 0) & (n <= 2) & long & (F.col("max_words") <= 2))
    found = F.array(
        F.when(F.col("max_repeated_phrase_seconds") >= LOOP_SECONDS, "repeated_phrase_loop"),
        F.when(poor, "low_lexical_diversity"),
        F.when((F.col("non_speech_marker_seconds") >= half) & (n <= 2), "non_speech_dominated"),
    )
    return F.when(F.coalesce("segment_count", F.lit(0)) == 0, F.array(F.lit("empty_output"))).otherwise(F.array_compact(found))


def quarantined(found: Column) -> Column:
    """Whether a retried window's findings keep it out: loops and low diversity do."""
    return F.arrays_overlap(found, F.array(F.lit("repeated_phrase_loop"), F.lit("low_lexical_diversity")))


def retry_rollup(judged: DataFrame, keys: list[str], seconds: Column) -> DataFrame:
    """Of windows with findings f: how many there are, are retried, and stay out, and for how long."""
    out = quarantined(F.col("f"))
    return judged.groupBy(*keys).agg(F.count("*").alias("windows"), F.count_if(F.size("f") > 0).alias("retried"), F.count_if(out).alias("quarantined"), F.sum(F.when(out, seconds).otherwise(0.0)).alias("quarantined_seconds"))


def _judged(segments: DataFrame, plans: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """plans with f, the findings of their segments."""
    on = [*keys, "number"]
    return plans.join(transcript_quality(segments, on, order), on, "left").withColumn("f", findings(F.col("core_end") - F.col("core_start"))).select(*plans.columns, "f")


def retry_windows(first: DataFrame, plans: DataFrame, keys: list[str], order: list[str], seconds: float = 30.0, overlap: float = 2.0) -> DataFrame:
    """The smaller windows by which windows of plans (keys, number, core_start, core_end) with findings are run again.

    first has the segments that the windows own, with their number; the rows returned have window, that number."""
    bad = _judged(first, plans, keys, order).where(F.size("f") > 0)
    return plan_windows(bad.select(*keys, F.col("number").alias("window"), F.col("core_start").alias("from"), F.col("core_end").alias("to")), seconds, overlap)


def retried(first: DataFrame, second: DataFrame, plans: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The segments of a first run and, for windows with findings, of a second by smaller ones; and (keys, number,
    findings, quarantined, fallback_findings) of the windows that were run again.

    Both have the number of the window of plans. Repetition is dropped from the second run's segments; windows that
    still loop or lack words stay out: a gap is better than what nobody said."""
    on = [*keys, "number"]
    judged = _judged(first, plans, keys, order)
    bad = judged.where(F.size("f") > 0)
    again = drop_repetition(second.join(bad.select(*on), on, "left_semi"), on, order)
    left = _judged(again, bad.drop("f"), keys, order)
    residual = F.array_intersect("f", F.array(F.lit("repeated_phrase_loop"), F.lit("low_lexical_diversity")))
    report = bad.select(*on, F.col("f").alias("findings")).join(left.select(*on, quarantined(F.col("f")).alias("quarantined"), residual.alias("fallback_findings")), on)
    kept = first.join(judged.where(F.size("f") == 0).select(*on), on, "left_semi")
    return kept.unionByName(again.join(report.where(~F.col("quarantined")).select(*on), on, "left_semi")), report


def quality_gate(quality: DataFrame) -> DataFrame:
    """quality, failing where a phrase is repeated for 45 seconds or more."""
    bad = F.col("max_repeated_phrase_seconds") >= RUN_SECONDS
    return quality.withColumn("max_repeated_phrase_seconds", F.when(bad, F.raise_error(F.concat(F.lit("quality gate: a phrase is repeated for seconds: "), F.col("max_repeated_phrase_seconds").cast("string"))).cast("double")).otherwise(F.col("max_repeated_phrase_seconds")))


def plan_windows(ranges: DataFrame, seconds: float, overlap: float) -> DataFrame:
    """ranges (from, to, others) with number, core_start, core_end, input_start and input_end of each of its windows.

    Cores are disjoint; inputs reach overlap further on both sides, inside the range."""
    if seconds <= 0 or not 0 <= overlap < seconds / 2:
        raise ValueError("an overlap is from 0 to under half a window")
    a, b = F.col("from"), F.col("to")
    fine = F.when((a < 0) | (b <= a), F.raise_error(F.lit("a range goes forward from 0")).cast("long")).otherwise(F.ceil((b - a) / seconds))
    out = ranges.withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), fine)))
    out = out.withColumn("core_start", a + (F.col("number") - 1) * seconds).withColumn("core_end", F.least(b, a + F.col("number") * seconds))
    return out.withColumn("input_start", F.greatest(a, F.col("core_start") - overlap)).withColumn("input_end", F.least(b, F.col("core_end") + overlap))


def owned_segments(segments: DataFrame, plans: DataFrame, seconds: float, origin: float = 0.0) -> DataFrame:
    """segments with the window of plans (number, core_start, core_end) whose core has their midpoint.

    Windows are seconds long from origin, so a midpoint's window is an equality join on its number, not a range join."""
    middle = (F.col("start") + F.col("end")) / 2
    number = (F.floor((middle - origin) / seconds) + 1).cast("long")
    return segments.withColumn("number", number).join(plans, "number").where((middle >= F.col("core_start")) & (middle < F.col("core_end")))


def not_monotonic(segments: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Segments that start before the one before them, or end before they start."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return segments.withColumn("previous_start", F.lag("start").over(w)).where((F.col("start") < F.col("previous_start")) | (F.col("end") < F.col("start")))


def merge_renumber(segments: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """segments of all chunks in order of (start, end), with ids from asr-000001 in every group."""
    w = Window.partitionBy(*keys).orderBy("start", "end", *ties)
    return segments.withColumn("id", F.format_string("asr-%06d", F.row_number().over(w)))


def chunk_rollup(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """One row a session of its chunks' runtime figures."""
    return chunks.groupBy(*keys).agg(F.count("*").alias("chunk_count"), F.round(F.sum("elapsed_seconds"), 3).alias("elapsed_seconds"), F.max("peak_rss_bytes").alias("peak_rss_bytes"), F.array_sort(F.collect_set("engine_version")).alias("engine_versions"), F.sum("primary_window_count").alias("primary_window_count"), F.sum("retried_window_count").alias("retried_window_count"), F.sum("quarantined_window_count").alias("quarantined_window_count"))


def checked_chunks(chunks: DataFrame, plans: DataFrame, key: str = "number") -> DataFrame:
    """chunks, failing unless each of plans has one, and no other has."""
    sides = chunks.select(key, F.lit(1).alias("__have"), F.lit(0).alias("__want")).unionByName(plans.select(key, F.lit(0).alias("__have"), F.lit(1).alias("__want")))
    odd = sides.groupBy(key).agg(F.sum("__have").alias("a"), F.sum("__want").alias("b")).agg(F.count_if((F.col("a") != 1) | (F.col("b") != 1)).alias("__odd"))
    fine = F.when(F.col("__odd") > 0, F.raise_error(F.lit("the chunks are not those of the plan")).cast("boolean")).otherwise(True)
    return chunks.join(F.broadcast(odd)).where(fine).drop("__odd")  # one row


def merge_faults(segments: DataFrame, sessions: DataFrame, keys: list[str], grace: float = 30.0) -> DataFrame:
    """(keys, fault) of merged sessions that have no segments, begin before their origin, or end grace after their duration.

    sessions has keys, origin and duration."""
    spans = segments.groupBy(*keys).agg(F.min("start").alias("__first"), F.max("end").alias("__last"))
    fault = F.when(F.col("__first").isNull(), "no_segments").when(F.col("__first") < F.col("origin"), "before_origin").when(F.col("__last") > F.col("origin") + F.col("duration") + grace, "after_end")
    return sessions.join(spans, keys, "left").withColumn("fault", fault).where("fault is not null").select(*keys, "fault")
