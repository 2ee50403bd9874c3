"""Streaming forms: segments that come in overlapping windows, a forward-only gate, and the block at a player's time.

Event time is a TIMESTAMP column; a session's seconds count from the epoch in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reading import EPSILON, LOOK_BACK
from ..functions.text import precision_rank


def once_owned(segments: DataFrame, seconds: float, late: str = "10 minutes") -> DataFrame:
    """A stream of segments (session, start, end, text, ts) that overlapping windows may bring twice, each once, with its
    window: the one whose core has the midpoint. State is kept as long as duplicates may be late."""
    middle = (F.col("start") + F.col("end")) / 2
    rows = segments.withWatermark("ts", late).withColumn("number", (F.floor(middle / seconds) + 1).cast("long"))
    return rows.dropDuplicatesWithinWatermark(["session", "number", "start", "end"])


def window_counts(segments: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """(window, session, segments, spoken_seconds) of a stream, final once the watermark has passed a window."""
    rows = segments.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", f"{seconds} seconds"), "session").agg(F.count("*").alias("segments"), F.round(F.sum(F.col("end") - F.col("start")), 3).alias("spoken_seconds"))


def forward_only(sessions: DataFrame, late: str) -> DataFrame:
    """New sessions of a stream (session_id, ts): those later than the watermark, each once; late ones are left out."""
    return sessions.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_id"])


def active_stream(probes: DataFrame, blocks: DataFrame) -> DataFrame:
    """A stream of probes (session, probe, t) with all blocks of a static table that are active at t, and their rank;
    a batch's consumer takes the best, as reading.active_block_at does."""
    spans = blocks.withColumn("__span", F.floor(F.col("start") / LOOK_BACK))
    asked = probes.withColumn("__span", F.explode(F.sequence(F.floor((F.col("t") - LOOK_BACK) / LOOK_BACK), F.floor((F.col("t") + EPSILON) / LOOK_BACK))))
    hits = asked.join(spans, ["session", "__span"]).where((F.col("start") <= F.col("t") + EPSILON) & (F.col("start") >= F.col("t") - LOOK_BACK) & (F.col("end") >= F.col("t") - EPSILON))
    return hits.select("session", "probe", "block_id", precision_rank(F.col("precision")).alias("rank"), "start", "sequence")


RUN = "session string, run long, normalized_text string, count long, duration double"
_STATE = "run long, text string, count long, first double, last double"


def _runs(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    run, text, count, first, last = state.get if state.exists else (0, None, 0, 0.0, 0.0)
    done = []
    # Arrow cuts a trigger's rows into batches as it likes; a session's rows of a trigger are put in order together
    for r in pd.concat(batches).sort_values(["start", "end", "normalized_text"], kind="stable").itertuples(index=False):
        if r.normalized_text == text:
            count, last = count + 1, r.end
            continue
        if count:
            done.append((key[0], run, text, count, max(0.0, last - first)))
        run, text, count, first, last = run + 1, r.normalized_text, 1, r.start, r.end
    state.update((run, text, count, first, last))
    yield pd.DataFrame(done, columns=["session", "run", "normalized_text", "count", "duration"])


def streamed_runs(segments: DataFrame) -> DataFrame:
    """Runs of equal texts of a stream (session, start, end, normalized_text) in order, each once the next has begun;
    the one under way is a session's state. Rows of a trigger are put in order of start, end and text; a trigger's rows
    are taken to come after those of earlier ones."""
    return segments.groupBy("session").applyInPandasWithState(_runs, RUN, _STATE, "append", "NoTimeout")
