"""The composed jobs: a session is prepared (its record, video and chunks), and finalised (aligned, published, entered in the manifest)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import alignment as A
from . import publishing as P
from .speech import plan_windows

# The state that a finalised session is left in, and the windows of its recognition.
FINALISED = "automated_review_pending"
CHUNK_SECONDS, OVERLAP_SECONDS = 1800.0, 15.0


def _demanded(value: Column, fine: Column, message: Column) -> Column:
    """value, failing with message where it is not fine."""
    return F.when(F.coalesce(fine, F.lit(False)), value).otherwise(F.raise_error(message).cast("string"))


def matched_sessions(requested: DataFrame, records: DataFrame, matches: DataFrame, on: list[str]) -> DataFrame:
    """requested (on) with what records and matches (on, status, video_id, ...) have of them, failing on a session that
    is in neither or one of them only, or that has no unique video. matches gives the columns that both have."""
    name = F.concat_ws("/", *[F.col(c).cast("string") for c in on])
    more = [c for c in records.columns if c not in matches.columns]
    rows = requested.select(*on).distinct().join(records.select(*on, *more, F.lit(True).alias("__record")), on, "left").join(matches, on, "left")
    there = F.col("__record") & F.col("status").isNotNull()
    status = _demanded(F.col("status"), there, F.concat(F.lit("session is absent from discovery outputs: "), name))
    unique = (F.col("status") == "matched") & F.col("video_id").isNotNull()
    return rows.withColumn("status", status).withColumn("video_id", _demanded(F.col("video_id"), unique, F.concat(F.lit("session has no unique match: "), name))).drop("__record")


def prepared_sessions(sessions: DataFrame, key: str, seconds: float = CHUNK_SECONDS, overlap: float = OVERLAP_SECONDS) -> DataFrame:
    """sessions (key, duration_seconds, ...) with matrix, the chunks that recognition has to run over: a session's
    number, start, duration, and the range that each owns."""
    plans = plan_windows(sessions.select(key, F.lit(0.0).alias("from"), F.col("duration_seconds").cast("double").alias("to")), seconds, overlap)
    item = F.struct(F.format_string("%03d", "number").alias("number"), F.col("input_start").alias("start"), (F.col("input_end") - F.col("input_start")).alias("duration"), F.col("core_start").alias("own_start"), F.col("core_end").alias("own_end"))
    matrix = plans.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("matrix"))
    return sessions.join(matrix, key).withColumn("processing", F.struct(F.lit("prepared").alias("state")))


@dataclass
class Finalised:
    """What finalising gives: entries with conflict, documents (session, pages, outline, summary), report and manifest."""

    entries: DataFrame
    documents: DataFrame
    report: DataFrame
    manifest: DataFrame


def finalised(blocks: DataFrame, segments: DataFrame, overrides: DataFrame | None, manifest: DataFrame) -> Finalised:
    """Aligns and publishes sessions, and enters them in manifest (session_id, status, ...).

    blocks has what publishing needs besides (page, speaker, section_id, section_title); ids of sessions are those of
    the manifest. The report has (session, journal_blocks, asr_segments, timed_blocks, review_queue)."""
    entries = written(A.align(blocks, segments, overrides), "entries")
    summary = P.alignment_summary(blocks, entries)
    documents = P.public_payload(blocks, entries).join(summary, "session")
    heard = segments.groupBy("session").agg(F.count("*").alias("asr_segments"))
    timed = entries.where("not conflict").groupBy("session").agg(F.count("*").alias("timed_blocks"))
    queue = A.review_queue(entries).groupBy("session").agg(F.count("*").alias("review_queue"))
    report = summary.select("session", F.col("total_blocks").alias("journal_blocks"))
    for part in (heard, timed, queue):
        report = report.join(part, "session", "left")
    done = documents.select(F.col("session").alias("__s"))
    entered = manifest.join(done, F.col("session_id") == F.col("__s"), "left").withColumn("status", F.when(F.col("__s").isNotNull(), FINALISED).otherwise(F.col("status"))).drop("__s")
    return Finalised(entries, documents, report.na.fill(0), entered)


def realtime_factor(elapsed: Column, duration: Column) -> Column:
    return F.round(elapsed / duration, 4)


def status_log(states: DataFrame) -> DataFrame:
    """(key, state, at) rows of runs, the newest of each: where a run that was stopped goes on."""
    return states.groupBy("key").agg(F.max_by(F.struct(*[c for c in states.columns if c != "key"]), F.struct("at", "state")).alias("x")).select("key", "x.*")
