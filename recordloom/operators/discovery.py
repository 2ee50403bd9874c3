"""What is to be done: records and their videos, the manifest, revisions, and the plan of the next intake.

Dates are the join keys, each side aggregated first; a date that many records share is one row by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# States that discovery may still change, and those that a preserved source does not reset.
OPEN_STATES = ["discovered", "review_required"]
LATER_STATES = ["pdf_parsed", "aligned", "published", "prototype_ready_review_pending"]


def unique_date_match(records: DataFrame, videos: DataFrame, on: list[str], order: str = "video_id") -> DataFrame:
    """records with the one video of their date; more or none need review, all their candidates listed in their order.

    A reviewer chooses among all candidates of a date, so all are listed: as many as the playlist has for it."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("video_id").alias("v"))))
    found = videos.groupBy(*on).agg(F.transform(listed, lambda x: x["v"]).alias("candidate_video_ids"))
    rows = records.join(found, on, "left").withColumn("candidate_video_ids", F.coalesce("candidate_video_ids", F.array().cast("array<string>")))
    one = F.size("candidate_video_ids") == 1
    return rows.withColumn("status", F.when(one, "matched").otherwise("review_required")).withColumn("match_confidence", F.when(one, 1.0).otherwise(0.0)).withColumn("video_id", F.when(one, F.element_at("candidate_video_ids", 1)))


def summary(matches: DataFrame) -> DataFrame:
    """How many records there are, matched ones and others."""
    return matches.agg(F.count("*").alias("records"), F.count_if(F.col("status") == "matched").alias("matched"), F.count_if(F.col("status") != "matched").alias("review_required"))


def manifest_upsert(manifest: DataFrame, matches: DataFrame) -> DataFrame:
    """manifest (session_id, session_date, journal_number, source_url, current_revision, status, youtube_video_id) with
    new and refreshed sessions of matches (session_id, session_date, journal_number, source_url, status, video_id).

    Sessions that are already processed keep their status; a video is set where there is a match."""
    old, new = manifest.alias("o"), matches.alias("n")
    rows = old.join(new, F.col("o.session_id") == F.col("n.session_id"), "full_outer")
    seen = F.col("n.session_id").isNotNull()
    fresh = F.when(F.col("n.status") == "matched", "discovered").otherwise("review_required")
    status = F.when(seen & (F.col("o.status").isNull() | F.col("o.status").isin(OPEN_STATES)), fresh).otherwise(F.col("o.status"))
    pick = lambda c: F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return rows.select(pick("session_id"), pick("session_date"), pick("journal_number"), pick("source_url"), F.when(seen, F.coalesce("o.current_revision", F.lit(0))).otherwise(F.col("o.current_revision")).alias("current_revision"), status.alias("status"), F.coalesce("n.video_id", "o.youtube_video_id").alias("youtube_video_id"))


def status_patch(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """manifest after sources of done (session_id, revision) have been preserved."""
    rows = manifest.join(done.select("session_id", F.col("revision").alias("__r")), "session_id", "left")
    status = F.when(F.col("__r").isNotNull() & ~F.coalesce(F.col("status").isin(LATER_STATES), F.lit(False)), "source_preserved").otherwise(F.col("status"))
    return rows.withColumn("status", status).withColumn("current_revision", F.coalesce("__r", "current_revision")).drop("__r")


def pending_sessions(matches: DataFrame, preserved: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Dates to process: matched, and either new and after all preserved ones, or preserved from another address.

    matches has session_date, source_url and status; preserved has session_date and source_url; both have keys, if
    given: each combination of them is a feed of its own."""
    keys, on = keys or [], [*(keys or []), "session_date"]
    rows = matches.join(preserved.select(*on, F.col("source_url").alias("__have")), on, "left")
    have = F.col("__have").isNotNull()
    latest = rows.groupBy(*keys).agg(F.max(F.when(have, F.col("session_date"))).alias("__latest"))
    rows = rows.join(latest, keys) if keys else rows.join(F.broadcast(latest))  # one row
    new = ~have & (F.col("__latest").isNull() | (F.col("session_date") > F.col("__latest")))
    return rows.where((F.col("status") == "matched") & (new | (F.col("__have") != F.col("source_url")))).select(*on).distinct()


def intake_plan(matches: DataFrame, preserved: DataFrame, pending: DataFrame, requested: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, session_date, session_id, source_url, video_id, branch, reason): work, by the first reason that holds.

    pending and requested have session_date: those with a branch under way, and those asked for. All have keys, if given:
    each combination of them is a feed of its own."""
    keys, on = keys or [], [*(keys or []), "session_date"]
    flag = lambda df, name: df.select(*on).distinct().withColumn(name, F.lit(True))
    rows = matches.join(preserved.select(*on, F.col("source_url").alias("__have")), on, "left").join(flag(pending, "__pending"), on, "left").join(flag(requested, "__asked"), on, "left")
    have = F.col("__have").isNotNull()
    last = rows.groupBy(*keys).agg(F.max(F.when(have, F.col("session_date"))).alias("__latest"), F.max("session_date").alias("__newest"))
    rows = rows.join(last, keys) if keys else rows.join(F.broadcast(last))  # one row
    reason = (
        F.when(F.col("__asked"), "requested_session")
        .when(F.col("__pending") & ~have, "pending_video_or_processing")
        .when(~have & (F.col("__latest").isNull() | (F.col("session_date") > F.col("__latest"))), "new_journal")
        .when(have & (F.col("__have") != F.col("source_url")), "source_url_changed")
        .when(have & (F.col("session_date") == F.col("__newest")), "verify_latest_revision")
    )
    rows = rows.withColumn("reason", reason).where("reason is not null")
    return rows.select(*on, "session_id", "source_url", F.when(F.col("status") == "matched", F.col("video_id")).alias("video_id"), F.concat(F.lit("automation/session-"), F.col("session_date").cast("string")).alias("branch"), "reason")


def unknown_requests(requested: DataFrame, records: DataFrame) -> DataFrame:
    """Requested dates that no record has."""
    return requested.join(records, "session_date", "left_anti")


def revision_register(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming (source, sha256, retrieved_at, ...) with its revision, and changed: whether it is a new one.

    Content that known (source, revision, sha256) has keeps its revision; other content gets the next ones, in order of
    retrieval, equal content once. A source's first revision supersedes none."""
    have = known.groupBy("source", "sha256").agg(F.min("revision").alias("__have"))
    last = known.groupBy("source").agg(F.max("revision").alias("__last"))
    rows = incoming.join(have, ["source", "sha256"], "left").join(last, "source", "left")
    first = rows.where("__have is null").groupBy("source", "sha256").agg(F.min("retrieved_at").alias("__at"))
    nth = F.row_number().over(Window.partitionBy("source").orderBy("__at", "sha256"))
    rows = rows.join(first.select("source", "sha256", "__at", nth.alias("__nth")), ["source", "sha256"], "left")
    revision = F.coalesce(F.col("__have"), F.coalesce("__last", F.lit(0)) + F.col("__nth")).cast("long")
    rows = rows.withColumn("revision", revision).withColumn("changed", F.col("__have").isNull() & (F.col("retrieved_at") == F.col("__at")))
    return rows.withColumn("supersedes_revision", F.when(F.col("revision") > 1, F.col("revision") - 1)).drop("__have", "__last", "__at", "__nth")


def current_revisions(known: DataFrame) -> DataFrame:
    """The newest revision of every source."""
    return known.groupBy("source").agg(F.max_by(F.struct(*known.columns), "revision").alias("x")).select("x.*")


def fingerprint_reuse(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Work whose fingerprint no finished work of the same key has."""
    return wanted.join(done.select("key", "fingerprint"), ["key", "fingerprint"], "left_anti")


def processing_plan(chunks: DataFrame) -> DataFrame:
    """plan_windows rows as jobs: id, owned range, and the range to read."""
    return chunks.select(F.format_string("chunk-%03d", "number").alias("id"), "number", F.col("input_start").alias("start"), F.col("input_end").alias("end"), F.col("core_start").alias("own_start"), F.col("core_end").alias("own_end"))


def duration_faults(probes: DataFrame) -> DataFrame:
    """Rows (requested_start, requested_end, duration) whose length is off by more than 5 seconds and 2 %, or not positive."""
    asked = F.col("requested_end") - F.col("requested_start")
    off = F.abs(F.col("duration") - asked) > F.greatest(F.lit(5.0), asked * 0.02)
    return probes.where(F.coalesce((asked <= 0) | off, F.lit(False)))
