"""Publication: one nested document a session, its summary, its outline, checks on it, and the index of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alignment_summary(blocks: DataFrame, entries: DataFrame) -> DataFrame:
    """Figures of each session. Entries are counted by block id, whether or not their block is there; conflicts apart."""
    total = blocks.groupBy("session").agg(F.count("*").alias("total_blocks"))
    kept = entries.where("not conflict").groupBy("session").agg(F.count_distinct("block_id").alias("timed_blocks"), F.count_if(F.col("review_state") == "needs_review").alias("needs_review"), F.count_if(F.col("review_state") == "manual_reviewed").alias("manual_reviewed"))
    clash = entries.groupBy("session").agg(F.count_if("conflict").alias("unresolved_conflicts"))
    out = total.join(kept, "session", "left").join(clash, "session", "left").na.fill(0)
    return out.withColumn("coverage", F.round(F.col("timed_blocks") / F.col("total_blocks"), 4))


def public_payload(blocks: DataFrame, entries: DataFrame) -> DataFrame:
    """(session, pages, outline): pages of blocks with their timings, sections with their first block and timing.

    blocks has session, pos, page, block_id, kind, text, speaker, section_id and section_title."""
    timing = F.struct("start", "end", F.lit("session_video").alias("time_domain"), "precision", "confidence", "review_state")
    timed = entries.where("not conflict").select("session", "block_id", timing.alias("timing"))
    rows = blocks.join(timed, ["session", "block_id"], "left")
    block = F.struct((F.col("pos") + 1).alias("sequence"), F.col("block_id").alias("id"), "kind", "text", "speaker", "section_id", "timing")
    pages = rows.groupBy("session", "page").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    pages = pages.groupBy("session").agg(F.array_sort(F.collect_list(F.struct(F.col("page").alias("number"), "blocks"))).alias("pages"))
    title = F.coalesce(F.min_by("section_title", "pos"), F.initcap(F.replace("section_id", F.lit("-"), F.lit(" "))))
    sections = rows.where("section_id is not null").groupBy("session", "section_id").agg(F.min("pos").alias("pos"), title.alias("title"), F.min_by("block_id", "pos").alias("first_block_id"), F.min_by("page", "pos").alias("page"), F.min_by("timing", F.when(F.col("timing").isNotNull(), F.col("pos"))).alias("timing"))
    outline = sections.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("section_id").alias("id"), "title", "first_block_id", "page", "timing"))), lambda s: s.dropFields("pos")).alias("outline"))
    return pages.join(outline, "session", "left")


def constraints() -> dict[str, Column]:
    """What must hold of every published block (sequence, page, start, end, confidence, id, kind, text)."""
    timed = F.col("start").isNotNull()
    return {
        "confidence_0_to_1": ~timed | F.col("confidence").between(0, 1),
        "end_from_0": ~timed | (F.col("end") >= 0),
        "has_id": F.col("id").isNotNull(),
        "has_kind": F.col("kind").isNotNull(),
        "has_text": F.col("text").isNotNull(),
        "page_from_1": F.col("page") >= 1,
        "sequence_from_1": F.col("sequence") >= 1,
        "start_from_0": ~timed | (F.col("start") >= 0),
    }


def schema_constraints(blocks: DataFrame) -> DataFrame:
    """(constraint, violations), in one pass."""
    rules = constraints()
    counts = blocks.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*map(F.col, rules)))).alias("constraint", "violations"))


def session_constraints() -> dict[str, Column]:
    """What must hold of every published session: types, formats, patterns and least values of its fields."""
    uri, text = r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]+$", lambda c: F.col(c).isNotNull()
    when = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"
    return {
        "channel": text("channel"),
        "coverage_0_to_1": F.col("coverage").between(0, 1),
        "date_format": F.rlike("date", F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")) & F.try_to_date("date").isNotNull(),
        "duration_above_0": F.col("duration_seconds") > 0,
        "id": text("id"),
        "journal_number_from_1": F.col("journal_number") >= 1,
        "journal_url_format": F.rlike("journal_url", F.lit(uri)),
        "needs_review_from_0": F.col("needs_review") >= 0,
        "page_count_from_1": F.col("page_count") >= 1,
        "playlist_id": text("playlist_id"),
        "retrieved_at_format": F.rlike("retrieved_at", F.lit(when)),
        "schema_version": F.col("schema_version") == "1.1.0",
        "sha256_pattern": F.rlike("sha256", F.lit("^[0-9a-f]{64}$")),
        "source_revision_from_1": F.col("source_revision") >= 1,
        "timed_blocks_from_0": F.col("timed_blocks") >= 0,
        "title": text("title"),
        "total_blocks_from_1": F.col("total_blocks") >= 1,
        "video_id": text("video_id"),
        "video_url_format": F.rlike("video_url", F.lit(uri)),
    }


def session_faults(sessions: DataFrame) -> DataFrame:
    """(id, constraint) of every violation; a field that is null, or missing in a row, is one."""
    wrong = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in session_constraints().items()]))
    return sessions.select("id", F.explode(wrong).alias("constraint"))


def validated(sessions: DataFrame) -> DataFrame:
    """sessions, failing on the first violations of one, ten at most, as the message lists them."""
    wrong = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in session_constraints().items()]))
    message = F.concat(F.lit("public session schema validation failed: "), F.array_join(F.slice(wrong, 1, 10), "; "))
    return sessions.withColumn("schema_version", F.when(F.size(wrong) == 0, F.col("schema_version")).otherwise(F.raise_error(message).cast("string")))


def shown_blocks(blocks: DataFrame) -> DataFrame:
    """The blocks that a reader sees: all but other ones."""
    return blocks.where("kind <> 'other'")


def first_violations(blocks: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """The first violations by path, as a report shows them."""
    wrong = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in constraints().items()]))
    return blocks.select(key, F.explode(wrong).alias("constraint")).orderBy(key, "constraint").limit(limit)


def public_index(sessions: DataFrame) -> DataFrame:
    """(latest, date, journal_number, title, path) of all published sessions, newest first; fails where there are none."""
    rows = sessions.select("date", "journal_number", "title", F.concat(F.lit("/data/sessions/"), F.col("date").cast("string"), F.lit(".json")).alias("path"))
    latest = rows.agg(F.max("date").alias("latest"))
    # no rows give no latest date, and an index without sessions is not published
    empty = F.raise_error(F.lit("cannot publish an empty session index")).cast(latest.schema["latest"].dataType)
    latest = latest.select(F.coalesce("latest", empty).alias("latest"))
    return rows.join(F.broadcast(latest)).orderBy(F.desc("date"))  # one row
