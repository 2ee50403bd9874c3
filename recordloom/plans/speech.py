"""Queries over speech operators, on events as segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import speech
from .bindings import DAY, SEG_SQL, segments

ORDER = ["start", "event_id"]
RUNS_SQL = f"""{SEG_SQL},
marked AS (SELECT *, CASE WHEN normalized_text = lag(normalized_text) OVER w THEN 0 ELSE 1 END AS fresh FROM seg WINDOW w AS (PARTITION BY user_id ORDER BY "start", event_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY "start", event_id) AS run FROM marked),
runs AS (SELECT user_id, run, min(normalized_text) AS normalized_text, count(*) AS n, greatest(0.0, arg_max("end", struct_pack(a := "start", b := event_id)) - min("start")) AS duration FROM numbered GROUP BY user_id, run)"""
_MARKERS = "('', 'blank_audio', 'music', 'applause', 'audience applauding', 'speaking in foreign language', 'speaks in foreign language')"


def consecutive_runs(spark, sf_dir):
    return speech.consecutive_runs(segments(spark, sf_dir), ["user_id"], ORDER).select("user_id", "run", "normalized_text", F.col("count").alias("n"), F.round("duration", 3).alias("duration"))


def drop_repetition(spark, sf_dir):
    return speech.drop_repetition(segments(spark, sf_dir), ["user_id"], ORDER).select("user_id", "event_id", "normalized_text")


def _windows(spark, sf_dir):
    return segments(spark, sf_dir).withColumn("win", F.floor(F.col("start") / (5 * DAY)).cast("long"))


WINDOWS_SQL = f"""{SEG_SQL},
win AS (SELECT *, CAST(floor("start" / {5 * DAY}) AS BIGINT) AS win FROM seg),
marked AS (SELECT *, CASE WHEN normalized_text = lag(normalized_text) OVER w THEN 0 ELSE 1 END AS fresh FROM win WINDOW w AS (PARTITION BY user_id, win ORDER BY "start", event_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, win ORDER BY "start", event_id) AS run FROM marked),
runs AS (SELECT user_id, win, run, min(normalized_text) AS t, count(*) AS n, greatest(0.0, arg_max("end", struct_pack(a := "start", b := event_id)) - min("start")) AS duration FROM numbered GROUP BY user_id, win, run),
loops AS (SELECT user_id, win, round(max(duration), 3) AS m, round(sum(CASE WHEN duration >= 20 THEN duration ELSE 0 END), 3) AS s FROM runs WHERE n >= 3 AND t NOT IN {_MARKERS} GROUP BY user_id, win),
quality AS (SELECT win.user_id, win.win, count(*) AS segment_count, count(*) FILTER (WHERE normalized_text NOT IN {_MARKERS}) AS lexical_segment_count,
  coalesce(round(count(DISTINCT CASE WHEN normalized_text NOT IN {_MARKERS} THEN normalized_text END) / nullif(count(*) FILTER (WHERE normalized_text NOT IN {_MARKERS}), 0), 4), 0.0) AS lexical_unique_ratio,
  round(sum(CASE WHEN normalized_text NOT IN {_MARKERS} THEN greatest(0.0, "end" - "start") ELSE 0.0 END), 3) AS lexical_seconds,
  round(sum(CASE WHEN normalized_text IN {_MARKERS} THEN greatest(0.0, "end" - "start") ELSE 0.0 END), 3) AS non_speech_marker_seconds,
  coalesce(any_value(loops.m), 0.0) AS max_repeated_phrase_seconds, coalesce(any_value(loops.s), 0.0) AS repeated_phrase_seconds
  FROM win LEFT JOIN loops ON win.user_id = loops.user_id AND win.win = loops.win GROUP BY win.user_id, win.win),
found AS (SELECT user_id, win, array_to_string(list_filter([
  CASE WHEN max_repeated_phrase_seconds >= 20 THEN 'repeated_phrase_loop' END,
  CASE WHEN (lexical_segment_count >= 12 AND lexical_unique_ratio < 0.25) OR (lexical_segment_count >= 3 AND lexical_unique_ratio <= 0.34 AND lexical_seconds >= 60)
    OR (lexical_segment_count > 0 AND lexical_segment_count <= 2 AND lexical_seconds >= 60) THEN 'low_lexical_diversity' END,
  CASE WHEN non_speech_marker_seconds >= 60 AND lexical_segment_count <= 2 THEN 'non_speech_dominated' END], lambda x: x IS NOT NULL), ',') AS findings FROM quality)"""


def _quality(spark, sf_dir):
    return speech.transcript_quality(_windows(spark, sf_dir), ["user_id", "win"], ORDER)


def transcript_quality(spark, sf_dir):
    return _quality(spark, sf_dir).drop("max_words")


def window_findings(spark, sf_dir):
    return _quality(spark, sf_dir).select("user_id", "win", F.array_join(speech.findings(F.lit(5 * DAY)), ",").alias("findings"))


def quarantine(spark, sf_dir):
    found = _quality(spark, sf_dir).withColumn("f", speech.findings(F.lit(5 * DAY))).where(F.size("f") > 0)
    return found.select("user_id", "win", F.array_join("f", ",").alias("reasons"), speech.quarantined(F.col("f")).alias("quarantined"))


def retry_rollup(spark, sf_dir):
    found = _quality(spark, sf_dir).withColumn("f", speech.findings(F.lit(5 * DAY)))
    return speech.retry_rollup(found, ["user_id"], F.lit(5 * DAY))


def _ranges(spark, sf_dir):
    return segments(spark, sf_dir).agg(F.lit(0.0).alias("from"), F.ceil(F.max("end")).cast("double").alias("to"))


PLAN_SQL = f"""{SEG_SQL}, span AS (SELECT ceil(max("end")) AS till FROM seg),
plans AS (SELECT CAST(n AS BIGINT) AS number, (n - 1) * {DAY} AS core_start, least(till, n * {DAY}) AS core_end, greatest(0.0, (n - 1) * {DAY} - 3600) AS input_start, least(till, least(till, n * {DAY}) + 3600) AS input_end
  FROM (SELECT till, unnest(range(1, CAST(ceil(till / {DAY}) AS BIGINT) + 1)) AS n FROM span))"""


def plan_windows(spark, sf_dir):
    return speech.plan_windows(_ranges(spark, sf_dir), DAY, 3600.0).drop("from", "to")


def owned_segments(spark, sf_dir):
    owned = speech.owned_segments(segments(spark, sf_dir), speech.plan_windows(_ranges(spark, sf_dir), DAY, 3600.0), DAY)
    return owned.select("event_id", "number", F.round("core_start", 3).alias("core_start"))


def window_inputs(spark, sf_dir):
    """Every segment in each window whose input has its start: overlapping windows, one owner."""
    plans = speech.plan_windows(_ranges(spark, sf_dir), DAY, 3600.0)
    seg = segments(spark, sf_dir)
    near = seg.withColumn("number", F.explode(F.sequence((F.floor((F.col("start") - 3600) / DAY) + 1).cast("long"), (F.floor((F.col("start") + 3600) / DAY) + 1).cast("long"))))
    middle = (F.col("start") + F.col("end")) / 2
    joined = near.join(plans, "number").where((F.col("start") >= F.col("input_start")) & (F.col("start") < F.col("input_end")))
    return joined.groupBy("number").agg(F.count("*").alias("in_input"), F.count_if((middle >= F.col("core_start")) & (middle < F.col("core_end"))).alias("owned"))


def monotonic_check(spark, sf_dir):
    shifted = segments(spark, sf_dir).withColumn("end", F.when(F.col("event_id") % 50 == 0, F.col("start") - 1).otherwise(F.col("end")))
    return speech.not_monotonic(shifted, ["user_id"], ["event_id"]).select("user_id", "event_id")


def merge_renumber(spark, sf_dir):
    seg = segments(spark, sf_dir)
    halves = seg.where("event_id % 2 = 1").unionByName(seg.where("event_id % 2 = 0"))
    return speech.merge_renumber(halves, ["user_id"], ["event_id"]).select("user_id", "event_id", "id")


def chunk_rollup(spark, sf_dir):
    chunks = segments(spark, sf_dir).select("user_id", F.col("value").alias("elapsed_seconds"), (F.col("event_id") * 1000).alias("peak_rss_bytes"), F.col("event_type").alias("engine_version"), F.lit(1).alias("primary_window_count"), (F.col("event_type") == "error").cast("int").alias("retried_window_count"), ((F.col("event_type") == "error") & (F.col("value") > 50)).cast("int").alias("quarantined_window_count"))
    return speech.chunk_rollup(chunks, ["user_id"]).withColumn("engine_versions", F.array_join("engine_versions", ","))


def merge_faults(spark, sf_dir):
    seg = segments(spark, sf_dir)
    users = seg.select("user_id").distinct().withColumn("origin", F.when(F.col("user_id") % 3 == 0, 2 * DAY).otherwise(0.0)).withColumn("duration", F.lit(29 * DAY))
    return speech.merge_faults(seg.where("user_id % 7 > 0"), users, ["user_id"])


QUERIES = {f.__name__: f for f in (consecutive_runs, drop_repetition, transcript_quality, window_findings, quarantine, retry_rollup, plan_windows, owned_segments, window_inputs, monotonic_check, merge_renumber, chunk_rollup, merge_faults)}

ORACLE_SQL = {
    "merge_faults": f"""WITH {SEG_SQL}, u AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN {2 * DAY} ELSE 0 END AS o, min("start") AS f, max("end") AS l FROM seg GROUP BY user_id), v AS (SELECT user_id, CASE WHEN user_id % 7 = 0 THEN 'no_segments' WHEN f < o THEN 'before_origin' WHEN l > o + {29 * DAY} + 30 THEN 'after_end' END AS fault FROM u) SELECT * FROM v WHERE fault IS NOT NULL""",
    "consecutive_runs": f"WITH {RUNS_SQL} SELECT user_id, CAST(run AS BIGINT) AS run, normalized_text, n, round(duration, 3) AS duration FROM runs",
    "drop_repetition": f"WITH {RUNS_SQL} SELECT s.user_id, s.event_id, s.normalized_text FROM numbered s JOIN runs r ON s.user_id = r.user_id AND s.run = r.run WHERE NOT (r.n >= 3 AND r.duration >= 45 AND r.normalized_text NOT IN {_MARKERS})",
    "transcript_quality": f"WITH {WINDOWS_SQL} SELECT * FROM quality",
    "window_findings": f"WITH {WINDOWS_SQL} SELECT * FROM found",
    "quarantine": f"WITH {WINDOWS_SQL} SELECT user_id, win, findings AS reasons, contains(findings, 'repeated_phrase_loop') OR contains(findings, 'low_lexical_diversity') AS quarantined FROM found WHERE findings <> ''",
    "retry_rollup": f"WITH {WINDOWS_SQL}, q AS (SELECT *, contains(findings, 'repeated_phrase_loop') OR contains(findings, 'low_lexical_diversity') AS q FROM found) SELECT user_id, count(*) AS windows, count(*) FILTER (WHERE findings <> '') AS retried, count(*) FILTER (WHERE q) AS quarantined, count(*) FILTER (WHERE q) * {5 * DAY} AS quarantined_seconds FROM q GROUP BY user_id",
    "plan_windows": f"WITH {PLAN_SQL} SELECT * FROM plans",
    "owned_segments": f"""WITH {PLAN_SQL} SELECT s.event_id, p.number, round(p.core_start, 3) AS core_start FROM seg s JOIN plans p ON (s."start" + s."end") / 2 >= p.core_start AND (s."start" + s."end") / 2 < p.core_end""",
    "window_inputs": f"""WITH {PLAN_SQL} SELECT p.number, count(*) AS in_input, count(*) FILTER (WHERE (s."start" + s."end") / 2 >= p.core_start AND (s."start" + s."end") / 2 < p.core_end) AS owned FROM seg s JOIN plans p ON s."start" >= p.input_start AND s."start" < p.input_end GROUP BY p.number""",
    "monotonic_check": f"""WITH {SEG_SQL}, c AS (SELECT user_id, event_id, "start", CASE WHEN event_id % 50 = 0 THEN "start" - 1 ELSE "end" END AS "end" FROM seg), l AS (SELECT *, lag("start") OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM c) SELECT user_id, event_id FROM l WHERE "start" < p OR "end" < "start" """,
    "merge_renumber": f"""WITH {SEG_SQL} SELECT user_id, event_id, printf('asr-%06d', row_number() OVER (PARTITION BY user_id ORDER BY "start", "end", event_id)) AS id FROM seg""",
    "chunk_rollup": "SELECT user_id, count(*) AS chunk_count, round(sum(value), 3) AS elapsed_seconds, max(event_id * 1000) AS peak_rss_bytes, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS engine_versions, count(*) AS primary_window_count, count(*) FILTER (WHERE event_type = 'error') AS retried_window_count, count(*) FILTER (WHERE event_type = 'error' AND value > 50) AS quarantined_window_count FROM events GROUP BY user_id",
}
