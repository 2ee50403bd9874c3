"""Queries over the reader's side, on events as timed blocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import alignment as A
from ..operators import reading as R
from .bindings import DAY, SEG_SQL, segments, table

_PRECISION = "CASE event_type WHEN 'view' THEN 'approximate_dialogue_turn' WHEN 'signup' THEN 'section_range' WHEN 'purchase' THEN 'contextual_dialogue_range' ELSE 'narrative_summary_range' END"
BLOCKS_SQL = f"""{SEG_SQL}, timed AS (SELECT event_id, user_id, event_id AS sequence, 'b' || event_id AS block_id, event_type, "start", "end", {_PRECISION} AS precision, CASE WHEN event_id % 5 = 0 THEN 'manual_reviewed' ELSE 'needs_review' END AS review_state FROM seg)"""


def _blocks(spark, sf_dir):
    return segments(spark, sf_dir).select("event_id", "user_id", F.col("event_id").alias("sequence"), F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("block_id"), "event_type", "start", "end", F.expr(_PRECISION).alias("precision"), F.when(F.col("event_id") % 5 == 0, "manual_reviewed").otherwise("needs_review").alias("review_state"))


def timed_blocks(spark, sf_dir):
    blocks = _blocks(spark, sf_dir).select("user_id", "block_id", "sequence")
    entries = _blocks(spark, sf_dir).where("event_type <> 'error'").withColumn("block_id", F.concat(F.lit("b"), (F.col("event_id") - F.col("event_id") % 2).cast("string")))
    timed = R.timed_blocks(blocks, entries.select("user_id", "block_id", F.col("event_id").alias("ord"), "start", "precision"), ["user_id", "block_id"])
    return timed.select("user_id", "block_id", "sequence", F.round("start", 3).alias("start"), "precision").orderBy("start", "sequence")


def specific_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).where(R.is_specific()).groupBy("precision", "review_state").agg(F.count("*").alias("n"))


def merge_ranges(spark, sf_dir):
    ranges = _blocks(spark, sf_dir).withColumn("day", F.floor(F.col("start") / DAY).cast("long"))
    return R.merge_ranges(ranges, ["day"]).select("day", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


def timeline_map(spark, sf_dir):
    ranges = _blocks(spark, sf_dir).where(R.is_specific()).withColumn("day", F.floor(F.col("start") / DAY).cast("long"))
    ranges = ranges.withColumn("start", F.col("start") - F.col("day") * DAY).withColumn("end", F.col("end") - F.col("day") * DAY)
    mapped = R.timeline_map(R.merge_ranges(ranges, ["day"]), F.lit(DAY))
    return mapped.select("day", F.round("start", 3).alias("start"), F.round("left", 6).alias("left"), F.round("width", 6).alias("width"))


def active_block_at(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    probes = blocks.where("event_type = 'click'").select(F.col("event_id").alias("probe"), F.lit("all").alias("session"), F.col("start").alias("t"))
    return R.active_block_at(probes, blocks.where("event_type <> 'click'").withColumn("session", F.lit("all")), ["session"]).select("probe", "block_id")


def range_distance(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(R.range_distance(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_discount") * 100 + F.col("l_tax") * 100), 4).alias("distance"))


def format_time(spark, sf_dir):
    return segments(spark, sf_dir).select("event_id", T.format_time(F.col("start") / 10 - 100).alias("at"))


def precision_rank(spark, sf_dir):
    return _blocks(spark, sf_dir).groupBy("precision").agg(F.count("*").alias("n"), F.min(T.precision_rank(F.col("precision"))).alias("rank"))


def url_state(spark, sf_dir):
    urls = segments(spark, sf_dir).select("event_id", F.concat(F.lit("https://host.example/sessions?block=b"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 == 1, "&t=").when(F.col("event_id") % 4 == 2, F.concat(F.lit("&t="), F.col("value").cast("string"))).otherwise("&t=-3")).alias("url"))
    return urls.select("event_id", T.url_state(F.col("url")).alias("s")).select("event_id", "s.block", "s.t")


def monotone_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("value").alias("start"))
    return A.monotone_filter(rows, ["user_id"], ["event_id"]).select("event_id", "conflict")


_KIND = "CASE event_type WHEN 'click' THEN 'speaker_utterance' WHEN 'view' THEN 'heading' WHEN 'signup' THEN 'narrative_summary' WHEN 'error' THEN 'other' ELSE 'prepared_statement' END"


def contextual_ranges(spark, sf_dir):
    seg = segments(spark, sf_dir).withColumn("session", F.col("user_id").cast("string")).withColumn("pos", F.col("event_id")).withColumn("block_id", F.col("event_id").cast("string")).withColumn("kind", F.expr(_KIND))
    entries = seg.where("event_type = 'purchase'")
    out = A.contextual_ranges(seg.select("session", "pos", "block_id", "kind"), entries, 2 * DAY, 4 * DAY)
    return out.select("session", "pos", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "precision", "confidence")


def anchor_bounds(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    seg = segments(spark, sf_dir).withColumn("session", F.col("user_id").cast("string")).withColumn("pos", place)
    anchors = seg.where("event_type = 'purchase'").select("session", "pos", "start", "end")
    bounds = A.anchor_bounds(anchors, seg.select("session", "pos"), seg.where("event_type = 'click'"))
    return bounds.select("session", F.col("interval").cast("long").alias("interval"), F.col("first_pos").cast("long").alias("first_pos"), F.col("past_pos").cast("long").alias("past_pos"), "low", "high")


def override_check(spark, sf_dir):
    seg = segments(spark, sf_dir).withColumn("session", F.col("user_id").cast("string")).withColumn("block_id", F.col("event_id").cast("string"))
    over = seg.select("session", F.when(F.col("event_id") % 10 == 0, "none").otherwise(F.col("block_id")).alias("block_id"), F.when(F.col("event_id") % 7 == 0, "exhibit").otherwise("session_video").alias("time_domain"), "start", F.when(F.col("event_id") % 11 == 0, F.col("start") - 1).otherwise(F.col("end")).alias("end"))
    found = A.override_faults(over, seg.select("session", "block_id", F.col("event_id").alias("pos")), seg.groupBy("session").agg((F.max("end") - DAY).alias("duration")))
    return found.groupBy("session", "fault").agg(F.count("*").alias("n"))


def uniqueness_margin(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), F.floor(F.col("event_id") / 2000).cast("int").alias("block"), F.get_json_object("props", "$.k").cast("long").alias("first"), "event_id", F.round(F.col("value") / 500, 6).alias("score"))
    best = rows.groupBy("session", "block").agg(F.max_by(F.struct("first", "event_id", "score"), F.struct("score", "event_id")).alias("x")).select("session", "block", "x.*")
    return A.uniqueness_margin(best, rows).select("session", "block", "event_id", F.round("margin", 6).alias("margin"))


def auto_accept(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("score"), (1 - F.col("l_discount") * 5).alias("coverage"), F.col("l_linenumber").alias("distinctive"), F.col("l_tax").alias("margin"))
    return rows.select("l_orderkey", "l_linenumber", A.auto_accepted().alias("accepted"), A.confidence(F.col("score") + 0.00001).alias("confidence"))


QUERIES = {f.__name__: f for f in (timed_blocks, specific_blocks, merge_ranges, timeline_map, active_block_at, range_distance, format_time, precision_rank, url_state, monotone_filter, contextual_ranges, anchor_bounds, override_check, uniqueness_margin, auto_accept)}


def _islands(source: str) -> str:
    return f"""reach AS (SELECT day, "start", "end", max("end") OVER (PARTITION BY day ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {source} WHERE "end" > "start"),
marks AS (SELECT *, sum(CASE WHEN "start" <= r + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY day ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM reach),
merged AS (SELECT day, min("start") AS "start", max("end") AS "end" FROM marks GROUP BY day, island)"""


_RANK = "CASE WHEN contains(precision, 'dialogue') THEN 3 WHEN contains(precision, 'section') THEN 1 ELSE 2 END"
ORACLE_SQL = {
    "timed_blocks": f"""WITH {BLOCKS_SQL}, e AS (SELECT user_id, 'b' || (event_id - event_id % 2) AS block_id, event_id, "start", precision FROM timed WHERE event_type <> 'error'),
      l AS (SELECT user_id, block_id, arg_max("start", event_id) AS st, arg_max(precision, event_id) AS p FROM e GROUP BY 1, 2)
      SELECT b.user_id, b.block_id, b.sequence, round(l.st, 3) AS "start", l.p AS precision FROM timed b JOIN l ON b.user_id = l.user_id AND b.block_id = l.block_id""",
    "specific_blocks": f"WITH {BLOCKS_SQL} SELECT precision, review_state, count(*) AS n FROM timed WHERE review_state = 'manual_reviewed' OR precision = 'approximate_dialogue_turn' GROUP BY 1, 2",
    "merge_ranges": f"""WITH {BLOCKS_SQL}, d AS (SELECT *, CAST(floor("start" / {DAY}) AS BIGINT) AS day FROM timed), {_islands("d")} SELECT day, round("start", 3) AS "start", round("end", 3) AS "end" FROM merged""",
    "timeline_map": f"""WITH {BLOCKS_SQL}, d0 AS (SELECT *, CAST(floor("start" / {DAY}) AS BIGINT) AS day FROM timed WHERE review_state = 'manual_reviewed' OR precision = 'approximate_dialogue_turn'), d AS (SELECT day, "start" - day * {DAY} AS "start", "end" - day * {DAY} AS "end" FROM d0), {_islands("d")},
      m AS (SELECT *, greatest(0.0, least(100.0, "start" / {DAY} * 100)) AS l FROM merged) SELECT day, round("start", 3) AS "start", round(l, 6) AS "left", round(greatest(0.0, least(100 - l, ("end" - "start") / {DAY} * 100)), 6) AS width FROM m""",
    "active_block_at": f"""WITH {BLOCKS_SQL}, p AS (SELECT event_id AS probe, "start" AS t FROM timed WHERE event_type = 'click'), h AS (SELECT p.probe, b.block_id, row_number() OVER (PARTITION BY p.probe ORDER BY {_RANK} DESC, b."start" DESC, b.sequence) AS n FROM p JOIN timed b ON b.event_type <> 'click' AND b."start" <= p.t + 0.25 AND b."start" >= p.t - 1800 AND b."end" >= p.t - 0.25)
      SELECT p.probe, h.block_id FROM p LEFT JOIN h ON p.probe = h.probe AND h.n = 1""",
    "range_distance": "SELECT l_orderkey, l_linenumber, round(greatest(0.0, l_discount * 100 - l_quantity, l_quantity - (l_discount * 100 + l_tax * 100)), 4) AS distance FROM lineitem",
    "format_time": f"""WITH {SEG_SQL}, s AS (SELECT event_id, CAST(floor(greatest("start" / 10 - 100, 0)) AS BIGINT) AS s FROM seg) SELECT event_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, (s // 60) % 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS at FROM s""",
    "precision_rank": f"WITH {BLOCKS_SQL} SELECT precision, count(*) AS n, min({_RANK}) AS rank FROM timed GROUP BY precision",
    "url_state": "SELECT event_id, 'b' || event_id AS block, CASE event_id % 4 WHEN 1 THEN 0.0 WHEN 2 THEN value END AS t FROM events",
    "monotone_filter": "SELECT event_id, value < coalesce(max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS conflict FROM events",
    "contextual_ranges": f"""WITH {SEG_SQL}, k AS (SELECT *, {_KIND} AS kind FROM seg), w AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN "end" END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s, first_value(CASE WHEN event_type = 'purchase' THEN "start" END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS e FROM k),
      p AS (SELECT *, CASE WHEN kind IN ('speaker_utterance', 'prepared_statement') AND e - s <= {2 * DAY} THEN 'contextual_dialogue_range' WHEN kind IN ('narrative_summary', 'procedural_event', 'session_clock_anchor') AND e - s <= {4 * DAY} THEN 'narrative_summary_range' WHEN kind = 'heading' AND e - s <= {4 * DAY} THEN 'section_range' END AS precision FROM w)
      SELECT CAST(user_id AS VARCHAR) AS session, event_id AS pos, round(s, 3) AS "start", round(e, 3) AS "end", precision, round(greatest(0.08, 0.46 - (e - s) / 500), 3) AS confidence FROM p WHERE event_type <> 'purchase' AND precision IS NOT NULL AND e >= s""",
    "anchor_bounds": f"""WITH {SEG_SQL.replace("seg AS", "seg0 AS")}, seg AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM seg0), sizes AS (SELECT user_id, count(*) AS blocks, count(*) FILTER (WHERE event_type = 'click') AS segs FROM seg GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'click') > 0),
      a AS (SELECT x.user_id, x.pos, (SELECT count(*) FROM seg c WHERE c.user_id = x.user_id AND c.event_type = 'click' AND c."start" <= x."start") - 1 AS high, (SELECT count(*) FROM seg c WHERE c.user_id = x.user_id AND c.event_type = 'click' AND c."start" < x."end") AS after FROM seg x WHERE x.event_type = 'purchase' AND x.user_id IN (SELECT user_id FROM sizes)),
      e AS (SELECT user_id, pos, high, after FROM a UNION ALL SELECT user_id, blocks, segs - 1, NULL FROM sizes)
      SELECT CAST(e.user_id AS VARCHAR) AS session, row_number() OVER w AS interval, coalesce(lag(pos) OVER w + 1, 0) AS first_pos, pos AS past_pos, least(coalesce(lag(after) OVER w, 0), segs) AS low, high FROM e JOIN sizes s ON e.user_id = s.user_id WINDOW w AS (PARTITION BY e.user_id ORDER BY pos)""",
    "override_check": f"""WITH {SEG_SQL}, d AS (SELECT user_id, max("end") - {DAY} AS duration FROM seg GROUP BY user_id), f AS (SELECT s.user_id, CASE WHEN event_id % 10 = 0 THEN 'unknown_block' WHEN event_id % 7 = 0 THEN 'time_domain' WHEN "start" < 0 OR "start" > CASE WHEN event_id % 11 = 0 THEN "start" - 1 ELSE "end" END OR CASE WHEN event_id % 11 = 0 THEN "start" - 1 ELSE "end" END > duration THEN 'range' END AS fault FROM seg s JOIN d ON s.user_id = d.user_id)
      SELECT CAST(user_id AS VARCHAR) AS session, fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY 1, 2""",
    "uniqueness_margin": """WITH r AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id // 2000 AS block, CAST(props->>'$.k' AS BIGINT) AS f, event_id, round(value / 500, 6) AS score FROM events),
      b AS (SELECT *, row_number() OVER (PARTITION BY session, block ORDER BY score DESC, event_id DESC) AS n FROM r)
      SELECT b.session, CAST(b.block AS INT) AS block, b.event_id, round(b.score - coalesce(max(r.score) FILTER (WHERE abs(r.f - b.f) > 3), 0.0), 6) AS margin FROM b JOIN r ON b.session = r.session AND b.block = r.block WHERE b.n = 1 GROUP BY b.session, b.block, b.event_id, b.score""",
    "auto_accept": "SELECT l_orderkey, l_linenumber, l_quantity / 50 >= 0.72 AND 1 - l_discount * 5 >= 0.62 AND l_linenumber >= 3 AND l_tax >= 0.055 AS accepted, round(least(0.98, greatest(0.0, (l_quantity / 50 + 0.00001 - 0.48) / 0.44)), 3) AS confidence FROM lineitem",
}
