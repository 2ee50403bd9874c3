"""Streaming operators driven to their end over the driver's tables: each reads a folder as a stream and returns what has been written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir, with_package
from ..streaming import operators as O
from .bindings import DAY, SEG_SQL, segments


def _stream(spark, df: DataFrame, name: str) -> DataFrame:
    """df as a stream of files."""
    path = f"{shared_dir(spark)}/recordloom/stream-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _drained(spark, df: DataFrame, name: str) -> DataFrame:
    """What a stream has written once all its input is read."""
    path = f"{shared_dir(spark)}/recordloom/out-{name}-{uuid.uuid4().hex}"
    query = df.writeStream.format("parquet").option("checkpointLocation", path + "-state").outputMode("append").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def _timed(spark, sf_dir):
    seg = segments(spark, sf_dir)
    return seg.select(F.col("user_id").cast("string").alias("session"), "event_id", "start", "end", "normalized_text", F.timestamp_micros((F.col("start") * 1e6).cast("long")).alias("ts"))


def stream_once_owned(spark, sf_dir):
    """Every segment twice, as two overlapping windows bring it; once in the result."""
    seg = _timed(spark, sf_dir)
    twice = _stream(spark, seg.unionByName(seg), "owned")
    owned = _drained(spark, O.once_owned(twice, DAY, "400 days"), "owned")
    return owned.groupBy("number").agg(F.count("*").alias("n"))


def stream_active_block(spark, sf_dir):
    seg = segments(spark, sf_dir)
    blocks = seg.where("event_type <> 'click'").select(F.lit("all").alias("session"), F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("block_id"), F.col("event_id").alias("sequence"), "start", "end", F.lit("approximate_dialogue_turn").alias("precision"))
    probes = _stream(spark, seg.where("event_type = 'click'").select(F.lit("all").alias("session"), F.col("event_id").alias("probe"), F.col("start").alias("t")), "probes")
    hits = _drained(spark, O.active_stream(probes, blocks), "active")
    return hits.groupBy("probe").agg(F.count("*").alias("active"), F.max_by("block_id", F.struct("rank", "start", -F.col("sequence"))).alias("best"))


def stream_runs(spark, sf_dir):
    """Runs that have ended: all but each user's last."""
    with_package(spark)
    runs = _drained(spark, O.streamed_runs(_stream(spark, _timed(spark, sf_dir).select("session", "start", "end", "normalized_text"), "runs")), "runs")
    return runs.select("session", "run", "normalized_text", F.col("count").alias("n"), F.round("duration", 3).alias("duration"))


def stream_window_counts(spark, sf_dir):
    """Segments by day and user, of the days that the watermark has passed."""
    counts = _drained(spark, O.window_counts(_stream(spark, _timed(spark, sf_dir), "counts"), int(DAY), "1 hour"), "counts")
    return counts.groupBy("session").agg(F.count("*").alias("windows"), F.sum("segments").alias("segments"))


QUERIES = {f.__name__: f for f in (stream_once_owned, stream_active_block, stream_runs, stream_window_counts)}

ORACLE_SQL = {
    "stream_once_owned": f"""WITH {SEG_SQL} SELECT CAST(floor(("start" + "end") / 2 / {DAY}) AS BIGINT) + 1 AS number, count(*) AS n FROM seg GROUP BY 1""",
    "stream_active_block": f"""WITH {SEG_SQL} SELECT p.event_id AS probe, count(*) AS active, 'b' || arg_max(b.event_id, struct_pack(s := b."start", q := -b.event_id)) AS best FROM seg p JOIN seg b ON p.event_type = 'click' AND b.event_type <> 'click' AND b."start" <= p."start" + 0.25 AND b."start" >= p."start" - 1800 AND b."end" >= p."start" - 0.25 GROUP BY 1""",
    "stream_window_counts": f"""WITH {SEG_SQL}, w AS (SELECT user_id, floor("start" / {DAY}) AS d, count(*) AS n FROM seg GROUP BY 1, 2), top AS (SELECT max("start") - 3600 AS mark FROM seg)
      SELECT CAST(user_id AS VARCHAR) AS session, count(*) AS windows, CAST(sum(n) AS BIGINT) AS segments FROM w, top WHERE (d + 1) * {DAY} <= mark GROUP BY 1""",
    "stream_runs": f"""WITH {SEG_SQL}, marked AS (SELECT *, CASE WHEN normalized_text = lag(normalized_text) OVER w THEN 0 ELSE 1 END AS fresh FROM seg WINDOW w AS (PARTITION BY user_id ORDER BY "start", event_id)), numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY "start", event_id) AS run FROM marked),
      runs AS (SELECT user_id, run, min(normalized_text) AS normalized_text, count(*) AS n, greatest(0.0, arg_max("end", "start") - min("start")) AS duration FROM numbered GROUP BY 1, 2), lasts AS (SELECT user_id, max(run) AS m FROM runs GROUP BY 1)
      SELECT CAST(r.user_id AS VARCHAR) AS session, CAST(run AS BIGINT) AS run, normalized_text, n, round(duration, 3) AS duration FROM runs r JOIN lasts l ON r.user_id = l.user_id WHERE run < m""",
}
