"""How queries over the driver's tables get the shapes that the operators take, in Spark and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import with_package

DAY = 86400.0

#: events as speech segments: start and end in seconds since 2024, a text and a user.
SEG_SQL = """seg AS (SELECT event_id, user_id, epoch(ts) - 1704067200.0 AS "start", epoch(ts) - 1704067200.0 + value AS "end",
  CASE event_type WHEN 'error' THEN 'blank_audio' ELSE event_type END AS normalized_text, event_type, value FROM events)"""

#: Lines of documents, some made into the forms that a record has; the same text in both engines.
INJECT = """CASE line_no % 13
  WHEN 0 THEN CASE doc_id % 4 WHEN 0 THEN 'OPENING PRAYER' WHEN 1 THEN 'ROLL CALL' WHEN 2 THEN 'PRESENTATION OF EVIDENCE' ELSE 'ROLL CALL' END
  WHEN 1 THEN 'Mr. Reyes. ' || line
  WHEN 2 THEN 'At 5:23 p.m., the session resumed. ' || line
  WHEN 3 THEN '[ Video presentation ]'
  WHEN 4 THEN 'MONDAY, JULY 6, 2026'
  WHEN 5 THEN CAST(page AS STRING)
  WHEN 6 THEN 'ROLL CALL'
  WHEN 7 THEN line || ' Exhibit D-1 - A, video 51:07 and 1:02:03 until 11:59 AM'
  WHEN 8 THEN 'and so ' || line
  WHEN 9 THEN 'It was 10:15 then; ' || line
  WHEN 10 THEN '. '
  WHEN 11 THEN 'The Chair. ' || line
  ELSE line END"""
LINES_SQL = f"""parts AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, line_no, line, CAST(floor(line_no / 4) AS BIGINT) + 1 AS page FROM (SELECT doc_id, i AS line_no, a[i + 1] AS line FROM (SELECT doc_id, a, unnest(range(len(a))) AS i FROM parts))),
raw AS (SELECT doc_id, line_no + 1 AS seq, page, {INJECT.replace("STRING", "VARCHAR")} AS raw_text FROM lines)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return with_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) - 1704067200.0
    return e.select("event_id", "user_id", start.alias("start"), (start + F.col("value")).alias("end"), F.when(F.col("event_type") == "error", "blank_audio").otherwise(F.col("event_type")).alias("normalized_text"), "event_type", "value")


def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seq, page, raw_text)"""
    d = table(spark, sf_dir, "documents").where("text is not null")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("page", F.floor(F.col("line_no") / 4) + 1)
    return lines.select("doc_id", (F.col("line_no") + 1).cast("long").alias("seq"), F.col("page").cast("long").alias("page"), F.expr(INJECT).alias("raw_text"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


