"""Feeds, playlists, document bytes and canonical JSON: the record's sources and sinks."""

from __future__ import annotations

import time
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

FEED = "parties array<struct<slug: string, label: string, sections: array<struct<id: int, title: string, documents: array<struct<id: int, label: string, url: string, filename: string>>>>>>"
PLAYLIST = "id string, title string, entries array<struct<id: string, title: string, duration: double>>"
# How titles carry a number and a date.
RECORD_TITLE = r"(?i)Journal\s+No\.\s*0*([0-9]+)\s*\(\s*([A-Za-z]+)\s+([0-9]{1,2})\s*,?\s*([0-9]{4})\s*\)"
VIDEO_TITLE = r"\(([A-Za-z]+)\s+([0-9]{1,2}),\s*([0-9]{4})\)\s*$"
PDF_MAGIC = "255044462D"


def feed_documents(feed: DataFrame, slug: str = "journal") -> DataFrame:
    """Every document of the first party with the slug, of feeds (keys..., parties); fails where there is none."""
    keys = [c for c in feed.columns if c != "parties"]
    party = F.get(F.filter("parties", lambda p: p["slug"] == slug), F.lit(0))
    rows = feed.withColumn("__p", F.when(party.isNull(), F.raise_error(F.lit(f"the feed has no party {slug}")).cast("string")).otherwise(F.lit(""))).withColumn("__s", party["sections"]).where("__p = ''")
    rows = rows.select(*keys, F.explode("__s").alias("s")).select(*keys, F.explode("s.documents").alias("d"))
    return rows.select(*keys, F.col("d.id").alias("feed_document_id"), F.col("d.label").alias("label"), F.col("d.url").alias("url"), F.col("d.filename").alias("filename"))


def title_date(month: Column, day: Column, year: Column) -> Column:
    """A date with the month's full name in any case; fails on any other."""
    return F.to_date(F.concat_ws(" ", F.initcap(F.lower(month)), day, year), "MMMM d yyyy")


def identity(label: Column) -> Column:
    """(number, session_date) of a record's title; null where it is none."""
    part = lambda i: F.regexp_extract(label, RECORD_TITLE, i)
    return F.when(F.rlike(label, F.lit(RECORD_TITLE)), F.struct(part(1).cast("int").alias("number"), title_date(part(2), part(3), part(4)).alias("session_date")))


def video_date(title: Column) -> Column:
    part = lambda i: F.regexp_extract(title, VIDEO_TITLE, i)
    return F.when(F.rlike(title, F.lit(VIDEO_TITLE)), title_date(part(1), part(2), part(3)))


def records(documents: DataFrame, base: str, prefix: str = "session") -> DataFrame:
    """feed_documents as records, failing on a title that is none: ids, date, number, address and whether it is an update."""
    known = identity(F.col("label"))
    failed = F.raise_error(F.concat(F.lit("unrecognized title: "), F.col("label"))).cast("int")
    rows = documents.withColumn("__i", known).withColumn("journal_number", F.when(F.col("__i").isNull(), failed).otherwise(F.col("__i.number"))).withColumn("session_date", F.col("__i.session_date"))
    rows = rows.withColumn("session_id", F.format_string(prefix + "-%02d", "journal_number")).withColumn("logical_source_id", F.format_string("journal-%02d-%s", F.col("journal_number"), F.col("session_date").cast("string")))
    rows = rows.withColumn("source_url", F.concat(F.lit(base), F.ltrim(F.col("url"), F.lit("/"))))
    return rows.withColumn("updated_marker", F.contains(F.lower(F.concat_ws(" ", "label", "filename")), F.lit("updated"))).drop("__i", "url")


def playlist_videos(playlist: DataFrame, watch: str) -> DataFrame:
    """(keys..., video_id, title, duration_seconds, session_date, watch_url) of playlists (keys..., entries)."""
    keys = [c for c in playlist.columns if c not in ("entries", "title", "id")]
    rows = playlist.select(*keys, F.explode("entries").alias("e"))
    return rows.select(*keys, F.col("e.id").alias("video_id"), F.col("e.title").alias("title"), F.col("e.duration").alias("duration_seconds"), video_date(F.col("e.title")).alias("session_date"), F.concat(F.lit(watch), F.col("e.id")).alias("watch_url"))


def is_pdf(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 5)) == PDF_MAGIC


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, sha256, byte_length) of PDF files; fails on a file that is none."""
    rows = spark.read.format("binaryFile").load(path)
    content = F.when(is_pdf(F.col("content")), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("no PDF: "), F.col("path"))).cast("binary"))
    rows = rows.select("path", content.alias("content"))
    return rows.withColumn("sha256", F.sha2("content", 256)).withColumn("byte_length", F.octet_length("content"))


def revisions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Revision descriptions under a folder, at its root and below revisions/."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "source.json").json(path)


def sessions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Published sessions, one file a date."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "????-??-??.json").json(path)


def read_with_retry(attempt: Callable[[], bytes], fallback: Callable[[], bytes] | None = None, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """What attempt gives, tried 1 to 5 times with growing pauses, then what fallback gives."""
    if not 1 <= attempts <= 5:
        raise ValueError("attempts is from 1 to 5")
    last: Exception | None = None
    for n in range(attempts):
        try:
            return attempt()
        except OSError as e:
            last = e
            if n + 1 < attempts:
                sleep(n + 1)
    if fallback is not None:
        return fallback()
    raise OSError("the source is unavailable") from last


def _sorted(value: Column, kind: DataType) -> Column:
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[_sorted(value[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _sorted(x, kind.elementType))
    return value


def canonical(df: DataFrame, name: str) -> Column:
    """JSON of a struct column of df, the fields of it and of structs in it sorted by name; null fields are written. The
    hash of it is a configuration's fingerprint."""
    return F.to_json(_sorted(F.col(name), df.schema[name].dataType), {"ignoreNullFields": "false"})


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """(path, parties) of captured feeds, one JSON document a file; fails on one without parties."""
    rows = spark.read.schema(FEED).option("multiLine", True).json(path).withColumn("path", F.input_file_name())
    missing = F.raise_error(F.concat(F.lit("no feed: "), F.col("path"))).cast(rows.schema["parties"].dataType)
    return rows.select("path", F.coalesce("parties", missing).alias("parties"))


def read_playlist(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """(path, id, title, entries) of captured playlists; of fallback, where there is none or none has entries."""
    read = lambda p: spark.read.schema(PLAYLIST).option("multiLine", True).json(p).withColumn("path", F.input_file_name()).where("entries is not null")
    try:
        live = read(path)
        if fallback is None or not live.isEmpty():
            return live
    except AnalysisException:
        if fallback is None:
            raise
    return read(fallback)


def read_session(spark: SparkSession, path: str, session_date: str) -> DataFrame:
    """One session of the published table, which is partitioned by session_date: the others' files are not read."""
    return spark.read.parquet(path).where(F.col("session_date") == F.lit(session_date).cast("date"))


def route_date(path: Column) -> Column:
    """The session date of a page's path; null of any other path."""
    found = F.regexp_extract(path, r"^/sessions/([0-9]{4}-[0-9]{2}-[0-9]{2})/?$", 1)
    return F.nullif(found, F.lit(""))


def in_order(df: DataFrame, by: str = "session_date", then: str = "journal_number") -> DataFrame:
    """Records by date and number, videos by date and id; what has none comes first."""
    return df.orderBy(F.coalesce(F.col(by).cast("string"), F.lit("")), F.col(then).asc_nulls_first())


def write_if_changed(path: str, text: str) -> bool:
    """Writes a small driver-side file through a temporary one, unless it has that text; whether it did."""
    target = Path(path)
    if target.is_file() and target.read_text(encoding="utf-8") == text:
        return False
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(target.suffix + ".tmp")
    part.write_text(text, encoding="utf-8", newline="\n")
    part.replace(target)
    return True
