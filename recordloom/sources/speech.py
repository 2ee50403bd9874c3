"""Speech recogniser output as segments: JSON lines in milliseconds, whole JSON documents, and repair of broken lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_asr

_LINE = "struct<start: bigint, end: bigint, text: string>"
_SHAPE = r'^\{"start":(-?[0-9]+),"end":(-?[0-9]+),"text":"(.*)"\}$'
_DOCUMENT = "struct<transcription: array<struct<offsets: struct<`from`: bigint, `to`: bigint>, text: string>>>"


def valid_text(content: Column) -> Column:
    """Bytes as text; what is not UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def repaired(line: Column) -> Column:
    """A line of the known shape whose text has bare quotes, with these escaped; null for any other shape."""
    text = F.regexp_replace(F.regexp_extract(line, _SHAPE, 3), r'(?<!\\)"', r'\\"')
    again = F.concat(F.lit('{"start":'), F.regexp_extract(line, _SHAPE, 1), F.lit(',"end":'), F.regexp_extract(line, _SHAPE, 2), F.lit(',"text":"'), text, F.lit('"}'))
    return F.when(F.rlike(line, F.lit(_SHAPE)), again)


def _whole(x: Column) -> Column:
    return F.when(x["start"].isNotNull() & x["end"].isNotNull() & x["text"].isNotNull(), x)


def parse_lines(lines: DataFrame, offset: float = 0.0) -> DataFrame:
    """(keys..., line_no, start, end, text, normalized_text, repaired, fault) of lines (keys..., line_no, line).

    Blank lines and empty texts are left out; fault is "invalid" for a line that is not JSON of that shape and cannot
    be repaired, and is null otherwise."""
    rows = lines.where(F.trim("line") != "")
    first, second = _whole(F.from_json("line", _LINE)), _whole(F.from_json(repaired(F.col("line")), _LINE))
    rows = rows.withColumn("__a", first).withColumn("__b", F.when(first.isNull(), second)).withColumn("__x", F.coalesce("__a", "__b"))
    out = rows.withColumn("start", offset + F.col("__x.start") / 1000.0).withColumn("end", offset + F.col("__x.end") / 1000.0).withColumn("text", F.trim("__x.text"))
    out = out.withColumn("repaired", F.col("__b").isNotNull()).withColumn("fault", F.when(F.col("__x").isNull(), "invalid"))
    out = out.withColumn("normalized_text", normalize_asr(F.col("text"))).where("fault is not null or text <> ''")
    return out.drop("line", "__a", "__b", "__x")


def order_faults(segments: DataFrame, keys: list[str], order: str) -> DataFrame:
    """segments with fault "not_monotonic" where one ends before it starts, or starts before the one kept before it."""
    back = F.col("start") < F.lag("start").over(Window.partitionBy(*keys).orderBy(order))
    return segments.withColumn("fault", F.coalesce("fault", F.when((F.col("end") < F.col("start")) | back, "not_monotonic")))


def parse_documents(documents: DataFrame, offset: float = 0.0) -> DataFrame:
    """(keys..., line_no, start, end, text, normalized_text, fault) of JSON documents (keys..., content)."""
    keys = [c for c in documents.columns if c != "content"]
    rows = documents.withColumn("__x", F.from_json("content", _DOCUMENT))
    rows = rows.select(*keys, F.posexplode_outer("__x.transcription").alias("line_no", "s"))
    rows = rows.select(*keys, "line_no", (offset + F.col("s.offsets.from") / 1000.0).alias("start"), (offset + F.col("s.offsets.to") / 1000.0).alias("end"), F.trim("s.text").alias("text"))
    rows = rows.withColumn("fault", F.when(F.col("start").isNull() | F.col("end").isNull() | F.col("text").isNull(), "invalid")).withColumn("normalized_text", normalize_asr(F.col("text")))
    return rows.where("fault is not null or text <> ''")


def strict(segments: DataFrame) -> DataFrame:
    """segments without fault, failing on the first that has one."""
    fault = F.raise_error(F.concat(F.lit("invalid recogniser output: "), F.col("fault"))).cast("double")
    return segments.withColumn("start", F.when(F.col("fault").isNotNull(), fault).otherwise(F.col("start"))).drop("fault")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of JSON-lines files; each file is read whole, as line numbers and order are the file's."""
    files = spark.read.format("binaryFile").load(path).select("path", valid_text(F.col("content")).alias("content"))
    lines = files.select("path", F.posexplode(F.split("content", r"\r\n|[\n\r]")).alias("n", "line"))
    return lines.select("path", (F.col("n") + 1).alias("line_no"), "line")
