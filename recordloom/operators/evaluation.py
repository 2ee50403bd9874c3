"""Evaluation of an alignment against reference moments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity
from ..functions.text import normalize_asr, tokens
from ..session import with_package, written
from .reading import range_distance

#: Tokens of moments that are broadcast at most; more are joined by a shuffle.
BROADCAST_TOKENS = 300_000


def _on_pages(moments: DataFrame, blocks: DataFrame, on: list[str]) -> DataFrame:
    """moments, failing on one whose page has no block."""
    pages = blocks.select(*on).distinct().withColumn("__page", F.lit(True))
    empty = F.raise_error(F.concat(F.lit("no blocks on reference page "), F.concat_ws("/", *[F.col(c).cast("string") for c in on]))).cast("boolean")
    return moments.join(pages, on, "left").withColumn("__page", F.coalesce("__page", empty)).where("__page").drop("__page")


def reference_match(moments: DataFrame, blocks: DataFrame, on: list[str]) -> DataFrame:
    """moments (on, moment, excerpt) with the block (on, sequence, block_id, text, perhaps speaker) that is most alike, and its score.

    on is the page, so a moment meets the blocks of one page; it fails on a page without blocks. A block's text begins
    with its speaker, where there is one. Ties go to the first block. Shared tokens are counted
    through an inverted index; strings are compared only where the coverage, and the most that difflib can add to it
    for strings of these lengths, reach what the moment's best coverage gives alone."""
    with_package(moments.sparkSession)
    moments = written(moments.withColumn("__m", F.monotonically_increasing_id()).withColumn("__q", normalize_asr(F.col("excerpt"))), "moments")
    said = F.concat_ws(" ", *([F.nullif(F.col("speaker"), F.lit(""))] if "speaker" in blocks.columns else []), F.nullif(F.col("text"), F.lit("")))
    blocks = written(blocks.withColumn("__b", F.monotonically_increasing_id()).withColumn("__t", normalize_asr(said)).drop("text", "speaker"), "blocks")
    moments = _on_pages(moments, blocks, on)
    q, t = F.array_distinct(tokens(F.col("__q"))), F.array_distinct(tokens(F.col("__t")))
    wanted = moments.select(*on, "__m", F.explode(q).alias("token"))
    few = wanted.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS
    hits = blocks.select(*on, "__b", F.explode(t).alias("token")).join(F.broadcast(wanted) if few else wanted, [*on, "token"]).groupBy("__m", "__b").agg(F.count("*").alias("hits"))
    asked = moments.select(*on, "__m", F.length("__q").alias("lq"), F.size(q).alias("nq"))
    sizes = blocks.select(*on, "__b", F.length("__t").alias("lt"))
    hits = written(hits.join(asked.drop(*on), "__m").withColumn("coverage", F.col("hits") / F.greatest(F.lit(1), F.col("nq"))).select("__m", "__b", "lq", "coverage"), "hits")
    best = hits.groupBy("__m").agg(F.max(0.75 * F.col("coverage")).alias("least"))
    most = 0.75 * F.col("coverage") + 0.25 * F.coalesce(2 * F.least("lq", "lt") / F.nullif(F.col("lq") + F.col("lt"), F.lit(0)), F.lit(1.0))
    can_win = most >= F.col("least") - 1e-9
    pairs = hits.join(best, "__m").join(sizes.drop(*on), "__b").where(can_win).select("__m", "__b", "coverage")
    # without a shared token difflib gives a quarter at most
    bare = asked.join(best, "__m", "left").withColumn("least", F.coalesce("least", F.lit(0.0))).where(F.col("least") <= 0.25 + 1e-9)
    bare = bare.join(sizes, on).withColumn("coverage", F.lit(0.0)).where(can_win).join(hits.select("__m", "__b"), ["__m", "__b"], "left_anti")
    rows = pairs.union(bare.select("__m", "__b", "coverage")).join(blocks.drop(*on), "__b").join(moments, "__m")
    rows = rows.withColumn("block_match_score", 0.75 * F.col("coverage") + 0.25 * similarity.difflib_ratio(F.col("__q"), F.col("__t")))
    first = Window.partitionBy("moment").orderBy(F.desc("block_match_score"), "sequence")
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "__q", "__t", "__m", "__b", "coverage")


def evaluate(matched: DataFrame, entries: DataFrame) -> DataFrame:
    """matched moments (block_id, expected_start, expected_end, tolerance) with their entry's error, and pass.

    A moment passes if its block's range overlaps the expected one, or begins within tolerance of it."""
    rows = matched.join(entries.select("block_id", "start", "end"), "block_id", "left")
    overlap = (F.col("start") <= F.col("expected_end")) & (F.col("end") >= F.col("expected_start"))
    error = range_distance(F.col("expected_start"), F.col("start"), F.col("end"))
    rows = rows.withColumn("aligned", F.col("start").isNotNull()).withColumn("navigation_error_seconds", F.when(F.col("start").isNotNull(), F.round(error, 3)))
    return rows.withColumn("range_overlap", overlap).withColumn("pass", F.coalesce(F.col("aligned") & (overlap | (error <= F.col("tolerance"))), F.lit(False)))


def exhibit_trap(evaluated: DataFrame) -> DataFrame:
    """evaluated rows with time_references: an exhibit's own times are kept, and none is taken for a seek target."""
    own = F.filter("time_references", lambda r: r["time_domain"] == "exhibit")
    inside = F.exists(own, lambda r: (r["time_seconds"] >= F.col("start")) & (r["time_seconds"] <= F.col("end")))
    return evaluated.withColumn("pass", F.col("pass") & (F.size(own) > 0) & ~F.coalesce(inside, F.lit(False)))


def pass_rate(evaluated: DataFrame) -> DataFrame:
    return evaluated.agg(F.count("*").alias("sample_count"), F.count_if("pass").alias("passed"), F.coalesce(F.round(F.count_if("pass") / F.nullif(F.count("*"), F.lit(0)), 4), F.lit(0.0)).alias("pass_rate"))
