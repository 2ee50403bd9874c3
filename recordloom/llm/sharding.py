"""Sharding along a Hilbert curve: rows near on the curve are near in every metadata dimension, so the runs that make
up shards and files have narrow ranges in all of them, by which readers skip files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import with_package
from .common import written

BITS = 8


def hilbert_index(coords: list[np.ndarray], bits: int) -> np.ndarray:
    """Place on the Hilbert curve through the cube of side 2**bits, by Skilling's transposed form (AIP 2004)."""
    x = [np.asarray(c).astype(np.int64) for c in coords]
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(len(x)):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0]) ^ swap
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flips = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flips = np.where(x[-1] & q, flips ^ (q - 1), flips)
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = (out << 1) | (((c ^ flips) >> b) & 1)
    return out


def _ordinal(name: str, kind: str, skip: int) -> Column:
    """A number in the order of the column; of a string, from the seven bytes that follow the first skip. Null comes first."""
    if kind == "string":
        head = F.rpad(F.substring(F.hex(F.encode(F.col(name), "UTF-8")), 2 * skip + 1, 14), 14, "0")
        return F.coalesce(F.conv(head, 16, 10).cast("long"), F.lit(-1).cast("long"))
    return F.coalesce(F.col(name).cast("double"), F.lit(float("-inf")))


def _common(docs: DataFrame, names: list[str]) -> dict[str, int]:
    """How many bytes all values of a string column begin with: those that the smallest and the largest share."""
    if not names:
        return {}
    ends = docs.agg(*[f(F.encode(F.col(c), "UTF-8")).alias(f"{i}{c}") for c in names for i, f in enumerate((F.min, F.max))]).first()
    shared = {c: [bytes(ends[f"{i}{c}"] or b"") for i in (0, 1)] for c in names}
    return {c: next((i for i, (x, y) in enumerate(zip(low, high, strict=False)) if x != y), min(len(low), len(high))) for c, (low, high) in shared.items()}


def _placed(docs: DataFrame, n_shards: int, by: tuple[str, ...]) -> DataFrame:
    """(doc_id, key, size, text_crc32, shard, slot, curve) of every row; key is that of _key()."""
    with_package(docs.sparkSession)
    kinds, dims = dict(docs.dtypes), [f"d{i}" for i in range(len(by))]
    skip = _common(docs, [c for c in by if kinds[c] == "string"])
    slim = docs.select("doc_id", _key().alias("key"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), *[_ordinal(c, kinds[c], skip.get(c, 0)).alias(d) for c, d in zip(by, dims, strict=True)])
    slim = written(slim, "sizes")
    steps = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    found = slim.agg(*[F.percentile_approx(d, steps, 5000).alias(d) for d in dims]).first()
    bounds = [np.asarray(found[d] or [], float) for d in dims]

    @F.pandas_udf("long")
    def curve(*cols: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([np.searchsorted(b, c.to_numpy(float), side="right") for b, c in zip(bounds, cols, strict=True)], BITS))

    order = ["curve", "text_crc32", "doc_id", "size"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = slim.select("doc_id", "key", "size", "text_crc32", curve(*dims).alias("curve")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    laid = written(laid.withColumn("at", F.monotonically_increasing_id()), "curve")
    laid = laid.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))
    # one row a partition
    before = laid.groupBy("part").agg(F.count("*").alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"), F.sum("n").over(Window.partitionBy()).alias("total"))
    out = laid.join(F.broadcast(before), "part").withColumn("rank", F.col("base") + F.col("at"))
    out = out.withColumn("shard", F.expr(f"(rank * {n_shards}) div total").cast("int"))
    first = F.expr(f"(shard * total + {n_shards - 1}) div {n_shards}")
    return out.select("doc_id", "key", "size", "text_crc32", "shard", (F.col("rank") - first).alias("slot"), "curve")


def _key() -> Column:
    return F.xxhash64("doc_id", F.col("text").cast("string"))


def shards(docs: DataFrame, n_shards: int = 8, by: tuple[str, ...] = ("lang", "source", "n_chars")) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve) for every row of docs (doc_id, text, by).

    Each column of by is quantised at 255 quantiles (a string by the seven bytes behind those that all have in common);
    rows are sorted by their cells' place on the curve, equal texts next to each other, then by doc_id, and cut into
    runs of equal row counts (law "rows": at most one apart). size is the text's UTF-8 bytes plus 1 (null: 1), slot
    counts from 0 in each shard. Nulls come first in every dimension; repeated rows take neighbouring slots; other
    columns are ignored; an empty table gives an empty result.
    """
    return _placed(docs, n_shards, by).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, rows_per_file: int = 1_000_000, n_shards: int = 8, by: tuple[str, ...] = ("lang", "source", "n_chars"), folder: str = "shard") -> None:
    """Writes docs as Parquet, one folder a shard, its rows in curve order; files hold rows_per_file rows at most.

    The folders are named by folder, which must be no column of docs: a clash is an error. Repeated rows take a slot
    each; an empty table writes no shard."""
    if folder in docs.columns:
        raise ValueError(f"{folder} is a column of the documents: name the folders otherwise")
    placed = _placed(docs, n_shards, by).select(F.col("key").alias("__key"), "shard", "slot", F.row_number().over(Window.partitionBy("key").orderBy("doc_id", "shard", "slot")).alias("__copy"))
    placed = placed.select("__key", "__copy", F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    keyed = docs.withColumn("__own", _key()).withColumn("__which", F.row_number().over(Window.partitionBy("__own").orderBy("doc_id")))
    same = (F.col("__which") <= F.col("__copy")) & (F.col("__which") >= F.col("__copy"))
    out = keyed.join(placed.hint("shuffle_hash"), (F.col("__own") == F.col("__key")) & same)
    out = out.repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot").select(*[F.col(f"`{c}`") for c in docs.columns], F.col("__shard").alias(folder))
    out.write.option("maxRecordsPerFile", rows_per_file).partitionBy(folder).parquet(path)
