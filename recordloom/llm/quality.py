"""Quality rules: figures of each text, and cross-document line frequency.

Lines are normalised and hashed; for every host the distinct documents (texts) of a line are counted. Every line above
the limit is boilerplate and is removed; a document of which too little is left is rejected. Copies of one text are one
document, so that they do not make boilerplate of each other's lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import with_package
from .common import LOWER, matching, written

#: Line keys that are broadcast at most; more are joined by a shuffle.
BROADCAST_LINES = 200_000
_SYMBOLS = b"#*$%&|<>"
_TAILS = bytes(range(0x80, 0xC0))
_SPACES = b" \t\n\v\f\r"
_NORMAL = LOWER.translate(bytes(48 if 48 <= b <= 57 else b for b in range(256)))
_POLY = np.uint64(0x9E3779B97F4A7C15)

_FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("h", pa.int64()), *[(c, pa.int64()) for c in _FIGURES], ("lines", pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())])))])


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    windows = ((h[:-2] * _POLY) ^ h[1:-1]) * _POLY ^ h[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= twice
    return int(covered.sum())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def without_lines(text: bytes, gone: set[int]) -> bytes:
    """The text without the lines of these hashes."""
    left = []
    for line in text.split(b"\n"):
        parts = line.translate(_NORMAL).split()
        if not parts or _signed(xxhash.xxh3_64_intdigest(b" ".join(parts))) not in gone:
            left.append(line)
    return b"\n".join(left)


def figures(text: bytes) -> tuple[list[int], list[dict]]:
    """The figures of a text, and its distinct normalised lines with their words."""
    words = text.split()
    chars = len(text.translate(None, _TAILS + _SPACES))
    seen, repeats, lines = set(), 0, {}
    for line in text.split(b"\n"):
        parts = line.translate(_NORMAL).split()
        if parts:
            repeats += line in seen
            seen.add(line)
            h = xxhash.xxh3_64_intdigest(b" ".join(parts))
            lines[h] = lines.get(h, 0) + len(parts)
    return [len(words), chars, len(text) - len(text.translate(None, _SYMBOLS)), repeats, repeated_words(words)], [{"line": _signed(h), "words": n} for h, n in lines.items()]


def _measure(batches):
    for batch in batches:
        # a handful of rows at a time, so that the lines of long texts are not all held at once
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            own = [figures(t.as_py() or b"") for t in part.column(3).cast(pa.binary())]
            yield pa.record_batch([part.column(0), part.column(1).cast(pa.string()), part.column(2), *[pa.array([x[0][i] for x in own], pa.int64()) for i in range(len(_FIGURES))], pa.array([x[1] for x in own], _SCHEMA.field("lines").type)], schema=_SCHEMA)


def _of_lines(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows joined with keys on (host, line); few keys are broadcast."""
    few = keys.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    return rows.join(F.broadcast(keys) if few else keys, ["host", "line"])


def _judged(docs: DataFrame, least_docs: int = 10, most_share: float = 0.005, least_left: float = 0.3, least_words: int = 50) -> DataFrame:
    """quality() with removed_lines, the hashes of the lines that are removed, or null."""
    with_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, source string, h long, " + ", ".join(f"{c} long" for c in _FIGURES) + ", lines array<struct<line: long, words: long>>"
    base = docs.mapInArrow(_measure, schema).withColumn("host", F.xxhash64("source")).withColumn("row", F.monotonically_increasing_id())
    base = written(base, "figures")
    lines = base.select("row", "host", "h", F.explode("lines").alias("x")).select("row", "host", "h", "x.*")
    hosts = base.groupBy("host").agg((F.count_distinct("h") * most_share).alias("most"))
    # texts are counted by (host, line, text) first, so that a line of very many documents is no task of its own
    often = lines.groupBy("host", "line").agg(F.count_distinct("h").alias("n")).where(F.col("n") > least_docs)
    removed = written(often.join(hosts, "host").where("n > most").select("host", "line"), "lines")
    lost = _of_lines(lines, removed).groupBy("row").agg(F.sum("words").alias("removed_words"), F.collect_set("line").alias("removed_lines"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words") >= least_left * F.col("n_words")
    out = base.drop("lines", "host").join(lost, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    return out.select("doc_id", *_FIGURES, failed.alias("base_failed"), (~failed & left).alias("kept"), "removed_words", "source", "h", "removed_lines")


def quality(docs: DataFrame, **how) -> DataFrame:
    """For every row of docs (doc_id, source, text): its figures, base_failed, kept, removed_words, source and h, the text's hash.

    A line of a host (source) is removed if more distinct texts have it than least_docs and than most_share of the
    host's texts. A document is rejected by the base rules, or if removed lines leave less than least_left of its words.
    Null texts are empty, and fail; a null source is a host of its own; repeated rows stand for themselves, and are one
    text to the counts; an empty table gives an empty result.
    """
    return _judged(docs, **how).drop("removed_lines")


def kept_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that quality() keeps, without the lines it removes; equal rows stay or go together.

    n_chars, if docs has it, is counted anew where lines are removed. Null and empty texts go, as they fail; nulls in
    other columns are values like any other; docs keeps its columns, whatever they are called; an empty table gives an
    empty result."""
    on = ["doc_id", "source", "__qtext"]
    judged = _judged(docs, **how).where(~F.col("kept") | F.col("removed_lines").isNotNull()).withColumnRenamed("h", "__qtext")
    judged = written(judged.groupBy(*on).agg(F.min("kept").alias("kept"), F.first("removed_lines").alias("__gone")), "judged")
    keyed = docs.withColumn("__qtext", F.xxhash64(F.col("text").cast("string")))
    left = matching(keyed, judged.where(~F.col("kept")), on, "left_anti")
    cut = judged.where("kept").select(*[F.col(c).alias(f"__{c}") for c in on], "__gone")
    # a document has a line or a few of these
    few = (cut.agg(F.sum(F.size("__gone"))).first()[0] or 0) <= BROADCAST_LINES
    left = left.join(F.broadcast(cut) if few else cut, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on], "left")

    @F.arrow_udf("string")
    def stripped(text: pa.Array, gone: pa.Array) -> pa.Array:
        return pa.array([None if g is None else without_lines(t.as_py(), set(g)).decode() for t, g in zip(text.cast(pa.binary()), gone.to_pylist(), strict=True)], pa.string())

    left = left.withColumn("__left", stripped(F.when(F.col("__gone").isNotNull(), F.col("text").cast("string")), F.col("__gone")))
    new = {"text": F.coalesce("__left", "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__gone").isNotNull(), F.length("__left").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])
