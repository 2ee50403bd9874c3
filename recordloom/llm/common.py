"""What the training-data operators share: cut lineage, sub-batches, connected components."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import with_package, written

#: Words are runs of anything but these six bytes, which is also what bytes.split() does.
WORD = r"[^\x20\x09-\x0D]+"

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
#: bytes.translate() table that lower-cases A-Z and leaves every other byte.
LOWER = bytes(b + 32 if b in _UPPER else b for b in range(256))
#: Rows of short keys that are broadcast at most.
BROADCAST_KEYS = 300_000
#: Edges that a task shrinks to stars at a time.
FOREST = 200_000


def matching(docs: DataFrame, keys: DataFrame, on: list[str], how: str, most: int = BROADCAST_KEYS) -> DataFrame:
    """docs joined with distinct keys as a left_semi or left_anti join, nulls being equal; docs keeps its columns.

    Keys are broadcast if there are no more than most, so that the texts are not shuffled; else both sides are."""
    keys = keys.select(*[F.col(c).alias(f"__{c}") for c in on])
    few = keys.limit(most + 1).count() <= most
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on]
    return docs.join(F.broadcast(keys) if few else keys, [*same], how)


def lower(name: str):
    """Lower-cases A-Z only."""
    return F.translate(F.col(name), _UPPER.decode(), _UPPER.decode().lower())


def _forest(batches):
    """Edges (a, b) of a task, a bounded number at a time, become the stars of their components."""

    def stars(edges):
        up: dict[int, int] = {}

        def root(x):
            top = x
            while (above := up.get(top, top)) != top:
                top = above
            while x != top:
                up[x], x = top, up[x]
            return top

        for a, b in edges:
            s, t = root(a), root(b)
            if s != t:
                up[max(s, t)] = min(s, t)
        ends = [(x, root(x)) for x in list(up)]
        return pa.record_batch([pa.array([x for x, _ in ends], pa.int64()), pa.array([r for _, r in ends], pa.int64())], names=["a", "b"])

    edges = set()
    for batch in batches:
        edges.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        if len(edges) > FOREST:
            yield stars(edges)
            edges = set()
    yield stars(edges)


def _least(edges: DataFrame) -> DataFrame:
    """(a, m): the smallest b of each a. It is grouped by another name for a, so that a join on a deals both sides anew,
    which is what lets Spark split the many edges of a hub among tasks."""
    return edges.groupBy(F.col("a").bitwiseXOR(-1).alias("x")).agg(F.min("b").alias("m")).select(F.col("x").bitwiseXOR(-1).alias("a"), "m")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of edges (a, b) but the roots: root is the smallest node that can be reached.

    Edges shrink to stars within their tasks; then large-star and small-star steps alternate; each rewrites the edges, of
    which there are never more than before, and the driver only learns whether they are stars.
    """
    with_package(edges.sparkSession)
    edges = edges.select("a", "b").where("a <> b").mapInArrow(_forest, "a long, b long")
    edges = written(edges, name)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _least(both).select("a", F.least("a", "m").alias("m"))
        # large star: the larger neighbours of a node go to the smallest of its neighbourhood
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = _least(large)
        # small star: the smaller neighbours of a node, and the node, go to the smallest of them
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.union(low.select("a", F.col("m").alias("b"))).distinct(), name)
        # stars: every node has one edge, to its root, and no root has one
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        if ends.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
