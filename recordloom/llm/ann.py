"""Nearest neighbours by inner product: a forest of random-projection trees, searched through one priority queue.

Trees are grown on a bounded sample, every vector is routed down all of them, and a query opens the most promising
leaves of the whole forest, best bound first. How many is measured, not guessed: some queries are held against all
vectors, and a query opens as many leaves as those needed to find the wanted share of their true neighbours. Each
leaf's members are scored exactly, in double precision, and the best of all opened leaves are merged. Equal vectors
are one class: a third of all rows with the same vector are one row in the leaves and one search.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import with_package
from .common import written

#: Vectors that the trees are grown on at most, classes that a tile holds about, queries that are searched or scored at a time.
SAMPLE, BLOCK, ASKED = 1 << 15, 1024, 128
#: Scores that a task holds before it keeps the best of each query.
HELD = 2_000_000


@dataclass
class Tree:
    """Inner node i has a normal and an offset, and children; a negative child -c - 1 is leaf c."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        node = np.zeros(len(x), np.int64) if len(self.normals) else np.full(len(x), -1)
        while (inner := np.flatnonzero(node >= 0)).size:
            at = node[inner]
            side = (np.einsum("ij,ij->i", x[inner], self.normals[at]) > self.offsets[at]).astype(np.int64)
            node[inner] = self.children[at, side]
        return -node - 1


def grow(x: np.ndarray, leaf: int, r: np.random.RandomState) -> Tree:
    """Splits at the median along the difference of two random points, of eight such directions the widest."""
    normals, offsets, children, leaves = [], [], [], 0
    todo = [(np.arange(len(x)), None, 0)]
    while todo:
        rows, parent, side = todo.pop()
        name = None
        if len(rows) > leaf:
            some = x[r.choice(rows, min(256, len(rows)), replace=False)]
            ends = r.randint(len(some), size=(8, 2))
            across = some[ends[:, 0]] - some[ends[:, 1]]
            across /= np.maximum(np.linalg.norm(across, axis=1, keepdims=True), 1e-30)
            normal = across[(some @ across.T).var(axis=0).argmax()]
            along = x[rows] @ normal
            offset = float(np.median(along))
            up = along > offset
            if 0.1 < up.mean() < 0.9:
                name = len(normals)
                normals.append(normal)
                offsets.append(offset)
                children.append([0, 0])
                todo += [(rows[up], name, 1), (rows[~up], name, 0)]
        if name is None:
            leaves += 1
            name = -leaves
        if parent is not None:
            children[parent][side] = name
    return Tree(np.array(normals).reshape(-1, x.shape[1]), np.array(offsets), np.array(children, np.int64).reshape(-1, 2))


def opened(trees: list[Tree], margins: list[np.ndarray]):
    """The leaves (tree, leaf) of the whole forest for one query, by the sum of squared margins on the wrong side; margins
    has the query's signed distance from the split of every node of each tree."""
    queue = [(0.0, n, 0 if len(t.normals) else -1) for n, t in enumerate(trees)]
    heapq.heapify(queue)
    while queue:
        far_off, n, node = heapq.heappop(queue)
        own, kids = margins[n], trees[n].children
        while node >= 0:
            margin = own[node]
            near, far = kids[node, int(margin > 0)], kids[node, int(margin <= 0)]
            heapq.heappush(queue, (far_off + margin * margin, n, int(far)))
            node = int(near)
        yield n, -node - 1


def search(trees: list[Tree], x: np.ndarray, probes: int) -> list[list[tuple[int, int]]]:
    """The first probes leaves for every row."""
    margins = [x @ t.normals.T - t.offsets for t in trees]
    return [list(islice(opened(trees, [m[i] for m in margins]), probes)) for i in range(len(x))]


def needed(trees: list[Tree], x: np.ndarray, near: list[np.ndarray], recall: float) -> int:
    """How many leaves the rows of x have to open so that recall of all rows' neighbours, near, are in one of them."""
    margins = [x @ t.normals.T - t.offsets for t in trees]
    places = []
    for i, own in enumerate(near):
        if not len(own):
            continue
        at: dict[tuple[int, int], list[int]] = {}
        for n, t in enumerate(trees):
            for j, leaf in enumerate(t.route(own).tolist()):
                at.setdefault((n, leaf), []).append(j)
        # the last few may be far off in all trees, and are left out
        missing, enough = set(range(len(own))), int((1 - recall) * len(own) / 2)
        for place, leaf in enumerate(opened(trees, [m[i] for m in margins]), 1):
            hit = missing.intersection(at.get(leaf, ()))
            places += [place] * len(hit)
            missing -= hit
            if len(missing) <= enough:
                break
        places += [1 << 62] * len(missing)
    places.sort()
    return places[max(int(np.ceil(recall * len(places))) - 1, 0)] if places else 1


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with one more component, by which all have the norm most: the largest inner product is then the nearest."""
    return np.hstack([x, np.sqrt(np.maximum(most**2 - (x**2).sum(axis=1), 0))[:, None]])


def _route(shared):
    def run(batches):
        trees, most, _ = shared.value
        for batch in batches:
            if batch.num_rows:
                lifted = _lifted(_matrix(batch.column(1)), most)
                for n, t in enumerate(trees):
                    yield pa.record_batch([pa.array(np.full(batch.num_rows, n, np.int32)), pa.array(t.route(lifted).astype(np.int32)), batch.column(0), batch.column(1)], names=["tree", "leaf", "class", "v"])

    return run


def _open(shared):
    def run(batches):
        trees, most, probes = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ASKED):
                part = batch.slice(at, ASKED)
                leaves = search(trees, _asked(_matrix(part.column(1)), most), probes)
                rows = np.repeat(np.arange(part.num_rows), [len(f) for f in leaves])
                tree, leaf = np.array([y for f in leaves for y in f], np.int32).reshape(-1, 2).T
                part = part.take(pa.array(rows))
                yield pa.record_batch([pa.array(tree), pa.array(leaf), part.column(0), part.column(1)], names=["tree", "leaf", "class", "v"])

    return run


def _asked(x: np.ndarray, most: float) -> np.ndarray:
    """Queries as points of the trees' space: of the norm that all lifted vectors have."""
    return np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True) * most, np.zeros((len(x), 1))])


def _exact(asked: np.ndarray, own: list[int], k: int):
    """Rows (class, v): the k best of a task for each of the queries asked, whose own classes are left out."""

    def run(batches):
        best = [([], [], []) for _ in own]
        for batch in batches:
            names, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
            for q, near in enumerate(asked @ x.T):
                near = np.where(names == own[q], -np.inf, near)
                pick = np.argsort(-near, kind="stable")[:k]
                s, c, v = best[q]
                s, c, v = np.concatenate([s, near[pick]]), np.concatenate([c, names[pick]]).astype(np.int64), [*v, *x[pick]]
                pick = [i for i in np.argsort(-s, kind="stable")[:k] if s[i] > -np.inf]
                best[q] = s[pick], c[pick], [v[i] for i in pick]
        for q, (s, c, v) in enumerate(best):
            yield pa.record_batch([pa.array([q] * len(s), pa.int32()), pa.array(s, pa.float64()), pa.array(c, pa.int64()), pa.array([r.tolist() for r in v], pa.list_(pa.float64()))], names=["q", "s", "class", "v"])

    return run


def _best_of(name: np.ndarray, worse: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each name, ties by id, without the ones that are there twice; worse is the negative score."""
    order = np.lexsort((ids, worse, name))
    name, worse, ids = name[order], worse[order], ids[order]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (worse[1:] != worse[:-1]) | (ids[1:] != ids[:-1])
    name, worse, ids = name[new], worse[new], ids[new]
    first = np.concatenate([[0], np.flatnonzero(name[1:] != name[:-1]) + 1]) if len(name) else np.empty(0, np.int64)
    rank = np.arange(len(name)) - np.repeat(first, np.diff(np.append(first, len(name))))
    return name[rank < k], worse[rank < k], ids[rank < k]


def _best(k: int):
    """Rows (tile, is_query, class, v, ids), a tile's members before its queries: the k best members for each query.

    A query's answers from the tiles of a task are merged; HELD scores are held at a time."""
    schema = pa.schema([("class", pa.int64()), ("found", pa.list_(pa.struct([("s", pa.float64()), ("id", pa.int64())])))])

    def out(held):
        name, worse, ids = _best_of(*map(np.concatenate, zip(*held, strict=True)), k)
        first = np.concatenate([[0], np.flatnonzero(name[1:] != name[:-1]) + 1])
        found = pa.StructArray.from_arrays([pa.array(worse), pa.array(ids)], names=["s", "id"])
        return pa.record_batch([pa.array(name[first]), pa.ListArray.from_arrays(pa.array(np.append(first, len(name)), pa.int32()), found)], schema=schema)

    def answers(x, start, many, flat, name, asked):
        near = asked @ x.T
        if near.shape[1] > k:
            cut = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
            row, pick = np.nonzero(near >= cut - 1e-9 * np.abs(cut) - 1e-300)
        else:
            row, pick = np.divmod(np.arange(near.size), near.shape[1])
        # the same sum whatever else is in the tile, so that a member scores alike in every tree
        exact = (x[pick] * asked[row]).sum(axis=1)
        times = many[pick]
        at = np.repeat(start[pick] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
        return np.repeat(name[row], times), np.repeat(-exact, times), flat[at]

    def run(batches):
        now, members, held, size = None, [], [], 0
        for batch in batches:
            tile, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            name, x = batch.column(2).to_numpy(zero_copy_only=False), _matrix(batch.column(3))
            many = batch.column(4).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, start = batch.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(many) - many
            cuts = np.concatenate([[0], np.flatnonzero((tile[1:] != tile[:-1]) | (asks[1:] != asks[:-1])) + 1, [len(tile)]]) if len(tile) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if tile[a] != now:
                    now, members = tile[a], []
                if not asks[a]:
                    members.append((x[a:b], many[a:b], flat[start[a] : start[b - 1] + many[b - 1]]))
                elif members:
                    if len(members) > 1:
                        members = [tuple(map(np.concatenate, zip(*members, strict=True)))]
                    own, times, ids = members[0]
                    for q in range(a, b, BLOCK):
                        held.append(answers(own, np.cumsum(times) - times, times, ids, name[q : min(q + BLOCK, b)], x[q : min(q + BLOCK, b)]))
                        size += len(held[-1][0])
                        if size > HELD:
                            held = [_best_of(*map(np.concatenate, zip(*held, strict=True)), k)]
                            size = len(held[0][0])
                            if size > HELD // 2:
                                yield out(held)
                                held, size = [], 0
        if size:
            yield out(held)

    return run


def needed_probes(classes: DataFrame, asked: DataFrame, forest: list[Tree], most: float, k: int, recall: float, tried: int) -> int:
    """needed() for tried of the queries asked: their exact neighbours are sought in every task, and merged by query."""
    some = asked.orderBy("class").limit(tried).collect()
    if not some:
        return 1
    x = np.array([r["v"] for r in some], np.float64)
    found = classes.select("class", "v").mapInArrow(_exact(x, [r["class"] for r in some], k), "q int, s double, class long, v array<double>")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "class"))).where(F.col("rank") <= k).select("q", "v").collect()
    near = [_lifted(np.array([r["v"] for r in found if r["q"] == q], np.float64).reshape(-1, x.shape[1]), most) for q in range(len(some))]
    return min(needed(forest, _asked(x, most), near, recall), sum(len(t.normals) + 1 for t in forest))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, trees: int = 32, leaf: int = 32, recall: float = 0.94, tried: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query, a row whose vec_id is divisible by every.

    vectors has vec_id and embedding; its other columns are ignored. Nearness is the inner product, in double
    precision on the original vectors; ties go to the smaller vec_id. A query is not its own neighbour. Rows whose id
    or vector is null, or whose vector is zero, of another length than most, or has null or non-finite components,
    take no part; of rows with the same vec_id and vector one does, with different vectors all do. An empty table gives an empty result.

    Trees are grown on SAMPLE vectors at most, those with the smallest hashes; leaves hold leaf of them, so that with
    more rows than SAMPLE a leaf holds more, and is scored in blocks. All queries open as many leaves as tried of them,
    those with the smallest hashes, need to find recall of their k nearest vectors, which are sought exactly. Of a class
    of equal vectors the k + 1 smallest ids can be in a result, and are all that is kept of it beside its queries.
    """
    spark = with_package(vectors.sparkSession)
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v")).where("vec_id is not null and v is not null").where(fine)
    rows = rows.withColumn("class", F.xxhash64("v"))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == size["n"])
    # the smallest ids of a class; the limit is applied in every task before the shuffle
    smallest = F.row_number().over(Window.partitionBy("class").orderBy("vec_id")) <= k + 1
    some = rows.groupBy("class", "vec_id").agg(F.first("v").alias("v")).withColumn("small", smallest).where("small")
    some = some.groupBy("class").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v"))
    classes = written(some, "classes")
    queries = written(rows.where(F.col("vec_id") % every == 0).select("class", "vec_id").distinct(), "queries")

    sample = classes.select("class", "v").orderBy("class").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    x = _matrix(sample)
    most = float(np.sqrt(classes.agg(F.max(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, b: a + b * b))).first()[0]))
    r = np.random.RandomState(20260101)
    forest = [grow(_lifted(x, most), leaf, r) for _ in range(trees)]
    asked = classes.join(queries.select("class").distinct(), "class", "left_semi").select("class", "v")
    probes = needed_probes(classes, asked, forest, most, k, recall, tried)
    shared = spark.sparkContext.broadcast((forest, most, probes))
    layout = f"tree int, leaf int, class long, v {kind}"
    placed = classes.select("class", "v").mapInArrow(_route(shared), layout)
    asked = asked.mapInArrow(_open(shared), layout)
    counts = placed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = placed.join(counts, ["tree", "leaf"]).join(classes.select("class", "ids"), "class")
    members = members.select("tree", "leaf", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("query"), "class", "v", "ids")
    asked = asked.join(counts, ["tree", "leaf"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asked.select("tree", "leaf", "block", F.lit(True).alias("query"), "class", "v", F.lit(None).cast("array<long>").alias("ids"))
    tiles = members.union(asked).withColumn("tile", F.xxhash64("tree", "leaf", "block"))
    tiles = tiles.repartition("tile").sortWithinPartitions("tile", "query").select("tile", "query", "class", "v", "ids")
    found = tiles.mapInArrow(_best(k + 1), "class long, found array<struct<s: double, id: long>>")
    # s is the negative score; a neighbour that several trees found comes with equal scores, so its copies are adjacent
    merged = found.groupBy("class").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("every"))
    first = F.filter("every", lambda f, i: (i == 0) | (f != F.get("every", i - 1)))
    merged = merged.select("class", F.slice(first, 1, k + 1).alias("found"))
    out = queries.join(merged, "class").select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(F.filter("found", lambda f: f["id"] != F.col("vec_id")), 1, k)).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))
