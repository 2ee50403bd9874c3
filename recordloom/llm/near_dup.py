"""Near duplicates by MinHash with tensored banding; every link is confirmed on full shingle sets.

A few small collections of minhashes are computed for each distinct shingle set; the key of a table is a pair of
collections, so m collections give m(m-1)/2 tables. With the defaults, 12 collections of 2 minhashes give 66 tables of
4 minhashes for 24 computed ones instead of 264, and a pair at similarity 0.8 shares no table with probability 1e-4
(0.9: 1e-7). Such a pair is lost only if no chain of other links joins it.

Work in a bucket is linear, not quadratic: equal sets are one node from the start, and every node is compared with a
few hubs of its buckets. Buckets whose nodes are all linked through hubs drop out. What is left are buckets of nodes that
are alike but mostly below the threshold: small ones are compared pair by pair, large buckets that share nodes form a
family, whose members outside its main component are a query set held against the whole family, block by block, so
that no pair but a link leaves a task. All links together give the components, once, at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import with_package
from .common import LOWER, components, matching, written

#: Words of a numpy block at most; a longer text is a block of its own.
BLOCK = 1 << 18
#: Members that one task compares with a hub in a row.
SALT_ROWS = 512
#: Nodes of a bucket that are compared pair by pair; those of larger ones meet in tiles of two blocks of about so many shingles.
SMALL, TILE = 16, 1 << 18
#: Masks by which the order of ids is turned: the smallest id under each is a hub of its bucket.
HUBS = (0, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D)
#: Nodes of a task that makes their keys.
NODES = 1 << 17
#: 8-byte ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 500_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_POLY = np.uint64(0xD6E8FEB86659FD93)


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(20260101)
    a, b = (r.randint(0, 1 << 32, size=(2, n), dtype=np.uint64) << np.uint64(32)) + r.randint(0, 1 << 32, size=(2, n), dtype=np.uint64)
    return a | np.uint64(1), b


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer than k words: of the whole sequence."""
    words = text.translate(LOWER).split() if text else ()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out * _POLY) ^ _mix(h[i : len(h) - n + 1 + i])
    return np.unique(_mix(out))


def _signatures(sets: list[np.ndarray], collections: int) -> np.ndarray:
    """For every set, the collections: two 32-bit minhashes in a 64-bit word each."""
    a, b = _constants(2 * collections)
    sizes = np.array([len(s) for s in sets])
    every, at = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.zeros((len(sets), collections), np.uint64)
    for i in range(2 * collections):
        low = np.minimum.reduceat(every * a[i] + b[i], at)
        out[:, i // 2] |= (_mix(low) & np.uint64(0xFFFFFFFF)) << np.uint64(32 * (i % 2))
    return out


def _sign(k: int, collections: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sig", pa.list_(pa.int64()))])

    def flush(ids, sets):
        full = [i for i, s in enumerate(sets) if len(s)]
        sig = dict(zip(full, _signatures([sets[i] for i in full], collections).view(np.int64).tolist(), strict=True)) if full else {}
        names = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist() if len(s) else (0, 0) for s in sets]
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in names], pa.int64()), pa.array([x[1] for x in names], pa.int64()), pa.array([sig.get(i) for i in range(len(sets))], pa.list_(pa.int64()))], schema=schema)

    def run(batches):
        ids, sets, held = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                ids.append(i)
                sets.append(shingle_set(text.as_py(), k))
                held += len(sets[-1]) + 8
                if held >= BLOCK:
                    yield flush(ids, sets)
                    ids, sets, held = [], [], 0
        if ids:
            yield flush(ids, sets)

    return run


def _confirm(k: int, num: int, den: int):
    """Rows (hub, member, text) sorted so that a hub's own rows (member null) come before those compared with it."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        hub, of = None, []
        for batch in batches:
            a, b = [], []
            for h, m, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                own = shingle_set(text.as_py(), k)
                if h != hub:
                    hub, of = h, []
                if m is None:
                    of.append(own)
                    continue
                for other in of:
                    if den * min(len(own), len(other)) < num * max(len(own), len(other)):
                        continue
                    both = np.intersect1d(own, other, assume_unique=True).size
                    if both and den * both >= num * (len(own) + len(other) - both):
                        a.append(m)
                        b.append(h)
                        break
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of pairs (a, b) whose shingle sets have den * intersection >= num * union.

    b is the hub: its text is sent once for every SALT_ROWS of its members, and a task holds one hub and one member.
    """
    hubs = pairs.groupBy("b").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    # hash joins, so that texts are sorted once only, by hub
    members = docs.join(pairs.join(hubs, "b").hint("shuffle_hash"), F.col("a") == F.col("doc_id"))
    members = members.select(F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.col("a").alias("member"), "text")
    own = docs.join(hubs.hint("shuffle_hash"), F.col("b") == F.col("doc_id")).select(F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("member"), "text")
    rows = own.union(members).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("member").asc_nulls_first())
    return rows.select("hub", "member", "text").mapInArrow(_confirm(k, num, den), "a long, b long")


def _tables(collections: int):
    """The keys of all tables, in order of their pairs of collections."""
    last = collections - 1
    pairs = F.transform(F.sequence(F.lit(0), F.lit(last - 1)), lambda i: F.transform(F.sequence(i + 1, F.lit(last)), lambda j: F.xxhash64(i, j, F.get("sig", i), F.get("sig", j))))
    return F.flatten(pairs)


def _equal(a: str, b: str):
    """How many of the single minhashes are equal."""
    half = lambda x: (F.shiftrightunsigned(x, 32) == 0).cast("int") + (x.bitwiseAND(0xFFFFFFFF) == 0).cast("int")
    return F.aggregate(F.zip_with(a, b, lambda x, y: half(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _first_table(a: str, b: str, collections: int):
    """The number of the first table that holds both: that of the first two collections in which they are equal."""
    same = F.filter(F.sequence(F.lit(0), F.lit(collections - 1)), lambda i: F.get(a, i) == F.get(b, i))
    i, j = F.get(same, F.lit(0)), F.get(same, F.lit(1))
    return i * collections - F.shiftright(i * (i + 1), 1) + j - i - 1


def _shared(one: np.ndarray, two: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many shingles of one set each of n sets has, whose shingles are two, sorted, of the set owner."""
    low, high = np.searchsorted(two, one, "left"), np.searchsorted(two, one, "right")
    many = high - low
    at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
    return np.bincount(owner[at], minlength=n)


def _tile(k: int, num: int, den: int):
    """Rows (tile, side, rep, root, text), a tile's together: links that join components of side 0 with those of side 1,
    or, where there is no side 1, of side 0 with one another. Shared shingles are counted exactly."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(sides):
        one, two = sides[0], sides[1] or sides[0]
        to: dict[int, int] = {}

        def root(x):
            while (up := to.get(x, x)) != x:
                x = up
            return x

        size = np.array([len(s) for _, _, s in two])
        every, owner = np.concatenate([s for _, _, s in two]), np.repeat(np.arange(len(two)), size)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        out = []
        for i, (rep, of, own) in enumerate(one):
            both = _shared(own, every, owner, len(two))
            fit = den * both >= num * (len(own) + size - both)
            if not sides[1]:
                fit[: i + 1] = False
            for j in np.flatnonzero(fit).tolist():
                s, t = root(of), root(two[j][1])
                if s != t:
                    to[max(s, t)] = min(s, t)
                    out.append((rep, two[j][0]))
        return pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], schema=schema)

    def run(batches):
        now, sides = None, ([], [])
        for batch in batches:
            for tile, side, rep, of, text in zip(*[batch.column(i).to_pylist() for i in range(4)], batch.column(4).cast(pa.binary()), strict=True):
                if tile != now:
                    if sides[0]:
                        yield links(sides)
                    now, sides = tile, ([], [])
                sides[side].append((rep, of, shingle_set(text.as_py(), k)))
        if sides[0]:
            yield links(sides)

    return run


def family_links(live: DataFrame, sizes: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links between components of the nodes in live (key, rep, root, low), whose buckets are large; low is the smallest
    node of a bucket.

    A family is what large buckets join. Its nodes are grouped by size (a link's sizes are in neighbouring groups) and
    by whether they are in its main component, and groups are cut into blocks of about TILE shingles; two blocks make a
    tile, but for those that are in the main component both.
    """
    family = components(live.select(F.col("rep").alias("a"), F.col("low").alias("b")), "families").select("node", F.col("root").alias("of"))
    nodes = live.select("rep", "root").distinct().join(family, F.col("rep") == F.col("node"), "left").select("rep", "root", F.coalesce("of", "rep").alias("family"))
    nodes = nodes.join(sizes, "rep").withColumn("size", F.floor(F.log("n") / float(np.log(den / num))).cast("int"))
    main = nodes.groupBy("family", "root").agg(F.count("*").alias("c")).groupBy("family").agg(F.max_by("root", F.struct("c", "root")).alias("main"))
    nodes = written(nodes.join(main, "family").withColumn("group", 2 * F.col("size") + (F.col("root") == F.col("main")).cast("int")).drop("main", "size"), "family")
    groups = nodes.groupBy("family", "group").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("blocks"))
    other = groups.select("family", F.col("group").alias("with"), F.col("blocks").alias("blocks_b"))
    near = (F.abs(F.floor(F.col("group") / 2) - F.floor(F.col("with") / 2)) <= 1) & ~((F.col("group") % 2 == 1) & (F.col("with") % 2 == 1))
    meets = groups.join(other, "family").where(near)
    rows = nodes.join(meets, ["family", "group"]).join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("block_b", F.explode(F.sequence(F.lit(0), F.col("blocks_b") - 1)))
    here, there = F.struct("group", "block"), F.struct(F.col("with").alias("group"), F.col("block_b").alias("block"))
    rows = rows.withColumn("tile", F.xxhash64("family", F.least(here, there), F.greatest(here, there))).withColumn("side", (here > there).cast("int"))
    rows = rows.repartition("tile").sortWithinPartitions("tile").select("tile", "side", "rep", "root", "text")
    return rows.mapInArrow(_tile(k, num, den), "a long, b long")


def _of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs with one of ids; few enough ids are broadcast, so that other texts are not shuffled."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _starred(links: DataFrame) -> DataFrame:
    """(node, root) of linked nodes: the smallest neighbour's smallest neighbour. Nodes with one root are in one
    component; it is for components() to see that those of one component have one root."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(links.select("b", "a"))
    near = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("root"))
    far = near.select(F.col("node").alias("root"), F.col("root").alias("far"))
    return near.join(far, "root", "left").select("node", F.coalesce("far", "root").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 2, num: int = 80, den: int = 100, collections: int = 12, least_equal: int = 0) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text; other columns are ignored).

    Words are runs of anything but ASCII white space, A-Z lower-cased. Null and empty texts, and those without words,
    have an empty set, n_shingles 0, and are their own component. Rows with equal sets are linked, repeated rows
    included; a row with a null doc_id gets the component of its set's other rows, or null, and kept true. An empty
    table gives an empty result. With least_equal above 0, pairs of small buckets with fewer equal ones of the single
    minhashes are not compared (of 24, 10 would lose 4e-5 of the pairs at similarity 0.8).
    """
    with_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(docs.mapInArrow(_sign(shingle, collections), "doc_id long, n long, s1 long, s2 long, sig array<long>"), "signed")
    nodes = signed.where("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "n", "sig")).alias("x"))
    nodes = written(nodes.select("s1", "s2", F.col("x.doc_id").alias("rep"), F.col("x.n").alias("n"), F.col("x.sig").alias("sig")), "nodes")
    # keys are nearly all different, so a task holds as many as it makes: nodes are dealt to many tasks first
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.count() // NODES)
    placed = nodes.select("rep", "sig").repartition(tasks, "rep").select("rep", F.posexplode(_tables(collections)).alias("t", "key"))

    # buckets with more than one node; most have one
    names = [f"hub{i}" for i in range(len(HUBS))]
    hubs = placed.groupBy("key").agg(F.max("rep").alias("high"), *[F.min(F.col("rep").bitwiseXOR(m)).alias(h) for h, m in zip(names, HUBS, strict=True)])
    # a hash join: the keys, of which there are 66 a node, need not be sorted to meet the few that are shared
    live = written(placed.join(hubs.where("hub0 < high").drop("high").hint("shuffle_hash"), "key"), "buckets")
    near = written(live.groupBy("rep").agg(*[F.min(h).bitwiseXOR(m).alias(h) for h, m in zip(names, HUBS, strict=True)]), "hubs")
    texts = written(_of(docs, near.select(F.col("rep").alias("doc_id"))), "texts")
    pairs = near.select(F.col("rep").alias("a"), F.explode(F.array_distinct(F.array(*names))).alias("b")).where("a <> b")
    links = written(confirmed(pairs, texts, shingle, num, den), "links")

    roots = _starred(links)
    live = live.select("key", "t", "rep", F.col("hub0").alias("low")).join(roots, F.col("rep") == F.col("node"), "left").select("key", "t", "rep", "low", F.coalesce("root", "rep").alias("root"))
    mixed = live.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("c")).where("least < most")
    live = written(live.join(mixed.select("key", "c"), "key"), "buckets")
    side = live.where(F.col("c") <= SMALL).join(nodes.select("rep", "n", "sig"), "rep").select("key", "t", "rep", "root", "n", "sig")
    other = side.select("key", *[F.col(c).alias(f"{c}_b") for c in ("rep", "root", "n", "sig")])
    pairs = side.join(other, "key").where((F.col("root") > F.col("root_b")) & (den * F.least("n", "n_b") >= num * F.greatest("n", "n_b")) & (F.col("t") == _first_table("sig", "sig_b", collections)))
    if least_equal:
        pairs = pairs.where(_equal("sig", "sig_b") >= least_equal)
    pairs = written(pairs.select(F.col("rep").alias("a"), F.col("rep_b").alias("b")), "pairs")
    found = confirmed(pairs, texts, shingle, num, den)
    large = live.where(F.col("c") > SMALL).select("key", "rep", "root", "low")
    if not large.isEmpty():
        found = found.union(family_links(large, nodes.select("rep", "n"), texts, shingle, num, den))
    # written, so that no task has two Python workers at once
    roots = components(links.union(written(found, "links")), "stars")
    members = nodes.select("s1", "s2", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("s1", "s2", F.coalesce("root", "rep").alias("root"))
    out = signed.select("doc_id", "n", "s1", "s2").join(members, ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def kept_one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, one where a kept row is repeated; rows without doc_id all stay.

    Null and empty texts are no copies of anything and stay, repeated rows of one doc_id aside; docs keeps its columns,
    whatever they are called; an empty table gives an empty result."""
    found = near_duplicates(docs, **how).where("doc_id is not null").groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
    found = written(found.where("not kept or n > 1"), "copies")
    gone, again = found.where(~F.col("kept")).select("doc_id"), found.where("kept").select("doc_id")
    kept = matching(docs, gone, ["doc_id"], "left_anti")
    if again.isEmpty():
        return kept
    return matching(kept, again, ["doc_id"], "left_anti").unionByName(matching(kept, again, ["doc_id"], "left_semi").dropDuplicates(["doc_id"]))
