"""Mixing sources to target weights by a low-discrepancy schedule, in built-in functions only.

Every source is one endless stream: its documents in a shuffled order, over and over, cut into blocks of equally many
words; it needs as many blocks as its target holds, the last one cut there. The blocks of all sources, side by side,
are cumulative weights: of M slots, M the next power of two, the first 2^m points of the van der Corput sequence hit
each of the cells j / M exactly once, and the point that hits a source's cell is a slot of that source. So every source gets
exactly the slots that its target needs, and any stretch of the schedule holds the sources near their weights. A
slot's rank among those of its source is the block that it takes: a document is taken where its blocks are, and its
place in the mix is that of the slot that takes its first word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

#: Cells by which slots meet sources, slots that are ranked together, and documents of a source that are summed up together, about.
CELLS, CHUNK, PART = 4096, 1 << 16, 1 << 14
#: Words of the mix in a partition.
STRETCH = 1 << 21


def _key(seed: int) -> Column:
    return F.xxhash64("doc_id", F.xxhash64(F.col("text").cast("string")), "source", F.lit(seed))


def sizes(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, key, size) of every row: words of the text, and its place in the shuffled order."""
    return docs.select("doc_id", "source", _key(seed).alias("key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(sid, source, source_size, docs, target) of every source; the weights go round the sources by code point, null last.

    The targets add up to share of all words. None is above most times its source; the excess goes to the others by
    weight. One row a source is sorted in one task: there are far fewer sources than documents.
    """
    by_name, by_level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("level", "sid")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    out = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")).withColumn("sid", F.row_number().over(by_name) - 1)
    out = out.withColumn("weight", weight).withColumn("level", most * F.col("source_size") / F.col("weight"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(Window.partitionBy()) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    out = out.withColumn("water", left / (F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # in order of the level at which a source is full, the first that stays below it sets the level of all others
    level = F.min_by(F.when(F.col("water") < F.col("level"), F.col("water")), F.when(F.col("water") < F.col("level"), F.struct("level", "sid"))).over(Window.partitionBy())
    return out.select("sid", "source", "source_size", "docs", F.coalesce(F.least(F.col("weight") * level, most * F.col("source_size")), most * F.col("source_size")).cast("double").alias("target"))


def van_der_corput(cell: Column, bits: int) -> Column:
    """The number of the point, of the first 2^bits, that hits cell: its bits in reverse."""
    return F.conv(F.reverse(F.lpad(F.bin(cell), bits, "0")), 2, 10).cast("long")


def schedule(goals: DataFrame, block: int, point=van_der_corput) -> tuple[DataFrame, int]:
    """(place, sid, rank) of every slot, and the number of places; goals as targets() has them.

    point gives the place of the point that hits a cell; places of cells behind the last source stay unused."""
    spark = goals.sparkSession
    goals = goals.select("sid", F.ceil(F.round("target").cast("long") / block).cast("long").alias("blocks")).where("blocks > 0")
    goals = goals.withColumn("high", F.sum("blocks").over(Window.orderBy("sid"))).withColumn("low", F.col("high") - F.col("blocks"))
    slots = goals.agg(F.sum("blocks")).first()[0] or 0
    bits = max(slots - 1, 1).bit_length()
    part = lambda c: F.expr(f"({c} * {CELLS}) div {max(slots, 1)}")
    spans = goals.select("*", F.explode(F.sequence(part("low"), part("(high - 1)"))).alias("part"))
    hit = spark.range(slots).select(F.col("id").alias("cell"), part("id").alias("part")).join(spans, "part").where("cell >= low and cell < high")
    hit = hit.select("sid", point(F.col("cell"), bits).alias("place")).withColumn("chunk", F.floor(F.col("place") / CHUNK))
    counts = hit.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    counts = counts.select("sid", "chunk", (F.sum("n").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("n")).alias("base"))
    rank = F.col("base") + F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("place")) - 1
    return hit.join(counts, ["sid", "chunk"]).select("place", "sid", rank.alias("rank")), 1 << bits


def _taken(docs: DataFrame, weights, share, most, block, seed, point=van_der_corput) -> tuple[DataFrame, int]:
    """(doc_id, source, key, size, sid, source_size, target, turn0, turn1) of every row, and the number of places. The
    turns are a document's two passes: the words taken, the place of the first one's slot and where in its block it is."""
    if most > 2:
        raise ValueError("a source is passed over twice at most")
    sized = written(sizes(docs, seed), "sizes")
    goals = written(targets(sized, weights, share, most), "targets")
    slots, places = schedule(goals, block, point)
    slots = written(slots, "slots")
    rows = sized.join(goals.select(F.col("source").alias("own"), "sid", "source_size", "docs", "target"), F.col("source").eqNullSafe(F.col("own"))).drop("own")
    # as many parts of the shuffled order as the source needs; keys are even over the 64-bit range
    parts = F.ceil(F.col("docs") / PART)
    rows = rows.withColumn("part", F.floor(F.shiftrightunsigned("key", 32) * parts / float(1 << 32)).cast("long")).drop("docs")
    full = rows.where("size > 0")
    base = full.groupBy("sid", "part").agg(F.sum("size").alias("n"))
    base = base.select("sid", "part", (F.sum("n").over(Window.partitionBy("sid").orderBy("part")) - F.col("n")).alias("base"))
    order = Window.partitionBy("sid", "part").orderBy(F.shiftrightunsigned("key", 32), "key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = full.join(base, ["sid", "part"]).withColumn("start", F.col("base") + F.sum("size").over(order) - F.col("size"))
    # a document's two appearances in the stream, by the blocks they lie in
    passes = placed.withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("low", F.col("start") + F.col("turn") * F.col("source_size")).withColumn("high", F.least(F.col("low") + F.col("size"), F.round("target").cast("long"))).where("low < high")
    pieces = passes.withColumn("rank", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block))))
    used = pieces.join(slots, ["sid", "rank"])
    words = F.least("high", (F.col("rank") + 1) * block) - F.greatest("low", F.col("rank") * block)
    used = used.select("doc_id", "key", "sid", "start", "turn", "place", "rank", words.alias("words"), (F.col("low") - F.col("rank") * block).alias("at"))
    turn = lambda t, c: F.coalesce(F.sum(F.when(F.col("turn") == t, F.col(c))), F.lit(0))
    head = lambda t, c: F.min(F.when((F.col("turn") == t) & (F.col("at") >= 0), F.col(c)))
    took = used.groupBy("doc_id", "key", "sid", "start").agg(*[f.alias(n) for t in (0, 1) for f, n in ((turn(t, "words"), f"words{t}"), (head(t, "place"), f"place{t}"), (head(t, "at"), f"at{t}"))])
    took = took.select(F.col("doc_id").alias("__d"), F.col("key").alias("__k"), "sid", "start", *[F.struct(F.col(f"words{t}").alias("words"), F.col(f"place{t}").alias("place"), F.col(f"at{t}").alias("at")).alias(f"turn{t}") for t in (0, 1)])
    out = placed.join(took, ["sid", "start"], "left").drop("__d", "__k", "base", "part", "start")
    empty = rows.where("size = 0").drop("part").withColumns({f"turn{t}": F.lit(None).cast(took.schema[f"turn{t}"].dataType) for t in (0, 1)})
    return out.unionByName(empty), places


def mixture(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 4096, seed: int = 0, point=van_der_corput) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, first, second, place) for every row of docs (doc_id, source, text).

    size counts the text's words (null: 0), taken the words that the mix takes: first in the first pass over the source,
    second in the second; place is that of the slot in which the document's first taken word is. A document that the
    target cuts gives its first words. Documents without words take nothing and have no place, a null source is one of
    its own, repeated rows stand for themselves, other columns are ignored, and an empty table gives an empty result.
    No pass beyond the second is made (most <= 2).
    """
    out, _ = _taken(docs, weights, share, most, block, seed, point)
    first, second = (F.coalesce(F.col(f"turn{t}.words"), F.lit(0)).cast("long") for t in (0, 1))
    return out.select("doc_id", "source", "size", "source_size", "target", (first + second).alias("taken"), first.alias("first"), second.alias("second"), F.least("turn0.place", "turn1.place").alias("place"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 4096, seed: int = 0, point=van_der_corput) -> DataFrame:
    """The documents of the mix in its order, with the columns of docs, whatever they are called: a row for each time that a document is taken.

    Partitions follow one another in the order of the schedule, and so do their rows. A document cut by its source's
    target gives its text up to its last taken word; n_chars, where docs has it, follows. Repeated rows are taken as
    often as they all are, each with its own columns; documents without words, and null texts, are not taken; an empty
    table gives an empty result.
    """
    took, places = _taken(docs, weights, share, most, block, seed, point)
    took = took.select("doc_id", "key", "size", F.array("turn0", "turn1").alias("turns")).where(F.exists("turns", lambda t: t["words"] > 0))
    copies = Window.partitionBy("key").orderBy("doc_id", "turns")
    took = took.select(F.col("key").alias("__key"), F.row_number().over(copies).alias("__copy"), F.col("size").alias("__size"), F.col("turns").alias("__turns"))
    keyed = docs.withColumn("__mixkey", _key(seed)).withColumn("__which", F.row_number().over(Window.partitionBy("__mixkey").orderBy("doc_id")))
    # not an equality, which would have both sides dealt by it as well
    same = (F.col("__which") <= F.col("__copy")) & (F.col("__which") >= F.col("__copy"))
    # texts are not sorted again for the join: what they meet is a short row each
    out = keyed.join(took.hint("shuffle_hash"), (F.col("__mixkey") == F.col("__key")) & same).withColumn("__turn", F.explode("__turns")).where("__turn.words > 0")
    # places are even: each partition is an equal stretch of the schedule, of STRETCH words at most
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), places * block // STRETCH)
    out = out.repartitionById(parts, F.expr(f"__turn.place * {parts} div {places}").cast("int")).sortWithinPartitions("__turn.place", "__turn.at")
    words = F.col("__turn.words")
    cut = F.regexp_substr("text", F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), words.cast("string"), F.lit("}+")))
    text = F.when(words == F.col("__size"), F.col("text")).otherwise(cut)
    new = {"text": text} | ({"n_chars": F.when(words == F.col("__size"), F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
