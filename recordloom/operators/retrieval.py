"""Candidates for a record's turns among speech segments, through an inverted index.

Segments are (session, seg, start, end, normalized_text), seg from 0 in order; queries are (session, block, tokens).
Everything is keyed by session and token: no turn meets a segment with which it shares no rare token.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity
from ..functions.text import tokens
from ..session import arrow_schema, with_package

# What is too common to search by, and the limits of a search.
STOPWORDS = """a an and ang ano are as at ay ba be but by dahil din doon for from had has have he her hindi his honor i if ikaw in is it ito
iyon ka kami kasi kay ko kung lang may mga mo na naman ng ni nila ninyo no not of on opo or our pa para po sa she sir so that the their
there they this to was we were with yes you your yung""".split()
RARE, SEEDS, LEADS, LONGEST, KEPT = 12, 14, 4, 20, 6
LEAST_SCORE, LEAST_COVERAGE = 0.54, 0.46

#: Segments of a piece of speech.
PIECE = 64


def postings(segments: DataFrame) -> DataFrame:
    """(session, token, seg), once for every token of a segment."""
    return segments.select("session", "seg", F.explode(F.array_distinct(tokens(F.col("normalized_text")))).alias("token"))


def token_idf(segments: DataFrame) -> DataFrame:
    """(session, token, df, n, idf): n segments in the session, df of them with the token."""
    n = segments.groupBy("session").agg(F.count("*").alias("n"))
    return postings(segments).groupBy("session", "token").agg(F.count("*").alias("df")).join(n, "session").withColumn("idf", idf())


def idf() -> Column:
    return F.ln((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1


def informative() -> Column:
    """Whether token is worth a search: longer than two, no stop word, and in few enough segments."""
    return (F.length("token") > 2) & ~F.col("token").isin(STOPWORDS) & (F.coalesce("df", F.lit(0)) <= F.greatest(F.lit(5), F.ceil(F.col("n") * 0.025)))


def query_tokens(queries: DataFrame, stats: DataFrame, sizes: DataFrame) -> DataFrame:
    """(session, block, token, count, df, n, idf) for the distinct tokens of each query; unheard ones have df 0.

    sizes has n by session."""
    rows = queries.select("session", "block", F.explode("tokens").alias("token")).groupBy("session", "block", "token").agg(F.count("*").alias("count"))
    rows = rows.join(stats.select("session", "token", "df").hint("merge"), ["session", "token"], "left").join(sizes, "session")
    return rows.withColumn("df", F.coalesce("df", F.lit(0))).withColumn("idf", idf())


def rare_tokens(query: DataFrame, limit: int = RARE) -> DataFrame:
    """The rarest informative tokens of each query, ties by token, with their rank from 1."""
    w = Window.partitionBy("session", "block").orderBy("df", "token")
    return query.where(informative()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def posting_votes(rare: DataFrame, posts: DataFrame, limit: int = SEEDS) -> DataFrame:
    """(session, block, seg, votes, seed): for each query the segments with most votes, a token's idf each; seed is
    the place from 1. Ties go to the segment of the rarest token, then the first. rare may bound segments by low and high."""
    hits = rare.join(posts.hint("merge"), ["session", "token"])  # a file's size says little of its postings': never broadcast
    if "low" in rare.columns:
        hits = hits.where(F.col("seg").between(F.col("low"), F.col("high")))
    votes = hits.groupBy("session", "block", "seg").agg(F.round(F.sum("idf"), 9).alias("votes"), F.min("rank").alias("first"))
    w = Window.partitionBy("session", "block").orderBy(F.desc("votes"), "first", "seg")
    return votes.withColumn("seed", F.row_number().over(w)).where(F.col("seed") <= limit).drop("first")


def ahead(segments: DataFrame) -> DataFrame:
    """(session, seg, ahead): the tokens of a segment and of those after it, LONGEST together."""
    w = Window.partitionBy("session").orderBy("seg").rowsBetween(0, LONGEST - 1)
    return segments.select("session", "seg", F.collect_list(tokens(F.col("normalized_text"))).over(w).alias("ahead"))


def _sizes_ahead(segments: DataFrame) -> DataFrame:
    """(session, seg, upto): the numbers of tokens of a segment and of those after it, summed up, LONGEST of them."""
    w = Window.partitionBy("session").orderBy("seg").rowsBetween(0, LONGEST - 1)
    sizes = segments.select("session", "seg", F.collect_list(F.size(tokens(F.col("normalized_text")))).over(w).alias("sizes"))
    upto = F.transform("sizes", lambda _, i: F.aggregate(F.slice("sizes", F.lit(1), i + 1), F.lit(0), lambda a, x: a + x))
    return sizes.select("session", "seg", upto.alias("upto"))


def _starts(seeds: DataFrame) -> DataFrame:
    """(session, block, first, met): the segments at which windows around the seeds begin."""
    starts = seeds.withColumn("lead", F.explode(F.sequence(F.lit(0), F.lit(LEADS - 1)))).withColumn("first", F.col("seg") - F.col("lead"))
    return starts.groupBy("session", "block", "first").agg(F.min(F.col("seed") * 1000 + F.col("lead") * 100).alias("met"))


def window_enum(seeds: DataFrame, segments: DataFrame, queries: DataFrame) -> DataFrame:
    """(session, block, first, past, heard, found): windows of segments [first, past) around the seeds, whose token
    number suits the query, with their tokens and the place at which the search meets them.

    queries has tokens, and low and high, the segments that a window may have. Windows are chosen by their token
    numbers alone; tokens are fetched for those that are left."""
    starts = _starts(seeds)
    starts = starts.join(queries.select("session", "block", F.size("tokens").alias("size"), "low", "high"), ["session", "block"]).where(F.col("first") >= F.col("low"))
    starts = starts.join(_sizes_ahead(segments).withColumnRenamed("seg", "first"), ["session", "first"])
    rows = starts.select("*", F.posexplode("upto").alias("n", "many")).withColumn("past", F.col("first") + F.col("n") + 1).where(F.col("past") <= F.col("high") + 1)
    # 35 hundredths in whole numbers: as a double, 0.35 * 180 is less than 63
    least, most = F.greatest(F.lit(1), F.floor(F.col("size") * 35 / 100)), F.greatest(F.lit(24), F.col("size") * 2)
    rows = rows.where(F.col("many").between(least, most)).select("session", "block", "first", "past", (F.col("met") + F.col("n") + 1).alias("found"))
    rows = rows.join(ahead(segments).withColumnRenamed("seg", "first"), ["session", "first"])
    heard = F.flatten(F.slice("ahead", F.lit(1), (F.col("past") - F.col("first")).cast("int")))
    return rows.select("session", "block", "first", "past", heard.alias("heard"), "found")


def exact_coverage(words: str, heard: str) -> Column:
    """The weight of query tokens that were heard, counts clipped, over that of all; words are distinct (token, count, idf)."""
    total = F.aggregate(words, F.lit(0.0), lambda a, w: a + w["idf"] * w["count"])
    times = lambda w: F.size(F.filter(heard, lambda t: t == w["token"])).cast("long")
    return F.aggregate(words, F.lit(0.0), lambda a, w: a + w["idf"] * F.least(w["count"], times(w))) / total


def _score(coverage, exact, ordered, compact, said: int, heard):
    balance = np.minimum(said, heard) / np.maximum(said, heard)
    return (0.42 * coverage + 0.23 * exact + 0.20 * ordered + 0.15 * compact) * (0.84 + 0.16 * np.sqrt(balance))


def _turn_windows(row: dict, least_score: float, least_coverage: float) -> list[dict]:
    """Scored windows of a turn (tokens, words, low, high) that begin at its starts in one piece of the speech.

    Windows of one start are prefixes of the longest: each segment is compared with the turn's tokens once, counts and
    similarities are summed up along the segments, and so are common subsequences of the strings."""
    said, base = row["tokens"], row["piece"][0]["seg"]
    texts = [[t for t in p["normalized_text"].split(" ") if t] for p in row["piece"]]
    names, count, idf = ([w[k] for w in row["words"]] for k in ("token", "count", "idf"))
    weight, count, idf = np.array(idf) * np.array(count), np.array(count), np.array(idf)
    total, size = np.cumsum(weight)[-1], len(said)
    least, most = max(1, size * 35 // 100), max(24, size * 2)
    spans = []
    for start in row["starts"]:
        a, many, ends = start["first"] - base, 0, []
        for b in range(a + 1, min(a + LONGEST, len(texts), row["high"] + 1 - base) + 1):
            many += len(texts[b - 1])
            if many > most:
                break
            if many >= least:
                ends.append((b, many))
        if ends:
            spans.append((start, a, ends))
    used = sorted({i for _, a, ends in spans for i in range(a, ends[-1][0])})
    place = {t: i for i, t in enumerate(names)}
    alike = similarity.alike(names, {t for i in used for t in texts[i]})
    times, soft = np.zeros((len(used), len(names)), dtype="int64"), np.zeros((len(used), len(names)))
    for n, i in enumerate(used):
        for t in texts[i]:
            if t in place:
                times[n, place[t]] += 1
                soft[n, place[t]] = 1.0
            for q, ratio in alike.get(t, ()):
                if ratio > soft[n, q]:
                    soft[n, q] = ratio
    at, strings, out = {i: n for n, i in enumerate(used)}, (" ".join(said), "".join(said)), []
    places = [similarity.char_places(s) for s in strings]
    for start, a, ends in spans:
        n, last = at[a], ends[-1][0]
        rows = [b - a - 1 for b, _ in ends]
        counted = np.cumsum(times[n : n + last - a], axis=0)[rows]
        exact = np.cumsum(idf * np.minimum(count, counted), axis=1)[:, -1] / total
        coverage = np.cumsum(weight * np.maximum.accumulate(soft[n : n + last - a], axis=0)[rows], axis=1)[:, -1] / total
        heard = np.array([many for _, many in ends])
        tokens_ = [t for i in range(a, last) for t in texts[i]]
        chars = np.cumsum([len(t) for t in tokens_])[heard - 1]
        lengths = (chars + heard - 1, chars)
        good = np.ones(len(ends), dtype=bool)
        if least_score or least_coverage:  # strings are compared where as much as these lengths can have in common is enough
            most_alike = [2 * np.minimum(len(s), m) / (len(s) + m) for s, m in zip(strings, lengths, strict=True)]
            good = (coverage >= least_coverage) & (_score(coverage, exact, *most_alike, size, heard) >= least_score)
        if not good.any():
            continue
        rows = np.flatnonzero(good)
        ratios = []
        for s, known, m, joined in zip(strings, places, lengths, (" ".join(tokens_), "".join(tokens_)), strict=True):
            upto = m[rows]
            ratios.append(2 * np.array(similarity.prefix_lcs(known, len(s), joined, upto.tolist())) / (len(s) + upto))
        exact, coverage, heard = exact[rows], coverage[rows], heard[rows]
        scores = _score(coverage, exact, *ratios, size, heard)
        for k, r in enumerate(rows.tolist()):
            if coverage[k] >= least_coverage and scores[k] >= least_score:
                length = ends[r][0] - a
                out.append({"session": row["session"], "block": row["block"], "interval": row["interval"], "first": start["first"], "past": start["first"] + length, "found": start["met"] + length, "score": float(scores[k]), "coverage": float(coverage[k]), "exact_coverage": float(exact[k]), "ordered": float(ratios[0][k]), "compact": float(ratios[1][k]), "distinctive": row["distinctive"]})
    return out


_SCORED = "session string, block int, interval int, first long, past long, found long, score double, coverage double, exact_coverage double, ordered double, compact double, distinctive long"


def scored_windows(seeds: DataFrame, segments: DataFrame, queries: DataFrame, least_score: float = 0.0, least_coverage: float = 0.0) -> DataFrame:
    """The windows of window_enum with exact_coverage, coverage, ordered, compact and score against their queries, those
    with the least coverage and score.

    queries (session, block, interval, tokens, words, distinctive, low, high): words are the distinct (token, count, idf).
    The speech is dealt in pieces of PIECE segments and those that the last windows reach into; a turn meets each piece
    in which it has a start once, with all of them."""
    starts = _starts(seeds).join(queries.select("session", "block", "low"), ["session", "block"]).where(F.col("first") >= F.col("low"))
    starts = starts.groupBy("session", "block", F.floor(F.col("first") / PIECE).alias("part")).agg(F.sort_array(F.collect_list(F.struct("first", "met"))).alias("starts"))
    own = F.floor(F.col("seg") / PIECE)
    parts = F.when((F.col("seg") % PIECE < LONGEST - 1) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))
    pieces = segments.select("session", "seg", "normalized_text", F.explode(parts).alias("part")).groupBy("session", "part")
    pieces = pieces.agg(F.sort_array(F.collect_list(F.struct("seg", "normalized_text"))).alias("piece"))
    rows = starts.join(queries.hint("merge"), ["session", "block"]).join(pieces.hint("merge"), ["session", "part"])
    rows = rows.select(F.col("session").cast("string"), F.col("block").cast("int"), "interval", "tokens", "words", "distinctive", "high", "starts", "piece")

    schema = arrow_schema(_SCORED)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                done = [w for row in batch.slice(at, 50).to_pylist() for w in _turn_windows(row, least_score, least_coverage)]
                if done:
                    yield pa.RecordBatch.from_pylist(done, schema=schema)

    with_package(rows.sparkSession)
    return rows.mapInArrow(run, _SCORED)
