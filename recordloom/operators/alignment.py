"""The alignment of a record with its speech: a monotone path of matched turns, ranges between them, and their review.

Tables are keyed by session: blocks (session, pos, block_id, kind, text), pos from 0 in order and text normalised;
segments as in retrieval, with id; overrides (session, block_id, start, end, time_domain, precision, reviewer, note).
Retrieval and scoring are distributed over turns; the choice of a path is sequential within an interval of a session,
between two reviewed blocks, and is one group. Tables that several steps read are written in between: a plan that
holds them once for each reader outgrows the driver.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_asr, tokens
from ..session import in_groups, written
from . import retrieval as R

# Kinds, thresholds, and the words of an entry.
SPOKEN, SUMMARY = ["speaker_utterance", "prepared_statement"], ["narrative_summary", "procedural_event", "session_clock_anchor"]
AUTO_SCORE, AUTO_COVERAGE, AUTO_DISTINCT, AUTO_MARGIN = 0.72, 0.62, 3, 0.055
SPOKEN_GAP, SUMMARY_GAP = 45.0, 180.0
CLAIMS = {
    "manual": "Human-reviewed range; no word-level claim.",
    "direct": "ASR-assisted turn range; not a word-level timestamp.",
    "contextual_dialogue_range": "Unmatched dialogue bounded by neighboring monotonic matches; not a direct lexical match.",
    "narrative_summary_range": "Journal summary bounded by neighboring monotonic dialogue; not verbatim speech.",
    "section_range": "Section context only; the printed heading is not treated as spoken audio.",
}


def checked_overrides(overrides: DataFrame, blocks: DataFrame, durations: DataFrame) -> DataFrame:
    """overrides with pos, failing on an unknown block, another time domain or a range outside the session."""
    rows = overrides.join(blocks.select("session", "block_id", "pos"), ["session", "block_id"], "left").join(durations, "session", "left")
    fine = F.col("pos").isNotNull() & (F.col("time_domain") == "session_video") & (F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("duration"))
    bad = F.raise_error(F.concat(F.lit("invalid manual override for "), F.col("block_id"))).cast("int")
    return rows.withColumn("pos", F.when(F.coalesce(fine, F.lit(False)), F.col("pos")).otherwise(bad)).drop("duration")


def override_faults(overrides: DataFrame, blocks: DataFrame, durations: DataFrame) -> DataFrame:
    """(session, block_id, fault) of overrides that checked_overrides would fail on."""
    rows = overrides.join(blocks.select("session", "block_id", "pos"), ["session", "block_id"], "left").join(durations, "session", "left")
    fault = F.when(F.col("pos").isNull(), "unknown_block").when(F.col("time_domain") != "session_video", "time_domain").when((F.col("start") < 0) | (F.col("start") > F.col("end")) | (F.col("end") > F.col("duration")), "range")
    return rows.withColumn("fault", fault).where("fault is not null").select("session", "block_id", "fault")


def anchor_bounds(anchors: DataFrame, blocks: DataFrame, segments: DataFrame) -> DataFrame:
    """(session, interval, first_pos, past_pos, low, high): the blocks between two anchors (session, pos, start, end),
    and the segments that they may match. Fails where anchors are not in the order of their starts."""
    sizes = blocks.groupBy("session").agg(F.count("*").alias("blocks")).join(segments.groupBy("session").agg(F.count("*").alias("segments")), "session")
    # one pass over segments and anchors by time: an anchor's end comes before segments of that time, its start after them
    event = lambda df, at, turn, pos: df.select("session", F.col(at).alias("at"), F.lit(turn).alias("turn"), pos.alias("pos"))
    events = event(segments, "start", 0, F.lit(None).cast("int")).union(event(anchors, "start", 1, F.col("pos").cast("int"))).union(event(anchors, "end", -1, F.col("pos").cast("int")))
    so_far = F.count(F.when(F.col("turn") == 0, 1)).over(Window.partitionBy("session").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0))
    counts = events.withColumn("n", so_far).where("turn <> 0").groupBy("session", "pos").agg(F.max(F.when(F.col("turn") == 1, F.col("n"))).alias("until"), F.max(F.when(F.col("turn") == -1, F.col("n"))).alias("after"))
    counts = anchors.select("session", "pos", "start", "end").join(counts, ["session", "pos"])
    w = Window.partitionBy("session").orderBy("pos")
    back = F.col("start") < F.lag("start").over(w)
    counts = counts.withColumn("until", F.when(back, F.raise_error(F.lit("manual override ranges are not monotonic in record order")).cast("long")).otherwise(F.col("until")))
    ends = counts.select("session", "pos", (F.col("until") - 1).alias("high"), "after").unionByName(sizes.select("session", F.col("blocks").cast("long").alias("pos"), (F.col("segments") - 1).alias("high"), F.lit(None).cast("long").alias("after")))
    ends = ends.join(sizes, "session")
    return ends.select("session", F.row_number().over(w).alias("interval"), F.coalesce(F.lag("pos").over(w) + 1, F.lit(0)).alias("first_pos"), F.col("pos").alias("past_pos"), F.least(F.coalesce(F.lag("after").over(w), F.lit(0)), F.col("segments")).alias("low"), "high")


def _suppress(found: list[dict]) -> list[dict]:
    """The best windows of a turn: in order of score, without those that overlap a better one by 60 % of the shorter."""
    kept: list[dict] = []
    for c in sorted(found, key=lambda r: (-r["score"], -r["coverage"], -r["exact_coverage"], r["found"])):
        length = c["past"] - c["first"]
        if all(max(0, min(c["past"], k["past"]) - max(c["first"], k["first"])) < 0.6 * max(1, min(length, k["past"] - k["first"])) for k in kept):
            kept.append(c)
            if len(kept) == R.KEPT:
                break
    return kept


_CANDIDATE = "session string, interval int, block int, first long, past long, found long, score double, coverage double, exact_coverage double, distinctive int"


def suppressed(candidates: DataFrame) -> DataFrame:
    """Per (session, block) up to six windows that do not overlap much."""
    rows = candidates.selectExpr(*[f"cast({p.split(' ')[0]} as {p.split(' ')[1]}) as {p.split(' ')[0]}" for p in _CANDIDATE.split(", ")])
    return in_groups(rows, ["session", "block"], _suppress, _CANDIDATE)


def node_weight(score: float, coverage: float, distinctive: int) -> float:
    return max(0.01, 5 * (score - R.LEAST_SCORE) + coverage + min(0.6, 0.08 * distinctive))


def best_path(rows: list[dict]) -> list[dict]:
    """At most one window a block, in the order of blocks and of time, with the largest sum of weights.

    Ends and sums of chains form a staircase: a chain is kept if no other ends as early with as large a sum. Of chains
    with equal sums the one found first stays: earlier blocks first, then windows in their given order."""
    ends: list[int] = []
    stairs: list[tuple[float, int]] = []
    nodes: list[tuple[dict, int | None]] = []
    at = 0
    while at < len(rows):
        block = rows[at]["block"]
        fresh = []
        while at < len(rows) and rows[at]["block"] == block:
            row = rows[at]
            step = bisect_right(ends, row["first"]) - 1
            total, back = stairs[step] if step >= 0 else (0.0, None)
            nodes.append((row, back))
            fresh.append((row["past"], total + node_weight(row["score"], row["coverage"], row["distinctive"]), len(nodes) - 1))
            at += 1
        for past, total, node in fresh:
            step = bisect_right(ends, past)
            if step and stairs[step - 1][0] >= total:
                continue
            start = step
            if step and ends[step - 1] == past:
                start -= 1
            while step < len(ends) and stairs[step][0] <= total:
                step += 1
            ends[start:step], stairs[start:step] = [past], [(total, node)]
    out, node = [], stairs[-1][1] if stairs else None
    while node is not None:
        row, node = nodes[node]
        out.append(row)
    return out[::-1]


def _path(found: list[dict]) -> list[dict]:
    return best_path(sorted(found, key=lambda r: (r["block"], -r["score"], -r["coverage"], -r["exact_coverage"], r["found"])))


def monotone_path(candidates: DataFrame) -> DataFrame:
    """The chosen candidates of each (session, interval)."""
    return in_groups(candidates, ["session", "interval"], _path, _CANDIDATE)


def uniqueness_margin(chosen: DataFrame, candidates: DataFrame) -> DataFrame:
    """chosen with margin: its score less the best of the block's windows that begin more than three segments off."""
    other = candidates.select("session", "block", F.col("first").alias("other"), F.col("score").alias("other_score"))
    rows = chosen.join(other, ["session", "block"], "left")
    best = F.coalesce(F.max(F.when(F.abs(F.col("other") - F.col("first")) > 3, F.col("other_score"))), F.lit(0.0))
    return rows.groupBy(*chosen.columns).agg((F.col("score") - best).alias("margin"))


def auto_accepted() -> Column:
    return (F.col("score") >= AUTO_SCORE) & (F.col("coverage") >= AUTO_COVERAGE) & (F.col("distinctive") >= AUTO_DISTINCT) & (F.col("margin") >= AUTO_MARGIN)


def confidence(score: Column) -> Column:
    return F.round(F.least(F.lit(0.98), F.greatest(F.lit(0.0), (score - 0.48) / 0.44)), 3)


def candidates(blocks: DataFrame, segments: DataFrame, bounds: DataFrame) -> DataFrame:
    """Scored windows of spoken blocks, with found, the interval, and distinctive, the number of informative tokens."""
    turns = blocks.where(F.col("kind").isin(SPOKEN)).withColumn("tokens", tokens(normalize_asr(F.col("text")))).where(F.size("tokens") >= 2)
    turns = turns.join(bounds, "session").where((F.col("pos") >= F.col("first_pos")) & (F.col("pos") < F.col("past_pos")) & (F.col("low") <= F.col("high")))
    turns = written(turns.select("session", "interval", F.col("pos").alias("block"), "tokens", "low", "high"), "turns")
    heard = written(segments.select("session", "seg", "normalized_text"), "heard")
    sizes = heard.groupBy("session").agg(F.count("*").alias("n"))
    words = written(R.query_tokens(turns, R.token_idf(heard), sizes), "words")
    rare = R.rare_tokens(words).join(turns.select("session", "block", "low", "high"), ["session", "block"])
    seeds = R.posting_votes(rare, R.postings(heard))
    facts = words.groupBy("session", "block").agg(F.sort_array(F.collect_list(F.struct("token", "count", "idf"))).alias("words"), F.count_if(R.informative()).alias("distinctive"))
    return R.scored_windows(seeds, heard, turns.join(facts, ["session", "block"]), R.LEAST_SCORE, R.LEAST_COVERAGE)


_ENTRY = ["session", "pos", "block_id", "start", "end", "precision", "confidence", "review_state", "evidence"]


def _evidence(method: str, claim: Column, **given: Column) -> Column:
    kinds = {"match_score": "double", "token_coverage": "double", "exact_token_coverage": "double", "uniqueness_margin": "double", "distinctive_tokens": "int", "asr_segment_ids": "array<string>", "reviewer": "string", "note": "string"}
    return F.struct(F.lit(method).alias("method"), claim.alias("claim_limit"), *[(given[n] if n in given else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


def direct_entries(chosen: DataFrame, blocks: DataFrame, segments: DataFrame) -> DataFrame:
    """Entries of matched turns: from their first segment's start to their last one's end."""
    heard = chosen.withColumn("seg", F.explode(F.sequence("first", F.col("past") - 1))).join(segments.select("session", "seg", "id", "start", "end"), ["session", "seg"])
    heard = heard.groupBy(*chosen.columns).agg(F.min_by("start", "seg").alias("start"), F.max_by("end", "seg").alias("end"), F.transform(F.array_sort(F.collect_list(F.struct("seg", "id"))), lambda x: x["id"]).alias("ids"))
    rows = heard.join(blocks.select("session", F.col("pos").alias("block"), "block_id"), ["session", "block"])
    proof = _evidence("monotonic_fuzzy_asr_path", F.lit(CLAIMS["direct"]), match_score=F.round("score", 4), token_coverage=F.round("coverage", 4), exact_token_coverage=F.round("exact_coverage", 4), uniqueness_margin=F.round("margin", 4), distinctive_tokens=F.col("distinctive"), asr_segment_ids=F.col("ids"))
    rows = rows.withColumn("pos", F.col("block")).withColumn("precision", F.lit("approximate_dialogue_turn")).withColumn("confidence", confidence(F.col("score"))).withColumn("review_state", F.when(auto_accepted(), "auto_accepted").otherwise("needs_review")).withColumn("evidence", proof)
    return rows.select(*_ENTRY)


def manual_entries(overrides: DataFrame) -> DataFrame:
    rows = overrides.withColumn("precision", F.coalesce("precision", F.lit("manual_reviewed_range"))).withColumn("confidence", F.lit(1.0)).withColumn("review_state", F.lit("manual_reviewed"))
    return rows.withColumn("evidence", _evidence("manual_override", F.lit(CLAIMS["manual"]), reviewer=F.col("reviewer"), note=F.col("note"))).select(*_ENTRY)


def contextual_ranges(blocks: DataFrame, entries: DataFrame, spoken_gap: float = SPOKEN_GAP, summary_gap: float = SUMMARY_GAP) -> DataFrame:
    """Entries of blocks without one, between the end of the entry before and the start of the one after, if that is
    not too long for their kind. Ranges found here are no anchors for others."""
    rows = blocks.join(entries.select("session", "pos", F.col("start").alias("a"), F.col("end").alias("b")), ["session", "pos"], "left")
    w = Window.partitionBy("session").orderBy("pos")
    rows = rows.withColumn("start", F.last("b", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("end", F.first("a", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    gap = F.col("end") - F.col("start")
    precision = F.when(F.col("kind").isin(SPOKEN) & (gap <= spoken_gap), "contextual_dialogue_range").when(F.col("kind").isin(SUMMARY) & (gap <= summary_gap), "narrative_summary_range").when((F.col("kind") == "heading") & (gap <= summary_gap), "section_range")
    rows = rows.withColumn("precision", precision).where("a is null and precision is not null and end >= start")
    claim = F.element_at(F.create_map(*[F.lit(x) for pair in CLAIMS.items() for x in pair]), F.col("precision"))
    rows = rows.withColumn("confidence", F.round(F.greatest(F.lit(0.08), 0.46 - gap / 500), 3)).withColumn("start", F.round("start", 3)).withColumn("end", F.round("end", 3))
    return rows.withColumn("review_state", F.lit("needs_review")).withColumn("evidence", _evidence("bounded_monotonic_context", claim)).select(*_ENTRY)


def monotone_filter(entries: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """entries with conflict: whether one starts before an earlier kept one. Whatever is dropped starts below the
    largest start so far, so the running maximum over all rows is that over the kept ones."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("conflict", F.col("start") < F.coalesce(F.max("start").over(w), F.lit(-1.0)))


def align(blocks: DataFrame, segments: DataFrame, overrides: DataFrame | None = None, durations: DataFrame | None = None) -> DataFrame:
    """All entries, in the order of the record, with conflict; those in conflict are not part of the result proper."""
    blocks, segments = written(blocks, "blocks"), written(segments, "segments")
    if overrides is None:
        sizes = blocks.groupBy("session").agg(F.count("*").cast("long").alias("past_pos")).join(segments.groupBy("session").agg((F.count("*") - 1).alias("high")), "session")
        bounds = sizes.select("session", F.lit(1).alias("interval"), F.lit(0).alias("first_pos"), "past_pos", F.lit(0).cast("long").alias("low"), "high")
        fixed = None
    else:
        if durations is None:
            durations = segments.groupBy("session").agg(F.max("end").alias("duration"))
        reviewed = written(checked_overrides(overrides, blocks, durations), "reviewed")
        bounds, fixed = anchor_bounds(reviewed, blocks, segments), manual_entries(reviewed)
    windows = written(suppressed(candidates(blocks, segments, bounds)), "windows")  # read twice: by the path and its margins
    chosen = uniqueness_margin(monotone_path(windows), windows)
    entries = direct_entries(chosen, blocks, segments)
    entries = written(entries if fixed is None else fixed.unionByName(entries), "entries")  # read twice: as anchors and as rows
    entries = entries.unionByName(contextual_ranges(blocks, entries))
    return monotone_filter(entries, ["session"], ["pos"])


def review_queue(entries: DataFrame) -> DataFrame:
    return entries.where("not conflict and review_state = 'needs_review'").select("session", "block_id", F.lit("low_confidence_or_contextual_range").alias("reason"), "precision", "confidence")


def diagnostics(blocks: DataFrame, entries: DataFrame) -> DataFrame:
    """Counts of each session; every entry that is not a direct match counts as a range, manual ones too."""
    eligible = blocks.groupBy("session").agg(F.count_if(F.col("kind").isin(SPOKEN)).alias("eligible_spoken_blocks"))
    direct = F.col("precision") == "approximate_dialogue_turn"
    counts = entries.where("not conflict").groupBy("session").agg(F.count_if(direct).alias("direct_matches"), F.count_if(F.col("review_state") == "auto_accepted").alias("auto_accepted"), F.count_if(F.col("review_state") == "manual_reviewed").alias("manual_reviewed"), F.count_if(~direct).alias("contextual_ranges"))
    out = eligible.join(counts, "session", "left").na.fill(0)
    return out.withColumn("abstained_spoken_blocks", F.greatest(F.lit(0), F.col("eligible_spoken_blocks") - F.col("direct_matches")))
