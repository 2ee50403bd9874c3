"""The aligner on small sessions, its path against all paths, and its similarity against plain definitions."""

import random
import re
from difflib import SequenceMatcher
from itertools import product

import pytest
from pyspark.sql import functions as F

from recordloom.functions import similarity as S
from recordloom.operators import alignment as A
from recordloom.plans import alignment as plans

SEG = "session string, seg long, id string, start double, end double, normalized_text string"
BLOCK = "session string, pos int, block_id string, kind string, text string"


def segments(spark, texts):
    return spark.createDataFrame([("s", i, f"asr-{i + 1:06d}", i * 10.0, i * 10.0 + 8, t) for i, t in enumerate(texts)], SEG)


def blocks(spark, rows):
    return spark.createDataFrame([("s", i, b, k, t) for i, (b, k, t) in enumerate(rows)], BLOCK)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_indel_ratio_is_by_the_longest_common_subsequence():
    r = random.Random(3)
    for _ in range(300):
        a, b = ("".join(r.choice("abcd ") for _ in range(r.randint(0, 80))) for _ in range(2))
        n = len(a) + len(b)
        assert S.indel_ratio(a, b) == (2 * lcs(a, b) / n if n else 1.0)
    assert S.lcs_length("kitten", "sitting") == 4


def test_soft_matches():
    assert S.soft_matches(["constitution", "of", "abcd"], ["constitusion", "xy"]) == [pytest.approx(11 * 2 / 24), 0.0, 0.0]


def weight(row):
    return A.node_weight(row["score"], row["coverage"], row["distinctive"])


def test_best_path_has_the_largest_weight():
    r = random.Random(5)
    for _ in range(200):
        rows = []
        for block in range(r.randint(1, 5)):
            for _ in range(r.randint(1, 3)):
                first = r.randint(0, 8)
                rows.append({"block": block, "first": first, "past": first + r.randint(1, 3), "score": r.uniform(0.54, 1), "coverage": r.random(), "distinctive": r.randint(1, 9), "exact_coverage": 0.0, "found": 0})
        path = A.best_path(rows)
        assert all(a["block"] < b["block"] and a["past"] <= b["first"] for a, b in zip(path, path[1:], strict=False))
        by = [[None, *[x for x in rows if x["block"] == b]] for b in sorted({x["block"] for x in rows})]
        best = 0.0
        for pick in product(*by):
            chosen = [x for x in pick if x]
            if all(a["past"] <= b["first"] for a, b in zip(chosen, chosen[1:], strict=False)):
                best = max(best, sum(map(weight, chosen)))
        assert sum(map(weight, path)) == pytest.approx(best)


TALK = ["the committee reviewed annual budget proposals yesterday", "witness described mysterious warehouse inventory discrepancies", "counsel requested documents concerning offshore accounts", "nothing relevant was mentioned during intermission"]


def test_turns_are_matched_in_order(spark):
    b = blocks(spark, [("b1", "speaker_utterance", TALK[0]), ("h", "heading", "RECESS"), ("b2", "speaker_utterance", TALK[2])])
    rows = {r["block_id"]: r for r in A.align(b, segments(spark, TALK)).collect()}
    assert rows["b1"]["start"] == 0.0 and rows["b2"]["start"] == 20.0
    assert rows["b1"]["review_state"] == "auto_accepted" and rows["b1"]["evidence"]["asr_segment_ids"] == ["asr-000001"]
    assert rows["h"]["precision"] == "section_range" and (rows["h"]["start"], rows["h"]["end"]) == (8.0, 20.0)
    assert rows["h"]["confidence"] == pytest.approx(0.436)
    assert A.diagnostics(b, A.align(b, segments(spark, TALK))).first()["abstained_spoken_blocks"] == 0


def test_same_words_later_go_to_the_later_turn(spark):
    b = blocks(spark, [("b1", "speaker_utterance", TALK[1]), ("b2", "speaker_utterance", TALK[1])])
    rows = {r["block_id"]: r["start"] for r in A.align(b, segments(spark, [TALK[0], TALK[1], TALK[1]])).collect()}
    assert rows == {"b1": 10.0, "b2": 20.0}


def test_structure_is_not_searched_and_unknown_words_are_left_out(spark):
    b = blocks(spark, [("h", "heading", TALK[0]), ("b", "speaker_utterance", "completely unrelated vocabulary everywhere")])
    assert A.align(b, segments(spark, TALK)).count() == 0


OVER = "session string, block_id string, start double, end double, time_domain string, precision string, reviewer string, note string"


def test_a_reviewed_block_bounds_the_search(spark):
    b = blocks(spark, [("b1", "speaker_utterance", TALK[2]), ("b2", "speaker_utterance", "reviewed by hand")])
    over = spark.createDataFrame([("s", "b2", 5.0, 9.0, "session_video", None, "r", "n")], OVER)
    rows = A.align(b, segments(spark, TALK), over).collect()
    assert [(r["block_id"], r["review_state"], r["conflict"]) for r in rows] == [("b2", "manual_reviewed", False)]


@pytest.mark.parametrize("row", [("s", "none", 1.0, 2.0, "session_video"), ("s", "b", 1.0, 2.0, "exhibit"), ("s", "b", 3.0, 2.0, "session_video"), ("s", "b", 1.0, 9e9, "session_video")])
def test_wrong_overrides_fail(spark, row):
    b, seg = blocks(spark, [("b", "speaker_utterance", TALK[0])]), segments(spark, TALK)
    over = spark.createDataFrame([(*row, None, "r", "n")], OVER)
    with pytest.raises(Exception, match="invalid manual override"):
        A.align(b, seg, over).collect()
    assert A.override_faults(over, b, seg.groupBy("session").agg(F.max("end").alias("duration"))).count() == 1


def test_reference_match_meets_every_document(spark, tmp_path):
    """Against all pairs; passages are in long documents, at any id, and some items share no token with any."""
    r = random.Random(5)
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.choice([5, 40, 500])))) for i in range(60)] + [(60, None), (61, "")]
    items = [(i, " ".join(docs[(i * 7 + 3) % 60][1].split()[:30])) for i in range(12)] + [(12, "zzz yyy"), (13, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = set()
    for i, q in items:
        qs = set(q.split())
        score = lambda t: 0.75 * len(qs & set(t.split())) / max(1, len(qs)) + 0.25 * SequenceMatcher(None, q, t).ratio()  # noqa: B023, E731
        best = min((d for d in docs if d[1] is not None), key=lambda d: (-score(d[1]), d[0]))  # noqa: B023
        want.add((i, f"d{best[0]:05d}", round(score(best[1]), 4)))
    got = plans.reference_match(spark, str(tmp_path)).collect()
    assert {(x["moment"], x["block_id"], x["block_match_score"]) for x in got} == want and len(got) == len(items)


def test_the_least_window_of_180_tokens_has_63(spark):
    """35 hundredths exactly: as a double, 0.35 * 180 is 62.99999999999999."""
    from recordloom.operators import retrieval as R

    queries = spark.createDataFrame([("s", 0, ["w"] * 180, 0, 1)], "session string, block int, tokens array<string>, low long, high long")
    seeds = spark.createDataFrame([("s", 0, 0, 1)], "session string, block int, seg long, seed int")
    rows = R.window_enum(seeds, segments(spark, ["w " * 61 + "w", "w"]), queries).collect()
    assert [(r["first"], r["past"], len(r["heard"])) for r in rows] == [(0, 2, 63)]


@pytest.mark.parametrize("name", ["soft_coverage", "align_score", "nms", "monotone_path"])
def test_the_driver_has_no_plan_of_all_steps_and_no_texts(spark, name):
    """Steps that others read are written, and of what is broadcast nothing has texts or postings, however small their files."""
    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 0 and plan.count("Scan parquet") <= 10
    below = [plan[m.start() : m.start() + 4000] for m in re.finditer("BroadcastExchange", plan)]
    assert not any("explode" in x.split("Exchange")[1] or "normalized_text" in x.split("Exchange")[1] for x in below)


def test_windows_reach_from_one_piece_of_speech_into_the_next(spark):
    """A turn at the edge of a piece, in a session of more than two pieces, is found where it was said."""
    from recordloom.operators import retrieval as R

    r = random.Random(7)
    said = ["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(8 * 3 * R.PIECE)]
    texts = [" ".join(said[i : i + 8]) for i in range(0, len(said), 8)]
    at = [R.PIECE - 2, 2 * R.PIECE - 1]
    turns = [(f"b{i}", "speaker_utterance", " ".join(texts[i : i + 4])) for i in at]
    found = A.align(blocks(spark, turns), segments(spark, texts)).collect()
    assert {(e["block_id"], e["start"], e["end"]) for e in found} == {(f"b{i}", i * 10.0, (i + 3) * 10.0 + 8) for i in at}
