"""Captured sources, composed jobs, streams, and the queries that SQL cannot express, against plain Python."""

import json
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from recordloom.functions import text as T
from recordloom.functions.text import normalize_asr
from recordloom.operators import evaluation as E
from recordloom.operators import jobs as J
from recordloom.operators import publishing as P
from recordloom.operators import speech as SP
from recordloom.operators import structure as ST
from recordloom.plans import alignment, structure
from recordloom.sources import records as S
from recordloom.streaming import operators as O

SF = "/root/testdata/sf0.001"


def fails(df, words):
    with pytest.raises(Exception, match=words):
        df.collect()


def test_captured_files(spark, tmp_path):
    doc = {"id": 1, "label": "Journal No. 007 (MAY 5, 2024)", "url": "/a.pdf", "filename": "a.pdf"}
    (tmp_path / "feed.json").write_text(json.dumps({"parties": [{"slug": "journal", "label": "J", "sections": [{"id": 6, "title": "x", "documents": [doc]}]}]}, indent=1))
    feed = S.read_feed(spark, str(tmp_path / "feed.json"))
    (row,) = S.records(S.feed_documents(feed), "https://host.example/").collect()
    assert (row["session_id"], str(row["session_date"]), row["source_url"]) == ("session-07", "2024-05-05", "https://host.example/a.pdf")
    (tmp_path / "other.json").write_text('{"x": 1}')
    fails(S.read_feed(spark, str(tmp_path / "other.json")), "no feed")
    (tmp_path / "old.json").write_text(json.dumps({"id": "p", "title": "t", "entries": [{"id": "v", "title": "Day (May 5, 2024)", "duration": 9.0}]}))
    for live in ("none.json", "other.json"):
        found = S.playlist_videos(S.read_playlist(spark, str(tmp_path / live), str(tmp_path / "old.json")).drop("path"), "w=").collect()
        assert [(r["video_id"], str(r["session_date"])) for r in found] == [("v", "2024-05-05")]
    with pytest.raises(Exception, match="none.json"):
        S.read_playlist(spark, str(tmp_path / "none.json")).collect()


def test_one_session_is_read_without_the_others(spark, tmp_path):
    spark.createDataFrame([(i, f"2024-05-0{i}") for i in range(1, 5)], "n int, d string").select("n", F.col("d").cast("date").alias("session_date")).write.partitionBy("session_date").parquet(str(tmp_path / "out"))
    one = S.read_session(spark, str(tmp_path / "out"), "2024-05-03")
    assert [r["n"] for r in one.collect()] == [3] and len({r[0] for r in one.select(F.input_file_name()).collect()}) == 1
    assert "PartitionFilters: [isnotnull(session_date" in one._jdf.queryExecution().executedPlan().toString()


def test_order_and_canonical_json(spark):
    rows = spark.createDataFrame([(2, "2024-05-02"), (1, "2024-05-02"), (3, None), (0, "2024-05-03")], "journal_number int, session_date string")
    assert [r["journal_number"] for r in S.in_order(rows).collect()] == [3, 1, 2, 0]
    df = spark.range(1).select(F.struct(F.lit(1).alias("b"), F.struct(F.lit("x").alias("d"), F.lit(None).cast("int").alias("c")).alias("a")).alias("x"))
    assert df.select(S.canonical(df, "x")).first()[0] == '{"a":{"c":null,"d":"x"},"b":1}'


def test_sessions_that_discovery_does_not_know(spark):
    records = spark.createDataFrame([("a", 1), ("b", 2), ("d", 4)], "session_id string, journal_number int")
    matches = spark.createDataFrame([("a", "matched", "v"), ("b", "review_required", None), ("c", "matched", "w")], "session_id string, status string, video_id string")
    asked = lambda *ids: J.matched_sessions(spark.createDataFrame([(i,) for i in ids], "session_id string"), records, matches, ["session_id"])
    assert [tuple(r) for r in asked("a", "a").select("session_id", "journal_number", "video_id").collect()] == [("a", 1, "v")]
    fails(asked("b"), "no unique match: b")
    for absent in "cde":
        fails(asked(absent), f"absent from discovery outputs: {absent}")


def test_windows_are_run_again(spark):
    """A clean window stays, a looping one is replaced by its second run, and stays out if that loops too."""
    said = lambda n, start, texts, step=10.0: [("s", n, start + i * step, start + (i + 1) * step, t) for i, t in enumerate(texts)]
    clean, loop, fixed = [f"word{i} and{i}" for i in range(12)], ["same again"] * 12, [f"other{i} now{i}" for i in range(10)]
    schema = "session string, number int, start double, end double, normalized_text string"
    first = spark.createDataFrame(said(1, 0.0, clean) + said(2, 120.0, loop) + said(3, 240.0, loop), schema)
    second = spark.createDataFrame(said(1, 0.0, loop) + said(2, 120.0, fixed) + said(3, 240.0, ["no", "no"], 55.0), schema)
    plans = spark.createDataFrame([("s", n, (n - 1) * 120.0, n * 120.0) for n in (1, 2, 3, 4)], "session string, number int, core_start double, core_end double")
    again = SP.retry_windows(first, plans, ["session"], ["start"])
    assert Counter(r["window"] for r in again.collect()) == {2: 4, 3: 4, 4: 4}
    assert [(r["input_start"], r["input_end"]) for r in again.where("window = 2").orderBy("number").collect()] == [(120.0, 152.0), (148.0, 182.0), (178.0, 212.0), (208.0, 240.0)]
    kept, report = SP.retried(first, second, plans, ["session"], ["start"])
    assert Counter((r["number"], r["normalized_text"]) for r in kept.collect()) == Counter([(1, t) for t in clean] + [(2, t) for t in fixed])
    got = {r["number"]: (r["findings"], r["quarantined"], r["fallback_findings"]) for r in report.collect()}
    assert set(got) == {2, 3, 4} and "repeated_phrase_loop" in got[2][0] and got[4] == (["empty_output"], False, [])
    assert not got[2][1] and got[3][1] and got[3][2] == ["low_lexical_diversity"]


def test_finalised_sessions(spark):
    entries = [r for r in alignment.align(spark, SF).collect() if not r["conflict"]]
    timed, queue = Counter(r["session"] for r in entries), Counter(r["session"] for r in entries if r["review_state"] == "needs_review")
    blocks, heard = Counter(r["session"] for r in alignment._blocks(spark, SF).collect()), Counter(r["session"] for r in alignment._segments(spark, SF).collect())
    rows = alignment.finalize_session(spark, SF).collect()
    assert {r["session"] for r in rows} == set(blocks)
    for r in rows:
        s = r["session"]
        assert (r["journal_blocks"], r["asr_segments"], r["timed_blocks"], r["review_queue"], r["status"]) == (blocks[s], heard[s], timed[s], queue[s], "automated_review_pending")


def test_validation_fails_on_a_fault(spark):
    good = {"id": "1", "schema_version": "1.1.0", "date": "2024-05-05", "journal_number": 1, "title": "t", "journal_url": "https://a.b/c", "retrieved_at": "2024-05-05T01:02:03Z", "sha256": "a" * 64, "page_count": 1, "video_id": "v", "video_url": "https://a.b/v", "playlist_id": "p", "channel": "c", "duration_seconds": 1.0, "source_revision": 1, "total_blocks": 1, "timed_blocks": 0, "coverage": 0.0, "needs_review": 0}
    assert P.validated(spark.createDataFrame([good])).count() == 1 and P.session_faults(spark.createDataFrame([good])).count() == 0
    bad = spark.createDataFrame([good | {"date": "2024-13-01", "sha256": "A" * 64, "page_count": 0}])
    assert {r["constraint"] for r in P.session_faults(bad).collect()} == {"date_format", "sha256_pattern", "page_count_from_1"}
    fails(P.validated(bad), "schema validation failed: date_format; page_count_from_1; sha256_pattern")
    fails(P.public_index(spark.createDataFrame([], "date date, journal_number int, title string")), "empty session index")


def score(excerpt, text):
    words = set(excerpt.split())
    return 0.75 * len(words & set(text.split())) / max(1, len(words)) + 0.25 * SequenceMatcher(None, excerpt, text).ratio()


def test_reference_moments(spark):
    """Every moment against every block of its page."""
    words = "the chair recognized gentleman from first district who moved that session be adjourned until tomorrow morning at nine".split()
    said = lambda n, k: " ".join(words[(n * j + j * j) % len(words)] for j in range(1, k))
    blocks = [(p, i, f"b{p}-{i}", said(p * 5 + i, 4 + i % 9), [None, "", "THE CHAIR.", "Mr. First District."][i % 4]) for p in range(4) for i in range(12)]
    blocks += [(9, 0, "x", "", None), (9, 1, "y", "", None)]
    moments = [(p, 100 * p + i, said(p * 3 + i, 3 + i % 7)) for p in range(4) for i in range(6)] + [(9, 900, "zzz"), (9, 901, "")]
    b, m = spark.createDataFrame(blocks, "page int, sequence int, block_id string, text string, speaker string"), spark.createDataFrame(moments, "page int, moment int, excerpt string")
    plain = {r["block_id"]: r["t"] for r in b.select("block_id", normalize_asr(F.concat_ws(" ", F.expr("nullif(speaker, '')"), "text")).alias("t")).collect()}
    asked = {r["moment"]: r["q"] for r in m.select("moment", normalize_asr(F.col("excerpt")).alias("q")).collect()}
    got = {r["moment"]: r for r in E.reference_match(m, b, ["page"]).collect()}
    assert set(got) == set(asked)
    for page, moment, _ in moments:
        own = [(score(asked[moment], plain[i]), -n, i) for p, n, i, *_ in blocks if p == page]
        best, _, name = max(own)
        assert got[moment]["block_id"] == name and got[moment]["block_match_score"] == pytest.approx(best)
    with pytest.raises(Exception, match="no blocks on reference page 8"):
        E.reference_match(m.union(spark.createDataFrame([(8, 1, "a")], m.schema)), b, ["page"]).collect()


def test_fragments_are_merged_as_the_rule_says(spark):
    """Every two neighbours of a page: whether they are merged, by the rule in Spark's columns on what stands there."""
    rows = ST.split_artifacts(structure._blocks(spark, SF))
    pages, merged = defaultdict(list), defaultdict(list)
    for out, df in ((pages, rows), (merged, ST.merge_fragments(rows))):
        for r in df.orderBy("doc_id", "page", "seq", "part").collect():
            out[r["doc_id"], r["page"]].append(r)
    assert set(pages) == set(merged)
    pairs = []
    for page, own in pages.items():
        at = 0
        for r in merged[page]:
            parts = own[at : at + r["merged"]]
            assert r["raw_text"] == " ".join(p["raw_text"] for p in parts) and r["indexes"] == [p["seq"] for p in parts]
            at += r["merged"]
            pairs += [(" ".join(p["raw_text"] for p in parts[:i]), parts[0]["role"], parts[i]["raw_text"], parts[i]["role"], True) for i in range(1, len(parts))]
            pairs += [(r["raw_text"], r["role"], own[at]["raw_text"], own[at]["role"], False)] if at < len(own) else []
        assert at == len(own)
    df = spark.createDataFrame(pairs, "a string, role_a string, b string, role_b string, merged boolean")
    structural = lambda x, role: F.col(role).isNotNull() | T.is_heading(F.col(x)) | F.startswith(F.col(x), F.lit("[")) | T.speaker(F.col(x)).isNotNull()
    goes_on, first = F.rlike("b", F.lit("^(?:" + T.CONTINUATION + ")")), F.substring("b", 1, 1)
    open_end = ~F.right("a", F.lit(1)).isin(*T.CLOSERS) | F.rlike(first, F.lit(r"^\p{Ll}")) | first.isin("‘", "’", "“", '"')
    rule = (goes_on & T.is_heading(F.col("a"))) | (~structural("a", "role_a") & ~structural("b", "role_b") & ~goes_on & (F.col("a") != "") & open_end)
    found = df.withColumn("rule", rule)
    assert found.where("merged").count() >= 20 and found.where("not merged").count() >= 100
    assert [tuple(r) for r in found.where("merged <> rule").limit(3).collect()] == []
    typed = structure.parse_document(spark, SF).collect()
    assert len(typed) == sum(map(len, merged.values())) == len({(r["doc_id"], r["id"]) for r in typed})


def test_forward_only(spark, tmp_path):
    """Sessions that come later than the watermark are left out, repeated ones too."""
    rows = [("a", "2024-05-01 00:00:00"), ("b", "2024-05-03 00:00:00"), ("b", "2024-05-03 00:00:00"), ("b", "2024-05-03 00:00:00"), ("late", "2024-04-01 00:00:00"), ("c", "2024-05-04 00:00:00")]
    # a trigger's watermark holds from the next but one on
    for n, part in enumerate((rows[:3], rows[3:4], rows[4:])):
        spark.createDataFrame(part, "session_id string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema("session_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    O.forward_only(stream, "1 day").writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    assert sorted(r["session_id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_blocks_are_typed_once_for_their_entries_and_themselves(spark):
    """Publication reads blocks that are written, not their lines' whole way from the documents twice over."""
    from recordloom.plans import catalog

    for name in ("public_payload", "alignment_summary"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "documents.parquet" not in plan and "ArrowEvalPython" not in plan


def test_groups_that_share_batches_are_folded_apart(spark):
    """Groups in one batch, and one that goes on from a batch into the next, each once and whole."""
    from recordloom.session import in_groups

    df = spark.range(5000).selectExpr("nullif(id % 7, 3) as k", "cast(id % 2 as int) as j", "id")
    rows = in_groups(df.where("k is null or k < 6 or id < 50"), ["k", "j"], lambda g: [{"k": g[0]["k"], "j": g[0]["j"], "n": len(g), "s": sum(r["id"] for r in g)}], "k long, j int, n long, s long").collect()
    want = df.where("k is null or k < 6 or id < 50").groupBy("k", "j").agg(F.count("*"), F.sum("id")).collect()
    assert len(rows) == 14 and {tuple(r) for r in rows} == {tuple(r) for r in want}
