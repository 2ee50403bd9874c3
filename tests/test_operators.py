"""Known cases of single operators."""

import pytest
from pyspark.sql import functions as F

from recordloom.functions import text as T
from recordloom.operators import discovery as D
from recordloom.operators import reading as R
from recordloom.operators import speech as SP
from recordloom.operators import structure as ST
from recordloom.sources import records, speech


def one(spark, expr, *values):
    return spark.range(1).select(expr(*[F.lit(v) for v in values]).alias("x")).first()["x"]


def test_windows(spark):
    plan = SP.plan_windows(spark.createDataFrame([(100.0, 365.0)], "from double, to double"), 120, 5).collect()
    assert [(r["core_start"], r["core_end"], r["input_start"], r["input_end"]) for r in plan] == [(100, 220, 100, 225), (220, 340, 215, 345), (340, 365, 335, 365)]
    chunks = SP.plan_windows(spark.createDataFrame([(0.0, 3700.0)], "from double, to double"), 1800, 15).collect()
    assert [(r["input_start"], r["input_end"]) for r in chunks] == [(0, 1815), (1785, 3615), (3585, 3700)]
    with pytest.raises(ValueError):
        SP.plan_windows(spark.range(1), 10, 5)


SEG = "k int, n int, start double, end double, normalized_text string"


def findings(spark, rows, seconds=120.0):
    df = spark.createDataFrame([(1, i, a, b, t) for i, (a, b, t) in enumerate(rows)], SEG)
    q = SP.transcript_quality(df, ["k"], ["start", "n"])
    return q.first(), q.select(SP.findings(F.lit(seconds)).alias("f")).first()["f"]


def test_loops_are_found(spark):
    q, f = findings(spark, [(i * 2.0, i * 2.0 + 2, "again and again") for i in range(30)])
    assert q["max_repeated_phrase_seconds"] == 60 and "repeated_phrase_loop" in f
    q, f = findings(spark, [(30.0, 32.0, "you"), (60.0, 62.0, "you"), (90.0, 92.0, "you")])
    assert q["max_repeated_phrase_seconds"] == 62 and f == ["repeated_phrase_loop"]
    assert findings(spark, [(0.0, 120.0, "you")])[1] == ["low_lexical_diversity"]
    assert findings(spark, [(0.0, 60.0, "blank_audio")])[1] == ["non_speech_dominated"]


def test_chunks_are_those_of_the_plan(spark):
    number = lambda *n: spark.createDataFrame([(i,) for i in n], "number long")
    assert SP.checked_chunks(number(1, 2), number(1, 2)).count() == 2
    for have in ((1,), (1, 1, 2), (1, 2, 3)):
        with pytest.raises(Exception, match="not those of the plan"):
            SP.checked_chunks(number(*have), number(1, 2)).collect()


def test_merged_fragments_keep_their_blocks_and_the_box_around_them(spark):
    rows = [(1, 1, 1, "The session was", [0.0, 10.0, 50.0, 20.0]), (1, 1, 2, "resumed.", [5.0, 20.0, 60.0, 30.0])]
    parts = ST.split_artifacts(spark.createDataFrame(rows, "doc_id long, page long, seq long, text string, bbox array<double>"))
    row = ST.merge_fragments(parts).first()
    assert (row["indexes"], row["bbox"], row["source_text"]) == ([1, 2], [0.0, 10.0, 60.0, 30.0], "The session was\nresumed.")


def test_quality_gate(spark):
    rows = spark.createDataFrame([(1, i, i * 2.0, i * 2.0 + 2, "again") for i in range(30)], SEG)
    with pytest.raises(Exception, match="quality gate"):
        SP.quality_gate(SP.transcript_quality(rows, ["k"], ["start"])).collect()


def test_text(spark):
    assert one(spark, T.normalize_asr, "Señor—Reyes’ CO-OP ẞ_x") == "señor reyes co op ss_x"
    assert one(spark, T.normalize_record, "ﬁnd re- gister­ed, CO-OP!") == "find re-gistered co-op"
    assert one(spark, T.slug, "Órdenes del día — №1") == "ordenes-del-dia-no1"
    assert one(spark, T.slug, "!!!") == "section"
    assert one(spark, T.format_time, 20776.9) == "5:46:16"
    assert one(spark, T.format_time, -3.0) == "0:00"
    assert one(spark, T.speaker, "Mr. Reyes. Good morning.") == "Mr. Reyes"
    assert one(spark, T.speaker, "Mr. Reyes.") is None
    assert one(spark, T.speech, "The Chair. Order!") == "Order!"
    assert one(spark, T.is_heading, "ROLL CALL (continuation of page 3)") is True
    assert one(spark, T.is_heading, "MONDAY, JULY 6, 2026") is False
    assert one(spark, T.join_lines, "  a \n\n b\x0bc ") == "a b c"


def test_time_references(spark):
    refs = one(spark, T.time_references, "At 5:07 p.m. see Exhibit “D-1 - 145 - A”, video 51:07")
    assert [(r["time_domain"], r["time_seconds"], r["time_seconds_since_midnight"], r["exhibit_id"]) for r in refs] == [("wall_clock", None, 17 * 3600 + 7 * 60, None), ("exhibit", 3067, None, "D-1-145-A")]
    assert one(spark, T.time_references, "at 51:07 nothing") == []


def test_fragments_are_merged_by_what_they_have_become(spark):
    rows = [(1, 1, 1, "The session was"), (1, 1, 2, "resumed."), (1, 1, 3, "ROLL CALL"), (1, 1, 4, "{continuation}"), (1, 1, 5, "MONDAY, JULY 6, 2026\n17"), (1, 2, 1, "  ")]
    parts = ST.split_artifacts(spark.createDataFrame(rows, "doc_id long, page long, seq long, text string"))
    out = [(r["raw_text"], r["role"], r["merged"]) for r in ST.merge_fragments(parts).orderBy("page", "seq", "part").collect()]
    assert out == [("The session was resumed.", None, 2), ("ROLL CALL {continuation}", None, 2), ("MONDAY, JULY 6, 2026", "page_header", 1), ("17", "page_number", 1)]


BLOCKS = "s string, block_id string, sequence int, start double, end double, precision string, review_state string"


def test_reader(spark):
    rows = [("s", "d", 1, 20.0, 30.0, "approximate_dialogue_turn", "x"), ("s", "n", 2, 20.0, 40.0, "narrative_summary_range", "x")]
    probes = spark.createDataFrame([("s", i, t) for i, t in enumerate([22.0, 35.0, 45.0, 19.9])], "s string, probe int, t double")
    got = R.active_block_at(probes, spark.createDataFrame(rows, BLOCKS), ["s"]).orderBy("probe").collect()
    assert [r["block_id"] for r in got] == ["d", "n", None, "d"]
    ranges = spark.createDataFrame([("s", 10.0, 12.0), ("s", 12.5, 15.0), ("s", 17.0, 19.0), ("s", 30.0, 32.0), ("s", 31.0, 31.0)], "s string, start double, end double")
    assert [(r["start"], r["end"]) for r in R.merge_ranges(ranges, ["s"]).orderBy("start").collect()] == [(10, 15), (17, 19), (30, 32)]


def test_recogniser_lines(spark):
    lines = spark.createDataFrame([(1, '{"start":0,"end":900,"text":" he said "yes" and left "}'), (2, ""), (3, '{"start":1000,"end":1500,"text":"  "}'), (4, "junk"), (5, '{"start":500,"end":400,"text":"x"}')], "line_no int, line string")
    got = speech.order_faults(speech.parse_lines(lines, 100.0), [], "line_no").orderBy("line_no").collect()
    assert [(r["line_no"], r["text"], r["repaired"], r["fault"]) for r in got] == [(1, 'he said "yes" and left', True, None), (4, None, False, "invalid"), (5, "x", False, "not_monotonic")]
    with pytest.raises(Exception, match="invalid recogniser output"):
        speech.strict(speech.parse_lines(lines)).collect()


def test_titles(spark):
    assert one(spark, records.identity, "Trial - Journal No. 06 (July 14 2026)")["number"] == 6
    assert str(one(spark, records.video_date, "Day (July 15, 2026)")) == "2026-07-15"
    assert one(spark, records.identity, "Minutes") is None


def test_manifest_is_idempotent_and_does_not_go_back(spark):
    schema = "session_id string, session_date string, journal_number int, source_url string, current_revision int, status string, youtube_video_id string"
    old = spark.createDataFrame([("a", "d1", 1, "u", 3, "published", "v"), ("b", "d2", 2, "u", 0, "review_required", None)], schema)
    new = spark.createDataFrame([("a", "d1", 1, "u2", "review_required", None), ("b", "d2", 2, "u", "matched", "w"), ("c", "d3", 3, "u", "matched", "x")], "session_id string, session_date string, journal_number int, source_url string, status string, video_id string")
    once = D.manifest_upsert(old, new)
    rows = {r["session_id"]: (r["status"], r["current_revision"], r["youtube_video_id"], r["source_url"]) for r in once.collect()}
    assert rows == {"a": ("published", 3, "v", "u2"), "b": ("discovered", 0, "w", "u"), "c": ("discovered", 0, "x", "u")}
    assert sorted(D.manifest_upsert(once, new).collect()) == sorted(once.collect())


def test_retry_and_files(tmp_path):
    tries, slept = [], []

    def fails():
        tries.append(1)
        raise OSError("no")

    assert records.read_with_retry(fails, lambda: b"x", 3, slept.append) == b"x"
    assert len(tries) == 3 and slept == [1, 2]
    with pytest.raises(ValueError):
        records.read_with_retry(fails, None, 9)
    path = str(tmp_path / "a" / "b.json")
    assert records.write_if_changed(path, "x") and not records.write_if_changed(path, "x") and records.write_if_changed(path, "y")


def test_documents_are_checked(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    assert records.read_documents(spark, str(tmp_path)).first()["byte_length"] == 10
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    with pytest.raises(Exception, match="no PDF"):
        records.read_documents(spark, str(tmp_path)).collect()


def test_candidates_are_in_the_order_of_their_events(spark, tmp_path):
    """Ids of six digits come after those of five, though v100000 is less than v99999."""
    from recordloom.plans import catalog

    rows = [(99998, "click"), (99999, "purchase"), (100000, "purchase")]
    spark.createDataFrame([(i, 1, t) for i, t in rows], "event_id long, user_id long, event_type string").withColumn("ts", F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    assert catalog.QUERIES["unique_date_match"](spark, str(tmp_path)).first()["candidates"] == "v99999,v100000"


def test_folding_is_that_of_python_for_every_character(spark):
    """Plain characters are folded by Spark, alone and beside a combining mark, an unusual one or at a word's end; others by Python."""
    import re
    import unicodedata

    texts = [t for c in range(0x20, 0x3100) for t in (chr(c), f"Aa{chr(c)}", f"{chr(c)}\u0301b", f"\ufb01 {chr(c)}")]
    folded = [unicodedata.normalize("NFKC", t).casefold() for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    x = F.col("x")
    for found, want in ((T.nfkc(x), [unicodedata.normalize("NFKC", t) for t in texts]), (T.casefold(x), [t.casefold() for t in texts]), (T.casefold(T.nfkc(x)), folded)):
        assert [r[1] for r in df.select("i", found).orderBy("i").collect()] == want
    found = df.select("i", T.normalize_asr(x)).orderBy("i").collect()
    ascii_only = [i for i, t in enumerate(folded) if t.isascii()]
    assert len(ascii_only) > 1000 and all(found[i][1] == re.sub("[^a-z0-9_]+", " ", folded[i]).strip(" ") for i in ascii_only)


def test_ordinary_text_is_not_sent_to_python(spark):
    """What Python gets grows with the unusual texts, not with the table."""
    sent = []
    known = T._python_text
    T._python_text = lambda name: lambda x: sent.append(x) or known(name)(x)
    try:
        df = spark.createDataFrame([("Çà É über-\n straße",), ("ﬁn",), (None,)], "x string")
        df.select(T.normalize_asr(F.col("x")), T.normalize_record(F.col("x"))).collect()
        assert [r[0] for r in df.select(sent[0]).collect()] == [None, "ﬁn", None]
    finally:
        T._python_text = known
    assert [tuple(r) for r in df.select(T.normalize_asr(F.col("x")), T.normalize_record(F.col("x"))).collect()] == [("çà é über strasse", "çà é über-strasse"), ("fin", "fin"), (None, None)]
