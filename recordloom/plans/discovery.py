"""Queries over discovery, sources and publication, on events, orders and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import discovery as D
from ..operators import jobs as J
from ..operators import publishing as P
from ..operators import speech as SP
from ..session import written
from ..sources import records as S
from ..sources import speech as W
from .bindings import DAY, SEG_SQL, segments, table
from .structure import normalize_asr_sql, typed, TYPED_SQL


def _journals(spark, sf_dir):
    """A record a user and day with clicks; videos are the purchases of it."""
    e = table(spark, sf_dir, "events").withColumn("session_date", F.col("ts").cast("date"))
    days = e.where("event_type = 'click'").groupBy("user_id", "session_date").agg(F.min("event_id").alias("n"))
    days = days.select("user_id", "session_date", F.format_string("s-%d", "n").alias("session_id"), F.col("n").alias("journal_number"), F.format_string("https://host.example/%d.pdf", "n").alias("source_url"))
    return days, e.where("event_type = 'purchase'").select("user_id", "session_date", "event_id", F.format_string("v%05d", "event_id").alias("video_id"))


JOURNALS_SQL = """e AS (SELECT *, CAST(ts AS DATE) AS session_date FROM events), days AS (SELECT user_id, session_date, min(event_id) AS n FROM e WHERE event_type = 'click' GROUP BY 1, 2),
vids AS (SELECT user_id, session_date, list(printf('v%05d', event_id) ORDER BY event_id) AS ids FROM e WHERE event_type = 'purchase' GROUP BY 1, 2),
matches AS (SELECT d.user_id, d.session_date, 's-' || n AS session_id, n AS journal_number, 'https://host.example/' || n || '.pdf' AS source_url, CASE WHEN len(ids) = 1 THEN 'matched' ELSE 'review_required' END AS status,
  CASE WHEN len(ids) = 1 THEN 1.0 ELSE 0.0 END AS match_confidence, CASE WHEN len(ids) = 1 THEN ids[1] END AS video_id, coalesce(array_to_string(ids, ','), '') AS candidates FROM days d LEFT JOIN vids v ON d.user_id = v.user_id AND d.session_date = v.session_date)"""


def _matches(spark, sf_dir):
    return D.unique_date_match(*_journals(spark, sf_dir), ["user_id", "session_date"], order="event_id")


def unique_date_match(spark, sf_dir):
    return _matches(spark, sf_dir).select("session_id", "status", "match_confidence", "video_id", F.array_join("candidate_video_ids", ",").alias("candidates"))


def discovery_summary(spark, sf_dir):
    return D.summary(_matches(spark, sf_dir))


def _manifest(spark, sf_dir):
    """Sessions of the past, every third already published, and some that no feed has any more."""
    m = _matches(spark, sf_dir).where("session_date < '2024-01-15'")
    old = m.where("journal_number % 2 = 0").select("session_id", "session_date", "journal_number", F.lit("old").alias("source_url"), F.lit(2).cast("int").alias("current_revision"), F.when(F.col("journal_number") % 3 == 0, "published").when(F.col("journal_number") % 3 == 1, "review_required").alias("status"), F.lit(None).cast("string").alias("youtube_video_id"))
    gone = old.where("journal_number % 4 = 0").withColumn("session_id", F.concat(F.lit("x"), "session_id"))
    return old.unionByName(gone)


MANIFEST_SQL = f"""{JOURNALS_SQL}, old0 AS (SELECT session_id, session_date, journal_number, 'old' AS source_url, 2 AS current_revision, CASE WHEN journal_number % 3 = 0 THEN 'published' WHEN journal_number % 3 = 1 THEN 'review_required' END AS status, CAST(NULL AS VARCHAR) AS youtube_video_id FROM matches WHERE session_date < DATE '2024-01-15' AND journal_number % 2 = 0),
old AS (SELECT * FROM old0 UNION ALL SELECT 'x' || session_id, session_date, journal_number, source_url, current_revision, status, youtube_video_id FROM old0 WHERE journal_number % 4 = 0),
manifest AS (SELECT coalesce(n.session_id, o.session_id) AS session_id, coalesce(n.session_date, o.session_date) AS session_date, coalesce(n.journal_number, o.journal_number) AS journal_number, coalesce(n.source_url, o.source_url) AS source_url,
  CASE WHEN n.session_id IS NOT NULL THEN coalesce(o.current_revision, 0) ELSE o.current_revision END AS current_revision,
  CASE WHEN n.session_id IS NOT NULL AND (o.status IS NULL OR o.status IN ('discovered', 'review_required')) THEN CASE WHEN n.status = 'matched' THEN 'discovered' ELSE 'review_required' END ELSE o.status END AS status, coalesce(n.video_id, o.youtube_video_id) AS youtube_video_id FROM old o FULL OUTER JOIN matches n ON o.session_id = n.session_id)"""


def manifest_upsert(spark, sf_dir):
    return D.manifest_upsert(_manifest(spark, sf_dir), _matches(spark, sf_dir))


def status_patch(spark, sf_dir):
    merged = D.manifest_upsert(_manifest(spark, sf_dir), _matches(spark, sf_dir))
    done = _matches(spark, sf_dir).where("journal_number % 5 = 0").select("session_id", F.lit(7).alias("revision"))
    return D.status_patch(merged, done).select("session_id", "status", "current_revision")


def _preserved(spark, sf_dir):
    """Every user's sessions; preserved are odd ones before the 20th, some under another address."""
    m = _matches(spark, sf_dir)
    return m, m.where("session_date < '2024-01-20' and journal_number % 2 = 1").select("user_id", "session_date", F.when(F.col("journal_number") % 3 == 0, "moved").otherwise(F.col("source_url")).alias("source_url"))


KEPT_SQL = f"""{JOURNALS_SQL}, kept AS (SELECT user_id, session_date, CASE WHEN journal_number % 3 = 0 THEN 'moved' ELSE source_url END AS have FROM matches WHERE session_date < DATE '2024-01-20' AND journal_number % 2 = 1),
edge AS (SELECT user_id, max(session_date) AS newest FROM matches GROUP BY 1), last AS (SELECT user_id, max(session_date) AS latest FROM kept GROUP BY 1),
one AS (SELECT m.*, k.have, e.newest, l.latest FROM matches m LEFT JOIN kept k ON m.user_id = k.user_id AND m.session_date = k.session_date JOIN edge e ON m.user_id = e.user_id LEFT JOIN last l ON m.user_id = l.user_id)"""


def pending_sessions(spark, sf_dir):
    return D.pending_sessions(*_preserved(spark, sf_dir), keys=["user_id"])


def intake_plan(spark, sf_dir):
    m, kept = _preserved(spark, sf_dir)
    asked = lambda n: m.where(f"journal_number % {n} = 0").select("user_id", "session_date")
    return D.intake_plan(m, kept, asked(4), asked(9), keys=["user_id"])


def unknown_requests(spark, sf_dir):
    days = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("session_date")).distinct()
    return D.unknown_requests(days, _journals(spark, sf_dir)[0].where("user_id < 3").select("session_date").distinct())


def feed_unnest(spark, sf_dir):
    """The users' clicks as feeds, and back."""
    e = table(spark, sf_dir, "events").where("event_type = 'click'")
    doc = F.struct(F.col("event_id").cast("int").alias("id"), F.format_string("Journal No. 0%d (%s)", F.col("event_id"), F.date_format(F.col("ts").cast("date"), "MMMM d, yyyy")).alias("label"), F.format_string("/files/%d.pdf", "event_id").alias("url"), F.when(F.col("event_id") % 3 == 0, "a (Updated).pdf").otherwise("a.pdf").alias("filename"))
    party = e.groupBy("user_id").agg(F.array(F.struct(F.lit("other").alias("slug"), F.lit("Other").alias("label"), F.array().cast("array<struct<id:int,title:string,documents:array<struct<id:int,label:string,url:string,filename:string>>>>").alias("sections")), F.struct(F.lit("journal").alias("slug"), F.lit("J").alias("label"), F.array(F.struct(F.lit(6).alias("id"), F.lit("Documents").alias("title"), F.collect_list(doc).alias("documents"))).alias("sections"))).alias("parties"))
    feeds = party.select("user_id", F.from_json(F.to_json(F.struct("parties")), S.FEED).alias("x")).select("user_id", "x.parties")
    return S.records(S.feed_documents(feeds), "https://host.example/").select("user_id", "feed_document_id", "session_id", "logical_source_id", "session_date", "source_url", "updated_marker")


def title_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    label = F.format_string("TRIAL - JOURNAL NO. 00%d ( %s )", F.col("o_custkey"), F.upper(F.date_format("d", "MMMM dd yyyy")))
    title = F.when(F.col("o_orderkey") % 3 == 0, "no date").otherwise(F.format_string("Session (%s) ", F.date_format("d", "MMMM d, yyyy")))
    return o.select("o_orderkey", S.identity(label).alias("i"), S.video_date(title).alias("video_date")).select("o_orderkey", F.col("i.number").cast("long").alias("number"), "i.session_date", "video_date")


def playlist_videos(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    entry = F.struct(F.format_string("v%05d", "event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, F.format_string("Day (%s)", F.date_format(F.col("ts").cast("date"), "MMMM d, yyyy"))).otherwise("Trailer").alias("title"), F.col("value").alias("duration"))
    lists = e.groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(entry).alias("entries"))).alias("j"))
    lists = lists.select("user_id", F.from_json("j", S.PLAYLIST).alias("p")).select("user_id", "p.*")
    return S.playlist_videos(lists, "https://watch.example/?v=").select("user_id", "video_id", "duration_seconds", "session_date", "watch_url")


def revision_register(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256"))
    known = d.where("doc_id % 3 = 0").groupBy("source", "sha256").agg(F.min("doc_id").alias("m"))
    known = known.select("source", "sha256", F.row_number().over(Window.partitionBy("source").orderBy("m")).cast("long").alias("revision"))
    out = D.revision_register(known, d.where("doc_id % 3 > 0").withColumnRenamed("doc_id", "retrieved_at"))
    return out.select("source", "retrieved_at", "revision", "changed", "supersedes_revision")


def current_revisions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("event_id").alias("revision"), "event_type")
    return D.current_revisions(e)


def fingerprint_reuse(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("key"), F.sha2(F.concat_ws("|", "lang", "text"), 256).alias("fingerprint"))
    return D.fingerprint_reuse(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0")).select("doc_id")


def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def processing_plan(spark, sf_dir):
    span = segments(spark, sf_dir).agg(F.lit(0.0).alias("from"), F.ceil(F.max("end")).cast("double").alias("to"))
    return D.processing_plan(SP.plan_windows(span, DAY, 3600.0))


def duration_tolerance(spark, sf_dir):
    e = segments(spark, sf_dir).select("event_id", F.lit(0.0).alias("requested_start"), (F.col("value") - 5).alias("requested_end"), (F.col("value") - 5 + F.col("event_id") % 13 - 6).alias("duration"))
    return D.duration_faults(e).select("event_id")


def asr_jsonl_parse(spark, sf_dir):
    """Turns as recogniser lines, every fifth with bare quotes, every ninth no line at all."""
    c = table(spark, sf_dir, "conversations").withColumn("t", F.regexp_replace("text", r"[^A-Za-z0-9 ]", ""))
    said = F.when(F.col("turn") % 5 == 0, F.concat(F.lit('he said "'), "t", F.lit('" twice'))).otherwise(F.col("t"))
    line = F.when((F.col("conv_id") + F.col("turn")) % 9 == 0, "{broken").otherwise(F.concat(F.lit('{"start":'), (F.col("turn") * 1000).cast("string"), F.lit(',"end":'), (F.col("turn") * 1000 + 1500).cast("string"), F.lit(',"text":"'), said, F.lit('"}')))
    return W.parse_lines(c.select("conv_id", F.col("turn").alias("line_no"), line.alias("line")), 10.0).select("conv_id", "line_no", "start", "end", "text", "normalized_text", "repaired", "fault")


def asr_json_parse(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("t", F.when(F.col("turn") == 2, "  ").otherwise(F.concat(F.lit(" "), "text")))
    item = F.struct("turn", F.struct(F.struct((F.col("turn") * 1000).alias("from"), (F.col("turn") * 1000 + 900).alias("to")).alias("offsets"), F.col("t").alias("text")).alias("x"))
    docs = c.groupBy("conv_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["x"]).alias("transcription"))).alias("content"))
    return W.parse_documents(docs).select("conv_id", F.col("line_no").cast("long").alias("line_no"), "start", "end", "text", "normalized_text")


def public_index(spark, sf_dir):
    s = _matches(spark, sf_dir).where("status = 'matched'").groupBy(F.col("session_date").alias("date")).agg(F.min("journal_number").alias("journal_number"), F.min("video_id").alias("title"))
    return P.public_index(s)


def _published(spark, sf_dir):
    return typed(spark, sf_dir).select(F.col("doc_id").cast("string").alias("session"), (F.col("sequence") - 1).alias("pos"), "page", F.col("id").alias("block_id"), "kind", F.col("body").alias("text"), F.col("speaker_raw").alias("speaker"), "section_id", "section_title")


def _publication(spark, sf_dir):
    """Blocks, written once for their entries and themselves, and entries of every third."""
    blocks = written(_published(spark, sf_dir), "published")
    b = blocks.where("pos % 3 = 0")
    return blocks, b.select("session", "block_id", (F.col("pos") * 2.0).alias("start"), (F.col("pos") * 2.0 + 1).alias("end"), F.lit("approximate_dialogue_turn").alias("precision"), F.round((F.col("pos") % 10) / 10, 3).alias("confidence"), F.when(F.col("pos") % 2 == 0, "needs_review").otherwise("manual_reviewed").alias("review_state"), (F.col("pos") % 15 == 0).alias("conflict"))


def alignment_summary(spark, sf_dir):
    return P.alignment_summary(*_publication(spark, sf_dir))


def public_payload(spark, sf_dir):
    doc = P.public_payload(*_publication(spark, sf_dir))
    blocks = F.flatten(F.transform("pages", lambda p: p["blocks"]))
    return doc.select("session", F.size("pages").cast("long").alias("pages"), F.size(blocks).cast("long").alias("blocks"), F.size(F.filter(blocks, lambda b: b["timing"].isNotNull())).cast("long").alias("timed"), F.coalesce(F.array_join(F.transform("outline", lambda s: F.concat(s["id"], F.lit("@"), s["first_block_id"])), ","), F.lit("")).alias("outline"))


def schema_constraints(spark, sf_dir):
    e = segments(spark, sf_dir)
    b = e.select(F.when(F.col("event_id") % 100 > 0, F.col("event_id").cast("string")).alias("id"), F.col("event_id").alias("sequence"), (F.col("user_id") - 1).alias("page"), (F.col("start") - 1000).alias("start"), F.col("end"), (F.col("value") / 400).alias("confidence"), F.col("event_type").alias("kind"), F.when(F.col("event_type") != "error", F.col("normalized_text")).alias("text"))
    return P.schema_constraints(b)


def schema_report(spark, sf_dir):
    """The first ten violations: a report's limit."""
    e = segments(spark, sf_dir)
    b = e.select(F.col("event_id").alias("id"), F.col("event_id").alias("sequence"), F.lit(1).alias("page"), "start", "end", (F.col("value") / 400).alias("confidence"), F.col("event_type").alias("kind"), F.when(F.col("event_type") != "error", F.col("normalized_text")).alias("text"))
    return P.first_violations(b, "id")


def _feed(spark, sf_dir):
    """All of one feed: a record a session id, and its video if it is the only one, of a made-up length."""
    m = _matches(spark, sf_dir)
    return m.select("session_id", "journal_number", "source_url"), m.select("session_id", "status", "video_id", (F.col("journal_number") % 9000 + 60).alias("duration_seconds"))


def prepare_session(spark, sf_dir):
    """Every session that has a video, prepared: its chunks as recognition gets them."""
    records, matches = _feed(spark, sf_dir)
    asked = matches.where("status = 'matched'").select("session_id")
    done = J.prepared_sessions(J.matched_sessions(asked, records, matches, ["session_id"]), "session_id")
    rows = done.select("session_id", "journal_number", "video_id", "processing.state", F.explode("matrix").alias("x"))
    return rows.select("session_id", "journal_number", "video_id", "state", "x.*")


def canonical_hash(spark, sf_dir):
    """Fingerprints of nested configurations whose fields are not in order."""
    n = table(spark, sf_dir, "nation")
    rows = n.select("n_nationkey", F.struct(F.col("n_regionkey").alias("z"), F.struct(F.col("n_name").alias("name"), F.lit(None).cast("string").alias("alias")).alias("b"), F.array(F.struct(F.lit(2).alias("y"), F.col("n_nationkey").alias("x"))).alias("a")).alias("config"))
    return rows.select("n_nationkey", F.sha2(S.canonical(rows, "config"), 256).alias("fingerprint"))


def _sessions(spark, sf_dir):
    """Orders as published sessions, some of them faulty."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = lambda c: c.cast("string")
    off = lambda n, good, bad: F.when(k % n == 0, bad).otherwise(good)
    return o.select(
        text(k).alias("id"), off(7, F.lit("1.1.0"), F.lit("1.0.0")).alias("schema_version"), off(11, text(F.col("o_orderdate").cast("date")), F.lit("2024-02-30")).alias("date"), (k % 13).alias("journal_number"), off(17, F.lit("t"), F.lit(None)).alias("title"),
        off(19, F.concat(F.lit("https://host.example/"), text(k)), F.lit("no address")).alias("journal_url"), off(23, F.lit("2024-01-02T03:04:05Z"), F.lit("2024-01-02 03:04")).alias("retrieved_at"), off(29, F.sha2(text(k), 256), F.upper(F.sha2(text(k), 256))).alias("sha256"), (k % 31).alias("page_count"),
        F.lit("v").alias("video_id"), F.lit("https://watch.example/?v=1").alias("video_url"), off(37, F.lit("p"), F.lit(None)).alias("playlist_id"), F.lit("c").alias("channel"), (k % 41).alias("duration_seconds"), (k % 43).alias("source_revision"),
        (k % 47).alias("total_blocks"), (k % 5 - 1).alias("timed_blocks"), (k % 53 / 50).alias("coverage"), F.lit(0).alias("needs_review"),
    )


def session_faults(spark, sf_dir):
    return P.session_faults(_sessions(spark, sf_dir))


def route_dates(spark, sf_dir):
    """Orders' pages by path, some of which are no session's."""
    o, day = table(spark, sf_dir, "orders"), F.col("o_orderdate").cast("date").cast("string")
    path = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("/sessions/"), day)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("/sessions/"), day, F.lit("/"))).otherwise(F.concat(F.lit("/about/"), day))
    return o.select("o_orderkey", S.route_date(path).alias("session_date"))


def realtime_factor(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", J.realtime_factor(F.col("l_tax").cast("double") * 1000, F.col("l_quantity").cast("double")).alias("realtime_factor"))


def run_states(spark, sf_dir):
    """The state in which each user's run was left."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("state"), F.col("event_id").alias("at"))
    return J.status_log(e)


def shown_blocks(spark, sf_dir):
    return P.shown_blocks(_published(spark, sf_dir)).groupBy("session").agg(F.count("*").alias("shown"))


QUERIES = {f.__name__: f for f in (prepare_session, canonical_hash, session_faults, route_dates, realtime_factor, run_states, shown_blocks, unique_date_match, discovery_summary, manifest_upsert, status_patch, pending_sessions, intake_plan, unknown_requests, feed_unnest, title_dates, playlist_videos, revision_register, current_revisions, fingerprint_reuse, content_hash, processing_plan, duration_tolerance, asr_jsonl_parse, asr_json_parse, public_index, alignment_summary, public_payload, schema_constraints, schema_report)}

_PUB = f"{TYPED_SQL}, entry AS (SELECT doc_id, id, sequence - 1 AS pos, (sequence - 1) % 15 = 0 AS conflict, CASE WHEN (sequence - 1) % 2 = 0 THEN 'needs_review' ELSE 'manual_reviewed' END AS review_state FROM typed WHERE (sequence - 1) % 3 = 0)"
ORACLE_SQL = {
    "prepare_session": f"""WITH {JOURNALS_SQL}, s AS (SELECT session_id, journal_number, video_id, CAST(journal_number % 9000 + 60 AS DOUBLE) AS d FROM matches WHERE status = 'matched'), c AS (SELECT *, unnest(range(1, CAST(ceil(d / 1800) AS BIGINT) + 1)) AS n FROM s),
      w AS (SELECT *, (n - 1) * 1800.0 AS a, least(d, n * 1800.0) AS b FROM c) SELECT session_id, journal_number, video_id, 'prepared' AS state, printf('%03d', n) AS number, CAST(greatest(0.0, a - 15) AS DOUBLE) AS "start", CAST(least(d, b + 15) - greatest(0.0, a - 15) AS DOUBLE) AS duration, CAST(a AS DOUBLE) AS own_start, CAST(b AS DOUBLE) AS own_end FROM w""",
    "canonical_hash": """SELECT n_nationkey, sha256('{"a":[{"x":' || n_nationkey || ',"y":2}],"b":{"alias":null,"name":"' || n_name || '"},"z":' || n_regionkey || '}') AS fingerprint FROM nation""",
    "session_faults": """WITH s AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS id FROM orders)
      SELECT id, 'schema_version' AS "constraint" FROM s WHERE k % 7 = 0 UNION ALL SELECT id, 'date_format' FROM s WHERE k % 11 = 0 UNION ALL SELECT id, 'journal_number_from_1' FROM s WHERE k % 13 = 0 UNION ALL SELECT id, 'title' FROM s WHERE k % 17 = 0
      UNION ALL SELECT id, 'journal_url_format' FROM s WHERE k % 19 = 0 UNION ALL SELECT id, 'retrieved_at_format' FROM s WHERE k % 23 = 0 UNION ALL SELECT id, 'sha256_pattern' FROM s WHERE k % 29 = 0 UNION ALL SELECT id, 'page_count_from_1' FROM s WHERE k % 31 = 0
      UNION ALL SELECT id, 'playlist_id' FROM s WHERE k % 37 = 0 UNION ALL SELECT id, 'duration_above_0' FROM s WHERE k % 41 = 0 UNION ALL SELECT id, 'source_revision_from_1' FROM s WHERE k % 43 = 0 UNION ALL SELECT id, 'total_blocks_from_1' FROM s WHERE k % 47 = 0
      UNION ALL SELECT id, 'timed_blocks_from_0' FROM s WHERE k % 5 = 0 UNION ALL SELECT id, 'coverage_0_to_1' FROM s WHERE k % 53 > 50""",
    "route_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS session_date FROM orders",
    "realtime_factor": "SELECT l_orderkey, l_linenumber, round(CAST(l_tax AS DOUBLE) * 1000 / CAST(l_quantity AS DOUBLE), 4) AS realtime_factor FROM lineitem",
    "run_states": "SELECT user_id AS key, arg_max(event_type, event_id) AS state, max(event_id) AS at FROM events GROUP BY 1",
    "shown_blocks": f"WITH {_PUB} SELECT CAST(doc_id AS VARCHAR) AS session, count(*) AS shown FROM typed WHERE kind <> 'other' GROUP BY 1",
    "unique_date_match": f"WITH {JOURNALS_SQL} SELECT session_id, status, match_confidence, video_id, candidates FROM matches",
    "discovery_summary": f"WITH {JOURNALS_SQL} SELECT count(*) AS records, count(*) FILTER (WHERE status = 'matched') AS matched, count(*) FILTER (WHERE status <> 'matched') AS review_required FROM matches",
    "manifest_upsert": f"WITH {MANIFEST_SQL} SELECT * FROM manifest",
    "status_patch": f"WITH {MANIFEST_SQL}, done AS (SELECT session_id FROM matches WHERE journal_number % 5 = 0) SELECT m.session_id, CASE WHEN d.session_id IS NOT NULL AND coalesce(m.status NOT IN ('pdf_parsed', 'aligned', 'published', 'prototype_ready_review_pending'), true) THEN 'source_preserved' ELSE m.status END AS status, CASE WHEN d.session_id IS NOT NULL THEN 7 ELSE m.current_revision END AS current_revision FROM manifest m LEFT JOIN done d ON m.session_id = d.session_id",
    "pending_sessions": f"WITH {KEPT_SQL} SELECT DISTINCT user_id, session_date FROM one WHERE status = 'matched' AND ((have IS NULL AND (latest IS NULL OR session_date > latest)) OR have <> source_url)",
    "intake_plan": f"""WITH {KEPT_SQL}, r AS (SELECT *, CASE WHEN journal_number % 9 = 0 THEN 'requested_session' WHEN journal_number % 4 = 0 AND have IS NULL THEN 'pending_video_or_processing' WHEN have IS NULL AND (latest IS NULL OR session_date > latest) THEN 'new_journal' WHEN have <> source_url THEN 'source_url_changed' WHEN have IS NOT NULL AND session_date = newest THEN 'verify_latest_revision' END AS reason FROM one)
      SELECT user_id, session_date, session_id, source_url, CASE WHEN status = 'matched' THEN video_id END AS video_id, 'automation/session-' || session_date AS branch, reason FROM r WHERE reason IS NOT NULL""",
    "unknown_requests": f"WITH {JOURNALS_SQL} SELECT DISTINCT session_date FROM e WHERE session_date NOT IN (SELECT session_date FROM days WHERE user_id < 3)",
    "feed_unnest": "SELECT user_id, CAST(event_id AS INT) AS feed_document_id, printf('session-%02d', event_id) AS session_id, printf('journal-%02d-', event_id) || CAST(ts AS DATE) AS logical_source_id, CAST(ts AS DATE) AS session_date, 'https://host.example/files/' || event_id || '.pdf' AS source_url, event_id % 3 = 0 AS updated_marker FROM events WHERE event_type = 'click'",
    "title_dates": "SELECT o_orderkey, o_custkey AS number, CAST(o_orderdate AS DATE) AS session_date, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS video_date FROM orders",
    "playlist_videos": "SELECT user_id, printf('v%05d', event_id) AS video_id, value AS duration_seconds, CASE WHEN event_id % 2 = 0 THEN CAST(ts AS DATE) END AS session_date, 'https://watch.example/?v=' || printf('v%05d', event_id) AS watch_url FROM events WHERE event_type = 'purchase'",
    "revision_register": """WITH d AS (SELECT doc_id, source, sha256(text) AS h FROM documents), k0 AS (SELECT source, h, min(doc_id) AS m FROM d WHERE doc_id % 3 = 0 GROUP BY 1, 2), k AS (SELECT source, h, row_number() OVER (PARTITION BY source ORDER BY m) AS rev FROM k0), l AS (SELECT source, max(rev) AS last FROM k GROUP BY 1),
      i AS (SELECT d.*, k.rev AS have FROM d LEFT JOIN k ON d.source = k.source AND d.h = k.h WHERE doc_id % 3 > 0), f0 AS (SELECT source, h, min(doc_id) AS got FROM i WHERE have IS NULL GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY got, h) AS nth FROM f0),
      r AS (SELECT i.source, i.doc_id, coalesce(have, coalesce(last, 0) + nth) AS revision, have IS NULL AND i.doc_id = f.got AS changed FROM i LEFT JOIN f ON i.source = f.source AND i.h = f.h LEFT JOIN l ON i.source = l.source)
      SELECT source, doc_id AS retrieved_at, revision, changed, CASE WHEN revision > 1 THEN revision - 1 END AS supersedes_revision FROM r""",
    "current_revisions": "SELECT user_id AS source, max(event_id) AS revision, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "fingerprint_reuse": "WITH d AS (SELECT doc_id, source, sha256(concat_ws('|', lang, text)) AS f FROM documents) SELECT doc_id FROM d WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM d o WHERE o.doc_id % 2 = 0 AND o.source = d.source AND o.f = d.f)",
    "content_hash": "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1",
    "processing_plan": f"""WITH {SEG_SQL}, span AS (SELECT ceil(max("end")) AS till FROM seg), p AS (SELECT n, till FROM (SELECT till, unnest(range(1, CAST(ceil(till / {DAY}) AS BIGINT) + 1)) AS n FROM span))
      SELECT printf('chunk-%03d', n) AS id, n AS number, greatest(0.0, (n - 1) * {DAY} - 3600) AS "start", least(till, least(till, n * {DAY}) + 3600) AS "end", (n - 1) * {DAY} AS own_start, least(till, n * {DAY}) AS own_end FROM p""",
    "duration_tolerance": "WITH p AS (SELECT event_id, value - 5 AS asked, value - 5 + event_id % 13 - 6 AS took FROM events) SELECT event_id FROM p WHERE asked <= 0 OR abs(took - asked) > greatest(5.0, asked * 0.02)",
    "asr_jsonl_parse": f"""WITH c AS (SELECT conv_id, turn, regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g') AS t FROM conversations), s AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 9 = 0 THEN NULL WHEN turn % 5 = 0 THEN trim('he said "' || t || '" twice') ELSE trim(t) END AS text, (conv_id + turn) % 9 = 0 AS bad FROM c)
      SELECT conv_id, turn AS line_no, CASE WHEN NOT bad THEN 10.0 + turn * 1000 / 1000.0 END AS "start", CASE WHEN NOT bad THEN 10.0 + (turn * 1000 + 1500) / 1000.0 END AS "end", text, {normalize_asr_sql("text")} AS normalized_text, NOT bad AND turn % 5 = 0 AS repaired, CASE WHEN bad THEN 'invalid' END AS fault FROM s WHERE bad OR text <> ''""",
    "asr_json_parse": f"""WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line_no, turn, trim(CASE WHEN turn = 2 THEN '' ELSE text END) AS text FROM conversations)
      SELECT conv_id, line_no, turn * 1000 / 1000.0 AS "start", (turn * 1000 + 900) / 1000.0 AS "end", text, {normalize_asr_sql("text")} AS normalized_text FROM c WHERE text <> ''""",
    "public_index": f"WITH {JOURNALS_SQL}, s AS (SELECT session_date AS date, min(journal_number) AS journal_number, min(video_id) AS title FROM matches WHERE status = 'matched' GROUP BY 1) SELECT date, journal_number, title, '/data/sessions/' || date || '.json' AS path, (SELECT max(date) FROM s) AS latest FROM s",
    "alignment_summary": f"""WITH {_PUB}, t AS (SELECT doc_id, count(*) AS n FROM typed GROUP BY 1), k AS (SELECT doc_id, count(DISTINCT id) FILTER (WHERE NOT conflict) AS timed, count(*) FILTER (WHERE NOT conflict AND review_state = 'needs_review') AS nr, count(*) FILTER (WHERE NOT conflict AND review_state = 'manual_reviewed') AS mr, count(*) FILTER (WHERE conflict) AS c FROM entry GROUP BY 1)
      SELECT CAST(t.doc_id AS VARCHAR) AS session, n AS total_blocks, coalesce(timed, 0) AS timed_blocks, coalesce(nr, 0) AS needs_review, coalesce(mr, 0) AS manual_reviewed, coalesce(c, 0) AS unresolved_conflicts, round(coalesce(timed, 0) / n, 4) AS coverage FROM t LEFT JOIN k ON t.doc_id = k.doc_id""",
    "public_payload": f"""WITH {_PUB}, b AS (SELECT t.*, e.id IS NOT NULL AS timed FROM typed t LEFT JOIN entry e ON t.doc_id = e.doc_id AND t.id = e.id AND NOT e.conflict), s AS (SELECT doc_id, section_id, min(sequence) AS pos, arg_min(id, sequence) AS f FROM b WHERE section_id IS NOT NULL GROUP BY 1, 2), o AS (SELECT doc_id, string_agg(section_id || '@' || f, ',' ORDER BY pos) AS outline FROM s GROUP BY 1)
      SELECT CAST(b.doc_id AS VARCHAR) AS session, count(DISTINCT page) AS pages, count(*) AS blocks, count(*) FILTER (WHERE timed) AS timed, coalesce(any_value(o.outline), '') AS outline FROM b LEFT JOIN o ON b.doc_id = o.doc_id GROUP BY b.doc_id""",
    "schema_constraints": f"""WITH {SEG_SQL}, b AS (SELECT CASE WHEN event_id % 100 > 0 THEN event_id END AS id, event_id AS sequence, user_id - 1 AS page, "start" - 1000 AS s, "end" AS e, value / 400 AS c, event_type AS kind, CASE WHEN event_type <> 'error' THEN normalized_text END AS text FROM seg)
      SELECT 'confidence_0_to_1' AS "constraint", count(*) FILTER (WHERE NOT (c BETWEEN 0 AND 1)) AS violations FROM b UNION ALL SELECT 'end_from_0', count(*) FILTER (WHERE e < 0) FROM b UNION ALL SELECT 'has_id', count(*) FILTER (WHERE id IS NULL) FROM b UNION ALL SELECT 'has_kind', count(*) FILTER (WHERE kind IS NULL) FROM b UNION ALL SELECT 'has_text', count(*) FILTER (WHERE text IS NULL) FROM b
      UNION ALL SELECT 'page_from_1', count(*) FILTER (WHERE page < 1) FROM b UNION ALL SELECT 'sequence_from_1', count(*) FILTER (WHERE sequence < 1) FROM b UNION ALL SELECT 'start_from_0', count(*) FILTER (WHERE s < 0) FROM b""",
    "schema_report": f"""WITH {SEG_SQL}, b AS (SELECT event_id AS id, value / 400 AS c, CASE WHEN event_type <> 'error' THEN normalized_text END AS text FROM seg), v AS (SELECT id, 'confidence_0_to_1' AS "constraint" FROM b WHERE NOT (c BETWEEN 0 AND 1) UNION ALL SELECT id, 'has_text' FROM b WHERE text IS NULL UNION ALL SELECT id, 'sequence_from_1' FROM b WHERE id < 1) SELECT * FROM v ORDER BY id, "constraint" LIMIT 10""",
}
