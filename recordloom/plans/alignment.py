"""Queries over retrieval, scoring and alignment: benchmark items against documents, and turns against themselves misheard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity
from ..functions.text import normalize_asr, normalize_record, tokens
from ..operators import alignment as A
from ..operators import evaluation as E
from ..operators import jobs as J
from ..operators import retrieval as R
from ..session import written
from .bindings import table
from .structure import normalize_asr_sql


def _documents(spark, sf_dir) -> DataFrame:
    """Documents as the segments of one session."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select(F.lit("all").alias("session"), F.col("doc_id").alias("seg"), normalize_asr(F.col("text")).alias("normalized_text"))


def _items(spark, sf_dir) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.lit("all").alias("session"), F.col("item_id").alias("block"), tokens(normalize_asr(F.col("text"))).alias("tokens"))


def _words(spark, sf_dir) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return R.query_tokens(_items(spark, sf_dir), R.token_idf(docs), docs.groupBy("session").agg(F.count("*").alias("n")))


STATS_SQL = f"""docs AS (SELECT 'all' AS session, doc_id AS seg, string_split({normalize_asr_sql("text")}, ' ') AS toks FROM documents WHERE text IS NOT NULL), sizes AS (SELECT session, count(*) AS n FROM docs GROUP BY 1),
posts AS (SELECT DISTINCT session, seg, t AS token FROM (SELECT session, seg, unnest(toks) AS t FROM docs) WHERE t <> ''), dfs AS (SELECT session, token, count(*) AS df FROM posts GROUP BY 1, 2),
stats AS (SELECT d.session, d.token, df, n, ln((n + 1) / (df + 1)) + 1 AS idf FROM dfs d JOIN sizes s ON d.session = s.session),
items AS (SELECT 'all' AS session, item_id AS block, unnest(string_split({normalize_asr_sql("text")}, ' ')) AS token FROM benchmark), q0 AS (SELECT session, block, token, count(*) AS c FROM items WHERE token <> '' GROUP BY 1, 2, 3),
q AS (SELECT q0.session, q0.block, q0.token, c, coalesce(df, 0) AS df, sizes.n, ln((sizes.n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM q0 JOIN sizes ON q0.session = sizes.session LEFT JOIN stats ON q0.session = stats.session AND q0.token = stats.token)"""
_STOP = "(" + ", ".join(f"'{w}'" for w in R.STOPWORDS) + ")"
_INFORMATIVE = f"length(token) > 2 AND token NOT IN {_STOP} AND df <= greatest(5, ceil(n * 0.025))"
RARE_SQL = f"{STATS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY session, block ORDER BY df, token) AS rank FROM q WHERE {_INFORMATIVE}), rare AS (SELECT * FROM ranked WHERE rank <= 12)"
VOTES_SQL = f"""{RARE_SQL}, votes AS (SELECT r.session, r.block, p.seg, round(sum(r.idf), 9) AS votes, min(r.rank) AS first FROM rare r JOIN posts p ON r.session = p.session AND r.token = p.token GROUP BY 1, 2, 3),
seeds AS (SELECT *, row_number() OVER (PARTITION BY session, block ORDER BY votes DESC, first, seg) AS seed FROM votes)"""


def token_idf(spark, sf_dir):
    return R.token_idf(_documents(spark, sf_dir)).select("session", "token", "df", F.round("idf", 6).alias("idf"))


def informative_tokens(spark, sf_dir):
    return R.token_idf(_documents(spark, sf_dir)).where(R.informative()).select("session", "token", "df")


def rare_tokens(spark, sf_dir):
    return R.rare_tokens(_words(spark, sf_dir)).select("block", "token", F.col("rank").cast("long").alias("rank"))


def _seeds(spark, sf_dir):
    return R.posting_votes(R.rare_tokens(_words(spark, sf_dir)), R.postings(_documents(spark, sf_dir)))


def posting_votes(spark, sf_dir):
    return _seeds(spark, sf_dir).select("block", "seg", F.round("votes", 6).alias("votes"), F.col("seed").cast("long").alias("seed"))


def exact_coverage(spark, sf_dir):
    """Of each item and each document it is seeded to: the weight of shared tokens, counts clipped."""
    words = _words(spark, sf_dir).groupBy("session", "block").agg(F.sort_array(F.collect_list(F.struct("token", "count", "idf"))).alias("words"))
    heard = _documents(spark, sf_dir).select("session", "seg", tokens(F.col("normalized_text")).alias("heard"))
    pairs = _seeds(spark, sf_dir).select("session", "block", "seg").join(words, ["session", "block"]).join(heard, ["session", "seg"])
    return pairs.select("block", "seg", F.round(R.exact_coverage("words", "heard"), 6).alias("exact_coverage"))


def indel_ratio(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    pairs = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return pairs.select("n_name", "r_name", F.round(similarity.indel(F.lower("n_name"), F.lower("r_name")), 6).alias("ratio"))


def _blocks(spark, sf_dir):
    """Turns as blocks: a system turn is a summary, which is not searched."""
    c = table(spark, sf_dir, "conversations")
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    kind = F.when(F.col("role") == "system", "narrative_summary").otherwise("speaker_utterance")
    return c.select(F.col("conv_id").cast("string").alias("session"), pos.alias("pos"), F.format_string("b%03d", "turn").alias("block_id"), kind.alias("kind"), normalize_record(F.col("text")).alias("text"))


def _segments(spark, sf_dir):
    """The turns' sentences as they are heard: five seconds each, every seventh word missing, every fifth misspelt."""
    c = table(spark, sf_dir, "conversations").where("role <> 'system'")
    s = c.select("conv_id", "turn", F.posexplode(F.split("text", r"[.\n]+")).alias("n", "s"))
    words = F.filter(F.split(normalize_asr(F.col("s")), " "), lambda w: w != "")
    kept = F.filter(F.transform(words, lambda w, i: F.when(i % 7 == 3, F.lit("")).when((i % 5 == 2) & (F.length(w) > 4), F.concat(F.substring(w, 1, 2), F.substring(w, 4, 50))).otherwise(w)), lambda w: w != "")
    s = s.withColumn("normalized_text", F.array_join(kept, " ")).where("normalized_text <> ''")
    seg = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "n")) - 1
    s = s.select(F.col("conv_id").cast("string").alias("session"), seg.cast("long").alias("seg"), "normalized_text")
    return s.withColumn("start", F.col("seg") * 5.0).withColumn("end", F.col("seg") * 5.0 + 5.0).withColumn("id", F.format_string("asr-%06d", F.col("seg") + 1))


def _bounds(segments) -> DataFrame:
    sizes = segments.groupBy("session").agg((F.count("*") - 1).alias("high"))
    return sizes.select("session", F.lit(1).alias("interval"), F.lit(0).alias("first_pos"), F.lit(1 << 30).alias("past_pos"), F.lit(0).cast("long").alias("low"), "high")


def _candidates(spark, sf_dir):
    segs = written(_segments(spark, sf_dir), "segments")  # read twice: as such and for the bounds
    return A.candidates(_blocks(spark, sf_dir), segs, _bounds(segs))


def soft_coverage(spark, sf_dir):
    return _candidates(spark, sf_dir).select("session", "block", "first", "past", F.round("coverage", 6).alias("coverage"))


def align_score(spark, sf_dir):
    return _candidates(spark, sf_dir).select("session", "block", "first", "past", F.round("score", 6).alias("score"), F.round("ordered", 6).alias("ordered"), F.round("compact", 6).alias("compact"))


def nms(spark, sf_dir):
    return A.suppressed(_candidates(spark, sf_dir)).select("session", "block", "first", "past")


def monotone_path(spark, sf_dir):
    return A.monotone_path(A.suppressed(_candidates(spark, sf_dir))).select("session", "block", "first", "past")


def _overrides(spark, sf_dir):
    """Every fourth conversation's first turn is reviewed: its first two segments, or what there is of them."""
    b = _blocks(spark, sf_dir).where("pos = 1 and cast(session as int) % 4 = 0")
    b = b.join(_segments(spark, sf_dir).groupBy("session").agg(F.max("end").alias("duration")), "session")
    return b.select("session", "block_id", F.lit(5.0).alias("start"), F.least(F.lit(10.0), "duration").alias("end"), F.lit("session_video").alias("time_domain"), F.lit(None).cast("string").alias("precision"), F.lit("reader").alias("reviewer"), F.lit("checked").alias("note"))


def _aligned(spark, sf_dir):
    return A.align(_blocks(spark, sf_dir), _segments(spark, sf_dir), _overrides(spark, sf_dir))


def align(spark, sf_dir):
    """Turns aligned with what was heard of them: one row an entry, with its evidence."""
    e = _aligned(spark, sf_dir)
    return e.select("session", "pos", "block_id", "start", "end", "precision", "confidence", "review_state", "conflict", F.to_json("evidence").alias("evidence"))


def review_queue(spark, sf_dir):
    return A.review_queue(_aligned(spark, sf_dir))


def diagnostics(spark, sf_dir):
    return A.diagnostics(_blocks(spark, sf_dir), _aligned(spark, sf_dir))


def finalize_session(spark, sf_dir):
    """All conversations aligned, published and entered in the manifest: what each run reports, and the state it leaves."""
    b = _blocks(spark, sf_dir).withColumn("page", (F.col("pos") / 4).cast("int") + 1).withColumn("speaker", F.lit(None).cast("string")).withColumn("section_id", F.lit(None).cast("string")).withColumn("section_title", F.lit(None).cast("string"))
    manifest = b.select(F.col("session").alias("session_id"), F.lit("pdf_parsed").alias("status")).distinct()
    done = J.finalised(b, _segments(spark, sf_dir), _overrides(spark, sf_dir), manifest)
    return done.report.join(done.manifest.select(F.col("session_id").alias("session"), "status"), "session")


def window_enum(spark, sf_dir):
    segs = written(_segments(spark, sf_dir), "segments")
    turns = _blocks(spark, sf_dir).where(F.col("kind").isin(A.SPOKEN)).select("session", F.col("pos").alias("block"), tokens(normalize_asr(F.col("text"))).alias("tokens")).join(_bounds(segs).select("session", "low", "high"), "session")
    seeds = turns.select("session", "block", F.least(F.col("block").cast("long") * 2, F.col("high")).alias("seg"), F.lit(1).alias("seed"))
    return R.window_enum(seeds, segs, turns).select("session", F.col("block").cast("long").alias("block"), "first", "past", F.size("heard").cast("long").alias("heard"))


def _moments(spark, sf_dir):
    """Benchmark items as moments on the one page of all documents, which hold passages of them."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.lit(0).alias("page"), F.col("doc_id").alias("sequence"), F.format_string("d%05d", "doc_id").alias("block_id"), F.col("text"))
    m = table(spark, sf_dir, "benchmark").select(F.lit(0).alias("page"), F.col("item_id").alias("moment"), F.col("text").alias("excerpt"), (F.col("item_id") * 10.0).alias("expected_start"), (F.col("item_id") * 10.0 + 5).alias("expected_end"), F.lit(30.0).alias("tolerance"))
    return m, d


def reference_match(spark, sf_dir):
    m, d = _moments(spark, sf_dir)
    return E.reference_match(m, d, ["page"]).select("moment", "block_id", F.round("block_match_score", 4).alias("block_match_score"))


def _evaluated(spark, sf_dir):
    m, d = _moments(spark, sf_dir)
    matched = m.withColumn("block_id", F.format_string("d%05d", F.col("moment") * 7))
    entries = d.where("sequence % 3 <> 0").select("block_id", (F.col("sequence") * 1.5).alias("start"), (F.col("sequence") * 1.5 + 2).alias("end"))
    return E.evaluate(matched, entries)


def evaluation(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("moment", "block_id", "aligned", F.coalesce("range_overlap", F.lit(False)).alias("range_overlap"), "navigation_error_seconds", "pass")


def pass_rate(spark, sf_dir):
    return E.pass_rate(_evaluated(spark, sf_dir))


QUERIES = {f.__name__: f for f in (token_idf, informative_tokens, rare_tokens, posting_votes, exact_coverage, indel_ratio, window_enum, soft_coverage, align_score, nms, monotone_path, align, review_queue, diagnostics, finalize_session, reference_match, evaluation, pass_rate)}

_EVAL = """d AS (SELECT printf('d%05d', doc_id) AS block_id, doc_id * 1.5 AS s, doc_id * 1.5 + 2 AS e FROM documents WHERE text IS NOT NULL AND doc_id % 3 <> 0), m AS (SELECT item_id AS moment, printf('d%05d', item_id * 7) AS block_id, item_id * 10.0 AS es, item_id * 10.0 + 5 AS ee FROM benchmark),
ev AS (SELECT moment, m.block_id, s IS NOT NULL AS aligned, coalesce(s <= ee AND e >= es, false) AS range_overlap, round(greatest(0.0, s - es, es - e), 3) AS navigation_error_seconds, s, e, es, ee FROM m LEFT JOIN d ON m.block_id = d.block_id), evaluated AS (SELECT moment, block_id, aligned, range_overlap, CASE WHEN aligned THEN CAST(navigation_error_seconds AS DOUBLE) END AS navigation_error_seconds, aligned AND (range_overlap OR greatest(0.0, s - es, es - e) <= 30) AS pass FROM ev)"""
_HEARD = f"""said AS (SELECT conv_id, turn, string_split_regex(text, '[.\\n]+') AS p FROM conversations WHERE role <> 'system'), sent AS (SELECT conv_id, turn, generate_subscripts(p, 1) AS n, list_filter(string_split({normalize_asr_sql("unnest(p)")}, ' '), lambda w: w <> '') AS ws FROM said),
kept AS (SELECT conv_id, turn, n, list_filter([CASE WHEN (i - 1) % 7 = 3 THEN '' WHEN (i - 1) % 5 = 2 AND length(ws[i]) > 4 THEN substring(ws[i], 1, 2) || substring(ws[i], 4, 50) ELSE ws[i] END for i in range(1, len(ws) + 1)], lambda w: w <> '') AS k FROM sent),
heard AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, n) - 1 AS seg, len(k) AS n FROM kept WHERE len(k) > 0)"""
ORACLE_SQL = {
    "token_idf": f"WITH {STATS_SQL} SELECT session, token, df, round(idf, 6) AS idf FROM stats",
    "informative_tokens": f"WITH {STATS_SQL} SELECT session, token, df FROM stats WHERE {_INFORMATIVE}",
    "rare_tokens": f"WITH {RARE_SQL} SELECT block, token, rank FROM rare",
    "posting_votes": f"WITH {VOTES_SQL} SELECT block, seg, round(votes, 6) AS votes, seed FROM seeds WHERE seed <= 14",
    "exact_coverage": f"""WITH {VOTES_SQL}, counts AS (SELECT session, seg, t AS token, count(*) AS heard FROM (SELECT session, seg, unnest(toks) AS t FROM docs) GROUP BY 1, 2, 3), tot AS (SELECT session, block, sum(idf * c) AS total FROM q GROUP BY 1, 2)
      SELECT s.block, s.seg, round(sum(q.idf * least(q.c, h.heard)) / any_value(tot.total), 6) AS exact_coverage FROM seeds s JOIN q ON s.session = q.session AND s.block = q.block JOIN counts h ON h.session = s.session AND h.seg = s.seg AND h.token = q.token JOIN tot ON tot.session = s.session AND tot.block = s.block WHERE seed <= 14 GROUP BY s.block, s.seg""",
    "indel_ratio": """WITH RECURSIVE p AS (SELECT n_name, r_name, lower(n_name) AS a, lower(r_name) AS b FROM nation JOIN region ON n_regionkey = r_regionkey),
      dp AS (SELECT n_name, r_name, a, b, 0 AS i, [0 for x in range(0, length(b) + 1)] AS row FROM p UNION ALL
        SELECT n_name, r_name, a, b, i + 1, list_reduce(list_prepend([0], [[j] for j in range(1, length(b) + 1)]), lambda acc, x: list_append(acc, CASE WHEN substring(a, i + 1, 1) = substring(b, CAST(x[1] AS INT), 1) THEN row[x[1]] + 1 ELSE greatest(row[x[1] + 1], acc[len(acc)]) END)) FROM dp WHERE i < length(a))
      SELECT n_name, r_name, round(2 * row[len(row)] / (length(a) + length(b)), 6) AS ratio FROM dp WHERE i = length(a)""",
    "window_enum": f"""WITH {_HEARD}, top AS (SELECT conv_id, max(seg) AS high FROM heard GROUP BY 1), b0 AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS block, len(list_filter(string_split({normalize_asr_sql("text")}, ' '), lambda w: w <> '')) AS size FROM conversations),
      b AS (SELECT b0.conv_id, block, size, high, least(block * 2, high) AS seg FROM b0 JOIN top ON b0.conv_id = top.conv_id WHERE role <> 'system'), st AS (SELECT *, seg - l.lead AS f FROM b, (SELECT unnest([0, 1, 2, 3]) AS lead) l WHERE seg - l.lead >= 0),
      w AS (SELECT st.conv_id, block, f, f + k.k AS past, size, (SELECT sum(n) FROM heard h WHERE h.conv_id = st.conv_id AND h.seg >= f AND h.seg < f + k.k) AS n FROM st, (SELECT unnest(range(1, 21)) AS k) k WHERE f + k.k <= high + 1)
      SELECT DISTINCT CAST(conv_id AS VARCHAR) AS session, block, f AS "first", past, CAST(n AS BIGINT) AS heard FROM w WHERE n BETWEEN greatest(1, floor(size * 0.35)) AND greatest(24, ceil(size * 2.0))""",
    "evaluation": f"WITH {_EVAL} SELECT * FROM evaluated",
    "pass_rate": f"WITH {_EVAL} SELECT count(*) AS sample_count, count(*) FILTER (WHERE pass) AS passed, round(count(*) FILTER (WHERE pass) / count(*), 4) AS pass_rate FROM evaluated",
}
