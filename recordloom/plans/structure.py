"""Queries over the structure of a record, on document lines with forms of a record injected."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import structure as S
from .bindings import LINES_SQL, record_lines, table, turns


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _fold_sql(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def normalize_record_sql(x: str) -> str:
    for wrong, right in T.REPAIRS:
        x = f"replace({x}, {_q(wrong)}, {_q(right)})"
    for _ in range(2):
        x = f"regexp_replace({x}, '([\\p{{L}}\\p{{N}}_])-\\s+([\\p{{L}}\\p{{N}}_])', '\\1-\\2', 'g')"
    x = f"regexp_replace({_fold_sql(x)}, '[^\\p{{L}}\\p{{N}}_\\s-]', ' ', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def normalize_asr_sql(x: str) -> str:
    return f"trim(regexp_replace({_fold_sql(x)}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def _matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_q(pattern)})"


ROLE_SQL = f"CASE WHEN {_matches(chr(116) + 'rim(replace(raw_text, ' + _q('  ') + ', ' + _q(' ') + '))', T.WEEKDAY_HEADER)} THEN 'page_header' WHEN {_matches('raw_text', T.PAGE_NUMBER)} THEN 'page_number' END"
_BARE = f"regexp_replace(raw_text, {_q(T.CONTINUATION_TAIL)}, '')"
HEADING_SQL = f"(({ROLE_SQL}) IS NULL AND length(raw_text) <= 180 AND length(regexp_replace({_BARE}, '\\P{{L}}', '', 'g')) >= 4 AND length(regexp_replace({_BARE}, '\\P{{Lu}}', '', 'g')) >= 0.92 * length(regexp_replace({_BARE}, '\\P{{L}}', '', 'g')))"
SPOKEN_SQL = f"regexp_matches(regexp_extract(raw_text, {_q(T.SPEAKER)}, 2), '\\S')"
SPEAKER_SQL = f"CASE WHEN {SPOKEN_SQL} THEN regexp_extract(raw_text, {_q(T.SPEAKER)}, 1) END"
BODY_SQL = f"CASE WHEN {SPOKEN_SQL} THEN regexp_extract(raw_text, {_q(T.SPEAKER)}, 2) ELSE raw_text END"
KIND_SQL = f"""CASE WHEN role IS NOT NULL THEN 'other' WHEN heading THEN 'heading' WHEN speaker_raw IS NOT NULL THEN 'speaker_utterance'
  WHEN length(regexp_replace({normalize_record_sql("raw_text")}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) <= 1 THEN 'other'
  WHEN {_matches("raw_text", T.VIDEO)} THEN 'video_presentation'
  WHEN {_matches("raw_text", T.CLOCK)} AND {_matches("raw_text", chr(92) + "b(?:At|It was)" + chr(92) + "b")} THEN 'session_clock_anchor'
  WHEN contains(coalesce(before, ''), 'PRAYER') THEN 'prepared_statement'
  WHEN {" OR ".join(f"contains(coalesce(before, ''), {_q(n)})" for n in T.PROCEDURAL)} THEN 'procedural_event'
  ELSE 'narrative_summary' END"""
SLUG_SQL = "coalesce(nullif(substring(trim(regexp_replace(replace(lower(strip_accents(raw_text)), 'ß', 'ss'), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80), ''), 'section')"
TYPED_SQL = f"""{LINES_SQL},
roles AS (SELECT *, {ROLE_SQL} AS role, {HEADING_SQL} AS heading, {SPEAKER_SQL} AS speaker_raw, {BODY_SQL} AS body FROM raw),
titled AS (SELECT *, last_value(CASE WHEN heading THEN raw_text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  last_value(CASE WHEN heading THEN raw_text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_title,
  row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS sequence, row_number() OVER (PARTITION BY doc_id, page ORDER BY seq) AS place FROM roles),
kinds AS (SELECT *, {KIND_SQL} AS kind, printf('j%02d-p%03d-b%03d', doc_id % 100, page, place) AS id FROM titled),
slugs AS (SELECT *, CASE WHEN kind = 'heading' THEN {SLUG_SQL} END AS slug FROM kinds),
nth AS (SELECT *, count(slug) OVER (PARTITION BY doc_id, slug ORDER BY seq) AS n FROM slugs),
typed AS (SELECT *, last_value(CASE WHEN slug IS NOT NULL THEN CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_id FROM nth)"""


def _raw(spark, sf_dir):
    return record_lines(spark, sf_dir)


def typed(spark, sf_dir):
    return S.typed_blocks(_raw(spark, sf_dir), F.col("doc_id") % 100)


def normalize_asr(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_asr(F.col("text")), 256).alias("hash"))


def normalize_journal(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_record(F.col("text")), 256).alias("hash"))


def normalize_both(spark, sf_dir):
    """The record's form once more in the form of speech: hyphens become spaces."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.normalize_record(F.col("text")).alias("text"))
    return d.select("doc_id", F.sha2(T.normalize_asr(F.col("text")), 256).alias("hash"))


def line_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.join_lines(F.col("text")), 256).alias("hash"))


def slugify(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat_ws("  / ", "p_name", "p_type")).alias("slug"))


def speaker_split(spark, sf_dir):
    label = F.when(F.col("role") == "user", "Mr. Reyes").when(F.col("role") == "assistant", "The Chair").otherwise("Atty. Cruz")
    t = turns(spark, sf_dir).withColumn("raw_text", F.concat(label, F.lit(". "), T.join_lines(F.col("text"))))
    return t.select("conv_id", "turn", T.speaker(F.col("raw_text")).alias("speaker"), F.length(T.speech(F.col("raw_text"))).cast("long").alias("chars"))


def heading_filter(spark, sf_dir):
    return _raw(spark, sf_dir).where(T.is_heading(F.col("raw_text"))).select("doc_id", "seq", "raw_text")


def page_roles(spark, sf_dir):
    return _raw(spark, sf_dir).withColumn("role", T.role(F.col("raw_text"))).where("role is not null").groupBy("doc_id", "role").agg(F.count("*").alias("n"))


def classify_blocks(spark, sf_dir):
    return S.classify(_raw(spark, sf_dir)).select("doc_id", "seq", "kind")


def section_fill(spark, sf_dir):
    return S.classify(_raw(spark, sf_dir)).select("doc_id", "seq", "section_title")


def section_ids(spark, sf_dir):
    return S.section_ids(S.classify(_raw(spark, sf_dir))).select("doc_id", "seq", "section_id")


def block_ids(spark, sf_dir):
    return S.block_ids(_raw(spark, sf_dir), F.col("doc_id") % 100).select("doc_id", "seq", F.col("sequence").cast("long").alias("sequence"), "id")


def time_references(spark, sf_dir):
    rows = _raw(spark, sf_dir).select("doc_id", "seq", F.posexplode(T.time_references(F.col("raw_text"))).alias("n", "r"))
    return rows.select("doc_id", "seq", F.col("n").cast("long").alias("n"), "r.*")


def continuations(spark, sf_dir):
    return typed(spark, sf_dir).where("continuation_of is not null").select("doc_id", "id", "continuation_of")


def page_nest(spark, sf_dir):
    nested = S.page_nest(S.block_ids(_raw(spark, sf_dir), F.col("doc_id") % 100), ["sequence", "id"])
    return nested.select("doc_id", "page", F.array_join(F.transform("blocks", lambda b: b["id"]), ",").alias("ids"), F.size("blocks").cast("long").alias("n"))


def _timed(spark, sf_dir):
    """Typed blocks, of which every third has a time."""
    return typed(spark, sf_dir).withColumn("start", F.when(F.col("sequence") % 3 == 0, F.col("sequence") * 10.0))


def section_outline(spark, sf_dir):
    return S.section_outline(_timed(spark, sf_dir))


def markdown_render(spark, sf_dir):
    return S.markdown(typed(spark, sf_dir), "<!-- record -->\n\n").select("doc_id", F.sha2("markdown", 256).alias("hash"), F.length("markdown").cast("long").alias("chars"))


def _blocks(spark, sf_dir):
    """Raw page blocks of three lines each, and some of page artefacts."""
    rows = _raw(spark, sf_dir).withColumn("seq", F.floor((F.col("seq") - 1) / 2) + 1).groupBy("doc_id", "page", "seq")
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("raw_text"))), lambda s: s["raw_text"]), "\n").alias("text"))


def artifact_split(spark, sf_dir):
    return S.split_artifacts(_blocks(spark, sf_dir)).select("doc_id", "page", "seq", F.col("part").cast("long").alias("part"), "raw_text", "role")


def fragment_merge(spark, sf_dir):
    return S.merge_fragments(S.split_artifacts(_blocks(spark, sf_dir))).select("doc_id", "page", "seq", "part", "merged", F.length("raw_text").alias("chars"))


def parse_document(spark, sf_dir):
    """Raw page blocks to typed blocks, all steps."""
    merged = S.merge_fragments(S.split_artifacts(_blocks(spark, sf_dir)))
    merged = merged.withColumn("seq", F.col("seq") * 1000 + F.col("part"))
    return S.typed_blocks(merged, F.col("doc_id") % 100).select("doc_id", "id", "kind", "section_id", "speaker_id", "continuation_of")


def document_characteristics(spark, sf_dir):
    """Of each document: pages, characters, and whether most pages have an image, where one in three lines stands for one."""
    pages = _raw(spark, sf_dir).groupBy("doc_id", "page").agg(F.sum(F.length("raw_text")).alias("chars"), F.count_if(F.col("seq") % 7 == 0).alias("images"))
    return S.characteristics(pages)


QUERIES = {f.__name__: f for f in (normalize_asr, normalize_journal, normalize_both, line_join, slugify, speaker_split, heading_filter, page_roles, classify_blocks, section_fill, section_ids, block_ids, time_references, continuations, page_nest, section_outline, markdown_render, artifact_split, fragment_merge, parse_document, document_characteristics)}

_LINE_JOIN = "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> ''), ' ')"
_TWO = f"""{LINES_SQL}, two AS (SELECT doc_id, page, CAST(floor((seq - 1) / 2) AS BIGINT) + 1 AS seq, string_agg(raw_text, chr(10) ORDER BY raw_text) AS text FROM raw GROUP BY 1, 2, 3),
ls AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS l FROM two),
pieces AS (SELECT doc_id, page, seq, unnest(l) AS raw_text, generate_subscripts(l, 1) - 1 AS part, l FROM ls),
checked AS (SELECT *, {ROLE_SQL} AS role FROM pieces),
every AS (SELECT *, count(*) OVER w AS n, count(role) OVER w AS r FROM checked WINDOW w AS (PARTITION BY doc_id, page, seq)),
parts2 AS (SELECT doc_id, page, seq, CAST(part AS BIGINT) AS part, raw_text FROM every WHERE n > 1 AND n = r UNION ALL SELECT DISTINCT doc_id, page, seq, CAST(0 AS BIGINT), array_to_string(l, ' ') FROM every WHERE NOT (n > 1 AND n = r))"""
_REFS = f"""{LINES_SQL}, m AS (SELECT doc_id, seq, raw_text, {", ".join(f"regexp_extract_all(raw_text, {_q(T.CLOCK)}, {i}) AS g{i}" for i in range(5))}, {_matches("raw_text", T.EXHIBIT_CONTEXT)} AS context, nullif(regexp_replace(regexp_extract(raw_text, {_q(T.EXHIBIT)}, 1), '\\s+', '', 'g'), '') AS exhibit FROM raw),
each AS (SELECT doc_id, seq, context, exhibit, unnest(g0) AS display, unnest(g1) AS h, unnest(g2) AS mi, coalesce(unnest(g3), '') AS s, coalesce(unnest(g4), '') AS ap, generate_subscripts(g0, 1) AS i FROM m),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seq ORDER BY i) - 1 AS n FROM each WHERE ap <> '' OR context)"""

ORACLE_SQL = {
    "normalize_asr": f"SELECT doc_id, sha256({normalize_asr_sql('text')}) AS hash FROM documents",
    "normalize_journal": f"SELECT doc_id, sha256({normalize_record_sql('text')}) AS hash FROM documents",
    "normalize_both": f"SELECT doc_id, sha256({normalize_asr_sql(normalize_record_sql('text'))}) AS hash FROM documents",
    "line_join": f"SELECT doc_id, sha256({_LINE_JOIN}) AS hash FROM documents",
    "slugify": "SELECT p_partkey, coalesce(nullif(substring(trim(regexp_replace(lower(concat_ws('  / ', p_name, p_type)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80), ''), 'section') AS slug FROM part",
    "speaker_split": f"WITH t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Mr. Reyes' WHEN 'assistant' THEN 'The Chair' ELSE 'Atty. Cruz' END || '. ' || {_LINE_JOIN} AS raw_text FROM conversations) SELECT conv_id, turn, {SPEAKER_SQL} AS speaker, length({BODY_SQL}) AS chars FROM t",
    "heading_filter": f"WITH {LINES_SQL} SELECT doc_id, seq, raw_text FROM raw WHERE {HEADING_SQL}",
    "page_roles": f"WITH {LINES_SQL}, r AS (SELECT doc_id, {ROLE_SQL} AS role FROM raw) SELECT doc_id, role, count(*) AS n FROM r WHERE role IS NOT NULL GROUP BY doc_id, role",
    "classify_blocks": f"WITH {TYPED_SQL} SELECT doc_id, seq, kind FROM kinds",
    "section_fill": f"WITH {TYPED_SQL} SELECT doc_id, seq, section_title FROM titled",
    "section_ids": f"WITH {TYPED_SQL} SELECT doc_id, seq, section_id FROM typed",
    "block_ids": f"WITH {TYPED_SQL} SELECT doc_id, seq, sequence, id FROM kinds",
    "time_references": f"""WITH {_REFS} SELECT doc_id, seq, n, CASE WHEN ap <> '' THEN 'wall_clock' ELSE 'exhibit' END AS time_domain, display,
      CASE WHEN ap = '' THEN CASE WHEN s <> '' THEN CAST(h AS INT) * 3600 + CAST(mi AS INT) * 60 + CAST(s AS INT) ELSE CAST(h AS INT) * 60 + CAST(mi AS INT) END END AS time_seconds,
      CASE WHEN ap <> '' THEN (CAST(h AS INT) % 12 + CASE WHEN lower(ap) LIKE 'p%' THEN 12 ELSE 0 END) * 3600 + CAST(mi AS INT) * 60 + coalesce(TRY_CAST(s AS INT), 0) END AS time_seconds_since_midnight,
      CASE WHEN ap = '' THEN exhibit END AS exhibit_id FROM kept""",
    "continuations": f"""WITH {TYPED_SQL}, lasts AS (SELECT *, last_value(CASE WHEN kind <> 'other' THEN struct_pack(id := id, page := page, body := body) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM typed)
      SELECT doc_id, id, p.id AS continuation_of FROM lasts WHERE p.page = page - 1 AND kind NOT IN ('heading', 'other') AND regexp_matches(raw_text, '^\\p{{Ll}}') AND p.body <> '' AND NOT regexp_matches(p.body, '[.?!)\\]”’]$')""",
    "page_nest": f"WITH {TYPED_SQL} SELECT doc_id, page, string_agg(id, ',' ORDER BY sequence) AS ids, count(*) AS n FROM kinds GROUP BY doc_id, page",
    "section_outline": f"""WITH {TYPED_SQL}, timed AS (SELECT *, CASE WHEN sequence % 3 = 0 THEN sequence * 10.0 END AS st FROM typed)
      SELECT doc_id, section_id, arg_min(section_title, sequence) AS title, arg_min(id, sequence) AS first_block_id, arg_min(page, sequence) AS page, CAST(arg_min(st, CASE WHEN st IS NOT NULL THEN sequence END) AS DOUBLE) AS "start" FROM timed WHERE section_id IS NOT NULL GROUP BY doc_id, section_id""",
    "markdown_render": f"""WITH {TYPED_SQL}, md AS (SELECT doc_id, sequence, CASE WHEN place = 1 THEN printf('<!-- page: %d -->', page) || chr(10) || chr(10) ELSE '' END || CASE WHEN kind = 'heading' THEN '## ' || body WHEN speaker_raw IS NOT NULL THEN rtrim('**' || speaker_raw || '.** ' || body) WHEN kind = 'video_presentation' THEN '_' || body || '_' ELSE body END AS t FROM kinds),
      doc AS (SELECT doc_id, regexp_replace('<!-- record -->' || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY sequence), '\\s+$', '') || chr(10) AS m FROM md GROUP BY doc_id) SELECT doc_id, sha256(m) AS hash, length(m) AS chars FROM doc""",
    "artifact_split": f"WITH {_TWO} SELECT doc_id, page, seq, part, raw_text, {ROLE_SQL} AS role FROM parts2",
    "document_characteristics": f"""WITH {LINES_SQL}, p AS (SELECT doc_id, page, sum(length(raw_text)) AS chars, count(*) FILTER (WHERE seq % 7 = 0) AS images FROM raw GROUP BY doc_id, page)
      SELECT doc_id, count(*) AS pages, CAST(sum(images) AS BIGINT) AS images, count(*) FILTER (WHERE images > 0) AS pages_with_images, CAST(sum(chars) AS BIGINT) AS chars, count(*) FILTER (WHERE images > 0) / count(*) >= 0.8 AND sum(chars) > 0 AS image_based FROM p GROUP BY doc_id""",
}
