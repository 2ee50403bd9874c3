"""From raw page blocks to typed blocks of a record, and their rendering.

Rows are (doc_id, page, seq, text, ...). A document is a window partition; pages are, where a rule ends with the page.
Window functions do all but the merging of fragments, whose test is on the text merged so far: it is a fold, which
runs on one page at a time, in Arrow batches of many.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import in_groups


def _doc(*order: str):
    return Window.partitionBy("doc_id").orderBy(*order)


def _so_far(window):
    return window.rowsBetween(Window.unboundedPreceding, 0)


def _earlier(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def split_artifacts(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, seq, part, raw_text, source_text, bbox, role) of raw blocks (doc_id, page, seq, text, perhaps bbox) that are not blank.

    A block of several lines that are all page headers or numbers is a fragment for each; any other is one, its lines
    joined."""
    rows = blocks.withColumn("lines", T.lines(F.col("text"))).where(F.size("lines") > 0)
    artifact = (F.size("lines") > 1) & F.forall("lines", lambda s: T.role(s).isNotNull())
    parts = F.when(artifact, F.transform("lines", lambda s: F.struct(s.alias("raw"), s.alias("source")))).otherwise(F.array(F.struct(F.array_join("lines", " ").alias("raw"), F.regexp_replace("text", r"\n+$", "").alias("source"))))
    box = F.col("bbox") if "bbox" in blocks.columns else F.lit(None).cast("array<double>")
    rows = rows.select("doc_id", "page", "seq", box.alias("bbox"), F.posexplode(parts).alias("part", "x")).select("doc_id", "page", "seq", "part", F.col("x.raw").alias("raw_text"), F.col("x.source").alias("source_text"), "bbox")
    return rows.withColumn("role", T.role(F.col("raw_text")))


# The same tests as in functions.text, for the fold.
_SPEAKER, _CONTINUATION, _TAIL = (re.compile(p) for p in (T.SPEAKER, T.CONTINUATION, T.CONTINUATION_TAIL))
_HEADER, _NUMBER = re.compile(T.WEEKDAY_HEADER), re.compile(T.PAGE_NUMBER)


def _heading(x: str) -> bool:
    if len(x) > 180 or _NUMBER.match(x) or _HEADER.match(x.replace("  ", " ").strip()):
        return False
    letters = [c for c in _TAIL.sub("", x) if c.isalpha()]
    return len(letters) >= 4 and sum(map(str.isupper, letters)) >= 0.92 * len(letters)


def _structural(x: str, role: str | None) -> bool:
    if role or _heading(x) or x.startswith("["):
        return True
    label = _SPEAKER.match(x)
    return bool(label and label.group(2).strip())


def _merges(one: dict, two: dict) -> bool:
    """Whether a page's next fragment continues what has been merged so far."""
    a, b = one["raw_text"], two["raw_text"]
    if _CONTINUATION.match(b) and _heading(a):
        return True
    if _structural(a, one["role"]) or _structural(b, two["role"]) or _CONTINUATION.match(b) or not a:
        return False
    return a[-1] not in T.CLOSERS or b[:1].islower() or b[:1] in ("‘", "’", "“", '"')


def _fold(page: list[dict]) -> list[dict]:
    out: list[dict] = []
    for row in sorted(page, key=lambda r: (r["seq"], r["part"])):
        row |= {"merged": 1, "indexes": [row["seq"]]}
        if out and _merges(out[-1], row):
            last = out[-1]
            last["raw_text"] = f"{last['raw_text']} {row['raw_text']}".strip()
            last["source_text"] += "\n" + row["source_text"]
            last["merged"] += 1
            last["indexes"] += row["indexes"]
            if last["bbox"] and row["bbox"]:
                last["bbox"] = [pick(x, y) for pick, x, y in zip((min, min, max, max), last["bbox"], row["bbox"], strict=True)]
        else:
            out.append(row)
    return out


def merge_fragments(fragments: DataFrame) -> DataFrame:
    """fragments of split_artifacts, those that continue the one before on their page merged into it: merged counts them,
    indexes are their blocks' seq, and bbox is around all of them."""
    schema = "doc_id long, page long, seq long, part int, raw_text string, source_text string, bbox array<double>, role string, merged long, indexes array<long>"
    rows = fragments.select("doc_id", "page", "seq", "part", "raw_text", "source_text", "bbox", "role")
    return in_groups(rows, ["doc_id", "page"], _fold, schema)


def block_ids(rows: DataFrame, number: Column) -> DataFrame:
    """rows with sequence in the document and id: journal number, page, and place on the page."""
    on_page = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("seq"))
    return rows.withColumn("sequence", F.row_number().over(_doc("seq"))).withColumn("id", F.format_string("j%02d-p%03d-b%03d", number, F.col("page"), on_page))


def classify(rows: DataFrame) -> DataFrame:
    """rows with role, kind and section_title; a block's kind is decided under the heading before it."""
    rows = rows.withColumn("role", T.role(F.col("raw_text")))
    title = F.when(T.is_heading(F.col("raw_text")) & F.col("role").isNull(), F.col("raw_text"))
    rows = rows.withColumn("__title", title)
    rows = rows.withColumn("__before", F.last("__title", ignorenulls=True).over(_earlier(_doc("seq"))))
    rows = rows.withColumn("kind", T.kind(F.col("raw_text"), F.col("role"), F.coalesce("__before", F.lit(""))))
    return rows.withColumn("section_title", F.last("__title", ignorenulls=True).over(_so_far(_doc("seq")))).drop("__title", "__before")


def section_ids(rows: DataFrame) -> DataFrame:
    """classified rows with section_id: the title's slug, from its second heading on with the ordinal."""
    slug = F.when(F.col("kind") == "heading", T.slug(F.col("raw_text")))
    rows = rows.withColumn("__slug", slug)
    nth = F.count("__slug").over(_so_far(Window.partitionBy("doc_id", "__slug").orderBy("seq")))
    own = F.when(F.col("__slug").isNotNull(), F.when(nth == 1, F.col("__slug")).otherwise(F.concat_ws("-", "__slug", nth.cast("string"))))
    rows = rows.withColumn("__id", own)
    return rows.withColumn("section_id", F.last("__id", ignorenulls=True).over(_so_far(_doc("seq")))).drop("__slug", "__id")


def spoken(rows: DataFrame) -> DataFrame:
    """rows with speaker_raw, speaker_id, body, normalized_text, time_references and features."""
    x = F.col("raw_text")
    rows = rows.withColumn("speaker_raw", T.speaker(x)).withColumn("body", T.speech(x))
    rows = rows.withColumn("speaker_id", F.when(F.col("speaker_raw").isNotNull(), T.slug(F.col("speaker_raw")))).withColumn("normalized_text", T.normalize_record(F.col("body")))
    rows = rows.withColumn("time_references", T.time_references(x))
    return rows.withColumn("features", F.when(F.exists("time_references", lambda r: r["time_domain"] == "exhibit"), F.array(F.lit("exhibit_timestamp"))))


def continuations(rows: DataFrame) -> DataFrame:
    """typed rows (id, body, kind) with continuation_of: the last substantive block, if it is on the page before, does
    not end its sentence, and this one goes on in lower case."""
    last = F.last(F.when(F.col("kind") != "other", F.struct("id", "page", "body")), ignorenulls=True).over(_earlier(_doc("seq")))
    rows = rows.withColumn("__last", last)
    goes_on = (F.col("__last.page") == F.col("page") - 1) & ~F.col("kind").isin("heading", "other") & F.rlike("raw_text", F.lit(r"^\p{Ll}")) & (F.col("__last.body") != "") & ~F.rlike("__last.body", F.lit(r"[.?!)\]”’]$"))
    return rows.withColumn("continuation_of", F.when(goes_on, F.col("__last.id"))).drop("__last")


def typed_blocks(rows: DataFrame, number: Column) -> DataFrame:
    """All of the above on merged fragments (doc_id, page, seq, raw_text)."""
    return continuations(spoken(section_ids(classify(block_ids(rows, number)))))


def page_nest(blocks: DataFrame, fields: list[str]) -> DataFrame:
    """(doc_id, page, blocks): the fields of a page's blocks in order."""
    return blocks.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("sequence", *[f for f in fields if f != "sequence"]))).alias("blocks"))


def section_outline(blocks: DataFrame) -> DataFrame:
    """(doc_id, section_id, title, first_block_id, page, start) of each section: start is its first timed block's."""
    first = lambda c: F.min_by(c, "sequence")
    timed = F.when(F.col("start").isNotNull(), F.col("sequence"))
    out = blocks.where("section_id is not null").groupBy("doc_id", "section_id")
    title = F.coalesce(first(F.coalesce("section_title", F.lit(""))), F.lit(""))
    return out.agg(title.alias("title"), first("id").alias("first_block_id"), first("page").alias("page"), F.min_by("start", timed).alias("start")).withColumn("title", F.when(F.col("title") == "", F.initcap(F.replace("section_id", F.lit("-"), F.lit(" ")))).otherwise(F.col("title")))


def block_markdown() -> Column:
    """A typed block as Markdown."""
    said = F.regexp_replace(F.concat(F.lit("**"), "speaker_raw", F.lit(".** "), "body"), r"\s+$", "")
    return F.when(F.col("kind") == "heading", F.concat(F.lit("## "), "body")).when(F.col("speaker_raw").isNotNull(), said).when(F.col("kind") == "video_presentation", F.concat(F.lit("_"), "body", F.lit("_"))).otherwise(F.col("body"))


def markdown(blocks: DataFrame, head: str = "") -> DataFrame:
    """(doc_id, markdown): head, then all blocks in order, each page under its mark."""
    first = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("sequence")) == 1
    text = F.concat(F.when(first, F.format_string("<!-- page: %d -->\n\n", "page")).otherwise(""), block_markdown())
    parts = blocks.select("doc_id", F.struct("sequence", text.alias("t")).alias("part"))
    whole = F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda s: s["t"]), "\n\n"))
    return parts.groupBy("doc_id").agg(F.concat(F.regexp_replace(whole, r"\s+$", ""), F.lit("\n")).alias("markdown"))


def characteristics(pages: DataFrame) -> DataFrame:
    """Of each document of pages (doc_id, chars, images): pages, images, characters, and whether it looks like scanned
    pages behind recognised text: four fifths of its pages have an image, and there is text."""
    out = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("images").alias("images"), F.count_if(F.col("images") > 0).alias("pages_with_images"), F.sum("chars").alias("chars"))
    return out.withColumn("image_based", (F.col("pages_with_images") / F.col("pages") >= 0.8) & (F.col("chars") > 0))
