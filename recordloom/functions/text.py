r"""Text functions of the record: folding, normalising, speakers, headings, clocks and block kinds.

Everything but the folding of unusual characters is built-in. Word characters are [\p{L}\p{N}_], which is what the rules
mean by \w; white space is what Unicode calls so.
"""

from __future__ import annotations

import unicodedata
from functools import cache
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import with_package

# Patterns, replacements and names that decide the results.
WEEKDAY_HEADER = r"^(?:MONDAY|TUESDAY|WEDNESDAY|THURSDAY|FRIDAY),\s+[A-Z]+\s+[0-9]{1,2},?\s*[0-9]{4}$"
PAGE_NUMBER = r"^[0-9]{1,3}$"
CONTINUATION = r"(?i)^[{(\[]\s*continuation\s*[)}\]]$"
CONTINUATION_TAIL = r"(?i)\s+[{(\[]\s*continuation.*$"
SPEAKER = (
    r"(?i)^(The Presiding Officer|The Chair|"
    r"(?:Senator-Judge|Senator|Senate President|Representative|Presiding Officer|Justice)\s+[^.]{1,90}|"
    r"(?:Mr|Ms|Mrs|Atty|Attys|Sen|Rep)\s*[.,]\s*[^.]{1,80})"
    r"\.\s*(.*)$"
)
EXHIBIT = r"(?i)\bExhibit\s+[“\"']?([A-Z0-9]+(?:\s*-\s*[A-Z0-9]+)+|[A-Z0-9]+)"
CLOCK = r"(?i)\b([0-9]{1,2}):([0-5][0-9])(?::([0-5][0-9]))?\s*([ap]\.?m\.?)?"
EXHIBIT_CONTEXT = r"(?i)\b(?:timestamp|video|exhibit)\b"
VIDEO = r"(?i)^\[\s*Video presentation\s*\]$"
REPAIRS = [("­", ""), ("ﬁ", "fi"), ("ﬂ", "fl"), ("PRESH)ING", "PRESIDING"), ("P ANGELIN AN", "PANGILINAN"), ("Wimess", "Witness"), ("wimess", "witness")]
PROCEDURAL = ["CALL TO ORDER", "PROCLAMATION", "ROLL CALL", "APPROVAL OF THE JOURNAL", "CALLING OF THE CASE", "APPEARANCES", "SUSPENSION", "RESUMPTION", "ADJOURNMENT", "ORDER OF THE PRESIDING OFFICER"]
CLOSERS = ".?!)]”’"

SPACE = r"[\s\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ASCII = r"^\p{ASCII}*$"


@cache
def _plain_chars() -> str:
    """The characters of Latin, Greek and Cyrillic text and its punctuation beyond ASCII that NFKC leaves alone, wherever
    they stand, and whose case is folded by lower(), but for sharp s, as ranges of a pattern."""
    blocks = [*range(0x80, 0x250), *range(0x370, 0x530), *range(0x2010, 0x2040)]
    fits = [c for c in blocks if unicodedata.category(s := chr(c))[0] not in "MC" and unicodedata.normalize("NFKC", s) == s and (s == "ß" or s.casefold() == s.lower() and len(s.lower()) == 1) and s != "Σ"]
    runs = [[c for _, c in run] for _, run in groupby(enumerate(fits), lambda x: x[1] - x[0])]
    return "".join(rf"\x{{{r[0]:X}}}-\x{{{r[-1]:X}}}" for r in runs)


_CHANGES = {
    "nfkc": lambda s: unicodedata.normalize("NFKC", s),
    "casefold": str.casefold,
    "folded": lambda s: unicodedata.normalize("NFKC", s).casefold(),
    "plain": lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold(),
}


@cache
def _python_text(name: str):
    """A Python text function on columns; made when first used, as there is no session on import."""
    change = _CHANGES[name]

    @F.pandas_udf("string")
    def own(x: pd.Series) -> pd.Series:
        return x.map(change, na_action="ignore")

    return own


def _unless(plain: Column, x: Column, name: str, plain_form: Column) -> Column:
    """plain_form where plain holds; only the other strings are sent to Python, a thousand at a time."""
    if found := SparkSession.getActiveSession():
        with_package(found)
    return F.coalesce(_python_text(name)(F.when(~plain, x)), plain_form)


def _plain(x: Column) -> Column:
    return ~F.rlike(x, F.lit(rf"[[^\x00-\x7F]&&[^{_plain_chars()}]]"))


def _lower(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def nfkc(x: Column) -> Column:
    return _unless(_plain(x), x, "nfkc", x)


def casefold(x: Column) -> Column:
    return _unless(_plain(x), x, "casefold", _lower(x))


def collapse(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, SPACE + "+", " "))


def normalize_asr(x: Column) -> Column:
    """For matching speech: folded, anything but word characters is one space. x is evaluated for each of its uses here:
    make it a column first, if it isn't one."""
    return F.trim(F.regexp_replace(_unless(_plain(x), x, "folded", _lower(x)), r"[^\p{L}\p{N}_]+", " "))


def normalize_record(x: Column) -> Column:
    """For matching the record: known misreadings repaired, words broken at a hyphen joined, folded; hyphens stay. x is as
    in normalize_asr."""
    plain = _plain(x)  # so are the repaired texts of plain ones
    x = _unless(plain, x, "nfkc", x)
    for wrong, right in REPAIRS:
        x = F.replace(x, F.lit(wrong), F.lit(right))
    x = F.regexp_replace(x, rf"(?<=[\p{{L}}\p{{N}}_])-{SPACE}+(?=[\p{{L}}\p{{N}}_])", "-")
    return collapse(F.regexp_replace(_unless(plain, x, "casefold", _lower(x)), r"[^\p{L}\p{N}_\s-]", " "))


def tokens(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda t: t != "")


def lines(x: Column) -> Column:
    """Stripped lines that are not blank."""
    edge = f"^{SPACE}+|{SPACE}+$"
    found = F.transform(F.split(x, r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"), lambda s: F.regexp_replace(s, edge, ""))
    return F.filter(found, lambda s: s != "")


def join_lines(x: Column) -> Column:
    """Stripped lines that are not blank, joined by one space."""
    return F.array_join(lines(x), " ")


def slug(x: Column) -> Column:
    """Without accents, folded, words joined by hyphens, 80 characters at most; "section" if nothing is left."""
    x = _unless(F.rlike(x, F.lit(_ASCII)), x, "plain", F.lower(x))
    x = F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(x, 1, 80), F.lit("")), F.lit("section"))


def is_page_header(x: Column) -> Column:
    return F.rlike(F.trim(F.replace(x, F.lit("  "), F.lit(" "))), F.lit(WEEKDAY_HEADER))


def role(x: Column) -> Column:
    """page_header, page_number or null."""
    return F.when(is_page_header(x), "page_header").when(F.rlike(x, F.lit(PAGE_NUMBER)), "page_number")


def is_heading(x: Column) -> Column:
    """At least four letters, 92 % of them upper case, of 180 characters at most; a continuation mark does not count."""
    text = F.regexp_replace(x, CONTINUATION_TAIL, "")
    letters, upper = F.length(F.regexp_replace(text, r"\P{L}", "")), F.length(F.regexp_replace(text, r"\P{Lu}", ""))
    return role(x).isNull() & (F.length(x) <= 180) & (letters >= 4) & (upper >= 0.92 * letters)


def speaker(x: Column) -> Column:
    """The speaker's label, null where no speech follows it."""
    return F.when(F.rlike(F.regexp_extract(x, SPEAKER, 2), F.lit(r"\S")), F.regexp_extract(x, SPEAKER, 1))


def speech(x: Column) -> Column:
    """What is said, without the speaker's label."""
    return F.when(speaker(x).isNotNull(), F.regexp_extract(x, SPEAKER, 2)).otherwise(x)


def time_references(x: Column) -> Column:
    """Clock times in order: on the wall with am or pm; else, in the context of an exhibit, within it; others are none."""
    group = lambda i: F.regexp_extract_all(x, F.lit(CLOCK), F.lit(i))
    zipped = F.arrays_zip(*[group(i).alias(f"g{i}") for i in range(5)])
    named = F.regexp_extract(x, EXHIBIT, 1)
    exhibit = F.when(named != "", F.regexp_replace(named, r"\s+", ""))

    def one(m: Column) -> Column:
        hour, minute = m["g1"].cast("int"), m["g2"].cast("int")
        second = F.coalesce(F.nullif(m["g3"], F.lit("")).cast("int"), F.lit(0))
        wall = m["g4"] != ""
        day = (hour % 12 + F.when(F.lower(m["g4"]).startswith("p"), 12).otherwise(0)) * 3600 + minute * 60 + second
        inside = F.when(m["g3"] != "", hour * 3600 + minute * 60 + second).otherwise(hour * 60 + minute)
        return F.struct(F.when(wall, "wall_clock").otherwise("exhibit").alias("time_domain"), m["g0"].alias("display"), F.when(~wall, inside).alias("time_seconds"), F.when(wall, day).alias("time_seconds_since_midnight"), F.when(~wall, exhibit).alias("exhibit_id"))

    context = F.rlike(x, F.lit(EXHIBIT_CONTEXT))
    return F.transform(F.filter(zipped, lambda m: (m["g4"] != "") | context), one)


def kind(x: Column, own_role: Column, section: Column) -> Column:
    """The kind of a block whose text is x, under the section title that stands before it."""
    said = F.length(F.regexp_replace(normalize_record(x), r"[^\p{L}\p{N}]", ""))
    procedural = F.lit(False)
    for name in PROCEDURAL:
        procedural = procedural | F.contains(section, F.lit(name))
    return (
        F.when(own_role.isNotNull(), "other")
        .when(is_heading(x), "heading")
        .when(speaker(x).isNotNull(), "speaker_utterance")
        .when(said <= 1, "other")
        .when(F.rlike(x, F.lit(VIDEO)), "video_presentation")
        .when(F.rlike(x, F.lit(CLOCK)) & F.rlike(x, F.lit(r"\b(?:At|It was)\b")), "session_clock_anchor")
        .when(F.contains(section, F.lit("PRAYER")), "prepared_statement")
        .when(procedural, "procedural_event")
        .otherwise("narrative_summary")
    )


def format_time(seconds: Column) -> Column:
    """h:mm:ss, or m:ss under an hour, of whole seconds from 0."""
    s = F.floor(F.greatest(seconds, F.lit(0))).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def precision_rank(x: Column) -> Column:
    return F.when(F.contains(x, F.lit("dialogue")), 3).when(F.contains(x, F.lit("section")), 1).otherwise(2)


def url_state(url: Column) -> Column:
    """(block, t) of a page address: t is null unless finite and from 0; an empty t is 0."""
    raw = F.try_parse_url(url, F.lit("QUERY"), F.lit("t"))
    t = F.when(F.trim(raw) == "", 0.0).otherwise(raw.try_cast("double"))
    return F.struct(F.try_parse_url(url, F.lit("QUERY"), F.lit("block")).alias("block"), F.when((t >= 0) & (t < float("inf")), t).alias("t"))
