r"""Personal data: candidate spans, scored by boosted trees on their format and context. Built-in functions only.

Base rules find e-mail addresses, IPv4 addresses, payment cards and international phone numbers, whose spans always
stand. Generators with a higher recall propose further spans of the four kinds (numbers without a country code,
written-out at and dot, bracketed dots, cards of other lengths) and secrets (long runs such as keys and tokens); trees
score them, and those at or above the calibrated threshold are added, where they overlap no base span; of a chain of
overlapping ones the best is.

The trees learn from the corpus itself: what base rules find in a bounded sample of documents is personal, and is
rewritten into the wider forms where it stands; what the generators propose there besides is not, unless trees trained
without it think it personal. Seeds, a few rows of each form, stand in for what a corpus may not hold.

Base patterns are those of the contract in a form that Java matches in linear time and without recursion: a run of
characters is tried from its begin only (or from where the last match ended, \G), and loops are possessive where what
follows them cannot match inside them.
"""

from __future__ import annotations

import json
import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import boost
from .common import written

KINDS = ["email", "ip", "card", "phone", "secret"]
#: kind -> (a cheap test that a text may match, pattern)
BASE = {
    "email": (F.contains, "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (F.rlike, r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    # a run of 14 digits or more; shorter ones fail in any case
    "card": (F.rlike, r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9]){13,}+"),
    "phone": (F.contains, "+", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
WIDER = {
    "email": (F.rlike, r"(?i)[\[(](?:at|dot)[\])]|@\x20|\x20@", r"(?i)[A-Z0-9._%+-]{1,64}+\x20?(?:@|\[at\]|\(at\))\x20?[A-Z0-9-]{1,63}+(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Z0-9-]{2,63}+){1,8}+"),
    "ip": (F.rlike, r"[0-9][\[(.]{1,2}[0-9.]", r"(?<![0-9])[0-9]{1,3}+(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}+){3}+"),
    "card": (F.rlike, r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){12,18}+(?![0-9])"),
    "phone": (F.rlike, r"[0-9]{2}[)\x20./-][\x20(]?[0-9]{2}", r"(?<![0-9.,])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,4}\)?){1,5}+(?![0-9])"),
    # with a digit; the test fails at once inside a word
    "secret": (F.rlike, r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16}", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,256}+={0,2}+(?![A-Za-z0-9+/_=-])"),
}
BEFORE, AFTER = 24, 2
#: Documents that examples are taken from, about, and examples of a kind and label at most.
SAMPLE, MOST = 5000, 400
#: Times that a word has to come before candidates for the trees to learn from it.
SEEN = 8
FEATURES = ["kind", "digits", "chars", "separators", "kinds_of", "luhn", "parts", "plus", "paren", "word", "glued_before", "glued_after", "written_out", "groups", "first_len", "last_len", "year", "upper", "distinct", "hex", "assigned"]


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes."""
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    total = F.aggregate(F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), value), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def _found(kind: str, base: bool) -> Column:
    """All matches of a pattern in text, with the characters since the last one, and what stands around them."""
    test, sign, pattern = (BASE if base else WIDER)[kind]
    hits, gaps = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.split("text", pattern, -1)
    rows = F.transform(F.arrays_zip(hits.alias("hit"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), F.slice(gaps, F.lit(2), F.size(hits)).alias("next")), lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.lit(base).alias("base"), F.length(x["gap"]).alias("gap"), x["hit"].alias("hit"), F.right(x["gap"], F.lit(BEFORE)).alias("before"), F.left(x["next"], F.lit(AFTER)).alias("after")))
    none = F.array().cast("array<struct<kind:int,base:boolean,gap:int,hit:string,before:string,after:string>>")
    return F.when(test(F.col("text"), F.lit(sign)), rows).otherwise(none)


def _lists() -> Column:
    return F.concat(*[_found(k, True) for k in BASE], *[_found(k, False) for k in WIDER])


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep of docs (row, text, ...) for every match, base and wider ones of all kinds, in n's order."""
    return docs.select(*keep, F.posexplode(_lists()).alias("n", "x")).select(*keep, "n", "x.*")


def placed(found: DataFrame) -> DataFrame:
    """found with start and end in characters."""
    order = Window.partitionBy("row", "kind", "base").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("hit")).over(order)
    return found.withColumn("end", end).withColumn("start", F.col("end") - F.length("hit")).drop("gap", "n")


def passing(found: DataFrame) -> DataFrame:
    """found with digits, and without the base matches that fail their kind's test."""
    found = found.withColumn("digit", F.regexp_replace("hit", r"[^0-9]", ""))
    small = F.forall(F.split(F.regexp_replace("hit", r"[^0-9.]", ""), r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))), -3, 3).cast("int"), F.lit(0)) <= 255))
    n = F.length("digit")
    # only strings of a card's length are summed up
    checked = luhn(F.when(n.between(13, 19), F.col("digit")).otherwise("0")) & n.between(13, 19)
    found = found.withColumn("small", (F.col("kind") == 1) & small).withColumn("luhn", checked.cast("int"))
    fine = F.when(F.col("kind") == 1, F.col("small")).when(F.col("kind") == 2, n.between(14, 19) & (F.col("luhn") == 1)).when(F.col("kind") == 3, n.between(10, 15)).otherwise(True)
    return found.where(~F.col("base") | fine)


def features(found: DataFrame, words: dict[str, int] | None = None) -> DataFrame:
    """found with FEATURES as integers; words has what was learned of the words that come before, by kind and word."""
    separators = F.regexp_replace("hit", r"[A-Za-z0-9]", "")
    groups = F.regexp_extract_all("hit", F.lit(r"[0-9]+"), F.lit(0))
    cols = {
        "digits": F.length("digit"), "chars": F.length("hit"), "separators": F.length(separators), "kinds_of": F.size(F.array_distinct(F.split(separators, ""))), "parts": F.col("small"),
        "plus": F.rlike("hit", F.lit(r"^(?:\+|00)")), "paren": F.contains("hit", F.lit("(")), "word": _learned(words or {}),
        "glued_before": F.rlike("before", F.lit(r"[A-Za-z0-9_/=:#.,-]$")), "glued_after": F.rlike("after", F.lit(r"^(?:[A-Za-z0-9_/=:#%-]|[.,][0-9])")), "written_out": F.rlike("hit", F.lit(r"(?i)[\[(](?:at|dot|\.)[\])]")),
        "groups": F.size(groups), "first_len": F.length(F.try_element_at(groups, F.lit(1))), "last_len": F.length(F.try_element_at(groups, F.lit(-1))), "year": F.rlike("hit", F.lit(r"^(?:19|20)[0-9]{2}[^0-9]|[^0-9](?:19|20)[0-9]{2}$")),
        "upper": F.length(F.regexp_replace("hit", r"[^A-Z]", "")), "distinct": F.size(F.array_distinct(F.split("hit", ""))), "hex": F.rlike("hit", F.lit(r"^(?:[0-9a-f]+|[0-9A-F]+)$")), "assigned": F.rlike("before", F.lit(r"[=:]\s?[\"']?$")),
    }
    for name, c in cols.items():
        found = found.withColumn(name, F.coalesce(c.cast("int"), F.lit(0)))
    return found


def _word() -> Column:
    """The kind, and the last word before."""
    return F.concat_ws(" ", F.col("kind").cast("string"), F.lower(F.regexp_extract("before", r"(\p{L}+)[^\p{L}]*$", 1)))


def _learned(words: dict[str, int]) -> Column:
    if not words:
        return F.lit(0)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), _word())


def seeds(n: int = 12, seed: int = 7) -> list[dict]:
    """Labelled rows, n of each form: kind, text, and whether its first wider match of that kind is personal."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card(k: int, sep: str, valid: bool) -> str:
        body = d(k - 1)
        total = sum(x if i % 2 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(body))))
        last = (-total) % 10
        full = body + str(last if valid else (last + r.randint(1, 9)) % 10)
        return sep.join(full[i : i + 4] for i in range(0, k, 4)) if sep else full

    part = lambda: str(r.randint(0, 255))
    key = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvw") for _ in range(r.randint(3, 9)))
    forms = [
        ("phone", True, lambda: f"{r.choice(['call', 'phone:', 'tel.', 'fax', 'mobile', 'dial'])} ({d(3)}) {d(3)}-{d(4)}"),
        ("phone", True, lambda: f"{word()} ({d(3)}) {d(3)}-{d(4)} {word()}"),
        ("phone", True, lambda: f"{r.choice(['call', 'tel', 'phone', 'reach me by phone'])} {d(3)}-{d(3)}-{d(4)}"),
        ("phone", True, lambda: f"{r.choice(['tel.', 'phone'])} 0{d(2)} {d(4)} {d(4)}"),
        ("phone", True, lambda: f"{r.choice(['call', 'fax'])} 00{d(2)} {d(2)} {d(4)} {d(2)}"),
        ("phone", False, lambda: f"{word()} 20{d(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)} {word()}"),
        ("phone", False, lambda: f"{r.choice(['on', 'date', word()])} {r.randint(10, 28)}.{r.randint(10, 12)}.20{d(2)} {word()}"),
        ("phone", False, lambda: f"{r.choice(['order', 'invoice', 'serial', word()])} {d(4)}-{d(4)} {word()}"),
        ("phone", False, lambda: f"isbn 978-{d(1)}-{d(2)}-{d(4)}-{d(1)}"),
        ("phone", False, lambda: f"{r.choice(['price', word()])} {d(3)} {d(3)} {r.choice(['eur', word()])}"),
        ("phone", False, lambda: f"{word()} {r.randint(10, 99)} {d(2)} {word()}"),
        ("phone", False, lambda: f"{r.choice(['ratio', 'size', word()])} {d(2)}/{d(2)} {word()}"),
        ("phone", False, lambda: f"version {r.randint(10, 20)}.{d(2)}.{d(3)} {word()}"),
        ("card", True, lambda: f"{r.choice(['card', 'visa', 'credit card', 'pay by'])} {card(13, '', True)}"),
        ("card", True, lambda: f"{r.choice(['card', word(), word()])} {card(16, '.', True)} {word()}"),
        ("card", True, lambda: f"{r.choice(['card', 'visa', 'credit card'])} {card(r.choice([15, 16]), r.choice(['', ' ']), False)}"),
        ("card", False, lambda: f"{r.choice(['serial', 'order', 'id:', word()])} {card(r.choice([13, 14, 15, 16]), '', False)} {word()}"),
        ("card", False, lambda: f"{word()} {card(r.choice([17, 18, 19]), '', False)} {word()}"),
        ("card", False, lambda: f"isbn 978-{d(1)}-{d(2)}-{d(6)}-{d(1)}"),
        ("ip", True, lambda: f"{r.choice(['ip', 'host', 'from', 'server', word()])} {part()}[.]{part()}[.]{part()}[.]{part()}"),
        ("ip", True, lambda: f"{r.choice(['ip', 'from', word()])} {part()}(.){part()}(.){part()}(.){part()} {word()}"),
        ("ip", False, lambda: f"{r.choice(['version', 'section', 'build', word()])} {r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(256, 999)}.{r.randint(0, 9)}"),
        ("ip", False, lambda: f"{word()} {r.randint(300, 999)}.{d(3)}.{r.randint(300, 999)}.{d(2)} {word()}"),
        ("email", True, lambda: f"{r.choice(['mail', 'contact', word()])} {word()}.{word()}[at]{word()}[dot]{r.choice(['com', 'org', 'net'])}"),
        ("email", True, lambda: f"{r.choice(['mail', 'write', word()])} {word()} (at) {word()} (dot) {r.choice(['com', 'org', 'de'])}"),
        ("email", True, lambda: f"{r.choice(['mail', word()])} {word()}@{word()}[dot]{r.choice(['com', 'org'])}"),
        ("email", False, lambda: f"{word()} {d(1)} @ {d(2)}.{d(2)} {word()}"),
        ("email", False, lambda: f"{word()} @ {word()} . {word().capitalize()} {word()}"),
        ("secret", True, lambda: f"{word()} = \"{key('0123456789abcdef', r.choice([32, 40, 64]))}\""),
        ("secret", True, lambda: f"{word()}: {key('0123456789ABCDEF', r.choice([32, 40]))} {word()}"),
        ("secret", True, lambda: f"{r.choice(['token', 'key', 'secret', word()])} {key(letters, r.randint(24, 48))} {word()}"),
        ("secret", True, lambda: f"{word()}={key(letters, r.randint(20, 44))}"),
        ("secret", False, lambda: f"{word()} {''.join(word() for _ in range(4))[:r.randint(16, 30)]:x<16} {word()}"),
        ("secret", False, lambda: f"{word()} {'-'.join(word() for _ in range(r.randint(3, 5)))}-{word()} {word()}"),
        ("secret", False, lambda: f"{word()}/{'/'.join(word() for _ in range(r.randint(3, 5)))}/{word()}"),
        ("secret", False, lambda: f"{word()} {'_'.join(word().upper() for _ in range(r.randint(3, 5)))} = {d(2)}"),
        ("secret", False, lambda: f"{word()} {r.choice('-_=x0') * r.randint(20, 60)} {word()}"),
        ("secret", False, lambda: f"{word()} {d(r.randint(20, 40))} {word()}"),
    ]
    out = [{"kind": KINDS.index(k), "y": int(y), "text": make()} for k, y, make in forms for _ in range(n)]
    r.shuffle(out)
    return out


def _choice(*forms: Column) -> Column:
    """One of the forms, by the hash of what stands there."""
    out, pick = forms[-1], F.pmod(F.xxhash64("hit", "before"), F.lit(len(forms)))
    for i, form in enumerate(forms[:-1]):
        out = F.when(pick == i, form).otherwise(out)
    return out


def rewritten() -> Column:
    """A base match in a form that only the wider generators find."""
    hit, digits = F.col("hit"), F.regexp_replace("hit", r"[^0-9]", "")
    at = lambda a, d: F.regexp_replace(F.regexp_replace(hit, "@", a), r"\.(?=[A-Za-z0-9-]+$)", d)
    email = _choice(at("[at]", "[dot]"), at(" (at) ", " (dot) "), at("@", "[dot]"), at(" [at] ", " [dot] "))
    ip = _choice(F.regexp_replace(hit, r"\.", "[.]"), F.regexp_replace(hit, r"\.", "(.)"))
    card = F.regexp_replace(digits, r"([0-9]{4})(?=[0-9])", r"$1.")
    national = F.regexp_replace(hit, r"^\+[0-9]{1,3}[\x20.-]*", "")
    phone = _choice(F.regexp_replace(hit, r"^\+", "00"), national, F.regexp_replace(national, r"[()]", ""))
    return F.when(F.col("kind") == 0, email).when(F.col("kind") == 1, ip).when(F.col("kind") == 2, card).otherwise(phone)


def examples(docs: DataFrame, sample: int = SAMPLE, most: int = MOST) -> DataFrame:
    """(kind, y, at, text) from about sample documents of docs, most of each kind and label: y is 1 for base matches,
    rewritten where they stand, and 0 for wider matches that overlap none; at is where in text the match begins."""
    part = min(1.0, sample / max(docs.count(), 1))
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(part * (1 << 20))).withColumn("row", F.monotonically_increasing_id())
    found = written(passing(placed(candidates(some, ["row"]))).select("row", "kind", "base", "start", "end", "before", "hit", "after"), "candidates")
    base = found.where("base").groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    other = found.where("not base").join(base, "row", "left").where(~F.coalesce(F.exists("spans", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start"))), F.lit(False)))
    rows = found.where("base").withColumn("hit", rewritten()).select("kind", F.lit(1).alias("y"), "before", "hit", "after").union(other.select("kind", F.lit(0), "before", "hit", "after"))
    rows = rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy("kind", "y").orderBy(F.xxhash64("before", "hit", "after"), "before", "hit", "after"))).where(F.col("n") <= most)
    return rows.select("kind", "y", F.length("before").alias("at"), F.concat("before", "hit", "after").alias("text"))


def model(docs: DataFrame, sample: int = SAMPLE, most: int = MOST, n: int = 12, seed: int = 7) -> tuple[boost.Boosted, dict[str, int]]:
    """Trees, and what was learned of the words before, from examples(docs) and n seeds of each form: a bounded number
    of rows, which Spark prepares as any others."""
    spark = docs.sparkSession
    given = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(seeds(n, seed))), "array<struct<kind:int,y:int,text:string>>")).alias("x")).select("x.kind", "x.y", F.lit(-1).alias("at"), "x.text")
    given = written(given.union(examples(docs, sample, most)).withColumn("row", F.monotonically_increasing_id()), "examples")
    rows = given.select("row", "text", F.col("kind").alias("asked"), "y", "at", F.xxhash64("text", "kind", "at").alias("h"))
    found = passing(placed(candidates(rows, ["row", "asked", "y", "at", "h"])).where(~F.col("base") & (F.col("kind") == F.col("asked")) & ((F.col("at") < 0) | (F.col("at") == F.col("start")))))
    table = features(found).groupBy("row", "y", "at", "h").agg(F.min_by(F.struct(F.array(*FEATURES).alias("x"), _word().alias("word")), "start").alias("z")).orderBy("h", "y").collect()
    x, y, own = np.array([r["z"]["x"] for r in table], float), np.array([r["y"] for r in table]), np.array([r["at"] < 0 for r in table])
    tally: dict[str, list[int]] = {}
    for r in table:
        tally.setdefault(r["z"]["word"], [0, 0])[r["y"]] += 1
    words = {w: round(4 * math.log((c[1] + 1) / (c[0] + 1))) for w, c in tally.items() if sum(c) >= SEEN and not w.endswith(" ")}
    x[:, FEATURES.index("word")] = [words.get(r["z"]["word"], 0) for r in table]
    first = boost.train(x[own | (y == 1)], y[own | (y == 1)])
    sure = own | (y == 1) | (first.probability(x) < 0.5)
    return boost.train(x[sure], y[sure]), words


def _spans(found: DataFrame, learned: tuple[boost.Boosted, dict[str, int]]) -> DataFrame:
    """(row, base, spans) of rows with found, their candidates; rows without spans may be missing."""
    trees, words = learned
    found = found.select("row", F.posexplode("found").alias("n", "x")).select("row", "n", "x.*")
    found = features(passing(placed(found)), words)
    chance = F.when(F.col("base"), 1.0).otherwise(trees.column(FEATURES))
    found = found.withColumn("chance", chance).where(F.col("base") | (F.col("chance") >= trees.threshold)).select("row", "kind", "base", "start", "end", "chance")
    found = written(found, "scored")  # the optimizer carries the trees through every later step otherwise
    in_order = Window.partitionBy("row").orderBy("start", "end", "kind", "base")
    reach = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("new", F.when(reach > F.col("start"), 0).otherwise(1)).withColumn("island", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max(F.struct("base", "chance", -F.col("start"), "end", -F.col("kind"))).over(Window.partitionBy("row", "island"))
    found = found.withColumn("best", best).where(F.col("base") | (~F.col("best.base") & (F.struct("base", "chance", -F.col("start"), "end", -F.col("kind")) == F.col("best"))))
    span = F.struct("start", "kind", "end")
    return found.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans"))


def pii_spans(docs: DataFrame, learned: tuple[boost.Boosted, dict[str, int]] | None = None) -> DataFrame:
    """(row, doc_id, base, spans) for every row of docs (doc_id, text): spans are (start, kind, end) in characters,
    end exclusive, by start, then kind; base holds those of the base rules, spans these and the added ones.

    Null texts are empty and have no spans, nor have empty ones; repeated rows stand for themselves; other columns are
    ignored; an empty table gives an empty result. Whole texts are searched, however long.
    """
    learned = learned or model(docs)
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seen = written(docs.select("row", "doc_id", _lists().alias("found")), "found")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    out = seen.select("row", "doc_id").join(_spans(seen.where(F.size("found") > 0), learned), "row", "left")
    return out.select("row", "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def listed(spans: str) -> Column:
    """Spans as kind:start:end, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, learned: tuple[boost.Boosted, dict[str, int]] | None = None) -> DataFrame:
    """docs with every span of text replaced by its kind in square brackets; overlapping spans are replaced as one, by
    the kind of the first. n_chars, where docs has it, follows.

    Every row stays, repeated ones included; null and empty texts are as they were; docs keeps its columns, whatever
    they are called; an empty table gives an empty result. Texts without candidates are not shuffled."""
    learned = learned or model(docs)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    seen = docs.select(own).select(F.monotonically_increasing_id().alias("row"), "doc", F.coalesce(F.col("doc.text").cast("string"), F.lit("")).alias("text"))
    seen = written(seen.select("row", "doc", _lists().alias("found")), "found")
    some = seen.where(F.size("found") > 0)
    merge = F.aggregate("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"), lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > s["start"]), F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.try_element_at(acc, F.lit(-1))["kind"].alias("kind"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end")))).otherwise(F.array_append(acc, s)))
    found = _spans(some, learned).select("row", merge.alias("cuts"))
    hit = some.select("row", "doc").join(found, "row", "left").withColumn("text", F.col("doc.text"))
    kinds = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    at = lambda i: F.get("cuts", i)
    pieces = F.transform("cuts", lambda s, i: F.concat(F.substring("text", F.when(i == 0, 1).otherwise(at(i - 1)["end"] + 1).cast("int"), (s["start"] - F.when(i == 0, 0).otherwise(at(i - 1)["end"])).cast("int")), F.get(kinds, s["kind"])))
    tail = F.substring("text", (at(F.size("cuts") - 1)["end"] + 1).cast("int"), F.length("text"))
    text = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), tail))
    cols = {"text": text} | ({"n_chars": F.when(F.col("cuts").isNull(), F.col("doc.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    hit = hit.select(*[cols.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
    return seen.where(F.size("found") == 0).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns]).union(hit)
