"""URL filter: host and path rules, and where none fits, the ratio of two character language models.

All URLs that rules accept and reject train one smoothed variable-order Markov model each; a URL's log-likelihood
difference, over its length, decides at a threshold that is calibrated on all of them, each judged by models that have
not learned from its part. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower, written

#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Characters of context at most, and grams that are broadcast at most; more are joined by a shuffle.
ORDER, BROADCAST_GRAMS = 3, 500_000
#: Parts of the labelled URLs; the models of a part learn from all URLs of the others, those of WHOLE from all there are.
PARTS, WHOLE = 5, -1
#: Bins a unit of score, by which percentiles are found.
BINS = 1000
_BEGIN, _END = "\u0002", "\u0003"


def split_url(pages: DataFrame) -> DataFrame:
    """pages with the host, A-Z lower-cased, and the path of url, and text: the whole url (null: empty), its host lower-cased."""
    at = F.locate("://", F.col("url"))
    rest = F.when(at > 0, F.col("url").substr(at + 3, F.length("url"))).otherwise("")
    pages = pages.withColumn("host", F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit("")))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    pages = pages.withColumn("lowered", lower("host"))
    text = F.when(at > 0, F.concat(F.substring("url", 1, at + 2), "lowered", F.substring(rest, F.length("host") + 1, F.length("url")))).otherwise(F.coalesce("url", F.lit("")))
    return pages.withColumn("path", path).withColumn("text", text).withColumn("host", F.col("lowered")).drop("lowered")


def rule_of(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (ties: the first by name), and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))[::-1]:
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _grams(urls: DataFrame) -> DataFrame:
    """A row for every character of text, and one for its end: with g0 to g3, each a character more of context."""
    text = F.concat(F.lit(_BEGIN * ORDER), "text", F.lit(_END))
    rows = urls.withColumn("__t", text).withColumn("__at", F.explode(F.sequence(F.lit(ORDER + 1), F.length("__t"))))
    return rows.select(*urls.columns, *[F.col("__t").substr(F.col("__at") - k, F.lit(k + 1)).alias(f"g{k}") for k in range(ORDER + 1)])


def train(urls: DataFrame, pull: float = 4.0) -> DataFrame:
    """(part, k, gram, delta, weight): the models of accepted and rejected URLs, by grams with k characters of context.

    urls has text and accepted. If it has a part, there are models for each part, which learn from all other parts, and
    those of all URLs, whose part is WHOLE; else only these. An order's probabilities are drawn towards those of the
    order below as by pull more occurrences: p(c | context) = (n(context c) + pull p(c | shorter context)) / (n(context)
    + pull), and 1/256 below the lowest. delta is the difference of the log-probabilities of the last character of gram;
    weight that of the factors pull / (n(context) + pull), by which a character that was never seen behind this context
    goes down to the shorter one (in rows of the context itself, whose delta is null).
    """
    parts = "part" in urls.columns
    rows = _grams(urls.select("text", "accepted", (F.col("part") if parts else F.lit(WHOLE)).cast("int").alias("own")))
    rows = rows.select("own", "accepted", F.posexplode(F.array(*[f"g{k}" for k in range(ORDER + 1)])).alias("k", "gram"))
    counts = rows.groupBy("own", "k", "gram").agg(F.count(F.when(F.col("accepted"), 1)).alias("a"), F.count(F.when(~F.col("accepted"), 1)).alias("r"))
    learn = F.array_remove(F.array(*[F.lit(p) for p in [WHOLE, *range(PARTS)]]), F.col("own")) if parts else F.array(F.lit(WHOLE))
    counts = written(counts.select("k", "gram", "a", "r", F.explode(learn).alias("part")).groupBy("part", "k", "gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r")), "grams")
    model, below = None, None
    for k in range(ORDER + 1):
        own = counts.where(F.col("k") == k).withColumn("context", F.substring("gram", 1, k))
        contexts = own.groupBy("part", "context").agg(F.sum("a").alias("all_a"), F.sum("r").alias("all_r"))
        own = own.join(contexts, ["part", "context"])
        if below is None:
            own = own.withColumn("lower_a", F.lit(1 / 256)).withColumn("lower_r", F.lit(1 / 256))
        else:
            own = own.withColumn("suffix", F.col("gram").substr(2, k)).join(below, ["part", "suffix"])
        own = own.withColumn("pa", (F.col("a") + pull * F.col("lower_a")) / (F.col("all_a") + pull)).withColumn("pr", (F.col("r") + pull * F.col("lower_r")) / (F.col("all_r") + pull))
        below = own.select("part", F.col("gram").alias("suffix"), F.col("pa").alias("lower_a"), F.col("pr").alias("lower_r"))
        own = own.select("part", "k", "gram", (F.ln("pa") - F.ln("pr")).alias("delta"), F.lit(None).cast("double").alias("weight"))
        down = F.ln((F.col("all_r") + pull) / (F.col("all_a") + pull))
        own = own.union(contexts.select("part", F.lit(k), "context", F.lit(None).cast("double"), down))
        model = own if model is None else model.union(own)
    return written(model, "model")


def log_ratio(urls: DataFrame, model: DataFrame) -> DataFrame:
    """urls, distinct rows with a text, and score: the models' log-likelihood difference, over the characters and the end.

    The models are those of the part of a row, or if urls has none, those of WHOLE. A character's difference is that of
    its longest known gram, and the weights of the longer contexts behind which it was not seen; an unknown context adds
    nothing, in either model. It is found once for every gram there is, however often. With more of them than can be
    broadcast, those above an equal share of all characters are, and the others are joined by a shuffle, which so has no
    hot keys.
    """
    own_part = F.col("part") if "part" in urls.columns else F.lit(WHOLE)
    rows = _grams(urls).withColumn("__part", own_part.cast("int")).select(*urls.columns, "__part", F.col(f"g{ORDER}").alias("__gram"))
    grams = rows.groupBy("__part", "__gram").agg(F.count("*").alias("__n"))
    sizes = {r["k"]: r["count"] for r in model.groupBy("k").count().collect()}
    delta = F.lit(0.0)
    for k in range(ORDER + 1):
        own = model.where(F.col("k") == k).withColumnRenamed("part", "__part")
        sent = F.broadcast if sizes.get(k, 0) <= BROADCAST_GRAMS // (ORDER + 1) else (lambda df: df)
        grams = grams.withColumn(f"g{k}", F.substring("__gram", ORDER - k + 1, k + 1)).withColumn(f"c{k}", F.substring("__gram", ORDER - k + 1, k))
        grams = grams.join(sent(own.where("delta is not null").select("__part", F.col("gram").alias(f"g{k}"), F.col("delta").alias(f"d{k}"))), ["__part", f"g{k}"], "left")
        grams = grams.join(sent(own.where("weight is not null").select("__part", F.col("gram").alias(f"c{k}"), F.col("weight").alias(f"w{k}"))), ["__part", f"c{k}"], "left")
        delta = F.coalesce(F.col(f"d{k}"), delta + F.coalesce(F.col(f"w{k}"), F.lit(0.0)))
    grams = written(grams.select("__part", "__gram", "__n", delta.alias("__delta")), "deltas")
    keys = ["__part", "__gram"]
    if grams.count() <= BROADCAST_GRAMS:
        rows = rows.join(F.broadcast(grams.drop("__n")), keys)
    else:
        often = F.col("__n") > F.lit(grams.agg(F.sum("__n")).first()[0] / BROADCAST_GRAMS)
        first = rows.join(F.broadcast(grams.where(often).drop("__n")), keys, "left")
        rows = first.where("__delta is not null").unionByName(first.where("__delta is null").drop("__delta").join(grams.where(~often).drop("__n"), keys))
    return rows.groupBy(*urls.columns).agg(F.avg("__delta").alias("score"))


def percentiles(scored: DataFrame, accepted: float, rejected: float) -> dict[bool, float]:
    """The percentiles, at these shares, of the scores of accepted and rejected rows of scored (accepted, score), as
    percentile() gives them; a class without rows has none. No task gets all scores: those of the bins that hold the
    ranks asked for are counted."""
    scored = scored.select("accepted", "score", F.floor(F.col("score") * BINS).alias("bin"))
    every = Window.partitionBy("accepted")
    bins = scored.groupBy("accepted", "bin").agg(F.count("*").alias("n"))
    bins = bins.withColumn("before", F.sum("n").over(every.orderBy("bin")) - F.col("n"))
    bins = bins.withColumn("at", (F.sum("n").over(every) - 1) * F.when(F.col("accepted"), accepted).otherwise(rejected))
    bins = bins.where("before <= ceil(at) and before + n > floor(at)").drop("n")
    near = scored.join(F.broadcast(bins), ["accepted", "bin"]).groupBy("accepted", "bin", "before", "at", "score").agg(F.count("*").alias("n"))
    near = near.withColumn("end", F.col("before") + F.sum("n").over(Window.partitionBy("accepted", "bin").orderBy("score")))
    holds = lambda rank: F.max(F.when((F.col("end") - F.col("n") <= rank) & (F.col("end") > rank), F.col("score")))
    ends = near.groupBy("accepted", "at").agg(holds(F.floor("at")).alias("low"), holds(F.ceil("at")).alias("high"))
    return {r["accepted"]: r["x"] for r in ends.select("accepted", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias("x")).collect()}


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, rejected_good: float = 0.05) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of pages (page_id, url).

    All distinct URLs with a rule's verdict train the models that judge the others. All of them set the threshold, too:
    dealt to PARTS by their hashes, each is scored by models of the other parts, and the threshold is halfway between
    accepted and rejected ones but for a share of rejected_good of each; where these overlap, no more than that share of
    the accepted is lost. A part is not scored if the others have no accepted or no rejected URL; without any score of a
    class, 0 stands for its percentile. The models judge the whole url. Without accepted and rejected URLs to learn from,
    whatever no rule fits is allowed. A null url, or one without "://", has an empty host and path; the models judge what
    there is of it. score is null where a rule decides. Repeated rows get equal verdicts, and an empty table an empty
    result.
    """
    rule, verdict = rule_of(rules)
    judged = split_url(pages.select("page_id", F.col("url").cast("string").alias("url"))).withColumn("rule", rule).withColumn("verdict", verdict)
    judged = written(judged.select("page_id", "host", "path", "rule", "verdict", "text"), "pages")
    known = judged.where("verdict is not null").groupBy("text").agg(F.first(F.col("verdict") == "allow").alias("accepted"))
    known = written(known.withColumn("part", F.pmod(F.shiftright(F.xxhash64("text"), 7), F.lit(PARTS)).cast("int")), "labelled")
    by_part = {r[0]: r[1:] for r in known.groupBy("part").agg(F.count_if("accepted"), F.count_if(~F.col("accepted"))).collect()}
    both = [sum(n[i] for n in by_part.values()) for i in range(2)]
    if not all(both):
        return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    model = train(known)
    tried = known.where(F.col("part").isin([p for p, n in by_part.items() if both[0] > n[0] and both[1] > n[1]]))
    tried = written(log_ratio(tried, model.where(F.col("part") != WHOLE)).select("accepted", "score"), "tried")
    edge = percentiles(tried, rejected_good, 1 - rejected_good)
    good, bad = edge.get(True, 0.0), edge.get(False, 0.0)
    least = min(good, (good + bad) / 2)
    other = judged.where("verdict is null")
    scores = log_ratio(other.select("text").distinct(), model.where(F.col("part") == WHOLE))
    out = other.join(scores, "text", "left").withColumn("verdict", F.when(F.col("score") < least, "block").otherwise("allow"))
    cols = ["page_id", "host", "path", "rule", "verdict", "score"]
    return judged.where("verdict is not null").withColumn("score", F.lit(None).cast("double")).select(*cols).union(out.select(*cols))
