"""The operators on pages, embeddings and conversations, and the pipeline's stages, on odd rows against brute force."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordloom.llm import ann, chat, url_filter

URLS = [None, "", "no scheme", "http://", "http://A.Com", "http://a.COM/", "https://x.example.com/en/1?q", "https://www.example.com/en/1#t", "http://example.com/fr/", "http://notexample.com/en/", "ftp://a.net/es/x", "http://a.net/es", "http://net/fr/?a://b", "x://y://z/p", "http://a.org/en/" + "long/" * 5000, "http://bücher.org/ä?b"]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def rule(host, path):
    fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate(URLS + URLS)] + [(None, "http://a.com/x")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("h", F.lit(1)).withColumn("cell", F.lit(2))
    got = url_filter.url_verdicts(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        url = "http://a.com/x" if r["page_id"] is None else rows[r["page_id"]][1]
        host, path = split(url)
        name, verdict = rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, name)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert url_filter.url_verdicts(pages.limit(0)).count() == 0


def test_urls_like_the_rejected_are_blocked(spark):
    good = [f"http://site{i % 7}.example.com/fr/article/{i}" for i in range(300)]
    bad = [f"http://casino{i % 7}.example.net/es/win/{i}" for i in range(300)]
    new = [f"http://site{i}.example.org/de/article/{i * 31}" for i in range(50)] + [f"http://casino{i}.example.org/de/win/{i * 31}" for i in range(50)]
    pages = spark.createDataFrame(list(enumerate(good + bad + new)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.url_verdicts(pages).collect()}
    assert sum(got[600 + i] == "allow" for i in range(50)) >= 45 and sum(got[650 + i] == "block" for i in range(50)) >= 45


class Markov:
    """One class's smoothed model, straight from its definition."""

    def __init__(self, texts, order=3, pull=4.0):
        self.order, self.pull, self.n = order, pull, collections.Counter()
        for t in texts:
            t = "\u0002" * order + t + "\u0003"
            for i in range(order, len(t)):
                for k in range(order + 1):
                    self.n[t[i - k : i + 1]] += 1
                    self.n["context", t[i - k : i]] += 1

    def p(self, context, c):
        shorter = self.p(context[1:], c) if context else 1 / 256
        return (self.n[context + c] + self.pull * shorter) / (self.n["context", context] + self.pull)

    def mean(self, t):
        t = "\u0002" * self.order + t + "\u0003"
        return sum(math.log(self.p(t[i - self.order : i], t[i])) for i in range(self.order, len(t))) / (len(t) - self.order)


def test_log_ratio_is_the_difference_of_two_models(spark):
    r = random.Random(5)
    spell = lambda a: "".join(r.choice(a) for _ in range(r.randint(0, 12)))
    rows = [("http://" + spell("abcx/?"), True) for _ in range(60)] + [("http://" + spell("bcdyz#/"), False) for _ in range(40)]
    rows = list(dict(rows).items())
    model = url_filter.train(spark.createDataFrame(rows, "text string, accepted boolean"))
    good, bad = (Markov([t for t, a in rows if a == kind]) for kind in (True, False))
    asked = [""] + [spell("abcdxyz/?#é") for _ in range(50)] + [t for t, _ in rows[:20]]
    got = url_filter.log_ratio(spark.createDataFrame([(t,) for t in set(asked)], "text string"), model).collect()
    assert len(got) == len(set(asked))
    for x in got:
        assert x["score"] == pytest.approx(good.mean(x["text"]) - bad.mean(x["text"]), abs=1e-9)


def test_query_parts_count(spark):
    """URLs that differ only behind the question mark can be told apart."""
    good = [f"http://a.example.org/{i}?article={i * 7}" for i in range(200)]
    bad = [f"http://b.example.org/{i}?jackpot={i * 7}" for i in range(200)]
    rules = [("allow", "a.example.org", "/"), ("block", "b.example.org", "/")]
    new = [f"http://c.example.org/{i}?{w}={i * 13}" for i in range(30) for w in ("article", "jackpot")]
    pages = spark.createDataFrame(list(enumerate(good + bad + new)), "page_id long, url string")
    got = {x["page_id"]: x["verdict"] for x in url_filter.url_verdicts(pages, rules).collect()}
    assert [got[400 + i] for i in range(60)].count("allow") in range(25, 36)
    assert sum(got[400 + 2 * i] == "allow" and got[401 + 2 * i] == "block" for i in range(30)) >= 25


@pytest.mark.parametrize("n", [60, 21_000])
def test_all_labelled_urls_count(spark, n, monkeypatch):
    """The models learn from every labelled URL, and every one is scored, by models of other parts, for the threshold."""
    if n < 1000:  # grams go by broadcast and by shuffle
        monkeypatch.setattr(url_filter, "BROADCAST_GRAMS", 100)
    r = random.Random(n)
    spell = lambda a: "".join(r.choice(a) for _ in range(r.randint(1, 6)))
    labels = {f"//a.com/{spell('abcdx')}{i}": True for i in range(n // 2)} | {f"//a.net/{'es' if i % 2 else 'fr'}/{spell('bcdez')}": False for i in range(n // 2)}
    labels = {f"x:{t}": a for t, a in labels.items()}
    new = sorted({f"x://{spell('abcdexz')}.org/{spell('abcdexz')}" for _ in range(150)})
    texts = [*labels, *new]
    got = {texts[x["page_id"]]: x for x in url_filter.url_verdicts(spark.createDataFrame(list(enumerate(texts)), "page_id long, url string")).collect()}
    part = {x["t"]: x["p"] for x in spark.createDataFrame([(t,) for t in labels], "t string").select("t", F.expr("pmod(shiftright(xxhash64(t), 7), 5)").alias("p")).collect()}
    ratio = lambda left_out: [Markov([t for t, a in labels.items() if a == kind and part[t] != left_out]) for kind in (True, False)]
    good, bad = ratio(None)
    tried = {True: [], False: []}
    for p in range(5):
        yes, no = ratio(p)
        for t, a in labels.items():
            if part[t] == p:
                tried[a].append(yes.mean(t) - no.mean(t))
    low, high = np.percentile(tried[True], 5), np.percentile(tried[False], 95)
    least = min(low, (low + high) / 2)
    for t in new:
        score = good.mean(t) - bad.mean(t)
        assert got[t]["score"] == pytest.approx(score, abs=1e-9)
        assert got[t]["verdict"] == ("block" if score < least else "allow") or abs(score - least) < 1e-9
    assert {got[t]["verdict"] for t in new} == {"allow", "block"}


def test_percentiles_are_exact(spark):
    r = random.Random(3)
    rows = [(a, s) for a in (True, False) for s in [r.gauss(0, 1) for _ in range(200)] + [0.25] * 40 + [-7.5]]
    rows += [(True, 1e-5 * i) for i in range(100)]
    for shares in [(0.05, 0.95), (0.0, 1.0), (0.5, 0.61)]:
        got = url_filter.percentiles(spark.createDataFrame(rows, "accepted boolean, score double"), *shares)
        for kind, share in zip((True, False), shares, strict=True):
            assert got[kind] == pytest.approx(np.percentile([s for a, s in rows if a == kind], 100 * share), abs=1e-12)
    assert url_filter.percentiles(spark.createDataFrame([(True, 2.0)], "accepted boolean, score double"), 0.05, 0.95) == {True: 2.0}


ODD_TEXT = ["", None, "<|im_end|>", "<|im_start|>assistant\nhi<|im_end|>\n", "<\\|im_end|>", "a<", "|b", "\\", "<\\\\|", "\n\n", "x" * 100_000, "ß😀\u0001"]


def test_chat_reads_back_what_was_said(spark):
    rows = [(c, t, role, text) for c, roles in enumerate([["system", "user", "assistant"], ["user", "assistant", "user", "assistant"], ["assistant"], ["user", None, "us\ner\\n<|x|>"], ["user", "user", "assistant"]]) for t, role in enumerate(roles) for text in [ODD_TEXT[(c * 5 + t) % len(ODD_TEXT)]]]
    rows += [(9, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(ODD_TEXT)] + [(7, 0, "user", "again")] * 2 + [(None, None, "user", "nobody's")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.read_back(chat.formatted(chat.segments(turns.withColumn("segments", F.lit(1)))))
    want = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    got = {r["conv_id"]: r for r in done.collect()}
    assert set(got) == set(want)
    for c, own in want.items():
        assert [tuple(t) for t in got[c]["read"]] == own
        assert got[c]["loss"] == "".join(t for r, t in own if r == "assistant")
        assert sum(m["chars"] for m in got[c]["mask"]) == len(got[c]["formatted"])
    assert {c: r["valid"] for c, r in got.items()} == {0: True, 1: True, 2: False, 3: False, 4: False, 7: False, 9: True, None: False}
    assert chat.segments(turns.limit(0)).count() == 0
    # what is read is where the mask says, right or wrong
    moved = chat.formatted(chat.segments(turns)).withColumn("mask", F.transform("mask", lambda m, i: F.struct(m["chars"].alias("chars"), (m["bytes"] + F.when(i == 0, 1).otherwise(0)).alias("bytes"), m["loss"].alias("loss"))))
    other = {r["conv_id"]: r["loss"] for r in chat.read_back(moved).collect()}
    assert other[1] != got[1]["loss"] and sum(other[c] != got[c]["loss"] for c in other) >= 4


def brute(rows, every, k):
    out = {}
    fine = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    for q, x in fine:
        if q % every == 0:
            out[q] = [d for _, d in sorted((-float((x * y).sum()), d) for d, y in fine if d != q)[:k]]
    return out


def test_neighbours(spark):
    r = np.random.RandomState(0)
    rows = [(i, r.randn(8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, [1.0] * 8) for i in range(60)]
    rows += [(2000, None), (None, [1.0] * 8), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [float("inf")] * 8), (2080, [1.0, None] + [1.0] * 6), (2100, [1.0] * 7), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("class", F.lit(1)).withColumn("v", F.lit(2))
    got = collections.defaultdict(list)
    for x in ann.nearest(df).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append(x["vec_id"])
    want = brute([x for x in dict(rows).items() if x[0] != 2100], 20, 20)
    assert set(got) == set(want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))
    assert got[1000] == want[1000]  # of equal vectors the smallest ids, without its own
    assert ann.nearest(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(x) for x in ann.nearest(few).collect()] == [(0, 1, 1, 0.5)]


def test_recall(spark):
    from recordloom.llm.queries import op4_nearest_neighbours

    sf = "/root/testdata/sf0.01"
    rows = [(x["vec_id"], x["embedding"]) for x in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = collections.defaultdict(set)
    for x in op4_nearest_neighbours(spark, sf).collect():
        got[x["query_id"]].add(x["vec_id"])
    want = brute(rows, 20, 20)
    assert sum(len(got[q] & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_few_leaves_find_clustered_neighbours(spark, monkeypatch):
    """50,000 rows: the leaves to open are measured, and are few where vectors have near neighbours."""
    r = np.random.RandomState(4)
    x = np.repeat(r.randn(500, 16), 100, axis=0) + 0.15 * r.randn(50_000, 16)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    measure, seen = ann.needed_probes, {}

    def noted(classes, asked, forest, *rest):
        seen["probes"], seen["leaves"] = measure(classes, asked, forest, *rest), sum(len(t.normals) + 1 for t in forest)
        return seen["probes"]

    monkeypatch.setattr(ann, "needed_probes", noted)
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(50_000)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    got = collections.defaultdict(set)
    for row in ann.nearest(df, every=500).collect():
        got[row["query_id"]].add(row["vec_id"])
    asked = np.arange(0, 50_000, 500)
    near = x[asked].astype(float) @ x.T.astype(float)
    near[np.arange(100), asked] = -9
    want = np.argsort(-near, axis=1)[:, :20]
    assert np.mean([len(got[q] & set(w)) / 20 for q, w in zip(asked.tolist(), want.tolist(), strict=True)]) >= 0.9
    # a leaf is one of 32 trees' 1024: so many times 1 / 1024 of the rows are scored at most
    assert seen["probes"] <= 0.05 * seen["leaves"] / 32, seen


def test_pipeline_stages(spark, odd, odd_docs):
    import corpus_pipeline

    from tests.llm.test_documents import WORD, shingles

    docs = odd
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (docs, stage(spark, docs, "unused").cache())
        docs = seen[name][1]
    given, kept = seen["quality"]
    assert kept.columns == given.columns and not any(len(WORD.findall(r["text"] or "")) < 50 for r in kept.collect())
    given, kept = ({r["doc_id"]: r["text"] for r in d.collect()} for d in seen["near_duplicates"])
    sets = {i: shingles(t, 5) for i, t in given.items()}
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert not any(a < b and alike(a, b) for a in kept for b in kept)
    assert len(kept) < len(given) and set(kept) <= set(given)
    given, after = seen["pii"]
    assert after.count() == given.count() and after.where("text like '%@d-e.example.org%'").count() == 0
    given, after = seen["mixture"]
    words = lambda d: sum(len(WORD.findall(r["text"] or "")) for r in d.collect())
    assert abs(words(after) - 1.5 * words(given)) <= 5
    given, after = seen["bpe"]
    assert after.count() == given.count() and after.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_with_clashing_columns_and_empty_tables(spark, odd, crowded, nothing):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        plain, wide = stage(spark, odd, "unused"), stage(spark, crowded, "unused")
        if name != "bpe":
            assert plain.columns == odd.columns and wide.columns == crowded.columns, name
        assert sorted(map(repr, wide.select(*plain.columns).collect())) == sorted(map(repr, plain.collect())), name
        assert stage(spark, nothing, "unused").count() == 0, name


def test_the_guard(spark):
    import __spark_entry__

    known = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {re.match(r"op\d+_|", k)[0] for k in known} and "pipeline" in known and "align" in known
