"""The operators on documents, each against a brute-force version, on odd rows, an empty table and clashing columns."""

import collections
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordloom.llm import bpe, lm_score, mixture, near_dup, pii, quality, sharding

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def same_rows(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, odd, odd_docs, crowded, nothing, k):
    got = near_dup.near_duplicates(odd, shingle=k)
    assert got.count() == len(odd_docs)
    sets = {i: shingles(t, k) for i, t, *_ in odd_docs if i is not None}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    for r in got.where("doc_id is not null").collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])
    assert same_rows(got, near_dup.near_duplicates(crowded, shingle=k))
    assert near_dup.near_duplicates(nothing).count() == 0
    kept = near_dup.kept_one_of_each(odd, shingle=k)
    assert kept.columns == odd.columns and kept.where("doc_id = 310").count() == 1
    assert {r["doc_id"] for r in kept.collect()} == {None, *(i for i in sets if find(i) == i)}


def test_large_family_of_near_copies(spark):
    """More near copies than a bucket may compare in pairs, some of which are linked by one chain only."""
    r = np.random.RandomState(1)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(150):
        own = list(base)
        for j in r.choice(100, r.randint(0, 9), replace=False):
            own[j] = f"x{r.randint(1 << 30)}"
        rows.append((i, " ".join(own)))
    got = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [shingles(t, 2) for _, t in rows]
    up = list(range(150))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(150):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    assert got == {i: find(i) for i in range(150)}


def test_quality(odd, odd_docs, crowded, nothing):
    got = quality.quality(odd)
    assert got.count() == len(odd_docs)
    want = collections.Counter()
    for i, t, *_ in odd_docs:
        t = t or ""
        w = WORD.findall(t)
        tri = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for n, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if tri[x] > 1 for j in (n, n + 1, n + 2)}
        seen, again = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        want[i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), again, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)] += 1
    assert collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got.collect()) == want
    assert same_rows(got.drop("source"), quality.quality(crowded).drop("source"))
    assert quality.quality(nothing).count() == 0 and quality.kept_documents(odd).columns == odd.columns


def test_boilerplate_goes_and_copies_stay(spark):
    """A line of many texts is boilerplate wherever it stands; copies of one text are one document to the counts."""
    spell = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    prose = lambda i, n: "\n".join(" ".join(f"t{spell(i)}x{spell(j)}y{spell(k)}" for k in range(20)) for j in range(n))
    bar = " ".join(f"menu{spell(k)}" for k in range(30))
    foot, feet = (" ".join(f"{w}{spell(k)}" for k in range(12)) for w in ("foot", "feet"))
    rows = [(i, "h", f"{prose(i, 2)}\n{bar}\n{prose(i + 10_000, 2)}") for i in range(40)]
    rows += [(100 + i, "h", f"first{spell(i)}\n" + "\n".join([bar] * 6)) for i in range(15)]
    rows += [(200 + i, "h", prose(777, 6)) for i in range(40)]
    rows += [(300 + i, "h", f"{prose(300 + i, 3)}\n{foot}\n{feet}") for i in range(30)]
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert all(got[i]["removed_words"] == 30 and got[i]["kept"] for i in range(40))
    assert not any(got[100 + i]["kept"] for i in range(15))
    assert all(got[300 + i]["kept"] and got[300 + i]["removed_words"] == 24 for i in range(30))
    assert all(got[200 + i]["kept"] and got[200 + i]["removed_words"] == 0 for i in range(40))


def test_kept_documents_are_without_boilerplate(spark):
    spell = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    prose = lambda i: " ".join(f"t{spell(i)}x{spell(j)}" for j in range(60))
    bar = "Ménü " + " ".join(f"menu{spell(k)}" for k in range(10)) + " 2024"
    rows = [(i, "h" if i % 2 else None, f"{prose(i)}\n\n{bar}\n{prose(i + 1000)}", 7) for i in range(60)]
    rows += [rows[3], (100, "other", f"{prose(100)}\n{bar}", 8), (101, "h", bar, 9)]
    got = sorted(map(tuple, quality.kept_documents(spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long")).collect()))
    assert len(got) == 62 and 101 not in {r[0] for r in got}
    for i, source, text, n_chars in got:
        want = f"{prose(100)}\n{bar}" if i == 100 else f"{prose(i)}\n\n{prose(i + 1000)}"
        assert (source, text, n_chars) == ("other" if i == 100 else "h" if i % 2 else None, want, 8 if i == 100 else len(want))


def shares(source_sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by handing out the excess of full sources again and again."""
    names = sorted(source_sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, share * sum(source_sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        level = (left - sum(full.values())) / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if weight[s] * level > most * source_sizes[s]]
        if not over:
            return full | {s: weight[s] * level for s in open_}
        full |= {s: most * source_sizes[s] for s in over}


def test_mixture(odd, odd_docs, crowded, nothing):
    got = mixture.mixture(odd, block=64).collect()
    assert len(got) == len(odd_docs)
    size, taken = collections.Counter(), collections.Counter()
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] == r["first"] + r["second"] <= 2 * r["size"] and (r["place"] is None) == (r["taken"] == 0)
    want = shares(size)
    assert {r["source"]: r["source_size"] for r in got} == dict(size)
    assert all(r["target"] == pytest.approx(want[r["source"]]) for r in got) and all(abs(taken[s] - want[s]) <= 1 for s in size)
    strip = lambda rows: sorted(((r["doc_id"], r["size"], r["taken"], r["place"]) for r in rows), key=repr)
    assert strip(mixture.mixture(odd, block=64).collect()) == strip(got) == strip(mixture.mixture(crowded.withColumn("target", F.lit(1)).withColumn("place", F.lit(2)), block=64).collect())
    assert mixture.mixture(nothing).count() == 0


def test_order_is_by_the_points(odd):
    """Another sequence of points takes the same words in another order."""
    own = mixture.mixture(odd, block=64).collect()
    other = mixture.mixture(odd, block=64, point=lambda cell, bits: cell).collect()
    taken = lambda rows: collections.Counter((r["doc_id"], r["taken"]) for r in rows)
    order = lambda rows: [r["doc_id"] for r in sorted((r for r in rows if r["place"] is not None), key=lambda r: r["place"])]
    assert taken(own) == taken(other) and order(own) != order(other)
    # cell after cell takes source after source; van der Corput points change between them
    changes = lambda rows: sum(a != b for a, b in zip(*[[by[i] for i in order(rows)][n:] for n in (0, 1)], strict=False))
    by = {r["doc_id"]: r["source"] for r in own}
    assert changes(own) > 3 * changes(other)


def test_mixed(spark, odd, crowded, nothing):
    mix = mixture.mixture(odd, block=64).collect()
    out = mixture.mixed(odd, block=64)
    rows = out.collect()
    assert out.columns == odd.columns and all(r["text"] for r in rows)
    words = collections.Counter()
    for r in rows:
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert words == collections.Counter({i: n for i, n in ((i, sum(r["taken"] for r in mix if r["doc_id"] == i)) for i in {r["doc_id"] for r in mix}) if n})
    # rows come in the order of their first appearances' places
    place = {r["doc_id"]: r["place"] for r in mix if r["place"] is not None}
    first = list(dict.fromkeys(r["doc_id"] for r in rows))
    assert [place[i] for i in first] == sorted(place[i] for i in first)
    wide = crowded
    for c in ("id", "own", "times", "target", "place", "part", "turn", "low", "high", "docs"):
        wide = wide.withColumn(c, F.lit(3))
    assert mixture.mixed(wide, block=64).columns == wide.columns
    assert same_rows(mixture.mixed(wide, block=64).select(*odd.columns), out) and mixture.mixed(nothing).count() == 0
    # copies of one row by id, text and source keep what else they have
    again = spark.createDataFrame([(1, "a b c", "en", "s", 5), (1, "a b c", "de", "s", 6)], odd.schema)
    assert {(r["lang"], r["n_chars"]) for r in mixture.mixed(again, share=2.0).collect()} == {("en", 5), ("de", 6)}


def test_schedule_keeps_near_the_weights(spark):
    goals = spark.createDataFrame([(0, 3000.0), (1, 1000.0), (2, 2000.0), (3, 0.0), (4, 7.0)], "sid int, target double")
    slots, places = mixture.schedule(goals, 1)
    slots = sorted(slots.collect())
    assert places == 8192 and len({r["place"] for r in slots}) == len(slots)
    for s, n in ((0, 3000), (1, 1000), (2, 2000), (4, 7)):
        assert [r["rank"] for r in slots if r["sid"] == s] == list(range(n))
    for n in (60, 600, 3000, 5000):
        part = collections.Counter(r["sid"] for r in slots[:n])
        assert abs(part[0] - n * 3000 / 6007) <= 8 and abs(part[1] - n * 1000 / 6007) <= 8


def test_shards(odd, odd_docs, crowded, nothing):
    got = sharding.shards(odd).collect()
    n = len(odd_docs)
    count = collections.Counter(r["shard"] for r in got)
    assert len(got) == n and max(count.values()) - min(count.values()) <= 1 and set(count) == set(range(8))
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(count[s])) for s in range(8))
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in odd_docs)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert same_rows(sharding.shards(odd), sharding.shards(crowded)) and sharding.shards(nothing).count() == 0


def test_hilbert_curve_goes_from_neighbour_to_neighbour():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        at = sharding.hilbert_index(list(grid.T), bits)
        assert sorted(at) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()


def test_shards_are_written(spark, odd, crowded, tmp_path):
    wide = crowded.withColumn("shard", F.lit("x")).withColumn("slot", F.lit(1))
    with pytest.raises(ValueError):
        sharding.write_shards(wide, str(tmp_path / "no"))
    for i, docs in enumerate((odd, wide)):
        sharding.write_shards(docs, str(tmp_path / f"out{i}"), n_shards=4, folder="part")
        back = spark.read.parquet(str(tmp_path / f"out{i}"))
        rows = [r["count"] for r in back.groupBy("part").count().collect()]
        assert len(rows) == 4 and max(rows) - min(rows) <= 1
        assert same_rows(back.select(*docs.columns), docs)


def test_files_can_be_pruned(spark):
    """A shard has few of the values of each dimension, strings with a long common prefix included."""
    r = np.random.RandomState(8)
    rows = [(i, "t", "en", f"https://host{a:03d}.example.org", int(b)) for i, (a, b) in enumerate(zip(r.randint(0, 256, 4000), r.randint(0, 1 << 20, 4000), strict=True))]
    got = {x["doc_id"]: x["shard"] for x in sharding.shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), n_shards=16, by=("source", "n_chars")).collect()}
    for at, values in ((3, sorted({x[3] for x in rows})), (4, sorted({x[4] for x in rows}))):
        place = {v: n / len(values) for n, v in enumerate(values)}
        width = [max(p) - min(p) for p in ([place[x[at]] for x in rows if got[x[0]] == s] for s in range(16))]
        assert np.mean(width) < 0.45


def test_lm_scores(odd, odd_docs, crowded, nothing):
    got = lm_score.lm_scores(odd)
    tokens = [(i, [*WORD.findall((t or "").translate(LOW)), None]) for i, t, *_ in odd_docs]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = collections.Counter(t for i, own in tokens if not held(i) for t in own)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(own), sum(t in c for t in own), n, round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own), 6)) for i, own in tokens)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got.collect()) == want
    assert all(r["score"] < 0 for r in got.collect())
    assert same_rows(got, lm_score.lm_scores(crowded)) and lm_score.lm_scores(nothing).count() == 0


def test_filter_gives_quantised_counts_back():
    r = np.random.RandomState(2)
    grams = np.unique(r.randint(1, 1 << 62, 20_000, dtype=np.int64).astype(np.uint64))
    counts = np.maximum(1, (r.pareto(1, len(grams)) * 2).astype(np.int64))
    first, bits, data = lm_score.build_filter(grams, counts, 1 << 20)
    flt = lm_score.Filter(0, [(0, first, bits, data)], 1 << 20)
    got = flt.counts(grams, False)
    # what is in the filter is never taken for less, and rarely for more
    low = lm_score.SCALE[np.searchsorted(lm_score.SCALE, counts, side="right") - 1]
    assert first == 0 and (got >= low).all() and np.mean(got > 1.6 * counts + 1) < 0.03
    assert np.mean(flt.counts(r.randint(1, 1 << 62, 20_000, dtype=np.int64).astype(np.uint64), False) > 0) < 0.03
    # a smaller bound starts the scale higher and stays within it
    first, bits, data = lm_score.build_filter(grams, counts, 4096)
    assert first > 0 and len(data) <= 4096
    got = lm_score.Filter(0, [(0, first, bits, data)], 4096).counts(grams, False)
    assert (got[counts >= lm_score.SCALE[first]] > 0).all()


def test_filters_grow_with_the_ngrams(spark):
    """N-grams that occur once keep their counts, and a segment's filter has no bound that could leave them out."""
    r = np.random.RandomState(3)
    words = [[f"w{x}" for x in r.randint(0, 1 << 40, 1000)] for _ in range(400)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    got = {row["doc_id"]: row for row in lm_score.lm_scores(docs).collect()}
    train = [w for i, w in enumerate(words) if not held(i)]
    n = sum(len(w) + 1 for w in train)
    total = n + 0.1 * (len({x for w in train for x in w}) + 2)
    # a training document's words and pairs occur once, and its first word follows the start, but for false positives
    once = lambda before: (1 + 100 * 1.1 / total) / (before + 100)
    end = len(train)
    want = math.log10(once(end)) + 999 * math.log10(once(1)) + math.log10((1 + 100 * (end + 0.1) / total) / 101)
    scores = [got[i]["score"] for i in got if not held(i)]
    assert len(got) == 400 and abs(np.mean(scores) - want) < 0.02 * abs(want)
    # 48 MB over 1024 segments, as the filter was bounded on 0.5 GB, hold some 40,000 of these
    grams = np.unique(r.randint(1, 1 << 62, 300_000, dtype=np.int64).astype(np.uint64))
    rows = pa.record_batch({"block": pa.array([0], pa.int32()), "pairs": [True], "segment": pa.array([0], pa.int32()), "hashes": [grams.tobytes()], "counts": [np.ones(len(grams), np.uint8).tobytes()]})
    (answer,) = lm_score._probe()([rows])
    assert (np.frombuffer(answer.column(3)[0].as_py(), np.uint8) >= 1).all()


def test_score_is_the_smoothed_pair_model(spark):
    """Against the model on exact counts, quantised as the filter's scale does, but for a filter's few false positives."""
    r = np.random.RandomState(6)
    docs = [(i, " ".join(f"w{min(int(x), 3000)}" for x in r.zipf(1.3, 150))) for i in range(400)]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    tokens = {i: [None, *t.split(), ""] for i, t in docs}  # None is the start, "" the end
    train = [own for i, own in tokens.items() if not held(i)]
    one, two = collections.Counter(t for own in train for t in own[1:]), collections.Counter(p for own in train for p in zip(own, own[1:], strict=False))
    total = sum(one.values()) + 0.1 * (len(one) + 1)
    q = lambda c: float(lm_score.VALUE[np.searchsorted(lm_score.SCALE, c, side="right")])

    def score(own):
        out = 0.0
        for a, b in zip(own, own[1:], strict=False):
            before = len(train) if a is None else q(one[a])
            out += math.log10((min(q(two[a, b]), before) + 100 * (q(one[b]) + 0.1) / total) / (before + 100))
        return out

    got = {x["doc_id"]: x["score"] for x in lm_score.lm_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    off = [abs(got[i] / score(own) - 1) for i, own in tokens.items()]
    assert np.mean(off) < 0.01 and np.quantile(off, 0.95) < 0.02
    # what a document has in training makes it likelier than the same words in another order
    assert all(got[i] < 0 for i in got)


def test_held_out_words_are_likelier_with_the_model(spark):
    rows = [(i, " ".join(f"a{(i + j) % 17} b{(i + j) % 17}" for j in range(30))) for i in range(200)]
    got = lm_score.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > got[0] / 2


def test_bpe(odd, odd_docs, crowded, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in bpe.encoded(odd, path).collect()}
    for i, t, *_ in odd_docs:
        e = tok.encode(t or "", add_special_tokens=False)
        assert got[i]["ids"] == e.ids and got[i]["decoded"] == tok.decode(e.ids, skip_special_tokens=False)
    assert same_rows(bpe.encoded(odd, path), bpe.encoded(crowded, path)) and bpe.encoded(nothing, path).count() == 0


def test_bpe_of_odd_characters():
    import random

    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, own, r = Tokenizer.from_file(path), bpe.WordBpe(open(path, encoding="utf-8").read()), random.Random(4)
    texts = ["", "ΣΑΣ ς", "a\x1cb\x1c", "é ́x", "<|endoftext|><|startoftext|>x<|ENDOFTEXT|>", "don't DON'T we'll", "漢字かな 한글 ١٢ ½", "😀👍🏽", "İ ẞ"]
    texts += ["".join(r.choice("ab cÀéß'tsΣ́\n\t<|endoftext>12漢😀  ﬁǅ") for _ in range(r.randint(1, 50))) for _ in range(500)]
    ids, at, decoded = own.encode([t.encode() for t in texts])
    for n, t in enumerate(texts):
        e = tok.encode(t, add_special_tokens=False)
        assert ids[at[n] : at[n + 1]].tolist() == e.ids and decoded[n] == tok.decode(e.ids, skip_special_tokens=False)


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)] if "@" in t else []
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        out += [(m.start(), 2, m.end())] * (14 <= len(d) <= 19 and luhn(d))
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15])


def test_pii(spark, odd, odd_docs, crowded, nothing):
    found = pii.pii_spans(odd)
    got = collections.defaultdict(list)
    for r in found.collect():
        got[r["doc_id"]].append([tuple(s) for s in r["base"]])
        assert set(map(tuple, r["base"])) <= set(map(tuple, r["spans"]))
    for i, t, *_ in odd_docs:
        assert base_spans(t or "") in got[i]
    assert [len(x) for x in got.values()] == list(collections.Counter(d[0] for d in odd_docs).values()) or sum(map(len, got.values())) == len(odd_docs)
    assert same_rows(found.drop("row"), pii.pii_spans(crowded).drop("row")) and pii.pii_spans(nothing).count() == 0
    out = pii.redacted(odd)
    assert out.columns == odd.columns and out.count() == len(odd_docs)
    text = out.where("doc_id = 300").first()["text"]
    assert text == "mail [email] now, ip [ip] and 1.2.3.400, card [card], call [phone]."


def prose_with_spans(seed, n, base_share):
    """Documents of invented words with numbers, codes and personal data among them, in no set context: (text, spans) each,
    spans (kind, string) that a reader would call personal."""
    import random

    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["ba", "ku", "lo", "mir", "ta", "ne", "sho", "gra", "vi", "po"]) for _ in range(r.randint(1, 4)))

    def card():
        body = "4" + d(14)
        return body + str(-sum(x if i % 2 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(body)))) % 10)

    ip = lambda: ".".join(str(r.randint(1, 255)) for _ in range(4))
    base = [lambda: (0, f"{word()}{d(2)}@{word()}.org"), lambda: (1, ip()), lambda: (2, card()), lambda: (3, f"+1 ({d(3)}) {d(3)}-{d(4)}")]
    wide = [lambda: (0, f"{word()}.{word()}[at]{word()}[dot]net"), lambda: (0, f"{word()}{d(1)} (at) {word()} (dot) com"), lambda: (1, ip().replace(".", "[.]")), lambda: (3, f"({d(3)}) {d(3)}-{d(4)}"), lambda: (4, "".join(r.choice("0123456789abcdef") for _ in range(40)))]
    plain = [lambda: f"20{d(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", lambda: d(2) + "/" + d(2), lambda: f"{r.randint(1, 9)}.{r.randint(0, 30)}.{r.randint(300, 999)}.{d(1)}", lambda: d(5) + "-" + d(2), lambda: "-".join(word() for _ in range(6)), lambda: d(3) + "." + d(2), lambda: word() + " @ " + word(), lambda: "_".join(word().upper() for _ in range(6))]
    out = []
    for _ in range(n):
        parts, own = [], []
        for _ in range(r.randint(20, 60)):
            x = r.random()
            if x < 0.03 * base_share:
                own.append(r.choice(base)())
                parts.append(own[-1][1])
            elif x < 0.06:
                own.append(r.choice(wide)())
                parts.append(own[-1][1])
            elif x < 0.15:
                parts.append(r.choice(plain)())
            else:
                parts.append(word())
        out.append((" ".join(parts), own))
    return out


@pytest.mark.parametrize("base_share", [1, 0])
def test_pii_that_base_rules_miss(spark, base_share):
    """Wider forms in prose that no seed is like, in corpora with and without base matches to learn from."""
    docs = prose_with_spans(base_share, 400, base_share)
    got = {r["doc_id"]: r for r in pii.pii_spans(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(docs)], "doc_id long, text string")).collect()}
    found = wanted = right = 0
    for i, (text, own) in enumerate(docs):
        spans = {(s["kind"], text[s["start"] : s["end"]]) for s in got[i]["spans"]}
        found += len(spans)
        wanted += len(set(own))
        right += len(spans & set(own))
    assert wanted > 300 and right > 0.8 * wanted and right > 0.9 * found, (found, wanted, right)


def test_repeated_runs_find_the_same(spark, odd):
    assert same_rows(pii.pii_spans(odd.repartition(3)).drop("row"), pii.pii_spans(odd.repartition(2)).drop("row"))


def test_redacted_with_clashing_columns(spark, odd, crowded, nothing):
    wide = crowded.withColumn("doc", F.lit(1)).withColumn("cuts", F.lit(2)).withColumn("base", F.lit(3))
    out = pii.redacted(wide)
    assert out.columns == wide.columns and same_rows(out.select(*odd.columns), pii.redacted(odd)) and pii.redacted(nothing).count() == 0
