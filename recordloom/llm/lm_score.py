"""Language-model scores from a log-frequency Bloom filter (Talbot and Osborne, 2007).

Documents are dealt to blocks, and the distinct words and word pairs of every block go to segments of the hash space. A
segment adds up the counts of its n-grams and holds them in a filter: an n-gram is in it once for every step of a
logarithmic scale that its count reaches, from 1 on; probing step after step until one fails gives the count back,
quantised (10 bits and 4 probes a step: 1.2 % false positives). The segment probes its filter for the n-grams of every
block and sends the steps back to the block, where the documents are scored. So every n-gram of the training documents
is in a filter, the filters grow with the distinct n-grams, and a worker holds one segment or one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import with_package
from .common import LOWER, written

BITS_PER_STEP, PROBES = 10, 4
#: Text bytes of a block of documents, which is scored at once; a longer text is in one block all the same.
BLOCK_BYTES = 4 << 20
#: Text bytes behind a segment of the hash space, and the most segments.
SEGMENT_BYTES, MAX_SEGMENTS = 8 << 20, 1 << 16
_U = np.uint64
_MIX, _POLY, _STEP = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)
_END, _START, _WORD = _U(0x1B873593CC9E2D51), _U(0x85EBCA6BC2B2AE35), _U(0xE7037ED1A0B428DB)

#: The scale: counts that are told apart.
SCALE = [1]
while SCALE[-1] < 1 << 50:
    SCALE.append(max(SCALE[-1] + 1, SCALE[-1] * 3 // 2))
SCALE = np.array(SCALE, np.int64)
#: What a count is taken for, by the number of steps reached from 1.
VALUE = np.concatenate([[0.0], (SCALE[:-1] + SCALE[1:] - 1) / 2, [float(SCALE[-1])]])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _MIX
    return x ^ (x >> _U(29))


def token_hashes(text: bytes) -> np.ndarray:
    words = text.translate(LOWER).split()
    out = np.empty(len(words) + 1, _U)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    out[-1] = _END
    return out


def _groups(batches, key: int):
    """(key, rows) of rows that come sorted by their column number key."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[key] != now and rows:
                yield now, rows
                rows = []
            now = row[key]
            rows.append(row)
    if rows:
        yield now, rows


def _grams(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, pairs with the token before, where documents begin, and their tokens."""
    sizes = np.array([len(t) for t in texts], np.int64)
    at = np.cumsum(sizes) - sizes
    tokens = np.concatenate(texts)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[at] = _START
    return tokens, _mix(before * _POLY ^ tokens), at, sizes


def _dealt(grams: np.ndarray, log_segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of sorted n-grams, ascending, the order that sorts them so, and where segments begin."""
    segment = (_mix(grams) >> _U(64 - log_segments)).astype(np.int32) if log_segments else np.zeros(len(grams), np.int32)
    order = np.argsort(segment, kind="stable")
    segment = segment[order]
    return segment, order, np.concatenate([[0], np.flatnonzero(np.diff(segment)) + 1])


def _count(log_segments: int):
    """Rows (block, held_out, text) of a block, which come together, become its distinct n-grams by segment, with the times they are in training documents."""
    schema = pa.schema([("block", pa.int32()), ("pairs", pa.bool_()), ("segment", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for block, rows in _groups(batches, 0):
            tokens, pairs, _, sizes = _grams([token_hashes(text.encode()) for _, _, text in rows])
            train = np.repeat([not held for _, held, _ in rows], sizes)
            for kind, grams in ((False, tokens), (True, pairs)):
                found, which = np.unique(grams, return_inverse=True)
                counts = np.bincount(which[train], minlength=len(found)).astype(np.int64)
                segment, order, starts = _dealt(found, log_segments)
                found, counts, ends = found[order], counts[order], np.append(starts[1:], len(found))
                for a in range(0, len(starts), 1024):
                    pick = list(zip(starts[a : a + 1024], ends[a : a + 1024], strict=True))
                    # most counts fit a byte
                    small = [counts[s:e].astype(np.uint8 if counts[s:e].max() < 256 else np.int64).tobytes() for s, e in pick]
                    yield pa.record_batch([pa.array([block] * len(pick), pa.int32()), pa.array([kind] * len(pick)), pa.array([segment[s] for s, _ in pick], pa.int32()), pa.array([found[s:e].tobytes() for s, e in pick], pa.binary()), pa.array(small, pa.binary())], schema=schema)

    return run


def _probe_bits(h: np.ndarray, step: np.ndarray | np.uint64, bits: np.ndarray | np.uint64):
    x = _mix(h + _STEP * (step + _U(1)))
    y = _mix(x ^ _POLY) | _U(1)
    for i in range(PROBES):
        yield (x + y * _U(i)) % bits


def build_filter(hashes: np.ndarray, counts: np.ndarray, most_bytes: int) -> tuple[int, int, bytes]:
    """(first step, bits, filter) of n-grams with their counts."""
    reached = np.searchsorted(SCALE, counts, side="right")
    tally = np.bincount(reached, minlength=len(SCALE) + 1)
    first = 0
    while first < len(SCALE) - 1:
        steps = int((np.maximum(np.arange(len(tally)) - first, 0) * tally).sum())
        if steps * BITS_PER_STEP <= most_bytes * 8:
            break
        first += 1
    size = min(most_bytes, steps * BITS_PER_STEP // 8 + 8)
    flags = np.zeros(size * 8, bool)
    for step in range(first, int(reached.max(initial=0))):
        for at in _probe_bits(hashes[reached > step], np.full(1, step, _U), _U(size * 8)):
            flags[at] = True
    return first, size * 8, np.packbits(flags, bitorder="little").tobytes()


class Filter:
    """Filters of segments, as they are probed. Segments are by the mixed hash, as counts are gathered."""

    def __init__(self, log_segments: int, parts: Iterable[tuple[int, int, int, bytes]], most_bytes: int):
        """parts, of most_bytes together at most, are taken one after the other."""
        n = 1 << log_segments
        self.shift, self.at, self.bits, self.first = log_segments, np.zeros(n, np.int64), np.zeros(n, _U), np.zeros(n, np.int64)
        data, at = np.zeros(most_bytes, np.uint8), 0
        for segment, first, bits, flags in parts:
            self.at[segment], self.bits[segment], self.first[segment] = at * 8, bits, first
            data[at : at + len(flags)] = np.frombuffer(flags, np.uint8)
            at += len(flags)
        self.data = data[:at].copy()

    def reached(self, grams: np.ndarray, words: bool) -> np.ndarray:
        """The steps that the counts of distinct n-grams reach."""
        h = _mix(grams ^ _WORD) if words else grams
        segment = (_mix(grams) >> _U(64 - self.shift)).astype(np.int64) if self.shift else np.zeros(len(grams), np.int64)
        bits, at, first = self.bits[segment], self.at[segment], self.first[segment]
        reached = np.zeros(len(grams), np.int64)
        alive, step = np.flatnonzero(bits > 0), first
        while len(alive):
            alive = alive[step[alive] < len(SCALE)]
            hit = np.ones(len(alive), bool)
            for pos in _probe_bits(h[alive], step[alive].astype(_U), bits[alive]):
                pos = pos.astype(np.int64) + at[alive]
                hit &= (self.data[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1 > 0
            alive = alive[hit]
            step[alive] += 1
            reached[alive] = step[alive]
        return reached

    def counts(self, grams: np.ndarray, words: bool) -> np.ndarray:
        """Quantised counts of distinct n-grams."""
        return VALUE[self.reached(grams, words)]


def _probe():
    """Rows of a segment, which come together, are answered: the step that each n-gram reaches in the segment's filter, and the exact counts of words."""
    schema = pa.schema([("block", pa.int32()), ("pairs", pa.bool_()), ("segment", pa.int32()), ("steps", pa.binary()), ("exact", pa.binary()), ("n_types", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        for segment, rows in _groups(batches, 2):
            kinds = {}
            for kind in (False, True):
                own = [(block, np.frombuffer(h, _U), c) for block, pairs, _, h, c in rows if pairs == kind]
                if own:
                    counts = np.concatenate([np.frombuffer(c, np.uint8 if len(c) == len(h) else np.int64).astype(np.int64) for _, h, c in own])
                    grams, which = np.unique(np.concatenate([h for _, h, _ in own]), return_inverse=True)
                    total = np.zeros(len(grams), np.int64)
                    np.add.at(total, which, counts)
                    kinds[kind] = own, grams, which, total
            hashes = np.concatenate([grams[total > 0] if kind else _mix(grams[total > 0] ^ _WORD) for kind, (_, grams, _, total) in kinds.items()])
            counts = np.concatenate([total[total > 0] for _, _, _, total in kinds.values()])
            # as large as its n-grams need
            first, bits, flags = build_filter(hashes, counts, (len(SCALE) * len(hashes) + 1) * BITS_PER_STEP)
            flt = Filter(0, [(0, first, bits, flags)], len(flags))
            for kind, (own, grams, which, total) in kinds.items():
                steps, exact = flt.reached(grams, not kind).astype(np.uint8)[which], b"" if kind else total[which]
                ends = np.cumsum([len(h) for _, h, _ in own])
                n, cuts = len(own), list(zip(np.append(0, ends[:-1]), ends, strict=True))
                known = [0, 0] if kind else [int((total > 0).sum()), int(total.sum())]
                yield pa.record_batch([pa.array([block for block, _, _ in own], pa.int32()), pa.array([kind] * n), pa.array([segment] * n, pa.int32()), pa.array([steps[s:e].tobytes() for s, e in cuts], pa.binary()), pa.array([None if kind else exact[s:e].tobytes() for s, e in cuts], pa.binary()), *[pa.array([x] + [0] * (n - 1), pa.int64()) for x in known]], schema=schema)

    return run


def _score(log_segments: int, n_docs: float, total: float, pull: float):
    """Rows of a block, which come together and by segment: answers (pairs, steps, exact), and documents (doc_id, held_out, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches):
        for _, rows in _groups(batches, 0):
            docs = [r for r in rows if r[1]]
            tokens, pairs, at, sizes = _grams([token_hashes(r[-1].encode()) for r in docs])

            def answered(grams, kind, column, dtype):
                found, which = np.unique(grams, return_inverse=True)
                out = np.empty(len(found), dtype)
                out[_dealt(found, log_segments)[1]] = np.frombuffer(b"".join(r[column] for r in rows if not r[1] and r[2] == kind), dtype)  # noqa: B023
                return out[which]

            own = VALUE[answered(tokens, False, 4, np.uint8)]
            before = np.empty_like(own)
            before[1:] = own[:-1]
            before[at] = n_docs
            both = np.minimum(VALUE[answered(pairs, True, 4, np.uint8)], before)
            p = (both + pull * (own + 0.1) / total) / (before + pull)
            exact = answered(tokens, False, 5, np.int64)
            base = np.add.reduceat(np.log10(exact + 0.1), at) - sizes * np.log10(total)
            yield pa.record_batch([pa.array([r[6] for r in docs], pa.int64()), pa.array([r[7] for r in docs], pa.bool_()), pa.array(sizes), pa.array(np.add.reduceat((exact > 0).astype(np.int64), at)), pa.array(base), pa.array(np.add.reduceat(np.log10(p), at))], schema=schema)

    return run


def lm_scores(docs: DataFrame, pull: float = 100.0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, text).

    Tokens are lower-cased words, then an end; documents whose crc32(doc_id as text) is divisible by 10 are held out
    of the counts. base_score is the add-0.1 word model on exact counts; score is the log10 probability by the filter's
    word pairs, drawn towards its words as by pull more occurrences. Words are known by 64-bit hashes. Null texts are
    empty, a null doc_id counts as an empty string (held out), repeated rows each count, and an empty table gives an
    empty result.
    """
    with_package(docs.sparkSession)
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size, n_docs = docs.agg(F.sum(F.octet_length("text")), F.count(F.when(~F.col("held_out"), 1))).first()
    log = min((max(size or 0, 1) // SEGMENT_BYTES).bit_length() + 3, MAX_SEGMENTS.bit_length() - 1)
    # by content, so that both times it is dealt a block has the same rows
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit((size or 0) // BLOCK_BYTES + 1)).cast("int"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    grams = docs.select("block", "held_out", "text").repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_count(log), "block int, pairs boolean, segment int, hashes binary, counts binary")
    answers = grams.repartition(parts, "segment").sortWithinPartitions("segment").mapInArrow(_probe(), "block int, pairs boolean, segment int, steps binary, exact binary, n_types long, n_tokens long")
    answers = written(answers, "counts")
    n_types, n_tokens = answers.agg(F.coalesce(F.sum("n_types"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    total = n_tokens + 0.1 * (n_types + 1)
    columns = ["block", "is_doc", "pairs", "segment", "steps", "exact", "doc_id", "held_out", "text"]
    rows = answers.withColumn("is_doc", F.lit(False)).select(*columns[:6], F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("string").alias("text"))
    none = F.lit(None)
    rows = rows.union(docs.select("block", F.lit(True), none.cast("boolean"), none.cast("int"), none.cast("binary"), none.cast("binary"), "doc_id", "held_out", "text"))
    rows = rows.repartition(parts, "block").sortWithinPartitions("block", "is_doc", "pairs", "segment", "doc_id")
    scored = rows.mapInArrow(_score(log, float(n_docs), float(total), pull), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n_tokens)).cast("long").alias("train_tokens"), "base_score", "score")
