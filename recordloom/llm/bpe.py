"""BPE encoding by a depth-first walk over the trie of distinct words.

The encoding of a word's prefix is decided by its last token and the encoding of what comes before that token, and the
last token is the one that goes together with the token before it, as merging the two alone shows. So a trie node needs
the state of its ancestors only, and words that share a prefix share its states: distinct words are walked in sorted
order with a stack of states, which is the depth-first order of their trie without the trie being built.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import with_package

#: Text bytes of a block at most (a longer text is a block of its own), and words that a worker remembers.
BLOCK, REMEMBERED = 1 << 20, 200_000


class WordBpe:
    """A tokenizer of words that end in a marker, from its JSON description."""

    def __init__(self, description: str):
        spec = json.loads(description)
        model = spec["model"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or not model["end_of_word_suffix"]:
            raise ValueError("not a lower-casing BPE tokenizer with word ends")
        self.end, self.vocab = model["end_of_word_suffix"], dict(model["vocab"])
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (self.vocab | self.special).items()}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        # \s stands for White_Space in the description; here it would also match separators U+001C to U+001F
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}") + "|\n")
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = iter(range(256, 512))
        self.char = {b: chr(b) if b in visible else chr(next(hidden)) for b in range(256)}
        self.byte_chars = [self.char[b] for b in range(256)]
        self.symbols = {i: [*t] for t, i in self.vocab.items() if not t.endswith(self.end)} | {i: [*t[: -len(self.end) - 1], t[-len(self.end) - 1 :]] for t, i in self.vocab.items() if t.endswith(self.end) and len(t) > len(self.end)}
        self.longest = max(map(len, self.symbols.values()))
        self.inner = {t: i for t, i in self.vocab.items() if not t.endswith(self.end)}
        self.final = {t[: -len(self.end)]: i for t, i in self.vocab.items() if t.endswith(self.end)}
        self.together: dict[int, bool] = {}
        self.known: dict[bytes, int] = {}
        self.forget()

    def forget(self) -> None:
        """Drops what was learned: ids and texts of words and chunks, which are known by their number."""
        self.known, self.learned = {}, {}
        self.flat, self.begin, self.lens, self.texts = array("i"), array("q"), array("q"), []
        for t, i in self.special.items():
            self.learned[t] = self._entry([i], t)
        if len(self.together) > 4 * REMEMBERED:
            self.together.clear()

    def _entry(self, ids: list[int], text: str) -> int:
        """The number under which these ids and their text are kept."""
        self.begin.append(len(self.flat))
        self.lens.append(len(ids))
        self.flat.extend(ids)
        self.texts.append(text)
        return len(self.texts) - 1

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE of a few symbols."""
        symbols = list(symbols)
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(pair, 1 << 30), i) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 30:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def fits(self, before: int, token: int) -> bool:
        """Whether token can follow before in an encoding; before is -1 at a word's start."""
        key = before * 65536 + token
        out = self.together.get(key)
        if out is None:
            if before < 0:
                out = self.merged(self.symbols[token]) == [self.token[token]]
            else:
                out = self.merged(self.symbols[before] + self.symbols[token]) == [self.token[before], self.token[token]]
            self.together[key] = out
        return out

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Token ids of distinct words in byte characters."""
        out, states, last, together, longest, inner, final = {}, [(-1, 0)], "", self.together, self.longest, self.inner, self.final
        for word in sorted(words):
            whole = final.get(word)
            if whole is not None and self.fits(-1, whole):
                out[word] = [whole]  # the states stay those of the last word
                continue
            size = len(word)
            shared, most = 0, min(len(last), size - 1, len(states) - 1)
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :]
            # the last token of word[:end] goes together with that of what is before it; at the word's end, tokens are final ones
            table = inner
            for end in range(shared + 1, size + 1):
                if end == size:
                    table = final
                for start in range(end - 1, (end - longest if end > longest else 0) - 1, -1):
                    token = table.get(word[start:end])
                    if token is not None:
                        before = states[start][0]
                        fits = together.get(before * 65536 + token)
                        if fits or fits is None and self.fits(before, token):
                            states.append((token, end - start))
                            break
                else:
                    raise ValueError(f"no token ends at {end} in {word!r}")
            ids, at = [], size
            while at:
                token, n = states[at]
                ids.append(token)
                at -= n
            ids.reverse()
            out[word] = ids
            states.pop()  # its last token was a final one
            last = word
        return out

    def _learn(self, chunks: set[bytes]) -> None:
        """Remembers the ids of chunks, which are texts without ASCII white space."""
        # chunks of ASCII letters are a word each; the others are cut into words
        plain = [c for c in chunks if c.isalpha()]
        words = b"\n".join(plain).lower().decode().split("\n") if plain else []
        chunks = [c for c in chunks if not c.isalpha()]
        joined = b"\n".join(chunks).decode()
        pieces = self.special_at.split(joined) if "<|" in joined else [joined]
        found: list[list] = [[]]
        for i, piece in enumerate(pieces):
            if i % 2:
                found[-1].append(piece)
                continue
            for word in self.words.findall(unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()):
                if word == "\n":
                    found.append([])
                else:
                    found[-1].append(word)
        learned, known, chars, token = self.learned, self.known, self.byte_chars, self.token
        flat, begin, lens, texts = self.flat, self.begin, self.lens, self.texts
        new = set(words).union(*found).difference(learned)
        spelled = {w: w if w.isascii() and w.isprintable() else "".join([chars[b] for b in w.encode()]) for w in new}
        encoded = self.encode_words(list(spelled.values()))
        for w, own in spelled.items():
            ids = encoded[own]
            learned[w] = len(texts)
            begin.append(len(flat))
            lens.append(len(ids))
            flat.extend(ids)
            texts.append(token[ids[0]] if len(ids) == 1 else " ".join([token[i] for i in ids]))
        known.update(zip(plain, map(learned.__getitem__, words), strict=True))
        for chunk, own in zip(chunks, found if chunks else (), strict=True):
            if len(own) == 1:
                known[chunk] = learned[own[0]]
                continue
            known[chunk], at = len(texts), len(flat)
            parts = [learned[w] for w in own]
            for p in parts:
                flat.extend(flat[begin[p] : begin[p] + lens[p]])
            begin.append(at)
            lens.append(len(flat) - at)
            texts.append(" ".join([texts[p] for p in parts]))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts, where each text's begin (and the last one's end), and the texts decoded from them."""
        split = [t.split() for t in texts]
        if len(self.known) > REMEMBERED:
            self.forget()
        new = set().union(*split).difference(self.known)
        if new:
            self._learn(new)
        # views, not copies; they are gone before the arrays grow again
        flat, begin, lens = (np.frombuffer(x, t) for x, t in ((self.flat, np.int32), (self.begin, np.int64), (self.lens, np.int64)))
        get, words = self.known.__getitem__, self.texts.__getitem__
        places = [[*map(get, s)] for s in split]
        decoded = [" ".join(filter(None, map(words, own))) for own in places]
        ends = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
        chunk = np.fromiter(chain.from_iterable(places), np.int64, int(ends[-1]))
        own = lens[chunk]
        at = np.cumsum(own) - own
        ids = flat[np.repeat(begin[chunk] - at, own) + np.arange(int(own.sum()))]
        return ids, np.concatenate([at, [len(ids)]])[ends], decoded


@cache
def _tokenizer(description: str) -> WordBpe:
    return WordBpe(description)


def _encode(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches):
        bpe = _tokenizer(shared.value)

        def out(rows):
            ids, offsets, decoded = bpe.encode([t for _, t in rows])
            return pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)), pa.array(decoded, pa.string())], schema=schema)

        rows, held = [], 0
        try:
            for batch in batches:
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                    rows.append((i, text.as_py() or b""))
                    held += len(rows[-1][1])
                    if held >= BLOCK:
                        yield out(rows)
                        rows, held = [], 0
            if rows:
                yield out(rows)
        finally:
            bpe.forget()  # the worker goes on to other tasks, and perhaps to none that needs its memory

    return run


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) for every row of docs (doc_id, text): token ids, and the text decoded from them.

    path is the tokenizer's JSON file, which the driver reads and broadcasts. Special tokens' strings in a text become
    their ids. Null and empty texts have no ids; repeated rows stand for themselves; an empty table gives an empty
    result.
    """
    with_package(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encode(shared), "doc_id long, ids array<int>, decoded string")
