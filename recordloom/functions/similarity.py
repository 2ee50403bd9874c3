"""String similarity that Spark lacks, in Arrow batches: normalised indel similarity, and difflib's ratio."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word or big integer of rows at a time (Hyyrö 2004)."""
    if len(a) < len(b):
        a, b = b, a
    places = char_places(b)
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths; 1 for two empty strings."""
    n = len(a) + len(b)
    return 2 * lcs_length(a, b) / n if n else 1.0


def char_places(b: str) -> dict[str, int]:
    """For each character the bits of its places in b."""
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    return places


def prefix_lcs(places: dict[str, int], size: int, a: str, ends: list[int]) -> list[int]:
    """lcs_length of the prefixes of a that end at ends, in ascending order, and the string of size that places are of."""
    full = (1 << size) - 1
    row, at, out = full, 0, []
    for end in ends:
        for c in a[at:end]:
            if c in places:
                hit = row & places[c]
                row = ((row + hit) | (row - hit)) & full
        at = end
        out.append(size - row.bit_count())
    return out


#: Ratios of pairs of tokens that have been compared, and counts of the characters of tokens by their code modulo 32:
#: texts of a language share most. Both are emptied at so many.
_ratios: dict[tuple[str, str], float] = {}
_letters: dict[str, np.ndarray] = {}
KNOWN_PAIRS, KNOWN_TOKENS, CELLS = 100_000, 20_000, 1 << 22


def _letter_counts(tokens: list[str]) -> np.ndarray:
    if len(_letters) > KNOWN_TOKENS:
        _letters.clear()
    return np.stack([_letters.setdefault(t, np.bincount([ord(c) % 32 for c in t], minlength=32).astype("int32")) if t not in _letters else _letters[t] for t in tokens])


def alike(query: list[str], heard: set[str], least: float = 0.72) -> dict[str, list[tuple[int, float]]]:
    """For heard tokens the places and similarities of the other query tokens that soft_matches counts them for.

    Two tokens have no more in common than the characters of both, which rules out most pairs without a comparison."""
    asked = [i for i, t in enumerate(query) if len(t) >= 4]
    others = [t for t in heard if len(t) >= 2]
    out: dict[str, list[tuple[int, float]]] = {}
    if not asked or not others:
        return out
    have, m = _letter_counts(others), np.array([len(t) for t in others])
    step = max(1, CELLS // have.size)
    for at in range(0, len(asked), step):
        some = asked[at : at + step]
        n = np.array([len(query[i]) for i in some])[:, None]
        fits = (np.abs(m - n) <= np.maximum(2, n // 3)) & (2 * np.minimum(_letter_counts([query[i] for i in some])[:, None, :], have).sum(axis=2) >= least * (n + m) - 1e-9)
        for i, j in np.argwhere(fits).tolist():
            token, t = query[some[i]], others[j]
            if token == t:
                continue
            ratio = _ratios.get((token, t))
            if ratio is None:
                if len(_ratios) >= KNOWN_PAIRS:
                    _ratios.clear()
                ratio = _ratios[token, t] = indel_ratio(token, t)
            if ratio >= least:
                out.setdefault(t, []).append((some[i], ratio))
    return out


def soft_matches(query: list[str], heard: list[str], least: float = 0.72) -> list[float]:
    """For every query token 1 if it was heard, else the best similarity to a heard token of about its length, from least on."""
    out = [1.0 if t in set(heard) else 0.0 for t in query]
    for near in alike(query, set(heard), least).values():
        for i, ratio in near:
            out[i] = max(out[i], ratio)
    return out


@cache
def _udfs():
    @F.pandas_udf("double")
    def indel(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    @F.pandas_udf("double")
    def difflib(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    return indel, difflib


def indel(a: Column, b: Column) -> Column:
    return _udfs()[0](a, b)


def difflib_ratio(a: Column, b: Column) -> Column:
    return _udfs()[1](a, b)
