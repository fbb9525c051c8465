"""Weighted fuzzy ratio of two texts, from 0 to 100: for discovery, never for identity.

The published definition: ratio is 100 times twice the longest common subsequence over both lengths; the token forms sort
the words, or set common words against the rest; partial forms take the best place of the shorter text in the longer.
Texts of like length (under 1.5) take the better of ratio and 0.95 of the token form; others also 0.9 of the partial forms
(0.6 from a length ratio of 8 on). Texts are compared as they are, case included.

The longest common subsequence is counted with one big integer per text (a bit per position), so a pair costs one pass
over the shorter text. Pairs come in Arrow batches; equal names of a batch are scored once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: fixed values: weights of the token and partial forms, and the length ratios at which they change
TOKENS, PARTIAL, FAR = 0.95, 0.9, 0.6
LIKE, LONG = 1.5, 8.0


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << i)
    every = (1 << len(a)) - 1
    state = every
    for c in b:
        hit = state & places.get(c, 0)
        state = ((state + hit) | (state - hit)) & every
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    return 200 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text to a stretch of the longer: of its own length, or shorter at either end."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0
    n = len(a)
    if len(a) == len(b) and a == b:
        return 100.0
    letters = set(a)
    # A stretch that ends (or, at the far end, begins) with a letter of no use is never the best.
    stretches = {b[:i] for i in range(1, n) if b[i - 1] in letters} | {b[i : i + n] for i in range(len(b) - n + 1) if b[i + n - 1] in letters} | {b[i:] for i in range(len(b) - n, len(b)) if b[i] in letters}
    best = max((ratio(a, s) for s in stretches), default=0.0)
    if len(a) == len(b) and best < 100:
        best = max(best, max((ratio(b, s) for s in ({a[:i] for i in range(1, n)} | {a[i:] for i in range(n)})), default=0.0))
    return best


def tokens(text: str) -> tuple[list[str], set[str]]:
    words = text.split()
    return sorted(words), set(words)


def token_ratio(a: str, b: str) -> float:
    """The better of the ratios of sorted words and of common words against each side's."""
    (sa, wa), (sb, wb) = tokens(a), tokens(b)
    both, left, right = sorted(wa & wb), sorted(wa - wb), sorted(wb - wa)
    if both and (not left or not right):
        return 100.0
    best = ratio(" ".join(sa), " ".join(sb))
    if not wa or not wb:
        return best
    shared, one, two = " ".join(both), " ".join(left), " ".join(right)
    if shared:
        x, y = f"{shared} {one}", f"{shared} {two}"
        return max(best, ratio(x, y), ratio(shared, x), ratio(shared, y))
    return max(best, ratio(one, two))


def partial_token_ratio(a: str, b: str) -> float:
    (sa, wa), (sb, wb) = tokens(a), tokens(b)
    if wa & wb:
        return 100.0
    best = partial_ratio(" ".join(sa), " ".join(sb))
    one, two = sorted(wa - wb), sorted(wb - wa)
    return best if one == sa and two == sb else max(best, partial_ratio(" ".join(one), " ".join(two)))


def weighted(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    far = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if far < LIKE:
        return max(best, TOKENS * token_ratio(a, b))
    scale = PARTIAL if far < LONG else FAR
    return max(best, scale * partial_ratio(a, b), TOKENS * scale * partial_token_ratio(a, b))


@F.pandas_udf(DoubleType())
def _weighted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        pairs = list(zip(a, b))
        known = {p: round(weighted(*p), 2) for p in set(pairs)}
        yield pd.Series([known[p] for p in pairs], dtype="float64")


def weighted_ratio(a: Column, b: Column) -> Column:
    return _weighted(a, b)
