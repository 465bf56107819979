"""String similarities: two Arrow-batched kernels and one JVM-side function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel: one integer operation a character of ``b``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        match = state & places.get(c, 0)
        state = (state + match | state - match) & full
    return len(a) - state.bit_count()


def _codes(texts: list[str], lengths: np.ndarray, number: np.ndarray, width: int) -> np.ndarray:
    """Characters of texts by their number in ``number``, from 1 on; 0 behind the ends."""
    flat = np.searchsorted(number, np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)) + 1
    out = np.zeros((len(texts), width), np.uint8 if len(number) < 255 else np.uint32)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def lcs_lengths(a: list[str], b: list[str], most: int = 1 << 13) -> np.ndarray:
    """``lcs_length`` of many pairs at once, where ``a`` has 64 characters at most: one machine word
    a pair, a step a character of ``b``."""
    out = np.zeros(len(a), np.int64)
    m, n = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    width = np.where(m <= 16, 16, np.where(m <= 32, 32, 64))
    order = np.lexsort((n, width))
    cuts = np.flatnonzero(np.diff(width[order], prepend=0))
    for first, last in zip(cuts, [*cuts[1:], len(order)], strict=True):
        for begin in range(first, last, most):
            part = order[begin : min(begin + most, last)]
            bits = int(width[part[0]])
            word = np.dtype(f"uint{bits}")
            left, right = [a[i] for i in part], [b[i] for i in part]
            number = np.unique(np.frombuffer("".join(left + right).encode("utf-32-le", "surrogatepass"), np.uint32))
            x, y = _codes(left, m[part], number, bits), _codes(right, n[part], number, int(n[part].max()))
            full = np.where(m[part] == bits, ~np.uint64(0), (np.uint64(1) << (m[part] % 64).astype(np.uint64)) - np.uint64(1)).astype(word)
            state = full.copy()
            for j in range(y.shape[1]):
                letter = y[:, j : j + 1]
                at = np.packbits(x == np.where(letter > 0, letter, np.iinfo(x.dtype).max), axis=1, bitorder="little").view(word).ravel()
                match = state & at
                state = (state + match | state - match) & full
            out[part] = m[part] - np.bitwise_count(state)
    return out


def indels(a: list[str | None], b: list[str | None]) -> np.ndarray:
    """``indel`` of many pairs, each distinct one once."""
    number: dict[tuple, int] = {}
    which = [number.setdefault(pair, len(number)) for pair in zip(a, b, strict=True)]
    pairs = [(x, y) if len(x or "") <= len(y or "") else (y, x) for x, y in number]
    short = [i for i, (x, y) in enumerate(pairs) if x and y and x != y and len(x) <= 64]
    value = np.zeros(len(pairs))
    if short:
        total = np.array([len(pairs[i][0]) + len(pairs[i][1]) for i in short])
        value[short] = 2.0 * lcs_lengths([pairs[i][0] for i in short], [pairs[i][1] for i in short]) / total
    quick = set(short)
    for i, (x, y) in enumerate(pairs):
        if i not in quick:
            value[i] = indel(x, y)
    return value[which]


def indel(a: str | None, b: str | None) -> float:
    """2 LCS / (length of both), 0 if either is missing or empty."""
    if not a or not b:
        return 0.0
    return 1.0 if a == b else 2.0 * lcs_length(a, b) / (len(a) + len(b))


def jaro_winkler_of(a: str | None, b: str | None) -> float:
    """Jaro similarity with the common-prefix bonus (0.1 a character, 4 at most) from 0.7 up."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                matched.append(c)
                break
    if not matched:
        return 0.0
    other = [c for c, t in zip(b, taken, strict=True) if t]
    m = len(matched)
    swaps = sum(x != y for x, y in zip(matched, other, strict=True)) // 2  # whole pairs
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


def _bits_below(k: np.ndarray) -> np.ndarray:
    """A word with the lowest ``k`` (0 to 64) bits set."""
    return np.where(k >= 64, ~np.uint64(0), (np.uint64(1) << (k % 64).astype(np.uint64)) - np.uint64(1))


def _lowest(word: np.ndarray) -> np.ndarray:
    return word & (~word + np.uint64(1))


def _jaro_winklers(a: list[str], b: list[str]) -> np.ndarray:
    """``jaro_winkler_of`` of pairs of texts of 1 to 64 characters: a text is a machine word, whose
    lowest free bit in reach is the character that a character matches."""
    la, lb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    number = np.unique(np.frombuffer("".join(a + b).encode("utf-32-le", "surrogatepass"), np.uint32))
    x, y = _codes(a, la, number, 64), _codes(b, lb, number, 64)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    taken, hit = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
    for i in range(int(la.max())):
        letter = x[:, i : i + 1]
        at = np.packbits(y == np.where(letter > 0, letter, np.iinfo(x.dtype).max), axis=1, bitorder="little").view(np.uint64).ravel()
        window = _bits_below(np.minimum(lb, i + reach + 1)) & ~_bits_below(np.clip(i - reach, 0, 64))
        free = _lowest(at & window & ~taken)
        taken |= free
        hit |= (free > 0).astype(np.uint64) << np.uint64(i)
    m, rows = np.bitwise_count(hit).astype(np.int64), np.arange(len(a))
    different, left, right = np.zeros(len(a), np.int64), hit.copy(), taken.copy()
    for _ in range(int(m.max())):  # matched characters of both, in order
        p, q = _lowest(left), _lowest(right)
        i, j = (np.minimum(np.bitwise_count(z - np.uint64(1)), 63) for z in (p, q))
        different += (p > 0) & (x[rows, i] != y[rows, j])
        left, right = left ^ p, right ^ q
    some = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / la + m / lb + (m - different // 2) / some) / 3, 0.0)
    prefix, same = np.zeros(len(a), np.int64), np.ones(len(a), bool)
    for k in range(4):
        same &= (x[:, k] == y[:, k]) & (x[:, k] > 0)
        prefix += same
    return np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)


def jaro_winklers(a: list[str | None], b: list[str | None], most: int = 1 << 13) -> np.ndarray:
    """``jaro_winkler_of`` of many pairs, each distinct one once."""
    number: dict[tuple, int] = {}
    which = [number.setdefault(pair, len(number)) for pair in zip(a, b, strict=True)]
    pairs = list(number)
    short = [i for i, (x, y) in enumerate(pairs) if x and y and x != y and len(x) <= 64 and len(y) <= 64]
    value = np.zeros(len(pairs))
    for at in range(0, len(short), most):
        part = short[at : at + most]
        value[part] = _jaro_winklers([pairs[i][0] for i in part], [pairs[i][1] for i in part])
    quick = set(short)
    for i, (x, y) in enumerate(pairs):
        if i not in quick:
            value[i] = jaro_winkler_of(x, y)
    return value[which]


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(indels(a.tolist(), b.tolist()), dtype="float64")


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(jaro_winklers(a.tolist(), b.tolist()), dtype="float64")


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the two strings' sets of characters; 0 if either is empty."""
    set_of = lambda x: F.array_distinct(F.split(x, ""))
    left, right = set_of(a), set_of(b)
    both = F.size(F.array_intersect(left, right))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(both / (F.size(left) + F.size(right) - both))


def length_ratio(a: Column, b: Column) -> Column:
    """Shorter length over longer; 0 if either is empty."""
    x, y = F.length(a), F.length(b)
    return F.when((x == 0) | (y == 0), F.lit(0.0)).otherwise(F.least(x, y) / F.greatest(x, y))


def exact_flag(a: Column, b: Column) -> Column:
    return F.when((a != "") & (a == b), 1).otherwise(0)
