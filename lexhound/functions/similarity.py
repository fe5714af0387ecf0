"""Similarities of two words, from 0 to 1, as columns."""

from __future__ import annotations

from enum import Enum

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Algorithm(Enum):
    HAMMING = "hamming"
    JARO = "jaro"
    EXACT = "exact"

    @classmethod
    def default(cls) -> Algorithm:
        """Of the bare enumeration; the indices have HAMMING as theirs."""
        return cls.JARO

    def similarity(self, a: Column, b: Column) -> Column:
        if self is Algorithm.HAMMING:
            return hamming(a, b)
        if self is Algorithm.JARO:
            return jaro(a, b)
        return F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))


def hamming(a: Column, b: Column) -> Column:
    """1 / (1 + d / shorter length), d: places that differ and what the longer has more; 0 if a word is empty."""
    differs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (~x.eqNullSafe(y)).cast("int"))
    d = F.aggregate(differs, F.lit(0), lambda acc, x: acc + x)
    shorter = F.least(F.char_length(a), F.char_length(b))
    return F.when(shorter == 0, F.lit(0.0)).otherwise(1.0 / (1.0 + d / shorter))


def prefix_rating(extra: Column) -> Column:
    """Of a word that begins with the query word and has extra characters more."""
    return F.when(extra == 0, F.lit(1.0)).otherwise(1.0 / (0.05 * extra + 0.5) - 1.2)


def jaro_of(query: str, words: list[str]) -> np.ndarray:
    """Jaro similarities of one word to many, one step for each of its characters."""
    n, m = len(words), len(query)
    size = np.array([len(w) for w in words], np.int64)
    if not n or not m:
        return np.where(size == m, 1.0, 0.0)
    width = max(1, int(size.max()))
    table = np.zeros((n, width), np.uint32)
    filled = np.arange(width) < size[:, None]
    table[filled] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    chars = np.frombuffer(query.encode("utf-32-le"), np.uint32)
    reach = np.maximum(np.maximum(size, m) // 2 - 1, 0)[:, None]
    place, free, hit = np.arange(width)[None], filled.copy(), np.zeros((n, m), bool)
    rows = np.arange(n)
    for i, c in enumerate(chars):
        fits = (table == c) & free & (np.abs(place - i) <= reach)
        at = fits.argmax(1)
        hit[:, i] = fits[rows, at]
        free[rows[hit[:, i]], at[hit[:, i]]] = False
    matches = hit.sum(1)
    # the matched characters of both, in order
    mine = np.where(np.arange(m) < matches[:, None], chars[np.argsort(~hit, axis=1, kind="stable")], 0)
    used = filled & ~free
    theirs = np.take_along_axis(table, np.argsort(~used, axis=1, kind="stable"), 1)
    k = min(m, width)
    swapped = ((mine[:, :k] != theirs[:, :k]) & (np.arange(k) < matches[:, None])).sum(1) // 2
    some = np.maximum(matches, 1)
    score = (matches / m + matches / np.maximum(size, 1) + (matches - swapped) / some) / 3
    return np.where(matches > 0, score, 0.0)


@F.pandas_udf(T.DoubleType())
def _jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    out = pd.Series(np.nan, index=a.index)
    for query, rows in b.groupby(a, sort=False).groups.items():
        out.loc[rows] = jaro_of(query, b.loc[rows].tolist())
    return out


def jaro(a: Column, b: Column) -> Column:
    """Jaro similarity; a should take few values, for each is compared with all its partners of an Arrow batch at once."""
    return _jaro(a, b)
