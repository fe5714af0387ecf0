"""Text rules of the engine, on the driver and as columns: what a word is, and how it is normalised."""

from __future__ import annotations

from functools import cache

import numpy as np
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A character that is not part of a word, for Spark: neither alphabetic nor a number, by Unicode.
SEPARATOR = r"[^\p{IsAlphabetic}\p{N}]"
_ALNUM = regex.compile(r"[\p{Alphabetic}\p{N}]")
#: Characters that join two words to a compound.
HYPHENS = "-—–"


def is_alphanumeric(c: str) -> bool:
    return _ALNUM.match(c) is not None


def is_whitespace(c: str) -> bool:
    """White space in queries: the ASCII kinds but for the vertical tab, and the non-breaking space."""
    return c in " \t\n\x0c\r\xa0" and c != ""


def normalize_word(word: str) -> str:
    """Alphanumeric characters only, each in lower case by itself (so no final sigma)."""
    return "".join(c.lower() for c in word if is_alphanumeric(c))


def lower_chars(col: Column) -> Column:
    """Lower case character by character; only words with a capital sigma need more than lower()."""
    by_char = F.array_join(F.transform(F.split(col, ""), F.lower), "")
    return F.when(F.contains(col, F.lit("Σ")), by_char).otherwise(F.lower(col))


def normalize(col: Column) -> Column:
    """normalize_word() of a column."""
    return lower_chars(F.regexp_replace(col, SEPARATOR, ""))


@cache
def alphanumeric_table() -> np.ndarray:
    """By code point, whether it is alphanumeric."""
    table = np.zeros(0x110000, bool)
    for m in regex.finditer(r"[\p{Alphabetic}\p{N}]+", "".join(map(chr, range(0xD800)))):
        table[m.start() : m.end()] = True
    for m in regex.finditer(r"[\p{Alphabetic}\p{N}]+", "".join(map(chr, range(0xE000, 0x110000)))):
        table[m.start() + 0xE000 : m.end() + 0xE000] = True
    return table
