"""Documents to words with UTF-8 byte offsets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import HYPHENS, alphanumeric_table, normalize_word

#: Bytes of text that one vectorised step holds.
CHUNK_BYTES = 1 << 20


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and its n + 1 offsets."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def scan(data: np.ndarray, at: np.ndarray, compounds: bool, strict_offsets: bool):
    """Words of texts: the text's number, first byte and end in data, start within the text, and whether it is a compound.

    A word is a run of alphanumeric characters. Two words with a single hyphen or dash between them also make a compound,
    unless the second one ends the text.
    """
    raw = data.tobytes()
    cp = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    alnum = alphanumeric_table()[cp]
    first = np.zeros(len(cp) + 1, bool)  # code points that begin a text; the end counts as one
    first[np.searchsorted(place, at)] = True
    begins = alnum & ~(np.append(False, alnum[:-1]) & ~first[:-1])
    ends = alnum & ~(np.append(alnum[1:], False) & ~first[1:])
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(at, place[s], side="right") - 1
    start = place[s] - at[doc]
    if not strict_offsets:  # a word that ends its text is said to start at the end
        last = first[e]
        start = np.where(last, at[doc + 1] - at[doc], start)
    a, b, flag = place[s], place[e], np.zeros(len(s), bool)
    if compounds and len(s) > 1:
        gap = s[1:] - e[:-1] == 1
        between = cp[np.minimum(e[:-1], len(cp) - 1)]
        joined = gap & (doc[1:] == doc[:-1]) & np.isin(between, [ord(c) for c in HYPHENS]) & ~first[e[1:]]
        k = np.flatnonzero(joined)
        doc, a, b = np.append(doc, doc[k]), np.append(a, place[s[k]]), np.append(b, place[e[k + 1]])
        start, flag = np.append(start, start[k]), np.append(flag, np.ones(len(k), bool))
    return doc, a, b, start, flag


def _chunks(at: np.ndarray):
    i, n = 0, len(at) - 1
    while i < n:
        j = min(max(int(np.searchsorted(at, at[i] + CHUNK_BYTES, side="right")) - 1, i + 1), n)
        yield i, j
        i = j


def _words(part: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """The strings from byte a to byte b of each word."""
    n = b - a
    upto = np.concatenate([[0], np.cumsum(n)])
    chars = part[np.repeat(a - upto[:-1], n) + np.arange(upto[-1])] if len(n) else part[:0]
    return pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(upto.astype(np.int32).tobytes()), pa.py_buffer(chars.tobytes())])


def _normalized(words: pa.Array, part: np.ndarray, compound: np.ndarray) -> pa.Array:
    """Words in lower case, compounds without their hyphen."""
    if compound.any():
        bare = words.filter(pa.array(compound))
        for c in HYPHENS:
            bare = pc.replace_substring(bare, c, "")
        words = pc.replace_with_mask(words, pa.array(compound), bare)
    if "İ".encode() in part.tobytes():  # the one letter that takes two in lower case
        return pa.array([normalize_word(w) for w in words.to_pylist()], pa.string())
    return pc.utf8_lower(words)


def _scanned(docs: DataFrame, keep: Sequence[str], text_col: str, compounds: bool, strict_offsets: bool, fields: list[T.StructField], make) -> DataFrame:
    """keep columns of docs and fields, of what make gives for each chunk: the rows' texts by number, and the fields' arrays.

    An Arrow pass over whole texts without a shuffle: Spark's own functions find words, but their offsets only by a
    running sum, which as a window would sort every word of the corpus by document.
    """
    source = docs.select(*(F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(keep)), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([*source.schema.fields[:-1], *fields])
    names = [f.name for f in schema]

    def run(batches):
        for batch in batches:
            data, at = _buffers(batch.column(len(keep)))
            for i, j in _chunks(at):
                part = data[at[i] : at[j]]
                if len(part):
                    doc, arrays = make(part, *scan(part, at[i : j + 1] - at[i], compounds, strict_offsets))
                    rows = pa.array(doc + i)
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(len(keep))), *arrays], names)

    got = source.mapInArrow(run, schema)
    return got.select(*(F.col(f"k{n}").alias(c) for n, c in enumerate(keep)), *(f.name for f in fields))


_START = T.StructField("start", T.IntegerType())
_COMPOUND = T.StructField("is_compound", T.BooleanType())


def raw_tokens(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text", compounds: bool = True, strict_offsets: bool = True) -> DataFrame:
    """keep columns of docs, raw (the word as it is in the text), start, is_compound."""

    def make(part, doc, a, b, start, flag):
        return doc, [_words(part, a, b), pa.array(start.astype(np.int32)), pa.array(flag)]

    return _scanned(docs, keep, text_col, compounds, strict_offsets, [T.StructField("raw", T.StringType()), _START, _COMPOUND], make)


def tokenize(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text", compounds: bool = True, strict_offsets: bool = True) -> DataFrame:
    """keep columns, word (normalised), start (UTF-8 byte offset), is_compound of every word of every whole text.

    Compounds are indexed as both words together (`next-gen` also as nextgen); pairs only, and not one that ends the text.
    strict_offsets=False gives a word that ends its text without a separator the text's length as its start.
    """

    def make(part, doc, a, b, start, flag):
        return doc, [_normalized(_words(part, a, b), part, flag), pa.array(start.astype(np.int32)), pa.array(flag)]

    return _scanned(docs, keep, text_col, compounds, strict_offsets, [T.StructField("word", T.StringType()), _START, _COMPOUND], make)


def document_words(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text", compounds: bool = True, strict_offsets: bool = True) -> DataFrame:
    """keep columns, word, positions (array<int>, in order) of every different word of each document: tokenize(), grouped within the pass."""

    def make(part, doc, a, b, start, flag):
        coded = _normalized(_words(part, a, b), part, flag).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((start, code, doc))
        doc, code, start = doc[order], code[order], start[order]
        fresh = np.ones(len(order), bool)  # not the same place again
        fresh[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1]) | (start[1:] != start[:-1])
        doc, code, start = doc[fresh], code[fresh], start[fresh]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
        first = np.flatnonzero(new)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), pa.array(start.astype(np.int32)))
        return doc[first], [coded.dictionary.take(pa.array(code[first])), lists]

    fields = [T.StructField("word", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))]
    return _scanned(docs, keep, text_col, compounds, strict_offsets, fields, make)
