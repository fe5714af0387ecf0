"""Expansion of query words to the vocabulary words that are near them or begin with them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import Algorithm, prefix_rating
from ..functions.text import normalize_word

PROXIMATES = "query_word string, word string, proximity float"


def _literals(words: Sequence[str]) -> Column:
    return F.array(*[F.struct(F.lit(w).alias("query_word"), F.lit(len(w.encode())).alias("bytes"), F.lit(len(w)).alias("chars")) for w in words])


def proximity(query: Column, word: Column, n_bytes: Column, n_chars: Column, algorithm: Algorithm, threshold: float) -> Column:
    """The rating (float) of word for a query word of so many bytes and characters; null if it isn't accepted.

    Below three bytes, the similarity must exceed the threshold. Else a word that begins with the query word is accepted
    whatever its similarity, and others if theirs reaches the threshold. Similarities are compared as 32-bit floats.
    """
    limit = F.lit(threshold).cast("float")
    similarity = algorithm.similarity(query, word).cast("float")
    if algorithm is Algorithm.HAMMING and threshold > 0:
        # what is longer or shorter by more can't reach the threshold; the rest isn't evaluated for it
        gap, shorter = F.abs(F.char_length(word) - n_chars), F.least(F.char_length(word), n_chars)
        similarity = F.when(gap <= shorter * (1 / threshold - 1) + 1e-3, similarity)
    extra = F.char_length(word) - n_bytes
    begins = (extra >= 0) & F.startswith(word, query)
    short = F.when(similarity > limit, similarity)
    long = F.when(begins, prefix_rating(extra).cast("float")).otherwise(F.when(similarity >= limit, similarity))
    return F.when(n_bytes < 3, short).otherwise(long)


def expand(vocabulary: DataFrame, words: Sequence[str], algorithm: Algorithm, threshold: float, first_char_only: bool) -> DataFrame:
    """(query_word, word, proximity) of the words of vocabulary(word) that each of a few query words matches.

    Query words are normalised and those that are equal taken once. With first_char_only, only words of the same first
    character are looked at, which the scan then filters by.
    """
    wanted = list(dict.fromkeys(w for w in map(normalize_word, words) if w))
    if not wanted:
        return vocabulary.sparkSession.createDataFrame([], PROXIMATES)
    if first_char_only:
        # a filter that Parquet's statistics can use, on the vocabulary and, by the join, on postings
        vocabulary = vocabulary.where(reduce(or_, (F.col("word").startswith(c) for c in sorted({w[0] for w in wanted}))))
    met = vocabulary.select(F.explode(_literals(wanted)).alias("q"), "word")
    if first_char_only:
        met = met.where(F.substring("word", 1, 1) == F.substring("q.query_word", 1, 1))
    rated = met.select("q.query_word", "word", proximity(F.col("q.query_word"), F.col("word"), F.col("q.bytes"), F.col("q.chars"), algorithm, threshold).alias("proximity"))
    return rated.where(F.col("proximity").isNotNull())


def proximate_documents(postings: DataFrame, proximates: DataFrame) -> DataFrame:
    """(query_word, doc_id, word, proximity): the documents of each word that a query word was expanded to."""
    return postings.select("word", "doc_id").distinct().join(proximates, "word").select("query_word", "doc_id", "word", "proximity")
