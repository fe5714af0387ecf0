"""Occurrences of words in documents: grouping, pairing and rating.

A hit is a row (doc_id, start, word_id, rating, occurrences, closest_not): occurrences is the sorted, distinct array of
all places (start, word_id) that it groups, its own included; closest_not the place of the nearest negated word, or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sets import progressive

PLACE = "struct<start:int,word_id:int>"
HITS = f"doc_id long, start int, word_id int, rating double, occurrences array<{PLACE}>, closest_not {PLACE}"
#: Orders hits of one start.
_TIE = ("word_id", "rating", "occurrences")


def place(start: Column, word_id: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), word_id.cast("int").alias("word_id"))


def word_rating(proximity: Column) -> Column:
    """What an occurrence of a word of that proximity to the query word is rated."""
    return (proximity.cast("double") - 1) * 4


def leaf_hits(found: DataFrame, word_id: int, distance_threshold: int | None) -> DataFrame:
    """Hits of (doc_id, word, start, rating), the occurrences of one query word, with near ones merged."""
    hits = found.withColumn("word_id", F.lit(word_id))
    own = place(F.col("start"), F.col("word_id"))
    if distance_threshold is None:
        merged = hits.withColumn("occurrences", F.array(own))
    else:
        merged = _merge_near(hits, distance_threshold, own)
    return merged.select("doc_id", "start", "word_id", "rating", "occurrences", F.lit(None).cast(PLACE).alias("closest_not"))


def _merge_near(hits: DataFrame, distance_threshold: int, own: Column) -> DataFrame:
    """Runs of a document's hits, in order of word and start, each at most the threshold from the one before, become one.

    The first stays, is rated 2 higher and takes the second's place with it; the others go.
    """
    in_order = Window.partitionBy("doc_id").orderBy("word", "start")
    gap = F.abs(F.col("start") - F.lag("start").over(in_order))
    next_gap = F.abs(F.lead("start").over(in_order) - F.col("start"))
    marked = hits.select(
        "doc_id", "start", "word_id", "rating", own.alias("own"),
        F.coalesce(gap <= distance_threshold, F.lit(False)).alias("follows"),
        F.coalesce(next_gap <= distance_threshold, F.lit(False)).alias("leads"),
        F.lead(own).over(in_order).alias("second"),
    )
    first = marked.where(~F.col("follows"))
    return first.select(
        "doc_id", "start", "word_id",
        F.when(F.col("leads"), F.col("rating") + 2.0).otherwise(F.col("rating")).alias("rating"),
        F.when(F.col("leads"), F.array_sort(F.array_distinct(F.array("own", "second")))).otherwise(F.array("own")).alias("occurrences"),
    )


def _merged(left: Column, right: Column) -> Column:
    """The left hit with the places of both; its rating and main place stay."""
    return F.struct(
        left["doc_id"].alias("doc_id"), left["start"].alias("start"), left["word_id"].alias("word_id"), left["rating"].alias("rating"),
        F.array_sort(F.array_distinct(F.concat(left["occurrences"], right["occurrences"]))).alias("occurrences"), left["closest_not"].alias("closest_not"),
    )


def and_hits(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each left hit with the first right one at or after it, and each right hit with the first left one after it; the rest goes."""
    met = progressive(left, right, "doc_id", "start", _TIE).where(F.col("ahead").isNotNull())
    pair = F.when(F.col("is_left"), _merged(F.col("own"), F.col("ahead"))).otherwise(_merged(F.col("ahead"), F.col("own")))
    return met.select(pair.alias("hit")).select("hit.*")


def or_hits(left: DataFrame, right: DataFrame) -> DataFrame:
    """As and_hits(), but hits with nothing ahead of them stay as they are."""
    met = progressive(left, right, "doc_id", "start", _TIE)
    pair = F.when(F.col("ahead").isNull(), F.col("own")).when(F.col("is_left"), _merged(F.col("own"), F.col("ahead"))).otherwise(_merged(F.col("ahead"), F.col("own")))
    return met.select(pair.alias("hit")).select("hit.*")


def and_not_hits(left: DataFrame, negated: DataFrame) -> DataFrame:
    """Every left hit: rated 2.5 higher in documents without a negated hit, else lower, the more so the nearer that is.

    The nearest negated hit is that whose start is nearest to the hit's, of two alike the later. The distance that counts
    is that of its start to any place of the hit.
    """
    last = F.max_by(F.struct(*negated.columns), F.struct(*_TIE))
    single = negated.groupBy("doc_id", "start").agg(last.alias("kept")).select("kept.*")
    met = progressive(left, single, "doc_id", "start", _TIE).where("is_left")
    back, ahead = F.col("start") - F.col("behind.start"), F.col("ahead.start") - F.col("start")
    near = F.when(F.col("ahead").isNotNull() & (F.col("behind").isNull() | (ahead <= back)), F.col("ahead")).otherwise(F.col("behind"))
    met = met.select("own", near.alias("near"))
    distance = F.array_min(F.transform(F.col("own.occurrences"), lambda o: F.abs(o["start"] - F.col("near.start"))))
    loss = 1.0 / (0.0001 * distance + 0.025) + F.col("near.rating")
    rating = F.when(F.col("near").isNull(), F.col("own.rating") + 2.5).otherwise(F.col("own.rating") - loss)
    place_of = F.when(F.col("near").isNotNull(), place(F.col("near.start"), F.lit(0))).otherwise(F.col("own.closest_not"))
    return met.select("own.doc_id", "own.start", "own.word_id", rating.alias("rating"), "own.occurrences", place_of.alias("closest_not"))


def rate(hits: DataFrame) -> DataFrame:
    """Final ratings: each two places next to each other of different words add the more the nearer they are.

    If the nearest two aren't the first two, the first of them becomes the hit's start, and the old one takes its place
    among the occurrences.
    """
    n = F.size("occurrences")
    pairs = F.zip_with(
        F.slice("occurrences", F.lit(1), n - 1), F.slice("occurrences", F.lit(2), n - 1),
        lambda a, b: F.struct((b["start"] - a["start"]).alias("distance"), a.alias("a"), (a["word_id"] != b["word_id"]).alias("differs")),
    )
    got = hits.withColumn("pairs", F.filter(F.transform(pairs, lambda p, i: F.struct(p["distance"].alias("distance"), i.alias("at"), p["a"].alias("a"), p["differs"].alias("differs"))), lambda p: p["differs"]))
    more = F.aggregate("pairs", F.lit(0.0), lambda acc, p: acc + 0.5 / (0.001 * p["distance"] + 0.1))
    got = got.withColumn("nearest", F.array_min("pairs"))
    moved = F.coalesce(F.col("nearest.at") > 0, F.lit(False))
    to = F.col("nearest.a")
    swapped = F.array_sort(F.array_distinct(F.concat(F.filter("occurrences", lambda o: o != to), F.array(place(F.col("start"), F.col("word_id"))))))
    return got.select(
        "doc_id", F.when(moved, F.col("nearest.a.start")).otherwise(F.col("start")).alias("start"), "word_id", (F.col("rating") + more).alias("rating"),
        F.when(moved, swapped).otherwise(F.col("occurrences")).alias("occurrences"), "closest_not",
    )


def top_hits(hits: DataFrame, k: int) -> DataFrame:
    """The k best by rating; ties by document and place, then by all places.

    Ratings that agree in six decimals are alike: sums of the same distances in another order differ in their last bits.
    """
    return hits.orderBy(F.round("rating", 6).desc(), "doc_id", "start", "word_id", "occurrences", "closest_not").limit(k)
