"""Set operators on sorted, distinct streams, as relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """What is in a and not in b."""
    return a.subtract(b)


def deduplicate(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """One row of each key (of each whole row without keys)."""
    return df.dropDuplicates(list(keys)) if keys else df.distinct()


def deduplicate_keeping(df: DataFrame, keys: Sequence[str], best: Column) -> DataFrame:
    """Of the rows of each key that for which best is greatest; a partial aggregate, so hot keys are cut down before they move."""
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), best).alias("kept"))
    return got.select(*(F.col(c) if c in keys else F.col("kept")[c].alias(c) for c in df.columns))


def progressive(left: DataFrame, right: DataFrame, match: str, at: str, order: Sequence[str]) -> DataFrame:
    """Both tables' rows, each with its neighbours of the other table within the same match value, in one sorted pass.

    A row (match, at, is_left, own, behind, ahead): own is the row itself as a struct of the tables' common columns; ahead
    is the other table's first row at or after it (for rows of right: after it), behind its last one before (for rows of
    right: at or before it). order breaks ties of at. Each match value is one window partition; every frame grows from
    its start, so the work is proportional to the rows.
    """
    cols = left.columns
    both = left.select(F.lit(True).alias("is_left"), *cols).unionByName(right.select(F.lit(False).alias("is_left"), *cols))
    # a row is sorted with its columns once, beside what the other table's rows take of it
    own = F.struct(*cols)
    both = both.withColumn("l", F.when(F.col("is_left"), own)).withColumn("r", F.when(~F.col("is_left"), own))
    forward = Window.partitionBy(match).orderBy(F.col(at), F.col("is_left").desc(), *order).rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy(match).orderBy(F.col(at).desc(), "is_left", *(F.col(c).desc() for c in order)).rowsBetween(Window.unboundedPreceding, 0)

    def other(window):
        return F.when(F.col("is_left"), F.last("r", ignorenulls=True).over(window)).otherwise(F.last("l", ignorenulls=True).over(window))

    return both.select(match, at, "is_left", F.coalesce("l", "r").alias("own"), other(forward).alias("behind"), other(backward).alias("ahead"))
