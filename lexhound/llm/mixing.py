"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, row_hash

#: Virtual time 1, at which every source has given its target, is cut into so many ranges.
TIME_RANGES = 65536


def source_targets(sizes: DataFrame, weights=(5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """(source, size) rows to (source, source_size, source_rank, target): shares by weight, none above max_epochs * size.

    The resharing of what capped sources leave has a closed form: by growing cap / weight, the sources before the
    first whose cap holds its share of the rest are capped. One row per source, so one task holds them all.
    """
    # Bounded: one row for each name of a source, whatever the number of documents.
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    s = sizes.select("source", F.col("size").alias("source_size"), (F.row_number().over(by_name) - 1).alias("source_rank"))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("source_rank") % n + 1).cast("int")).cast("long")
    s = s.withColumns({"w": weight, "cap": F.col("source_size") * max_epochs})
    by_ratio = Window.partitionBy(F.lit(0)).orderBy((F.col("cap") / F.col("w")).asc(), F.col("source_rank").asc())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    s = s.withColumns(
        {
            "rest": F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "rest_w": F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)),
        }
    )
    # level: words per unit of weight if this source and all after it are uncapped
    s = s.withColumn("level", F.col("rest") / F.col("rest_w"))
    s = s.withColumn("fits", F.col("cap") >= F.col("level") * F.col("w"))
    s = s.withColumn("final", F.max(F.when(F.col("fits"), F.struct(-(F.col("cap") / F.col("w")), -F.col("source_rank"), F.col("level")))).over(whole)["level"])
    target = F.when(F.col("fits"), F.col("final") * F.col("w")).otherwise(F.col("cap").cast("double"))
    return s.select("source", "source_size", "source_rank", F.least(target, F.col("cap").cast("double")).alias("target"))


def _sizes(docs: DataFrame, text_col: str, id_col: str, source_col: str, *more) -> DataFrame:
    doc_id = F.col(f"`{id_col}`")
    return docs.select(
        doc_id.alias("doc_id"),
        F.col(f"`{source_col}`").alias("source"),
        F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("?"), F.col(f"`{text_col}`").cast("string")), F.lit(""))).alias("h"),
        *more,
    )


def mix(docs: DataFrame, weights=(5, 2, 1), max_epochs: int = 3, hash_digits: int = 3, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document: a row (doc_id, source, size, source_size, target, taken) for each of docs.

    A source's documents are shuffled by the MD5 of their id (of the text, where that is null); copy e of a document ends, in its source's virtual time, at
    (e * source size + cumulative size) / target. All copies are put in order of that time and those taken whose sizes
    add up to at most the sum of all sizes. A hot source is cut into 16**hash_digits ranges of the hash, whose sums give
    each range its start, so no task holds a source; likewise the global order is cut into ranges of virtual time.

    Null text has size 0; a null source is a source of its own, after all names. A document of size 0 is never taken.
    Repeated rows are documents of their own; of rows with one doc_id the smaller comes first. Other columns are not
    read. No rows in, no rows out. Results depend on the rows alone, not on their order or partitioning.
    """
    return mix_sizes(materialise(_sizes(docs, text_col, id_col, source_col), "mix-sizes"), weights, max_epochs, hash_digits)


def mixed(docs: DataFrame, weights=(5, 2, 1), max_epochs: int = 3, hash_digits: int = 3, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of docs, each as often as mix() takes it; those that it doesn't take are gone.

    The columns are those of docs. Rows that are alike in all columns stand for each other: their copies come together.
    """
    row = row_hash(docs).alias("row")
    got = mix_sizes(materialise(_sizes(docs, text_col, id_col, source_col, row), "mix-sizes"), weights, max_epochs, hash_digits)
    copies = got.where("taken > 0").groupBy("doc_id", "row").agg(F.sum((F.col("taken") / F.col("size")).cast("int")).cast("int").alias("copies"))
    names = docs.columns
    base = docs.select(*(F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(names)), row)
    same = (base["row"] == copies["row"]) & base[f"k{names.index(id_col)}"].eqNullSafe(copies["doc_id"])
    met = base.join(copies, same).drop(copies["row"]).dropDuplicates(["row", f"k{names.index(id_col)}"])
    met = met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return met.select(*(F.col(f"k{n}").alias(c) for n, c in enumerate(names)))


def mix_sizes(base: DataFrame, weights=(5, 2, 1), max_epochs: int = 3, hash_digits: int = 3) -> DataFrame:
    """mix() for rows (doc_id, source, size, h); further columns are kept, and row, if there, orders what is alike otherwise."""
    part = F.substring("h", 1, hash_digits)
    keep = [c for c in base.columns if c != "h"]
    base = base.withColumn("part", part).withColumn("source_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))
    sums = base.groupBy("source_key", "part").agg(F.sum("size").alias("size"), F.first("source").alias("source"))
    ahead = Window.partitionBy("source_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source_key", "part", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("start"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("size").alias("size")), weights, max_epochs)
    targets = targets.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))).drop("source")
    # one row per source and range of hashes: it shuffles on the keys of the window below
    starts = starts.join(targets, "source_key")
    within = Window.partitionBy("source_key", "part").orderBy("h", "doc_id", "size", *(["row"] if "row" in keep else [])).rowsBetween(Window.unboundedPreceding, 0)
    ranked = base.withColumn("cum", F.sum("size").over(within)).join(starts, ["source_key", "part"])
    ranked = ranked.select(*keep, "h", "source_size", "source_rank", "target", (F.col("cum") + F.col("start")).alias("cum"))
    ranked = materialise(ranked, "mix-ranked")

    def ends(epoch):
        return (F.lit(epoch).cast("long") * F.col("source_size") + F.col("cum")).cast("double") / F.col("target")

    def place(epoch):
        return F.struct(ends(epoch).alias("ends"), "source_rank", "h", "size")

    def time_range(at):
        return F.least(F.floor(at * TIME_RANGES), F.lit(4 * TIME_RANGES)).cast("long")

    some = (F.col("size") > 0) & (F.col("target") > 0)
    copies = ranked.where(some).select(F.explode(F.array(*[place(e) for e in range(max_epochs)])).alias("place"), "size")
    copies = copies.withColumn("slice", time_range(F.col("place.ends")))
    # at most 4 * TIME_RANGES + 1 rows in this window
    in_time = Window.partitionBy(F.lit(0)).orderBy("slice")
    slices = copies.groupBy("slice").agg(F.sum("size").alias("size"))
    slices = slices.select("slice", "size", F.sum("size").over(in_time).alias("upto"))
    budget = ranked.agg(F.sum("size")).first()[0] or 0
    # the range in which the budget ends; its copies alone need an order among themselves
    over = slices.where(F.col("upto") > budget).agg(F.min(F.struct("slice", (F.col("upto") - F.col("size")).alias("before")))).first()[0]
    if over is None:

        def taken(epoch):
            return some
    else:
        here = Window.partitionBy("slice").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        last = copies.where(F.col("slice") == over["slice"]).withColumn("upto", F.sum("size").over(here) + over["before"])
        edge = last.where(F.col("upto") <= budget).agg(F.max("place")).first()[0]

        def taken(epoch):
            fits = time_range(ends(epoch)) < over["slice"]
            if edge is not None:
                last = F.struct(*(F.lit(edge[c]).cast(t) for c, t in (("ends", "double"), ("source_rank", "int"), ("h", "string"), ("size", "long"))))
                fits = fits | (place(epoch) <= last)
            return some & fits

    times = sum((taken(e).cast("long") for e in range(1, max_epochs)), taken(0).cast("long"))
    return ranked.select(*keep, "source_size", "target", (F.col("size") * F.coalesce(times, F.lit(0))).alias("taken"))
