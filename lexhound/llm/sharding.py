"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Sizes are packed as if rounded up to so many significant bits, by less than one part in 8192. So the driver holds one
#: class for each size below 16384 and 8192 for each doubling after, whatever the number of groups.
SIZE_BITS = 14


class Capacities:
    """Bins by (room left, bin) in a balanced tree: a treap whose heap order is a hash of the bin."""

    __slots__ = ("_root",)

    def __init__(self):
        self._root = None  # a node: [room, bin, priority, left, right]

    def add(self, room: int, at: int) -> None:
        node = [room, at, (at * 0x9E3779B1 ^ 0x5BD1E995) * 0x85EBCA6B & 0xFFFFFFFF, None, None]
        path, here = [], self._root
        while here is not None and here[2] >= node[2]:
            side = 4 if (here[0], here[1]) < (room, at) else 3
            path.append((here, side))
            here = here[side]
        # what is below splits into the new node's two sides
        low, high = (node, 3), (node, 4)
        while here is not None:
            if (here[0], here[1]) < (room, at):
                low[0][low[1]], low = here, (here, 4)
                here = here[4]
            else:
                high[0][high[1]], high = here, (here, 3)
                here = here[3]
        low[0][low[1]] = high[0][high[1]] = None
        if path:
            path[-1][0][path[-1][1]] = node
        else:
            self._root = node

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin of least room that holds size; None if none does."""
        above, best, here = None, None, self._root
        parent = None
        while here is not None:
            if here[0] >= size:
                best, above = here, parent
                parent, here = (here, 3), here[3]
            else:
                parent, here = (here, 4), here[4]
        if best is None:
            return None
        a, b = best[3], best[4]
        place = above
        while a is not None or b is not None:  # both sides join where the node was
            if b is None or a is not None and a[2] >= b[2]:
                nxt, a = a, None
                self._hang(place, nxt)
                place, a = (nxt, 4), nxt[4]
            else:
                nxt = b
                self._hang(place, nxt)
                place, b = (nxt, 3), nxt[3]
        self._hang(place, None)
        return best[0], best[1]

    def _hang(self, place, node) -> None:
        if place is None:
            self._root = node
        else:
            place[0][place[1]] = node


def pack(classes: list[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int, int]] | None:
    """Best fit decreasing of classes (size, number of groups of that size), largest first, into bins of one capacity.

    Returns runs (size, bin, how many). With bins, None if they don't fit into so many; without, a bin is opened when no
    open one holds a group, and a group above the capacity gets a bin of its own. The bins' remaining capacities are in
    a balanced tree, and each group goes to the tightest that holds it; of a class, as many as fit go to that bin at
    once, which is what best fit does with equal groups one after the other, for a bin that has taken one is tighter.
    """
    open_bins, opened, runs = Capacities(), 0, []
    for b in range(bins or 0):
        open_bins.add(capacity, b)
    for size, n in classes:
        while n:
            got = open_bins.take_tightest(size)
            if got is None:
                if bins is not None:
                    return None
                got, opened = (max(capacity, size), opened), opened + 1
            room, b = got
            k = min(n, room // size) if size else n
            runs.append((size, b, k))
            n -= k
            open_bins.add(room - k * size, b)
    return runs


def balanced_pack(classes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """pack() with the least capacity, to one part in 2**20, at which everything fits into bins bins.

    A group above an even share gets a bin of its own first, and the rest share the others evenly.
    """
    classes = sorted(classes, reverse=True)
    alone, rest, free = [], [], bins
    total = sum(s * n for s, n in classes)
    for s, n in classes:
        while n and free > 1 and s * free > total:
            alone.append((s, free - 1, 1))
            free, total, n = free - 1, total - s, n - 1
        if n:
            rest.append((s, n))
    if not rest:
        return alone
    low = max(-(-total // free), rest[0][0])
    found = pack(rest, low, free)
    if found is None:
        # at most the share and the largest group more: then the emptiest bin always has room
        high = low + rest[0][0]
        step = max(1, (low >> 20))
        while low < high:  # fitting isn't monotone in the capacity, but the end that is kept does fit
            middle = (low + high) // 2
            if middle + step >= high and found is not None:
                break
            got = pack(rest, middle, free)
            if got is None:
                low = middle + 1
            else:
                high, found = middle, got
        if found is None:
            found = pack(rest, high, free)
    assert found is not None
    return alone + found


def shard(docs: DataFrame, shards: int | None = 16, capacity: int | None = None, text_col: str = "text", id_col: str = "doc_id", slices: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row, equal texts never parted.

    With shards, so many of near equal bytes; else as few as best fit decreasing needs of at most capacity bytes each (a
    group that is larger has a shard of its own).

    size: UTF-8 bytes and 1; a null text counts as empty and is grouped with empty texts. Groups are packed by best fit
    decreasing, their sizes rounded up to SIZE_BITS significant bits. Only how many groups there are of each such size
    reaches the driver, and the groups of one are interchangeable: they are numbered within it and take the runs that the
    packing gave it. slot numbers each shard's rows from 0; it is made from counts of parts of the hash, so no task holds
    a shard. Repeated rows are rows of their own. No rows in: none out.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        # 128 bits stand for a text
        F.xxhash64(text).alias("g1"),
        F.xxhash64(F.lit(1), text, F.octet_length(text)).alias("g2"),
    )
    return shard_sizes(materialise(base, "shard-sizes"), shards, capacity, slices)


def rounded_size(size):
    """A size rounded up to SIZE_BITS significant bits."""
    low = F.greatest(F.length(F.bin(size)) - SIZE_BITS, F.lit(0))
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), low)
    return F.call_function("shiftleft", F.call_function("shiftright", size + unit - 1, low), low)


def shard_sizes(base: DataFrame, shards: int | None, capacity: int | None = None, slices: int = 64) -> DataFrame:
    """shard() for rows (doc_id, size, text_crc32, g1, g2)."""
    spark = base.sparkSession
    groups = base.groupBy("g1", "g2").agg(F.sum("size").alias("bytes"))
    groups = groups.select("g1", "g2", rounded_size(F.col("bytes")).alias("bytes"), F.pmod("g1", F.lit(slices)).alias("slice"))
    groups = materialise(groups, "shard-groups")
    cells = groups.groupBy("bytes", "slice").count()  # of each size, by slices of the hash
    classes = [(r["bytes"], r["count"]) for r in groups.groupBy("bytes").count().collect()]
    runs = balanced_pack(classes, shards) if capacity is None else pack(sorted(classes, reverse=True), capacity)
    ordered: dict[int, int] = {}
    table = []
    for size, b, k in runs:
        first = ordered.get(size, 0)
        table.append((size, b, first, first + k))
        ordered[size] = first + k
    runs_df = spark.createDataFrame(table, "bytes long, shard int, first long, until long")
    # the number of a group within its size: what the slices before hold, then its place in the slice
    before = Window.partitionBy("bytes").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("bytes", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bytes", "slice").orderBy("g1", "g2")
    numbered = groups.withColumn("n", F.row_number().over(inside) - 1).join(cells, ["bytes", "slice"])
    numbered = numbered.withColumn("n", F.col("n") + F.col("offset"))
    placed = _place(numbered, runs_df, len(table))
    placed = materialise(placed.select("g1", "g2", "shard"), "shard-placed")
    return _slots(base, placed, slices)


def _place(numbered: DataFrame, runs: DataFrame, n_runs: int) -> DataFrame:
    """The shard of each group: the run of its size that holds its number. The runs are few: at most sizes + shards * steps."""
    joined = numbered.join(F.broadcast(runs) if n_runs <= 100_000 else runs, "bytes")
    return joined.where((F.col("n") >= F.col("first")) & (F.col("n") < F.col("until")))


def _slots(base: DataFrame, placed: DataFrame, slices: int) -> DataFrame:
    """Rows in order of (part of the hash, group, part of the id, id) within the shard, numbered without a hole.

    Parts of ids split groups of many copies, so that none is numbered in one task.
    """
    # The slot needs an order only: parts are the unit of counting, and rows are ordered within a part.
    rows = base.join(placed.select("g1", "g2", "shard"), ["g1", "g2"])
    part = F.pmod(F.xxhash64("g1", F.coalesce(F.col("doc_id"), F.lit(-1))), F.lit(slices * 16))
    rows = rows.withColumn("part", part)
    counts = rows.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "g1", "g2")
    out = rows.withColumn("slot", F.row_number().over(inside) - 1).join(counts, ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("offset")).cast("long").alias("slot"))
