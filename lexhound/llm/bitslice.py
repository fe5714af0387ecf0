"""Exact top-k by inner product over a bit-sliced index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

#: Rows of one block of the index: what one step of the search holds.
BLOCK_ROWS = 65_536
#: Least significant attribute slices that the bitmap sums leave out; the rows that this leaves open are resolved exactly.
DROPPED = 1
#: Vectors whose quantised components lie within this are sliced: no inner product of up to 2**13 of them leaves 64 bits.
#: Others are scored beside the bitmaps, by integers of any size.
LARGEST = 1 << 24


def naf(values: np.ndarray) -> list[np.ndarray]:
    """Signed digits (-1, 0, 1) of integers, least significant first, no two adjacent ones set."""
    rest, out = values.astype(np.int64).copy(), []
    while rest.any():
        digit = np.where(rest & 1, 2 - (rest & 3), 0)
        out.append(digit.astype(np.int8))
        rest = (rest - digit) >> 1
    return out


class Block:
    """Bitmaps of the rows of a block: slices[d, i] holds bit i of attribute d less the block's minimum of d."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], np.ascontiguousarray(values[order])
        n, dim = self.values.shape
        self.words = -(-n // 64) if n else 0
        shifted = (self.values - self.values.min(0, initial=LARGEST)).astype(np.uint64) if n else self.values.astype(np.uint64)
        bits = int(shifted.max(initial=0)).bit_length()
        self.slices = np.zeros((dim, bits, self.words), np.uint64)
        for i in range(bits):
            packed = np.packbits(((shifted >> np.uint64(i)) & np.uint64(1)).astype(np.uint8).T, axis=1, bitorder="little")
            raw = np.zeros((dim, self.words * 8), np.uint8)
            raw[:, : packed.shape[1]] = packed
            self.slices[:, i] = raw.view(np.uint64)
        self.rows = np.full(self.words, ~np.uint64(0))
        if n % 64:
            self.rows[-1] = np.uint64((1 << (n % 64)) - 1)

    def pack(self) -> tuple[bytes, bytes, bytes, int]:
        kind = np.int8 if np.abs(self.values).max(initial=0) < 128 else np.int32
        return self.ids.tobytes(), self.values.astype(kind).tobytes(), self.slices.tobytes(), self.slices.shape[1]

    @classmethod
    def unpack(cls, dim: int, bits: int, ids: bytes, values: bytes, slices: bytes) -> Block:
        self = cls.__new__(cls)
        self.ids = np.frombuffer(ids, np.int64)
        n = len(self.ids)
        kind = np.int8 if len(values) == n * dim else np.int32
        self.values = np.frombuffer(values, kind).reshape(n, dim)
        self.words = -(-n // 64)
        self.slices = np.frombuffer(slices, np.uint64).reshape(dim, bits, self.words)
        self.rows = np.full(self.words, ~np.uint64(0))
        if n % 64:
            self.rows[-1] = np.uint64((1 << (n % 64)) - 1)
        return self

    def sums(self, query: np.ndarray, dropped: int = DROPPED) -> tuple[list[np.ndarray], int]:
        """Slices of the score of all rows, least significant first, up to a constant and without dropped attribute slices; what these add at most.

        Each digit of a query's component adds the attribute's slices, or, if it is negative, their complements, at its
        weight. The bitmaps of a weight go through full adders, whose carries go to the next, until one is left.
        """
        digits = naf(query)
        _, bits, words = self.slices.shape
        dropped = min(dropped, max(bits - 1, 0))
        slack = ((1 << dropped) - 1) * sum(int(np.abs(d).astype(np.int64).sum()) << j for j, d in enumerate(digits))
        at: list[list[np.ndarray]] = [[] for _ in range(len(digits) + bits - dropped)]
        for j, digit in enumerate(digits):
            plus, minus = np.flatnonzero(digit > 0), np.flatnonzero(digit < 0)
            for i in range(dropped, bits):
                if len(plus):
                    at[i - dropped + j].append(self.slices[plus, i])
                if len(minus):
                    at[i - dropped + j].append(~self.slices[minus, i])
        out, w = [], 0
        while w < len(at):
            parts = at[w]
            m = np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros((1, words), np.uint64)
            while len(m) > 1:
                if w + 1 == len(at):
                    at.append([])
                k = len(m) // 3
                if k:
                    a, b, c = m[:k], m[k : 2 * k], m[2 * k : 3 * k]
                    x = a ^ b
                    carry = x & c
                    carry |= a & b
                    x ^= c
                    m = np.concatenate([x, m[3 * k :]]) if 3 * k < len(m) else x
                else:
                    carry = m[:1] & m[1:]
                    m = m[:1] ^ m[1:]
                at[w + 1].append(carry)
            out.append(m[0])
            w += 1
        return out, slack >> dropped

    def top(self, query_id: int, query: np.ndarray, k: int, dropped: int = DROPPED) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows but those of query_id: highest score first, then the smaller id."""
        lo, hi = np.searchsorted(self.ids, query_id), np.searchsorted(self.ids, query_id, side="right")
        open_rows = self.rows
        if hi > lo:
            open_rows = self.rows.copy()
            for r in range(lo, hi):
                open_rows[r >> 6] &= ~np.uint64(1 << (r & 63))
        if int(np.bitwise_count(open_rows).sum()) > k:
            slices, slack = self.sums(query, dropped)
            # from the most significant slice downward: the k-th highest sum
            better, edge, at = np.zeros_like(open_rows), open_rows, 0
            n_better = 0
            for i in range(len(slices) - 1, -1, -1):
                high = edge & slices[i]
                n = n_better + int(np.bitwise_count(high).sum())
                if n >= k:
                    edge = high
                    at |= 1 << i
                else:
                    better, n_better = better | high, n
                    edge = edge & ~slices[i]
            open_rows = self.at_least(slices, open_rows, at - slack)
        rows = np.flatnonzero(np.unpackbits(open_rows.view(np.uint8), bitorder="little"))
        score = self.values[rows].astype(np.int64) @ query.astype(np.int64)
        order = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[order]], score[order]

    @staticmethod
    def at_least(slices: list[np.ndarray], rows: np.ndarray, value: int) -> np.ndarray:
        """The rows whose sum is at least value: the boundary that the dropped slices leave open is within."""
        if value <= 0:
            return rows
        above, equal = np.zeros_like(rows), rows
        for i in range(len(slices) - 1, -1, -1):
            if value >> i & 1:
                equal = equal & slices[i]
            else:
                above = above | (equal & slices[i])
                equal = equal & ~slices[i]
        return above | equal


def best_of(ids: np.ndarray, values: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Block.top() by the exact scores of all rows, whose components may be of any size; scores beyond 64 bits become the nearest long."""
    own = np.flatnonzero(ids != query_id)
    if not len(own):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = [int(x) for x in query.tolist()]
    score = [sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in values[own].tolist()]
    order = sorted(range(len(own)), key=lambda r: (-score[r], ids[own[r]]))[:k]
    low, high = -(1 << 63), (1 << 63) - 1
    return ids[own[order]], np.array([min(max(score[r], low), high) for r in order], np.int64)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v array<double>): floor(scale * x), whole numbers, of every vector that isn't null and holds no null or non-finite component.

    Rows with a null id take no part.
    """
    v = F.col(f"`{vector_col}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    got = vectors.where(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & finite & (F.size(v) > 0))
    floor = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)  # noqa: E731 (larger ones are whole)
    return got.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(v, lambda x: floor(x.cast("double") * scale)).alias("v"))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column(1)
    return batch.column(0).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)


def _gathered(batches, most: int):
    """Blocks (dimension, ids, values) of at most so many rows of one dimension each."""
    held: dict[int, list] = {}
    for batch in batches:
        ids, flat, sizes = _arrays(batch)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for dim in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == dim)
            values = flat[(ends[rows][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)
            parts = held.setdefault(dim, [])
            parts.append((ids[rows], values))
            while sum(len(a) for a, _ in parts) >= most:
                a, b = np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts])
                yield dim, a[:most], b[:most]
                parts[:] = [(a[most:], b[most:])]
    for dim, parts in held.items():
        a = np.concatenate([x for x, _ in parts])
        if len(a):
            yield dim, a, np.concatenate([y for _, y in parts])


#: A block of the index (kind 0): rows that are sliced, and those whose components are too large for that; or a query (kind 1), whose vector is in vals.
ENTRIES = "part int, dim int, kind int, id long, bits int, ids binary, vals binary, slices binary, wide_ids binary, wide_vals binary"
_NAMES = [x.split()[0] for x in ENTRIES.split(", ")]


def _is_wide(values: np.ndarray) -> np.ndarray:
    return np.abs(values).max(1, initial=0) >= LARGEST


def build_index(rows: DataFrame, n: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of the index of (vec_id, v) rows, of which there are n, as ENTRIES; written to the shared folder."""
    from pyspark import TaskContext

    def pack(batches):
        part = TaskContext.get().partitionId()
        for dim, ids, values in _gathered(batches, block_rows):
            wide = _is_wide(values)
            a, b, c, bits = Block(ids[~wide], values[~wide].astype(np.int64)).pack()
            row = (part, dim, 0, 0, bits, a, b, c, ids[wide].tobytes(), values[wide].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int32()] * 3 + [pa.int64(), pa.int32()] + [pa.binary()] * 5, strict=True)], _NAMES)

    return materialise(rows.repartition(max(1, -(-n // block_rows))).mapInArrow(pack, ENTRIES), "bitslice")


class Searcher:
    """The blocks of one part and dimension, and the best rows that they hold for a query."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.wide: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, dim: int, bits: int, ids: bytes, values: bytes, slices: bytes, wide_ids: bytes, wide_values: bytes) -> None:
        if ids:
            self.blocks.append(Block.unpack(dim, bits, ids, values, slices))
        if wide_ids:
            self.wide.append((np.frombuffer(wide_ids, np.int64), np.frombuffer(wide_values, np.float64).reshape(-1, dim)))

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of at most k rows of each block."""
        got = [best_of(*rows, query_id, query, k) for rows in self.wide]
        if np.abs(query).max() < LARGEST:
            got += [b.top(query_id, query.astype(np.int64), k) for b in self.blocks]
        else:
            got += [best_of(b.ids, b.values, query_id, query, k) for b in self.blocks]
        return np.concatenate([a for a, _ in got]), np.concatenate([b for _, b in got])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, query_hash, rank (from 1), vec_id, score of the k highest integer inner products of each query with all other rows.

    Both tables are quantised to floor(scale * x). Ties go to the smaller vec_id; rows of the query's own id take no part,
    nor do vectors that quantised() leaves out; only vectors of the query's dimension are scored. Repeated rows count
    each. A query that is given twice is answered once; different vectors of one id are answered each, and query_hash
    (of the quantised vector) tells them apart. Components may be of any size; a score beyond 64 bits is given as the
    nearest long and ranked by that within the answers of different blocks. Fewer rows than k: all. No rows or queries:
    none out.

    The index has blocks of BLOCK_ROWS rows. Each goes to Python once for each group of queries, followed by the group's
    queries one by one: what a task reads is its blocks and its queries, whatever their product. There are several
    groups only where blocks are fewer than tasks could be. A block gives k rows a query, which one window merges.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vector_col, scale)
    n = rows.count()
    index = build_index(rows, n)
    parts = max(1, -(-n // BLOCK_ROWS))
    groups = max(1, -(-2 * spark.sparkContext.defaultParallelism // parts))
    asked = quantised(queries, id_col, vector_col, scale).dropDuplicates(["vec_id", "v"])

    def pack(batches):
        for batch in batches:
            ids, flat, sizes = _arrays(batch)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            raw = np.ascontiguousarray(flat, np.float64)
            vals = pa.array([raw[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sizes.astype(np.int32)), vals], ["id", "dim", "vals"])

    packed = asked.mapInArrow(pack, "id long, dim int, vals binary")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    none = F.lit(None).cast("binary")
    placed = packed.select(every, "dim", F.lit(1).alias("kind"), "id", F.lit(0).alias("bits"), none.alias("ids"), "vals", none.alias("slices"), none.alias("wide_ids"), none.alias("wide_vals"))
    placed = placed.withColumn("group", F.pmod(F.xxhash64("id", "vals"), F.lit(groups)).cast("int"))
    copies = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = copies.unionByName(placed).repartition(parts * groups, "part", "group").sortWithinPartitions("part", "group", "dim", "kind").select(*_NAMES, "group")

    def search(batches):
        at, held = None, Searcher()
        for batch in batches:
            columns = [batch.column(c) for c in range(len(_NAMES) + 1)]
            part, dim, kind, ids, group = (columns[c].to_pylist() for c in (0, 1, 2, 3, 10))
            who, what, ranked = [], [], []
            for r in range(batch.num_rows):
                if (part[r], group[r], dim[r]) != at:
                    at, held = (part[r], group[r], dim[r]), Searcher()
                if kind[r] == 0:
                    held.add(dim[r], *(columns[c][r].as_py() for c in range(4, 10)))
                elif held.blocks or held.wide:
                    raw = columns[6][r].as_py()
                    a, b = held.top(ids[r], np.frombuffer(raw, np.float64), k)
                    who.append((ids[r], xxhash.xxh64_intdigest(raw) - (1 << 63), len(a)))
                    what.append(a)
                    ranked.append(b)
            if who:
                times = [n for *_, n in who]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array([x[c] for x in who], np.int64), times)) for c in (0, 1)] + [pa.array(np.concatenate(what)), pa.array(np.concatenate(ranked))],
                    ["query_id", "query_hash", "vec_id", "score"],
                )

    found = met.mapInArrow(search, T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "query_hash", "vec_id", "score")]))
    best = Window.partitionBy("query_id", "query_hash").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "query_hash", "rank", "vec_id", "score")
