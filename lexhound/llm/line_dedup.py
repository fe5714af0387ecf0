"""Near-duplicate lines by a segment-partition edit join."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, chunks, materialise, release_memory, text_buffers
from .components import components
from .edit_distance import code_points, distances, trim

#: A bucket that indexes more lines than this is cut up by second segments.
HOT_BUCKET = 128
#: Ids of lines that a task remembers so as to index copies once (a power of two).
SEEN = 1 << 18
#: Candidate lines up to this many (16 MB of ids) are broadcast to find their texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_CHUNK = 1 << 19


#: Lines of so many characters may differ in a stretch. Their lengths are in bands, each 1.2 times the one before.
STRETCHED = 48
_BANDS = [STRETCHED]
while _BANDS[-1] < 1 << 40:
    _BANDS.append(_BANDS[-1] * 6 // 5)
_BANDS = np.array(_BANDS, np.int64)


@dataclass(frozen=True)
class Closeness:
    """Which lines are near, n the code points of the shorter.

    Those that at most min(max_edits, n // chars_per_edit) edits part, wherever they are; and those that differ in one
    stretch of at most n // chars_per_stretch code points on either side, so what may differ grows with the line; for n of
    STRETCHED and more (chars_per_stretch 0: none).
    """

    max_edits: int = 2
    chars_per_edit: int = 16
    chars_per_stretch: int = 16

    def __post_init__(self):
        if self.max_edits < 0 or self.chars_per_edit < 4:
            raise ValueError("max_edits must not be negative, chars_per_edit at least 4")
        if self.chars_per_stretch and self.chars_per_stretch < 16:
            raise ValueError("chars_per_stretch must be 0 or at least 16")

    def edits(self, n):
        return np.minimum(self.max_edits, np.asarray(n) // self.chars_per_edit)

    def stretch(self, n):
        n = np.asarray(n)
        return np.where(n >= STRETCHED, n // self.chars_per_stretch, 0) if self.chars_per_stretch else np.zeros_like(n)


def segments(n: int, parts: int) -> list[tuple[int, int]]:
    """Start and length of each part of n characters; the lengths differ by at most one, the longer ones come last."""
    size, longer = divmod(n, parts)
    out, at = [], 0
    for k in range(parts):
        own = size + (k >= parts - longer)
        out.append((at, own))
        at += own
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Substrings:
    """Hashes of any substrings of a text in constant time each, from one running sum over its bytes."""

    _powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(self._powers[0]) < n:
            up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
            up[0] = down[0] = 1
            type(self)._powers = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        up, self.down = self._powers
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: n - 1], out=self.sums[1:])
        # where each code point starts, and the end
        self.place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of code points start to end."""
        a, b = self.place[start], self.place[end]
        return _mix((self.sums[b] - self.sums[a]) * self.down[a] + (end - start).astype(np.uint64))


def _part_starts(n: np.ndarray, parts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """segments()[k] of many lengths at once."""
    size, longer = n // parts, n % parts
    first = parts - longer
    return k * size + np.maximum(k - first, 0), size + (k >= first)


def _key(digest: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    return _mix(digest ^ (n.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(k + 1)))


def line_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the lines of texts start and end (bytes), without empty ones."""
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(at[:-1], breaks + 1)
    starts = starts[starts < len(data)]
    starts = starts[data[starts] != 10]
    ends = np.union1d(at[1:], breaks)
    return starts, ends[np.searchsorted(ends, starts, side="right")] if len(starts) else starts


class Lines:
    """The distinct lines of a chunk that are long enough for edits, with hashes of any of their parts.

    Those that are in seen (a table of SEEN ids, which is updated) are left out.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, close: Closeness, seen: np.ndarray | None = None):
        self.hashes = Substrings(data)
        starts, ends = line_bounds(data, at)
        # in code points
        first = np.searchsorted(self.hashes.place, starts)
        n = np.searchsorted(self.hashes.place, ends) - first
        long = np.flatnonzero(n >= close.chars_per_edit)
        raw = data.tobytes()
        ids = np.fromiter((xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), np.uint64, len(long))
        self.ids, keep = np.unique(ids, return_index=True)
        if seen is not None:
            place = (self.ids & np.uint64(SEEN - 1)).astype(np.int64)
            new = seen[place] != self.ids
            self.ids, keep = self.ids[new], keep[new]
            seen[place[new]] = self.ids
        self.first, self.n = first[long[keep]], n[long[keep]]

    def indexed(self, close: Closeness):
        """(key, place of the line, segment) of each segment of each line."""
        edits = close.edits(self.n)
        for k in range(close.max_edits + 1):
            use = np.flatnonzero(k <= edits)
            n = self.n[use]
            start, size = _part_starts(n, edits[use] + 1, k)
            a = self.first[use] + start
            yield _key(self.hashes.hash(a, a + size), n, k), use, k

    def probes(self, close: Closeness, own: bool = False):
        """(key, place of the line, segment, n of the indexed line, start in this line) of each substring that may equal a segment of a line as long or shorter.

        Of segment k, moved by m, and a line longer by d: some equal segment has at most k edits before and
        edits - k after it, so -k <= m <= k and -(edits - k) <= m - d <= edits - k. Without own, what equals the
        line's own index entry (d = m = 0) is left out; the index is joined with itself for that.
        """
        for d in range(close.max_edits + 1):
            other = self.n - d
            edits = close.edits(other)
            for k in range(close.max_edits + 1):
                ok = (d <= edits) & (k <= edits)
                for m in range(-k, k + 1):
                    if d == 0 and m == 0 and not own:
                        continue
                    use = np.flatnonzero(ok & (np.abs(m - d) <= edits - k))
                    if not len(use):
                        continue
                    n = other[use]
                    start, size = _part_starts(n, edits[use] + 1, k)
                    start = start + m
                    inside = (start >= 0) & (start + size <= self.n[use])
                    use, start, size, n = use[inside], start[inside], size[inside], n[inside]
                    a = self.first[use] + start
                    yield _key(self.hashes.hash(a, a + size), n, k), use, k, n, start


    def tails(self, close: Closeness, probing: bool):
        """(key, place of the line, side, band) of the beginning (side 0) and the end of each line that a stretch may part from others.

        A stretch of n // 16 leaves 15 of 32 parts of the line at its beginning or end. Lengths are in bands, of which a
        line is indexed in its own and probes the one below if a shorter line there may be near.
        """
        if not close.chars_per_stretch:
            return
        band = np.searchsorted(_BANDS, self.n, side="right") - 1
        if probing:
            below = np.where(band > 0, _BANDS[np.maximum(band, 1)] - 1, 0)  # the longest of the band below
            use = np.flatnonzero((band > 0) & (self.n <= below + close.stretch(below)))
            band = band - 1
        else:
            use = np.flatnonzero(band >= 0)
        band = band[use]
        for side in (0, 1):
            yield self.tail(use, side, band, 45), use, side, band

    def tail(self, use: np.ndarray, side: int, band: np.ndarray, percent: int) -> np.ndarray:
        """The key of so much of each line's beginning or end, by the least length of its band."""
        size = _BANDS[band] * percent // 100
        a = self.first[use] + (0 if side == 0 else self.n[use] - size)
        return _key(self.hashes.hash(a, a + size), band, 100 + side)


def _keys(docs: DataFrame, close: Closeness) -> DataFrame:
    """(key, id, probe): of every line its segments, and the substrings that probe for those of others, in one pass.

    Copies of a line are left out in a task that has just met it, so a line however frequent comes about once a task.
    """

    def run(batches):
        seen = np.zeros(SEEN, np.uint64)
        seen[0] = 1  # no line's: the place of id 1 is another
        for batch in batches:
            data, at = text_buffers(batch.column(0))
            for i, j in chunks(at, _CHUNK):
                lines = Lines(data[at[i] : at[j]], at[i : j + 1] - at[i], close, seen)
                for probe, entries in ((False, (lines.indexed(close), lines.tails(close, False))), (True, (lines.probes(close), lines.tails(close, True)))):
                    for key, use, *_ in chain(*entries):
                        if len(use):
                            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(lines.ids[use].view(np.int64)), pa.array(np.full(len(use), probe))], ["key", "id", "probe"])
            release_memory()

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "key long, id long, probe boolean")


def _refined(lines: DataFrame, close: Closeness, probing: bool) -> DataFrame:
    """(line, keys array<long>) to (key, id): for entries under hot keys, keys of more of the line, one of which near lines share too.

    Where a segment k is equal, at most k edits are before it and edits - k after it; so of k + 1 segments of what is
    before, and of edits - k + 1 of what is after, one each is equal too. Where 45 hundredths are equal at one end,
    and there are less than 70, a stretch of n // 16 leaves over 20 at the other.
    """

    def run(batches):
        for batch in batches:
            for text, hot in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                lines = Lines(data, np.array([0, len(data)]), close)
                if not len(lines.ids):
                    continue
                hot, length, out = set(hot), int(lines.n[0]), []
                entries = ((key, k, None, None) for key, _, k in lines.indexed(close)) if not probing else ((key, k, n, s) for key, _, k, n, s in lines.probes(close, own=True))
                for key, k, n, start in entries:
                    h = int(key.view(np.int64)[0]) if len(key) else None
                    if h not in hot:
                        continue
                    n = length if n is None else int(n[0])
                    edits = int(close.edits(n))
                    own, size = segments(n, edits + 1)[k]
                    start = own if start is None else int(start[0])
                    sides = []
                    for base, theirs, mine, budget in ((0, own, start, k), (start + size, n - own - size, length - start - size, edits - k)):
                        side = []
                        for q, (a, w) in enumerate(segments(theirs, budget + 1)):
                            for m in range(-budget, budget + 1) if probing else (0,):
                                if 0 <= a + m and a + m + w <= mine:
                                    at = np.array([base + a + m])
                                    side.append((q, int(lines.hashes.hash(at, at + w)[0])))
                        sides.append(side)
                    out += [xxhash.xxh64_intdigest(b"%d|%d|%d|%d|%d" % (h, *x, *y)) for x in sides[0] for y in sides[1]]
                for key, use, side, band in chain(lines.tails(close, False), lines.tails(close, True) if probing else ()):
                    for h in key.view(np.int64).tolist():
                        if h in hot:
                            out += [xxhash.xxh64_intdigest(b"%d|%d" % (h, int(lines.tail(use, s, band, part)[0]))) for s, part in ((side, 70), (1 - side, 20))]
                got = np.unique(np.array(out, np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(np.full(len(got), lines.ids[0]).view(np.int64))], ["key", "id"])

    return lines.select("line", "keys").mapInArrow(run, "key long, id long")


def _exploded(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line_no, line, h1, h2) of every line with a word. row stands for the document: rows alike in id and text are one."""
    base = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return base.where(F.col("line").rlike(WORD)).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def _texts(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(h1, h2, line), once each, of the lines whose h1 is one of the n ids."""
    found = _exploded(docs).select("h1", "h2", "line").join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, F.col("h1") == ids["id"], "left_semi")
    return found.groupBy("h1", "h2").agg(F.first("line").alias("line"))


def _met(index: DataFrame, probes: DataFrame) -> DataFrame:
    a, p = index.alias("a"), probes.alias("p")
    met = p.join(a, (F.col("a.key") == F.col("p.key")) & (F.col("a.id") != F.col("p.id")))
    return met.select(F.least("a.id", "p.id").alias("x"), F.greatest("a.id", "p.id").alias("y"))


def candidates(docs: DataFrame, close: Closeness, hot: int = HOT_BUCKET) -> DataFrame:
    """Pairs (x, y) of ids of lines of docs(doc_id, text) that may be near; no near pair of different lines is missing.

    Of all entries, which are shuffled once, only those stay under whose key a line is indexed and another one stands.
    Buckets of more than hot lines are taken out of the join, and what falls into them is joined by keys of more of the
    line instead, which near lines share too.
    """
    bucket = Window.partitionBy("key")
    entries = _keys(docs, close).withColumns({"low": F.min("id").over(bucket), "high": F.max("id").over(bucket), "unmet": F.min("probe").over(bucket)})
    entries = materialise(entries.where("low <> high AND NOT unmet").select("key", "id", "probe").distinct(), "lines-entries")
    sizes = entries.where("NOT probe").groupBy("key").count()
    crowded = materialise(sizes.where(F.col("count") > hot).select("key"), "lines-hot")
    n = crowded.count()
    mark = F.broadcast(crowded) if n <= BROADCAST_IDS else crowded
    calm = entries.join(mark, "key", "left_anti") if n else entries
    found = _met(calm.where("NOT probe"), calm)
    if n:
        held = materialise(entries.join(mark, "key", "left_semi").groupBy("id").agg(F.collect_set("key").alias("keys")), "lines-refined")
        texts = materialise(_texts(docs, held.select("id"), held.count()).join(held, F.col("h1") == F.col("id")).select("line", "keys"), "lines-hot-texts")
        found = found.unionByName(_met(_refined(texts, close, False), _refined(texts, close, True)))
    return found.distinct()


def line_links(docs: DataFrame, close: Closeness = Closeness(), hot: int = HOT_BUCKET) -> DataFrame:  # noqa: B008
    """Pairs (a1, a2, b1, b2) of the 128-bit ids of different lines of docs(doc_id, text) that are near, each once."""
    if not close.max_edits and not close.chars_per_stretch:
        return docs.sparkSession.createDataFrame([], "a1 long, a2 long, b1 long, b2 long")
    pairs = materialise(candidates(docs, close, hot), "lines-candidates")
    ids = materialise(pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))).distinct(), "lines-ids")
    texts = materialise(_texts(docs, ids, ids.count()), "lines-texts")
    # two different lines of one 64-bit id are both looked up under it
    a = texts.select(F.col("h1").alias("x"), F.col("h2").alias("a2"), F.col("line").alias("a"))
    b = texts.select(F.col("h1").alias("y"), F.col("h2").alias("b2"), F.col("line").alias("b"))
    both = pairs.join(a, "x").join(b, "y").select("x", "a2", "y", "b2", "a", "b")

    def verify(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                rows = batch.slice(i, 4096)
                lines = list(zip(rows.column(4).to_pylist(), rows.column(5).to_pylist(), strict=True))
                short = np.array([min(len(x), len(y)) for x, y in lines], np.int64)
                near = distances(lines, close.max_edits) <= close.edits(short)
                rest = np.flatnonzero(~near & (close.stretch(short) > 0))
                near[rest] = [max(map(len, trim(*map(code_points, lines[k])))) <= most for k, most in zip(rest.tolist(), close.stretch(short[rest]).tolist(), strict=True)]
                near = pa.array(near)
                yield pa.RecordBatch.from_arrays([rows.column(c).filter(near) for c in range(4)], ["a1", "a2", "b1", "b2"])
        release_memory()

    return materialise(both.mapInArrow(verify, T.StructType([T.StructField(c, T.LongType()) for c in ("a1", "a2", "b1", "b2")])), "lines-links")


def _node(a, b):
    return F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))


def line_classes(docs: DataFrame, close: Closeness = Closeness(), text_col: str = "text", id_col: str = "doc_id", hot: int = HOT_BUCKET) -> DataFrame:  # noqa: B008
    """A row for each line that holds a word: doc_id, row, line_no, class_doc_id, class_line_no, n_links, n_copies, kept.

    A text's lines are what \\n parts, numbered from 0. Lines are linked if equal or near (see Closeness); a class is what
    links connect, named by its first line in order of (doc_id, line number), nulls last. n_links: different lines that
    are near this one; n_copies: lines equal to it, itself included; kept: whether it is its class's first.

    Null and empty texts and lines without a word give no row. Rows alike in id and text are one document, each with
    rows of its own here; of documents with one id and different texts, the hash of the text (row) decides. No rows in,
    none out. Other columns are not read. Equal lines meet only in aggregates, never in pairs, however many they are.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    lines = materialise(_exploded(docs).select("doc_id", "row", "line_no", "h1", "h2"), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "line_no")
    distinct = materialise(lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n_copies")), "lines-distinct")
    links = line_links(docs, close, hot)
    edges = links.select(_node("a1", "a2").alias("a"), _node("b1", "b2").alias("b"))
    member = components(edges)
    degree = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    linked = links.select(F.col("a1").alias("h1"), F.col("a2").alias("h2")).unionByName(links.select(F.col("b1").alias("h1"), F.col("b2").alias("h2"))).distinct()
    linked = linked.withColumn("node", _node("h1", "h2")).join(member, "node").join(degree, "node")
    linked = linked.join(distinct.select("h1", "h2", "first"), ["h1", "h2"])
    heads = linked.groupBy("component").agg(F.min("first").alias("head"))
    linked = materialise(linked.join(heads, "component").select("h1", "h2", "head", "n_links"), "lines-linked")
    whole = distinct.join(linked, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("head", "first").alias("head"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    got = lines.join(whole, ["h1", "h2"])
    return got.select(
        "doc_id", "row", "line_no", F.col("head.doc_id").alias("class_doc_id"), F.col("head.line_no").alias("class_line_no"), "n_links", "n_copies", (place == F.col("head")).alias("kept")
    )


def dedup_lines(docs: DataFrame, close: Closeness = Closeness(), text_col: str = "text", id_col: str = "doc_id", min_chars: int = 20, hot: int = HOT_BUCKET) -> DataFrame:  # noqa: B008
    """docs with each class of lines left only where it first stands; documents whose every line with a word is gone go too.

    A document's own later copies of a line go as well. Lines of fewer than min_chars code points, which may be alike by
    chance, and lines without a word stay where they are. Null and empty texts stay. Texts without such copies are
    returned as they are; the columns are those of docs, extra ones included, and rows that are repeated stay repeated.
    """
    text = F.col(f"`{text_col}`")
    found = line_classes(docs, close, text_col, id_col, hot)
    gone = found.where(~F.col("kept")).groupBy("doc_id", "row").agg(F.collect_set("line_no").alias("gone"))
    names = docs.columns
    base = docs.select(*(F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(names)), F.xxhash64(F.col(f"`{id_col}`"), text.cast("string")).alias("row"))
    body = F.col(f"k{names.index(text_col)}")
    same = (base["row"] == gone["row"]) & base[f"k{names.index(id_col)}"].eqNullSafe(gone["doc_id"])
    joined = base.join(gone, same, "left").drop(gone["row"], gone["doc_id"])
    stays = F.filter(F.split(body, "\n"), lambda x, i: (F.char_length(x) < min_chars) | ~F.array_contains(F.col("gone"), i))
    left = F.when(F.col("gone").isNull(), body).otherwise(F.array_join(stays, "\n"))
    joined = joined.withColumn("left", left)
    joined = joined.where(F.col("gone").isNull() | F.col("left").rlike(WORD))
    return joined.select(*(F.col("left" if c == text_col else f"k{n}").alias(c) for n, c in enumerate(names)))
