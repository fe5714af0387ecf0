"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections import defaultdict
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, materialise, release_memory, row_hash, segment_sums, text_buffers
from .components import components

BITS, DISTANCE, SHINGLE, SEED = 64, 3, 3, 42
#: Two segments: of three differing bits, one has one at most.
SEGMENT = BITS // 2
#: A bucket of more distinct fingerprints than this is cut up by bytes of the other segment.
HOT_BUCKET = 64
#: Further fingerprints of a text, of its words; bins of its sketch; and the overlap of shingles that two such texts must have.
TABLES, BINS, LEAST_OVERLAP = 3, 128, 0.5
#: Words (192 bytes each, and their text) whose bits a batch keeps from chunk to chunk; beyond it starts anew.
CACHED_WORDS = 100_000
#: Rows up to this many (16 MB) are broadcast to be taken out; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def fingerprints_of(data: np.ndarray, at: np.ndarray, sketches: np.ndarray | None = None) -> np.ndarray:
    """The fingerprint of each text: the majority of each bit over the hashes of its three-word shingles; 0 without a word.

    sketches, if given, takes of each text and each of BINS ranges of the hash the least hash (its lowest 16 bits, but 0
    where there is none): the share of bins that two texts have in common is about their shingles' overlap.
    """
    out = np.zeros(len(at) - 1, np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, j in chunks(at):
        raw = data[at[i] : at[j]].tobytes().lower()
        hashes: list[int] = []
        sizes = []
        for a, b in zip((at[i:j] - at[i]).tolist(), (at[i + 1 : j + 1] - at[i]).tolist(), strict=True):
            words = raw[a:b].split()
            n = len(words)
            if n > SHINGLE:
                joined = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
                starts = [0, *(ends[: n - SHINGLE]).tolist()]
                hashes += [digest(joined[s:e], SEED) for s, e in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
                sizes.append(n - SHINGLE + 1)
            elif n:
                hashes.append(digest(b" ".join(words), SEED))
                sizes.append(1)
            else:
                sizes.append(0)
        if hashes:
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            h = np.array(hashes, np.uint64)
            if sketches is not None:
                place = (np.repeat(np.arange(i, j), sizes) * BINS) + (h >> np.uint64(57)).astype(np.int64)
                place -= i * BINS
                least = np.full((j - i) * BINS, ~np.uint64(0))
                np.minimum.at(least, place, h)
                met = np.zeros(len(least), bool)
                met[place] = True
                sketches[i:j] = np.where(met, np.maximum(least.astype(np.uint16), 1), 0).reshape(-1, BINS)
            total = np.zeros((j - i, BITS), np.int64)
            for k in range(0, j - i, 256):  # the bits of some texts at a time
                lo, hi = bounds[k], bounds[min(k + 256, j - i)]
                for lo2 in range(lo, hi, 1 << 17):
                    hi2 = min(lo2 + (1 << 17), hi)
                    bits = np.unpackbits(h[lo2:hi2].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    total[k : k + 256] += segment_sums(bits, np.clip(bounds[k : min(k + 256, j - i) + 1], lo2, hi2) - lo2, np.int64)
            over = (2 * total > np.array(sizes)[:, None]).astype(np.uint8)
            out[i:j] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def word_fingerprints_of(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """TABLES fingerprints of each text, of independent hashes: the majority of each bit over its words, which weigh the root of their count.

    A replaced word changes these less than the three shingles it is in. Weights are whole numbers, so sums are exact.
    """
    out = np.zeros((len(at) - 1, TABLES), np.uint64)
    number = defaultdict(count().__next__)
    known = np.zeros((0, BITS * TABLES), np.uint8)  # bits of the words numbered so far, which later chunks use again
    for i, j in chunks(at, 1 << 19):
        if len(number) > CACHED_WORDS:
            number, known = defaultdict(count().__next__), known[:0]
        raw = data[at[i] : at[j]].tobytes().lower()
        ids, sizes = [], []
        for a, b in zip((at[i:j] - at[i]).tolist(), (at[i + 1 : j + 1] - at[i]).tolist(), strict=True):
            words = raw[a:b].split()
            ids += map(number.__getitem__, words)
            sizes.append(len(words))
        if not ids:
            continue
        if len(number) > len(known):
            fresh = list(islice(number, len(known), None))
            hashes = np.array([[xxhash.xxh64_intdigest(w, SEED + 1 + t) for t in range(TABLES)] for w in fresh], np.uint64)
            known = np.concatenate([known, np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little")])
        pair, times = np.unique(np.repeat(np.arange(j - i), sizes) * len(number) + np.array(ids, np.int64), return_counts=True)
        doc, word = np.divmod(pair, len(number))
        weight = np.rint(16 * np.sqrt(times))
        bounds = np.searchsorted(doc, np.arange(j - i + 1))
        total = np.zeros((j - i, BITS * TABLES))
        for d in range(j - i):
            for lo in range(bounds[d], bounds[d + 1], 1 << 13):  # products of whole numbers below 2**24 are exact
                hi = min(lo + (1 << 13), bounds[d + 1])
                kind = np.float32 if weight[lo:hi].sum() < 1 << 24 else np.float64
                total[d] += weight[lo:hi].astype(kind) @ known[word[lo:hi]].astype(kind)
        over = (2 * total > segment_sums(weight.astype(np.int64), bounds)[:, None]).astype(np.uint8)
        out[i:j] = np.packbits(over, axis=1, bitorder="little").view(np.uint64)
    return out


def signatures(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep columns of docs with fp (as fingerprints()), words (array<long>, of word_fingerprints_of()) and sketch (binary) of the whole text."""
    source = docs.select(*(F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(keep)), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType(
        [*source.schema.fields[:-1], T.StructField("fp", T.LongType()), T.StructField("words", T.ArrayType(T.LongType(), False)), T.StructField("sketch", T.BinaryType())]
    )

    def run(batches):
        for batch in batches:
            data, at = text_buffers(batch.column(len(keep)))
            n = len(at) - 1
            sketches = np.zeros((n, BINS), np.uint16)
            fp = fingerprints_of(data, at, sketches).view(np.int64)
            words = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * TABLES), pa.array(word_fingerprints_of(data, at).view(np.int64).ravel()))
            raw = pa.array([r.tobytes() for r in sketches], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(fp), words, raw], [f.name for f in schema])
            release_memory()

    return source.mapInArrow(run, schema).select(*(F.col(f"k{n}").alias(c) for n, c in enumerate(keep)), "fp", "words", "sketch")


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of bins of each two sketches that are alike, of those that either fills."""
    filled = ((a != 0) | (b != 0)).sum(1)
    return ((a == b) & (a != 0)).sum(1) / np.maximum(filled, 1)


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep columns of docs with fp, the 64-bit fingerprint (long) of the whole text; null counts as empty: 0."""
    source = docs.select(*(F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(keep)), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            got = fingerprints_of(*text_buffers(batch.column(len(keep)))).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(got)], [f.name for f in schema])

    return source.mapInArrow(run, schema).select(*(F.col(f"k{n}").alias(c) for n, c in enumerate(keep)), "fp")


def _low():
    return F.lit((1 << SEGMENT) - 1).cast("long")


def _segment(fp, k):
    return fp.bitwiseAND(_low()) if k == 0 else F.shiftrightunsigned(fp, SEGMENT)


def _key(segment, k: int, bit: int):
    """Segment k without a bit, which bit of which segment that is, and the table, in one number."""
    own = segment.bitwiseAND(F.lit(((1 << SEGMENT) - 1) ^ (1 << bit)).cast("long")).bitwiseOR(F.lit((k * SEGMENT + bit) << SEGMENT).cast("long"))
    return own.bitwiseOR(F.shiftleft(F.col("table").cast("long"), SEGMENT + 6))


def near_pairs(distinct: DataFrame, hot: int = HOT_BUCKET) -> DataFrame:
    """Distinct fp, or (table, fp), to all pairs (table, a, b), a < b as longs, of a table's near fingerprints, each once.

    Near are, in table 0 (which is meant if none is given), those at DISTANCE or fewer differing bits; in others those
    one segment of which differs by at most a bit, and the other by at most DISTANCE.

    A fingerprint is indexed under each of its two segments with each one bit left out; two within the distance agree in
    such a variant. The pair is taken in one variant only: the first segment that differs by at most a bit, at that bit.
    Where so many share a segment that a bucket may be hot, its members are further keyed by each byte of the other
    segment, one of which must agree for at most three bits differ; that is exact, and no bucket is emitted whole.
    """
    fp = F.col("fp")
    if "table" not in distinct.columns:
        distinct = distinct.withColumn("table", F.lit(0))
    halves = distinct.select("table", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _segment(fp, k).alias("s")) for k in (0, 1)])).alias("x")).select("table", "x.*")
    # A bucket joins two values of a segment, so a hot one holds a value that more than half of hot share.
    crowded = halves.groupBy("table", "k", "s").count().where(F.col("count") > hot // 2)
    hot_keys = crowded.select(
        F.explode(F.array(*[F.when(F.col("k") == 0, _key(F.col("s"), 0, b)).otherwise(_key(F.col("s"), 1, b)) for b in range(SEGMENT)])).alias("key")
    ).distinct().withColumn("crowded", F.lit(True))
    # the key holds the table too; both sides of the join have the same columns, so one exchange serves them
    variants = distinct.select("fp", F.explode(F.array(*[_key(_segment(fp, k), k, b) for k in (0, 1) for b in range(SEGMENT)])).alias("key"))
    n_hot = hot_keys.count()
    if n_hot:
        marked = variants.join(F.broadcast(hot_keys) if n_hot <= 200_000 else hot_keys.hint("merge"), "key", "left")
        other = F.when(F.shiftrightunsigned("key", SEGMENT).bitwiseAND(F.lit(63).cast("long")) < SEGMENT, _segment(fp, 1)).otherwise(_segment(fp, 0))
        pieces = F.array(*[F.lit(q << 8).bitwiseOR(F.shiftrightunsigned(other, 8 * q).bitwiseAND(F.lit(255).cast("long")).cast("int")) for q in range(4)])
        marked = marked.select("fp", "key", F.explode(F.when(F.col("crowded"), pieces).otherwise(F.array(F.lit(-1)))).alias("piece"))
    else:
        marked = variants.withColumn("piece", F.lit(-1))
    # Spark takes an exploded table to be as large as the one before, and would broadcast all variants of a small one
    a, b = marked.hint("merge").alias("a"), marked.hint("merge").alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    x0, x1 = _segment(x, 0), _segment(x, 1)
    at = F.shiftrightunsigned(F.col("a.key"), SEGMENT).bitwiseAND(F.lit(63).cast("long"))
    first0, first1 = F.bit_count(x0) <= 1, F.bit_count(x1) <= 1
    # the bit that differs in a segment, 0 if none does
    bit_of = lambda s: F.when(s == 0, F.lit(0)).otherwise(F.round(F.log2(s.cast("double"))).cast("int"))
    chosen = F.when(first0, bit_of(x0)).when(first1, bit_of(x1) + SEGMENT)
    rest = F.when(first0, x1).otherwise(x0)
    equal = [F.shiftrightunsigned(rest, 8 * q).bitwiseAND(F.lit(255).cast("long")) == 0 for q in range(4)]
    piece = F.when(equal[0], 0).when(equal[1], 1).when(equal[2], 2).otherwise(3)
    once = (F.col("a.piece") < 0) | (F.shiftright(F.col("a.piece"), 8) == piece)
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.piece") == F.col("b.piece")) & (F.col("a.fp") < F.col("b.fp"))
    table = F.shiftrightunsigned(F.col("a.key"), SEGMENT + 6).cast("int")
    near = F.when(table == 0, F.bit_count(x) <= DISTANCE).otherwise(F.bit_count(rest) <= DISTANCE)
    pairs = a.join(b, on & near & (at == chosen) & once)
    return pairs.select(table.alias("table"), F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, fp, n_near, component_id of every row: links join fingerprints that differ in at most three bits.

    n_near: other rows linked directly, those of one fingerprint included. component_id: the smallest id that links
    lead to. Rows are first grouped by fingerprint, so copies, however many, are one node and are never paired. A text
    without a word has fingerprint 0 and is linked like any other. Repeated rows are rows of their own; a null id is
    kept and never the smallest unless all are null. No rows in, no rows out. Other columns are not read.
    """
    marked = materialise(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"]), "simhash")
    return link(marked)


def link(marked: DataFrame) -> DataFrame:
    """near_duplicates() for rows (doc_id, fp)."""
    return marked.join(_labels(marked), "fp").select("doc_id", "fp", F.col("n_near").cast("long"), "component_id")


def _labels(marked: DataFrame) -> DataFrame:
    """(fp, n_near, component, component_id) of each fingerprint of (doc_id, fp); component: its least fingerprint."""
    nodes = materialise(marked.groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")), "simhash-nodes")
    pairs = materialise(near_pairs(nodes.select("fp")).drop("table"), "simhash-pairs")
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = nodes.select(F.col("fp").alias("b"), F.col("copies").alias("beside"))
    degree = ends.join(copies, "b").groupBy("a").agg(F.sum("beside").alias("near")).select(F.col("a").alias("fp"), "near")
    member = components(pairs).select(F.col("node").alias("fp"), "component")
    graph = nodes.join(degree, "fp", "left").join(member, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = graph.groupBy("component").agg(F.min("least").alias("component_id"))
    near = F.col("copies") - 1 + F.coalesce("near", F.lit(0))
    return graph.join(least, "component").select("fp", near.alias("n_near"), "component", "component_id")


def wide_links(nodes: DataFrame, least_overlap: float, hot: int = HOT_BUCKET) -> DataFrame:
    """Pairs (a, b) of the fp of nodes(fp, words, sketch), which are distinct in fp, that are linked; each once, a < b.

    Linked are fingerprints at DISTANCE or fewer differing bits; and texts whose sketches overlap by least_overlap, if in
    one of TABLES they are candidates: their word fingerprints are near (see near_pairs()), where of texts with one
    word fingerprint the least fp stands for all, or equal, of which each is compared with that least one.
    """
    by_word = nodes.select("fp", F.posexplode("words").alias("table", "word")).withColumn("table", F.col("table") + 1)
    least = materialise(by_word.groupBy("table", "word").agg(F.min("fp").alias("least")), "simhash-words")
    every = least.select("table", F.col("word").alias("fp")).unionByName(nodes.select(F.lit(0).alias("table"), "fp"))
    pairs = materialise(near_pairs(every, hot), "simhash-pairs")
    of = lambda end: least.select("table", F.col("word").alias(end), F.col("least").alias(f"{end}_fp"))
    found = pairs.where("table > 0").join(of("a"), ["table", "a"]).join(of("b"), ["table", "b"]).select(F.col("a_fp").alias("x"), F.col("b_fp").alias("y"))
    found = found.unionByName(by_word.join(least, ["table", "word"]).select(F.col("least").alias("x"), F.col("fp").alias("y")))
    found = found.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    sketch = lambda end: nodes.select(F.col("fp").alias(end), F.col("sketch").alias(f"{end}_sketch"))
    met = found.join(sketch("a"), "a").join(sketch("b"), "b").select("a", "b", "a_sketch", "b_sketch")

    def verify(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BINS) for c in (2, 3))
                near = pa.array(overlaps(x, y) >= least_overlap)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(near) for c in (0, 1)], ["a", "b"])

    verified = met.mapInArrow(verify, "a long, b long")
    return pairs.where("table = 0").select("a", "b").unionByName(verified).distinct()


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_overlap: float = LEAST_OVERLAP, hot: int = HOT_BUCKET) -> DataFrame:
    """docs with one row left of each component of wide_links(): that with the smallest id, nulls last, and of such rows that with the smallest hash of all columns.

    The columns are those of docs. Null and empty texts, and all without a word, are near duplicates of each other. Rows
    that are alike in all columns are one. Only rows that go, or that are repeated, are matched by their hashes; texts of
    others aren't shuffled.
    """
    names = docs.columns
    row = row_hash(docs).alias("row")
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), row)
    marked = materialise(signatures(own, ["doc_id", "row"]), "simhash")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    nodes = marked.groupBy("fp").agg(F.min_by(F.struct(place.alias("place"), "words", "sketch"), place).alias("kept")).select("fp", "kept.*")
    nodes = materialise(nodes, "simhash-nodes")
    member = components(wide_links(nodes, least_overlap, hot)).withColumnRenamed("node", "fp")
    heads = nodes.join(member, "fp", "left").groupBy(F.coalesce("component", "fp").alias("component")).agg(F.min("place").alias("head"))
    heads = heads.select(F.col("head.doc_id").alias("doc_id"), F.col("head.row").alias("row"))
    same = lambda a, b, key: (a["row"] == b["row"]) & a[key].eqNullSafe(b["doc_id"])
    rows = marked.groupBy("doc_id", "row").count()
    gone = materialise(rows.join(heads, same(rows, heads, "doc_id"), "left_anti").select("doc_id", "row"), "simhash-gone")
    twice = rows.where("count > 1").join(heads, same(rows, heads, "doc_id"), "left_semi").select("doc_id", "row")
    twice = materialise(twice, "simhash-twice")
    base = docs.select(*(F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(names)), row)
    key = f"k{names.index(id_col)}"

    def against(table):
        return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table

    gone, doubled = against(gone), against(twice)
    stay = base.join(gone, same(base, gone, key), "left_anti")
    if not twice.isEmpty():
        single = stay.join(doubled, same(stay, doubled, key), "left_anti")
        stay = single.unionByName(stay.join(doubled, same(stay, doubled, key), "left_semi").dropDuplicates(["row", key]))
    return stay.select(*(F.col(f"k{n}").alias(c) for n, c in enumerate(names)))
