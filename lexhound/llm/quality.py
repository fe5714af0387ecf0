"""Quality rules: statistics of whole texts, and an isolation forest over them."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, segment_sums, text_buffers

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "n_lines", "n_digits", "n_upper", "n_stops", "n_marks")
WINDOW = 5
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?{}[]=_/\\@~^"]] = True

TREES, SAMPLE, DEPTH = 128, 256, 16
#: Labelled rows from which trees are drawn and thresholds come, at most (in expectation).
LABELLED_ROWS = 50_000


def repeats(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word (its id and its document's number), whether a window of five words over it occurs twice in the document."""
    n = len(ids)
    covered = np.zeros(n, bool)
    if n < WINDOW:
        return covered
    m = n - WINDOW + 1
    key = np.zeros(m, np.uint64)
    x = ids.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            key = (key ^ x[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        key = (key ^ doc[:m].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(32)
    whole = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :])  # windows within one document
    order = whole[np.argsort(key[whole], kind="stable")]
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if not len(same):
        return covered
    # of equal hashes, the words themselves decide
    a, b = order[same], order[same + 1]
    equal = doc[a] == doc[b]
    for k in range(WINDOW):
        equal &= ids[a + k] == ids[b + k]
    hit = np.zeros(n + 1, np.int64)
    twice = np.zeros(m, bool)
    twice[a[equal]] = twice[b[equal]] = True
    starts = np.flatnonzero(twice)
    np.add.at(hit, starts, 1)
    np.add.at(hit, starts + WINDOW, -1)
    return np.cumsum(hit[:-1]) > 0


def text_stats(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """STATS of each text, whole, as rows of integers."""
    out = np.zeros((len(at) - 1, len(STATS)), np.int64)
    for i, j in chunks(at):
        part, bounds = data[at[i] : at[j]], at[i : j + 1] - at[i]
        blank = _BLANK[part]
        flags = {1: ~blank & ((part & 0xC0) != 0x80), 2: _SYMBOL[part], 7: _DIGIT[part], 8: _UPPER[part], 9: _STOP[part], 10: _MARK[part]}
        for k, f in flags.items():
            out[i:j, k] = segment_sums(f, bounds)
        out[i:j, 5] = np.diff(bounds)
        number = defaultdict(count().__next__)
        ids, sizes = [], []
        raw = part.tobytes()
        for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), i):
            text = raw[a:b]
            words = text.split()
            ids += map(number.__getitem__, words)
            sizes.append(len(words))
            lines = [x for x in text.split(b"\n") if x and not x.isspace()] if b"\n" in text else [text] if words else []
            out[d, 3] = len(lines) - len(set(lines))
            out[d, 6] = len(lines)
        out[i:j, 0] = sizes
        if ids:
            doc = np.repeat(np.arange(len(sizes)), sizes)
            out[i:j, 4] = segment_sums(repeats(np.array(ids, np.int64), doc), np.concatenate([[0], np.cumsum(sizes)]))
    return out


def rule_stats(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep columns of docs with STATS (long) of the whole text; a null text has those of an empty one."""
    source = docs.select(*(F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(keep)), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([*source.schema.fields[:-1], *(T.StructField(s, T.LongType()) for s in STATS)])

    def run(batches):
        for batch in batches:
            got = text_stats(*text_buffers(batch.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), *(pa.array(got[:, k]) for k in range(len(STATS)))], [f.name for f in schema])

    return source.mapInArrow(run, schema).select(*(F.col(f"k{n}").alias(c) for n, c in enumerate(keep)), *STATS)


def features(stats: np.ndarray) -> np.ndarray:
    """Ratios that don't follow a text's length, from rows of STATS; on log scales, where they start from 0."""
    s = stats.astype(np.float64)
    col = {name: s[:, k] for k, name in enumerate(STATS)}
    words, size, lines = np.maximum(col["n_words"], 1), np.maximum(col["n_bytes"], 1), np.maximum(col["n_lines"], 1)
    return np.column_stack(
        [
            np.log(1 + col["word_chars"] / words),
            np.log(0.02 + col["n_symbols"] / words),
            np.sqrt(col["n_dup_lines"] / lines),
            np.sqrt(col["n_repeat_words"] / words),
            np.sqrt(col["n_digits"] / size),
            np.log(0.1 + col["n_upper"] / words),
            np.log(0.1 + col["n_stops"] / words),
            np.log(0.02 + col["n_marks"] / words),
        ]
    )


@dataclass
class Forest:
    """Trees in arrays: feature (-1: leaf), split value, children, and the path length that a leaf stands for."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    roots: np.ndarray
    norm: float
    threshold: float = 1.0


def _mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, sample: int = SAMPLE, depth_limit: int = DEPTH, seed: int = 7) -> Forest:
    """An isolation forest over the rows of x: each tree splits a sample at random values of random features.

    A node's values are drawn from its whole box, which starts from low to high, not only from where its rows lie: so
    places that no row of x takes are cut off early, and rows of another kind are isolated there though there be many.
    """
    rng = np.random.default_rng(seed)
    feature, value, left, depth, roots = [], [], [], [], []
    sample = min(sample, len(x))
    wide = np.flatnonzero(high > low)
    for _ in range(trees if len(x) else 0):
        rows = x[rng.choice(len(x), sample, replace=False)]
        roots.append(len(feature))
        feature.append(0), value.append(0.0), left.append(0), depth.append(0.0)
        todo = [(roots[-1], rows, 0, low.copy(), high.copy())]
        while todo:
            node, r, d, lo, hi = todo.pop()
            if d >= depth_limit or len(r) <= 1 or not len(wide):
                feature[node], depth[node] = -1, d + _mean_path(len(r))
                continue
            f = int(rng.choice(wide))
            v = rng.uniform(lo[f], hi[f])
            feature[node], value[node], left[node] = f, v, len(feature)
            for side, part in enumerate((r[r[:, f] < v], r[r[:, f] >= v])):
                feature.append(0), value.append(0.0), left.append(0), depth.append(0.0)
                l2, h2 = lo.copy(), hi.copy()
                (h2 if side == 0 else l2)[f] = v
                todo.append((left[node] + side, part, d + 1, l2, h2))
    return Forest(*(np.array(a) for a in (feature, value, left, depth)), np.array(roots, np.int64), depth_limit + max(_mean_path(sample), 1e-9))


def anomaly(forest: Forest, x: np.ndarray) -> np.ndarray:
    """2 ** (-mean path / norm) of each row: near 1 for rows that few splits isolate."""
    total = np.zeros(len(x))
    for root in forest.roots:
        node = np.full(len(x), root)
        live = np.arange(len(x))
        while len(live):
            f = forest.feature[node[live]]
            leaf = f < 0
            if leaf.any():
                total[live[leaf]] += forest.depth[node[live[leaf]]]
                live, f = live[~leaf], f[~leaf]
            if len(live):
                at = node[live]
                node[live] = forest.left[at] + (x[live, f] >= forest.value[at])
    return np.exp2(-total / max(len(forest.roots), 1) / forest.norm)


def calibrate(score: np.ndarray, good: np.ndarray, most_good_lost: float = 0.004) -> float:
    """The threshold above which rows go: it parts good from bad labels best among those that lose at most that share of the good."""
    if not good.any() or good.all():
        return float(np.nextafter(score.max(), 2)) if len(score) else 1.0
    order = np.argsort(-score, kind="stable")
    s, g = score[order], good[order]
    lost, caught = np.cumsum(g) / g.sum(), np.cumsum(~g) / (~g).sum()
    last = np.append(s[1:] != s[:-1], True)  # equal scores go together
    ok = last & (lost <= most_good_lost)
    if not ok.any():
        return float(np.nextafter(s[0], 2))
    best = np.flatnonzero(ok)[np.argmax((caught - lost)[ok])]
    if caught[best] <= lost[best]:
        return float(np.nextafter(s[0], 2))
    return float((s[best] + s[best + 1]) / 2) if best + 1 < len(s) else float(s[best])


def base_failed():
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def ranges(stats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest value of each of features() over all rows (0 without rows)."""

    def run(batches):
        for batch in batches:
            x = features(np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(STATS))]).astype(np.int64))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*x.min(0), *x.max(0))], names)

    width = features(np.zeros((0, len(STATS)), np.int64)).shape[1]
    low, high = [f"low{k}" for k in range(width)], [f"high{k}" for k in range(width)]
    names = low + high
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in names])
    got = stats.select(*STATS).mapInArrow(run, schema).agg(*(F.min(c).alias(c) for c in low), *(F.max(c).alias(c) for c in high)).first()
    return np.array([got[c] or 0.0 for c in low]), np.array([got[c] or 0.0 for c in high])


def fit(stats: DataFrame, labels: DataFrame, labelled: int = LABELLED_ROWS, most_good_lost: float = 0.004) -> Forest:
    """A forest from rows (doc_id, STATS), its threshold from labels (doc_id, quality: 0 is bad).

    The ranges from which values are drawn are those of all rows that pass the base rules. Trees are grown from labelled
    good ones among these, the threshold is set on all labelled ones; that sample is chosen by the hash of doc_id and
    bounded in expectation. Without labels of both kinds nothing is rejected. If none is good, trees are grown from the
    bad ones; without any there are no trees, and each row's anomaly is 1.
    """
    draw = F.pmod(F.xxhash64("doc_id", F.lit("forest")), F.lit(1 << 30)) / float(1 << 30)
    passed = stats.where(~base_failed())
    low, high = ranges(passed)
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = known.where(draw < labelled / max(known.count(), 1))
    y = passed.join(picked, "doc_id").orderBy("doc_id", *STATS).select("quality", *STATS).toPandas()
    good = y["quality"].to_numpy() != 0
    given = features(y[list(STATS)].to_numpy(np.int64))
    forest = grow(given[good] if good.any() else given, low, high)
    if len(y) and len(forest.roots):
        forest.threshold = calibrate(anomaly(forest, given), good, most_good_lost)
    return forest


def judge(stats: DataFrame, forest: Forest) -> DataFrame:
    """stats with base_failed, anomaly (double) and kept: not base_failed, and no more anomalous than the threshold."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)  # bounded: trees * 2 * sample nodes
    source = stats.select(*(F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(stats.columns)), base_failed().alias("base_failed"))
    where = [stats.columns.index(s) for s in STATS]
    schema = T.StructType([*source.schema.fields, T.StructField("anomaly", T.DoubleType())])

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in where]).astype(np.int64)
            score = np.concatenate([anomaly(shared.value, features(x[i : i + 4096])) for i in range(0, len(x), 4096)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [f.name for f in schema])

    got = source.mapInArrow(run, schema)
    got = got.select(*(F.col(f"k{n}").alias(c) for n, c in enumerate(stats.columns)), "base_failed", "anomaly")
    return got.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= forest.threshold))
