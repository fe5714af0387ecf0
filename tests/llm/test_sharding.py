import random
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexhound.llm.sharding import Capacities, balanced_pack, pack, rounded_size, shard


def test_the_tree_finds_the_tightest_bin():
    rng = random.Random(5)
    tree, flat = Capacities(), []
    for k in range(4000):
        if rng.random() < 0.6:
            room = rng.randint(0, 60)
            tree.add(room, k)
            insort(flat, (room, k))
        else:
            size = rng.randint(0, 70)
            at = bisect_left(flat, (size, -1))
            assert tree.take_tightest(size) == (flat.pop(at) if at < len(flat) else None)


def naive(sizes, capacity):
    left = []
    for s in sorted(sizes, reverse=True):
        fits = [(room, b) for b, room in enumerate(left) if room >= s]
        if fits:
            left[min(fits)[1]] -= s
        else:
            left.append(max(capacity, s) - s)
    return left


def test_pack_is_best_fit_decreasing():
    rng = random.Random(6)
    for _ in range(50):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 60))]
        classes = sorted(((s, sizes.count(s)) for s in set(sizes)), reverse=True)
        runs = pack(classes, 40)
        held = defaultdict(int)
        for s, b, k in runs:
            held[b] += s * k
        assert sorted(40 - v for v in held.values()) == sorted(naive(sizes, 40))
    assert pack([(50, 2), (1, 3)], 40) == [(50, 0, 1), (50, 1, 1), (1, 2, 3)]
    assert pack([(5, 3)], 5, 2) is None
    assert balanced_pack([], 3) == []


def test_rounded_sizes(spark):
    values = [0, 1, 2**14 - 1, 2**14, 2**14 + 1, 2**20 + 1, 3 * 2**30 + 7, 2**50 + 1]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(rounded_size(F.col("v"))).collect()]
    assert all(v <= g <= v + v / 8192 for v, g in zip(values, got, strict=True)) and got[:4] == values[:4]
    assert all(g >> max(0, g.bit_length() - 14) << max(0, g.bit_length() - 14) == g for g in got)


def rows():
    rng = random.Random(7)
    texts = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 400))) for _ in range(300)]
    got = [(k, t, "x", 1) for k, t in enumerate(texts)] + [(500 + k, "a hot text", "x", 1) for k in range(150)]
    return [*got, (700, None, None, None), (701, "", "", 0), (702, "", "", 0), (3, texts[3], "x", 1), (None, "no id", "x", 2)]


@pytest.mark.parametrize("how", [{"shards": 16}, {"shards": None, "capacity": 5000}, {"shards": 1}])
def test_frames(spark, how):
    given = rows()
    df = spark.createDataFrame(given, "doc_id long, text string, shard string, g1 int")
    got = shard(df, **how).collect()
    size = {}
    for d, t, *_ in given:
        size[d] = (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), t or "")
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((d is None, d or 0) for d, *_ in given)
    bytes_of, where, slots = defaultdict(int), defaultdict(set), defaultdict(list)
    for r in got:
        assert (r["size"], r["text_crc32"]) == size[r["doc_id"]][:2]
        bytes_of[r["shard"]] += r["size"]
        where[size[r["doc_id"]][2]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(x) == 1 for x in where.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    total = sum(bytes_of.values())
    if how.get("shards"):
        assert len(bytes_of) == how["shards"] and max(bytes_of.values()) - min(bytes_of.values()) < 0.02 * total
    else:
        assert max(bytes_of.values()) <= 5000 and len(bytes_of) <= -(-total // 5000) + 1
    assert shard(df.limit(0), **how).count() == 0
