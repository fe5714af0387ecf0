import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexhound.llm.simhash import LEAST_OVERLAP, TABLES, drop_near_duplicates, fingerprints_of, link, near_duplicates, near_pairs, word_fingerprints_of


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints():
    rng = random.Random(1)
    texts = ["", " \n", "One", "one two", "A b C d", "ÀÉ \x85 x\x0by"] + [" ".join(rng.choice(["ab", "É", "x"]) for _ in range(rng.randint(1, 600))) for _ in range(40)]
    raw = [t.encode() for t in texts]
    got = fingerprints_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert got.tolist() == [brute_fingerprint(t) for t in texts]


def brute_links(fps):
    near = {i: {j for j, y in fps.items() if j != i and bin(x ^ y).count("1") <= 3} for i, x in fps.items()}
    least = {}
    for i in fps:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least[i] = min(seen)
    return {i: (len(near[i]), least[i]) for i in fps}


@pytest.mark.parametrize("hot", [64, 1])
def test_links_are_those_of_brute_force(spark, hot, monkeypatch):
    from lexhound.llm import simhash

    monkeypatch.setattr(simhash.near_pairs, "__defaults__", (hot,))
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    base += [base[0] & ~0xFFFFFFFF | rng.getrandbits(32) for _ in range(40)]  # one half in common
    fps = {}
    for k in range(260):
        x = rng.choice(base)
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
            x ^= 1 << rng.randrange(64)
        fps[k] = x
    signed = [(k, x - (1 << 64) if x >> 63 else x) for k, x in fps.items()]
    got = link(spark.createDataFrame(signed, "doc_id long, fp long")).collect()
    assert {r["doc_id"]: (r["n_near"], r["component_id"]) for r in got} == brute_links(fps)


def test_frames(spark):
    text = " ".join(f"word{k}" for k in range(400))
    rows = [(5, text, "a"), (3, text + " more", "b"), (9, text.upper(), "c"), (7, "something else that stands alone here", "d"), (8, None, "e"), (2, "", "f"), (2, "", "f"), (None, text, "g")]
    long = "very long text of the same words " * 30_000
    rows += [(400, long, "i"), (401, long + "end", "i")]
    rows += [(100 + k, "copies of one text, and of no other", "h") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = defaultdict(list)
    for r in near_duplicates(df).collect():
        got[r["doc_id"]].append((r["n_near"], r["component_id"]))
    assert got[5] == [(3, 3)] and got[None] == [(3, 3)] and got[7] == [(0, 7)] and got[8] == [(2, 2)] and got[2] == [(2, 2)] * 2
    assert got[150] == [(199, 100)] and got[400] == got[401] == [(1, 400)]
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["fp"]) for r in kept.collect()) == [(2, "f"), (3, "b"), (7, "d"), (100, "h"), (400, "i")]
    assert near_duplicates(df.limit(0)).count() == 0 and drop_near_duplicates(df.limit(0)).count() == 0
    assert drop_near_duplicates(df.where(F.col("doc_id").isNull())).count() == 1


def _lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", _lowered(text))


def brute_word_fingerprints(text):
    out, times = [], Counter(_words(text))
    for table in range(TABLES):
        x = 0
        total = sum(round(16 * math.sqrt(n)) for n in times.values())
        for bit in range(64):
            if 2 * sum(round(16 * math.sqrt(n)) for w, n in times.items() if xxhash.xxh64_intdigest(w.encode(), 43 + table) >> bit & 1) > total:
                x |= 1 << bit
        out.append(x)
    return out


def brute_sketch(text):
    words, least = _words(text), {}
    for shingle in [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else []):
        h = xxhash.xxh64_intdigest(" ".join(shingle).encode(), 42)
        least[h >> 57] = min(least.get(h >> 57, h), h)
    return {k: max(h & 0xFFFF, 1) for k, h in least.items()}


def brute_drop(rows, least_overlap=LEAST_OVERLAP):
    """The ids that stay of rows (doc_id, text), whose ids differ."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    groups = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        groups.setdefault(brute_fingerprint(t or ""), []).append((d, t))
    nodes = {fp: (own[0][0], brute_word_fingerprints(own[0][1]), brute_sketch(own[0][1])) for fp, own in groups.items()}
    bits = lambda x: bin(x).count("1")
    linked = {fp: {fp} for fp in nodes}

    def link(x, y):
        linked[x].add(y)
        linked[y].add(x)

    for x, y in combinations(nodes, 2):
        if bits(x ^ y) <= 3:
            link(x, y)
    for table in range(TABLES):
        least = {}
        for fp, (_, words, _) in nodes.items():
            w = words[table]
            least[w] = min(least.get(w, fp), fp, key=signed)
        near = [(least[words[table]], fp) for fp, (_, words, _) in nodes.items()]
        for v, w in combinations(least, 2):
            low, high = bits((v ^ w) & 0xFFFFFFFF), bits((v ^ w) >> 32)
            if low <= 1 and high <= 3 or high <= 1 and low <= 3:
                near.append((least[v], least[w]))
        for x, y in near:
            a, b = nodes[x][2], nodes[y][2]
            if sum(a.get(k) == h for k, h in b.items()) >= least_overlap * max(1, len(a.keys() | b.keys())):
                link(x, y)
    stay, seen = set(), set()
    for start in nodes:
        if start in seen:
            continue
        group, todo = {start}, [start]
        while todo:
            for y in linked[todo.pop()] - group:
                group.add(y)
                todo.append(y)
        seen |= group
        stay.add(min(nodes[x][0] for x in group))
    return stay


def near_copies(seed, n=60):
    """Texts, and copies of which some words are replaced or moved."""
    rng = random.Random(seed)
    vocabulary = [f"word{k}" for k in range(400)] + ["the", "of", "and"] * 60
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 150)))) for k in range(n)]
    for k in range(n):
        words = rows[k][1].split()
        for _ in range(rng.randint(0, 1 + len(words) // 15)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((n + k, " ".join(words)))
    rows += [(4 * n + k, " ".join(sorted(rows[k][1].split()))) for k in range(10)]  # the same words in another order
    return [*rows, (9000, None), (9001, ""), (9002, "A b C"), (9003, "a B c")]


@pytest.mark.parametrize(("seed", "hot"), [(1, 64), (2, 1)])
def test_wide_links_are_those_of_brute_force(spark, seed, hot):
    rows = near_copies(seed)
    kept = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot)
    got = {r["doc_id"] for r in kept.collect()}
    assert got == brute_drop(rows)
    assert len(brute_drop(rows, 2.0)) > len(got) + 5


def test_signatures_of_long_texts_in_pieces():
    text = " ".join(f"w{k % 7000} the" for k in range(60_000))
    raw = np.frombuffer(text.encode(), np.uint8)
    assert word_fingerprints_of(raw, np.array([0, len(raw)]))[0].tolist() == brute_word_fingerprints(text)
    data = np.frombuffer((text + "a b" + "").encode(), np.uint8)
    at = np.array([0, len(text), len(text) + 3, len(text) + 3])
    assert word_fingerprints_of(data, at)[1].tolist() == brute_word_fingerprints("a b") and not word_fingerprints_of(data, at)[2].any()


def test_repeated_rows_and_rows_that_differ_elsewhere(spark):
    text = "a text of some words that several rows have in common"
    rows = [(1, text, "a"), (1, text, "b"), (1, text, "b"), (2, "another text which stands alone here", "c"), (2, "another text which stands alone here", "c"), (None, text, "d")]
    got = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, other string"))
    assert sorted((r["doc_id"], r["other"] if r["doc_id"] == 2 else "") for r in got.collect()) == [(1, ""), (2, "c")]


@pytest.mark.parametrize("hot", [64, 1])
def test_variants_are_not_broadcast(spark, tmp_path, hot):
    """64 variants of each fingerprint, whose size Spark underrates by as much, would go through the driver's memory."""
    spark.range(1000).select((F.col("id") % 500).alias("fp")).distinct().write.parquet(str(tmp_path / "nodes"))
    plan = near_pairs(spark.read.parquet(str(tmp_path / "nodes")), hot)._jdf.queryExecution().executedPlan().toString()
    own = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert own.index("SortMergeJoin") < (own.find("BroadcastHashJoin") if "BroadcastHashJoin" in own else len(own))


@pytest.mark.parametrize("cached", [100_000, 50])
def test_words_are_hashed_once_for_all_chunks(monkeypatch, cached):
    from lexhound.llm import simhash

    hashed = []
    monkeypatch.setattr(simhash, "CACHED_WORDS", cached)
    monkeypatch.setattr(simhash.xxhash, "xxh64_intdigest", lambda w, seed, own=xxhash.xxh64_intdigest: hashed.append(w) or own(w, seed))
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(60_000)) for _ in range(5)]  # more than a chunk
    raw = [t.encode() for t in texts]
    got = word_fingerprints_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert cached == 50 or len(hashed) == TABLES * 300
    monkeypatch.undo()
    assert got.tolist() == [brute_word_fingerprints(t) for t in texts]
