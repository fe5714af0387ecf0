import hashlib
import random
from collections import defaultdict

import pytest

from lexhound.llm.mixing import mix, mixed


def brute(rows, weights=(5, 2, 1), epochs=3):
    """taken by position, by filling up targets step by step and sorting all copies."""
    sizes = [len((t or "").split()) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = defaultdict(int)
    for (*_, s), n in zip(rows, sizes, strict=True):
        total[s] += n
    target, free, left = {}, set(names), sum(sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > epochs * total[s]}
        for s in over or free:
            target[s] = epochs * total[s] if over else level * w[s]
        left -= sum(target[s] for s in over)
        free -= over or free
    copies, cum = [], defaultdict(int)
    order = sorted(range(len(rows)), key=lambda k: (hashlib.md5(str("" if rows[k][0] is None else rows[k][0]).encode()).hexdigest(), rows[k][0] or 0, sizes[k]))
    for k in order:
        s = rows[k][2]
        cum[s] += sizes[k]
        h = hashlib.md5(str("" if rows[k][0] is None else rows[k][0]).encode()).hexdigest()
        if sizes[k] and target[s]:
            copies += [((e * total[s] + cum[s]) / target[s], names.index(s), h, sizes[k], k) for e in range(epochs)]
    taken, upto = [0] * len(rows), 0
    for *_, n, k in sorted(copies):
        upto += n
        if upto > sum(sizes):
            break
        taken[k] += n
    return sizes, total, target, taken


def corpus(seed):
    rng = random.Random(seed)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 3, 10, 200])), rng.choice(["a", "a", "a", "b", "c", "Z", None, "é"])) for k in range(300)]
    return [*rows, (900, None, "a"), (901, "", "nothing"), (902, "x" * 100_000, "tiny")]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rows = corpus(seed)
    sizes, total, target, taken = brute(rows)
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, source string, h string, part int")
    got = {r["doc_id"]: r for r in mix(df).collect()}
    for k, (d, _, s) in enumerate(rows):
        assert (got[d]["size"], got[d]["source_size"], got[d]["taken"]) == (sizes[k], total[s], taken[k]), d
        assert got[d]["target"] == pytest.approx(target[s])
    assert sum(taken) > 0.9 * sum(sizes)
    copies = mixed(df)
    assert copies.columns == df.columns
    times = defaultdict(int)
    for r in copies.collect():
        times[r["doc_id"]] += 1
    assert {d: times[d] * n for (d, *_), n in zip(rows, sizes, strict=True)} == {d: n for (d, *_), n in zip(rows, taken, strict=True)}


def test_edges(spark):
    schema = "doc_id long, text string, source string"
    assert mix(spark.createDataFrame([], schema)).count() == 0 and mixed(spark.createDataFrame([], schema)).count() == 0
    empty = spark.createDataFrame([(1, None, None), (2, "", "a")], schema)
    assert [r["taken"] for r in mix(empty).collect()] == [0, 0] and mixed(empty).count() == 0
    same = spark.createDataFrame([(1, "a b", "s")] * 4 + [(None, "c", "s")], schema)
    assert sorted(r["taken"] for r in mix(same).collect()) == [1, 2, 2, 2, 2]
    assert mixed(same).count() == 5


def test_rows_alike_but_for_the_source_or_another_column(spark):
    rows = [(k, "w " * 5, s, x) for k in range(12) for s, x in (("x", "a"), ("y", "b"))]
    rows += [(100, "w " * 5, "x", "c"), (100, "w " * 5, "x", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    want, got = defaultdict(int), defaultdict(int)
    for r in mix(df).collect():
        want[r["doc_id"], r["source"]] += r["taken"] // r["size"]
    for r in mixed(df).collect():
        got[r["doc_id"], r["source"]] += 1
        assert (r["doc_id"], r["text"], r["source"], r["lang"]) in rows
    assert {k: n for k, n in want.items() if n} == dict(got)
