import random
from collections import defaultdict
from functools import reduce

import pytest
from pyspark.sql import functions as F

from lexhound.functions.similarity import Algorithm
from lexhound.operators import sets
from lexhound.operators.hits import HITS, and_hits, and_not_hits, leaf_hits, or_hits, rate, top_hits
from lexhound.operators.index import Index, IndexConfig, LosslessIndex, SimpleIndex
from lexhound.plans.search import Query, StrayNotError, TooManyParts

EXACT = IndexConfig(1.0, Algorithm.EXACT, 100)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def rows(df):
    return sorted((r["doc_id"], r["start"], r["word_id"], round(r["rating"], 4), tuple(map(tuple, r["occurrences"])), tuple(r["closest_not"] or ())) for r in df.collect())


def test_and_not_lowers_ratings_but_keeps_documents(spark):
    index = LosslessIndex.build(docs(spark, "company stop", "company hello"), EXACT)
    q = Query.parse("company -stop")
    assert ids(q.documents(index).table()) == [0, 1] and ids(q.documents(index).table(strict_not=True)) == [1]
    got = {r["doc_id"]: r for r in q.hits(index, 1000).collect()}
    assert len(got) == 2 and got[1]["rating"] == 2.5 and got[0]["rating"] < -30
    assert got[0]["closest_not"]["start"] == 8 and got[1]["closest_not"] is None
    assert rows(Query.parse("-stop company").hits(index, 1000)) == rows(q.hits(index, 1000))
    assert [r["doc_id"] for r in q.search(index, 5).collect()] == [1, 0]


def test_stray_not(spark):
    index = LosslessIndex.build(docs(spark, "a b"), EXACT)
    for text in ("not a", "a or not b", "(not a) and (not b)", "a and not (b or not a)"):
        with pytest.raises(StrayNotError):
            Query.parse(text).documents(index).table()
        with pytest.raises(StrayNotError):
            Query.parse(text).hits(index)


def test_near_places_of_a_word_merge(spark):
    index = LosslessIndex.build(docs(spark, "we go we go we " + "x " * 100 + "we."), EXACT)
    got = rows(Query.parse("we").hits(index, 10))
    assert got == [(0, 0, 1, 2.0, ((0, 1), (6, 1)), ()), (0, 215, 1, 0.0, ((215, 1),), ())]
    assert len(rows(Query.parse("we").hits(index, None))) == 4


def test_fuzzy_and_prefix(spark):
    index = LosslessIndex.build(docs(spark, "lectus semper", "luctus sem", "nothing here"), IndexConfig(0.85, Algorithm.HAMMING, 1000))
    got = {(r["query_word"], r["word"]): r["proximity"] for r in index.proximates(["luctus", "sem", "no", "Sem"]).collect()}
    assert set(got) == {("luctus", "luctus"), ("luctus", "lectus"), ("sem", "sem"), ("sem", "semper")}
    assert got["luctus", "lectus"] == pytest.approx(6 / 7) and got["sem", "semper"] == pytest.approx(1 / 0.65 - 1.2)
    assert ids(Query.parse("luctus sem").documents(index).table()) == [0, 1]
    assert ids(Query.parse("luctus test -sem").documents(index).table()) == []
    rated = {r["doc_id"]: r["rating"] for r in Query.parse("luctus").hits(index).collect()}
    assert rated == {0: pytest.approx(-4 / 7, abs=1e-6), 1: 0.0}
    found = Query.parse("luctus").documents(index)
    assert rows(Query.parse("luctus").hits(index, 100, found.proximates)) == rows(Query.parse("luctus").hits(index))


def test_first_character_rule_and_thresholds(spark):
    texts = docs(spark, "abcdefgh xbcdefgh ab abc é éa")
    near = {r["word"] for r in LosslessIndex.build(texts, IndexConfig(0.8, Algorithm.HAMMING, 3)).proximates(["abcdefgh"]).collect()}
    far = {r["word"] for r in LosslessIndex.build(texts, IndexConfig(0.8, Algorithm.HAMMING, 100)).proximates(["abcdefgh"]).collect()}
    assert near == {"abcdefgh"} and far == {"abcdefgh", "xbcdefgh"}
    # short words must exceed the threshold; what begins with a word is accepted whatever its similarity
    strict = LosslessIndex.build(texts, IndexConfig(1.0, Algorithm.HAMMING, 100))
    assert [r["word"] for r in strict.proximates(["ab", "é"]).collect()] == []
    assert {r["word"] for r in strict.proximates(["abc"]).collect()} == {"abc", "abcdefgh"}
    assert LosslessIndex.build(texts, IndexConfig(0.8, Algorithm.JARO, 100)).proximates(["", "!"]).count() == 0


def test_index_operations(spark):
    a = LosslessIndex.build(docs(spark, "one two two", "two three"), EXACT)
    assert {(r["word"], r["doc_id"]): r["positions"] for r in a.compact().collect()} == {("one", 0): [0], ("two", 0): [4, 8], ("two", 1): [0], ("three", 1): [4]}
    assert a.contains_word("TWO!", 0) and not a.contains_word("one", 1) and ids(a.documents_with_word("two")) == [0, 1] and a.documents_with_word("zero").count() == 0
    assert a.word_count() == 3 and sorted(r[0] for r in a.words_starting_with("T").collect()) == ["three", "two"]
    words = {"one": [1], "two": [2, 1], "three": [1]}
    assert a.size().first()[0] == sum(len(w) + 16 + sum(8 + 8 * n + 16 for n in ns) for w, ns in words.items())
    assert a.to_simple().size().first()[0] == sum(len(w) + 16 + 8 * len(ns) + 16 for w, ns in words.items())
    again = a.merge(a)
    assert sorted(map(tuple, again.postings().collect())) == sorted(map(tuple, a.postings().collect()))
    assert ids(a.remove(1).document_postings().select("doc_id").distinct()) == [0]
    changed = spark.createDataFrame([(1, "four")], "doc_id long, text string")
    assert sorted(r["word"] for r in a.insert(changed).postings().where("doc_id = 1").collect()) == ["four", "three", "two"]
    assert [r["word"] for r in a.upsert(changed).postings().where("doc_id = 1").collect()] == ["four"]
    assert a.insert_word("Fi-ve", 7, 3).contains_word("five", 7)


def test_simple_index_reads_texts_again(spark):
    texts = docs(spark, "one two two", "two three")
    simple, full = SimpleIndex.build(texts), LosslessIndex.build(texts, IndexConfig.simple_default())
    for text in ("two", "two three", "one or three -two"):
        assert rows(Query.parse(text).hits(simple)) == rows(Query.parse(text).hits(full))
    changed = simple.with_documents(docs(spark, "one two", "three"))
    assert [tuple(r) for r in changed.missing().collect()] == [("two", 1)]
    fixed = changed.apply_missing()
    assert fixed.missing().count() == 0 and ids(fixed.documents_with_word("two")) == [0]
    with pytest.raises(ValueError, match="with_documents"):
        SimpleIndex(simple.document_postings()).occurrences(None, "two")
    assert ids(simple.insert(spark.createDataFrame([(5, "two")], "doc_id long, text string")).documents_with_word("two")) == [0, 1, 5]
    assert simple.insert_word("new", 9).contains_word("new", 9) and simple.remove(0).document_postings().where("doc_id = 0").isEmpty()


def test_sets(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "x string") for xs in (["hi", "and", "bye"], ["Hello", "there!", "See you!", "bye"]))
    show = lambda df: sorted(r["x"] for r in df.collect())
    assert show(sets.intersect(a, b)) == ["bye"] and show(sets.union(a, b)) == ["Hello", "See you!", "and", "bye", "hi", "there!"] and show(sets.difference(a, b)) == ["and", "hi"]
    many = spark.createDataFrame([("x", 1), ("x", 3), ("y", 2)], "k string, v int")
    assert sorted(map(tuple, sets.deduplicate_keeping(many, ["k"], F.col("v")).collect())) == [("x", 3), ("y", 2)]
    assert sets.deduplicate(many, ["k"]).count() == 2 and sets.deduplicate(many.union(many)).count() == 3


def random_hits(rng, word_id, n):
    got = []
    for _ in range(n):
        start = rng.randrange(40)
        occ = sorted({(start, word_id)} | {(rng.randrange(40), word_id + 10) for _ in range(rng.randint(0, 2))})
        got.append((rng.randrange(6), start, word_id, float(rng.randint(-3, 3)), occ, None))
    return sorted(set((d, s, w, r, tuple(o), c) for d, s, w, r, o, c in got))


def key(h):
    return h[1], h[2], h[3], h[4]


def merged(a, b):
    return (*a[:4], tuple(sorted(set(a[4]) | set(b[4]))), ())


def naive(left, right, kind):
    out, by = [], defaultdict(lambda: ([], []))
    for side, hits in enumerate((left, right)):
        for h in hits:
            by[h[0]][side].append(h)
    for ls, rs in by.values():
        ls, rs = sorted(ls, key=key), sorted(rs, key=key)
        if kind == "not":
            for a in ls:
                near = None
                for b in rs:
                    if near is None or abs(b[1] - a[1]) <= abs(near[1] - a[1]):
                        near = b
                if near is None:
                    out.append((*a[:3], a[3] + 2.5, a[4], ()))
                else:
                    d = min(abs(o[0] - near[1]) for o in a[4])
                    out.append((*a[:3], a[3] - 1 / (0.0001 * d + 0.025) - near[3], a[4], (near[1], 0)))
            continue
        for a in ls:
            ahead = [b for b in rs if b[1] >= a[1]]
            out += [merged(a, ahead[0])] if ahead else [(*a[:5], ())] if kind == "or" else []
        for b in rs:
            ahead = [a for a in ls if a[1] > b[1]]
            out += [merged(ahead[0], b)] if ahead else [(*b[:5], ())] if kind == "or" else []
    return sorted((d, s, w, round(r, 4), o, c) for d, s, w, r, o, c in out)


@pytest.mark.parametrize("seed", range(4))
def test_pairing_is_that_of_a_naive_merge(spark, seed):
    rng = random.Random(seed)
    left, right = random_hits(rng, 1, 60), random_hits(rng, 2, 50)
    a, b = (spark.createDataFrame(x, HITS) for x in (left, right))
    for kind, op in (("and", and_hits), ("or", or_hits), ("not", and_not_hits)):
        assert rows(op(a, b)) == naive(left, right, kind), kind
    if seed == 0:
        assert len(rows(or_hits(a, b))) == len(left) + len(right)


def test_final_rating_and_start(spark):
    hits = [(1, 0, 1, 1.0, [(0, 1), (50, 1), (60, 2)], None), (2, 7, 3, 0.0, [(7, 3)], None), (3, 5, 1, 0.0, [(5, 1), (5, 2), (105, 1)], None)]
    got = {r[0]: r for r in rows(rate(spark.createDataFrame(hits, HITS)))}
    assert got[1] == (1, 50, 1, round(1 + 0.5 / 0.11, 4), ((0, 1), (60, 2)), ())
    assert got[2] == (2, 7, 3, 0.0, ((7, 3),), ()) and got[3] == (3, 5, 1, 7.5, ((5, 1), (5, 2), (105, 1)), ())


def test_best_hits_by_ratings_that_agree_but_for_their_last_bits(spark):
    sums = [reduce(lambda acc, d: acc + 0.5 / (0.001 * d + 0.1), ds, 0.0) for ds in ((2, 2, 3), (3, 2, 2))]  # sum() would round only once
    assert sums[0] < sums[1]
    hits = [(doc, 0, 1, rating, [(0, 1), (place, 2)], None) for doc, rating, place in ((1, sums[0], 9), (1, sums[1], 8), (2, sums[1], 8), (0, 1.0, 8))]
    got = top_hits(spark.createDataFrame(hits, HITS), 3).collect()
    assert [(r["doc_id"], r["occurrences"][1]["start"]) for r in got] == [(1, 8), (1, 9), (2, 8)]


def test_a_source_of_ones_own(spark):
    class Doubled(Index):
        config = EXACT

        def document_postings(self):
            return spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "word string, doc_id long")

        def occurrences(self, proximates, word):
            return self.document_postings().where(F.col("word") == word).select("doc_id", "word", (F.col("doc_id") * 10).cast("int").alias("start"), F.lit(1.0).alias("rating"))

    own = Doubled()
    assert own.word_count() == 2 and own.contains_word("b", 1) and sorted(r[0] for r in own.words_starting_with("a").collect()) == ["a"]
    assert ids(Query.parse("a b").documents(own).table()) == [1]
    other = lambda proximates, word: own.occurrences(proximates, word).where("doc_id = 2")
    assert [r[0] for r in rows(Query.parse("a").hits(own, occurrences=other))] == [2]
    assert rows(Query.parse("a").hits(own)) == [(1, 10, 1, 1.0, ((10, 1),), ()), (2, 20, 1, 1.0, ((20, 1),), ())]


def test_many_leaves_and_none(spark):
    index = LosslessIndex.build(docs(spark, " ".join(f"w{k}" for k in range(140)), "w1 w2"), EXACT)
    assert ids(Query.parse(" ".join(f"w{k}" for k in range(140))).documents(index).table()) == [0]
    assert ids(Query.parse(" or ".join(f"w{k}" for k in range(139))).documents(index).table()) == [0, 1]
    empty = LosslessIndex.build(docs(spark).limit(0) if False else spark.createDataFrame([], "doc_id long, text string"), EXACT)
    assert Query.parse("a or b").hits(empty).count() == 0 and Query.parse("a").documents(empty).table().count() == 0
    assert leaf_hits(empty.occurrences(None, "a"), 1, 5).count() == 0


def test_queries_of_very_many_words(spark):
    index = LosslessIndex.build(spark.createDataFrame([(k, f"w{k} w{k + 1} all") for k in range(5)], "doc_id long, text string"), IndexConfig(1.0, Algorithm.EXACT, 100))
    found = lambda text, **how: sorted(r[0] for r in Query.parse(text).documents(index).table(**how).collect())
    many = [f"x{k}" for k in range(300)]
    assert found(" or ".join([*many, "w3"])) == [2, 3] and found(" ".join([*many, "w3"])) == []
    assert found("all " + " ".join(f"-{w}" for w in [*many, "w3"]), strict_not=True) == [0, 1, 4]
    with pytest.raises(TooManyParts):
        Query.parse(" ".join(many)).hits(index)
    with pytest.raises(StrayNotError):
        Query.parse("-a -b").documents(index).table()
