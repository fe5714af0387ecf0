"""How much of an index its maintenance moves: plans, with the results beside them."""

import pytest
from pyspark.sql import functions as F

from lexhound.functions.similarity import Algorithm
from lexhound.operators import index as module
from lexhound.operators.index import IndexConfig, LosslessIndex, SimpleIndex
from lexhound.operators.tokenize import document_words
from lexhound.plans.search import Query

SCHEMA = "doc_id long, text string"


@pytest.fixture
def stored(spark, tmp_path):
    """An index over files, and its texts; nothing is broadcast by Spark itself."""
    docs = spark.createDataFrame([(k, f"all w{k} w{k % 3} all") for k in range(30)], SCHEMA)
    document_words(docs).select("word", "doc_id", "positions").write.parquet(str(tmp_path / "rows"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield LosslessIndex.of_compact(spark.read.parquet(str(tmp_path / "rows")), ids=docs.select("doc_id")), docs
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def table(df):
    return sorted(map(tuple, df.collect()))


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_remove_moves_no_places(spark, stored):
    index, _ = stored
    gone = spark.range(0, 30, 2).select(F.col("id").alias("doc_id"))
    got = index.remove(gone)
    assert "SortMergeJoin" not in plan(got.postings())
    assert table(got.postings()) == table(index.postings().where("doc_id % 2 = 1"))
def test_upsert_moves_no_places_of_other_documents(spark, stored):
    index, _ = stored
    got = index.upsert(texts(spark, (3, "new"), (99, "other new")))
    assert "SortMergeJoin" not in plan(got.postings()) and "HashAggregate(keys=[word" not in plan(got.postings())
    assert table(got.postings()) == sorted([*table(index.postings().where("doc_id <> 3")), ("new", 3, 0), ("new", 99, 6), ("other", 99, 0)])
def test_insert_of_other_documents_groups_nothing(spark, stored):
    index, _ = stored
    got = index.insert(texts(spark, (98, "new all"), (99, "new")))
    assert "Aggregate" not in plan(got.postings())
    assert table(got.postings()) == sorted([*table(index.postings()), ("new", 98, 0), ("all", 98, 4), ("new", 99, 0)])
def test_apply_missing_joins_words_of_known_texts_alone(spark, stored):
    index, _ = stored
    got = index.to_simple().with_documents(texts(spark, (3, "all new"), (77, "x"))).apply_missing().document_postings()
    # the words of known documents are joined by a shuffle of theirs: the scan beside it goes on without an exchange
    assert plan(got).index("Union") < plan(got).index("SortMergeJoin") and plan(got).count("BroadcastHashJoin [doc_id") >= 2
    assert table(got) == sorted([*table(index.document_postings().where("doc_id <> 3")), ("all", 3)])
def test_size_groups_nothing(spark, stored):
    index, _ = stored
    index = LosslessIndex.of_compact(index.compact(), index.config, index.words())
    want = {w: [len(r["positions"]) for r in rows] for w, rows in _by_word(index).items()}
    assert "hashpartitioning(word#" not in plan(LosslessIndex.of_compact(index.compact(), index.config, spark.range(1).select(F.lit("a").alias("word"))).size())
    assert index.size().first()[0] == sum(len(w) + 16 + sum(8 + 8 * n + 16 for n in ns) for w, ns in want.items())
    assert index.to_simple().size().first()[0] == sum(len(w) + 16 + 8 * len(ns) + 16 for w, ns in want.items())


def _by_word(index):
    found = {}
    for r in index.compact().collect():
        found.setdefault(r["word"], []).append(r)
    return found
def test_simple_merge_groups_shared_documents_alone(spark, stored):
    index, docs = stored
    other = SimpleIndex.build(texts(spark, (3, "all new"), (3, "again all"), (99, "all")))
    want = sorted({*table(index.document_postings()), ("new", 3), ("again", 3), ("all", 99)})
    got = index.to_simple().merge(other)
    assert table(got.document_postings()) == want
    assert plan(got.document_postings()).count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in plan(got.document_postings())
    for _ in range(module.MOST_SPLITS + 1):  # merges one upon the other don't double what is read for ever
        got = got.merge(other)
    assert got._splits == module.MOST_SPLITS and table(got.document_postings()) == want
def test_merge_groups_shared_documents_alone(spark, stored):
    index, docs = stored
    other = LosslessIndex.build(texts(spark, (3, "all new all"), (None, "none"), (99, "all")))
    got = index.merge(other).merge(other)
    want = sorted({*table(index.postings()), *table(other.postings())}, key=str)
    assert sorted(map(tuple, got.postings().collect()), key=str) == want
    assert "BroadcastHashJoin" in plan(got.postings()) and "SortMergeJoin" not in plan(got.postings())
def test_changed_texts_are_told_before_words_are_joined(spark, stored, monkeypatch):
    index, docs = stored
    now = docs.where("doc_id > 4").unionByName(texts(spark, (0, "all w0 all w0"), (1, "all w1 gone w1 w1 new"), (2, ""), (3, "w3 all"), (4, "xall w4 w1")))
    own = index.to_simple().with_documents(now)
    want = table(own.missing())
    assert want == [("all", 2), ("all", 4), ("w0", 3), ("w2", 2)]
    monkeypatch.setattr(module, "FEW_TEXTS", 3)
    changed = module._changed(own._rows, now)
    assert table(changed) == [(1,), (2,), (3,), (4,)] and table(own.missing()) == want
    for most in (2, 10):  # changed documents joined by a shuffle, and broadcast
        monkeypatch.setattr(module, "MOST_IDS", most)
        assert table(own.missing()) == want and table(own.apply_missing().missing()) == []


def test_places_stay_in_as_many_parts_as_are_set(spark, stored):
    index, _ = stored
    index = LosslessIndex.of_compact(index.compact(), IndexConfig(1.0, Algorithm.EXACT, 100))
    assert "REPARTITION_BY_NUM" in plan(Query.parse("all").hits(index, 100))
