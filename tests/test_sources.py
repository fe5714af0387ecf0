import pytest

from lexhound.functions.similarity import Algorithm
from lexhound.operators.index import IndexConfig, LosslessIndex, SimpleIndex
from lexhound.plans.search import Query
from lexhound.sources.documents import DocumentMap, read_index, with_doc_id, write_index
from lexhound.streaming.incremental import StreamingIndex


def names(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "name string")


def ids(m):
    return {r["name"]: r["doc_id"] for r in m.table.collect()}


def test_document_map(spark):
    m = DocumentMap.empty(spark)
    assert m.first_free() == 0
    m = m.reserve(names(spark, "b", "a", "a"))
    assert ids(m) == {"a": 0, "b": 1} and m.reserve(names(spark, "a")) is m
    assert m.get_id("b") == 1 and m.get_name(0) == "a" and m.get_id("x") is None and m.get_name(9) is None and m.contains(1)
    table = spark.createDataFrame([("p", 1), ("q", 2), ("r", 5), ("s", 9)], "name string, doc_id long")
    m = DocumentMap(table)
    assert m.first_free() == 3
    assert ids(m.reserve(names(spark, "a", "b", "c", "d", "e", "f", "p"))) == {"p": 1, "q": 2, "r": 5, "s": 9, "a": 3, "b": 4, "c": 6, "d": 7, "e": 8, "f": 10}
    # id 0 isn't given again while there are others
    assert DocumentMap(table.where("doc_id < 3")).first_free() == 3 and DocumentMap(table.where("doc_id = 5")).first_free() == 1
    assert DocumentMap(spark.createDataFrame([("z", 0)], "name string, doc_id long")).first_free() == 1


def test_insert_and_remove(spark):
    m, index = DocumentMap.empty(spark).insert(spark.createDataFrame([("x", "one two"), ("y", "two")], "name string, text string"), LosslessIndex.build(spark.createDataFrame([], "doc_id long, text string")))
    assert sorted(r["doc_id"] for r in index.documents_with_word("two").collect()) == [0, 1]
    same, kept = m.force_remove(7, index)
    assert same is m and kept is index
    m, index = m.force_remove(0, index)
    assert ids(m) == {"y": 1} and index.documents_with_word("one").count() == 0
    keyed = with_doc_id(spark.createDataFrame([(1, 2), (1, 3)], "a int, b int"), "a", "b")
    assert keyed.select("doc_id").distinct().count() == 2


@pytest.mark.parametrize("kind", [LosslessIndex, SimpleIndex])
def test_index_on_disk(spark, tmp_path, kind):
    index = kind.build(spark.createDataFrame([(1, "alpha beta"), (2, "beta-gamma ray")], "doc_id long, text string"), IndexConfig(0.9, Algorithm.JARO, 7))
    write_index(index, str(tmp_path / "i"))
    got = read_index(spark, str(tmp_path / "i"))
    assert type(got) is kind and got.config == index.config
    assert sorted(map(tuple, got.document_postings().collect())) == sorted(map(tuple, index.document_postings().collect()))
    assert sorted(r[0] for r in got.words().collect()) == ["alpha", "beta", "betagamma", "gamma", "ray"]


def test_streaming(spark, tmp_path):
    source, schema = tmp_path / "in", "doc_id long, text string"
    stream = StreamingIndex(spark, str(tmp_path / "index"))

    def feed(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(source))
        stream.start(spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "checkpoint")).awaitTermination()

    feed((1, "old words"), (2, "other words"), (3, "gone words"))
    feed((1, "new words"), (3, None), (4, "late"))
    got = stream.index()
    assert sorted((r["doc_id"], r["word"]) for r in got.postings().collect()) == [(1, "new"), (1, "words"), (2, "other"), (2, "words"), (4, "late")]
    stream.apply(spark.createDataFrame([(4, "later")], schema), 7)
    stream.apply(spark.createDataFrame([(4, "later")], schema), 7)  # a batch that is run again
    assert [r["word"] for r in stream.index().postings().where("doc_id = 4").collect()] == ["later"]
    other = stream.compact(str(tmp_path / "compacted"))
    assert sorted(map(tuple, other.index().postings().collect())) == sorted(map(tuple, stream.index().postings().collect()))
    other.apply(spark.createDataFrame([(2, None)], schema), 0)
    assert other.index().postings().where("doc_id = 2").isEmpty()
    assert [r["doc_id"] for r in Query.parse("words -other").documents(stream.index()).table(strict_not=True).collect()] == [1]


def test_streaming_order(spark, tmp_path):
    schema = "doc_id long, text string, at int"
    stream = StreamingIndex(spark, str(tmp_path / "index"), order="at")
    stream.apply(spark.createDataFrame([(1, "zebra first", 1), (1, "apple later", 2), (2, "kept", 3), (2, None, 2), (3, "text", 1), (3, None, 2), (4, "same b", 1), (4, "same a", 1)], schema), 0)
    assert sorted((r["doc_id"], r["word"]) for r in stream.index().postings().collect()) == [(1, "apple"), (1, "later"), (2, "kept"), (4, "b"), (4, "same")]
    # without an order a removal counts before any text
    plain = StreamingIndex(spark, str(tmp_path / "plain"))
    plain.apply(spark.createDataFrame([(1, "text"), (1, None), (2, "a"), (2, "b")], "doc_id long, text string"), 0)
    assert [(r["doc_id"], r["word"]) for r in plain.index().postings().collect()] == [(2, "b")]


def test_texts_of_the_index_without_places_are_replaced(spark):
    docs = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    config = IndexConfig(1.0, Algorithm.EXACT, 100)
    old = SimpleIndex.build(docs((0, "old words"), (1, "other words")), config)
    found = lambda index, word: sorted(r["doc_id"] for r in index.occurrences(None, word).collect())
    for new in (old.insert(docs((0, "new words"))), old.merge(SimpleIndex.build(docs((0, "new words")), config)), old.with_documents(docs((0, "new words")))):
        assert found(new, "old") == [] and found(new, "words") == [0, 1]
        assert [tuple(r) for r in new.missing().select("word", "doc_id").collect()] == [("old", 0)]
        assert sorted(r["word"] for r in new.apply_missing().document_postings().where("doc_id = 0").collect()) in (["new", "words"], ["words"])
    new = old.upsert(docs((0, "new words")))
    assert found(new, "new") == [0] and found(new, "old") == [] and new.missing().isEmpty()
    assert old.documents_with_word("old").count() == 1


def test_an_index_is_written_with_one_pass_over_texts(spark, tmp_path):
    counted = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            counted.add(b.num_rows)
            yield b

    docs = spark.createDataFrame([(k, f"word{k} and more") for k in range(500)], "doc_id long, text string").mapInArrow(count, "doc_id long, text string").repartition(3)
    from lexhound.operators.tokenize import document_words

    index = LosslessIndex.of_compact(document_words(docs).select("word", "doc_id", "positions"))
    write_index(index, str(tmp_path / "i"))
    assert counted.value == 500
    got = read_index(spark, str(tmp_path / "i"))
    assert got.postings().count() == 1500 and got.documents_with_word("and").count() == 500
    assert sorted(p.name for p in (tmp_path / "i").iterdir()) == ["config", "postings", "vocabulary"]
