"""Inverted indices as relations: with positions (Lossless) or of documents alone (Simple)."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import Algorithm
from ..functions.text import normalize_word
from . import expand as _expand
from .hits import word_rating
from .tokenize import document_words, tokenize

#: So many ids are broadcast at most (64 MB as Spark's table of longs); more of them are joined by a shuffle.
MOST_IDS = 1_000_000
#: Documents whose words are joined with those of their texts without a look at which have changed.
FEW_TEXTS = 10_000
#: Merges of indices that hold the same documents, one upon the other, that read these apart from the rest.
MOST_SPLITS = 3

#: Takes some rows of a table with a doc_id.
Keep = Callable[[DataFrame], DataFrame]
#: An index's rows of the documents that a Keep leaves; it is applied to the texts where the rows come from these.
Rows = Callable[[Keep], DataFrame]


@dataclass(frozen=True)
class IndexConfig:
    """How query words are matched: similarity threshold, algorithm, and the vocabulary size above which only words of the same first character are."""

    threshold: float = 0.85
    algorithm: Algorithm = Algorithm.HAMMING
    word_count_limit: int = 1000

    @classmethod
    def simple_default(cls) -> IndexConfig:
        return cls(word_count_limit=2500)


class Index(ABC):
    """What queries need of an index. A source of one's own implements the abstract methods and may override the others."""

    config: IndexConfig

    @abstractmethod
    def document_postings(self) -> DataFrame:
        """(word, doc_id), distinct."""

    def document_rows(self) -> DataFrame:
        """(word, doc_id), where rows may be repeated; for what drops repetitions anyway."""
        return self.document_postings()

    @abstractmethod
    def occurrences(self, proximates: DataFrame | None, word: str) -> DataFrame:
        """(doc_id, word, start, rating) of a query word's occurrences; exact ones if proximates is None."""

    def words(self) -> DataFrame:
        """The vocabulary (word), distinct."""
        return self.document_postings().select("word").distinct()

    def words_starting_with(self, char: str) -> DataFrame:
        c = normalize_word(char)[:1]
        return self.words().where(F.col("word").startswith(c) if c else F.lit(False))

    def word_count(self) -> int:
        return self.words().count()

    def contains_word(self, word: str, doc_id: int) -> bool:
        return not self.documents_with_word(word).where(F.col("doc_id") == doc_id).isEmpty()

    def documents_with_word(self, word: str) -> DataFrame:
        """(doc_id), distinct."""
        return self.document_postings().where(F.col("word") == normalize_word(word)).select("doc_id").distinct()

    def is_large(self) -> bool:
        """Whether the vocabulary exceeds the limit; counts no further than that."""
        limit = self.config.word_count_limit
        return self.words().limit(limit + 1).count() > limit

    def proximates(self, words: Sequence[str]) -> DataFrame:
        """(query_word, word, proximity) of each query word's expansion."""
        c = self.config
        if c.algorithm is Algorithm.EXACT:
            wanted = list(dict.fromkeys(w for w in map(normalize_word, words) if w))
            return self.words().where(F.col("word").isin(wanted)).select(F.col("word").alias("query_word"), "word", F.lit(1.0).cast("float").alias("proximity"))
        return _expand.expand(self.words(), words, c.algorithm, c.threshold, self.is_large())


def _rated(postings: DataFrame, proximates: DataFrame | None, word: str) -> DataFrame:
    w = normalize_word(word)
    if proximates is None:
        return postings.where(F.col("word") == w).select("doc_id", "word", "start", F.lit(0.0).alias("rating"))
    mine = proximates.where(F.col("query_word") == w).select("word", "proximity")
    return postings.join(mine, "word").select("doc_id", "word", "start", word_rating(F.col("proximity")).alias("rating"))


class LosslessIndex(Index):
    """Every place of every word: postings(word, doc_id, start), distinct."""

    def __init__(self, postings: DataFrame, config: IndexConfig = IndexConfig(), vocabulary: DataFrame | None = None):  # noqa: B008
        self.config, self._postings, self._vocabulary = config, postings.select("word", "doc_id", "start"), vocabulary
        self._compact: DataFrame | None = None
        self._rows: Rows = lambda keep: keep(self.compact())
        self._ids: DataFrame | None = None
        self._splits = 0

    @classmethod
    def build(cls, docs: DataFrame, config: IndexConfig = IndexConfig(), text_col: str = "text", id_col: str = "doc_id", strict_offsets: bool = True) -> LosslessIndex:  # noqa: B008
        """Of docs; a document that is given twice counts once.

        Ids alone are read first: only documents whose id is given twice are grouped.
        """
        named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        rows = _built(named, lambda texts: document_words(texts, strict_offsets=strict_offsets).select("word", "doc_id", "positions"), _one_of_each_place)
        return cls._of_rows(rows, config, ids=named.select("doc_id"))

    @classmethod
    def of_compact(cls, compact: DataFrame, config: IndexConfig = IndexConfig(), vocabulary: DataFrame | None = None, ids: DataFrame | None = None) -> LosslessIndex:  # noqa: B008
        """Of (word, doc_id, positions), one row for each word of a document, which what needs no places reads as they are.

        ids: (doc_id) of its documents where they are known, repeated or not; else they are read from the rows.
        """
        return cls._of_rows(lambda keep: keep(compact).select("word", "doc_id", "positions"), config, vocabulary, ids)

    @classmethod
    def _of_rows(cls, rows: Rows, config: IndexConfig, vocabulary: DataFrame | None = None, ids: DataFrame | None = None, splits: int = 0) -> LosslessIndex:
        compact = rows(_all)
        got = cls(compact.select("word", "doc_id", F.explode("positions").alias("start")), config, vocabulary)
        got._compact, got._rows, got._ids, got._splits = compact, rows, ids, splits
        return got

    def postings(self) -> DataFrame:
        return self._postings

    def compact(self) -> DataFrame:
        """(word, doc_id, positions array<int>), the places in order; of documents just read, grouped as they are read."""
        if self._compact is not None:
            return self._compact
        return self._postings.groupBy("word", "doc_id").agg(F.array_sort(F.collect_set("start")).alias("positions"))

    def ids(self) -> DataFrame:
        """(doc_id) of the documents, maybe repeated, and of some that hold no word."""
        return self._ids if self._ids is not None else self.document_rows().select("doc_id").distinct()

    def document_postings(self) -> DataFrame:
        if self._compact is not None:
            return self._compact.select("word", "doc_id")
        return self._postings.select("word", "doc_id").distinct()

    def document_rows(self) -> DataFrame:
        return (self._compact if self._compact is not None else self._postings).select("word", "doc_id")

    def words(self) -> DataFrame:
        return self._vocabulary.select("word") if self._vocabulary is not None else self.document_rows().select("word").distinct()

    def documents_with_word(self, word: str) -> DataFrame:
        found = self.document_rows().where(F.col("word") == normalize_word(word)).select("doc_id")
        return found if self._compact is not None else found.distinct()

    def occurrences(self, proximates: DataFrame | None, word: str) -> DataFrame:
        return _rated(self._postings, proximates, word)

    def places_of_documents(self) -> DataFrame:
        """(doc_id, places): how many places the words of each document have, by the rows of its words."""
        return self.compact().groupBy("doc_id").agg(F.sum(F.size("positions")).alias("places"))

    def merge(self, other: LosslessIndex) -> LosslessIndex:
        """Both indices' places. Only documents that both hold are grouped; rows of the others stay as they are."""
        rows, splits = _united(self, other, _one_of_each_place)
        return LosslessIndex._of_rows(rows, self.config, ids=self.ids().unionByName(other.ids()), splits=splits)

    def insert_word(self, word: str, doc_id: int, start: int) -> LosslessIndex:
        row = self._postings.sparkSession.createDataFrame([(normalize_word(word), doc_id, start)], "word string, doc_id long, start int")
        return self.merge(LosslessIndex(row, self.config))

    def insert(self, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> LosslessIndex:
        """Adds documents' words; those of an earlier version of a document stay."""
        return self.merge(LosslessIndex.build(docs, self.config, text_col, id_col))

    def upsert(self, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> LosslessIndex:
        """Puts documents' words in place of those of earlier versions."""
        return self.remove(docs.select(F.col(id_col).alias("doc_id"))).insert(docs, text_col, id_col)

    def remove(self, ids: DataFrame | int) -> LosslessIndex:
        without = _without(ids)
        if self._compact is None:
            return LosslessIndex(without(self._postings), self.config)
        return LosslessIndex._of_rows(lambda keep: self._rows(lambda df: keep(without(df))), self.config, ids=without(self.ids()), splits=self._splits)

    def size(self) -> DataFrame:
        """One row: bytes, an estimate of a tree of words, each with a tree of documents with a list of places."""
        return _bytes(self.compact().agg(F.sum(8 + 8 * F.size("positions") + 16).alias("docs")), self.words(), 16)

    def to_simple(self) -> SimpleIndex:
        config = replace(self.config, word_count_limit=2500)
        if self._compact is None:
            return SimpleIndex(self.document_postings(), config)
        return SimpleIndex._of_rows(lambda keep: self._rows(keep).select("word", "doc_id"), config, None, self._ids, self._splits, self._vocabulary)


class SimpleIndex(Index):
    """The documents of every word: postings(word, doc_id), distinct. Places come from reading the documents again.

    documents(doc_id, text): the text of each document as it is now, one for each id. What is added later replaces the text
    of the same id, while the postings of the earlier one stay until apply_missing() or upsert().
    """

    def __init__(self, postings: DataFrame, config: IndexConfig | None = None, documents: DataFrame | None = None):
        self.config, self._postings, self._documents = config or IndexConfig.simple_default(), postings.select("word", "doc_id"), documents
        self._rows: Rows = lambda keep: keep(self._postings)
        self._ids: DataFrame | None = None
        self._vocabulary: DataFrame | None = None
        self._splits = 0

    @classmethod
    def build(cls, docs: DataFrame, config: IndexConfig | None = None, text_col: str = "text", id_col: str = "doc_id") -> SimpleIndex:
        named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        rows = _built(named, lambda texts: document_words(texts).select("word", "doc_id"), DataFrame.distinct)
        return cls._of_rows(rows, config, named, named.select("doc_id"))

    @classmethod
    def _of_rows(cls, rows: Rows, config: IndexConfig | None, documents: DataFrame | None, ids: DataFrame | None, splits: int = 0, vocabulary: DataFrame | None = None) -> SimpleIndex:
        got = cls(rows(_all), config, documents)
        got._rows, got._ids, got._splits, got._vocabulary = rows, ids, splits, vocabulary
        return got

    def with_documents(self, docs: DataFrame) -> SimpleIndex:
        """With texts (doc_id, text) to read again, in place of earlier ones of their ids; documents without one have no occurrences."""
        return SimpleIndex._of_rows(self._rows, self.config, _replaced(self._documents, docs), self._ids, self._splits, self._vocabulary)

    def ids(self) -> DataFrame:
        """(doc_id) of the documents, maybe repeated, and of some that hold no word."""
        return self._ids if self._ids is not None else self._postings.select("doc_id").distinct()

    def words(self) -> DataFrame:
        return self._vocabulary.select("word") if self._vocabulary is not None else super().words()

    def document_postings(self) -> DataFrame:
        return self._postings

    def documents_with_word(self, word: str) -> DataFrame:
        return self._postings.where(F.col("word") == normalize_word(word)).select("doc_id")

    def occurrences(self, proximates: DataFrame | None, word: str) -> DataFrame:
        if self._documents is None:
            raise ValueError("give the documents' texts by with_documents() first")
        w = normalize_word(word)
        wanted = self._postings.where(F.col("word") == w) if proximates is None else self._postings.join(proximates.where(F.col("query_word") == w).select("word"), "word", "left_semi")
        docs = self._documents.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
        return _rated(tokenize(docs).select("word", "doc_id", "start").distinct(), proximates, word)

    def merge(self, other: SimpleIndex) -> SimpleIndex:
        """Both indices' postings; of a document whose text both know, that of other counts. Rows of documents that only one of them holds stay as they are."""
        rows, splits = _united(self, other, DataFrame.distinct)
        return SimpleIndex._of_rows(rows, self.config, _replaced(self._documents, other._documents), self.ids().unionByName(other.ids()), splits)

    def insert_word(self, word: str, doc_id: int) -> SimpleIndex:
        row = self._postings.sparkSession.createDataFrame([(normalize_word(word), doc_id)], "word string, doc_id long")
        return self.merge(SimpleIndex(row, self.config))

    def insert(self, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> SimpleIndex:
        return self.merge(SimpleIndex.build(docs, self.config, text_col, id_col))

    def upsert(self, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> SimpleIndex:
        """Puts documents' words in place of those of earlier versions."""
        return self.remove(docs.select(F.col(id_col).alias("doc_id"))).insert(docs, text_col, id_col)

    def remove(self, ids: DataFrame | int) -> SimpleIndex:
        without = _without(ids)
        return SimpleIndex._of_rows(lambda keep: self._rows(lambda df: keep(without(df))), self.config, self._documents, without(self.ids()), self._splits)

    def missing(self) -> DataFrame:
        """(word, doc_id) that the texts no longer hold, of all documents whose text is known.

        Of more than FEW_TEXTS documents, those that hold what they held are told first by the number of their words and
        128 bits of these words' hashes; only the others' words are joined.
        """
        if self._documents is None:
            raise ValueError("give the documents' texts by with_documents() first")
        known = self._documents.select("doc_id").distinct()
        known = bounded(known if known.count() <= FEW_TEXTS else _changed(self._rows, self._documents))
        held = self._rows(lambda df: df.join(known, "doc_id", "left_semi")).select("word", "doc_id")
        now = document_words(self._documents.join(known, "doc_id", "left_semi")).select("word", "doc_id")
        return held.join(now, ["word", "doc_id"], "left_anti")

    def apply_missing(self, missing: DataFrame | None = None) -> SimpleIndex:
        """The index without what missing() found. Rows of documents of which nothing is missing stay as they are."""
        gone = self.missing() if missing is None else missing
        # missing() finds documents with a known text alone; if these are few, it needn't be computed for their ids
        named = bounded((self._documents if missing is None and _are_few(self._documents) else gone).select("doc_id"))

        def rows(keep: Keep) -> DataFrame:
            rest = self._rows(lambda df: keep(df.join(named, "doc_id", "left_anti")))
            return rest.unionByName(self._rows(lambda df: keep(df.join(named, "doc_id", "left_semi"))).join(gone, ["word", "doc_id"], "left_anti").select("word", "doc_id"))

        return SimpleIndex._of_rows(rows, self.config, self._documents, self._ids, self._splits)

    def size(self) -> DataFrame:
        """One row: bytes, an estimate of a tree of words, each with a tree of documents."""
        return _bytes(self._postings.agg((8 * F.count("*")).alias("docs")), self.words(), 32)


def _all(df: DataFrame) -> DataFrame:
    return df


def _bytes(docs: DataFrame, words: DataFrame, each: int) -> DataFrame:
    """One row: bytes of documents, already summed up, and of words, with so many more for each. Two sums: nothing is grouped."""
    own = words.agg(F.sum(F.octet_length("word") + each).alias("words"))
    return docs.crossJoin(own).select(F.coalesce(F.col("docs") + F.col("words"), F.lit(0)).cast("long").alias("bytes"))


def _one_of_each_place(compact: DataFrame) -> DataFrame:
    """One row for each word of a document, with the places of all its rows."""
    places = F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions"))))
    return compact.groupBy("word", "doc_id").agg(places.alias("positions"))


def _are_few(ids: DataFrame) -> bool:
    return ids.count() <= MOST_IDS


def bounded(ids: DataFrame, distinct: bool = True) -> DataFrame:
    """The different ones of ids(doc_id), or a table with a row for each, to be broadcast if they are few."""
    ids = ids.select("doc_id").distinct() if distinct else ids
    return F.broadcast(ids) if _are_few(ids) else ids


def _without(ids: DataFrame | int) -> Keep:
    """Takes rows of other documents than one id, or than a table (doc_id)."""
    if isinstance(ids, int):
        return lambda df: df.where(F.col("doc_id") != ids)
    gone = bounded(ids)
    return lambda df: df.join(gone, "doc_id", "left_anti").select(*df.columns)


def _split(sides: Sequence[Rows], ids: DataFrame, group: Callable[[DataFrame], DataFrame]) -> Rows:
    """The rows of sides; those of documents of ids, and of ones without an id, are grouped, the rest stay as they are."""
    among = bounded(ids.select("doc_id").distinct().withColumn("_among", F.lit(True)), distinct=False)

    def marked(df: DataFrame) -> DataFrame:
        return df.join(among, "doc_id", "left")

    def rows(keep: Keep) -> DataFrame:
        alone = [side(lambda df: keep(marked(df).where("_among IS NULL AND doc_id IS NOT NULL").select(*df.columns))) for side in sides]
        both = [side(lambda df: keep(marked(df).where("_among OR doc_id IS NULL").select(*df.columns))) for side in sides]
        return reduce(DataFrame.unionByName, [*alone, group(reduce(DataFrame.unionByName, both))])

    return rows


def _built(named: DataFrame, words: Callable[[DataFrame], DataFrame], group: Callable[[DataFrame], DataFrame]) -> Rows:
    """The words of named(doc_id, text)."""
    repeated = named.groupBy("doc_id").count().where(F.col("count") > 1)

    def rows(keep: Keep) -> DataFrame:
        return words(keep(named))

    return rows if repeated.isEmpty() else _split([rows], repeated.select("doc_id"), group)


def _united(a: LosslessIndex | SimpleIndex, b: LosslessIndex | SimpleIndex, group: Callable[[DataFrame], DataFrame]) -> tuple[Rows, int]:
    """The rows of both, and how often rows are now read apart. Ids alone say which documents both hold."""
    sides = [a._rows, b._rows]
    named = a.ids().select("doc_id", F.lit(1).alias("side")).unionByName(b.ids().select("doc_id", F.lit(2).alias("side")))
    shared = named.groupBy("doc_id").agg(F.bit_or("side").alias("sides")).where("sides = 3").select("doc_id")
    splits = max(a._splits, b._splits)
    if shared.isEmpty():
        return lambda keep: reduce(DataFrame.unionByName, [side(keep) for side in sides]), splits
    if splits >= MOST_SPLITS:  # each doubles what is read
        return lambda keep: group(reduce(DataFrame.unionByName, [side(keep) for side in sides])), splits
    return _split(sides, shared, group), splits + 1


def _changed(rows: Rows, docs: DataFrame) -> DataFrame:
    """(doc_id) of docs(doc_id, text) whose words aren't those that rows has of them."""

    def told(words: DataFrame, n: int) -> DataFrame:
        return words.select("doc_id", F.lit(n).alias("n"), *((F.xxhash64(F.lit(seed), F.col("word")) if n else F.lit(0).cast("long")).alias(f"h{seed}") for seed in (0, 1)))

    def summed(parts: DataFrame) -> DataFrame:
        return parts.groupBy("doc_id").agg(F.sum("n").alias("n"), F.bit_xor("h0").alias("h0"), F.bit_xor("h1").alias("h1"))

    held = summed(told(rows(_all), 1))
    now = summed(told(document_words(docs), 1).unionByName(told(docs, 0)))  # documents without a word too
    return now.exceptAll(held).select("doc_id")


def _replaced(old: DataFrame | None, new: DataFrame | None) -> DataFrame | None:
    """Texts (doc_id, text) of old and new; of an id in both, that of new. The ids of new alone are matched, not texts."""
    if old is None or new is None:
        return old if new is None else new.select("doc_id", "text")
    return old.select("doc_id", "text").join(bounded(new.select("doc_id")), "doc_id", "left_anti").unionByName(new.select("doc_id", "text"))


def has_repeated_ids(docs: DataFrame) -> bool:
    """Whether a doc_id of docs is given twice; reads that column alone."""
    return not docs.groupBy("doc_id").count().where(F.col("count") > 1).isEmpty()
