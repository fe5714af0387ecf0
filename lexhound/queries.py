"""One query for each operator, over the whole tables of a folder."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.similarity import Algorithm
from .functions.text import normalize
from .operators import sets
from .operators.expand import proximate_documents
from .operators.hits import leaf_hits, rate, top_hits
from .operators.index import IndexConfig, LosslessIndex, SimpleIndex
from .operators.tokenize import raw_tokens, tokenize
from .plans.parser import ParseError
from .plans.search import Query
from .sources.documents import DocumentMap, read_index, read_table, shared_folder, with_doc_id, write_index
from .streaming.incremental import StreamingIndex

EXACT = IndexConfig(threshold=1.0, algorithm=Algorithm.EXACT, word_count_limit=100)
HAMMING = IndexConfig()
JARO = IndexConfig(threshold=0.9, algorithm=Algorithm.JARO)
#: What the queries below look for.
WORD, OTHER, PREFIX, FUZZY, DISTANCE = "the", "ering", "than", "thering", 100
EXPANDED = ("thering", "nicht", "of", "ertheding")
#: Documents that single lookups ask for.
LOOKED_UP = (0, 1, 2, 5, 10**12)
#: What q_parse() reads.
PARSED = (
    "icelk kvarn", "icelk kvarn web server", "not icelk", "or", "for me", " (  ) ", "icelk and kvarn or agde", "agde or icelk and kvarn", "(icelk or kvarn) and code", "code (kvarn or icelk) ",
    " (icelk or iselk)  (kvarn or agde)))", "icelk -(agde or kvarn)", "icelk - (agde or kvarn)", "not ", "or icelk", "(or (icelk))", "icelk and not kvarn or agde", "icelk or not kvarn or agde",
    "agde not sync or icelk and not kvarn or agde", "icelk !kvarn", "icelk.dev", "next-generation kvarn", "river", "river bank", "river and bank", "river or bank", "not river", "river -bank", "river not bank", "!river", "a b c", "a or b c", "a b or c", "(a or b) c", "a (b or c) d", "a and b or c and d", "a -(b or c)",
    "a not b not c", "((a))", "(a b", "a) b", "a(b)c", "ab.cd", "semi-colon", "-", "", "   ", "and", "a and", "or b", "not", "a or not b", "Ä und Ö", "A AND b", "android orbit notable", "()", "- a", "a - b", "a  and  b", "a,b",
)

_built: dict[tuple[str, str], str] = {}


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").select("doc_id", "text")


def index(spark: SparkSession, folder: str, config: IndexConfig = HAMMING) -> LosslessIndex:
    """The documents' index, written the first time that a session asks for it."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _built:
        path = shared_folder(spark)
        write_index(LosslessIndex.build(documents(spark, folder)), path)
        _built[key] = path
    found = read_index(spark, _built[key])
    return LosslessIndex.of_compact(found.compact(), config, found.words(), documents(spark, folder).select("doc_id"))


def _hits(df: DataFrame) -> DataFrame:
    places = F.concat_ws(" ", F.transform("occurrences", lambda o: F.concat_ws(":", o["start"], o["word_id"])))
    return df.select("doc_id", "start", "word_id", F.round("rating", 6).alias("rating"), places.alias("places"), F.coalesce("closest_not.start", F.lit(-1)).alias("not_start"))


def _proximates(df: DataFrame) -> DataFrame:
    return df.select("query_word", "word", F.round(F.col("proximity").cast("double"), 6).alias("proximity"))


def q_tokenize(spark, folder):
    return tokenize(documents(spark, folder))


def q_tokenize_end_offsets(spark, folder):
    return tokenize(documents(spark, folder), strict_offsets=False).where(~F.col("is_compound")).select("doc_id", "word", "start")


def q_normalize_words(spark, folder):
    return raw_tokens(documents(spark, folder)).select(normalize(F.col("raw")).alias("word")).groupBy("word").count()


def q_hyphen_compounds(spark, folder):
    return tokenize(documents(spark, folder)).where("is_compound").select("doc_id", "word", "start")


def q_postings_simple(spark, folder):
    return SimpleIndex.build(documents(spark, folder)).document_postings()


def q_postings_lossless(spark, folder):
    compact = LosslessIndex.build(documents(spark, folder)).compact()
    return compact.select("word", "doc_id", F.size("positions").cast("long").alias("n"), F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


def q_vocabulary(spark, folder):
    return index(spark, folder).words()


def q_word_count(spark, folder):
    return index(spark, folder).words().agg(F.count("*").alias("words"))


def q_words_starting_with(spark, folder):
    return index(spark, folder).words_starting_with("é")


def q_index_size(spark, folder):
    own = index(spark, folder)
    return own.size().select(F.lit("lossless").alias("kind"), "bytes").unionByName(own.to_simple().size().select(F.lit("simple").alias("kind"), "bytes"))


def q_contains_word(spark, folder):
    """Single lookups: whether documents hold a word."""
    own = index(spark, folder)
    return spark.createDataFrame([(w, d, own.contains_word(w, d)) for w in (WORD, OTHER) for d in LOOKED_UP], "word string, doc_id long, found boolean")


def q_word_by_document(spark, folder):
    """Whether each document holds a word."""
    found = index(spark, folder).documents_with_word(OTHER).withColumn("has_word", F.lit(True))
    return documents(spark, folder).select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("has_word", F.lit(False)).alias("has_word"))


def q_docs_with_word(spark, folder):
    return index(spark, folder).documents_with_word(WORD)


def q_insert_documents(spark, folder):
    """The index of documents, with conversations' turns added under ids of their own."""
    turns = with_doc_id(read_table(spark, folder, "conversations"), "conv_id", "turn").select("doc_id", "text")
    return index(spark, folder).insert(turns).compact().groupBy("word").agg(F.count("*").alias("docs"), F.sum(F.size("positions")).alias("places"))


def q_merge_indexes(spark, folder):
    other = LosslessIndex.build(read_table(spark, folder, "benchmark"), id_col="item_id")
    return index(spark, folder).merge(other).postings()


def q_merge_simple_indexes(spark, folder):
    other = SimpleIndex.build(read_table(spark, folder, "benchmark"), id_col="item_id")
    return index(spark, folder).to_simple().merge(other).document_postings()


def q_remove_document(spark, folder):
    """Without the documents that labels call toxic."""
    toxic = read_table(spark, folder, "labels").where("toxic = 1").select("doc_id")
    return index(spark, folder).remove(toxic).places_of_documents()


def q_upsert_documents(spark, folder):
    """Documents that have a benchmark item's id take its text."""
    items = read_table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return index(spark, folder).upsert(items).places_of_documents()


def q_missing_postings(spark, folder):
    """What an index of documents holds that benchmark texts under the same ids do not."""
    items = read_table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return index(spark, folder).to_simple().with_documents(items).missing()


def q_apply_missing(spark, folder):
    items = read_table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return index(spark, folder).to_simple().with_documents(items).apply_missing().document_postings().groupBy("doc_id").agg(F.count("*").alias("words"))


def q_simple_upsert(spark, folder):
    """The index without places: documents that have a benchmark item's id take its text, others' places are read again."""
    items = read_table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    own = index(spark, folder, EXACT).to_simple().with_documents(documents(spark, folder)).upsert(items)
    return _hits(rate(leaf_hits(own.occurrences(None, OTHER), 1, None)))


def q_simple_insert_missing(spark, folder):
    """As above, but inserted: what the earlier texts held and the new ones don't is stale."""
    items = read_table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return index(spark, folder, EXACT).to_simple().with_documents(documents(spark, folder)).insert(items).missing()


def q_force_remove(spark, folder):
    """Names and places of labelled documents once one of them is gone from map and index."""
    known, own = DocumentMap(_labelled(spark, folder)), index(spark, folder)
    for doc_id in (*LOOKED_UP, -1):
        known, own = known.force_remove(doc_id, own)
    places = own.places_of_documents()
    return known.table.join(places, "doc_id", "full").select("name", "doc_id", "places")


def q_document_map_reads(spark, folder):
    """Single lookups in the map of labelled documents, and its first free id."""
    known = DocumentMap(_labelled(spark, folder))
    rows = [("contains", str(d), str(known.contains(d)).lower()) for d in LOOKED_UP]
    rows += [("name", str(d), known.get_name(d)) for d in LOOKED_UP]
    rows += [("id", f"doc {d}", None if (got := known.get_id(f"doc {d}")) is None else str(got)) for d in LOOKED_UP]
    return spark.createDataFrame([*rows, ("first free", "", str(known.first_free()))], "read string, of string, found string")


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "labels").where("doc_id IS NOT NULL").select("doc_id").distinct().select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), "doc_id")


def q_streaming_index(spark, folder):
    """Two micro-batches: all documents; then benchmark texts under the same ids, in several versions, and removals of toxic documents."""
    stream = StreamingIndex(spark, shared_folder(spark), order="version")
    items = read_table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    toxic = read_table(spark, folder, "labels").where("toxic = 1 AND doc_id IS NOT NULL").select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(3).alias("version"))
    stream.apply(documents(spark, folder).withColumn("version", F.lit(0)), 0)
    versions = items.withColumn("version", F.lit(2)).unionByName(items.select("doc_id", F.lit("zzz an earlier text").alias("text"), F.lit(1).alias("version")))
    stream.apply(versions.unionByName(toxic), 1)
    return stream.index().places_of_documents()


def q_parse(spark, folder):
    """Trees of query strings, or the names of their errors."""

    def tree(text):
        try:
            return str(Query.parse(text))
        except ParseError as e:
            return type(e).__name__

    return spark.createDataFrame([(t, tree(t)) for t in PARSED], "query string, tree string")


def q_document_map(spark, folder):
    """Ids for pages by their urls, into a map in which every labelled document has a name: pages take the ids between those."""
    return DocumentMap(_labelled(spark, folder)).reserve(read_table(spark, folder, "pages").select(F.col("url").alias("name")).where("name IS NOT NULL")).table


def q_expand_exact(spark, folder):
    return _proximates(index(spark, folder, EXACT).proximates(EXPANDED))


def q_expand_hamming(spark, folder):
    return _proximates(index(spark, folder, HAMMING).proximates(EXPANDED))


def q_expand_prefix(spark, folder):
    """At a threshold that no other word reaches."""
    return _proximates(index(spark, folder, replace(HAMMING, threshold=1.0)).proximates([PREFIX, "é"]))


def q_expand_jaro(spark, folder):
    return _proximates(index(spark, folder, JARO).proximates(EXPANDED))


def q_expand_whole_vocabulary(spark, folder):
    return _proximates(index(spark, folder, replace(HAMMING, threshold=0.7, word_count_limit=10**9)).proximates([FUZZY, "of"]))


def q_expand_documents(spark, folder):
    own = index(spark, folder)
    return proximate_documents(own.postings(), own.proximates([FUZZY])).select("query_word", "doc_id", "word", F.round(F.col("proximity").cast("double"), 6).alias("proximity"))


def _documents_query(text: str, config: IndexConfig = EXACT, strict: bool = False):
    def run(spark, folder):
        return Query.parse(text).documents(index(spark, folder, config)).table(strict)

    return run


def q_docs_intersect(spark, folder):
    own = index(spark, folder)
    return sets.intersect(own.documents_with_word(WORD), own.documents_with_word(OTHER))


def q_docs_union(spark, folder):
    own = index(spark, folder)
    return sets.union(own.documents_with_word(WORD), own.documents_with_word(OTHER))


def q_docs_difference(spark, folder):
    own = index(spark, folder)
    return sets.difference(own.documents_with_word(WORD), own.documents_with_word(OTHER))


def q_deduplicate(spark, folder):
    """One row of each word and document of the index's places."""
    return sets.deduplicate(index(spark, folder).postings().select("word", "doc_id"))


def q_deduplicate_keeping(spark, folder):
    """Of each word of the index the place that is latest in the lowest document."""
    return sets.deduplicate_keeping(index(spark, folder).postings(), ["word"], F.struct(-F.col("doc_id"), "start"))


def q_progressive(spark, folder):
    """Places of two words, each with the other word's place before and after it; -1 for none."""
    own = index(spark, folder).postings()
    left, right = (own.where(F.col("word") == w) for w in (WORD, OTHER))
    met = sets.progressive(left, right, "doc_id", "start", ["word"])
    return met.select("doc_id", "start", "is_left", F.coalesce("behind.start", F.lit(-1)).alias("behind"), F.coalesce("ahead.start", F.lit(-1)).alias("ahead"))


def q_hits_word(spark, folder):
    return _hits(rate(leaf_hits(index(spark, folder, EXACT).occurrences(None, WORD), 1, None)))


def q_hits_word_reread(spark, folder):
    """The same by the index without places, which reads the documents again."""
    own = index(spark, folder, EXACT)
    simple = SimpleIndex(own.document_postings(), EXACT, documents(spark, folder))
    return _hits(rate(leaf_hits(simple.occurrences(None, OTHER), 1, None)))


def _hits_query(text: str, config: IndexConfig = EXACT):
    def run(spark, folder):
        return _hits(Query.parse(text).hits(index(spark, folder, config), DISTANCE))

    return run


def q_search_topk(spark, folder):
    return _hits(Query.parse("the and of").search(index(spark, folder, EXACT), 20, DISTANCE))


def q_search_topk_fuzzy(spark, folder):
    return _hits(top_hits(Query.parse(f"{FUZZY} or erther -{OTHER}").hits(index(spark, folder), DISTANCE), 20))


#: Query strings by the name of the query that runs them over documents, then over hits.
DOCUMENT_QUERIES = {
    "docs_and": ("the ering of", EXACT, False),
    "docs_or": ("thering or nicht or (ering and thble)", EXACT, False),
    "docs_and_not": ("the -ering", EXACT, False),
    "docs_and_not_strict": ("the -(thing or ering)", EXACT, True),
    "docs_fuzzy": ("thering erther or nicht", HAMMING, False),
}
HIT_QUERIES = {
    "hits_session_merge": ("the", EXACT),
    "hits_and": ("the of", EXACT),
    "hits_or": ("thing or ering", EXACT),
    "hits_and_not": ("ering -thing", EXACT),
    "hits_nested": ("(the or thing) and (of or ering) not thble", EXACT),
    "hits_fuzzy": ("thering erther", HAMMING),
    "rating_final": ("the of thing", EXACT),
}

QUERIES = {
    name.removeprefix("q_"): f
    for name, f in list(globals().items())
    if name.startswith("q_")
} | {k: _documents_query(*v) for k, v in DOCUMENT_QUERIES.items()} | {k: _hits_query(*v) for k, v in HIT_QUERIES.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return q_search_topk(spark, folder)
