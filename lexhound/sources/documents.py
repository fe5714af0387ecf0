"""Documents in and out: names and ids, tables, and indices on disk."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.similarity import Algorithm
from ..operators.index import IndexConfig, LosslessIndex, SimpleIndex


#: Of Parquet files that are sorted, so many make a range: their rows, some 20 times as large in memory, are sorted without a spill.
RANGE_BYTES = 8 << 20


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; one with fewer splits than there are cores is dealt out to all of them."""
    df, cores = spark.read.parquet(f"{folder}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def with_doc_id(df: DataFrame, *keys: str) -> DataFrame:
    """df with a doc_id made of key columns: a hash, so that it needs no order and is the same in every run."""
    return df.withColumn("doc_id", F.xxhash64(*keys))


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, within spark.checkpoint.dir; a local one only in local mode where that is unset.

    It is removed when the driver's JVM ends.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/lexhound-index"
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)  # which counts for folders that exist
    return path


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _folder_bytes(spark: SparkSession, path: str) -> int:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def write_sorted(postings: DataFrame, path: str, unsorted: str, ranges: int | None = None) -> None:
    """Postings as Parquet in order of word and document, by way of a folder of their own that is removed.

    Rows are first written as they come, for what finds the bounds of ranges would else read and tokenize all texts once
    more; by what they take there, ranges are made so small that none is sorted on disk. Ranges are over word and document,
    so the rows of a word that most documents hold are in many files.
    """
    spark, keys = postings.sparkSession, ["word", "doc_id"]
    postings.write.mode("overwrite").parquet(unsorted)
    if ranges is None:
        ranges = max(spark.sparkContext.defaultParallelism, -(-_folder_bytes(spark, unsorted) // RANGE_BYTES))
    rows = spark.read.schema(postings.schema).parquet(unsorted)
    rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
    delete_folder(spark, unsorted)


def write_index(index: LosslessIndex | SimpleIndex, path: str, ranges: int | None = None) -> None:
    """Postings and vocabulary as Parquet, in order of word and document, so that a lookup reads few row groups.

    A row is a word of a document; places are an array of it.
    """
    lossless = isinstance(index, LosslessIndex)
    postings = index.compact() if lossless else index.document_postings()
    spark = postings.sparkSession
    write_sorted(postings, f"{path}/postings", f"{path}/unsorted", ranges)
    words = spark.read.parquet(f"{path}/postings").select("word").distinct()
    words.repartitionByRange("word").sortWithinPartitions("word").write.mode("overwrite").parquet(f"{path}/vocabulary")
    config = asdict(index.config) | {"algorithm": index.config.algorithm.value, "lossless": lossless}
    spark.createDataFrame([(json.dumps(config),)], "config string").coalesce(1).write.mode("overwrite").json(f"{path}/config")


def read_index(spark: SparkSession, path: str) -> LosslessIndex | SimpleIndex:
    """What write_index() wrote."""
    config = json.loads(spark.read.schema("config string").json(f"{path}/config").first()["config"])
    lossless = config.pop("lossless")
    own = IndexConfig(**config | {"algorithm": Algorithm(config["algorithm"])})
    postings = spark.read.parquet(f"{path}/postings")
    if lossless:
        return LosslessIndex.of_compact(postings, own, spark.read.parquet(f"{path}/vocabulary"))
    return SimpleIndex(postings, own)


class DocumentMap:
    """Documents' names and ids, one to one: a table (name, doc_id)."""

    def __init__(self, table: DataFrame):
        self.table = table.select("name", "doc_id")

    @classmethod
    def empty(cls, spark: SparkSession) -> DocumentMap:
        return cls(spark.createDataFrame([], "name string, doc_id long"))

    def contains(self, doc_id: int) -> bool:
        return not self.table.where(F.col("doc_id") == doc_id).isEmpty()

    def get_id(self, name: str) -> int | None:
        row = self.table.where(F.col("name") == name).first()
        return row["doc_id"] if row else None

    def get_name(self, doc_id: int) -> str | None:
        row = self.table.where(F.col("doc_id") == doc_id).first()
        return row["name"] if row else None

    def first_free(self) -> int:
        """0 if there is no document; else the lowest id above 0 that is free."""
        if self.table.isEmpty():
            return 0
        runs = _runs(self.table)
        gap = runs.where("gaps > 0").orderBy("gaps").first()
        return gap["low"] - gap["gaps"] if gap else self.table.where("doc_id > 0").select("doc_id").distinct().count() + 1

    def reserve(self, names: DataFrame) -> DocumentMap:
        """With an id for each new name of names(name), in order of name: free ids from the lowest on. Known names keep theirs."""
        new = names.select("name").distinct().join(self.table.select("name"), "name", "left_anti")
        numbered = with_row_number(new, F.col("name"))
        n = numbered.count()
        if not n:
            return self
        if self.table.isEmpty():
            return DocumentMap(numbered.select("name", F.col("n").alias("doc_id")))
        used = self.table.where("doc_id > 0").select("doc_id").distinct().count()
        # a gap before a run holds the free ids whose numbers are from the gaps of the run before to its own
        runs = with_row_number(_runs(self.table), F.col("gaps"), "k")
        before = runs.select((F.col("k") + 1).alias("k"), F.col("gaps").alias("gaps_before"))
        gaps = runs.join(before, "k", "left").select("gaps", "low", F.coalesce("gaps_before", F.lit(0)).alias("gaps_before")).where((F.col("gaps") > F.col("gaps_before")) & (F.col("gaps_before") < n))
        last = F.least(F.col("gaps"), F.lit(n)) - 1
        free = gaps.select("gaps", "low", F.explode(F.sequence(F.col("gaps_before"), last)).alias("n")).select("n", (F.col("low") - F.col("gaps") + F.col("n")).alias("free"))
        placed = numbered.join(free, "n", "left").select("name", F.coalesce("free", F.col("n") + used + 1).alias("doc_id"))
        return DocumentMap(self.table.unionByName(placed))

    def remove(self, doc_id: int) -> DocumentMap:
        return DocumentMap(self.table.where(F.col("doc_id") != doc_id))

    def force_remove(self, doc_id: int, index: LosslessIndex | SimpleIndex) -> tuple[DocumentMap, LosslessIndex | SimpleIndex]:
        """Map and index without the document; as they are if it is unknown."""
        return (self.remove(doc_id), index.remove(doc_id)) if self.contains(doc_id) else (self, index)

    def insert(self, docs: DataFrame, index: LosslessIndex | SimpleIndex) -> tuple[DocumentMap, LosslessIndex | SimpleIndex]:
        """Map and index with docs(name, text). A known name keeps its id, and the words of its earlier text stay."""
        known = self.reserve(docs)
        return known, index.insert(docs.join(known.table, "name").select("doc_id", "text"))


def with_row_number(df: DataFrame, order: Column, name: str = "n") -> DataFrame:
    """df with a gapless number from 0 in an order, without one task that holds all: ranges are numbered each by itself.

    One count for each range reaches the driver.
    """
    part = df.repartitionByRange(order).withColumn("_range", F.spark_partition_id())
    path = f"{shared_folder(df.sparkSession)}/numbered"
    part.write.parquet(path)
    kept = df.sparkSession.read.schema(part.schema).parquet(path)
    sizes = sorted((r["_range"], r["count"]) for r in kept.groupBy("_range").count().collect())
    before, offsets = 0, {}
    for k, size in sizes:
        offsets[k], before = before, before + size
    base = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.col("_range")) if offsets else F.lit(0)
    inside = Window.partitionBy("_range").orderBy(order)
    return kept.withColumn(name, (F.row_number().over(inside) - 1 + base).cast("long")).drop("_range")


def _runs(table: DataFrame) -> DataFrame:
    """Runs of ids above 0 without a free one between them: gaps, how many ids above 0 are free before it, and low, its first."""
    numbered = with_row_number(table.select("doc_id").where("doc_id > 0").distinct(), F.col("doc_id"))
    return numbered.groupBy((F.col("doc_id") - F.col("n") - 1).alias("gaps")).agg(F.min("doc_id").alias("low"))
