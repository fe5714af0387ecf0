"""Index maintenance by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import IndexConfig, LosslessIndex, bounded, has_repeated_ids
from ..operators.tokenize import document_words
from ..sources.documents import delete_folder, write_sorted

SCHEMA = "word string, doc_id long, positions array<int>, batch long"


class StreamingIndex:
    """An index that streams of documents keep up to date.

    Each micro-batch writes the words of its documents to a folder of its own, and marks the documents that it replaces or
    removes; both folders are named by the batch, so a batch that is run again after a failure replaces what it had
    written. A document's words are those of the last batch that named it. compact() folds all batches into one elsewhere.

    order: a column of the stream (a time, a version) by which the last of several rows for a document within a batch
    counts, be it a text or a removal; of rows alike in it, the greatest text. Without one, a removal in the batch counts
    before any text, and of texts the greatest.
    """

    def __init__(self, spark: SparkSession, path: str, config: IndexConfig = IndexConfig(), order: str | None = None):  # noqa: B008
        self.spark, self.path, self.config, self.order = spark, path, config, order

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Documents (doc_id, text); a null text removes the document. Texts are grouped only if an id is given twice."""
        docs = batch.select("doc_id", "text")
        if has_repeated_ids(docs):
            order = F.col(self.order) if self.order else F.col("text").isNull()
            last = F.max_by(F.struct("text"), F.struct(order, "text"))
            docs = batch.groupBy("doc_id").agg(last.alias("last")).select("doc_id", "last.text")
        self._write(self.path, document_words(docs).select("word", "doc_id", "positions"), docs.select("doc_id"), batch_id)

    @staticmethod
    def _write(path: str, compact: DataFrame, named: DataFrame, batch_id: int) -> None:
        write_sorted(compact, f"{path}/postings/batch={batch_id}", f"{path}/unsorted/batch={batch_id}")
        named.write.mode("overwrite").parquet(f"{path}/named/batch={batch_id}")

    def compact(self, path: str) -> StreamingIndex:
        """What the index holds now, as one batch before all others in a folder of its own, where streams can go on."""
        compact = self.index().compact()
        self._write(path, compact, compact.select("doc_id").distinct(), -1)
        return StreamingIndex(self.spark, path, self.config, self.order)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()

    def index(self) -> LosslessIndex:
        """Of the batches that were written whole, without the rows of documents that a later one names."""
        postings = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/postings")
        named = self.spark.read.schema("doc_id long, batch long").parquet(f"{self.path}/named")
        whole = [r["batch"] for r in named.select("batch").distinct().collect()]
        several = named.groupBy("doc_id").agg(F.max("batch").alias("last"), F.min("batch").alias("first")).where("first < last").select("doc_id", "last")
        named_again = bounded(several.select("doc_id", "last"), distinct=False)
        kept = postings.where(F.col("batch").isin(whole) & F.col("doc_id").isNotNull()).join(named_again, "doc_id", "left").where("last IS NULL OR batch = last")
        return LosslessIndex.of_compact(kept.select("word", "doc_id", "positions"), self.config, ids=named.select("doc_id"))
