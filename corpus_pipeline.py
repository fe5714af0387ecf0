"""A training corpus from raw documents in five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexhound.llm.common import Scratch, delete_table, materialise, table
from lexhound.llm.lang_id import bounds, fit, keep_known
from lexhound.llm.line_dedup import dedup_lines
from lexhound.llm.mixing import mixed
from lexhound.llm.queries_bpe import tokens
from lexhound.llm.queries_lang_id import training_rows
from lexhound.llm.simhash import drop_near_duplicates

#: A document stays if one language has at least this posterior; text without a letter (und) has none.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learnt from the labelled ones; others go, as do those without a letter.

    A document that takes far more bits a byte than held-out labelled ones of the language found is in none.
    """
    model = fit(training_rows(docs))
    return keep_known(docs, model, LEAST_SCORE, most_bits=bounds(training_rows(docs, others=True), model))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal to or within two edits of an earlier one go, and documents that hold nothing else."""
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id."""
    return drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by target weights: each document as often as the mix takes it."""
    return mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, ids and the digests of op3 for every document of the mix."""
    return tokens(docs, ["doc_id", "source", "lang"])


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("encoding", encoding)]
#: Models, edit distances, components and tokens are beyond SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage wrote is removed once its result is, but for that of the last, which is read lazily."""
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with Scratch(spark) as own:
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        own.remove(but=docs)
        if read is not None:
            delete_table(read)
        read = docs
    return STAGES[-1][1](spark, docs, sf_dir)
