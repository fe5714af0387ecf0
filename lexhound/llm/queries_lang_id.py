"""op9: the language of every document, learnt from those not held out."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .lang_id import fit, predict


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs, others=False):
    """(key, lang, text) of the labelled documents that are learnt from, or of the others, which are held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (held_out() if others else ~held_out()))
    return known.select(F.col("doc_id").alias("key"), "lang", "text")


def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs))
    got = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model, ["doc_id", "held_out"])
    return got.select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


QUERIES = {"op9_language_id": op9_language_id}
ORACLES = {}
