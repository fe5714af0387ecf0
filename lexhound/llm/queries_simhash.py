"""op8: every document's fingerprint, links and component."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .simhash import near_duplicates


def op8_simhash(spark, sf_dir):
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")


QUERIES = {"op8_simhash": op8_simhash}
ORACLES = {}
