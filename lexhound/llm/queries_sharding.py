"""op5: all documents in sixteen shards of near equal bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .sharding import shard


def op5_sharding(spark, sf_dir):
    got = shard(table(spark, sf_dir, "documents"), 16)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op5_sharding": op5_sharding}
ORACLES = {}
