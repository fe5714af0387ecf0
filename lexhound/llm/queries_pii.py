"""op1: every document with pseudonyms in place of personal data."""

from __future__ import annotations

import secrets

from pyspark.sql import functions as F

from .common import table
from .pii import pseudonymise

#: The session's setting of the key; what Spark shows of its settings hides those whose names hold "secret".
KEY_SETTING = "spark.lexhound.pii.secret"
#: Where none is set: values are linked within this process, and nobody can restore them.
_random_key = secrets.token_bytes(32)


def op1_pii(spark, sf_dir):
    given = spark.conf.get(KEY_SETTING, None)
    got = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), given.encode() if given else _random_key)
    return got.select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_found"), "pii_spans")


QUERIES = {"op1_pii": op1_pii}
ORACLES = {}
