"""op3: every document's token ids and the bytes they stand for, as digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from .bpe import encode
from .common import table


def tokens(docs, keep, path=None, pattern=None):
    """keep columns of docs, ids, n_tokens, ids_sha256, decoded_sha256 of rows that have a text."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    got = encode(docs.select(*keep, "text"), path, pattern, decoded_into="decoded")
    words = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return got.select(
        *keep,
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(words.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_bpe(spark, sf_dir):
    return tokens(table(spark, sf_dir, "documents"), ["doc_id"]).drop("ids")


QUERIES = {"op3_bpe": op3_bpe}
ORACLES = {}
