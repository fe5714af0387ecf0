"""op4: the main text of every page."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .html_text import extract


def op4_html(spark, sf_dir):
    got = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {"op4_html": op4_html}
ORACLES = {}
