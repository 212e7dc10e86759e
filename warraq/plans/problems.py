"""Queries of the general problem, over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from warraq.operators.multivalue import AUTHORS, IDS, KEYWORDS, explode_values
from warraq.sources import load


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """(field, rec_key, pos, item): one row per packed value; keys and positions are unique, so the rows are distinct."""
    sample, registry = load(spark, d, "sample_articles"), load(spark, d, "authors06")
    parts = [
        explode_values(sample, "row_no", "authors", AUTHORS, "authors"),
        explode_values(sample, "row_no", "keywords", KEYWORDS, "keywords"),
        explode_values(registry, "id", "articles_ids", IDS, "articles_ids"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES = {"p6_found": p6_found}
