"""Queries of problem 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.reading import reading_levels
from ledgerloom.session import table


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents", ["doc_id", "text"]), table(spark, sf_dir, "reading_labels", ["doc_id", "reading_level"])).select("doc_id", "reading_level")


QUERIES = {"p10_found": p10_found}
SQL: dict[str, str] = {}
