"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.survivor import best_values
from ledgerloom.session import table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_values(table(spark, sf_dir, "extracted_fields", ["reading_id", "job_id", "field_name", "value", "confidence", "source", "candidates", "selection_reason"]))


QUERIES = {"p7_found": p7_found}
SQL: dict[str, str] = {}
