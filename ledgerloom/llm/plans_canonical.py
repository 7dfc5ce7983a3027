"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.canonical import canonical_rows
from ledgerloom.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "invoice_facts", ["job_id", "place_of_supply", "bank_name"])
    return canonical_rows(facts, table(spark, sf_dir, "line_items", ["job_id", "line_no", "unit"]), table(spark, sf_dir, "ref_values"))


QUERIES = {"p5_found": p5_found}
SQL: dict[str, str] = {}
