"""Queries on raw records: timestamp normalisation (p3) and nested payloads (p6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.nested import analyse, child_rows, shred, typed_tables
from ledgerloom.operators.timestamps import invoice_dates, read_dates
from ledgerloom.session import table, write_out


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invoice_dates(table(spark, sf_dir, "invoice_facts", ["job_id", "site_id", "invoice_date", "due_date"]), table(spark, sf_dir, "intake_sites"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return child_rows(table(spark, sf_dir, "extraction_payloads", ["payload_id", "payload"]))


def p3_undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same values with no site's date order given: only the values of a site speak, and what stays open is marked."""
    out = read_dates(table(spark, sf_dir, "invoice_facts", ["job_id", "site_id", "invoice_date", "due_date"]), table(spark, sf_dir, "intake_sites"), declared=False)
    return out.select("job_id", "field_name", F.col("ts_normal").alias("normal_form"), F.col("ts_status").alias("status"), F.col("ts_order").alias("date_order"), F.round("ts_posterior", 6).alias("posterior"))


def p6_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items of all payloads as a table of their own, every attribute a typed column."""
    payloads = table(spark, sf_dir, "extraction_payloads", ["payload_id", "payload"])
    rows = write_out(shred(payloads, "payload_id", "payload", analyse(payloads, "payload"), natural={"cells": "column"}))
    return typed_tables(rows, "payload_id")["line_items"]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p3_found": p3_found, "p3_undeclared": p3_undeclared, "p6_found": p6_found, "p6_line_items": p6_line_items}
SQL: dict[str, str] = {}
