"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.history import batch_pairs, prepare
from ledgerloom.session import cut, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All batches are appended to a segment index, then every record probes the segments of the batches before its own."""
    columns = ["job_id", "batch_no", "site_id", "status", "invoice_number", "invoice_date", "vendor_gstin", "grand_total", "buyer_name", "vendor_name"]
    records = cut(prepare(table(spark, sf_dir, "invoice_facts", columns), table(spark, sf_dir, "intake_sites")))
    pairs = batch_pairs(records)
    return pairs.select(F.least("job_id_a", "job_id_b").alias("job_id_a"), F.greatest("job_id_a", "job_id_b").alias("job_id_b")).distinct()


QUERIES = {"p2_found": p2_found}
SQL: dict[str, str] = {}
