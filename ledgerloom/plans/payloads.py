"""Queries on raw JSON records: flattening of both dialects, building the nested form and reading it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.jobs import _JOBS, jobs
from ledgerloom.sources.files import flat_record, nested_record
from ledgerloom.session import table

_PICK = {
    "vendor_name": ("$.vendor_name", "$.company.name"), "vendor_gstin": ("$.vendor_gstin", "$.company.gstin"), "buyer_name": ("$.buyer_name", "$.client.name"),
    "invoice_number": ("$.invoice_number", "$.meta.invoiceNumber"), "invoice_date": ("$.invoice_date", "$.meta.date"), "bank_name": ("$.bank_name", "$.bankDetails.bankName"),
}
_SQL_PICK = ", ".join(f"coalesce(j->>'{a}', j->>'{b}') AS {c}" for c, (a, b) in _PICK.items())


def payload_flat(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "extraction_payloads", ["payload_id", "payload"]).distinct().where(F.try_parse_json("payload").isNotNull())
    return df.select("payload_id", *[c.alias(n) for n, c in flat_record(F.col("payload")).items()])


def builder_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    names = [*_PICK, "grand_total"]
    j = jobs(spark, d, names).select("job_id", *names)
    lines = table(spark, d, "line_items", ["job_id", "line_no", "description", "amount"]).distinct().groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "description", "amount"))).alias("items"))
    doc = j.join(lines, "job_id", "left").select("job_id", nested_record({n: F.col(n) for n in names}, F.col("items")).alias("doc"))
    return doc.select("job_id", *[c.alias(n) for n, c in flat_record(F.col("doc")).items()], F.coalesce(F.json_array_length(F.get_json_object("doc", "$.items")), F.lit(0)).cast("bigint").alias("n_items"))


QUERIES = {"payload_flat": payload_flat, "builder_json_roundtrip": builder_json_roundtrip}
SQL = {
    "payload_flat": f"SELECT payload_id, {_SQL_PICK}, try_cast(coalesce(j->>'$.grand_total', j->>'$.totals.grandTotal') AS DOUBLE) AS grand_total FROM (SELECT DISTINCT payload_id, payload, payload::JSON AS j FROM extraction_payloads WHERE json_valid(payload))",
    "builder_json_roundtrip": f"SELECT j.job_id, {', '.join('j.' + c for c in _PICK)}, CASE WHEN isnan(j.grand_total) THEN NULL ELSE j.grand_total END AS grand_total, coalesce(l.n, 0) AS n_items FROM {_JOBS} j LEFT JOIN (SELECT job_id, count(*) AS n FROM (SELECT DISTINCT job_id, line_no, description, amount FROM line_items) GROUP BY 1) l ON j.job_id = l.job_id",
}
