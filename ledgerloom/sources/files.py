"""Sources and sinks: intake of files with a quarantine, records as JSON, append-only tables with latest views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXTENSIONS = ("pdf", "jpg", "jpeg", "png", "tiff", "webp")
MAX_BYTES = 50 * 1024 * 1024


def intake(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) files of a folder: extension and size are checked, accepted content is hashed.

    Only paths and lengths are read for the check; content is read for accepted files alone.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    reason = F.when(~ext.isin(*EXTENSIONS), "extension").when(F.col("length") > MAX_BYTES, "size").when(F.col("length") == 0, "empty")
    files = files.withColumn("reason", reason)
    good = files.where("reason IS NULL").select("path", "length", "modificationTime", F.sha2("content", 256).alias("document_hash"))
    return good, files.where("reason IS NOT NULL").select("path", "length", "reason")


def json_records(spark: SparkSession, path: str, schema: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """JSON records with a given schema, without files of certain names and without corrupt records."""
    df = spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", "true").json(path)
    df = df.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return df.where(F.col("_corrupt").isNull() & ~F.col("file").isin(*exclude)).drop("_corrupt") if exclude else df.where(F.col("_corrupt").isNull()).drop("_corrupt")


def append(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def latest_view(versions: DataFrame, key: list[str], version: str, deleted: str | None = None) -> DataFrame:
    """Current rows of an append-only table: the last version of every key, without tombstones."""
    w = Window.partitionBy(*key).orderBy(F.col(version).desc())
    cur = versions.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return cur.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else cur


def upsert(path: str, changes: DataFrame, version: Column) -> None:
    """An update is an appended version of the row."""
    append(changes.withColumn("_version", version), path)


def replace_partitions(df: DataFrame, path: str, partition: list[str]) -> None:
    """Replaces just the partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def export_split(df: DataFrame, path: str, split: str = "split") -> None:
    """Records as JSON lines in one folder per split."""
    df.write.mode("overwrite").partitionBy(split).json(path)


def export_lines(df: DataFrame, line: Column, path: str) -> None:
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def instruction_line(instruction: str, text: Column, answer: Column, limit: int = 4000) -> Column:
    """One JSON object per example, the input cut to ``limit`` characters as the format prescribes."""
    return F.to_json(F.struct(F.lit(instruction).alias("instruction"), F.substring(text, 1, limit).alias("input"), answer.alias("output")))


def nested_record(row: dict[str, Column], lines: Column) -> Column:
    """A flat record as a nested JSON document (company, client, meta, items, totals, bankDetails)."""
    return F.to_json(
        F.struct(
            F.struct(row["vendor_name"].alias("name"), row["vendor_gstin"].alias("gstin")).alias("company"),
            F.struct(row["buyer_name"].alias("name")).alias("client"),
            F.struct(row["invoice_number"].alias("invoiceNumber"), row["invoice_date"].alias("date")).alias("meta"),
            lines.alias("items"),
            F.struct(row["grand_total"].alias("grandTotal")).alias("totals"),
            F.struct(row["bank_name"].alias("bankName")).alias("bankDetails"),
        )
    )


def flat_record(payload: Column) -> dict[str, Column]:
    """The flat record of either JSON dialect: snake_case names first, then the nested camelCase ones."""
    pick = lambda *paths: F.coalesce(*[F.get_json_object(payload, p) for p in paths])
    return {
        "vendor_name": pick("$.vendor_name", "$.company.name"),
        "vendor_gstin": pick("$.vendor_gstin", "$.company.gstin"),
        "buyer_name": pick("$.buyer_name", "$.client.name"),
        "invoice_number": pick("$.invoice_number", "$.meta.invoiceNumber"),
        "invoice_date": pick("$.invoice_date", "$.meta.date"),
        "grand_total": pick("$.grand_total", "$.totals.grandTotal").try_cast("double"),
        "bank_name": pick("$.bank_name", "$.bankDetails.bankName"),
    }
