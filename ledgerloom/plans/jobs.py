"""Queries on jobs, runs and templates: latest views, duplicates, listings, splits, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.lifecycle import first_by_hash, hash_split, latest, page, record_diff, round_robin, running_novelty, running_rank
from ledgerloom.operators.retrieval import best_with_margin
from ledgerloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_JOBS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY received_at DESC, batch_no) rn FROM invoice_facts) WHERE rn = 1)"


def jobs(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    """One row per job: the last delivery."""
    return latest(table(spark, d, "invoice_facts", list(dict.fromkeys(["job_id", "received_at", "batch_no", *columns]))), ["job_id"], [F.desc("received_at"), F.col("batch_no")])


@query(f"SELECT job_id, batch_no, status, vendor_name, grand_total FROM {_JOBS}")
def jobs_latest(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d, ["status", "vendor_name", "grand_total"]).select("job_id", "batch_no", "status", "vendor_name", "grand_total")


@query("SELECT job_id, run_id, pipeline_version, overall_confidence FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, run_id) rn FROM extraction_runs) WHERE rn = 1")
def latest_run_per_job(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "extraction_runs", ["job_id", "run_id", "pipeline_version", "overall_confidence", "created_at"])
    return latest(runs, ["job_id"], [F.desc("created_at"), F.col("run_id")]).select("job_id", "run_id", "pipeline_version", "overall_confidence")


@query("SELECT run_id, document_hash FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(document_hash, run_id) ORDER BY created_at, run_id) rn FROM extraction_runs) WHERE rn = 1")
def dedupe_by_hash(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "extraction_runs", ["run_id", "document_hash", "created_at"])
    return first_by_hash(runs, "document_hash", "run_id", [F.col("created_at"), F.col("run_id")]).select("run_id", "document_hash")


@query(f"SELECT job_id, status, overall_confidence FROM {_JOBS} WHERE status IN ('done', 'reviewed', 'partially_reviewed') AND (vendor_name ILIKE '%limited%' OR job_id ILIKE '%limited%') AND needs_review ORDER BY created_at DESC, job_id LIMIT 50 OFFSET 10")
def jobs_page(spark: SparkSession, d: str) -> DataFrame:
    df = jobs(spark, d, ["status", "overall_confidence", "vendor_name", "needs_review", "created_at"])
    df = df.where(F.col("status").isin("done", "reviewed", "partially_reviewed") & (F.col("vendor_name").ilike("%limited%") | F.col("job_id").ilike("%limited%")) & F.col("needs_review"))
    return page(df, [F.desc("created_at"), F.col("job_id")], 50, 10).select("job_id", "status", "overall_confidence")


@query(f"SELECT status, count(*) AS n_jobs, count(*) FILTER (WHERE needs_review) AS n_review, round(avg(overall_confidence), 6) AS mean_confidence FROM {_JOBS} GROUP BY status")
def jobs_count(spark: SparkSession, d: str) -> DataFrame:
    df = jobs(spark, d, ["status", "overall_confidence", "needs_review"])
    return df.groupBy("status").agg(F.count("*").alias("n_jobs"), F.count_if("needs_review").alias("n_review"), F.round(F.avg("overall_confidence"), 6).alias("mean_confidence"))


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE ground_truth_source = 'human_corrected') AS gold, count(*) FILTER (WHERE ground_truth_source = 'human_confirmed') AS silver, count(*) FILTER (WHERE ground_truth_source = 'auto_accepted') AS bronze, count(DISTINCT template_family_id) AS families FROM {_JOBS}")
def dataset_tier_stats(spark: SparkSession, d: str) -> DataFrame:
    df = jobs(spark, d, ["ground_truth_source", "template_family_id"])
    tier = lambda x: F.count_if(F.col("ground_truth_source") == x)
    return df.agg(F.count("*").alias("total"), tier("human_corrected").alias("gold"), tier("human_confirmed").alias("silver"), tier("auto_accepted").alias("bronze"), F.countDistinct("template_family_id").alias("families"))


@query("""
WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, run_id) rn FROM extraction_runs) WHERE rn = 1),
f AS (SELECT DISTINCT reading_id, run_id, field_name, confidence FROM extracted_fields)
SELECT r.job_id, r.run_id, count(f.reading_id) AS n_readings, count(DISTINCT f.field_name) AS n_fields, round(min(f.confidence), 6) AS least_confidence
FROM r LEFT JOIN f ON r.run_id = f.run_id GROUP BY r.job_id, r.run_id""")
def audit_trail(spark: SparkSession, d: str) -> DataFrame:
    runs = latest(table(spark, d, "extraction_runs", ["job_id", "run_id", "created_at"]), ["job_id"], [F.desc("created_at"), F.col("run_id")])
    fields = table(spark, d, "extracted_fields", ["reading_id", "run_id", "field_name", "confidence"]).distinct()
    per_run = fields.groupBy("run_id").agg(F.count("reading_id").alias("n_readings"), F.countDistinct("field_name").alias("n_fields"), F.round(F.min("confidence"), 6).alias("least_confidence"))
    return runs.select("job_id", "run_id").join(per_run, "run_id", "left").na.fill(0, ["n_readings", "n_fields"]).select("job_id", "run_id", "n_readings", "n_fields", "least_confidence")


@query(f"SELECT template_family_id, count(*) AS sample_count, arg_min(vendor_name, struct_pack(a := created_at, b := job_id)) FILTER (WHERE vendor_name <> '') AS first_vendor, min(created_at) AS first_seen FROM {_JOBS} WHERE template_family_id IS NOT NULL GROUP BY template_family_id")
def family_get_or_create(spark: SparkSession, d: str) -> DataFrame:
    df = jobs(spark, d, ["template_family_id", "vendor_name", "created_at"]).where("template_family_id IS NOT NULL")
    first = F.min_by(F.when(F.col("vendor_name") != "", F.col("vendor_name")), F.when(F.col("vendor_name") != "", F.struct("created_at", "job_id")))
    return df.groupBy("template_family_id").agg(F.count("*").alias("sample_count"), first.alias("first_vendor"), F.min("created_at").alias("first_seen"))


@query("SELECT pipeline_version, document_hash, dense_rank() OVER (PARTITION BY pipeline_version ORDER BY first_seen, document_hash) AS version_num FROM (SELECT pipeline_version, document_hash, min(created_at) AS first_seen FROM extraction_runs WHERE document_hash IS NOT NULL GROUP BY 1, 2) WHERE pipeline_version IS NOT NULL")
def version_numbering(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "extraction_runs", ["pipeline_version", "document_hash", "created_at"]).where("document_hash IS NOT NULL AND pipeline_version IS NOT NULL")
    first = runs.groupBy("pipeline_version", "document_hash").agg(F.min("created_at").alias("first_seen"))
    return running_rank(first, "pipeline_version", "first_seen", "document_hash", "before").select("pipeline_version", "document_hash", (F.col("before") + 1).alias("version_num"))


@query(f"SELECT job_id, template_family_id, seen_before, seen_before < 3 AS is_novel FROM (SELECT job_id, template_family_id, count(*) OVER (PARTITION BY template_family_id ORDER BY created_at, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen_before FROM {_JOBS} WHERE template_family_id IS NOT NULL)")
def novelty_running(spark: SparkSession, d: str) -> DataFrame:
    df = jobs(spark, d, ["template_family_id", "created_at"]).where("template_family_id IS NOT NULL")
    return running_novelty(df, "template_family_id", "created_at", "job_id", 3).select("job_id", "template_family_id", "seen_before", "is_novel")


@query(f"SELECT template_family_id, count(*) FILTER (WHERE ground_truth_source = 'human_corrected') AS corrections, count(*) AS reviewed, round(greatest(0, 1 - count(*) FILTER (WHERE ground_truth_source = 'human_corrected') / count(*)), 6) AS accuracy FROM {_JOBS} WHERE template_family_id IS NOT NULL GROUP BY 1")
def template_feedback_rates(spark: SparkSession, d: str) -> DataFrame:
    df = jobs(spark, d, ["template_family_id", "ground_truth_source"]).where("template_family_id IS NOT NULL")
    fixed = F.count_if(F.coalesce(F.col("ground_truth_source") == "human_corrected", F.lit(False)))
    return df.groupBy("template_family_id").agg(fixed.alias("corrections"), F.count("*").alias("reviewed"), F.round(F.greatest(F.lit(0.0), 1 - fixed / F.count("*")), 6).alias("accuracy"))


@query(f"SELECT job_id, template_family_id, turn FROM (SELECT job_id, template_family_id, row_number() OVER (PARTITION BY template_family_id ORDER BY created_at DESC, job_id) AS turn FROM {_JOBS} WHERE template_family_id IS NOT NULL) ORDER BY turn, template_family_id LIMIT 100")
def stratified_round_robin(spark: SparkSession, d: str) -> DataFrame:
    df = jobs(spark, d, ["template_family_id", "created_at"]).where("template_family_id IS NOT NULL")
    return round_robin(df, "template_family_id", [F.desc("created_at"), F.col("job_id")], 100).select("job_id", "template_family_id", "turn")


@query(f"SELECT job_id, CASE WHEN CAST('0x' || substr(sha256(job_id || '42'), 1, 8) AS BIGINT) < CAST(0.8 * 4294967296 AS BIGINT) THEN 'train' ELSE 'val' END AS split FROM {_JOBS}")
def train_val_split(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d, []).select("job_id", hash_split(F.col("job_id"), 0.8).alias("split"))


@query(f"SELECT job_id, batch_no FROM {_JOBS} j WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.job_id = j.job_id) AND EXISTS (SELECT 1 FROM extraction_runs r WHERE r.job_id = j.job_id AND r.is_auto_accepted)")
def anti_semi_holdout(spark: SparkSession, d: str) -> DataFrame:
    df = jobs(spark, d, []).select("job_id", "batch_no")
    df = df.join(table(spark, d, "documents", ["job_id"]).where("job_id IS NOT NULL"), "job_id", "left_anti")
    return df.join(table(spark, d, "extraction_runs", ["job_id", "is_auto_accepted"]).where("is_auto_accepted"), "job_id", "left_semi")


_SNAP = "SELECT job_id, field_name, max(value) AS v FROM extracted_fields WHERE {} GROUP BY job_id, field_name"


@query(f"""
SELECT field_name, change, count(*) AS n FROM (
  SELECT coalesce(a.field_name, b.field_name) AS field_name,
    CASE WHEN a.job_id IS NULL THEN 'added' WHEN b.job_id IS NULL THEN 'removed' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'equal' ELSE 'changed' END AS change
  FROM ({_SNAP.format("source <> 'human_corrected' AND selection_reason IS DISTINCT FROM 'rerun'")}) a
  FULL JOIN ({_SNAP.format("source = 'human_corrected' OR selection_reason = 'rerun'")}) b ON a.job_id = b.job_id AND a.field_name = b.field_name) GROUP BY 1, 2""")
def field_corrections_diff(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "extracted_fields", ["job_id", "field_name", "value", "source", "selection_reason"])
    later = (F.col("source") == "human_corrected") | F.col("selection_reason").eqNullSafe("rerun")
    snap = lambda x: x.groupBy("job_id", "field_name").agg(F.max("value").alias("v"))
    return record_diff(snap(f.where(~later)), snap(f.where(later)), ["job_id", "field_name"], "v").groupBy("field_name", "change").agg(F.count("*").alias("n"))


@query("""
SELECT job_id, field_name, reading_id, confidence, runner_up, round(confidence - coalesce(runner_up, 0), 6) AS margin FROM (
  SELECT *, lead(confidence) OVER w AS runner_up, row_number() OVER w AS rn FROM (SELECT DISTINCT reading_id, job_id, field_name, confidence FROM extracted_fields WHERE value IS NOT NULL)
  WINDOW w AS (PARTITION BY job_id, field_name ORDER BY confidence DESC, reading_id)) WHERE rn = 1""")
def margin_to_runner_up(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "extracted_fields", ["reading_id", "job_id", "field_name", "confidence", "value"]).where("value IS NOT NULL").drop("value").distinct()
    return best_with_margin(f, ["job_id", "field_name"], "confidence", [F.col("reading_id")]).select("job_id", "field_name", "reading_id", "confidence", "runner_up", "margin")
