"""Listings, lookups, selections and statistics of jobs and templates, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.evaluation import document_slice
from ledgerloom.functions.money import amount_in_words
from ledgerloom.operators.lifecycle import latest
from ledgerloom.plans.evaluation import _JUDGED, _judged
from ledgerloom.plans.jobs import _JOBS, jobs
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


def by_key(df: DataFrame, key: str, value: object) -> DataFrame:
    """Point lookup: the filter reaches the scan."""
    return df.where(F.col(key) == F.lit(value))


@query("SELECT document_hash, arg_max(run_id, (created_at, run_id)) AS run_id, count(*) AS runs FROM extraction_runs WHERE document_hash IS NOT NULL GROUP BY 1")
def hash_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The newest run of every document hash."""
    r = table(spark, d, "extraction_runs", ["document_hash", "run_id", "created_at"]).where("document_hash IS NOT NULL")
    return r.groupBy("document_hash").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"), F.count("*").alias("runs"))


@query(f"""SELECT job_id, coalesce(status IN ('reviewed', 'done') AND ground_truth_source IN ('human_corrected', 'human_confirmed', 'auto_accepted'), false) AS baseline, coalesce(status IN ('reviewed', 'partially_reviewed', 'completed'), false) AS accuracy,
coalesce(status = 'reviewed' AND ground_truth_source IN ('human_corrected', 'human_confirmed'), false) AS slices, coalesce(status NOT IN ('pending', 'processing', 'failed', 'deleted'), false) AS annotate, coalesce(status <> 'reviewed', false) AS reprocess, row_number() OVER (PARTITION BY status ORDER BY created_at DESC, job_id) AS newest FROM {_JOBS}""")
def job_selections(spark: SparkSession, d: str) -> DataFrame:
    """Which population each job belongs to (three benchmarks, annotation, reprocessing), and its place by age within its status."""
    from ledgerloom.operators.lifecycle import running_rank

    status, truth = F.col("status"), F.col("ground_truth_source")
    no = lambda c: F.coalesce(c, F.lit(False))
    j = jobs(spark, d, ["status", "ground_truth_source", "created_at"])
    # Newest first: the place from the end, so a status with a third of all jobs is ranked by hours.
    counted = j.groupBy("status").agg(F.count("*").alias("n"))
    j = j.withColumn("reverse", -F.unix_micros(F.col("created_at").cast("timestamp"))).withColumn("back", F.timestamp_micros("reverse"))
    ranked = running_rank(j, "status", "back", "job_id", "before").join(F.broadcast(counted), "status")
    return ranked.select(
        "job_id", no(status.isin("reviewed", "done") & truth.isin("human_corrected", "human_confirmed", "auto_accepted")).alias("baseline"), no(status.isin("reviewed", "partially_reviewed", "completed")).alias("accuracy"),
        no((status == "reviewed") & truth.isin("human_corrected", "human_confirmed")).alias("slices"), no(~status.isin("pending", "processing", "failed", "deleted")).alias("annotate"), no(status != "reviewed").alias("reprocess"), (F.col("before") + 1).alias("newest"),
    )


@query(f"""WITH r AS (SELECT job_id, arg_max(decision, (created_at, run_id)) AS decision FROM extraction_runs GROUP BY 1)
SELECT job_id, CASE WHEN status IN ('done', 'reviewed', 'partially_reviewed') THEN 'done' WHEN status = 'failed' THEN 'failed' ELSE coalesce('run:' || decision, 'preprocessing') END AS stage, CASE WHEN status IN ('done', 'reviewed', 'partially_reviewed') THEN 100 WHEN status = 'failed' THEN 0 WHEN decision IS NOT NULL THEN 60 ELSE 15 END AS pct FROM {_JOBS} LEFT JOIN r USING (job_id)""")
def stage_projection(spark: SparkSession, d: str) -> DataFrame:
    """Stage and progress of every job: a final status decides, else what its latest run said, else the first stage."""
    r = table(spark, d, "extraction_runs", ["job_id", "run_id", "decision", "created_at"]).groupBy("job_id").agg(F.max_by("decision", F.struct("created_at", "run_id")).alias("decision"))
    j = jobs(spark, d, ["status"]).join(r, "job_id", "left")
    done = F.col("status").isin("done", "reviewed", "partially_reviewed")
    stage = F.when(done, "done").when(F.col("status") == "failed", "failed").otherwise(F.coalesce(F.concat(F.lit("run:"), "decision"), F.lit("preprocessing")))
    return j.select("job_id", stage.alias("stage"), F.when(done, 100).when(F.col("status") == "failed", 0).when(F.col("decision").isNotNull(), 60).otherwise(15).alias("pct"))


@query(f"""WITH f AS (SELECT template_family_id AS family, count(*) AS samples, min(vendor_gstin) AS gstin FROM {_JOBS} WHERE template_family_id IS NOT NULL GROUP BY 1),
r AS (SELECT template_family_id AS family, field_name, count(*) AS n FROM (SELECT DISTINCT reading_id, template_family_id, field_name FROM extracted_fields WHERE template_family_id IS NOT NULL) GROUP BY 1, 2)
SELECT f.family, samples, gstin, coalesce(k, 0) AS n_rules, coalesce(rules, '') AS rules FROM f LEFT JOIN (SELECT family, count(*) AS k, string_agg(field_name || '=' || n, ',' ORDER BY field_name) AS rules FROM r GROUP BY 1) USING (family)""")
def template_listing(spark: SparkSession, d: str) -> DataFrame:
    """Every family with its samples, vendor and the list of its fields, in one join."""
    f = jobs(spark, d, ["template_family_id", "vendor_gstin"]).where("template_family_id IS NOT NULL").groupBy(F.col("template_family_id").alias("family")).agg(F.count("*").alias("samples"), F.min("vendor_gstin").alias("gstin"))
    x = table(spark, d, "extracted_fields", ["reading_id", "template_family_id", "field_name"]).where("template_family_id IS NOT NULL").distinct()
    r = x.groupBy(F.col("template_family_id").alias("family"), "field_name").agg(F.count("*").alias("n"))
    r = r.groupBy("family").agg(F.count("*").alias("k"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field_name", "n"))), lambda s: F.concat(s["field_name"], F.lit("="), s["n"])), ",").alias("rules"))
    return f.join(r, "family", "left").select("family", "samples", "gstin", F.coalesce("k", F.lit(0)).alias("n_rules"), F.coalesce("rules", F.lit("")).alias("rules"))


@query(f"""SELECT template_family_id AS family, field_name, count(*) AS n, count(*) FILTER (WHERE correct) AS hits, round(count(*) FILTER (WHERE correct) / count(*), 3) AS rate FROM {_JUDGED} JOIN (SELECT job_id, template_family_id FROM {_JOBS}) USING (job_id) WHERE template_family_id IS NOT NULL AND value IS NOT NULL AND value <> '' GROUP BY 1, 2""")
def template_field_stats(spark: SparkSession, d: str) -> DataFrame:
    """Readings of each family's fields and the share that is right; readings that say nothing are left out."""
    j = _judged(spark, d).where("value <> ''").join(jobs(spark, d, ["template_family_id"]).where("template_family_id IS NOT NULL"), "job_id")
    return j.groupBy(F.col("template_family_id").alias("family"), "field_name").agg(F.count("*").alias("n"), F.count_if("correct").alias("hits"), F.round(F.count_if("correct") / F.count("*"), 3).alias("rate"))


@query("SELECT job_id, doc_id, row_number() OVER (PARTITION BY job_id ORDER BY created_at, doc_id) AS pos FROM documents WHERE job_id IS NOT NULL")
def child_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of every job in order."""
    from pyspark.sql import Window

    w = Window.partitionBy("job_id").orderBy("created_at", "doc_id")
    return table(spark, d, "documents", ["job_id", "doc_id", "created_at"]).where("job_id IS NOT NULL").select("job_id", "doc_id", F.row_number().over(w).alias("pos"))


@query(f"SELECT status, CASE WHEN status IN ('pending', 'failed') THEN 'deleted' ELSE status END AS after, count(*) AS n FROM {_JOBS} GROUP BY 1")
def bulk_soft_delete(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of the jobs of each status when pending and failed ones are cleared."""
    return jobs(spark, d, ["status"]).groupBy("status").agg(F.count("*").alias("n")).select("status", F.when(F.col("status").isin("pending", "failed"), "deleted").otherwise(F.col("status")).alias("after"), "n")


@query(f"SELECT template_family_id AS family, list_sort(list_distinct(flatten(list(review_reasons)))) AS reasons FROM {_JOBS} WHERE template_family_id IS NOT NULL AND review_reasons IS NOT NULL GROUP BY 1")
def distinct_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Distinct review reasons of every family, sorted (a set has no order of its own)."""
    j = jobs(spark, d, ["template_family_id", "review_reasons"]).where("template_family_id IS NOT NULL AND review_reasons IS NOT NULL")
    one = j.groupBy(F.col("template_family_id").alias("family"), "review_reasons").agg(F.count("*").alias("n"))
    return one.groupBy("family").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("review_reasons")))).alias("reasons"))


@query("SELECT job_id, count(*) AS n, string_agg(coalesce(description, ''), '|' ORDER BY line_no, description) AS lines FROM (SELECT DISTINCT job_id, line_no, description FROM line_items) GROUP BY 1")
def job_line_items(spark: SparkSession, d: str) -> DataFrame:
    """The line items of every job as one list in order."""
    l = table(spark, d, "line_items", ["job_id", "line_no", "description"]).distinct()  # noqa: E741
    g = l.groupBy("job_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("line_no", "description"))).alias("l"))
    return g.select("job_id", "n", F.array_join(F.transform("l", lambda x: F.coalesce(x["description"], F.lit(""))), "|").alias("lines"))


@query(f"WITH c AS (SELECT count(*) FILTER (WHERE ground_truth_source = 'human_corrected') AS gold, count(*) FILTER (WHERE ground_truth_source = 'human_confirmed') AS silver, count(*) FILTER (WHERE status = 'reviewed') AS reviewed FROM {_JOBS}) SELECT gold, silver, reviewed, greatest(0, gold - 100) AS fresh, greatest(0, gold - 100) >= 20 AS due FROM c")
def retrain_trigger(spark: SparkSession, d: str) -> DataFrame:
    """Corrected, confirmed and reviewed jobs, those new since the last attempt (at 100), and whether they are enough for another."""
    c = jobs(spark, d, ["status", "ground_truth_source"]).agg(F.count_if(F.col("ground_truth_source") == "human_corrected").alias("gold"), F.count_if(F.col("ground_truth_source") == "human_confirmed").alias("silver"), F.count_if(F.col("status") == "reviewed").alias("reviewed"))
    fresh = F.greatest(F.lit(0), F.col("gold") - 100)
    return c.select("gold", "silver", "reviewed", fresh.alias("fresh"), (fresh >= 20).alias("due"))


_ONES = "['One','Two','Three','Four','Five','Six','Seven','Eight','Nine','Ten','Eleven','Twelve','Thirteen','Fourteen','Fifteen','Sixteen','Seventeen','Eighteen','Nineteen']"
_TENS = "['','Twenty','Thirty','Forty','Fifty','Sixty','Seventy','Eighty','Ninety']"
_BELOW = f"CASE WHEN {{n}} >= 100 THEN 'One Hundred' WHEN {{n}} < 20 THEN {_ONES}[CAST({{n}} AS INT)] ELSE {_TENS}[CAST({{n}} // 10 AS INT)] || CASE WHEN {{n}} % 10 > 0 THEN ' ' || {_ONES}[CAST({{n}} % 10 AS INT)] ELSE '' END END"


@query(f"""SELECT job_id, CASE WHEN amount <= 0 OR whole = 0 AND paise = 0 THEN '' ELSE CASE WHEN whole > 0 THEN 'Rupees ' || array_to_string(list_filter([CASE WHEN c > 0 THEN {_BELOW.format(n='c')} || ' Crore' END, CASE WHEN l > 0 THEN {_BELOW.format(n='l')} || ' Lakh' END, CASE WHEN t > 0 THEN {_BELOW.format(n='t')} || ' Thousand' END,
CASE WHEN h > 0 THEN {_BELOW.format(n='h')} || ' Hundred' END, CASE WHEN r > 0 THEN {_BELOW.format(n='r')} END], lambda x: x IS NOT NULL), ' ') ELSE '' END || CASE WHEN paise > 0 THEN CASE WHEN whole > 0 THEN ' and ' ELSE 'Rupees ' END || {_BELOW.format(n='paise')} || ' Paise' ELSE '' END || ' Only' END AS words
FROM (SELECT *, whole // 10000000 AS c, whole // 100000 % 100 AS l, whole // 1000 % 100 AS t, whole // 100 % 10 AS h, whole % 100 AS r FROM (SELECT job_id, grand_total AS amount, CAST(floor(grand_total) AS BIGINT) AS whole, CAST(round_even((grand_total - floor(grand_total)) * 100, 0) AS BIGINT) AS paise FROM {_JOBS} WHERE grand_total IS NOT NULL AND NOT isnan(grand_total)))""")
def cheque_words(spark: SparkSession, d: str) -> DataFrame:
    """Totals in words with rupees and paise."""
    return jobs(spark, d, ["grand_total"]).where("grand_total IS NOT NULL AND NOT isnan(grand_total)").select("job_id", amount_in_words(F.col("grand_total")).alias("words"))


@query("""SELECT doc_id, CASE WHEN contains(n, 'hand') THEN 'handwritten' WHEN contains(n, 'photo') OR contains(n, 'img_') OR contains(n, 'camera') OR regexp_matches(n, '\\.(jpg|jpeg|png|webp)$') THEN 'photo' WHEN contains(n, 'scan') THEN 'scanned' WHEN ends_with(n, '.pdf') THEN 'digital' ELSE 'scanned' END AS slice
FROM (SELECT doc_id, lower(coalesce(source, 'scan') || '_' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.JPG' ELSE '' END) AS n FROM documents)""")
def document_slices(spark: SparkSession, d: str) -> DataFrame:
    """Kind of every document by a file's name made of its channel and id."""
    end = F.when(F.col("doc_id") % 3 == 0, ".pdf").when(F.col("doc_id") % 3 == 1, ".JPG").otherwise("")
    name = F.concat(F.coalesce("source", F.lit("scan")), F.lit("_"), F.col("doc_id"), end)
    return table(spark, d, "documents", ["doc_id", "source"]).select("doc_id", document_slice(name, F.lit(False)).alias("slice"))
