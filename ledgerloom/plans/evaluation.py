"""Queries on accuracy, margins, arithmetic and evidence, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import evaluation
from ledgerloom.plans.cleaning import _amount, _close
from ledgerloom.plans.jobs import _JOBS, jobs
from ledgerloom.plans.layout import _TOKENS, tokens
from ledgerloom.plans.values import _FIELDS, readings
from ledgerloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

FIELDS = ["vendor_name", "buyer_name", "invoice_number", "invoice_date", "place_of_supply", "bank_name", "vendor_gstin", "grand_total"]


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_TRUTH = "(SELECT * FROM (" + " UNION ALL ".join(f"SELECT job_id, '{f}' AS field_name, {'printf(chr(37) || chr(46) || chr(50) || chr(102), grand_total)' if f == 'grand_total' else f} AS truth FROM {_JOBS} WHERE {f} IS NOT NULL" for f in FIELDS) + ") WHERE trim(truth, ' ') <> '')"
_KEY = "coalesce(translate(lower(trim({c}, ' ')), ', -/', ''), '')"
_SLICES = "(SELECT job_id, coalesce(arg_max(routing_decision, (created_at, run_id)), 'unrouted') AS slice FROM extraction_runs GROUP BY 1)"
_JUDGED = f"""(SELECT r.*, truth, slice, CASE WHEN r.field_name = 'grand_total' THEN r.value IS NOT NULL AND coalesce({_close(_amount('r.value'), _amount('truth'), 0.5, 0.01)}, false) ELSE {_KEY.format(c='r.value')} = {_KEY.format(c='truth')} END AS correct
FROM {_FIELDS} r JOIN {_TRUTH} t ON r.job_id = t.job_id AND r.field_name = t.field_name JOIN {_SLICES} s ON r.job_id = s.job_id)"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    truth = evaluation.long_truth(jobs(spark, d, FIELDS), FIELDS)
    runs = table(spark, d, "extraction_runs", ["job_id", "run_id", "routing_decision", "created_at"])
    slices = runs.where("routing_decision IS NOT NULL").groupBy("job_id").agg(F.max_by("routing_decision", F.struct("created_at", "run_id")).alias("slice"))
    slices = runs.select("job_id").distinct().join(slices, "job_id", "left").na.fill("unrouted", ["slice"])
    return evaluation.judged(readings(spark, d), truth).join(slices, "job_id")


@query(f"""WITH j AS {_JUDGED}, g AS (SELECT 'field_name' AS grouped_by, field_name AS value_of, correct FROM j UNION ALL SELECT 'slice', slice, correct FROM j UNION ALL SELECT 'source', source, correct FROM j UNION ALL SELECT 'all', NULL, correct FROM j)
SELECT grouped_by, value_of, count(*) AS n, count(*) FILTER (WHERE correct) AS hits, round(count(*) FILTER (WHERE correct) / count(*), 6) AS accuracy FROM g GROUP BY 1, 2""")
def accuracy_report(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of all readings against the recorded values: per field, per slice (the route of the latest run that has one), per source and over all."""
    return evaluation.scorecard(_judged(spark, d), ["field_name", "slice", "source"])


@query(f"""WITH j AS {_JUDGED} SELECT slice, count(DISTINCT job_id) AS jobs, round(count(*) FILTER (WHERE correct) / count(*), 6) AS accuracy, round(coalesce(count(*) FILTER (WHERE correct AND field_name IN ('invoice_number', 'vendor_gstin', 'grand_total')) / nullif(count(*) FILTER (WHERE field_name IN ('invoice_number', 'vendor_gstin', 'grand_total')), 0), 0), 6) AS critical_accuracy FROM j GROUP BY 1""")
def slice_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy over all fields and over the critical ones, per slice."""
    critical = F.col("field_name").isin("invoice_number", "vendor_gstin", "grand_total")
    share = F.coalesce(F.try_divide(F.count_if(F.col("correct") & critical), F.count_if(critical)), F.lit(0.0))
    return _judged(spark, d).groupBy("slice").agg(F.countDistinct("job_id").alias("jobs"), F.round(F.count_if("correct") / F.count("*"), 6).alias("accuracy"), F.round(share, 6).alias("critical_accuracy"))


@query(f"""SELECT source, count(*) AS tokens, round(count(*) FILTER (WHERE correct) / count(*), 6) AS accuracy, round(coalesce(count(*) FILTER (WHERE correct AND value IS NOT NULL AND value <> '') / nullif(count(*) FILTER (WHERE value IS NOT NULL AND value <> ''), 0), 0), 6) AS accuracy_filled FROM {_JUDGED} GROUP BY 1""")
def token_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Share of right labels, over all and over those that say something, per source."""
    says = F.col("value").isNotNull() & (F.col("value") != "")
    share = F.coalesce(F.try_divide(F.count_if(F.col("correct") & says), F.count_if(says)), F.lit(0.0))
    return _judged(spark, d).groupBy("source").agg(F.count("*").alias("tokens"), F.round(F.count_if("correct") / F.count("*"), 6).alias("accuracy"), F.round(share, 6).alias("accuracy_filled"))


@query(f"""WITH f AS (SELECT template_family_id AS family, j.job_id FROM {_JOBS} j WHERE template_family_id IS NOT NULL), s AS (SELECT job_id, count(*) AS n, count(*) FILTER (WHERE source = 'llm') AS ai FROM {_FIELDS} GROUP BY 1)
SELECT count(DISTINCT family) AS families, count(*) AS jobs, round(count(*) / count(DISTINCT family), 6) AS per_family, round(count(*) FILTER (WHERE coalesce(ai, 0) = 0) / count(*), 6) AS without_ai FROM f LEFT JOIN s USING (job_id)""")
def replay_report(spark: SparkSession, d: str) -> DataFrame:
    """Template families, jobs in a family on average, and the share of jobs of which no reading is a language model's."""
    f = jobs(spark, d, ["template_family_id"]).where("template_family_id IS NOT NULL")
    s = readings(spark, d).groupBy("job_id").agg(F.count_if(F.col("source") == "llm").alias("ai"))
    n = F.countDistinct("template_family_id")
    return f.join(s, "job_id", "left").agg(n.alias("families"), F.count("*").alias("jobs"), F.round(F.count("*") / n, 6).alias("per_family"), F.round(F.count_if(F.coalesce("ai", F.lit(0)) == 0) / F.count("*"), 6).alias("without_ai"))


@query(f"""WITH w AS (SELECT *, row_number() OVER o AS rn, lead(value) OVER o AS nv, lead(confidence) OVER o AS nc FROM {_FIELDS} WHERE confidence IS NOT NULL AND value IS NOT NULL WINDOW o AS (PARTITION BY job_id, field_name ORDER BY confidence DESC, reading_id)),
m AS (SELECT *, greatest(0.0, confidence - nc) AS margin, field_name = 'grand_total' AS amount FROM w WHERE rn = 1)
SELECT job_id, field_name, value, round(confidence * CASE WHEN coalesce(margin < 0.20 AND CASE WHEN amount THEN coalesce(abs({_amount('value')} - {_amount('nv')}) > 0.05, false) ELSE upper(value) <> upper(nv) END, false) THEN CASE WHEN amount THEN 0.65 + 1.75 * margin ELSE 0.70 + 1.5 * margin END ELSE 1.0 END + 1e-9, 4) AS calibrated FROM m""")
def margin_penalty(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.with_margin_penalty(readings(spark, d).where("confidence IS NOT NULL AND value IS NOT NULL"))


@query(f"""WITH r AS (SELECT job_id, list(x ORDER BY reading_id) AS totals FROM (SELECT job_id, reading_id, {_amount('value')} AS x FROM {_FIELDS} WHERE field_name = 'grand_total') WHERE x IS NOT NULL GROUP BY 1),
c AS (SELECT job_id, list_filter([subtotal], lambda v: v IS NOT NULL) AS subs, list_filter([tax_amount, cgst + sgst, igst], lambda v: v IS NOT NULL) AS taxes, list_concat(list_filter([grand_total], lambda v: v IS NOT NULL), coalesce(totals, [])) AS totals FROM {_JOBS} LEFT JOIN r USING (job_id)),
e AS (SELECT job_id, s.i, s.v AS subtotal, t.i AS j, t.v AS tax, g.i AS k, g.v AS total FROM (SELECT job_id, subs, CASE WHEN len(taxes) > 0 THEN taxes ELSE [0.0] END AS taxes, totals FROM c) q, LATERAL (SELECT unnest(subs) AS v, generate_subscripts(subs, 1) AS i) s, LATERAL (SELECT unnest(taxes) AS v, generate_subscripts(taxes, 1) AS i) t, LATERAL (SELECT unnest(totals) AS v, generate_subscripts(totals, 1) AS i) g)
SELECT job_id, subtotal, tax, total FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY i, j, k) AS rn FROM e WHERE abs(subtotal + tax - total) <= 0.05 AND total > 0) WHERE rn = 1""")
def accounting_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    """The first subtotal, tax and total among recorded and read candidates that add up."""
    from ledgerloom.functions.cleaning import clean_amount

    r = readings(spark, d).where("field_name = 'grand_total'").select("job_id", "reading_id", clean_amount(F.col("value")).alias("x")).where("x IS NOT NULL")
    totals = r.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("reading_id", "x"))).alias("t")).select("job_id", F.col("t.x").alias("read"))
    j = jobs(spark, d, ["subtotal", "tax_amount", "cgst", "sgst", "igst", "grand_total"]).join(totals, "job_id", "left")
    taxes = F.array_compact(F.array("tax_amount", F.col("cgst") + F.col("sgst"), "igst"))
    return evaluation.accounting_triples(j.select("job_id", F.array_compact(F.array("subtotal")).alias("subs"), taxes.alias("taxes"), F.concat(F.array_compact(F.array("grand_total")), F.coalesce("read", F.array().cast("array<double>"))).alias("totals")))


@query(f"""SELECT label, count(*) AS present, count(*) FILTER (WHERE contains(t, v)) AS matched, round(count(*) FILTER (WHERE contains(t, v)) / count(*), 6) AS share FROM (SELECT field_name AS label, regexp_replace(lower(truth), '[^a-z0-9]', '', 'g') AS v, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS t FROM {_TRUTH} JOIN documents USING (job_id) WHERE text IS NOT NULL) WHERE v <> '' GROUP BY 1""")
def alignment_stats(spark: SparkSession, d: str) -> DataFrame:
    """Recorded values that stand in the texts of their job's documents, per field."""
    docs = table(spark, d, "documents", ["doc_id", "job_id", "text"]).where("job_id IS NOT NULL AND text IS NOT NULL")
    labels = evaluation.long_truth(jobs(spark, d, FIELDS), FIELDS).join(docs.select("job_id", "doc_id"), "job_id").select("doc_id", F.col("field_name").alias("label"), F.col("truth").alias("value"))
    return evaluation.alignment(labels, docs.select("doc_id", "text"))


@query(f"""SELECT doc_id, job_id, arg_min(seq, seq) AS seq, arg_min(text, seq) AS token FROM (SELECT t.doc_id, d.job_id, seq, t.text FROM {_TOKENS} t JOIN (SELECT doc_id, job_id FROM documents) d USING (doc_id) JOIN (SELECT job_id, invoice_number FROM {_JOBS} WHERE invoice_number IS NOT NULL AND trim(invoice_number, ' ') <> '') j USING (job_id) WHERE contains(lower(t.text), lower(trim(invoice_number, ' ')))) GROUP BY 1, 2""")
def value_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The first token of a document that holds its job's invoice number."""
    docs = table(spark, d, "documents", ["doc_id", "job_id"]).where("job_id IS NOT NULL")
    j = jobs(spark, d, ["invoice_number"]).where("trim(invoice_number) <> ''").select("job_id", F.lower(F.trim("invoice_number")).alias("v"))
    t = tokens(spark, d).select("doc_id", "seq", "text").join(docs.join(j, "job_id"), "doc_id").where(F.lower("text").contains(F.col("v")))
    return t.groupBy("doc_id", "job_id").agg(F.min("seq").alias("seq"), F.min_by("text", "seq").alias("token"))


@query()
def word_errors(spark: SparkSession, d: str) -> DataFrame:
    """Word error rate of readings of names, per source (words are compared one by one, which SQL has not)."""
    r = _judged(spark, d).where("field_name IN ('vendor_name', 'buyer_name') AND value IS NOT NULL")
    return r.select("source", evaluation.word_error_rate(F.lower("value"), F.lower("truth")).alias("e")).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("e"), 6).alias("mean_wer"))
