"""Queries on typed and scanned text: cleaning, repair, comparison, items and labelled values in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.functions.money import amount_words
from ledgerloom.operators import extraction
from ledgerloom.plans.jobs import _JOBS, jobs
from ledgerloom.plans.values import _FIELDS, readings
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


_KEY = "lower(regexp_replace({}, '[^A-Za-z0-9]', '', 'g'))"


@query(f"SELECT field_name, {_KEY.format('value')} AS norm, count(*) AS n, count(DISTINCT value) AS spellings FROM {_FIELDS} WHERE trim(value) <> '' GROUP BY 1, 2")
def text_normalise_match(spark: SparkSession, d: str) -> DataFrame:
    r = readings(spark, d).where("trim(value) <> ''")
    return r.groupBy("field_name", text.alnum_key(F.col("value")).alias("norm")).agg(F.count("*").alias("n"), F.countDistinct("value").alias("spellings"))


@query(f"SELECT job_id, invoice_number, nullif(regexp_extract(regexp_replace(trim(invoice_number, ' '), '(?i)^(?:invoice|inv|bill|no|number)[\\s.:#]+', ''), '(\\S{{2,}})', 1), '') AS cleaned FROM {_JOBS} WHERE invoice_number IS NOT NULL")
def number_clean(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d, ["invoice_number"]).where("invoice_number IS NOT NULL").select("job_id", "invoice_number", text.clean_number(F.col("invoice_number")).alias("cleaned"))


@query(f"SELECT job_id, vendor_name, trim(regexp_replace(regexp_replace(regexp_replace(trim(vendor_name, ' '), '(?i)^(?:m/s\\.?|messrs\\.?|name\\s*:|to\\s*:)\\s*', ''), '[ \\t]+', ' ', 'g'), '[,;:.]+$', '', 'g'), ' ') AS cleaned FROM {_JOBS} WHERE vendor_name IS NOT NULL")
def name_clean(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d, ["vendor_name"]).where("vendor_name IS NOT NULL").select("job_id", "vendor_name", text.clean_name(F.col("vendor_name")).alias("cleaned"))


_N = "regexp_replace(value, '(?i)rs\\.?|inr|₹|,|\\s', '', 'g')"
_D = f"translate(upper({_N}), 'OQDILZSBG', '000112586')"


_NUM = "CASE WHEN regexp_matches({x}, '^[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN try_cast({x} AS DOUBLE) END"


@query(f"SELECT reading_id, value, coalesce(p, f) AS amount, round(CASE WHEN p IS NOT NULL THEN 0.95 WHEN f IS NOT NULL THEN greatest(0.5, 0.9 - 0.1 * length(regexp_replace({_N}, '[0-9.\\-]', '', 'g'))) END, 6) AS conf FROM (SELECT *, {_NUM.format(x=_N)} AS p, {_NUM.format(x=_D)} AS f FROM {_FIELDS} WHERE value IS NOT NULL)")
def numeric_correct(spark: SparkSession, d: str) -> DataFrame:
    """Every reading as a number, as it stands or with confused letters read as digits."""
    r = readings(spark, d).where("value IS NOT NULL")
    return r.select("reading_id", "value", text.numeric_candidates(F.col("value")).alias("c")).select("reading_id", "value", F.col("c.value").alias("amount"), F.round("c.conf", 6).alias("conf"))


_T = "translate(upper(translate(trim(value, ' '), '.-', '//')), 'OQDILZSBG', '000112586')"
_P = "try_cast(string_split({t}, '/')[{i}] AS INT)"


@query(f"""SELECT reading_id, value, CASE WHEN n = 3 AND m BETWEEN 1 AND 12 AND d BETWEEN 1 AND (CASE WHEN m IN (4, 6, 9, 11) THEN 30 WHEN m = 2 THEN CASE WHEN y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0) THEN 29 ELSE 28 END ELSE 31 END) AND y BETWEEN 1900 AND 2199
THEN printf('%02d/%02d/%04d', d, m, y) END AS repaired FROM (SELECT reading_id, value, len(string_split({_T}, '/')) AS n, {_P.format(t=_T, i=1)} AS d, {_P.format(t=_T, i=2)} AS m, CASE WHEN {_P.format(t=_T, i=3)} < 100 THEN {_P.format(t=_T, i=3)} + 2000 ELSE {_P.format(t=_T, i=3)} END AS y FROM {_FIELDS} WHERE field_name = 'invoice_date' AND value IS NOT NULL)""")
def date_correct(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).where("field_name = 'invoice_date' AND value IS NOT NULL").select("reading_id", "value", text.date_repair(F.col("value")).alias("repaired"))


@query(f"SELECT job_id, CASE WHEN grand_total >= 1 THEN CAST(floor(grand_total) AS BIGINT) END AS amount FROM {_JOBS} WHERE grand_total IS NOT NULL AND NOT isnan(grand_total)")
def words_to_amount(spark: SparkSession, d: str) -> DataFrame:
    """Amounts into words and back."""
    df = jobs(spark, d, ["grand_total"]).where("grand_total IS NOT NULL AND NOT isnan(grand_total)")
    return df.select("job_id", text.words_amount(amount_words(F.col("grand_total"))).alias("amount"))


@query()
def fuzzy_ratio_match(spark: SparkSession, d: str) -> DataFrame:
    """Readings of a vendor's name against the recorded one: longest-blocks ratio, which SQL has not."""
    truth = jobs(spark, d, ["vendor_name"]).where("vendor_name <> ''").select("job_id", F.col("vendor_name").alias("recorded"))
    r = readings(spark, d).where("field_name = 'vendor_name' AND value <> ''").join(truth, "job_id")
    return r.select("reading_id", F.round(text.sequence_ratio(F.col("value"), F.col("recorded")), 6).alias("ratio"), text.fuzzy_equal(F.col("value"), F.col("recorded")).alias("same"))


_ITEM = extraction.ITEM.replace("'", "''")
_TEXT_LINES = "(SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"


@query(f"SELECT doc_id, line_no, try_cast(regexp_extract(line, '{_ITEM}', 1) AS INT) AS pos, trim(regexp_extract(line, '{_ITEM}', 2), ' ') AS description, CAST(regexp_extract(line, '{_ITEM}', 3) AS DOUBLE) AS quantity, CAST(regexp_extract(line, '{_ITEM}', 4) AS DOUBLE) AS rate, CAST(regexp_extract(line, '{_ITEM}', 5) AS DOUBLE) AS amount FROM {_TEXT_LINES} WHERE regexp_matches(line, '{_ITEM}')")
def document_line_items(spark: SparkSession, d: str) -> DataFrame:
    return extraction.line_items(extraction.text_lines(table(spark, d, "documents", ["doc_id", "text"])))


LABELS = {"invoice_number": "invoice no", "date": "date", "total": "total"}
_VALUE = r"([0-9A-Za-z][0-9A-Za-z/.\-]*)"


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT doc_id, line_no, '{f}' AS field, nullif(regexp_extract(line, '(?i){p}[^0-9A-Za-z]*{_VALUE}', 1), '') AS value FROM {_TEXT_LINES}" for f, p in LABELS.items()) + ") SELECT doc_id, field, value, line_no, n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, field) AS n, row_number() OVER (PARTITION BY doc_id, field ORDER BY line_no, value) AS rn FROM c WHERE value IS NOT NULL) WHERE rn = 1")
def labelled_values(spark: SparkSession, d: str) -> DataFrame:
    lines = extraction.text_lines(table(spark, d, "documents", ["doc_id", "text"]))
    return extraction.best_labelled(extraction.labelled_values(lines, LABELS, _VALUE)).select("doc_id", "field", "value", "line_no", "n")
