"""Queries on field values: parsing, repair, merging, agreement, accuracy, sums of line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.identifiers import repair_bank_code, repair_phone, repair_tax_number, tax_number_valid
from ledgerloom.functions.money import amount_words, close, parse_amount
from ledgerloom.operators.scoring import SOURCE_WEIGHTS, error_rate, merge_by_weight, pair_agreement, precision_recall
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


_WEIGHT = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SOURCE_WEIGHTS.items()) + " ELSE 0.5 END"
_FIELDS = "(SELECT DISTINCT reading_id, job_id, field_name, value, confidence, source FROM extracted_fields)"


def readings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_fields", ["reading_id", "job_id", "field_name", "value", "confidence", "source"]).distinct()


@query(f"SELECT job_id, field_name, value, source, effective FROM (SELECT *, round(confidence * CAST({_WEIGHT} AS DOUBLE), 6) AS effective, row_number() OVER (PARTITION BY job_id, field_name ORDER BY round(confidence * CAST({_WEIGHT} AS DOUBLE), 6) DESC, reading_id) rn FROM {_FIELDS} WHERE trim(value) <> '') WHERE rn = 1")
def merge_best_source(spark: SparkSession, d: str) -> DataFrame:
    return merge_by_weight(readings(spark, d))


@query(f"WITH o AS (SELECT job_id, field_name, source, min(value) AS value FROM {_FIELDS} WHERE value IS NOT NULL GROUP BY 1, 2, 3) SELECT a.source AS source_a, b.source AS source_b, count(*) AS pairs, count(*) FILTER (WHERE a.value = b.value) AS agreeing FROM o a JOIN o b ON a.job_id = b.job_id AND a.field_name = b.field_name AND a.source < b.source GROUP BY 1, 2")
def engine_agreement(spark: SparkSession, d: str) -> DataFrame:
    return pair_agreement(readings(spark, d))


@query(f"""
WITH t AS (SELECT job_id, max(vendor_gstin) AS truth FROM {_JOBS} WHERE vendor_gstin <> '' GROUP BY 1),
r AS (SELECT source, truth, value FROM {_FIELDS} f JOIN t USING (job_id) WHERE field_name = 'vendor_gstin')
SELECT source, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM (
SELECT source, count(*) FILTER (WHERE value = truth) AS tp, count(*) FILTER (WHERE value IS NOT NULL AND value <> truth) AS fp, count(*) FILTER (WHERE value IS NULL OR value <> truth) AS fn FROM r GROUP BY source)""")
def token_prf1(spark: SparkSession, d: str) -> DataFrame:
    truth = jobs(spark, d, ["vendor_gstin"]).where("vendor_gstin <> ''").select("job_id", F.col("vendor_gstin").alias("truth"))
    r = readings(spark, d).where("field_name = 'vendor_gstin'").join(truth, "job_id")
    return precision_recall(r, ["source"], "truth", "value")


@query(f"""
WITH t AS (SELECT job_id, vendor_name AS truth FROM {_JOBS} WHERE vendor_name <> '')
SELECT source, count(*) AS n, round(avg(least(1.0, levenshtein(value, truth) / length(truth))), 6) AS mean_cer FROM {_FIELDS} f JOIN t USING (job_id) WHERE field_name = 'vendor_name' AND value <> '' GROUP BY source""")
def cer_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    truth = jobs(spark, d, ["vendor_name"]).where("vendor_name <> ''").select("job_id", F.col("vendor_name").alias("truth"))
    r = readings(spark, d).where("field_name = 'vendor_name' AND value <> ''").join(truth, "job_id")
    return r.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(error_rate(F.col("value"), F.col("truth"))), 6).alias("mean_cer"))


@query(f"SELECT field_name, source, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (WHERE value IS NULL OR value = '') AS missing FROM {_FIELDS} GROUP BY GROUPING SETS ((field_name), (source), ())")
def accuracy_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    r = readings(spark, d)
    r.createOrReplaceTempView("_readings")
    return spark.sql("SELECT field_name, source, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, count_if(value IS NULL OR value = '') AS missing FROM _readings GROUP BY GROUPING SETS ((field_name), (source), ())")


@query(f"SELECT reading_id, value, CASE WHEN contains(value, '%') THEN NULL WHEN regexp_matches(regexp_replace(value, '(?i)rs\\.?|inr|₹|,|\\s', '', 'g'), '^\\(.*\\)$') THEN -abs(try_cast(nullif(regexp_extract(regexp_replace(value, '(?i)rs\\.?|inr|₹|,|\\s', '', 'g'), '(-?\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE)) ELSE try_cast(nullif(regexp_extract(regexp_replace(value, '(?i)rs\\.?|inr|₹|,|\\s', '', 'g'), '(-?\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) END AS amount FROM {_FIELDS} WHERE field_name = 'grand_total' AND value IS NOT NULL")
def currency_parse(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).where("field_name = 'grand_total' AND value IS NOT NULL").select("reading_id", "value", parse_amount(F.col("value")).alias("amount"))


def _words_sql(n: str) -> str:
    from ledgerloom.functions.money import ONES, TENS

    ones, tens = "[" + ", ".join(f"'{x}'" for x in ONES) + "]", "[" + ", ".join(f"'{x}'" for x in TENS) + "]"
    two = lambda e: f"(CASE WHEN {e} < 20 THEN {ones}[{e} + 1] ELSE trim({tens}[{e} // 10 + 1] || ' ' || {ones}[{e} % 10 + 1]) END)"
    crore, lakh, thousand, hundred = f"({n} // 10000000 % 100)", f"({n} // 100000 % 100)", f"({n} // 1000 % 100)", f"({n} // 100 % 10)"
    part = lambda e, name: f"CASE WHEN {e} > 0 THEN {two(e)} || '{name}' END"
    return f"concat_ws(' ', {part(crore, ' Crore')}, {part(lakh, ' Lakh')}, {part(thousand, ' Thousand')}, {part(hundred, ' Hundred')}, CASE WHEN {n} % 100 > 0 THEN {two(f'({n} % 100)')} END)"


@query(f"SELECT job_id, CASE WHEN n >= 1 THEN {_words_sql('n')} ELSE '' END AS words FROM (SELECT job_id, CAST(floor(grand_total) AS BIGINT) AS n FROM {_JOBS} WHERE grand_total IS NOT NULL AND NOT isnan(grand_total))")
def amount_to_words(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d, ["grand_total"]).where("grand_total IS NOT NULL AND NOT isnan(grand_total)").select("job_id", amount_words(F.col("grand_total")).alias("words"))


_CODE = "upper(regexp_replace(vendor_gstin, '\\s', '', 'g'))"
_ALPHA = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'"


@query(f"""
SELECT job_id, vendor_gstin, CASE WHEN regexp_full_match({_CODE}, '[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][0-9A-Z]Z[0-9A-Z]') THEN
  substr({_ALPHA}, CAST((36 - list_sum(list_transform(range(14), lambda i: ((instr({_ALPHA}, substr({_CODE}, CAST(i + 1 AS INT), 1)) - 1) * (i % 2 + 1)) // 36 + ((instr({_ALPHA}, substr({_CODE}, CAST(i + 1 AS INT), 1)) - 1) * (i % 2 + 1)) % 36)) % 36) % 36 + 1 AS INT), 1) = substr({_CODE}, 15, 1)
  ELSE FALSE END AS valid FROM {_JOBS} WHERE vendor_gstin IS NOT NULL""")
def tax_number_checksum(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d, ["vendor_gstin"]).where("vendor_gstin IS NOT NULL").select("job_id", "vendor_gstin", tax_number_valid(F.col("vendor_gstin")).alias("valid"))


_G = "upper(regexp_replace(value, '[^0-9A-Za-z]', '', 'g'))"
_GFIX = f"translate(substr({_G}, 1, 2), 'OQDILZSBG', '000112586') || translate(substr({_G}, 3, 5), '0125689', 'OIZSGBG') || translate(substr({_G}, 8, 4), 'OQDILZSBG', '000112586') || translate(substr({_G}, 12, 1), '0125689', 'OIZSGBG') || substr({_G}, 13, 1) || translate(translate(substr({_G}, 14, 1), '2', 'Z'), '0125689', 'OIZSGBG') || substr({_G}, 15, 1)"


@query(f"SELECT reading_id, value, CASE WHEN length({_G}) = 15 AND regexp_full_match({_GFIX}, '[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][0-9A-Z]Z[0-9A-Z]') THEN {_GFIX} END AS repaired FROM {_FIELDS} WHERE field_name = 'vendor_gstin' AND value IS NOT NULL")
def tax_number_repair(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).where("field_name = 'vendor_gstin' AND value IS NOT NULL").select("reading_id", "value", repair_tax_number(F.col("value")).alias("repaired"))


_B = "upper(regexp_replace(ifsc_code, '[^0-9A-Za-z]', '', 'g'))"
_BFIX = f"translate(substr({_B}, 1, 4), '0158', 'OISB') || '0' || translate(substr({_B}, 6, 6), 'O', '0')"


@query(f"SELECT job_id, ifsc_code, CASE WHEN length({_B}) = 11 AND regexp_full_match({_BFIX}, '[A-Z]{{4}}0[A-Z0-9]{{6}}') THEN {_BFIX} END AS repaired FROM {_JOBS} WHERE ifsc_code IS NOT NULL")
def bank_code_repair(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d, ["ifsc_code"]).where("ifsc_code IS NOT NULL").select("job_id", "ifsc_code", repair_bank_code(F.col("ifsc_code")).alias("repaired"))


@query(f"SELECT job_id, vendor_phone, CASE WHEN length(p) >= 10 THEN right(p, 10) END AS repaired FROM (SELECT job_id, vendor_phone, regexp_replace(translate(upper(regexp_replace(vendor_phone, '^\\s*\\+?91[-\\s]', '')), 'OQDILZSBG', '000112586'), '[^0-9]', '', 'g') AS p FROM {_JOBS} WHERE vendor_phone IS NOT NULL)")
def phone_repair(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d, ["vendor_phone"]).where("vendor_phone IS NOT NULL").select("job_id", "vendor_phone", repair_phone(F.col("vendor_phone")).alias("repaired"))


_LINES = "(SELECT DISTINCT * FROM line_items)"


@query(f"""
WITH s AS (SELECT job_id, round(sum(amount), 2) AS line_sum, count(*) AS n_lines FROM {_LINES} GROUP BY 1)
SELECT j.job_id, j.subtotal, s.line_sum, s.n_lines, abs(s.line_sum - j.subtotal) <= greatest(1.5, abs(s.line_sum) * 0.015) AS consistent FROM {_JOBS} j LEFT JOIN s ON j.job_id = s.job_id""")
def line_item_sums(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "line_items").distinct().groupBy("job_id").agg(F.round(F.sum("amount"), 2).alias("line_sum"), F.count("*").alias("n_lines"))
    df = jobs(spark, d, ["subtotal"]).select("job_id", "subtotal").join(lines, "job_id", "left")
    return df.select("job_id", "subtotal", "line_sum", "n_lines", close(F.col("line_sum"), F.col("subtotal"), 1.5, 0.015).alias("consistent"))


@query(f"""
WITH l AS (SELECT job_id, line_no, description, coalesce(amount, 0) AS amount, coalesce(cgst_rate, 0) + coalesce(sgst_rate, 0) + coalesce(igst_rate, 0) AS rate FROM {_LINES}),
x AS (SELECT l.*, j.discount, CAST(sum(CAST(amount AS DECIMAL(18, 4))) OVER (PARTITION BY l.job_id) AS DOUBLE) AS gross FROM l JOIN (SELECT job_id, coalesce(CASE WHEN isnan(discount) THEN NULL ELSE discount END, 0) AS discount FROM {_JOBS}) j ON l.job_id = j.job_id)
SELECT job_id, CAST(round(sum(CAST(amount AS DECIMAL(18, 4))), 2) AS DOUBLE) AS gross, CAST(round(sum(CAST(round(CASE WHEN gross > 0 THEN discount * amount / gross ELSE 0 END, 4) AS DECIMAL(18, 4))), 2) AS DOUBLE) AS discount, CAST(round(sum(CAST(round((amount - CASE WHEN gross > 0 THEN discount * amount / gross ELSE 0 END) * rate / 100, 4) AS DECIMAL(18, 4))), 2) AS DOUBLE) AS tax FROM x GROUP BY job_id""")
def recalculate_totals(spark: SparkSession, d: str) -> DataFrame:
    """A discount on the whole invoice is apportioned to the lines by amount before tax is taken."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    lines = table(spark, d, "line_items").distinct().select("job_id", n("amount").alias("amount"), (n("cgst_rate") + n("sgst_rate") + n("igst_rate")).alias("rate"))
    disc = jobs(spark, d, ["discount"]).select("job_id", F.coalesce(F.nanvl("discount", F.lit(None).cast("double")), F.lit(0.0)).alias("discount"))
    exact = lambda c: F.round(c, 4).cast("decimal(18,4)")  # noqa: E731  sums do not depend on the order of rows
    x = lines.join(disc, "job_id").withColumn("gross", F.sum(exact(F.col("amount"))).over(Window.partitionBy("job_id")).cast("double"))
    share = F.when(F.col("gross") > 0, F.col("discount") * F.col("amount") / F.col("gross")).otherwise(0.0)
    total = lambda c: F.round(F.sum(exact(c)), 2).cast("double")
    return x.groupBy("job_id").agg(total(F.col("amount")).alias("gross"), total(share).alias("discount"), total((F.col("amount") - share) * F.col("rate") / 100).alias("tax"))


_C = "SELECT job_id, field_name, reading_id, value, 0 AS ord, confidence, source FROM {} WHERE trim(value) <> ''"


@query("""
WITH f AS (SELECT DISTINCT reading_id, job_id, field_name, value, confidence, source, candidates FROM extracted_fields),
c AS (SELECT job_id, field_name, reading_id, unnest(candidates) AS x, generate_subscripts(candidates, 1) AS ord FROM f),
a AS (SELECT job_id, field_name, reading_id, 0 AS ord, value AS text, confidence FROM f WHERE trim(value) <> '' UNION ALL SELECT job_id, field_name, reading_id, ord, x.text, x.confidence FROM c WHERE trim(x.text) <> ''),
k AS (SELECT *, lower(trim(text)) AS norm FROM a),
b AS (SELECT job_id, field_name, norm, round(max(confidence), 6) AS best, count(*) AS votes, arg_min(text, struct_pack(a := reading_id, b := ord)) AS text FROM k GROUP BY 1, 2, 3)
SELECT job_id, field_name, text, best, votes FROM (SELECT *, row_number() OVER (PARTITION BY job_id, field_name ORDER BY round(best + 0.05 * (votes - 1), 6) DESC, norm) rn FROM b) WHERE rn = 1""")
def candidate_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Values and candidates of a field, deduplicated without regard to case, ranked by confidence and repetition."""
    f = table(spark, d, "extracted_fields", ["reading_id", "job_id", "field_name", "value", "confidence", "source", "candidates"]).distinct()
    own = F.array(F.struct(F.lit(0).alias("ord"), F.col("value").alias("text"), F.col("confidence").alias("confidence")))
    rest = F.transform(F.coalesce("candidates", F.array()), lambda x, i: F.struct((i + 1).alias("ord"), x["text"].alias("text"), x["confidence"].alias("confidence")))
    a = f.select("job_id", "field_name", "reading_id", F.inline(F.concat(own, rest))).where(F.trim("text") != "").withColumn("norm", F.lower(F.trim("text")))
    b = a.groupBy("job_id", "field_name", "norm").agg(F.round(F.max("confidence"), 6).alias("best"), F.count("*").alias("votes"), F.min_by("text", F.struct("reading_id", "ord")).alias("text"))
    w = Window.partitionBy("job_id", "field_name").orderBy(F.round(F.col("best") + 0.05 * (F.col("votes") - 1), 6).desc(), "norm")
    return b.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("job_id", "field_name", "text", "best", "votes")
