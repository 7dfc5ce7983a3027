"""Queries on cleaned field texts, comparisons and boxes, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import boxes, cleaning
from ledgerloom.plans.jobs import _JOBS, jobs
from ledgerloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

_R = "(SELECT DISTINCT reading_id, job_id, field_name, value FROM extracted_fields)"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_fields", ["reading_id", "job_id", "field_name", "value"]).distinct()


def _line(c: str) -> str:
    return f"coalesce(list_filter(list_transform(string_split({c}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[1], {c})"


def _vendor(c: str) -> str:
    s = rf"regexp_replace(regexp_replace({_line(c)}, '(?i)^(?:retail|tax|tax invoice|invoice|bill of supply|original for recipient|cash memo)\s*', ''), '^[:\s\-#*]+', '')"
    return rf"trim(regexp_replace({s}, '(?i)\s+(?:plot\s*no|sector|road|street|sarani|lane|nagar|opp|near|floor|building|behind|kolkata|mumbai|delhi|bengaluru|west bengal|pin|ph|phone|gstin|email|cin|\d+/\d+)\b.*$', ''), ':.,- ')"


def _buyer(c: str) -> str:
    line = rf"coalesce(list_filter(list_transform(string_split({c}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(?:bill\s*to|billed\s*to|buyer|consignee|customer)[:\s]*$'))[1], {c})"
    s = rf"regexp_replace(regexp_replace({line}, '(?i)^(?:bill\s*to|billed\s*to|buyer|consignee|customer|m/s|mr\.|ms\.|sri|smt)?\s*(?:name)?\s*[:.\-]?\s*', ''), '^[:\s\-#*]+', '')"
    return rf"trim(regexp_replace({s}, '(?i)\s+(?:invoice\s*no|invoice\s*date|sls\s*code|due\s*date|place\s*of\s*supply|category|sub\s*category|phone|mobile|gstin|pan|order|address|kolkata|mumbai|delhi)\b.*$', ''), ':.,- ')"


def _place(c: str) -> str:
    s = rf"trim(regexp_replace({_line(c)}, '(?i)^(?:place\s*of\s*supply|state/ut\s*code|pos|state\s*code|supply\s*state)\s*[:.\-]?\s*', ''), ':.,- ')"
    return rf"trim(regexp_replace({s}, '(?i)\s+(?:category|sub\s*category|phone|mobile|buyer|invoice|due|sls|ftoagency|\(sch\d+\))\b.*$', ''), ':.,- ')"


def _number(c: str) -> str:
    s = rf"regexp_replace(regexp_replace({c}, '(?i)^(?:invoice|inv|bill|voucher|challan)\s*(?:no\.?|#|num|number)?\s*[:.\-]?\s*', ''), '^[:\s\-#]+', '')"
    s = rf"regexp_replace({s}, '\s+(?:\d{{1,2}}[-/.](?:\d{{1,2}}|[A-Za-z]{{3}})[-/.]\d{{2,4}}|\d{{4}}[-/.]).*$', '')"
    s = rf"regexp_replace({s}, '(?i)\s+(?:date|dated|due|gstin|pan|po|place|to|bill|amount|total|customer|e-com|order|generated|cashier|name|phone|mobile)\b.*$', '')"
    first = rf"list_filter(list_transform(regexp_split_to_array({s}, '\s+'), lambda x: trim(x, ':.,- ')), lambda x: x <> '')[1]"
    return rf"CASE WHEN length({first}) >= 2 AND regexp_matches({first}, '[\p{{L}}\p{{N}}]') THEN {first} ELSE trim({s}, ':.,- ') END"


_MONTH = "CASE lower(substr(regexp_extract({c}, '{p}', 2), 1, 3)) " + " ".join(f"WHEN '{m}' THEN '{i:02d}'" for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)) + " ELSE '01' END"


def _date(c: str) -> str:
    p = r"\b(\d{1,2})[-/\s]([A-Za-z]{3,9})[-/\s](\d{2,4})\b"
    n = rf"regexp_extract({c}, '\b(?:\d{{1,2}}[-/.](?:\d{{1,2}}|[A-Za-z]{{3}})[-/.]\d{{2,4}}|\d{{4}}[-/.](?:\d{{1,2}}|[A-Za-z]{{3}})[-/.]\d{{1,2}})\b', 0)"
    year = f"regexp_extract({c}, '{p}', 3)"
    named = f"lpad(regexp_extract({c}, '{p}', 1), 2, '0') || '/' || {_MONTH.format(c=c, p=p)} || '/' || CASE WHEN length({year}) = 2 THEN '20' ELSE '' END || {year}".replace("{1,2}", "{1,2}")
    return f"CASE WHEN regexp_matches({c}, '{p}') THEN {named} WHEN {n} <> '' THEN {n} ELSE trim({c}, ' ') END"


def _amount(c: str) -> str:
    s = rf"trim(regexp_replace({c}, '₹|Rs\.|INR|,', '', 'g'), ' ')"
    n = rf"try_cast(nullif(regexp_extract(regexp_replace({s}, '[()]', '', 'g'), '[-+]?\d*\.?\d+', 0), '') AS DOUBLE)"
    return f"CASE WHEN contains({c}, '%') THEN NULL WHEN starts_with({s}, '(') AND ends_with({s}, ')') THEN -{n} ELSE {n} END"


_TAX = r"regexp_extract(value, '\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b', 0)"


@query(f"SELECT job_id, {_vendor('vendor_name')} AS vendor, {_buyer('buyer_name')} AS buyer, {_place('place_of_supply')} AS place, {_number('invoice_number')} AS number, {_date('invoice_date')} AS dated FROM {_JOBS}")
def cleaned_fields(spark: SparkSession, d: str) -> DataFrame:
    """Vendor, buyer, place, number and date of every job in the form that extraction gives them."""
    j = jobs(spark, d, ["vendor_name", "buyer_name", "place_of_supply", "invoice_number", "invoice_date"])
    return j.select(
        "job_id", cleaning.clean_vendor(F.col("vendor_name")).alias("vendor"), cleaning.clean_buyer(F.col("buyer_name")).alias("buyer"), cleaning.clean_place(F.col("place_of_supply")).alias("place"),
        cleaning.clean_invoice_number(F.col("invoice_number")).alias("number"), cleaning.clean_date(F.col("invoice_date")).alias("dated"),
    )


@query(f"""SELECT reading_id, field_name, CASE WHEN value = '' THEN NULL WHEN field_name = 'grand_total' THEN CASE WHEN ({_amount('value')}) IS NOT NULL THEN printf('%.2f', {_amount('value')}) END WHEN field_name = 'invoice_number' THEN {_number('value')} WHEN field_name = 'invoice_date' THEN {_date('value')}
WHEN field_name = 'buyer_name' THEN {_buyer('value')} WHEN field_name = 'vendor_name' THEN {_vendor('value')} WHEN field_name = 'place_of_supply' THEN {_place('value')} WHEN field_name = 'vendor_gstin' THEN CASE WHEN {_TAX} <> '' THEN {_TAX} ELSE upper(trim(value, ' ')) END ELSE trim(value, ' ') END AS parsed FROM {_R} WHERE value IS NOT NULL""")
def field_parse(spark: SparkSession, d: str) -> DataFrame:
    """Every reading in the form of its field."""
    return _values(spark, d).where("value IS NOT NULL").select("reading_id", "field_name", cleaning.parse_field(F.col("field_name"), F.col("value")).alias("parsed"))


@query(rf"""SELECT doc_id, line_no, words FROM (SELECT doc_id, line_no, trim(regexp_replace(line, '(?i)^(?:amount\s*in\s*words|in\s*words|amount\s*words|rupees\s*in\s*words)\s*[:.\-]?\s*', ''), ':.,- ') AS words FROM
(SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)) WHERE line <> '')
WHERE lower(words) NOT IN ('taxable amount', 'total amount', 'net taxable', 'grand total', 'net amount', 'amount') AND regexp_matches(lower(words), 'rupees|only|thousand|hundred|lakh|crore|zero|one|two|three|four|five|six|seven|eight|nine|ten|twenty|thirty|forty|fifty')""")
def words_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of all documents that may hold an amount in words, without the label."""
    lines = table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("line <> ''")
    return lines.select("doc_id", "line_no", F.explode(F.array_compact(F.array(cleaning.clean_words(F.col("line"))))).alias("words"))


@query(rf"SELECT reading_id, CASE WHEN starts_with(trim(value, ' '), '-') THEN -try_cast(regexp_replace(value, '[^0-9.]', '', 'g') AS DOUBLE) ELSE try_cast(regexp_replace(value, '[^0-9.]', '', 'g') AS DOUBLE) END AS digits_value, coalesce(try_cast(regexp_extract(replace(value, ',', ''), '[-+]?\d*\.?\d+', 0) AS DOUBLE), 0.0) AS cell_value, translate(lower(trim(value, ' ')), ', -/', '') AS eval_value FROM {_R} WHERE value IS NOT NULL")
def value_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every reading as a number of digits and dots, as a table's cell, and as evaluation compares it."""
    v = F.col("value")
    return _values(spark, d).where("value IS NOT NULL").select("reading_id", cleaning.digits_float(v).alias("digits_value"), cleaning.cell_number(v).alias("cell_value"), cleaning.eval_key(v).alias("eval_value"))


def _close(a: str, b: str, absolute: float, relative: float) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN {a} IS NULL AND {b} IS NULL ELSE abs({a} - {b}) <= greatest({absolute}, greatest(abs({a}), abs({b})) * {relative}) END"


#: Absolute and relative tolerance of the comparisons.
VARIANTS = {"accuracy": (0.5, 0.01), "baseline": (1.0, 0.01), "slices": (1.5, 0.015)}


@query(f"SELECT r.reading_id, abs(x - t) <= greatest(1.0, x * 0.02) AS share_match, {_close('x', 't', 0.5, 0.01)} AS accuracy, {_close('x', 't', 1.0, 0.01)} AS baseline, {_close('x', 't', 1.5, 0.015)} AS slices FROM (SELECT reading_id, job_id, {_amount('value')} AS x FROM {_R} WHERE field_name = 'grand_total') r JOIN (SELECT job_id, CASE WHEN NOT isnan(grand_total) THEN grand_total END AS t FROM {_JOBS}) j USING (job_id)")
def amount_matches(spark: SparkSession, d: str) -> DataFrame:
    """Totals as read against the recorded total, by every tolerance in use."""
    truth = jobs(spark, d, ["grand_total"]).select("job_id", F.nanvl("grand_total", F.lit(None).cast("double")).alias("t"))
    r = _values(spark, d).where("field_name = 'grand_total'").select("reading_id", "job_id", cleaning.clean_amount(F.col("value")).alias("x")).join(truth, "job_id")
    return r.select("reading_id", cleaning.share_match(F.col("x"), F.col("t")).alias("share_match"), *[cleaning.close_variant(F.col("x"), F.col("t"), *v).alias(k) for k, v in VARIANTS.items()])


_IFSC = "CASE WHEN length(s) = 11 AND substr(s, 5, 1) IN ('0', 'O', 'D', 'Q') THEN substr(s, 1, 4) || '0' || substr(s, 6, 6) ELSE s END"


@query(f"""SELECT job_id, code, b.canonical AS bank, p.canonical AS place FROM (SELECT job_id, CASE WHEN regexp_matches(c, '^[A-Z]{{4}}0[A-Z0-9]{{6}}$') AND NOT regexp_matches(c, 'EMPL|BENE|DEPT|ANNE|OFFI|PAYE') THEN c END AS code, substr(trim(vendor_gstin, ' '), 1, 2) AS prefix FROM (SELECT job_id, vendor_gstin, {_IFSC} AS c FROM (SELECT job_id, vendor_gstin, replace(upper(trim(ifsc_code, ' ')), '@', 'B') AS s FROM {_JOBS})))
LEFT JOIN (SELECT code AS bcode, canonical FROM ref_values WHERE list_name = 'bank_name' AND code IS NOT NULL) b ON substr(code, 1, 4) = bcode LEFT JOIN (SELECT code AS pcode, canonical FROM ref_values WHERE list_name = 'place_of_supply' AND code IS NOT NULL) p ON prefix = pcode""")
def codes_to_names(spark: SparkSession, d: str) -> DataFrame:
    """Bank of a repaired bank code, and place of supply of a tax number's first two digits, by the reference list (a fixed small table)."""
    ref = table(spark, d, "ref_values", ["list_name", "code", "canonical"]).where("code IS NOT NULL")
    named = lambda name, key, out: F.broadcast(ref.where(F.col("list_name") == name).select(F.col("code").alias(key), F.col("canonical").alias(out)))
    j = jobs(spark, d, ["ifsc_code", "vendor_gstin"]).select("job_id", cleaning.bank_code(F.col("ifsc_code")).alias("code"), F.substring(F.trim("vendor_gstin"), 1, 2).alias("prefix"))
    j = j.withColumn("bcode", F.substring("code", 1, 4)).join(named("bank_name", "bcode", "bank"), "bcode", "left")
    return j.join(named("place_of_supply", "pcode", "place"), F.col("prefix") == F.col("pcode"), "left").select("job_id", "code", "bank", "place")


_BOX = "(SELECT DISTINCT reading_id, bbox FROM extracted_fields WHERE len(bbox) = 4)"
_PAGE = (1240, 1754)


def _axis(lo: str, hi: str, size: int, least: int) -> str:
    a, b = (f"greatest(0, least(1000, CAST(trunc(1000.0 * bbox[{i}] / {size}) AS INT)))" for i in (lo, hi))
    far = f"CASE WHEN {b} <= {a} THEN least(1000, {a} + {least}) ELSE {b} END"
    return f"CASE WHEN {b} <= {a} AND ({far}) <= {a} THEN greatest(0, ({far}) - {least}) ELSE {a} END, {far}"


def _cut(least: int) -> str:
    return f"(SELECT [p[1], p[3], p[2], p[4]] FROM (SELECT [{_axis(1, 3, _PAGE[0], least)}, {_axis(2, 4, _PAGE[1], least)}] AS p))"


def _round(scale: bool) -> str:
    return "[" + ", ".join(f"greatest(0, least(1000, CAST(round_even({f'1000.0 * bbox[{i}] / {_PAGE[(i - 1) % 2]}' if scale else f'bbox[{i}]'}, 0) AS INT)))" for i in range(1, 5)) + "]"


_FIX = "[{p}[1], {p}[2], CASE WHEN {p}[3] <= {p}[1] THEN least(1000, {p}[1] + 2) ELSE {p}[3] END, CASE WHEN {p}[4] <= {p}[2] THEN least(1000, {p}[2] + 2) ELSE {p}[4] END]"


@query(f"""SELECT reading_id, {_cut(2)} AS cut_box, {_cut(3)} AS export_box, px AS rounded_box, CASE WHEN list_max(bbox) <= 1.0 THEN list_transform(bbox, lambda x: CAST(round_even(x * 1000, 0) AS INT)) WHEN bbox[3] > 1000 OR bbox[4] > 1000 THEN {_FIX.format(p='px')} ELSE {_FIX.format(p='th')} END AS auto_box,
[CAST(greatest(0, bbox[1] - dx) AS INT), CAST(greatest(0, bbox[2] - dy) AS INT), CAST(least({_PAGE[0]}, bbox[3] + dx) AS INT), CAST(least({_PAGE[1]}, bbox[4] + dy) AS INT)] AS margin_box, bbox[1] >= 0 AND bbox[2] >= 0 AND bbox[1] < bbox[3] AND bbox[2] < bbox[4] AND bbox[3] <= 1000 AND bbox[4] <= 1000 AS sound
FROM (SELECT *, {_round(True)} AS px, {_round(False)} AS th, trunc((bbox[3] - bbox[1]) * 0.05) AS dx, trunc((bbox[4] - bbox[2]) * 0.05) AS dy FROM {_BOX})""")
def box_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every reading's box in thousandths of the page by each rule, with a margin, and whether it is sound."""
    b, w, h = F.col("bbox"), F.lit(_PAGE[0]), F.lit(_PAGE[1])
    df = table(spark, d, "extracted_fields", ["reading_id", "bbox"]).where(F.size("bbox") == 4).distinct()
    return df.select(
        "reading_id", boxes.to_thousandths(b, w, h).alias("cut_box"), boxes.to_thousandths(b, w, h, 3).alias("export_box"), boxes.to_thousandths_rounded(b, w, h).alias("rounded_box"),
        boxes.auto_thousandths(b, w, h).alias("auto_box"), boxes.with_margin(b, w, h).alias("margin_box"), boxes.sound(b).alias("sound"),
    )
