"""Cleaning of captured field texts: names, places, numbers, dates, amounts, and the comparisons used in evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headings that may stand before a value, and words at which a value ends.
VENDOR_HEAD = "retail|tax|tax invoice|invoice|bill of supply|original for recipient|cash memo"
VENDOR_END = r"plot\s*no|sector|road|street|sarani|lane|nagar|opp|near|floor|building|behind|kolkata|mumbai|delhi|bengaluru|west bengal|pin|ph|phone|gstin|email|cin|\d+/\d+"
BUYER_LINE = r"bill\s*to|billed\s*to|buyer|consignee|customer"
BUYER_HEAD = r"bill\s*to|billed\s*to|buyer|consignee|customer|m/s|mr\.|ms\.|sri|smt"
BUYER_END = r"invoice\s*no|invoice\s*date|sls\s*code|due\s*date|place\s*of\s*supply|category|sub\s*category|phone|mobile|gstin|pan|order|address|kolkata|mumbai|delhi"
PLACE_HEAD = r"place\s*of\s*supply|state/ut\s*code|pos|state\s*code|supply\s*state"
PLACE_END = r"category|sub\s*category|phone|mobile|buyer|invoice|due|sls|ftoagency|\(sch\d+\)"
NUMBER_HEAD = r"(?:invoice|inv|bill|voucher|challan)\s*(?:no\.?|#|num|number)?\s*[:.\-]?\s*"
NUMBER_END = "date|dated|due|gstin|pan|po|place|to|bill|amount|total|customer|e-com|order|generated|cashier|name|phone|mobile"
WORDS_HEAD = r"amount\s*in\s*words|in\s*words|amount\s*words|rupees\s*in\s*words"
NO_WORDS = ["taxable amount", "total amount", "net taxable", "grand total", "net amount", "amount"]
NUMBER_WORDS = "rupees|only|thousand|hundred|lakh|crore|zero|one|two|three|four|five|six|seven|eight|nine|ten|twenty|thirty|forty|fifty"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
DATE = r"\b(?:\d{1,2}[-/.](?:\d{1,2}|[A-Za-z]{3})[-/.]\d{2,4}|\d{4}[-/.](?:\d{1,2}|[A-Za-z]{3})[-/.]\d{1,2})\b"
NAMED_DATE = r"\b(\d{1,2})[-/\s]([A-Za-z]{3,9})[-/\s](\d{2,4})\b"
TAX_NUMBER, TAX_PERSON, BANK_CODE = r"\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", r"\b[A-Z]{4}0[A-Z0-9]{6}\b"
NO_BANK_CODE = "EMPL|BENE|DEPT|ANNE|OFFI|PAYE"
_EDGE = r":.,\- "


def _edge(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{_EDGE}]+|[{_EDGE}]+$", "")


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _before(c: Column, words: str) -> Column:
    return F.regexp_replace(c, rf"(?i)\s+(?:{words})\b.*$", "")


def _head(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, rf"(?i)^{pattern}", "")


def _unmarked(c: Column) -> Column:
    return F.regexp_replace(c, r"^[:\s\-#*]+", "")


def clean_vendor(c: Column) -> Column:
    """The first line without heading, up to the first word of an address."""
    s = F.coalesce(F.try_element_at(_lines(c), F.lit(1)), c)
    return _edge(_before(_unmarked(_head(s, rf"(?:{VENDOR_HEAD})\s*")), VENDOR_END))


def clean_buyer(c: Column) -> Column:
    """The first line that is no mere heading, without form of address, up to the next label."""
    s = F.coalesce(F.try_element_at(F.filter(_lines(c), lambda x: ~x.rlike(rf"(?i)^(?:{BUYER_LINE})[:\s]*$")), F.lit(1)), c)
    return _edge(_before(_unmarked(_head(s, rf"(?:{BUYER_HEAD})?\s*(?:name)?\s*[:.\-]?\s*")), BUYER_END))


def clean_place(c: Column) -> Column:
    s = F.coalesce(F.try_element_at(_lines(c), F.lit(1)), c)
    return _edge(_before(_edge(_head(s, rf"(?:{PLACE_HEAD})\s*[:.\-]?\s*")), PLACE_END))


def clean_words(c: Column) -> Column:
    """An amount in words without its label; null unless it has a word of number."""
    s = _edge(_head(c, rf"(?:{WORDS_HEAD})\s*[:.\-]?\s*"))
    return F.when(~F.lower(s).isin(NO_WORDS) & F.lower(s).rlike(NUMBER_WORDS), s)


def clean_invoice_number(c: Column) -> Column:
    """The number behind its label, before a date or the next label: the first word of two characters, else the whole."""
    s = F.regexp_replace(_head(c, NUMBER_HEAD), r"^[:\s\-#]+", "")
    s = F.regexp_replace(s, r"\s+(?:\d{1,2}[-/.](?:\d{1,2}|[A-Za-z]{3})[-/.]\d{2,4}|\d{4}[-/.]).*$", "")
    s = _before(s, NUMBER_END)
    first = F.try_element_at(F.filter(F.transform(F.split(s, r"\s+"), _edge), lambda x: x != ""), F.lit(1))
    return F.when((F.length(first) >= 2) & first.rlike(r"[\p{L}\p{N}]"), first).otherwise(_edge(s))


def clean_date(c: Column) -> Column:
    """``d Mon yyyy`` as dd/MM/yyyy, else the first numeric date as it stands, else the text."""
    day, name, year = (F.regexp_extract(c, NAMED_DATE, i) for i in (1, 2, 3))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(F.lower(name), 1, 3)).cast("int")
    named = F.concat(F.lpad(day, 2, "0"), F.lit("/"), F.lpad(F.when(month > 0, month).otherwise(1).cast("string"), 2, "0"), F.lit("/"), F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year))
    numeric = F.regexp_extract(c, DATE, 0)
    return F.when(c.rlike(NAMED_DATE), named).when(numeric != "", numeric).otherwise(F.trim(c))


def clean_amount(c: Column) -> Column:
    """A number in a text with currency signs; null for percentages, negative in brackets."""
    s = F.trim(F.regexp_replace(c, r"₹|Rs\.|INR|,", ""))
    n = F.regexp_extract(F.regexp_replace(s, r"[()]", ""), r"[-+]?\d*\.?\d+", 0).try_cast("double")
    return F.when(~c.contains("%"), F.when(s.startswith("(") & s.endswith(")"), -n).otherwise(n))


def parse_field(field: Column, c: Column) -> Column:
    """A captured text in the form of its field; amounts come before all other kinds but words."""
    found = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(c, pattern, 0), F.lit("")), F.upper(F.trim(c)))
    amount = field.contains("amount") | field.contains("total") | field.isin("subtotal", "cgst", "sgst", "igst", "discount", "round_off")
    kinds = [
        (field.contains("amount_in_words"), clean_words(c)), (amount, F.format_string("%.2f", clean_amount(c))), (field == "invoice_number", clean_invoice_number(c)), (field.contains("date"), clean_date(c)),
        (field == "buyer_name", clean_buyer(c)), (field == "vendor_name", clean_vendor(c)), (field == "place_of_supply", clean_place(c)), (field.contains("gstin"), found(TAX_NUMBER)), (field.contains("pan"), found(TAX_PERSON)), (field.contains("ifsc"), found(BANK_CODE)),
    ]
    out = F.trim(c)
    for test, value in reversed(kinds):
        out = F.when(test, value).otherwise(out)
    # A format of nothing is the text "null".
    return F.when(c != "", F.when(amount & ~field.contains("amount_in_words") & clean_amount(c).isNull(), None).otherwise(out))


def digits_float(c: Column) -> Column:
    """What is left of digits and dots, negative behind a leading minus; null if that is no number."""
    n = F.regexp_replace(c, r"[^0-9.]", "").try_cast("double")
    return F.when(F.trim(c).startswith("-"), -n).otherwise(n)


def cell_number(c: Column) -> Column:
    """The first number of a table's cell, 0 where there is none."""
    return F.coalesce(F.regexp_extract(F.regexp_replace(c, ",", ""), r"[-+]?\d*\.?\d+", 0).try_cast("double"), F.lit(0.0))


def eval_key(c: Column) -> Column:
    """What evaluation compares: lower case without comma, blank, dash and slash; missing is empty."""
    return F.coalesce(F.translate(F.lower(F.trim(c)), ", -/", ""), F.lit(""))


def share_match(a: Column, b: Column) -> Column:
    """Within 1 or 2 % of the first number: not symmetric."""
    return F.abs(a - b) <= F.greatest(F.lit(1.0), a * 0.02)


def close_variant(a: Column, b: Column, absolute: float, relative: float) -> Column:
    """Equal within an absolute bound or a share of the larger number; two missing numbers are equal."""
    both = F.abs(a - b) <= F.greatest(F.lit(absolute), F.greatest(F.abs(a), F.abs(b)) * relative)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(both)


def bank_code(c: Column) -> Column:
    """An 11-character bank code with its fifth character repaired to 0; null for anything else and for words that look like one."""
    s = F.translate(F.upper(F.trim(c)), "@", "B")
    s = F.when((F.length(s) == 11) & F.substring(s, 5, 1).isin("0", "O", "D", "Q"), F.concat(F.substring(s, 1, 4), F.lit("0"), F.substring(s, 6, 6))).otherwise(s)
    return F.when(s.rlike("^[A-Z]{4}0[A-Z0-9]{6}$") & ~s.rlike(NO_BANK_CODE), s)
