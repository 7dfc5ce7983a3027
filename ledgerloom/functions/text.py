"""Cleaning and comparing typed and scanned text."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ledgerloom.functions.identifiers import to_digits

# Number words and scales of amounts in words.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14,
    "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
SCALE_WORDS = {"thousand": 1_000, "lakh": 100_000, "crore": 10_000_000, "million": 1_000_000, "billion": 1_000_000_000}


def alnum_key(c: Column) -> Column:
    """Lower case, letters and digits only: the form in which values are compared."""
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def clean_number(c: Column) -> Column:
    """An invoice number without a label in front; the first word of at least two characters."""
    t = F.regexp_replace(F.trim(c), r"(?i)^(?:invoice|inv|bill|no|number)[\s.:#]+", "")
    return F.nullif(F.regexp_extract(t, r"(\S{2,})", 1), F.lit(""))


def clean_name(c: Column) -> Column:
    """A name without form of address in front, labels, and doubled blanks."""
    t = F.regexp_replace(F.trim(c), r"(?i)^(?:m/s\.?|messrs\.?|name\s*:|to\s*:)\s*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"[,;:.]+$", ""))


def numeric_candidates(c: Column) -> Column:
    """Readings of a damaged amount with confidence: as it stands, else with confused letters read as digits."""
    t = F.regexp_replace(c, r"(?i)rs\.?|inr|₹|,|\s", "")
    # Checked by pattern: a cast alone takes exponents and words like "inf" as well.
    number = lambda x: F.when(x.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)$"), x).try_cast("double")
    plain, fixed = number(t), number(to_digits(t))
    n = F.length(F.regexp_replace(t, r"[0-9.\-]", ""))
    return F.when(plain.isNotNull(), F.struct(plain.alias("value"), F.lit(0.95).alias("conf"))).when(fixed.isNotNull(), F.struct(fixed.alias("value"), F.greatest(F.lit(0.5), 0.9 - 0.1 * n).cast("double").alias("conf")))


def date_repair(c: Column) -> Column:
    """dd/MM/yyyy of a damaged numeric date, day first; null if it is no date."""
    t = to_digits(F.translate(F.trim(c), ".-", "//"))
    parts = F.split(t, "/")
    d, m, y = (F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (1, 2, 3))
    y = F.when(y < 100, y + 2000).otherwise(y)
    last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)), 29).otherwise(28)).otherwise(31)
    return F.when((F.size(parts) == 3) & m.between(1, 12) & d.between(1, last) & y.between(1900, 2199), F.format_string("%02d/%02d/%04d", d, m, y))


def words_amount(c: Column) -> Column:
    """Value of an amount in words (hundred, thousand, lakh, crore, million, billion); null without a number word."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z]+", " "), " "), lambda w: w.isin(*NUMBER_WORDS, *SCALE_WORDS, "hundred"))
    num = F.create_map(*[F.lit(x) for k, v in NUMBER_WORDS.items() for x in (k, v)])
    scale = F.create_map(*[F.lit(x) for k, v in SCALE_WORDS.items() for x in (k, v)])

    def step(s: Column, w: Column) -> Column:
        big, small = F.try_element_at(scale, w), F.try_element_at(num, w)
        seg = F.when(big.isNotNull(), F.lit(0).cast("bigint")).when(w == "hundred", F.greatest(s["seg"], F.lit(1).cast("bigint")) * 100).otherwise(s["seg"] + F.coalesce(small, F.lit(0)))
        total = F.when(big.isNotNull(), s["total"] + F.greatest(s["seg"], F.lit(1).cast("bigint")) * big).otherwise(s["total"])
        return F.struct(total.cast("bigint").alias("total"), seg.cast("bigint").alias("seg"))

    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("seg"))
    out = F.aggregate(words, start, step)
    return F.when(F.size(words) > 0, out["total"] + out["seg"])


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b)])


def sequence_ratio(a: Column, b: Column) -> Column:
    """Longest-matching-blocks ratio of the texts' letters and digits; equal ones have 1."""
    x, y = alnum_key(a), alnum_key(b)
    return F.when(x == y, 1.0).otherwise(_ratio(x, y))


def fuzzy_equal(a: Column, b: Column, least: float = 0.8) -> Column:
    """Equal, one within the other, or alike by at least ``least``."""
    x, y = alnum_key(a), alnum_key(b)
    return (x == y) | ((F.length(x) > 0) & (F.length(y) > 0) & (x.contains(y) | y.contains(x))) | (sequence_ratio(a, b) >= least)
