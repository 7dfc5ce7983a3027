"""Amounts in text: parsing, number words in the Indian scale, tolerant comparison (all Catalyst expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words.
ONES = ["", "One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine", "Ten", "Eleven", "Twelve", "Thirteen", "Fourteen", "Fifteen", "Sixteen", "Seventeen", "Eighteen", "Nineteen"]
TENS = ["", "", "Twenty", "Thirty", "Forty", "Fifty", "Sixty", "Seventy", "Eighty", "Ninety"]
SCALES = [("Crore", 10_000_000), ("Lakh", 100_000), ("Thousand", 1_000), ("Hundred", 100)]


def parse_amount(text: Column) -> Column:
    """First amount in a text as double; brackets mean negative, percentages and texts without digits give null."""
    t = F.regexp_replace(text, r"(?i)rs\.?|inr|₹|,|\s", "")
    number = F.regexp_extract(t, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(text.contains("%"), None).when(t.rlike(r"^\(.*\)$"), -F.abs(number)).otherwise(number)


def _below_hundred(n: Column) -> Column:
    ones, tens = F.array(*map(F.lit, ONES)), F.array(*map(F.lit, TENS))
    low = F.try_element_at(ones, (n % 10 + 1).cast("int"))
    return F.when(n < 20, F.try_element_at(ones, (n + 1).cast("int"))).otherwise(F.trim(F.concat_ws(" ", F.try_element_at(tens, F.expr("0").cast("int") + (F.floor(n / 10) + 1).cast("int")), low)))


def amount_words(amount: Column) -> Column:
    """Whole rupees in words (crore, lakh, thousand, hundred); blank for null and amounts below 1, null from 1,000 crore."""
    n = F.floor(amount).cast("bigint")
    parts = []
    for name, size in SCALES:
        share = F.floor(n % (size * {"Crore": 1000, "Hundred": 10}.get(name, 100)) / size).cast("bigint")
        words = F.trim(F.concat_ws(" ", F.when(share >= 100, F.concat(_below_hundred(F.floor(share / 100)), F.lit(" Hundred"))), _below_hundred(share % 100))) if name == "Crore" else _below_hundred(share)
        parts.append(F.when(share > 0, F.concat(words, F.lit(f" {name}"))))
    parts.append(F.when(n % 100 > 0, _below_hundred(n % 100)))
    return F.when(n >= 10_000_000_000, None).when(n >= 1, F.concat_ws(" ", *parts)).otherwise("")


def amount_in_words(amount: Column) -> Column:
    """An amount as a cheque has it: rupees and paise, blank for null, zero and negative amounts."""
    paise = F.bround((amount - F.floor(amount)) * 100, 0).cast("bigint")
    small = F.when(paise >= 100, F.lit("One Hundred")).otherwise(_below_hundred(paise))
    whole = F.when(amount >= 1, F.concat(F.lit("Rupees "), amount_words(amount)))
    pence = F.when(paise > 0, F.concat(F.when(amount >= 1, F.lit(" and ")).otherwise(F.lit("Rupees ")), small, F.lit(" Paise")))
    said = F.concat(F.coalesce(whole, F.lit("")), F.coalesce(pence, F.lit("")))
    return F.when(amount >= 10_000_000_000, None).when((amount > 0) & (said != ""), F.concat(said, F.lit(" Only"))).otherwise("")


def close(a: Column, b: Column, absolute: float, relative: float) -> Column:
    """Equal within the larger of an absolute and a relative tolerance; null if either is missing."""
    return F.abs(a - b) <= F.greatest(F.lit(absolute), F.abs(a) * relative)
