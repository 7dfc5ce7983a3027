"""Check digits and formats of registration numbers, and repair of characters confused in scanning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Letters that stand for digits in scans, and back.
LETTERS, DIGITS = "OQDILZSBG", "000112586"


def mod36_check(code: Column) -> Column:
    """Check character over the first 14 places: weights 1, 2, 1, 2 ..., digits of the product summed in base 36."""
    def step(acc: Column, i: Column) -> Column:
        value = F.instr(F.lit(BASE36), F.substring(code, i + 1, F.lit(1))) - 1
        product = value * (i % 2 + 1)
        return acc + F.floor(product / 36).cast("int") + product % 36

    total = F.aggregate(F.sequence(F.lit(0), F.lit(13)), F.lit(0), step)
    return F.substring(F.lit(BASE36), (36 - total % 36) % 36 + 1, F.lit(1))


def tax_number_valid(raw: Column) -> Column:
    """Is a 15-place tax number well formed with a right check character? Null stays null."""
    code = F.upper(F.regexp_replace(raw, r"\s", ""))
    return F.when(code.rlike(r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]$"), mod36_check(code) == F.substring(code, 15, 1)).when(raw.isNotNull(), F.lit(False))


def to_digits(c: Column) -> Column:
    return F.translate(F.upper(c), LETTERS, DIGITS)


def repair_tax_number(raw: Column) -> Column:
    """Places of a tax number that must be digits or letters are brought to that class; null if the form stays wrong."""
    code = F.upper(F.regexp_replace(raw, r"[^0-9A-Za-z]", ""))
    letters = lambda c: F.translate(c, "0125689", "OIZSGBG")
    fixed = F.concat(to_digits(F.substring(code, 1, 2)), letters(F.substring(code, 3, 5)), to_digits(F.substring(code, 8, 4)), letters(F.substring(code, 12, 1)), F.substring(code, 13, 1), letters(F.translate(F.substring(code, 14, 1), "2", "Z")), F.substring(code, 15, 1))
    return F.when((F.length(code) == 15) & fixed.rlike(r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]$"), fixed)


def repair_bank_code(raw: Column) -> Column:
    """Eleven places: four letters, a zero, six letters or digits with O read as 0."""
    code = F.upper(F.regexp_replace(raw, r"[^0-9A-Za-z]", ""))
    fixed = F.concat(F.translate(F.substring(code, 1, 4), "0158", "OISB"), F.lit("0"), F.translate(F.substring(code, 6, 6), "O", "0"))
    return F.when((F.length(code) == 11) & fixed.rlike(r"^[A-Z]{4}0[A-Z0-9]{6}$"), fixed)


def repair_phone(raw: Column) -> Column:
    """Last ten digits of a phone number after confused letters are read as digits."""
    digits = F.regexp_replace(to_digits(F.regexp_replace(raw, r"^\s*\+?91[-\s]", "")), r"[^0-9]", "")
    return F.when(F.length(digits) >= 10, F.substring(digits, -10, 10))
