from pyspark.sql import functions as F

from ledgerloom.functions.geometry import iou
from ledgerloom.functions.identifiers import repair_bank_code, repair_tax_number, tax_number_valid
from ledgerloom.functions.money import amount_words, parse_amount
from ledgerloom.operators.scoring import error_rate


def one(spark, col, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(col.alias("r")).first().r


def test_amounts(spark):
    p = parse_amount(F.col("t"))
    for text, want in [("Rs. 1,560.50", 1560.5), ("(250)", -250.0), ("18%", None), ("none", None), ("", None), ("₹ 12", 12.0)]:
        assert one(spark, p, t=text) == want
    w = amount_words(F.col("n"))
    assert one(spark, w, n=15600.0) == "Fifteen Thousand Six Hundred"
    assert one(spark, w, n=12345678.9) == "One Crore Twenty Three Lakh Forty Five Thousand Six Hundred Seventy Eight"
    assert one(spark, w, n=0.4) == "" and one(spark, w, n=20.0) == "Twenty"


def test_check_digit(spark):
    v = tax_number_valid(F.col("g"))
    for code, want in [("27AABCU9603R1ZN", True), ("27AABCU9603R1ZM", False), ("29AAAAA0000A1ZY", True), ("27AADCA1234A1Z9", False), ("27 AABCU 9603R1ZN", True), ("x", False)]:
        assert one(spark, v, g=code) is want


def test_repairs(spark):
    assert one(spark, repair_tax_number(F.col("g")), g="27AABCU96O3R1ZN") == "27AABCU9603R1ZN"
    assert one(spark, repair_bank_code(F.col("c")), c="SBINOOOO123") == "SBIN0000123"
    assert one(spark, repair_bank_code(F.col("c")), c="SB1") is None


def test_geometry_and_errors(spark):
    box = lambda *v: tuple(F.lit(x) for x in v)
    assert one(spark, iou(box(0, 0, 10, 10), box(5, 0, 15, 10)), x=1) == 50 / 150
    assert one(spark, iou(box(0, 0, 0, 0), box(0, 0, 0, 0)), x=1) == 0.0
    assert 0 < one(spark, error_rate(F.col("a"), F.col("b")), a="156O.50", b="1560.50") < 0.2
