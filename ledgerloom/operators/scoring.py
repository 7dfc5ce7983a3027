"""Field readings in long form: merging by source weight, agreement, accuracy, error rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weight of a reading's source when values are merged by weighted confidence; 0.5 for any other source.
SOURCE_WEIGHTS = {
    "tie_template": 1.10, "tie_fast_path": 1.10, "native_vector_geometry": 1.05, "native_vector_font_hierarchy": 1.05, "native_vector_buyer_block": 1.05, "native_vector_regex": 1.05, "native_vector_totals": 1.05, "native_pdf": 1.00, "layoutlm": 0.85,
    "heuristic": 0.65, "heuristic_reconciled": 0.70, "paddleocr": 0.75, "trocr": 0.85, "handwriting_specializer": 0.85, "easyocr": 0.65, "llm": 0.60, "llm_unavailable": 0.00, "llm_error": 0.00,
}


def weight_of(source: Column) -> Column:
    w = F.lit(0.5)
    for name, x in SOURCE_WEIGHTS.items():
        w = F.when(source == name, x).otherwise(w)
    return w


def merge_by_weight(readings: DataFrame) -> DataFrame:
    """The reading of every job and field with the highest confidence times source weight."""
    df = readings.where(F.trim("value") != "").withColumn("effective", F.round(F.col("confidence") * weight_of(F.col("source")), 6))
    w = Window.partitionBy("job_id", "field_name").orderBy(F.col("effective").desc(), "reading_id")
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("job_id", "field_name", "value", "source", "effective")


def pair_agreement(readings: DataFrame) -> DataFrame:
    """How often two sources that read the same field of the same job agree.

    Readings of one field are few; values are counted by (job, field, source, value) first.
    """
    one = readings.where(F.col("value").isNotNull()).groupBy("job_id", "field_name", "source").agg(F.min("value").alias("value"))
    a, b = one.withColumnsRenamed({"source": "source_a", "value": "va"}), one.withColumnsRenamed({"source": "source_b", "value": "vb"})
    j = a.join(b, ["job_id", "field_name"]).where("source_a < source_b")
    return j.groupBy("source_a", "source_b").agg(F.count("*").alias("pairs"), F.count_if(F.col("va") == F.col("vb")).alias("agreeing"))


def error_rate(typed: Column, right: Column) -> Column:
    """Character error rate by edit distance, capped at 1; two empty strings have none."""
    d = F.levenshtein(typed, right)
    return F.when(F.length(right) == 0, F.when(F.length(typed) == 0, 0.0).otherwise(1.0)).otherwise(F.least(F.lit(1.0), d / F.length(right)))


def precision_recall(df: DataFrame, key: list[str], truth: str, guess: str) -> DataFrame:
    """Precision, recall and F1; a wrong label counts as a false positive and a false negative."""
    hit = F.count_if(F.col(truth).isNotNull() & F.col(guess).isNotNull() & (F.col(truth) == F.col(guess)))
    fp = F.count_if(F.col(guess).isNotNull() & ~F.col(guess).eqNullSafe(F.col(truth)))
    fn = F.count_if(F.col(truth).isNotNull() & ~F.col(truth).eqNullSafe(F.col(guess)))
    g = df.groupBy(*key).agg(hit.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return g.select(*key, "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))
