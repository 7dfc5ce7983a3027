"""Evaluation of readings against recorded values, word errors, margins between candidates, arithmetic hypotheses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.cleaning import clean_amount, close_variant, eval_key

#: Fields held as amounts; all others are compared as text.
AMOUNTS = ("grand_total", "subtotal", "tax_amount")


def long_truth(jobs: DataFrame, fields: list[str]) -> DataFrame:
    """(job_id, field_name, truth) of the recorded fields that are filled."""
    parts = [F.struct(F.lit(f).alias("field_name"), (F.format_string("%.2f", f) if f in AMOUNTS else F.col(f)).alias("truth"), F.col(f).isNotNull().alias("filled")) for f in fields]
    return jobs.select("job_id", F.inline(F.array(*parts))).where("filled AND trim(truth) <> ''").drop("filled")


def judged(readings: DataFrame, truth: DataFrame) -> DataFrame:
    """Readings with the recorded value beside them and ``correct``: equal as text, or within half a unit or 1 % as an amount."""
    both = readings.join(truth, ["job_id", "field_name"])
    amount = F.coalesce(close_variant(clean_amount(F.col("value")), clean_amount(F.col("truth")), 0.5, 0.01), F.lit(False))
    return both.withColumn("correct", F.when(F.col("field_name").isin(*AMOUNTS), F.col("value").isNotNull() & amount).otherwise(eval_key(F.col("value")) == eval_key(F.col("truth"))))


def scorecard(df: DataFrame, keys: list[str]) -> DataFrame:
    """Count, correct ones and accuracy for every value of each key and over all (key and value are null there)."""
    rows = F.array(*[F.struct(F.lit(k).alias("grouped_by"), F.col(k).cast("string").alias("value_of")) for k in keys], F.struct(F.lit("all").alias("grouped_by"), F.lit(None).cast("string").alias("value_of")))
    # Counted by all keys first, so what is spread over the report's rows is a small table.
    counted = df.groupBy(*keys).agg(F.count("*").alias("c"), F.count_if("correct").alias("h"))
    g = counted.select("c", "h", F.inline(rows)).groupBy("grouped_by", "value_of").agg(F.sum("c").alias("n"), F.sum("h").alias("hits"))
    return g.select("grouped_by", "value_of", "n", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("accuracy"))


def document_slice(filename: Column, handwritten: Column) -> Column:
    """Kind of document by its file's name: the first rule that holds."""
    n = F.lower(filename)
    photo = n.contains("photo") | n.contains("img_") | n.contains("camera") | n.rlike(r"\.(jpg|jpeg|png|webp)$")
    return F.when(handwritten | n.contains("hand"), "handwritten").when(photo, "photo").when(n.contains("scan"), "scanned").when(n.endswith(".pdf"), "digital").otherwise("scanned")


def with_margin_penalty(readings: DataFrame) -> DataFrame:
    """Best reading of every job and field; its confidence falls if the runner-up says something else and is close behind."""
    w = Window.partitionBy("job_id", "field_name").orderBy(F.desc("confidence"), "reading_id")
    df = readings.withColumns({"_rn": F.row_number().over(w), "next_value": F.lead("value").over(w), "next_confidence": F.lead("confidence").over(w)}).where("_rn = 1").drop("_rn")
    margin = F.greatest(F.lit(0.0), F.col("confidence") - F.col("next_confidence"))
    amount = F.col("field_name").isin(*AMOUNTS)
    a, b = clean_amount(F.col("value")), clean_amount(F.col("next_value"))
    other = F.when(amount, F.coalesce(F.abs(a - b) > 0.05, F.lit(False))).otherwise(F.upper("value") != F.upper("next_value"))
    factor = F.when(F.coalesce(other & (margin < 0.20), F.lit(False)), F.when(amount, 0.65 + 1.75 * margin).otherwise(0.70 + 1.5 * margin)).otherwise(1.0)
    return df.select("job_id", "field_name", "value", F.round(F.col("confidence") * factor + 1e-9, 4).alias("calibrated"))


def accounting_triples(candidates: DataFrame) -> DataFrame:
    """First (subtotal, tax, total) of every job, in the order of its lists, whose sum is right within 0.05 and whose total is positive.

    ``candidates`` has job_id and the lists ``subs``, ``taxes`` and ``totals``; no taxes counts as a tax of 0.
    """
    taxes = F.when(F.size("taxes") > 0, F.col("taxes")).otherwise(F.array(F.lit(0.0)))
    one = candidates.select("job_id", F.posexplode("subs").alias("i", "subtotal"), taxes.alias("taxes"), "totals")
    two = one.select("job_id", "i", "subtotal", F.posexplode("taxes").alias("j", "tax"), "totals")
    three = two.select("job_id", "i", "j", "subtotal", "tax", F.posexplode("totals").alias("k", "total")).where((F.abs(F.col("subtotal") + F.col("tax") - F.col("total")) <= 0.05) & (F.col("total") > 0))
    best = three.groupBy("job_id").agg(F.min_by(F.struct("subtotal", "tax", "total"), F.struct("i", "j", "k")).alias("t"))
    return best.select("job_id", "t.*")


@F.pandas_udf(T.DoubleType())
def word_error_rate(typed: pd.Series, right: pd.Series) -> pd.Series:
    """Edits between words over the words of the right text, at most 1; two empty texts have none."""

    def rate(a: str | None, b: str | None) -> float:
        x, y = (a or "").split(), (b or "").split()
        if not y:
            return 0.0 if not x else 1.0
        last = list(range(len(y) + 1))
        for i, u in enumerate(x, 1):
            row = [i]
            for j, v in enumerate(y, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (u != v)))
            last = row
        return min(1.0, last[-1] / len(y))

    return pd.Series([rate(a, b) for a, b in zip(typed, right)])


def alignment(labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Per label: values present, and those found in their document's text, case and separators aside.

    ``labels`` has (doc_id, label, value), ``texts`` (doc_id, text).
    """
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    one = labels.where(key(F.col("value")) != "").join(texts, "doc_id")
    hit = F.coalesce(key(F.col("text")).contains(key(F.col("value"))), F.lit(False))
    g = one.groupBy("label").agg(F.count("*").alias("present"), F.count_if(hit).alias("matched"))
    return g.select("label", "present", "matched", F.round(F.col("matched") / F.col("present"), 6).alias("share"))
