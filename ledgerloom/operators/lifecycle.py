"""Append-only facts with latest views: versions, duplicates, pages of a listing, splits, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order`` (end it in a unique column)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def first_by_hash(df: DataFrame, content: str, key: str, order: list[Column]) -> DataFrame:
    """First row of every content hash; rows without a hash stand for themselves."""
    return latest(df.withColumn("_content", F.coalesce(content, key)), ["_content"], order).drop("_content")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def running_rank(df: DataFrame, key: str, time: str, tie: str, into: str) -> DataFrame:
    """Adds ``into``: how many rows of the key came before, by ``time`` and then ``tie``.

    Counted by hour first, so a key that holds a third of all rows is ranked in as many tasks as it has hours.
    """
    df = df.withColumn("_hour", F.date_trunc("hour", time))
    counts = df.groupBy(key, "_hour").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(key).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_hour", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    own = F.row_number().over(Window.partitionBy(key, "_hour").orderBy(time, tie)) - 1
    return df.withColumn("_own", own).join(offsets, [key, "_hour"]).withColumn(into, F.col("_own") + F.col("_ahead")).drop("_hour", "_own", "_ahead")


def running_novelty(df: DataFrame, key: str, time: str, tie: str, seen: int) -> DataFrame:
    """How often a key came before, and whether it still counts as new; keys and times are filled."""
    return running_rank(df, key, time, tie, "seen_before").withColumn("is_novel", F.col("seen_before") < seen)


def round_robin(df: DataFrame, stratum: str, order: list[Column], n: int) -> DataFrame:
    """``n`` rows taken in turn from the strata, the first of each in ``order`` first."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("turn") <= n).orderBy("turn", stratum).limit(n)


def hash_split(key: Column, share: float, seed: str = "42") -> Column:
    """``train`` for about ``share`` of the keys, ``val`` for the rest; the same key always goes the same way."""
    place = F.conv(F.substring(F.sha2(F.concat(key.cast("string"), F.lit(seed)), 256), 1, 8), 16, 10).cast("bigint")
    return F.when(place < int(share * 2**32), "train").otherwise("val")


def record_diff(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """Added, removed, changed and equal values of two snapshots (full outer join, null-safe)."""
    a, b = before.select(*key, F.col(value).alias("old")), after.select(*key, F.col(value).alias("new"))
    j = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), key, "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "equal").otherwise("changed")
    return j.select(*key, "old", "new", change.alias("change"))
