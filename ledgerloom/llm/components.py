"""Connected components of a link table, distributed (alternating large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut

#: The algorithm ends after a number of rounds logarithmic in the longest path; what has not ended by then is an error.
MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in the columns ``a`` and ``b``; a component is named by its least id.

    Hubs are no problem: every round keeps stars, whose edges are counted by key and never gathered.
    """
    now = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        now = cut(_small_star(_large_star(now)))
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components are not complete after {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots).distinct()
