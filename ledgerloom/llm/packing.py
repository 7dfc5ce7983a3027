"""Filling fixed-capacity containers with texts: variable-capacity best fit over size classes.

Texts of one token count are interchangeable, so the packing is planned on the histogram of sizes,
which has at most as many rows as the largest capacity whatever the number of texts, and then realised
by ranking the texts within their size. The plan opens, for the largest size left, the container kind
with the least cost (room wasted per token of capacity after filling it with the best fitting sizes
still there), repeats that pattern as often as its sizes last, so every step uses up a size, and finally
downsizes each container to the smallest kind that holds its contents. Only a text larger than the
largest kind is split: into full containers and a rest that is packed like any other text.

Ranks within a hot size are counted in hashed buckets with running offsets, so no size class is
gathered in one task. Defined results: null and blank texts have no tokens and take no container;
ties go to the larger kind; capacities that repeat or are not positive are ignored; without
containers or texts the result is empty; repeated document ids are separate texts.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import cut

#: Least number of buckets of the two-level ranks, and rows of the largest key for each of them.
BUCKETS, BUCKET_ROWS = 64, 100_000

#: Longest plan (rows) that is broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000

#: Largest capacity that a plan is made for: the histogram and the plan are held by the driver.
MAX_CAPACITY = 1 << 20


def plan_patterns(histogram: dict[int, int], capacities: list[int]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(capacity, repetitions, [(size, pieces of it)]) of all patterns; ``histogram`` counts the pieces by size."""
    left = dict(histogram)
    sizes = sorted(left)
    caps = sorted(set(capacities))
    out = []
    while sizes:
        big = sizes[-1]
        best = None
        for cap in caps:
            if cap < big:
                continue
            room, take = cap - big, {big: 1}
            hi = len(sizes)
            while room >= sizes[0]:
                hi = bisect_right(sizes, room, 0, hi)
                if hi == 0:
                    break
                s = sizes[hi - 1]
                n = min(room // s, left[s] - take.get(s, 0))
                if n <= 0:
                    hi -= 1
                    continue
                take[s] = take.get(s, 0) + n
                room -= n * s
            cost = (room / cap, -cap)
            if best is None or cost < best[0]:
                best = (cost, cap, take)
        _, cap, take = best
        times = min(left[s] // n for s, n in take.items())
        used = sum(s * n for s, n in take.items())
        final = next(c for c in caps if c >= used)  # downsized to its contents
        out.append((final, times, sorted(take.items(), reverse=True)))
        for s, n in take.items():
            left[s] -= n * times
            if left[s] == 0:
                del left[s]
                sizes.pop(bisect_right(sizes, s) - 1)
    return out


def ranked(df: DataFrame, key: str, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Adds ``rank`` from 0 within ``key``, counted in hashed buckets so that no key is sorted in one task."""
    df = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = df.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    own = F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order)) - 1
    return df.withColumn("_r", own).join(offsets, [key, "_b"]).withColumn("rank", F.col("_r") + F.col("_off")).drop("_b", "_r", "_off")


def pack(sized: DataFrame, capacities: list[int], key: str = "doc_id") -> DataFrame:
    """(key, piece, tokens, container, capacity): every piece of every text with its container."""
    spark = sized.sparkSession
    kind = dict(sized.dtypes)[key]
    caps = sorted({int(c) for c in capacities if c and c > 0})
    empty = spark.createDataFrame([], f"`{key}` {kind}, piece int, tokens bigint, container bigint, capacity int")
    if not caps:
        return empty
    top = caps[-1]
    if top > MAX_CAPACITY:
        raise ValueError(f"capacities above {MAX_CAPACITY} tokens are not planned")
    # A text above the largest kind makes full pieces and a rest.
    pieces = sized.where(F.col("tokens") > 0).select(key, "tokens", F.posexplode(F.expr(f"transform(sequence(0L, (tokens - 1) div {top}), i -> least({top}L, tokens - i * {top}))")).alias("piece", "size"))
    pieces = cut(pieces.select(key, "piece", F.col("size").alias("tokens")))
    # At most one row per token count up to the largest capacity.
    histogram = {int(r.tokens): int(r.n) for r in pieces.groupBy("tokens").agg(F.count("*").alias("n")).collect()}
    if not histogram:
        return empty
    rows, first, start = [], 0, dict.fromkeys(histogram, 0)
    for cap, times, take in plan_patterns(histogram, caps):
        for s, n in take:
            rows.append((s, start[s], start[s] + n * times, n, first, cap))
            start[s] += n * times
        first += times
    plan = spark.createDataFrame(rows, "tokens bigint, lo bigint, hi bigint, per int, first bigint, capacity int")
    buckets = max(BUCKETS, max(histogram.values()) // BUCKET_ROWS)
    placed = ranked(pieces, "tokens", [key, "piece"], buckets).join(F.broadcast(plan) if len(rows) <= BROADCAST_ROWS else plan, "tokens").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select(key, "piece", "tokens", (F.col("first") + F.expr("(rank - lo) div per")).alias("container"), "capacity")
