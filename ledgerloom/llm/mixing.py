"""Mixing sources to target weights with capped repetition.

Weights of the sources of a mix are its target shares. Where a token budget is asked for that some
source cannot carry within its repetition limit, the weights are tempered: target shares and natural
token shares are exponentiated, w(t) ~ target^t * natural^(1-t), and the exponent is bisected to the
largest value within every limit. Without a budget the exponent is 1 and the budget is the largest
one at which the exact targets stay within all limits. The weights are then realised in blocks: a
source gives whole repetitions of all its documents, and of one more block, in an order permuted by
hash, the documents up to what is left of its budget and then those that still fit, so no document
repeats more than its limit. Where only the evenness of the mix is given (``temperature``), weights are the
sources' token shares raised to a power, bisected to the target entropy or to the repetition limit.

Token totals cover all documents. Prefix sums within a block run in hash buckets with offsets, so a
source with a third of all rows is spread over as many buckets as its documents need. Defined results: a source without
documents gets share 0 and the others keep their proportions; null sources and blank texts are left
out; limits below 1 count as 0; a mix without any documents gives rows with 0 tokens; empty tables
give empty results.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.packing import ranked
from ledgerloom.session import cut

BISECTIONS, MAX_TARGETS = 60, 100_000

#: Documents of a source for each bucket of its prefix sums; buckets are the leading bits of a hash, at least 8 of them.
BUCKET_ROWS = 50_000


def tempered(target: dict[str, float], tokens: dict[str, int], limit: dict[str, int], budget: float | None) -> tuple[dict[str, float], float, float]:
    """(weights, exponent, budget) of one mix; sources without tokens have weight 0."""
    live = [s for s in target if tokens.get(s, 0) > 0 and target[s] > 0 and limit[s] >= 1]
    zero = dict.fromkeys(target, 0.0)
    if not live:
        return zero, 1.0, 0.0
    total = sum(tokens[s] for s in live)

    def weights(t: float) -> dict[str, float]:
        raw = {s: target[s] ** t * (tokens[s] / total) ** (1 - t) for s in live}
        z = sum(raw.values())
        return {s: v / z for s, v in raw.items()}

    def room(w: dict[str, float]) -> float:
        return min(limit[s] * tokens[s] / w[s] for s in live)

    if budget is None:
        w = weights(1.0)
        return {**zero, **w}, 1.0, room(w)
    if room(weights(1.0)) >= budget:
        return {**zero, **weights(1.0)}, 1.0, budget
    lo, hi = 0.0, 1.0  # natural shares need the fewest repetitions
    if room(weights(0.0)) < budget:
        return {**zero, **weights(0.0)}, 0.0, room(weights(0.0))
    for _ in range(BISECTIONS):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if room(weights(mid)) >= budget else (lo, mid)
    return {**zero, **weights(lo)}, lo, budget


def temperature(tokens: dict[str, int], limit: dict[str, int], entropy: float, budget: float) -> tuple[dict[str, float], float, float]:
    """(weights, exponent, budget): token shares raised to the exponent that gives ``entropy`` (nats).

    Entropy falls as the exponent rises from 0 (equal weights). Where a source would repeat more often than
    its limit, the exponent is bisected on towards 1, the natural shares, until all limits hold.
    """
    live = [s for s in tokens if tokens[s] > 0 and limit.get(s, 0) >= 1]
    zero = dict.fromkeys(tokens, 0.0)
    if not live:
        return zero, 1.0, 0.0
    total = sum(tokens[s] for s in live)

    def weights(a: float) -> dict[str, float]:
        raw = {s: math.exp(a * math.log(tokens[s] / total)) for s in live}
        z = sum(raw.values())
        return {s: v / z for s, v in raw.items()}

    def bisect(lo: float, hi: float, left) -> float:  # noqa: ANN001
        for _ in range(BISECTIONS):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if left(weights(mid)) else (lo, mid)
        return hi

    room = lambda w: min(limit[s] * tokens[s] / w[s] for s in live)
    a = 0.0 if entropy >= math.log(len(live)) else bisect(0.0, 64.0, lambda w: -sum(v * math.log(v) for v in w.values() if v > 0) > entropy)
    if room(weights(a)) < budget:
        a = bisect(min(a, 1.0), max(a, 1.0), lambda w: room(w) < budget) if a < 1 else 1.0
    w = weights(a)
    return {**zero, **w}, a, min(budget, room(w))


def mix_plan(sized: DataFrame, targets: DataFrame, budget_share: float | None = None, by_entropy: bool = False) -> DataFrame:
    """(mix_id, source, target_share, max_repeats, available, exponent, wanted) of every line of ``targets``.

    ``sized`` has source and tokens; ``budget_share`` sets the budget to that share of the mix's own tokens.
    ``by_entropy`` takes only the entropy of the target shares: weights are then tempered token shares.
    """
    lines = targets.select("mix_id", "source", "target_share", "max_repeats").limit(MAX_TARGETS + 1).collect()
    if len(lines) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} lines of targets")
    named = targets.select("source").distinct()
    have = {r.source: int(r.tokens) for r in sized.join(F.broadcast(named), "source").groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    rows = []
    for mix in sorted({r.mix_id for r in lines}):
        own = [r for r in lines if r.mix_id == mix]
        t, cap = {r.source: r.target_share or 0.0 for r in own}, {r.source: max(int(r.max_repeats or 0), 0) for r in own}
        budget = None if budget_share is None else budget_share * sum(have.get(s, 0) for s in t)
        if by_entropy:
            goal = sum(-x / sum(t.values()) * math.log(x / sum(t.values())) for x in t.values() if x > 0)
            w, exponent, total = temperature({s: have.get(s, 0) for s in t}, cap, goal, budget if budget is not None else float(sum(have.get(s, 0) for s in t)))
        else:
            w, exponent, total = tempered(t, have, cap, budget)
        rows += [(mix, s, float(t[s]), cap[s], have.get(s, 0), float(exponent), float(w[s] * total)) for s in sorted(t, key=str)]
    return sized.sparkSession.createDataFrame(rows, "mix_id int, source string, target_share double, max_repeats int, available bigint, exponent double, wanted double")


def fill_rest(left: int, sizes: list[tuple[int, int]]) -> dict[int, int]:
    """size -> documents to take, largest sizes first, so that what is ``left`` of a source's budget is filled.

    ``sizes`` has (size, documents) of the documents that are still free.
    """
    take: dict[int, int] = {}
    for size, n in sorted(sizes, reverse=True):
        k = min(n, left // size)
        if k > 0:
            take[size] = k
            left -= k * size
    return take


def _fill_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """The fill of one source of one mix: a row for each size. Sizes differ, so they are few beside the tokens they sum to."""
    take = fill_rest(int(pdf["left"].iloc[0]), list(zip(pdf["tokens"].tolist(), pdf["n"].tolist())))
    return pd.DataFrame([(pdf["mix_id"].iloc[0], pdf["source"].iloc[0], size, k) for size, k in take.items()], columns=["mix_id", "source", "tokens", "take"])


def mix_documents(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(mix_id, source, doc_id, tokens, copies, order_key): how often each document enters each mix.

    Copy k of a source's documents forms its k-th block, in the order of ``order_key``.
    """
    lines = plan.where((F.col("available") > 0) & (F.col("wanted") > 0)).select("mix_id", "source", "available", "wanted", "max_repeats")
    docs = sized.where(F.col("tokens") > 0).join(F.broadcast(lines), "source")
    whole = F.floor(F.col("wanted") / F.col("available") + 1e-9)
    docs = docs.withColumn("whole", F.least(whole, F.col("max_repeats").cast("bigint"))).withColumn("rest", F.greatest(F.col("wanted") - F.col("whole") * F.col("available"), F.lit(0.0)))
    # The last block in permuted order: bucket by the leading bits of the hash, prefix sums within buckets.
    docs = cut(docs.withColumn("h", F.xxhash64("mix_id", "source", "whole", "doc_id")))
    bits = min(max(8, math.ceil(math.log2(max(docs.count(), 1) / BUCKET_ROWS + 1))), 24)
    docs = docs.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    sums = docs.groupBy("mix_id", "source", "bucket").agg(F.sum("tokens").alias("n"))
    ahead = Window.partitionBy("mix_id", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("mix_id", "source", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inner = Window.partitionBy("mix_id", "source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    run = docs.withColumn("upto", F.sum("tokens").over(inner)).join(offsets, ["mix_id", "source", "bucket"])
    may = F.col("whole") < F.col("max_repeats")
    extra = ((F.col("ahead") + F.col("upto") <= F.col("rest") + 0.5) & may).cast("int")
    run = cut(run.select("mix_id", "source", "doc_id", "tokens", "h", "whole", "rest", may.alias("may"), extra.alias("extra")))
    # The block goes on past the first document that does not fit: what is left takes free documents that do, the largest first.
    used = run.groupBy("mix_id", "source").agg((F.floor(F.max("rest") + 0.5) - F.sum(F.col("tokens") * F.col("extra"))).cast("bigint").alias("left")).where("left > 0")
    open_ = run.where(F.col("may") & (F.col("extra") == 0)).join(F.broadcast(used), ["mix_id", "source"]).where(F.col("tokens") <= F.col("left"))
    sizes = open_.groupBy("mix_id", "source", "tokens").agg(F.count("*").alias("n"), F.first("left").alias("left"))
    few = cut(sizes.groupBy("mix_id", "source").applyInPandas(_fill_group, "mix_id int, source string, tokens bigint, take bigint"))
    # Only documents of the sizes that are wanted are ranked, in hashed buckets.
    named = open_.join(few, ["mix_id", "source", "tokens"]).withColumn("_k", F.struct("mix_id", "source", "tokens"))
    extras = ranked(named, "_k", ["h", "doc_id"]).where(F.col("rank") < F.col("take")).select("mix_id", "source", "h", "doc_id", F.lit(1).alias("filled"))
    run = run.join(extras, ["mix_id", "source", "h", "doc_id"], "left").withColumn("extra", F.col("extra") + F.coalesce("filled", F.lit(0)))
    return run.select("mix_id", "source", "doc_id", "tokens", (F.col("whole") + F.col("extra")).cast("int").alias("copies"), F.col("h").alias("order_key")).where("copies > 0")


def mix_report(plan: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per mix and source: target and actual share, tokens, documents and the most copies of one document."""
    got = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    out = plan.join(got, ["mix_id", "source"], "left").na.fill(0, ["mixed_tokens", "documents", "most_copies"])
    whole = F.sum("mixed_tokens").over(Window.partitionBy("mix_id"))
    return out.select("mix_id", "source", "target_share", "max_repeats", "available", "exponent", "mixed_tokens", "documents", "most_copies", F.coalesce(F.try_divide(F.col("mixed_tokens"), whole), F.lit(0.0)).alias("actual_share"))
