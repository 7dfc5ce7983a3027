"""Template retrieval: fingerprints, inverted anchor index, set similarity, margins between candidates."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import cut


def fingerprint(parts: list[Column], length: int = 16) -> Column:
    """Hexadecimal prefix of the sha256 of the parts."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two sets of strings: two empty sets are alike, one empty set is like nothing."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / either)


#: Ids of a block of the left side, of which there are at least two for each core, and of the right side.
LEFT_IDS, RIGHT_IDS = 8_192, 2_048

#: An anchor that this share of a block's pairs have in common is counted in a matrix product, a rarer one by its rows.
COMMON = 1 / 256


def _packer(code: str):
    """For mapInPandas: sorted ids with their anchors in blocks, as the ids, how many anchors each has, and the anchors' codes as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), RIGHT_IDS):
                some = pdf.iloc[at : at + RIGHT_IDS]
                codes = [np.asarray(c, code) for c in some["codes"]]
                yield pd.DataFrame({"ids": [some["id"].tolist()], "sizes": [np.array([len(c) for c in codes], np.int32).tobytes()], "codes": [np.concatenate(codes).tobytes()]})

    return run


def _entries(sizes: bytes, codes: bytes, code: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, row of each entry, code of each entry) of a packed block, ordered by code."""
    n, c = np.frombuffer(sizes, np.int32), np.frombuffer(codes, code)
    order = np.argsort(c, kind="stable")
    return len(n), np.repeat(np.arange(len(n)), n)[order], c[order]


def _shared(a: tuple, b: tuple) -> np.ndarray:
    """Matrix of the number of codes that each row of one block has in common with each row of another."""
    (na, rows_a, codes_a), (nb, rows_b, codes_b) = a, b
    ua, at_a, n_a = np.unique(codes_a, return_index=True, return_counts=True)
    ub, at_b, n_b = np.unique(codes_b, return_index=True, return_counts=True)
    both, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    hits = np.zeros((na, nb), np.float32)
    common = n_a[ia] * n_b[ib] > na * nb * COMMON
    ja, jb = ia[common], ib[common]
    for at in range(0, len(ja), 512):
        x, y = np.zeros((na, min(512, len(ja) - at)), np.float32), np.zeros((min(512, len(ja) - at), nb), np.float32)
        for k, (p, q) in enumerate(zip(ja[at : at + 512], jb[at : at + 512])):
            x[rows_a[at_a[p] : at_a[p] + n_a[p]], k] = 1
            y[k, rows_b[at_b[q] : at_b[q] + n_b[q]]] = 1
        hits += x @ y
    for p, q in zip(ia[~common], ib[~common]):
        hits[np.ix_(rows_a[at_a[p] : at_a[p] + n_a[p]], rows_b[at_b[q] : at_b[q] + n_b[q]])] += 1
    return hits


def _best(top: int, code: str):
    """For mapInPandas over (block, blocks of the left side, blocks of the right side), each left block's rows together and the right side in order."""

    def scan(lefts: list[tuple], rights: Iterator[tuple]) -> pd.DataFrame:
        ids = [i for left in lefts for i in left[0]]
        row_of = {i: n for n, i in enumerate(ids)}
        mine = _entries(b"".join(x[1] for x in lefts), b"".join(x[2] for x in lefts), code)
        row, hit, pos = (np.zeros(0, np.int64) for _ in range(3))
        least, others = np.zeros(len(ids), np.float32), []
        for right_ids, sizes, codes in rights:
            hits = _shared(mine, _entries(sizes, codes, code))
            for n, i in enumerate(right_ids):
                if i in row_of:
                    hits[row_of[i], n] = 0
            # Who comes later is larger, so it must share more than the last of the best so far.
            floor = least + 1
            if len(right_ids) > top and (hits >= floor[:, None]).sum() > 4 * top * len(ids):
                floor = np.maximum(floor, np.partition(hits, len(right_ids) - top, axis=1)[:, len(right_ids) - top])
            r, c = np.nonzero(hits >= floor[:, None])
            row, hit, pos = np.concatenate([row, r]), np.concatenate([hit, hits[r, c].astype(np.int64)]), np.concatenate([pos, c + len(others)])
            others += right_ids
            order = np.lexsort((pos, -hit, row))
            row, hit, pos = row[order], hit[order], pos[order]
            start = np.searchsorted(row, np.arange(len(ids)))
            rank = np.arange(len(row)) - start[row]
            least[row[rank == top - 1]] = hit[rank == top - 1]
            keep = rank < top
            row, hit, pos = row[keep], hit[keep], pos[keep]
        return pd.DataFrame({"id": [ids[r] for r in row], "other": [others[p] for p in pos], "hits": hit})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((r.block, r.side, (list(r.ids), r.sizes, r.codes)) for pdf in batches for r in pdf.itertuples())
        for _, own in groupby(rows, lambda r: r[0]):
            lefts, first = [], None
            for _, side, packed in own:
                if side:
                    first = packed
                    break
                lefts.append(packed)
            if lefts and first:
                yield scan(lefts, chain([first], (packed for _, _, packed in own)))

    return run


def inverted_candidates(left: DataFrame, right: DataFrame, top: int) -> DataFrame:
    """(id, other, hits): the ``top`` others that share most anchors with each id.

    Both sides have (id, anchor), distinct. Anchors are of a small vocabulary, so nearly every two ids share
    some and a table of pairs would grow with the square of the ids. Blocks of the left side therefore read the right
    side block by block, in the order of its ids, count shared anchors in memory and keep the best of each id.
    What moves is the right side once for each left block. Ties go to the smaller other.
    """
    spark = left.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    anchors = left.select("anchor").union(right.select("anchor")).where("anchor IS NOT NULL").distinct()
    codes = cut(anchors.select("anchor", F.row_number().over(Window.orderBy("anchor")).alias("code")))
    code = np.min_scalar_type(codes.count()).name

    def packed(df: DataFrame) -> DataFrame:
        lists = df.where("id IS NOT NULL").join(codes, "anchor").groupBy("id").agg(F.collect_list("code").alias("codes"))
        # Ordered over all partitions; fixed, as the ranges come from a sample.
        ordered = lists.repartitionByRange(ranges, "id").sortWithinPartitions("id")
        return cut(ordered.mapInPandas(_packer(code), f"ids array<{dict(df.dtypes)['id']}>, sizes binary, codes binary")).withColumn("at", F.monotonically_increasing_id())

    mine = packed(left)
    theirs = mine if left is right else packed(right)
    blocks = max(2 * spark.sparkContext.defaultParallelism, -(-(mine.agg(F.sum(F.size("ids"))).first()[0] or 0) // LEFT_IDS))
    # Packed rows are counted across the ranges: the upper bits of ``at`` are the range, the lower ones the row in it.
    counted = (F.shiftright("at", 33) + F.col("at").bitwiseAND((1 << 33) - 1) * ranges) % blocks
    own = mine.select(counted.cast("int").alias("block"), F.lit(0).alias("side"), "at", "ids", "sizes", "codes")
    met = theirs.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), "at", "ids", "sizes", "codes")
    placed = own.union(met).repartitionByRange(blocks, "block").sortWithinPartitions("block", "side", "at")
    return placed.mapInPandas(_best(top, code), f"id {dict(left.dtypes)['id']}, other {dict(right.dtypes)['id']}, hits bigint")


def best_with_margin(df: DataFrame, key: list[str], score: str, tie: list[Column]) -> DataFrame:
    """The best row of every key, the runner-up's score and the margin to it."""
    w = Window.partitionBy(*key).orderBy(F.col(score).desc(), *tie)
    df = df.withColumn("runner_up", F.lead(score).over(w)).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return df.withColumn("margin", F.round(F.col(score) - F.coalesce("runner_up", F.lit(0.0)), 6))


def spatial_alignment(pairs: DataFrame, key: list[str], reach: float = 300.0) -> DataFrame:
    """Mean closeness of shared anchors: 1 at the same place, 0 from ``reach`` on; ``pairs`` has ax, ay, bx, by."""
    d = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    return pairs.groupBy(*key).agg(F.avg(F.greatest(F.lit(0.0), 1 - d / reach)).alias("spatial"), F.count("*").alias("shared"))


def match_templates(queries: DataFrame, templates: DataFrame, top: int = 20) -> DataFrame:
    """Best template of every query among those with the same retrieval key, with the margin to the next.

    Both sides have (id, key, anchor, x, y, weight). Candidates come from the key (at most ``top`` per
    query, the heaviest first, a top-k by definition); they are scored by Jaccard of the anchors and by
    spatial alignment of the shared ones.
    """
    head = templates.groupBy("key", F.col("id").alias("template")).agg(F.max("weight").alias("weight"))
    w = Window.partitionBy("key").orderBy(F.desc("weight"), "template")
    head = head.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top).select("key", "template")
    q = queries.select("id", "key", "anchor", F.col("x").alias("ax"), F.col("y").alias("ay"))
    t = templates.groupBy(F.col("id").alias("template"), "anchor").agg(F.avg("x").alias("bx"), F.avg("y").alias("by"))
    size_q, size_t = q.groupBy("id").agg(F.countDistinct("anchor").alias("nq")), t.groupBy("template").agg(F.count("*").alias("nt"))
    joined = q.join(head, "key").join(t, ["template", "anchor"])
    s = spatial_alignment(joined, ["id", "template"]).join(size_q, "id").join(size_t, "template")
    s = s.withColumn("jaccard", F.col("shared") / (F.col("nq") + F.col("nt") - F.col("shared")))
    s = s.withColumn("score", F.round(0.5 * F.col("jaccard") + 0.5 * F.col("spatial"), 4))
    best = best_with_margin(s, ["id"], "score", [F.col("template")])
    return best.select("id", "template", "score", "margin", (F.col("margin") < 0.05).alias("ambiguous"))
