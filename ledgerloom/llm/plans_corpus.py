"""Queries of problems 8 and 9, over token counts of whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.mixing import mix_documents, mix_plan, mix_report
from ledgerloom.llm.packing import pack
from ledgerloom.llm.tokens import with_tokens
from ledgerloom.session import cut, table


#: Most kinds of containers; a longer table is refused.
MAX_KINDS = 1_000


def _capacities(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    kinds = table(spark, sf_dir, "containers").select("container_kind", "capacity_tokens").limit(MAX_KINDS + 1).collect()
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of containers")
    return sorted((r.container_kind, r.capacity_tokens) for r in kinds if r.capacity_tokens)


def _sized(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return cut(with_tokens(table(spark, sf_dir, "documents", [*keep, "text"]), keep=keep))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts into containers of all kinds jointly: one row per text or piece of a split text."""
    held = _capacities(spark, sf_dir)
    # Of several kinds with one capacity the first by name stands for all: a piece is placed once.
    kinds = spark.createDataFrame([(k, c) for c, k in {c: k for k, c in reversed(held)}.items()], "container_kind string, capacity int")
    packed = pack(_sized(spark, sf_dir, "doc_id"), [c for _, c in held])
    return packed.join(F.broadcast(kinds), "capacity").select("doc_id", "piece", "tokens", "container", "container_kind", "capacity")


def p8_each_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts into containers of one kind, for each kind: only texts above that kind are split."""
    sized, out = _sized(spark, sf_dir, "doc_id"), None
    for kind, cap in _capacities(spark, sf_dir):
        part = pack(sized, [cap]).select(F.lit(kind).alias("container_kind"), "doc_id", "piece", "tokens", "container")
        out = part if out is None else out.union(part)
    return out


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and filled share by kind of the joint packing."""
    bins = p8_containers(spark, sf_dir).groupBy("container_kind", "capacity", "container").agg(F.sum("tokens").alias("used"), F.count("*").alias("pieces"))
    by = bins.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("used").alias("tokens"), F.sum("capacity").alias("room"))
    return by.select("container_kind", "containers", "pieces", "tokens", (F.col("tokens") / F.col("room")).alias("filled"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares really reached for every mix at its exact targets."""
    sized = _sized(spark, sf_dir, "doc_id", "source")
    plan = mix_plan(sized, table(spark, sf_dir, "mix_targets"))
    return mix_report(plan, mix_documents(sized, plan))


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of every mix with their number of copies."""
    sized = _sized(spark, sf_dir, "doc_id", "source")
    return mix_documents(sized, mix_plan(sized, table(spark, sf_dir, "mix_targets")))


def p9_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached when each mix is to have as many tokens as its sources hold: weights are tempered to the limits."""
    sized = _sized(spark, sf_dir, "doc_id", "source")
    plan = mix_plan(sized, table(spark, sf_dir, "mix_targets"), budget_share=1.0)
    return mix_report(plan, mix_documents(sized, plan))


def p9_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached when weights are the sources' token shares raised to the power that gives the targets' entropy within the limits."""
    sized = _sized(spark, sf_dir, "doc_id", "source")
    plan = mix_plan(sized, table(spark, sf_dir, "mix_targets"), budget_share=1.0, by_entropy=True)
    return mix_report(plan, mix_documents(sized, plan))


QUERIES = {"p8_containers": p8_containers, "p8_each_kind": p8_each_kind, "p8_fill": p8_fill, "p9_documents": p9_documents, "p9_mix": p9_mix, "p9_tempered": p9_tempered, "p9_temperature": p9_temperature}
SQL: dict[str, str] = {}
