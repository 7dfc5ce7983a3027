"""Splitting a stream of pages into documents by a fold that carries what the current document is known to be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of a boundary that each signal gives, and the score from which a page starts a new document.
NEW_NUMBER, NEW_TAX, TITLE, AFTER_TOTALS, CONTINUES, BOUNDARY = 0.35, 0.30, 0.20, 0.10, -0.35, 0.40


def page_signals(pages: DataFrame) -> DataFrame:
    """Number, tax number, title, continuation and totals of every page text."""
    t = F.lower("page_text")
    found = lambda p: F.nullif(F.regexp_extract("page_text", p, 1), F.lit(""))
    return pages.select(
        "doc_id", "page",
        found(r"(?i)(?:invoice no|item no\.?|order)[:.]?\s+([A-Za-z]*-?[0-9]{3,})").alias("number"),
        found(r"\b([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z])\b").alias("tax"),
        t.rlike(r"tax invoice|statement of account|dear |hello").alias("title"),
        t.rlike(r"continued|carried forward|brought forward").alias("continues"),
        t.rlike(r"grand total|total amount|authorised signatory|total [0-9]").alias("totals"),
    )


def _score(state: Column, p: Column) -> Column:
    differs = lambda name: (state[name].isNotNull() & p[name].isNotNull() & (state[name] != p[name]))
    part = lambda c, w: F.when(F.coalesce(c, F.lit(False)), F.lit(w)).otherwise(F.lit(0.0))
    return F.round(part(differs("number"), NEW_NUMBER) + part(differs("tax"), NEW_TAX) + part(p["title"], TITLE) + part(state["totals"], AFTER_TOTALS) + part(p["continues"], CONTINUES), 4)


def segment_pages(signals: DataFrame) -> DataFrame:
    """(doc_id, page, segment, score): the carried number and tax number are forgotten at every split.

    A document's pages are folded in one array: a document has a bounded number of pages by nature.
    """
    pages = F.array_sort(F.collect_list(F.struct("page", "number", "tax", "title", "continues", "totals")))
    start = F.struct(
        F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("tax"), F.lit(False).alias("totals"), F.lit(0).alias("segment"), F.lit(False).alias("begun"),
        F.array().cast("array<struct<page:int,segment:int,score:double>>").alias("out"),
    )

    def step(state: Column, p: Column) -> Column:
        score = _score(state, p)
        split = state["begun"] & (score >= BOUNDARY)
        segment = F.when(split, state["segment"] + 1).otherwise(state["segment"])
        return F.struct(
            F.when(split, p["number"]).otherwise(F.coalesce(state["number"], p["number"])).alias("number"),
            F.when(split, p["tax"]).otherwise(F.coalesce(state["tax"], p["tax"])).alias("tax"),
            p["totals"].alias("totals"), segment.alias("segment"), F.lit(True).alias("begun"),
            F.concat(state["out"], F.array(F.struct(p["page"].alias("page"), segment.alias("segment"), score.alias("score")))).alias("out"),
        )

    folded = signals.groupBy("doc_id").agg(pages.alias("pages")).select("doc_id", F.aggregate("pages", start, step)["out"].alias("out"))
    return folded.select("doc_id", F.inline("out"))
