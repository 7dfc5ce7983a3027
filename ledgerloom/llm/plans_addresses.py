"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.addresses import address_pairs, location_parties
from ledgerloom.session import table


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "invoice_facts", ["vendor_address", "buyer_address", "buyer_address_line1"])
    return facts.select(F.explode(F.array("vendor_address", "buyer_address", "buyer_address_line1")).alias("address"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return address_pairs(_addresses(spark, sf_dir))


def p4_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every string with a house number and a street with its location: one row a string, whatever the size of the location."""
    return location_parties(_addresses(spark, sf_dir)).select("address", "location")


QUERIES = {"p4_found": p4_found, "p4_locations": p4_locations}
SQL: dict[str, str] = {}
