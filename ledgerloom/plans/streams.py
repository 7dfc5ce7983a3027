"""Queries on the event table, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import table
from ledgerloom.streaming import progress

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df: DataFrame, *stamps: str) -> DataFrame:
    """Instants as zone-less timestamps, as the tables hold them."""
    for c in stamps:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


_DAY = "SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


@query(_DAY)
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    return _plain(progress.tumbling(events(spark, d), "1 day"), "window_start")


@query("SELECT w AS window_start, count(*) AS n, round(avg(value), 4) AS mean FROM (SELECT value, unnest([time_bucket(INTERVAL '6 hours', ts), time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours']) AS w FROM events) GROUP BY 1")
def sliding_avg(spark: SparkSession, d: str) -> DataFrame:
    return _plain(progress.sliding_average(events(spark, d), "12 hours", "6 hours"), "window_start")


@query("""WITH g AS (SELECT user_id, ts, CAST(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL '2 hours' AS INT) AS cut, event_id FROM events),
s AS (SELECT user_id, ts, sum(coalesce(cut, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_counts(spark: SparkSession, d: str) -> DataFrame:
    return _plain(progress.sessions(events(spark, d), "2 hours"), "session_start")


@query("SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS stage, arg_max(value, struct_pack(a := ts, b := event_id)) AS value, max(event_id) AS max_event_id, count(*) AS n_events FROM events GROUP BY 1")
def progress_last_state(spark: SparkSession, d: str) -> DataFrame:
    return progress.last_state(events(spark, d), "user_id")


@query("SELECT event_type, count(*) AS n, sum(k) AS total_k, max(k) AS max_k FROM (SELECT event_type, CAST(props::JSON->>'$.k' AS BIGINT) AS k FROM events) GROUP BY 1")
def json_props_extract(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events", ["event_type", "props"]).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total_k"), F.max(k).alias("max_k"))


@query(_DAY)
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return _plain(progress.drain(progress.tumbling(progress.event_stream(spark, d), "1 day"), "complete"), "window_start")


@query("SELECT DISTINCT event_id FROM events")
def stream_dedupe_watermark(spark: SparkSession, d: str) -> DataFrame:
    return progress.drain(progress.unseen(progress.event_stream(spark, d), ["event_id"], "400 days").select("event_id"), "append")
