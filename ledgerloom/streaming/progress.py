"""Event streams: windows, sessions, last state per key, duplicates under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import shared_path

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    ]
)


def event_stream(spark: SparkSession, directory: str, name: str = "events", files_per_trigger: int = 1) -> DataFrame:
    """The event files of a directory as a stream; ``ts`` becomes an instant, as watermarks need."""
    df = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", f"{name}*.parquet").parquet(directory)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """Events and their summed value per window and type."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    g = df.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sliding_average(events: DataFrame, width: str, slide: str, late: str = "10 minutes") -> DataFrame:
    df = events.withWatermark("ts", late) if events.isStreaming else events
    g = df.groupBy(F.window("ts", width, slide)).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))
    return g.select(F.col("window.start").alias("window_start"), "n", "mean")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of every user: events with no pause of ``gap`` or more between them."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    g = df.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("session_start"), "n")


def last_state(events: DataFrame, key: str) -> DataFrame:
    """The last event of every key; ties go to the larger id."""
    order = F.struct("ts", "event_id")
    return events.groupBy(key).agg(F.max_by("event_type", order).alias("stage"), F.max_by("value", order).alias("value"), F.max("event_id").alias("max_event_id"), F.count("*").alias("n_events"))


def unseen(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """First event of every key while its state is kept; state older than the watermark is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def drain(stream: DataFrame, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what is there and returns its result.

    The result goes to a parquet folder beside the checkpoint, in the shared folder where the cluster
    names one; each batch is written under its id, so a batch that is run again replaces itself.
    """
    spark = stream.sparkSession
    base = checkpoint or shared_path(spark, "stream")
    out = f"{base}/out"

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={0 if mode == 'complete' else epoch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(f"{out}/epoch=*") if _exists(spark, out) else spark.createDataFrame([], stream.schema)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
