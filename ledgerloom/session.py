"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import functools
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ledgerloom", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that every operator here expects (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LEDGERLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, directory: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """One parquet table of a data directory, with only the named columns in the scan."""
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    return df.select(*columns) if columns else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder. A local session makes its own; a cluster without one is refused."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or local_folder())


@functools.cache
def local_folder() -> str:
    """A folder of this process, for sessions on one machine only; it goes when the process ends."""
    import shutil
    import tempfile

    path = tempfile.mkdtemp(prefix="ledgerloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


#: A plan's estimated bytes that say nothing: Spark's own figure for a plan of unknown size.
UNKNOWN_BYTES = (1 << 63) - 1


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder and cut its lineage.

    A checkpoint keeps the estimated size of its plan, and joins multiply estimates: over rounds of joins the
    number itself would fill the driver's memory, so an estimate above ``UNKNOWN_BYTES`` is dropped.
    """
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= UNKNOWN_BYTES:
        return out
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(out._jdf.queryExecution().analyzed().rdd(), out._jdf.schema(), False), spark)


#: Bytes of input for each task of a Python stage, beyond the number that the session shuffles into, and the most tasks.
SPREAD_BYTES, SPREAD_TASKS = 256 << 20, 200_000


def _input_bytes(df: DataFrame) -> int:
    """Bytes of the files below a plan after pruning of columns is left aside; what is no file has no size that can be trusted."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    files = [leaves.apply(i) for i in range(leaves.size())]
    return sum(int(str(x.stats().sizeInBytes())) for x in files if x.getClass().getSimpleName() == "LogicalRelation")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into as many tasks as the session shuffles into, or more if the input is large.

    For Python stages: their cost follows the rows, not the bytes by which adaptive execution merges
    small partitions, and it leaves a partitioning that names its number as it is.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(_input_bytes(df) // SPREAD_BYTES, SPREAD_TASKS))
    return df.repartition(n, *keys)


def widen(scan: DataFrame) -> DataFrame:
    """A scan for a map-only Python stage: moved to more tasks only if its files make fewer than there are cores."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan._jdf.queryExecution().toRdd().getNumPartitions() >= cores else scan.repartition(cores)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared checkpoint folder; it is deleted when the driver ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def write_out(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the shared checkpoint folder; later reads take only the columns they need."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
