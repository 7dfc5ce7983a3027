from pyspark.sql import functions as F

from ledgerloom.operators.lifecycle import first_by_hash, latest, record_diff
from ledgerloom.sources import files
from ledgerloom.streaming import progress


def test_latest_and_hash(spark):
    df = spark.createDataFrame([("a", 1, "h", 0), ("a", 2, "h", 0), ("b", 1, None, 0), ("c", 1, None, 0), ("c", 1, None, 0)], "k string, v int, h string, x int")
    assert {(r.k, r.v) for r in latest(df, ["k"], [F.desc("v")]).collect()} == {("a", 2), ("b", 1), ("c", 1)}
    assert first_by_hash(df.distinct(), "h", "k", [F.col("v")]).count() == 3
    assert latest(df.limit(0), ["k"], [F.desc("v")]).count() == 0


def test_diff(spark):
    a = spark.createDataFrame([("1", "x"), ("2", None), ("3", "z")], "k string, v string")
    b = spark.createDataFrame([("1", "y"), ("2", None), ("4", "q")], "k string, v string")
    assert {r.k: r.change for r in record_diff(a, b, ["k"], "v").collect()} == {"1": "changed", "2": "equal", "3": "removed", "4": "added"}


def test_sinks(spark, tmp_path):
    p = str(tmp_path / "t")
    files.append(spark.createDataFrame([("a", 1, False), ("b", 1, False)], "k string, version int, gone boolean"), p)
    files.append(spark.createDataFrame([("a", 2, False), ("b", 2, True)], "k string, version int, gone boolean"), p)
    assert [(r.k, r.version) for r in files.latest_view(spark.read.parquet(p), ["k"], "version", "gone").collect()] == [("a", 2)]
    q = str(tmp_path / "q")
    files.replace_partitions(spark.createDataFrame([("v1", 1), ("v2", 2)], "version string, x int"), q, ["version"])
    files.replace_partitions(spark.createDataFrame([("v1", 9)], "version string, x int"), q, ["version"])
    assert sorted((r.version, r.x) for r in spark.read.parquet(q).collect()) == [("v1", 9), ("v2", 2)]


def test_intake(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one")
    (tmp_path / "b.exe").write_bytes(b"two")
    (tmp_path / "c.png").write_bytes(b"")
    good, bad = files.intake(spark, str(tmp_path))
    assert good.count() == 1 and [r.reason for r in bad.collect()] == ["extension"]  # the source passes over empty files


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).selectExpr("id as event_id", "timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, cast(id as int)) as ts", "id % 3 as user_id", "'click' as event_type", "cast(id as double) as value", "'{}' as props")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    stream = progress.tumbling(progress.event_stream(spark, str(tmp_path / "events.parquet"), name="part"), "1 day")
    got = sorted(map(tuple, progress.drain(stream, "complete", str(tmp_path / "ck")).collect()))
    want = sorted(map(tuple, progress.tumbling(rows.withColumn("ts", F.col("ts").cast("timestamp")), "1 day").collect()))
    assert got == want and len(got) == 9
