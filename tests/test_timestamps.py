from ledgerloom.operators.timestamps import invoice_dates, normalise_timestamps

FACTS = "job_id string, site_id int, invoice_date string, due_date string, batch_no int"
SITES = [(1, "Asia/Kolkata", "DMY"), (2, "America/New_York", "MDY"), (3, "Europe/Berlin", "DMY"), (4, "UTC", "YMD")]


def run(spark, rows):
    sites = spark.createDataFrame(SITES, "site_id int, time_zone string, date_order string")
    facts = spark.createDataFrame([(f"j{i}", s, v, None, 1) for i, (s, v) in enumerate(rows)], FACTS)
    got = {r.job_id: r.normal_form for r in invoice_dates(facts, sites).collect()}
    return [got.get(f"j{i}") for i in range(len(rows))]


def test_forms(spark):
    cases = [
        ((1, "03/04/2026"), "2026-04-03"), ((2, "03/04/2026"), "2026-03-04"), ((2, "25/04/2026"), "2026-04-25"), ((1, "04-25-26"), "2026-04-25"),
        ((4, "2026.6.3"), "2026-06-03"), ((1, "Dt. 5th Feb 2026"), "2026-02-05"), ((1, "Tue, 31 Mar 2026"), "2026-03-31"), ((1, "46260"), "2026-08-26"),
        ((1, "1770533661127"), "2026-02-08T06:54:21.127000Z"), ((1, "20260420T083007Z"), "2026-04-20T08:30:07.000000Z"),
        ((1, "Nov 30, 2025 12:30 AM IST"), "2025-11-29T19:00:00.000000Z"), ((2, "2026-03-20 10:00:00 [America/New_York]"), "2026-03-20T14:00:00.000000Z"),
        ((2, "2026-11-01 01:30:00"), "2026-11-01T05:30:00.000000Z"),  # occurs twice: the first
        ((2, "2026-03-08 02:30:00"), "2026-03-08T07:30:00.000000Z"),  # skipped: the offset before the change
        ((2, "01 Nov 2026 01:30:00 EST"), "2026-11-01T06:30:00.000000Z"), ((3, "2026-01-08T20:45:21.375188351+0530"), "2026-01-08T15:15:21.375188Z"),
        ((1, "31/02/2026"), None), ((1, "2026-13-45"), None), ((1, "net 30"), None), ((1, ""), None), ((1, None), None), ((1, "x" * 50_000), None),
    ]
    assert run(spark, [c for c, _ in cases]) == [w for _, w in cases]


def test_order_is_learned_where_none_is_declared(spark):
    sites = spark.createDataFrame([(9, "UTC", None)], "site_id int, time_zone string, date_order string")
    rows = [(f"a{i}", 9, f"02/{d}/2026", None, 1) for i, d in enumerate(range(13, 28))] + [("z", 9, "02/03/2026", None, 1)]
    got = {r.job_id: r.normal_form for r in invoice_dates(spark.createDataFrame(rows, FACTS), sites).collect()}
    assert got["z"] == "2026-02-03"


def test_edges(spark):
    sites = spark.createDataFrame(SITES, "site_id int, time_zone string, date_order string")
    assert invoice_dates(spark.createDataFrame([], FACTS), sites).count() == 0
    df = spark.createDataFrame([("k", None, "03/04/2026 10:00", "x"), ("k", None, "03/04/2026", "x")], "ts_day string, src int, v string, value string")
    out = normalise_timestamps(df.withColumnRenamed("ts_day", "key").selectExpr("*", "cast(null as string) as tz", "cast(null as string) as o"), "v", "src", "tz", "o")
    got = sorted((r.ts_status, r.ts_normal) for r in out.collect())
    assert [g[0] for g in got] == ["ambiguous", "unresolved"] and got[0][1] == "2026-04-03"
