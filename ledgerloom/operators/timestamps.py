"""Mixed timestamp formats and time zones: one unambiguous date or UTC instant per value.

Every value is taken apart once with JVM-side expressions into a *shape* (numeric triple, named
month, compact digits, epoch, spreadsheet serial) plus an optional time of day and zone. A shape
whose day/month/year order is not settled by the text itself has several valid parses. Per source
an expectation-maximisation over the order mixture decides between them: each value contributes its
likelihood under every valid parse, the source's declared order enters as a Dirichlet prior, and the
posterior chooses. The EM runs on counts per (source, shape, set of valid parses), so its input is a
few dozen rows per source however many values there are, and a hot source costs no more than others.

Defined results: null, blank and non-date texts ("net 30") and dates that do not exist give status
``none`` and no normal form; a local time without any zone (no source zone) gives ``unresolved``;
equal posteriors give ``ambiguous`` and the order named first in ``ORDERS``. Empty input gives an
empty result. Extra columns are passed through; the operator's own columns are prefixed ``ts_``.
"""

from __future__ import annotations

import math
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut

#: Orders a text may be read in; ties between posteriors fall to the earlier one.
ORDERS = ("DMY", "MDY", "YMD", "YDM")

#: Pseudo-counts of a source's declared order against the evidence in its values: a prior that enough values outweigh.
DECLARED_COUNTS = 1_000.0

#: Most time zones by name; the time-zone database has about 600.
MAX_ZONES = 2_000

#: EM stops at this change of any mixture weight, or after this many rounds.
EM_TOLERANCE, EM_ROUNDS = 1e-9, 200

#: Largest posterior table (rows) that is broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 50_000

# Zone letters that the time-zone database no longer abbreviates by name.
EXTRA_LETTERS = {
    "UTC": 0, "GMT": 0, "Z": 0, "IST": 330, "GST": 240, "CET": 60, "CEST": 120, "BST": 60, "WET": 0, "WEST": 60, "EET": 120, "EEST": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AEST": 600, "AEDT": 660,
    "ACST": 570, "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780, "JST": 540, "SGT": 480, "HKT": 480, "MSK": 180, "PKT": 300, "NPT": 345,
}

_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_DAY_NAME = r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*[.,]?\s+"
_TIME = r"^(.+?)[T ]\s*(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*(?:([AaPp])\.?[Mm]\b\.?)?\s*(.*)$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
_TRIPLE = r"^(\d{1,4})([-/. ])(\d{1,2})\2(\d{1,4})$"
_DAY_MONTH_YEAR = r"(?i)^(\d{1,2})(?:st|nd|rd|th)?[-/. ,]*([a-z]{3,9})\.?[-/. ,]+(\d{4}|\d{2})$"
_MONTH_DAY_YEAR = r"(?i)^([a-z]{3,9})\.?[-/. ]*(\d{1,2})(?:st|nd|rd|th)?[-/. ,]+(\d{4}|\d{2})$"
_YEAR_MONTH_DAY = r"(?i)^(\d{4})[-/. ,]*([a-z]{3,9})\.?[-/. ,]*(\d{1,2})(?:st|nd|rd|th)?$"


def _int(c: Column) -> Column:
    return F.when(c != "", c).try_cast("int")


def _valid(y: Column, m: Column, d: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return F.coalesce((y >= 1) & m.between(1, 12) & (d >= 1) & (d <= last), F.lit(False))


def dissect(df: DataFrame, value: str) -> DataFrame:
    """Adds the value's shape (``ts_shape``), its three parts, time of day (``ts_time``) and zone text.

    Each pattern runs once and its groups come out as one array, so the generated code stays small.
    """
    t = F.trim(F.regexp_replace(F.col(value), r"[\s\u00a0]+", " "))
    t = F.regexp_replace(t, r"(?i)^(dt|dtd|dated|date|on)[.:]*\s+|\s*[.,;]+$", "")
    t = F.regexp_replace(F.regexp_replace(t, _DAY_NAME, ""), r"^(\d{8})T?(\d{2})(\d{2})(\d{2})(Z|[+-]\d{2}:?\d{2})?$", "$1T$2:$3:$4$5")
    df = df.withColumn("ts_t", t)
    timed = F.col("ts_t").rlike(_TIME)
    df = df.withColumn("ts_time", F.when(timed, F.split(F.regexp_replace("ts_t", _TIME, "$1\u0001$2\u0001$3\u0001$4\u0001$5\u0001$6\u0001$7"), "\u0001", -1)))
    df = df.withColumn("ts_d", F.regexp_replace(F.coalesce(F.col("ts_time")[0], F.col("ts_t")), r"^\s+|[\s,]+$", ""))
    d, untimed = F.col("ts_d"), F.col("ts_time").isNull()
    kinds = [
        ("triple", d.rlike(_TRIPLE), F.regexp_replace(d, _TRIPLE, "$1\u0001$3\u0001$4")),
        ("compact", d.rlike(_COMPACT), F.regexp_replace(d, _COMPACT, "$1\u0001$2\u0001$3")),
        ("named_dmy", d.rlike(_DAY_MONTH_YEAR), F.regexp_replace(d, _DAY_MONTH_YEAR, "$1\u0001$2\u0001$3")),
        ("named_mdy", d.rlike(_MONTH_DAY_YEAR), F.regexp_replace(d, _MONTH_DAY_YEAR, "$2\u0001$1\u0001$3")),
        ("named_ymd", d.rlike(_YEAR_MONTH_DAY), F.regexp_replace(d, _YEAR_MONTH_DAY, "$3\u0001$2\u0001$1")),
        ("epoch_s", untimed & d.rlike(r"^\d{10}$"), d),
        ("epoch_ms", untimed & d.rlike(r"^\d{13}$"), d),
        ("serial", untimed & d.rlike(r"^[2-7]\d{4}$"), d),
    ]
    # Spark evaluates only the branch that applies, and keeps its label beside the parts.
    found = F.coalesce(*[F.when(test, F.concat(F.lit(name + "\u0001"), parts)) for name, test, parts in kinds])
    df = df.withColumn("ts_g", F.split(found, "\u0001", -1))
    g = F.col("ts_g")
    named = g[0].startswith("named")
    middle = F.when(named, F.nullif(F.array_position(F.array(*map(F.lit, _MONTHS)), F.substring(F.lower(g[2]), 1, 3)), F.lit(0)).cast("int")).otherwise(F.try_element_at(g, F.lit(3)).try_cast("int"))
    triple = F.when(F.length(g[1]) >= 3, "y_first").when(F.length(g[3]) >= 3, "y_last").otherwise("y_short")
    df = df.withColumns({"ts_shape": F.when(g[0] == "triple", triple).otherwise(g[0]), "ts_b": middle, "ts_a": g[1].try_cast("int"), "ts_c": F.try_element_at(g, F.lit(4)).try_cast("int")})
    return df.drop("ts_t", "ts_g")


def _year(y: Column) -> Column:
    return F.when(y < 100, y + 2000).otherwise(y)


def _readings() -> dict[str, tuple[Column, Column, Column, Column]]:
    """For each order: is it open to the shape, and the year, month and day it gives."""
    a, b, c, s = F.col("ts_a"), F.col("ts_b"), F.col("ts_c"), F.col("ts_shape")
    return {
        "DMY": (s.isin("y_last", "y_short"), _year(c), b, a),
        "MDY": (s.isin("y_last", "y_short"), _year(c), a, b),
        "YMD": (s.isin("y_first", "y_short", "compact"), _year(a), b, c),
        "YDM": (s == "y_first", _year(a), c, b),
    }


def _mask() -> Column:
    return F.concat(*[F.when(use & _valid(y, m, d), "1").otherwise("0") for use, y, m, d in _readings().values()])


def _mixture(pdf: pd.DataFrame, counts: float = DECLARED_COUNTS) -> pd.DataFrame:
    """EM over the order mixture of one source; ``pdf`` has its counts by shape and valid parses."""
    declared = next((x for x in pdf["declared"] if isinstance(x, str) and x in ORDERS), None)
    out = []
    for shape, part in pdf.groupby("ts_shape"):
        total = float(part["n"].sum())
        prior = min(counts, 4.0 * (total + 1))
        pseudo = [1e-3 + (prior if o == declared else 0.0) for o in ORDERS]
        # A year that stands first leaves day and month; day-first sources still write month first there.
        pseudo[2] += prior if shape in ("y_first", "compact") else 0.0
        w = [p / sum(pseudo) for p in pseudo]
        rows = [([int(x) for x in m], float(n)) for m, n in zip(part["ts_mask"], part["n"])]
        for _ in range(EM_ROUNDS):
            expected = list(pseudo)
            for open_, n in rows:
                like = [x * o for x, o in zip(w, open_)]
                z = sum(like)
                if z > 0:
                    expected = [e + n * v / z for e, v in zip(expected, like)]
            new = [e / sum(expected) for e in expected]
            moved = max(abs(x - y) for x, y in zip(w, new))
            w = new
            if moved < EM_TOLERANCE:
                break
        for mask, _n in rows:
            like = [x * int(o) for x, o in zip(w, mask)]
            z = sum(like)
            best = max(range(4), key=lambda i: (like[i], -i))
            tied = sum(abs(x - like[best]) <= 1e-12 and x > 0 for x in like) > 1
            out.append((pdf["ts_source"].iloc[0], shape, "".join(map(str, mask)), ORDERS[best] if z > 0 else None, like[best] / z if z > 0 else 0.0, tied))
    return pd.DataFrame(out, columns=["ts_source", "ts_shape", "ts_mask", "ts_order", "ts_posterior", "ts_tied"])


_MIXTURE_SCHEMA = "ts_source string, ts_shape string, ts_mask string, ts_order string, ts_posterior double, ts_tied boolean"


def order_posteriors(dissected: DataFrame, source: str, date_order: str, declared_counts: float = DECLARED_COUNTS) -> DataFrame:
    """Per (source, shape, set of valid parses): the order chosen, its posterior, whether it is tied.

    Counts are aggregated before the per-source step, so a group there has at most
    11 shapes x 16 masks rows.
    """
    counts = (
        dissected.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("ts_source"), "ts_shape", "ts_mask")
        .agg(F.count("*").alias("n"), F.max(date_order).alias("declared"))
    )
    return counts.groupBy("ts_source").applyInPandas(lambda pdf: _mixture(pdf, declared_counts), _MIXTURE_SCHEMA)


def zone_letters(zones: list[str]) -> list[tuple[str, str, int]]:
    """(zone, letters, minutes east of UTC) for each zone's own abbreviations over recent years."""
    rows = []
    for zone in zones:
        try:
            tz = ZoneInfo(zone)
        except Exception:
            continue
        own = {}
        for k in range(0, 365 * 6, 15):
            at = datetime(2021, 1, 1, tzinfo=timezone.utc) + timedelta(days=k)
            local = at.astimezone(tz)
            own[local.tzname()] = int(local.utcoffset().total_seconds() // 60)
        rows += [(zone, k, v) for k, v in ({**EXTRA_LETTERS, **own}).items() if k and k.isalpha()]
    return rows


def normalise_timestamps(df: DataFrame, value: str, source: str, zone: str, date_order: str, zones: DataFrame | None = None, declared_counts: float = DECLARED_COUNTS) -> DataFrame:
    """Adds ``ts_normal`` (``YYYY-MM-DD`` or ``...T...Z``), ``ts_status``, ``ts_order`` and ``ts_posterior``.

    ``source`` names the column that identifies who wrote the value; ``zone`` and ``date_order`` hold
    the IANA zone and the declared order of that source (either may be null). ``zones`` is a dimension
    table with the column ``zone``, where there is one; without it the values' own zones are listed.
    ``declared_counts`` is the weight of the declared order in values; without bound (``math.inf``) it decides
    wherever it gives a date.
    """
    spark = df.sparkSession
    zone_names = df if zones is None else zones
    df = dissect(df, value).withColumn("ts_mask", _mask())
    post = cut(order_posteriors(df, source, date_order, declared_counts))
    small = post.count() <= BROADCAST_ROWS
    df = df.withColumn("ts_source", F.coalesce(F.col(source).cast("string"), F.lit("")))
    df = df.join(F.broadcast(post) if small else post, ["ts_source", "ts_shape", "ts_mask"], "left")

    # Distinct zones are bounded by the time-zone database (about 600 names).
    zones = sorted(r[0] for r in zone_names.select(zone).where(F.col(zone).isNotNull()).distinct().limit(MAX_ZONES + 1).collect())
    if len(zones) > MAX_ZONES:
        raise ValueError(f"more than {MAX_ZONES} names of time zones")
    letters = spark.createDataFrame(zone_letters(zones) + [("", k, v) for k, v in EXTRA_LETTERS.items()], "ts_zone string, ts_letters string, ts_minutes int")
    known = F.when(F.col(zone).isin(zones) if zones else F.lit(False), F.col(zone)).otherwise("")
    df = df.withColumn("ts_zone", known).withColumn("ts_letters", F.upper(F.trim(F.translate(F.col("ts_time")[6], "[]()", ""))))
    df = df.join(F.broadcast(letters), ["ts_zone", "ts_letters"], "left")

    r = _readings()
    pick = lambda i: F.coalesce(*[F.when(F.col("ts_order") == o, r[o][i]) for o in ORDERS])
    named = F.col("ts_shape").isin("named_dmy", "named_mdy", "named_ymd")
    # Each step is a projection of its own: parts used more than once are computed once and the generated code stays small.
    df = df.withColumns(
        {
            "ts_y": F.when(named, _year(F.col("ts_c"))).otherwise(pick(1)),
            "ts_m": F.when(named, F.col("ts_b")).otherwise(pick(2)),
            "ts_dd": F.when(named, F.col("ts_a")).otherwise(pick(3)),
        }
    )
    y, m, d = F.col("ts_y"), F.col("ts_m"), F.col("ts_dd")
    serial = F.date_add(F.lit("1899-12-30").cast("date"), F.when(F.col("ts_shape") == "serial", F.col("ts_a"))).cast("string")
    df = df.withColumn("ts_day", F.when(F.col("ts_shape") == "serial", serial).when(_valid(y, m, d), F.format_string("%04d-%02d-%02d", y, m, d)))
    df = df.withColumn("ts_z", F.trim(F.translate(F.col("ts_time")[6], "[]()", "")))

    z, east, tm = F.col("ts_z"), F.col("ts_minutes"), F.col("ts_time")
    offset = r"^(?i:UTC|GMT)?\s*([+-]\d{1,2}):?(\d{2})?$"
    suffix = (
        F.when(z == "", F.when(F.col("ts_zone") != "", F.concat(F.lit(" "), F.col("ts_zone"))))
        .when(z.rlike(offset), F.regexp_replace(F.regexp_replace(z, offset, "$1:$2"), ":$", ":00"))
        .when(east.isNotNull(), F.format_string("%s%02d:%02d", F.when(east < 0, "-").otherwise("+"), F.expr("abs(ts_minutes) div 60"), F.expr("abs(ts_minutes) % 60")))
        .when(z.contains("/"), F.concat(F.lit(" "), z))
    )
    hour, half = _int(tm[1]), F.upper(tm[5])
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "P", 12).otherwise(0))
    df = df.withColumns({"ts_suffix": suffix, "ts_hour": hour})
    clock = F.format_string(" %02d:%s:%s.%s", F.col("ts_hour"), tm[2], F.when(tm[3] == "", "00").otherwise(tm[3]), F.rpad(F.substring(tm[4], 1, 6), 6, "0"))
    # A cast with a region reads a repeated local time as the first one and a skipped one with the offset before the change.
    stamp = F.when(F.col("ts_day").isNotNull() & F.col("ts_hour").isNotNull() & F.col("ts_suffix").isNotNull(), F.concat(F.col("ts_day"), clock, F.col("ts_suffix")))
    df = df.withColumn("ts_stamp", stamp)
    micros = (
        F.when(F.col("ts_shape") == "epoch_s", F.col("ts_d").try_cast("bigint") * 1_000_000)
        .when(F.col("ts_shape") == "epoch_ms", F.col("ts_d").try_cast("bigint") * 1_000)
        .otherwise(F.unix_micros(F.col("ts_stamp").try_cast("timestamp")))
    )
    df = df.withColumn("ts_micros", micros)
    # A zone-less timestamp prints the same in every session zone.
    instant = F.expr("date_format(timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(ts_micros as decimal(20, 0)) / 1000000), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")")
    normal = F.when(F.col("ts_micros").isNotNull(), instant).when(F.col("ts_time").isNull(), F.col("ts_day"))
    status = (
        F.when(normal.isNotNull() & F.coalesce(F.col("ts_tied"), F.lit(False)), "ambiguous")
        .when(normal.isNotNull(), "ok")
        .when(F.col("ts_day").isNotNull(), "unresolved")
        .otherwise("none")
    )
    df = df.withColumn("ts_normal", normal).withColumn("ts_status", status)
    return df.drop("ts_t", "ts_d", "ts_shape", "ts_a", "ts_b", "ts_c", "ts_time", "ts_mask", "ts_source", "ts_tied", "ts_zone", "ts_letters", "ts_minutes", "ts_micros", "ts_day", "ts_y", "ts_m", "ts_dd", "ts_z", "ts_suffix", "ts_hour", "ts_stamp")


def read_dates(facts: DataFrame, sites: DataFrame, declared: bool = True) -> DataFrame:
    """(job_id, field_name, raw, ts_normal, ts_status, ts_order, ts_posterior) of every filled invoice and due date.

    ``declared`` takes a site's date order as given; else only the values of the site speak for an order.
    """
    long = facts.select("job_id", "site_id", F.explode(F.create_map(F.lit("invoice_date"), F.col("invoice_date"), F.lit("due_date"), F.col("due_date"))).alias("field_name", "raw"))
    long = long.where(F.trim("raw") != "").distinct()
    # intake_sites is a fixed dimension of ten rows.
    long = long.join(F.broadcast(sites.select("site_id", "time_zone", "date_order")), "site_id", "left")
    long = long if declared else long.withColumn("date_order", F.lit(None).cast("string"))
    return normalise_timestamps(long, "raw", "site_id", "time_zone", "date_order", zones=sites, declared_counts=math.inf)


def invoice_dates(facts: DataFrame, sites: DataFrame) -> DataFrame:
    """(job_id, field_name, normal_form) for every invoice and due date that holds an existing date."""
    out = read_dates(facts, sites)
    # explode, not a filter: a filter would be pushed through the projections and repeat their expressions.
    kept = F.explode(F.array_compact(F.array("ts_normal"))).alias("normal_form")
    return out.select("job_id", "field_name", kept).distinct()
