"""Deduplicating new batches against all history with a segment index for edit distance.

Every accepted record is cut into a fixed number of segments of its invoice number, its tax number
and its total; a segment is stored with the string's length and its position. A string within
``EDITS`` edits of another leaves at least one of that string's ``EDITS + 1`` segments intact, so a new
record probes the index with the few substrings that can be such a segment, and only what meets is
verified. A segment of one field is always keyed together with another field (or a segment of it),
so no key is shared by all records of one vendor however many they are. Where a field is missing, the
key says so, and meets only records with which the field is missing on a side:

    B  total, its digits in order and its neighbourhood, with the day        (number different or missing)
    N  number, with the total, its digits in order and its neighbourhood     (another day, or missing)
    T  total, with each segment of the number, day missing                   (number different)
    S  total, with the last digits of the number, day missing                (a part of the number dropped)
    D  number, with the day, total missing         E  number, with the day   (total different)
    R  day, with the number less one character or its last digits            (number different, total missing)
    X  number, with the tax number, total missing                            (another day)
    M  number, total missing and day missing       G  total, number missing and day missing

Together they reach every pair that ``same_invoice`` accepts (tested).

The index is stored: ``append_batch`` adds one batch's segments and comparable records to a folder, each
partitioned by batch, and ``find_repeats`` looks a batch up in what is stored, so adding a batch reads
segments and the few records that meet, never the facts of older batches. Appending a batch again
replaces that batch only. Records of one batch that agree in all comparable fields are one entry with its
jobs beside it, so a thousand copies of one record cost as much as one. ``verify`` first bounds the edit
distances of number, tax number and total and the days between on generated code; what is left is
compared with date and parties, which numbers reused by a vendor and equal recurring totals need.

Defined results: null, blank and unreadable fields make no segments; a record without number and
total finds and is found by nothing; rows delivered twice are one job; a record is never paired with
itself; ties do not matter, every pair that verifies is returned; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from datetime import date
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.names import compatible, parse_name
from ledgerloom.llm.text import distance
from ledgerloom.operators.timestamps import normalise_timestamps
from ledgerloom.session import shared_path, spread

#: Edits that a field may be away; it is then cut into one segment more.
EDITS = 2

ACCEPTED = ("done", "reviewed")

#: The comparable forms of a record.
PARTS = ["number", "serial", "tax", "total", "day", "buyer", "vendor"]

# Letters that scanners put for digits, and notes that people add to an invoice number.
_DIGITS = str.maketrans("OQDILZSBG", "000112586")
_NOTE_BEFORE = re.compile(r"^\s*(?:(?:tax\s+)?invoice|inv|bill|no|num|number|ti|ref|nr)?\s*(?:no)?\s*[.#:/-]*\s+|^\s*(?:inv|no|ti|bill|ref)\s*[.#:/-]+\s*(?=[A-Za-z0-9])|^\s*#\s*", re.I)
_NOTE_AFTER = re.compile(r"(?:[\s/(*-]*\b(?:copy|dup|duplicate|original|orig|rev|o|d|c)\b[.)]*|[\s*]+)+$", re.I)


def number_core(raw: object) -> str:
    """An invoice number without notes, separators and padding, lookalikes as digits."""
    if not isinstance(raw, str) or not raw.strip():
        return ""
    s = raw.strip().upper()
    for _ in range(2):
        cut_ = _NOTE_AFTER.sub("", s)
        s = cut_ if re.search(r"\d", cut_) else s
        front = _NOTE_BEFORE.sub("", s)
        # "INV-0183" is a number of its own; "INV-GST00664" and "INV-MIM/26-27/5" carry a note.
        if front != s and re.search(r"\d", front) and (re.search(r"[A-Z]{2}", front) or not re.match(r"^\s*[A-Z]{3}-", s)):
            s = front
    parts = re.findall(r"[A-Z0-9]+", s)
    out = []
    for p in parts:
        head = re.match(r"[A-Z]*?(?=[A-Z]?\d|$)", p).group(0) if re.search(r"\d", p) else p
        tail = p[len(head) :].translate(_DIGITS)
        out.append(head + (tail.lstrip("0") or "0" if tail.isdigit() else tail))
    return re.sub(r"(?<=[A-Z])0+(?=\d)", "", "".join(out))


def serial_of(raw: object) -> str:
    """The last group of digits of an invoice number, without padding: what is left if a middle part is dropped."""
    if not isinstance(raw, str):
        return ""
    groups = re.findall(r"\d+", _NOTE_AFTER.sub("", raw.strip()))
    return groups[-1].lstrip("0") if groups else ""


def tax_core(raw: object) -> str:
    """A tax number in its shape 99AAAAA9999A..., lookalikes brought to what the position asks for."""
    if not isinstance(raw, str):
        return ""
    s = re.sub(r"[^A-Z0-9]", "", raw.upper())
    if len(s) < 13:
        return ""
    to_letter = str.maketrans("0125689", "OIZSGBG")
    return s[:2].translate(_DIGITS) + s[2:7].translate(to_letter) + s[7:11].translate(_DIGITS) + s[11:].translate(_DIGITS)


def total_digits(v: object) -> str:
    return str(round(abs(v) * 100)) if isinstance(v, (int, float)) and v == v and abs(v) < 1e15 else ""


def segments(s: str) -> list[tuple[int, str]]:
    """(position, text) of the ``EDITS + 1`` even segments of a string."""
    m, n, out, at = EDITS + 1, len(s), [], 0
    for i in range(m):
        k = n // m + (1 if i >= m - n % m else 0)
        out.append((i, s[at : at + k]))
        at += k
    return out


def probes(s: str) -> set[tuple[int, int, str]]:
    """(length, position, text) of all substrings that may equal a segment of a string within ``EDITS``."""
    n, m, out = len(s), EDITS + 1, set()
    for size in range(max(1, n - EDITS), n + EDITS + 1):
        at, shift = 0, n - size
        for i in range(m):
            k = size // m + (1 if i >= m - size % m else 0)
            # Multi-match-aware window: i edits may lie before the segment, EDITS - i after it.
            lo = max(0, at - i, at + shift - (EDITS - i))
            hi = min(n - k, at + i, at + shift + (EDITS - i))
            for p in range(lo, hi + 1):
                out.add((size, i, s[p : p + k]))
            at += k
    return out


def _one_off(s: str) -> set[str]:
    """A string and what is left of it without one character: strings one edit or swap apart share one of these."""
    return {s} | {s[:i] + s[i + 1 :] for i in range(len(s))}


def _keys(number: str, serial: str, tax: str, total: str, day: str, index: bool) -> set[int]:
    narrow = [f"{len(number)}.{i}.{t}" for i, t in segments(number)] if number else []

    def wide() -> list[str]:
        return [f"{size}.{i}.{t}" for size, i, t in probes(number)]

    def missing(*fields: str) -> list[str]:
        """Index: which of the fields this record lacks; probe: what the other must lack so that each is missing on a side."""
        own = "".join("01"[not f] for f in fields)
        return [own] if index else ["".join(m) for m in product(*("01" if x == "1" else "1" for x in own))]

    def days(own: bool) -> list[int]:
        """The pair of days that a record lies in, or the two pairs with what is at most a day away."""
        on = date.fromisoformat(day).toordinal()
        return [on // 2] if own else [(on - 1) // 2, (on + 1) // 2]

    # Totals that differ by one edit, by the order of digits, or by at most 100 in the last places.
    step = int(total) // 101 if total else 0
    alike = [*_one_off(total), "s" + "".join(sorted(total)), *(f"c{step + d}" for d in ((0,) if index else (-1, 0, 1)))] if total else []
    # A field that must be missing on a side is seldom missing: the side that lacks it asks widely, or is kept widely, and the other gives its own form.
    own_form, lacking = ("0", "1") if index else ("1", "0")
    keys = []
    if total and number:
        if index or day:
            keys += [f"T{own_form}|{total}|{s}" for s in narrow]
        if not day:
            keys += [f"T{lacking}|{total}|{s}" for s in wide()]
        keys += [f"N|{number}|{s}" for s in alike]
        keys += [f"S|{total}|{serial}|{m}" for m in missing(day)] if serial else []
    if number:
        keys += [f"M|{number}|{m}" for m in missing(total, day)]
        keys += [f"X|{number}|{tax[:14]}|{m}" for m in missing(total)] if tax else []
    if number and day:
        keys += [f"D|{d}|{number}|{m}" for d in days(index) for m in missing(total)]
        if tax:
            keys += [f"E|{d}|{number}" for d in days(index)]
            short = [*_one_off(number), *([f"s{serial}"] if serial else [])]
            if index or total:
                keys += [f"R{own_form}|{d}|{s}" for s in short for d in days(True)]
            if not total:
                keys += [f"R{lacking}|{d}|{s}" for s in short for d in days(False)]
    if total:
        keys += [f"G|{total}|{m}" for m in missing(number, day)]
        # Totals that differ need tax numbers that are alike, so both sides have one.
        keys += [f"B|{d}|{t}" for d in days(index) for t in (alike if tax else [total])] if day else []
    return {xxhash.xxh64_intdigest(k) - (1 << 63) for k in keys}


def _key_rows(records: DataFrame, index: bool) -> DataFrame:
    fields = ["number", "serial", "tax", "total", "day"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 2_000):
                some = pdf.iloc[at : at + 2_000]
                keys = [_keys(*row, index) for row in zip(*(some[c] for c in fields))]
                n = [len(k) for k in keys]
                yield pd.DataFrame({"key": np.fromiter((k for ks in keys for k in ks), np.int64, sum(n)), "entry": np.repeat(some["entry"].to_numpy(), n), "batch_no": np.repeat(some["batch_no"].to_numpy(), n)})

    return records.select("entry", "batch_no", *fields).mapInPandas(run, "key bigint, entry bigint, batch_no int")


def prepare(facts: DataFrame, sites: DataFrame) -> DataFrame:
    """One record per job with the comparable forms of its fields; ``day`` is the invoice date's UTC day."""
    once = facts.groupBy("job_id").agg(F.min(F.struct(*[c for c in facts.columns if c != "job_id"])).alias("r")).select("job_id", "r.*")
    once = once.join(F.broadcast(sites.select("site_id", "time_zone", "date_order")), "site_id", "left")
    dated = normalise_timestamps(once, "invoice_date", "site_id", "time_zone", "date_order", zones=sites, declared_counts=math.inf)
    cols = ["job_id", "batch_no", "status", "invoice_number", "vendor_gstin", "grand_total", "buyer_name", "vendor_name", "ts_normal"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(
                {
                    "job_id": pdf["job_id"], "batch_no": pdf["batch_no"], "accepted": pdf["status"].isin(ACCEPTED),
                    "number": pdf["invoice_number"].map(number_core), "serial": pdf["invoice_number"].map(serial_of), "tax": pdf["vendor_gstin"].map(tax_core), "total": pdf["grand_total"].map(total_digits),
                    "day": pdf["ts_normal"].map(lambda x: x[:10] if isinstance(x, str) else ""),
                    "buyer": pdf["buyer_name"].fillna("").str.strip(), "vendor": pdf["vendor_name"].fillna("").str.strip(),
                }
            )

    schema = "job_id string, batch_no int, accepted boolean, number string, serial string, tax string, total string, day string, buyer string, vendor string"
    return dated.select(*cols).mapInPandas(run, schema)


def entries(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, jobs of entries): records of one batch and standing that agree in all comparable fields are one entry."""
    named = records.withColumn("entry", F.xxhash64("batch_no", "accepted", *PARTS))
    # Equal rows lie together, so neither step moves a row again.
    named = spread(named.select("entry", "batch_no", "accepted", *PARTS, "job_id"), "entry")
    return named.drop("job_id").dropDuplicates(), named.select("entry", "batch_no", "job_id").dropDuplicates()


def build_segments(held: DataFrame) -> DataFrame:
    """(key, entry, batch_no): the index rows of the accepted entries, to be appended to the stored index."""
    return _key_rows(held.where("accepted"), index=True)


def append_batch(records: DataFrame, path: str) -> None:
    """Adds the accepted records of one or more batches to the index in ``path``; a batch that is there already is replaced."""
    held, jobs = entries(records.where("accepted"))
    # Small batches share a task, a large one is split: by ranges before its segments are made, so that these are never moved, or by adaptive execution.
    ranges = held.repartitionByRange(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), "batch_no", "entry")
    for name, df in (("segments", build_segments(ranges)), ("records", held.hint("rebalance", "batch_no")), ("jobs", jobs.hint("rebalance", "batch_no"))):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_no").parquet(f"{path}/{name}")


#: Columns of the stored tables, with the batch last as it is their partition.
_STORED = {"segments": "key bigint, entry bigint, batch_no int", "records": "entry bigint, accepted boolean, " + ", ".join(f"{c} string" for c in PARTS) + ", batch_no int", "jobs": "entry bigint, job_id string, batch_no int"}


def stored(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(_STORED[name]).parquet(f"{path}/{name}")


def probe(asked: DataFrame, index: DataFrame) -> DataFrame:
    """(entry_a, entry_b): accepted entries of earlier batches that an entry may repeat."""
    mine = _key_rows(asked, index=False).withColumnsRenamed({"entry": "entry_b", "batch_no": "batch_b"})
    held = index.withColumnsRenamed({"entry": "entry_a", "batch_no": "batch_a"})
    return held.join(mine, "key").where(F.col("batch_a") < F.col("batch_b")).select("entry_a", "entry_b").distinct()


def find_repeats(records: DataFrame, path: str) -> DataFrame:
    """(job_id_a, job_id_b): each of the records with the accepted jobs of earlier batches in the index that record the same invoice."""
    spark = records.sparkSession
    asked, jobs = entries(records)
    pairs = verify(probe(asked, stored(spark, path, "segments")), stored(spark, path, "records"), asked)
    a = stored(spark, path, "jobs").select(F.col("entry").alias("entry_a"), F.col("job_id").alias("job_id_a"))
    return pairs.join(a, "entry_a").join(jobs.select(F.col("entry").alias("entry_b"), F.col("job_id").alias("job_id_b")), "entry_b").select("job_id_a", "job_id_b")


def batch_pairs(records: DataFrame, path: str | None = None) -> DataFrame:
    """All batches of ``records`` against all earlier ones; the index is kept in ``path``, else in the shared folder."""
    path = path or shared_path(records.sparkSession, "segments")
    append_batch(records, path)
    return find_repeats(records, path)


def _days(a: str, b: str) -> int:
    return abs((date.fromisoformat(a) - date.fromisoformat(b)).days)


def _field(a: str, b: str, edits: int) -> str:
    if not a or not b:
        return "none"
    return "same" if a == b else "near" if distance(a, b, edits) <= edits else "other"


#: Names of parties recur; a worker parses each once while it stays in a bounded cache.
_parsed = lru_cache(50_000)(parse_name)


def _party(a: str, b: str) -> str:
    if not a or not b:
        return "none"
    if a == b:
        return "same"
    pa, pb = _parsed(a), _parsed(b)
    if compatible(pa, pb):
        return "near"
    ca, cb = "".join(pa[1]), "".join(pb[1])
    return "near" if min(len(ca), len(cb)) >= 8 and distance(ca, cb, 3) <= 3 else "other"


def same_invoice(a: dict, b: dict) -> bool:
    number = _field(a["number"], b["number"], EDITS)
    if number == "near" and distance(a["number"], b["number"], 1) > 1:
        number = "far"
    if number in ("other", "far"):
        sa, sb = a["serial"], b["serial"]
        if sa and sa == sb and (a["number"].startswith(b["number"][:2]) or a["number"].endswith(b["number"]) or b["number"].endswith(a["number"])):
            number = "near"  # a part in the middle or in front was left out
    tax = _field(a["tax"][:14], b["tax"][:14], EDITS)
    total = _field(a["total"], b["total"], 1)
    if total == "other":
        close = abs(int(a["total"]) - int(b["total"])) <= 100
        total = "near" if close or (sorted(a["total"]) == sorted(b["total"]) and distance(a["total"], b["total"], 3) <= 3) else "other"
    day = "none" if not a["day"] or not b["day"] else "same" if _days(a["day"], b["day"]) <= 1 else "other"
    if tax == "other" or number in ("other", "far") and not (total == "same" and day == "same" and number == "far"):
        return False
    # What no clause below accepts whatever the parties are, before names are parsed.
    if number != "same" and (day == "other" or total not in ("same", "near") and (number == "none" or total == "other")):
        return False
    return _clauses(a, b, number, tax, total, day) and (tax != "none" or _party(a["vendor"], b["vendor"]) != "other")


def _clauses(a: dict, b: dict, number: str, tax: str, total: str, day: str) -> bool:
    if number == "same" and total in ("same", "near") and day == "same":
        return True  # whatever the buyer, so no name is parsed
    if tax not in ("same", "near") and (number == "same" and total == "other" or number == "none" and (total != "same" or day != "same")):
        return False
    buyer = _party(a["buyer"], b["buyer"])
    if number == "same":
        if total == "same":
            return day != "other" and (buyer != "other" or day == "same") or buyer in ("same", "near")
        if total == "near":
            return day == "same" or buyer in ("same", "near")
        if total == "none":
            return (day == "same" and buyer != "other") or (day == "none" and buyer in ("same", "near")) or (buyer == "same" and day == "other" and tax == "same" and len(a["number"]) > 6)
        return day == "same" and buyer in ("same", "near") and tax in ("same", "near")
    if number in ("near", "far"):
        if total == "same":
            return day == "same" and buyer != "other" or (number == "near" and buyer in ("same", "near") and day == "none")
        return number == "near" and total in ("near", "none") and day == "same" and buyer in ("same", "near") and tax != "none"
    # The number is missing on one side.
    return total == "same" and day == "same" and buyer in ("same", "near") and tax != "other" or (total == "same" and tax in ("same", "near") and day == "same" and buyer == "none") or (
        total == "same" and tax in ("same", "near") and buyer in ("same", "near") and day == "none"
    ) or (total == "near" and tax in ("same", "near") and day == "same" and buyer in ("same", "near"))


def _within_bounds(a: str, b: str) -> Column:
    """What ``same_invoice`` needs at least, by edit distances alone. A swap counts as one there and as two here."""
    f = lambda side, c: F.col(f"{side}.{c}")
    missing = lambda c: (f(a, c) == "") | (f(b, c) == "")
    close = lambda x, y, n: F.levenshtein(x, y, n) >= 0
    tax = missing("tax") | close(F.substring(f(a, "tax"), 1, 14), F.substring(f(b, "tax"), 1, 14), 2 * EDITS)
    day = missing("day") | (F.abs(F.datediff(f(a, "day").cast("date"), f(b, "day").cast("date"))) <= 1)
    digits = lambda side: F.array_sort(F.split(f(side, "total"), ""))
    total = missing("total") | close(f(a, "total"), f(b, "total"), 2) | (F.abs(f(a, "total").cast("bigint") - f(b, "total").cast("bigint")) <= 100) | (digits(a) == digits(b))
    number = missing("number") | close(f(a, "number"), f(b, "number"), 2 * EDITS) | (f(a, "serial") == f(b, "serial"))
    return tax & (((f(a, "number") == f(b, "number")) & ~missing("number")) | (day & total & number))


def verify(candidates: DataFrame, held: DataFrame, asked: DataFrame) -> DataFrame:
    """(entry_a, entry_b) of the candidates that record one invoice."""
    p = F.struct(*PARTS)
    both = candidates.join(held.select(F.col("entry").alias("entry_a"), p.alias("a")), "entry_a").join(asked.select(F.col("entry").alias("entry_b"), p.alias("b")), "entry_b").where(_within_bounds("a", "b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [same_invoice(x, y) for x, y in zip(pdf["a"], pdf["b"])]
            yield pdf.loc[keep, ["entry_a", "entry_b"]]

    return spread(both, "entry_a", "entry_b").mapInPandas(run, "entry_a bigint, entry_b bigint")
