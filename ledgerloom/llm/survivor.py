"""Best representative of each duplicate group: one surviving value per field by truth discovery.

Every reading and every candidate it lists is a claim (job, field, source, value). A claim's source is
who read it if the reading is sure, otherwise how it came (an unsure reading, a candidate) and in which
band of stated confidence. Alternately

    support of a value   = sum of the log-odds of its claims' sources, plus its plausibility
    reliability of a source = mean posterior of the values it claims

until no reliability moves by more than ``TOLERANCE``. A second pass does the same with sources known to copy: two readers that agree on values which turned
out wrong are dependent, and a value's later claims count by what they say independently of earlier
ones. Trusted kinds of claims (a person's correction, a
repeated run) keep their stated reliability: where they speak, the machines mostly agree on an error.
A value that is only the beginning of a longer claimed value supports the longer one (the most complete
value wins), placeholders are no claims, and forms that the field cannot have are held to be implausible.

Groups with the same pattern of claims have the same posterior, so learning runs over distinct patterns
with their counts, not over groups, and over arrays of a whole Arrow batch, not claim by claim. Claims
are counted by (group, source, value) before a group is
gathered, so repeated readings of one hot group shrink to its distinct values; reliabilities are a table of a few dozen rows (bounded by
sources x kinds x bands, checked). Defined results: groups without any claim give a null value; ties go
to the smaller string; rows with the same reading id are one reading; null fields and sources are a field
and a source of their own, and names of sources may hold any character; empty tables give empty results;
a reliability that still moves after ``MAX_ROUNDS`` rounds is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import spread, write_out

#: Kinds of claims whose reliability is given, not learned.
TRUSTED = {"human_corrected": 0.999999, "rerun": 0.99999}

#: Bands of stated confidence; a reading counts as sure from the first bound on.
BANDS = (0.55, 0.7)

#: From round ``DAMPED`` on a reliability goes half the way, so that none swings to and fro for ever.
TOLERANCE, DAMPED, MAX_ROUNDS, MAX_SOURCES = 1e-3, 25, 200, 1_000

#: Wrong values a source could give instead of the right one, if sources err independently.
FALSE_VALUES = 10

#: Log-odds taken from a value whose form the field cannot have, and share of support passed to a longer form.
IMPLAUSIBLE, PREFIX_SHARE = 1.5, 1.0

# What systems write for "nothing".
PLACEHOLDERS = ["", "-", "--", "n/a", "na", "n.a.", "null", "none", "nil", "nan", "unknown", "not available", "?", "??", "???", "tbd"]

#: What all groups with the same claims share.
PATTERN = ["sids", "at", "times", "flags", "ext"]


def plausible(field: Column, text: Column) -> Column:
    """Could the field hold this form?"""
    day, month, year = (F.regexp_extract(text, r"^(\d{2})/(\d{2})/(\d{4})$", i).try_cast("int") for i in (1, 2, 3))
    last = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, 29).otherwise(31)
    dated = day.between(1, last) & month.between(1, 12) & year.between(1990, 2100)
    ok = (
        F.when(field.endswith("gstin"), text.rlike(r"^\d{2}[A-Z]{5}\d{4}[A-Z][A-Z\d]Z[A-Z\d]$|^\d{2}[A-Z]{5}\d{4}[A-Z]\d[A-Z]\d[A-Z\d]?$|^\d{2}[A-Z]{5}\d{4}[A-Z\d]{4}$"))
        .when(field.isin("grand_total", "subtotal", "tax_amount"), text.rlike(r"^-?\d+\.\d{2}$"))
        .when(field.endswith("date"), F.coalesce(dated, ~text.rlike(r"^[\d/OIZSBGl]+$")))
        .when(field == "invoice_number", ~text.rlike(r"(?<![A-Za-z])[A-Za-z](?=\d)|(?<=\d)[A-Za-z]"))
        .otherwise(~text.rlike(r"[A-Za-z]\d|\d[A-Za-z]|[a-z][A-Z]"))
    )
    return F.coalesce(ok, F.lit(False))


def groups_of(readings: DataFrame) -> DataFrame:
    """(job_id, field_name, several, texts, sids, at, times, flags, ext) of every group, in one exchange.

    ``sids``, ``at`` and ``times`` are the source, the number of the text and the count of every claim,
    ``flags`` the plausibility of each text and ``ext`` the number of its longer form, -1 for none.
    """
    band = lambda c: F.when(c < BANDS[0], "low").when(c < BANDS[1], "mid").otherwise("high")
    own_sid = (
        F.when(F.col("source") == "human_corrected", "human_corrected")
        .when(F.col("selection_reason") == "rerun", "rerun")
        .when(F.coalesce("confidence", F.lit(0.0)) < BANDS[0], "value||low")
        .otherwise(F.concat(F.lit("value|"), F.coalesce("source", F.lit("?")), F.lit("|sure")))
    )
    filled = lambda t: F.when(~F.lower(F.trim(t)).isin(PLACEHOLDERS), t)
    own = F.array(F.struct(own_sid.alias("sid"), filled(F.col("value")).alias("text")))
    others = F.transform(F.coalesce("candidates", F.array()), lambda c: F.struct(F.concat(F.lit("candidate||"), band(F.coalesce(c["confidence"], F.lit(0.0)))).alias("sid"), filled(c["text"]).alias("text")))
    rows = spread(readings.select("job_id", "field_name", "reading_id", F.concat(own, others).alias("said")), "job_id", "field_name")
    # Equal to the exchange's keys or finer, so none of these steps moves a row again.
    rows = rows.dropDuplicates(["job_id", "field_name", "reading_id"]).select("job_id", "field_name", "reading_id", F.inline("said"))
    counted = rows.groupBy("job_id", "field_name", "sid", "text").agg(F.count("*").cast("int").alias("n"), F.min("reading_id").alias("lo"), F.max("reading_id").alias("hi"))
    counted = counted.withColumn("ok", plausible(F.col("field_name"), F.col("text")))
    claim = F.when(F.col("text").isNotNull(), F.struct("sid", "n", "ok", "text"))
    g = counted.groupBy("job_id", "field_name").agg((F.min("lo") < F.max("hi")).alias("several"), F.array_sort(F.collect_list(claim)).alias("c"))
    g = g.withColumn("forms", F.array_distinct(F.transform("c", lambda c: F.struct(c["text"].alias("text"), c["ok"].alias("ok")))))
    g = g.withColumns({"texts": F.col("forms")["text"], "flags": F.col("forms")["ok"]})
    # The longest plausible text that begins with this one; of equally long ones the larger.
    longer = lambda t: F.filter("forms", lambda x: x["ok"] & (F.length(x["text"]) > F.length(t)) & (F.length(t) >= 2) & x["text"].startswith(t))
    best = lambda xs: F.array_max(F.transform(xs, lambda x: F.struct(F.length(x["text"]).alias("n"), x["text"].alias("t"))))["t"]
    none = F.array(F.lit(-1))
    ext = F.when(F.size("texts") < 2, F.slice(none, 1, F.size("texts"))).otherwise(F.transform("texts", lambda t: F.coalesce(F.array_position("texts", best(longer(t))), F.lit(0)).cast("int") - 1))
    at = F.transform("c", lambda c: F.array_position("texts", c["text"]).cast("int") - 1)
    return g.select("job_id", "field_name", "several", "texts", F.col("c")["sid"].alias("sids"), at.alias("at"), F.col("c")["n"].alias("times"), "flags", ext.alias("ext"))


def _logit(p: float, false_values: int = 1) -> float:
    p = min(max(p, 0.02), 0.999999)
    return math.log(false_values * p / (1 - p))


def _reader(sid: str) -> str:
    """Who read it, of a sure reading; its name may hold any character."""
    return sid[len("value|") : -len("|sure")] if sid.startswith("value|") and sid.endswith("|sure") else ""


def _start(sid: str) -> float:
    """Before anything is learned a claim counts by its stated confidence."""
    if sid in TRUSTED:
        return TRUSTED[sid]
    kind, _, rest = sid.partition("|")
    return {"low": 0.25, "mid": 0.5, "high": 0.75, "sure": 0.65}[rest.rpartition("|")[2]] + (0.1 if kind == "value" and rest == "|low" else 0.0)


class Claims:
    """The claims of one Arrow batch of patterns as flat arrays; ``sids`` is the sorted list of all sources."""

    def __init__(self, batch: pa.RecordBatch, sids: list[str], readers: list[str]):
        col = {c: batch.column(c) for c in PATTERN}
        flat = lambda c: col[c].flatten().to_numpy(zero_copy_only=False)
        n_claims, n_texts = (np.asarray(pc.list_value_length(col[c])).astype(np.int64) for c in ("sids", "flags"))
        self.first = np.concatenate([[0], np.cumsum(n_texts)])
        self.row_of_text = np.repeat(np.arange(len(n_texts)), n_texts)
        self.row = np.repeat(np.arange(len(n_claims)), n_claims)
        self.text = self.first[self.row] + flat("at").astype(np.int64)
        self.sid = np.asarray(pc.index_in(col["sids"].flatten(), value_set=pa.array(sids, pa.string()))).astype(np.int64)
        self.n = flat("times").astype(float)
        self.ok = flat("flags").astype(bool)
        ext = flat("ext").astype(np.int64)
        self.short = np.flatnonzero(ext >= 0)
        self.long = self.first[self.row_of_text[self.short]] + ext[self.short]
        place = {r: i for i, r in enumerate(readers)}
        self.reader = np.array([place.get(_reader(s), -1) for s in sids], dtype=np.int64)[self.sid] if len(sids) else np.empty(0, np.int64)

    def posteriors(self, weight: np.ndarray, copied: np.ndarray) -> np.ndarray:
        """Posterior of every text."""
        # A source that repeats itself is hardly more certain.
        w = weight[self.sid] * (1 + np.log(self.n))
        if copied.any():
            place = np.empty(len(weight), np.int64)
            place[np.lexsort((np.arange(len(weight)), -weight))] = np.arange(len(weight))
            read = np.flatnonzero((self.reader >= 0) & (w > 0))
            read = read[np.argsort(self.text[read] * len(weight) + place[self.sid[read]], kind="stable")]
            text, reader, own = self.text[read], self.reader[read], np.ones(len(read))
            for k in range(1, len(read)):
                met = np.flatnonzero(text[k:] == text[:-k])
                if not len(met):
                    break
                own[met + k] *= (1 - copied[reader[met + k], reader[met]]) ** 3
            w[read] *= own
        own = np.bincount(self.text, w, minlength=len(self.ok))
        support = np.where(self.ok, own, own - IMPLAUSIBLE)
        np.add.at(support, self.long, PREFIX_SHARE * np.maximum(own[self.short], 0.0))
        # The longest form has no longer one, so no order among these matters.
        support[self.short] = np.minimum(support[self.short], support[self.long] - 2.0)
        if not len(support):
            return support
        filled = np.flatnonzero(np.diff(self.first))
        top = np.zeros(len(self.first) - 1)
        top[filled] = np.maximum.reduceat(support, self.first[filled])
        e = np.exp(np.maximum(support - top[self.row_of_text], -60))
        return e / np.bincount(self.row_of_text, e, minlength=len(top))[self.row_of_text]

    def votes(self, p: np.ndarray, times: np.ndarray, n_sids: int) -> tuple[np.ndarray, np.ndarray]:
        said = self.n * times[self.row]
        return np.bincount(self.sid, p[self.text] * said, minlength=n_sids), np.bincount(self.sid, said, minlength=n_sids)

    def agreement(self, p: np.ndarray, times: np.ndarray, n_readers: int) -> tuple[np.ndarray, np.ndarray]:
        """(wrong values shared, values shared wrongly or disagreed on) of every two readers, the smaller first."""
        read = np.flatnonzero(self.reader >= 0)
        read = read[np.lexsort((self.text[read], self.reader[read], self.row[read]))]
        row, reader, text = self.row[read], self.reader[read], self.text[read]
        hits, n = np.zeros(n_readers * n_readers), np.zeros(n_readers * n_readers)
        for k in range(1, len(read)):
            met = np.flatnonzero(row[k:] == row[:-k])
            if not len(met):
                break
            met = met[reader[met] != reader[met + k]]
            pair = reader[met] * n_readers + reader[met + k]
            same = text[met] == text[met + k]
            wrong = np.where(same, 1 - p[text[met]], 0.0)
            hits += np.bincount(pair, wrong * times[row[met]], minlength=len(hits))
            n += np.bincount(pair, np.where(same, wrong, 1.0) * times[row[met]], minlength=len(n))
        return hits, n


def weights_of(rel: np.ndarray, copied: np.ndarray) -> np.ndarray:
    """Votes: plain log-odds while sources count as unrelated, against many possible errors once copying is known."""
    return np.array([_logit(p, FALSE_VALUES if copied.any() else 1) for p in rel])


def discover(patterns: DataFrame) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """(sources, readers, reliability of every source, dependence of every two readers), learned over all (pattern, n)."""
    sids = sorted(r[0] for r in patterns.select(F.explode("sids")).distinct().limit(MAX_SOURCES + 1).collect())
    if len(sids) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources of claims")
    readers = sorted({_reader(s) for s in sids} - {""})
    start = np.array([_start(s) for s in sids])
    given = np.array([s in TRUSTED for s in sids], dtype=bool)
    rel, copied = start.copy(), np.zeros((len(readers), len(readers)))
    n_readers = len(readers)
    for independent in (True, False):
        for turn in range(MAX_ROUNDS):
            weight = weights_of(rel, copied)

            def run(batches: Iterator[pa.RecordBatch], weight: np.ndarray = weight, copied: np.ndarray = copied) -> Iterator[pa.RecordBatch]:
                total: dict[int, np.ndarray] = {}
                for b in batches:
                    c, times = Claims(b, sids, readers), b.column("n").to_numpy(zero_copy_only=False).astype(float)
                    p = c.posteriors(weight, copied)
                    for k, (hits, n) in enumerate((c.votes(p, times, len(sids)), c.agreement(p, times, n_readers))):
                        total[k] = total.get(k, 0.0) + np.stack([hits, n])
                for k, (hits, n) in total.items():
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(at), k), pa.int32()), "at": pa.array(at, pa.int32()), "hits": pa.array(hits[at]), "n": pa.array(n[at])})

            got = patterns.mapInArrow(run, "kind int, at int, hits double, n double").groupBy("kind", "at").agg(F.sum("hits"), F.sum("n")).collect()
            new = rel.copy()
            for kind, at, h, n in got:
                if kind == 0 and not given[at]:
                    new[at] = (h + 4 * start[at]) / (n + 4)
            if turn >= DAMPED:
                new = (new + rel) / 2
            moved = float(np.abs(new - rel).max(initial=0.0))
            rel = new
            if not independent or moved < TOLERANCE:
                pairs = np.zeros(n_readers * n_readers)
                for kind, at, h, n in got:
                    if kind == 1:
                        pairs[at] = h / (n + 10)
                pairs = pairs.reshape(n_readers, n_readers)
                copied = pairs + pairs.T
            if moved < TOLERANCE:
                break
        else:
            raise RuntimeError(f"reliabilities still move by {moved:.4f} after {MAX_ROUNDS} rounds")
    return sids, readers, rel, copied


def surviving_values(readings: DataFrame) -> DataFrame:
    """(job_id, field_name, best_value, posterior, several) of every group; ``several`` says if it has two readings."""
    groups = write_out(groups_of(readings))
    patterns = write_out(spread(groups.groupBy(*PATTERN).agg(F.count("*").alias("n")), *PATTERN))
    sids, readers, rel, copied = discover(patterns)
    weight = weights_of(rel, copied)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = Claims(b, sids, readers)
            p = c.posteriors(weight, copied)
            texts = b.column("texts").flatten()
            near = np.round(p, 9)
            # The best text of every group; equal posteriors go to the smaller string.
            order = np.lexsort((-near, c.row_of_text))
            filled = np.diff(c.first) > 0
            best = np.full(b.num_rows, -1, np.int64)
            best[filled] = order[c.first[:-1][filled]]
            top = near[best[c.row_of_text]] == near
            for r in np.flatnonzero(np.bincount(c.row_of_text, top, minlength=b.num_rows) > 1):
                best[r] = min((i for i in range(c.first[r], c.first[r + 1]) if top[i]), key=lambda i: texts[i].as_py())
            chosen = pa.array(best, mask=best < 0)
            yield pa.RecordBatch.from_arrays([b.column("job_id"), b.column("field_name"), texts.take(chosen), pa.array(p, pa.float64()).take(chosen), b.column("several")], names=["job_id", "field_name", "best_value", "posterior", "several"])

    return groups.mapInArrow(run, "job_id string, field_name string, best_value string, posterior double, several boolean")


def best_values(readings: DataFrame) -> DataFrame:
    """(job_id, field_name, best_value) of every job and field with at least two different readings."""
    return surviving_values(readings).where("several").select("job_id", "field_name", "best_value")
