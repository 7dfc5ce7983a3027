"""Mapping free-entered values to a reference list, with unmatched values reported.

A multi-pattern automaton over the canonical names, codes, long names and aliases of a list finds
every embedded mention in a value; among overlapping mentions the longest wins. Values without a
mention, or whose mentions name different entries equally well, go to token-set similarity: each
token of the value takes its best partner among an entry's tokens (slips, lookalike characters,
abbreviations), and the entry with the highest share of matched length wins if it passes
``MIN_SIMILARITY`` and leads the next one by ``MIN_LEAD``.

Every distinct value is mapped once, by workers that hold the reference list (at most ``MAX_REFERENCE`` rows,
checked); the answers are joined back to the rows by a broadcast where they are few (``BROADCAST_VALUES``, checked),
so one value that fills a third of all rows costs nothing extra, else by value, where adaptive execution splits hot ones. Defined results: null and blank values give no
row, values equal to a canonical entry are not reported by ``canonical_rows``, ties go to 0 (unmatched),
an empty reference list leaves everything unmatched, empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.text import distance, plain, sounds_like
from ledgerloom.session import cut, spread

MIN_SIMILARITY, MIN_LEAD = 0.72, 0.04

#: The list is held by every worker; a longer one is refused.
MAX_REFERENCE = 100_000

#: Distinct values whose answers are broadcast; more are joined by a shuffle.
BROADCAST_VALUES = 500_000

CACHE = 200_000

# Usual ways to write units of quantity, by the code of the unit.
UNIT_ALIASES = {
    "NOS": "no nos num number numbers nbr each ea unit units",
    "PCS": "pc pcs piece pieces pce",
    "KGS": "kg kgs k.g kilo kilos kilogram kilograms kilogramme kilogrammes",
    "GMS": "g gm gms gram grams gramme grammes",
    "QTL": "qtl qtls quintal quintals qntl qntls",
    "TON": "t tn ton tons tonne tonnes mt m.ton m.tons m.t metric_ton metric_tons metric_tonne",
    "MTR": "m mtr mtrs meter meters metre metres running_metre running_meter rmt",
    "CMS": "cm cms centimetre centimetres centimeter centimeters",
    "FTS": "ft fts foot feet rft running_feet running_foot",
    "SQM": "sqm sq_m sqmt sqmtr sq_mtr sq_mtrs sq_meter sq_meters sq_metre sq_metres square_metre square_metres square_meter square_meters m2",
    "SQF": "sqf sft sqft sq_ft sq_feet sq_foot square_feet square_foot",
    "CBM": "cbm cum cu_m cu_mtr cu_mtrs cu_meter cu_metre cubic_metre cubic_metres cubic_meter cubic_meters m3",
    "LTR": "l lt ltr ltrs litre litres liter liters",
    "MLT": "ml mls mlt millilitre millilitres milliliter milliliters",
    "BOX": "box boxes bx bxs",
    "CTN": "ctn ctns carton cartons cart case cases",
    "BAG": "bag bags bg bgs sack sacks",
    "BDL": "bdl bdls bundle bundles bndl bndls",
    "ROL": "rol rols roll rolls rl rls",
    "SET": "set sets st",
    "PRS": "pr prs pair pairs",
    "DOZ": "doz dz dzn dozen dozens",
    "BTL": "btl btls bottle bottles botl",
    "DRM": "drm drms drum drums barrel_drum barrel barrels",
    "PKT": "pkt pkts pckt pckts packet packets pack packs",
    "SHT": "sht shts sheet sheets",
    "HRS": "hr hrs hour hours",
    "KMS": "km kms kilometre kilometres kilometer kilometers",
}

# Words around a mention that say nothing about which entry is meant.
NOISE = {
    "place_of_supply": "state of the ut province india place supply st",
    "bank_name": "the m/s ms messrs branch br ltd limited bank bk bnk of",
}


def tokens(s: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", plain(s).replace("m/s", " "))


@lru_cache(CACHE)
def token_likeness(x: str, y: str) -> float:
    """Likeness of a typed token and an entry's token, 0 if they are no variants of each other."""
    if x == y:
        return 1.0
    n = max(len(x), len(y))
    limit = 1 if n <= 5 else 2 if n <= 9 else 3
    if 3 <= len(x) < len(y) and y.startswith(x):  # cut off: "Chet." for "Chetana"
        short = 0.75
    else:
        short = 0.0
    if abs(len(x) - len(y)) > limit + 1:
        return short
    sx, sy = sounds_like(x), sounds_like(y)
    if len(set(sx) ^ set(sy)) > 2 * limit + 1:
        return short
    d = min(distance(x, y, limit), distance(sx, sy, limit) + 0.5)
    return max(short, 1 - d / n) if d <= limit else short


def _slip_rank(typed: str, form: str) -> int:
    """Of two equally near forms the likelier slip: a doubled letter, then a lost one, a wrong one, an added one."""
    if re.sub(r"(.)\1+", r"\1", typed) == re.sub(r"(.)\1+", r"\1", form):
        return 0
    return 1 if len(typed) < len(form) else 2 if len(typed) == len(form) else 3


class Matcher:
    """Maps values of one list; ``entries`` are (ref_id, canonical, code, long_name)."""

    def __init__(self, list_name: str, entries: list[tuple[int, str, str | None, str | None]]):
        self.noise = set(NOISE.get(list_name, "").split())
        self.list_name = list_name
        self.patterns: dict[str, set[int]] = {}
        self.forms: list[tuple[int, list[str]]] = []
        self.written: list[tuple[int, str]] = []
        units = list_name == "unit"
        for ref, canonical, code, long_name in entries:
            names = [x for x in (canonical, code, long_name) if x]
            if units:
                names += [a.replace("_", " ") for a in UNIT_ALIASES.get(canonical, "").split()]
            for name in names:
                t = tokens(name)
                if not t:
                    continue
                self._add(t, ref)
                if not units and name != code:
                    short = [x for x in t if x not in self.noise]
                    if short and name is canonical and len("".join(short)) >= 5 and len(short) < len(t) and t[0] not in self.noise:
                        self._add(short, ref)  # "Jaldhara Finance" for "Jaldhara Finance Bank"
                    self.forms.append((ref, t))
                if units and len("".join(t)) >= 3:
                    written = plain(name)
                    self.written += [(ref, written), (ref, written + "(s)")]
        self.squeezed: dict[str, set[int]] = {}
        for p, refs in self.patterns.items():
            self.squeezed.setdefault(p.replace(" ", ""), set()).update(refs)
        self.auto = ahocorasick.Automaton()
        for p, refs in self.patterns.items():
            if len(refs) == 1:
                self.auto.add_word(f" {p} ", (len(p) + 2, next(iter(refs))))
        if len(self.auto):
            self.auto.make_automaton()
        self.match = lru_cache(CACHE)(self._match)

    def _add(self, t: list[str], ref: int) -> None:
        self.patterns.setdefault(" ".join(t), set()).add(ref)

    def _mentions(self, t: list[str]) -> list[int]:
        """Entries of the longest non-overlapping mentions, longest first."""
        text = " " + " ".join(t) + " "
        found = []
        if len(self.auto):
            for end, (n, ref) in self.auto.iter(text):
                found.append((n, end - n + 1, ref))
        found.sort(key=lambda x: (-x[0], x[1]))
        taken: list[tuple[int, int]] = []
        out: list[tuple[int, int]] = []
        for n, start, ref in found:
            span = (start + 1, start + n - 1)
            if all(span[1] <= a or span[0] >= b for a, b in taken):
                taken.append(span)
                out.append((n, ref))
        return out

    def _match(self, value: str) -> int:
        t = tokens(value)
        if not t:
            return 0
        whole = self.squeezed.get("".join(t))
        if whole and len(whole) == 1:
            return next(iter(whole))
        if self.list_name == "unit":
            bare = tokens(re.sub(r"\(.{0,2}\)?$", "", plain(value)))
            whole = self.squeezed.get("".join(bare))
            if whole and len(whole) == 1:
                return next(iter(whole))
            nearest = self._nearest_written(re.sub(r"\s+", " ", plain(value)).strip(" ."))
            if nearest:  # "squar feet" is a slip of a longer form, no mention of "feet"
                return nearest
            # A mention beside other words ("approx 5 kg bag"): the longest decides, between equally long ones none.
            mentions = self._mentions([x for x in t if not x.isdigit()])
            top = {r for n, r in mentions if n == mentions[0][0]}
            return top.pop() if len(top) == 1 and mentions[0][0] > 3 else 0
        mentions = self._mentions(t)
        named = [(n, r) for n, r in mentions if n > 6]
        if named:
            best = named[0][0]
            top = {r for n, r in named if n == best}
            if len(top) == 1:
                return top.pop()
        codes = {r for n, r in mentions if n <= 6}
        rest = [x for x in t if x not in self.noise and not x.isdigit()]
        by_name = self._similar(t)
        if by_name:
            return by_name
        # A code decides where the name beside it is missing; beside another name it does not.
        if len(codes) == 1 and (not rest or any(x in self.patterns for x in rest)):
            return codes.pop()
        return 0

    def _score(self, typed: list[str], entry: list[str]) -> float:
        total = sum(map(len, typed)) + sum(map(len, entry))
        got, left = 0.0, list(entry)
        for x in sorted(typed, key=len, reverse=True):
            best = max(left, key=lambda y: (token_likeness(x, y) * min(len(x), len(y)), y), default=None)
            if best is not None and (like := token_likeness(x, best)) > 0.5:
                got += like * (len(x) + len(best))
                left.remove(best)
        joined = token_likeness("".join(typed), "".join(entry)) if len(typed) != len(entry) or got < 0.99 * total else 0.0
        return max(got / total, joined)

    def _similar(self, t: list[str]) -> int:
        scores: dict[int, float] = {}
        stripped = [x for x in t if x not in self.noise and not x.isdigit()]
        for ref, entry in self.forms:
            mine = [x for x in entry if x not in self.noise] or entry
            typed = stripped or t
            s = self._score(typed, mine)
            if len(mine) < len(entry) or len(typed) < len(t):
                s = max(s, 0.98 * self._score(t, entry))
            # A long mention inside a longer value ("..., Town Branch"): the entry's words must all be there.
            if len(typed) > len(mine) and len(mine) >= 1:
                inside = self._inside(typed, mine)
                s = max(s, inside)
            scores[ref] = max(scores.get(ref, 0.0), s)
        ranked = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
        if not ranked or ranked[0][1] < MIN_SIMILARITY:
            return 0
        if len(ranked) > 1 and ranked[0][1] - ranked[1][1] < MIN_LEAD:
            return 0
        return ranked[0][0]

    def _nearest_written(self, typed: str) -> int:
        """The entry with the least edit distance to one of its written forms, compared as a whole."""
        best: list[tuple[float, int, int]] = []
        for ref, form in self.written:
            n = max(len(typed), len(form))
            limit = 0 if n <= 3 else 1 if n <= 5 else 2 if n <= 9 else 3
            if abs(len(typed) - len(form)) > limit:
                continue
            d = min(distance(typed, form, limit), distance(sounds_like(typed), sounds_like(form), limit) + 0.5)
            if d <= limit:
                best.append((d, _slip_rank(typed, form), ref))
        best.sort()
        if not best or len({r for d, k, r in best if (d, k) == best[0][:2]}) > 1:
            return 0
        return best[0][2]

    def _inside(self, typed: list[str], entry: list[str]) -> float:
        likes = [max((token_likeness(x, y) for x in typed), default=0.0) for y in entry]
        if min(likes) <= 0.5 or (len(entry) == 1 and len(entry[0]) < 6):
            return 0.0
        return (0.97 if len(entry) > 1 else 0.85) * sum(v * len(y) for v, y in zip(likes, entry)) / sum(map(len, entry))


def map_values(df: DataFrame, value: str, list_name: str, reference: DataFrame, into: str = "ref_id") -> DataFrame:
    """Adds ``into``: the entry of ``list_name`` that each value means, 0 if the list has none."""
    entries = [tuple(r) for r in reference.where(F.col("list_name") == list_name).select("ref_id", "canonical", "code", "long_name").limit(MAX_REFERENCE + 1).collect()]
    if len(entries) > MAX_REFERENCE:
        raise ValueError(f"list {list_name} has more than {MAX_REFERENCE} entries")
    held: list[Matcher] = []

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not held:
            held.append(Matcher(list_name, entries))
        for pdf in batches:
            yield pd.DataFrame({"_v": pdf["_v"], into: pdf["_v"].map(held[0].match).astype("int32")})

    # By a key of its own: values that are already distinct would be taken as placed and merged into one task.
    values = spread(df.select(F.col(value).alias("_v")).where(F.col(value).isNotNull()).distinct().withColumn("_h", F.xxhash64("_v")), "_h")
    mapped = cut(values.mapInPandas(find, f"_v string, `{into}` int"))
    small = mapped.count() <= BROADCAST_VALUES
    out = df.join(F.broadcast(mapped) if small else mapped, df[value] == mapped["_v"], "left").drop("_v")
    return out.withColumn(into, F.coalesce(into, F.lit(0)))


def canonical_rows(facts: DataFrame, lines: DataFrame, reference: DataFrame) -> DataFrame:
    """(job_id, line_no, field_name, ref_id) for every filled value that is no canonical entry itself."""
    sources = [
        (facts.select("job_id", F.lit(0).alias("line_no"), F.col("place_of_supply").alias("v")), "place_of_supply"),
        (facts.select("job_id", F.lit(0).alias("line_no"), F.col("bank_name").alias("v")), "bank_name"),
        (lines.select("job_id", "line_no", F.col("unit").alias("v")), "unit"),
    ]
    out = None
    for df, name in sources:
        # ``map_values`` refuses a list beyond ``MAX_REFERENCE``, so the entries may be sent to the workers.
        known = F.broadcast(reference.where(F.col("list_name") == name).select(F.col("canonical").alias("v")).distinct())
        open_ = df.where(F.col("v").isNotNull() & (F.trim("v") != "")).join(known, "v", "left_anti").distinct()
        part = map_values(open_, "v", name, reference).select("job_id", "line_no", F.lit(name).alias("field_name"), "ref_id").distinct()
        out = part if out is None else out.union(part)
    return out
