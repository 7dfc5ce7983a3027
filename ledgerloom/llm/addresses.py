"""Same postal address written differently: which strings denote one location.

Every distinct string is parsed into house number, street, kind of street, locality, town and postal
code; abbreviations are written out and parts may stand in any order or be missing. Strings with the
same parse form one class. Candidates have one house number (a location has one number, so different
numbers can never meet) and streets that are equal or within the edit bounds: streets of one number meet
by what is left of them without one or two characters. They are verified by the parts: streets alike up to
slips, no contradiction in kind of street, town, postal code or locality, and at least one of the last
three in common unless one side names none of them. Verified links are split by average linkage over the
cosine of the weighted character n-gram vectors of their streets' names, as for names; a verified link counts
as ``MIN_COSINE`` at least. Nothing that verifies has streets that are not alike, so an index of the grams finds no pair more.

Defined results: null, blank and number-less strings denote no location and give no row; "7" and "7A"
differ; repeated rows change nothing; ties in clustering go to the smaller ids; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.names import cluster_links
from ledgerloom.llm.text import distance, edit_keys, near, plain
from ledgerloom.session import cut, spread, write_out

MIN_COSINE, MIN_LINKAGE, GRAM = 0.20, 0.15, 4

# Kinds of street and of locality with their usual abbreviations.
STREET = {"cross road": "crs rd|cross rd|crs road|x road|x rd|cr road", "road": "rd", "lane": "ln|lne|la", "street": "str|st|strt", "marg": "mrg|mg", "avenue": "ave|av", "path": "", "gali": "galli", "highway": "hwy"}
LOCALITY = {
    "industrial area": "ind area|indl area|industrial ar|ind ar|indl ar|industl area|ia|i a|industrial", "industrial estate": "ind estate|indl estate", "nagar": "ngr|nagr|ng", "colony": "col|cly|colny|coly",
    "estate": "est|estt", "layout": "lyt|l/o|lay out|lo", "market": "mkt|mrkt", "vihar": "", "enclave": "encl", "park": "pk", "garden": "gdn", "sector": "sec", "phase": "ph", "extension": "extn|ext",
}
_HOUSE = r"(?:survey|surv|svy|sy|s|shop|sh|gala|unit|u|plot|pl|house|hse|h|door|d|flat|fl|g|p|office|off|godown|shed|room|rm|block|bldg|building|khasra)"
_NUMBER = re.compile(rf"(?:\b{_HOUSE}\b[\s.,:/-]*(?:no|num|nos|number|n0)?\b[\s.,:#/-]*|\bno\b[\s.:#]*|#\s*)(\d+)\s*[-/]?\s*([a-z](?![a-z]))?", re.I)
_FLOOR = re.compile(r"\b(?:\d+\s*(?:st|nd|rd|th)|gr?o?u?n?d|grd|gf|first|second|third|fourth|upper|lower|1s|2n|3r)\.?\s*(?:floor|flr|fl|flor|fir|floo?r?)\b\.?|\bg\.?\s?f\b\.?", re.I)
_PIN = re.compile(r"(?:\bpin(?:code)?\b[\s.:-]*)?\b(\d{3})\s?(\d{3})\b", re.I)
_LANDMARK = re.compile(r"(?<![a-z])(?:near|nr|behind|bhd|beh|b/h|bh|opposite|opp|next to|beside|besides|adjacent to|adj|off)\b\.?", re.I)
_POI = r"(?:school|temple|chowk|bus stand|godown|water tank|petrol pump|weighbridge|bridge|hospital|park|mosque|church|station|bank|college|tank|pump|sch|tmpl|tpl|hosp|stn|wb)"


_PLAIN = {"pradesh", "india", "dist", "district", "state", "town", "city", "taluka", "post"}


def _kinds(table: dict[str, str]) -> list[tuple[re.Pattern, str]]:
    out = []
    for name, abbrs in table.items():
        for a in [name, *filter(None, abbrs.split("|"))]:
            out.append((re.compile(rf"(?<![a-z])([a-z0-9]{{3,}}(?:[ -][a-z]{{2,}})?)\s+{re.escape(a).replace(chr(92) + ' ', r'[ .]+')}(?![a-z])\.?"), name))
    return out


_STREETS, _LOCALITIES = _kinds(STREET), _kinds(LOCALITY)
_KIND_WORDS = sorted({w for t in (STREET, LOCALITY) for k, v in t.items() for a in [k, *v.split("|")] for w in a.split() if len(w) >= 4})


def _repair(text: str) -> str:
    """Kind words with a slip are brought to their form."""
    return re.sub(r"[a-z0-9]{4,}", lambda m: _kind_word(m.group(0)), text)


@lru_cache(100_000)
def _kind_word(w: str) -> str:
    if w in _KIND_WORDS:
        return w
    hits = [k for k in _KIND_WORDS if abs(len(k) - len(w)) <= 1 and k[0] == w[0] and distance(w, k, 1) <= 1]
    return hits[0] if len(hits) == 1 else w


def _take(text: str, kinds: list[tuple[re.Pattern, str]]) -> tuple[str, str, str]:
    """(name, kind, rest of the text) of the first part that ends in one of the kinds."""
    for pattern, kind in kinds:
        m = pattern.search(text)
        if m:
            return m.group(1).replace(" ", "").replace("-", ""), kind, text[: m.start()] + " , " + text[m.end() :]
    return "", "", text


def _first_part(text: str) -> tuple[str, str, str]:
    """A street without a kind that is known, or with a very short name: the first part that has a word ("Broadway", "Rue de Rivoli", "MG Road")."""
    for m in re.finditer(r"[^,]+", text):
        words = re.findall(r"[a-z0-9]+", m.group(0))
        if any(w.isalpha() and len(w) >= 2 and w not in _PLAIN for w in words):
            kind = next((k for k, abbrs in STREET.items() for a in [k, *abbrs.split("|")] if len(words) > 1 and a and words[-1] == a), "")
            return "".join(words[:-1] if kind else words), kind, text[: m.start()] + " , " + text[m.end() :]
    return "", "", text


def parse_address(raw: str) -> tuple[str, str, str, str, str, str, list[str]]:
    """(number, street, kind of street, locality, kind of locality, postal code, other place names)."""
    s = plain(raw)
    s = re.sub(r"[\n\r\t;|]+", " , ", s)
    s = re.sub(r"\s+-\s+", " , ", s)
    pin = ""
    m = None
    for m in _PIN.finditer(s):
        pass
    if m:
        pin = m.group(1) + m.group(2)
        s = s[: m.start()] + " , " + s[m.end() :]
    s = _FLOOR.sub(" , ", s)
    number = ""
    m = _NUMBER.search(s)
    if m is None:
        m = re.search(r"(?<![a-z0-9])(\d{1,4})\s*-?([a-z](?![a-z]))?(?![a-z0-9])", s)
    if m:
        part = re.match(r"/\s?(\d{1,4})(?![\d/])", s[m.end() :]) if not m.group(2) else None  # "12/4" is a number of its own
        number = str(int(m.group(1))) + (m.group(2) or "").lower() + (f"/{int(part.group(1))}" if part else "")
        s = s[: m.start()] + " , " + s[m.end() + (part.end() if part else 0) :]
    s = _repair(re.sub(r"(?<=[a-z])-(?=[a-z])", "", s).replace(".", " . "))
    s = re.sub(r"\s*\.\s*", " ", s)
    # A landmark ends with its kind of place or at the next comma.
    s = re.sub(_LANDMARK.pattern + rf"\s*[^,]*?{_POI}\b|" + _LANDMARK.pattern + r"[^,]*", " , ", s)
    s = re.sub(r"\s+", " ", s)
    street, kind, s = _take(s, _STREETS)
    locality, lkind, s = _take(s, _LOCALITIES)
    if not street:
        street, kind, s = _first_part(s)
    return number, street, kind, locality, lkind, pin, [w for w in re.findall(r"[a-z0-9]+", s) if len(w) >= 4 and w not in _PLAIN]


def class_key(p: tuple) -> str:
    return "|".join([*p[:6], " ".join(sorted(p[6]))])


def _alike(a: str, b: str) -> bool:
    n = min(len(a), len(b))
    return a == b or (n >= 4 and near(a, b, 1 if n < 7 else 2))


def same_location(a: tuple, b: tuple) -> bool:
    na, sa, ka, la, lka, pa, ra = a
    nb, sb, kb, lb, lkb, pb, rb = b
    if na != nb or not sa or not sb or not _alike(sa, sb):
        return False
    if ka and kb and ka != kb:
        return False
    # Of the other place names (town and state, a part may be missing) the shorter list must be found in the longer.
    short, long = sorted((list(ra), list(rb)), key=len)
    common = bool(short) and all(any(_alike(x, y) for y in long) for x in short)
    if short and not common:
        return False
    if la and lb and not _alike(la, lb):
        return False
    if pa and pb and pa != pb and distance(pa, pb, 1) > 1:
        return False
    return bool(common or (la and lb) or (pa and pb)) or not (len(ra) or la or pa) or not (len(rb) or lb or pb)


_SCHEMA = "address string, class_key string, number string, street string, kind string, locality string, lkind string, pin string, rest array<string>"


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for a in pdf["address"]:
            p = parse_address(a)
            rows.append((a, class_key(p), *p))
        yield pd.DataFrame(rows, columns=["address", "class_key", "number", "street", "kind", "locality", "lkind", "pin", "rest"])


#: Streets of one number whose edit keys are held at once; more are met in slices of the keys, each in a task of its own.
SLICE = 20_000


def near_streets(streets: DataFrame, per_slice: int = SLICE) -> DataFrame:
    """(number, street, other) with street < other: distinct streets of one number that are alike.

    What shares an edit key is met in memory, number by number, so only streets are moved and never their keys.
    """
    sized = streets.join(streets.groupBy("number").agg(F.ceil(F.count("*") / per_slice).alias("slices")), "number")
    sliced = sized.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    # One row for each number and slice, many of them in one batch.
    gathered = spread(sliced, "number", "slice").groupBy("number", "slice", "slices").agg(F.collect_list("street").alias("streets")).where(F.size("streets") > 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for number, slice_, slices, names in zip(pdf["number"], pdf["slice"], pdf["slices"], pdf["streets"]):
                names, keys, who = sorted(names), [], []
                for i, name in enumerate(names):
                    own = [k for k in edit_keys(name, 7) if k % slices == slice_]
                    keys.append(np.array(own, np.int64))
                    who.append(np.full(len(own), i))
                keys, who = np.concatenate(keys), np.concatenate(who)
                order = np.lexsort((who, keys))
                keys, who = keys[order], who[order]
                # A row and the one ``far`` rows on have one key; runs of one key are as long as the longest far.
                met, far = [], 1
                while len(at := np.flatnonzero(keys[far:] == keys[:-far])):
                    met.append(np.unique(who[at] * len(names) + who[at + far]))
                    far += 1
                pairs = [divmod(int(x), len(names)) for x in np.unique(np.concatenate(met))] if met else []
                alike = [(number, names[i], names[j]) for i, j in pairs if _alike(names[i], names[j])]
                yield pd.DataFrame(alike, columns=["number", "street", "other"])

    return gathered.mapInPandas(run, "number string, street string, other string").distinct()


def street_cosines(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(street_a, street_b, cosine) of pairs of streets; the weights of the grams count every class of a street."""
    n = classes.count()
    t = F.concat(F.lit("^"), "street", F.lit("$"))
    each = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - (GRAM - 1))), lambda i: F.substring(t, i, F.lit(GRAM))))
    df = classes.groupBy("street").agg(F.count("*").alias("n")).select("n", F.explode(each).alias("g")).groupBy("g").agg(F.sum("n").alias("df"))
    named = pairs.select(F.col("street_a").alias("street")).union(pairs.select("street_b")).distinct()
    weighted = named.select("street", F.explode(each).alias("g")).join(df, "g").withColumn("w", F.log(1 + F.lit(n) / F.col("df")))
    vector = weighted.groupBy("street").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.map_from_entries(F.collect_list(F.struct("g", "w"))).alias("v"))
    both = pairs.join(vector.toDF("street_a", "norm_a", "va"), "street_a").join(vector.toDF("street_b", "norm_b", "vb"), "street_b")
    dot = F.aggregate(F.map_keys("va"), F.lit(0.0), lambda t, g: t + F.col("va")[g] * F.coalesce(F.col("vb")[g], F.lit(0.0)))
    return both.select("street_a", "street_b", (dot / (F.col("norm_a") * F.col("norm_b"))).alias("cosine"))


def _located(addresses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((address, class_key) of every distinct string with a house number and a street, (class_key, id, cluster)); ids are in the order of the keys."""
    distinct = spread(addresses.select("address").where(F.trim("address") != ""), "address").dropDuplicates(["address"])
    parsed = write_out(distinct.mapInPandas(_parse_batches, _SCHEMA).where((F.col("number") != "") & (F.col("street") != "")))
    parts = ["number", "street", "kind", "locality", "lkind", "pin", "rest"]
    classes = parsed.groupBy("class_key").agg(F.min(F.struct(*parts)).alias("p")).select("class_key", "p.*")
    tasks = int(parsed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    classes = write_out(classes.repartitionByRange(tasks, "class_key").sortWithinPartitions("class_key").withColumn("id", F.monotonically_increasing_id()))

    p = F.struct("kind", "locality", "lkind", "pin", "rest")
    one = classes.select("number", "street", F.col("id").alias("a"), p.alias("pa"))
    two = classes.select("number", F.col("street").alias("other"), F.col("id").alias("b"), p.alias("pb"))
    # Only streets that are equal or alike can be of one location, so these are all candidates.
    same = one.join(two.withColumnRenamed("other", "street"), ["number", "street"]).where("a < b").withColumn("other", F.col("street"))
    slips = near_streets(classes.select("number", "street").distinct()).join(one, ["number", "street"]).join(two, ["number", "other"])
    both = same.unionByName(slips)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for number, street, other, x, y in zip(pdf["number"], pdf["street"], pdf["other"], pdf["pa"], pdf["pb"]):
                keep.append(same_location((number, street, *(x[c] for c in parts[2:])), (number, other, *(y[c] for c in parts[2:]))))
            yield pdf.loc[keep, ["a", "b", "street", "other"]].set_axis(["a", "b", "street_a", "street_b"], axis=1)

    links = cut(spread(both, "number", "street", "a").mapInPandas(verify, "a bigint, b bigint, street_a string, street_b string"))
    cosines = street_cosines(links.where("street_a <> street_b").select("street_a", "street_b").distinct(), classes)
    sim = F.when(F.col("street_a") == F.col("street_b"), F.lit(1.0)).otherwise(F.greatest("cosine", F.lit(MIN_COSINE)))
    links = links.join(cosines, ["street_a", "street_b"], "left").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), sim.alias("sim"))
    clusters = cluster_links(links, MIN_LINKAGE)
    placed = classes.select("class_key", "id").join(clusters, "id", "left").select("class_key", "id", F.coalesce("cluster", "id").alias("cluster"))
    return parsed.select("address", "class_key"), placed


def location_parties(addresses: DataFrame) -> DataFrame:
    """(address, class_key, location) of every distinct string with a house number and a street."""
    usable, placed = _located(addresses)
    placed = write_out(placed)
    named = placed.join(placed.select(F.col("id").alias("cluster"), F.col("class_key").alias("location")), "cluster")
    return usable.join(named.select("class_key", "location"), "class_key").select("address", "class_key", "location")


def address_pairs(addresses: DataFrame) -> DataFrame:
    """(address_a, address_b): all pairs of different strings of one location, the smaller first."""
    usable, placed = _located(addresses)
    loc = write_out(usable.join(placed.select("class_key", "cluster"), "class_key").select("address", "cluster"))
    a, b = loc.withColumnRenamed("address", "address_a"), loc.withColumnRenamed("address", "address_b")
    return a.join(b, "cluster").where(F.col("address_a") < F.col("address_b")).select("address_a", "address_b")
