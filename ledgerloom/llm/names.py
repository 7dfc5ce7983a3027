"""Variant spellings of names: which strings name the same firm or person.

1. Every distinct string is parsed (``parse_name``): form of address, branch and legal form fall
   away or are brought to one word, abbreviations are written out, split and hyphenated parts are
   kept. Strings with the same parse form one class, so copies and mere spelling of punctuation
   never reach the join.
2. The distinctive parts of the classes become character 4-gram vectors with tf-idf weights, and a
   distributed sparse product finds all pairs with a cosine of at least ``MIN_COSINE`` (the top n of
   every string, with n left open: no posting and no list of partners is capped). The grams of a slip
   weigh more the larger the table is, so pairs within the edit bounds of step 3 are also found by
   what is left of them without one or two characters, whatever their cosine; they count as ``MIN_COSINE``.
3. Pairs are verified structurally (``compatible``): the distinctive part may differ by typing slips,
   trade words by abbreviation, initials or truncation; given names may be initials or short forms.
   Sister firms (same owner name, other trade) and relatives (same surname, other given name) fail.
4. The verified graph's components are split by average-linkage clustering, a missing edge counting
   as similarity 0, so that one ambiguous form ("G. Kajehonem") cannot chain two parties.

Every result row is a string with its class and party, or a pair of strings of one party. Defined
results: null, empty and blank strings are left out; a string without letters is its own party;
repeated rows change nothing; ties in clustering go to the smaller ids; empty tables give empty results.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.components import connected_components
from ledgerloom.llm.text import edit_keys, grams, near, plain
from ledgerloom.session import cut, spread

#: Least cosine of the n-gram vectors of two classes, and least average similarity within a party.
MIN_COSINE, MIN_LINKAGE = 0.25, 0.20

#: Length of the character n-grams. Four keep the postings short: three-letter syllables recur in every tenth name.
GRAM = 4

#: Rows of one gram that meet in one task.
BLOCK = 1_000

#: Components of at most this many links are clustered in one task each; larger ones in distributed rounds, with the same result.
LOCAL_LINKS = 20_000

# Forms of address and courtesy.
COURTESY = {"m/s", "ms", "messrs", "mr", "mrs", "shri", "shree", "sri", "smt", "dr", "prof", "the", "kum", "late"}

# Legal forms and their usual abbreviations, each with the word it stands for.
LEGAL = {
    "private": "private", "pvt": "private", "pvtltd": "private", "p": "private", "pv": "private", "limited": "limited", "ltd": "limited", "llp": "llp",
    "company": "company", "co": "company", "coy": "company", "comp": "company", "and": "and", "sons": "sons", "son": "sons", "son's": "sons",
    "enterprises": "enterprises", "enterprise": "enterprises", "ent": "enterprises", "entp": "enterprises", "entps": "enterprises", "n": "and",
    "inc": "limited", "corp": "company", "corporation": "company", "bros": "sons", "brothers": "sons",
}

# Words of trade with their usual abbreviations.
TRADE = {
    "printing": "prtg ptg", "press": "", "paper": "ppr", "mills": "mill mls", "spices": "spice", "international": "int'l intl intnl internl",
    "pharma": "phar pharm pharmaceutical pharmaceuticals", "distributors": "dist distr distrs distributers distributor dists", "cold": "", "storage": "stor strg",
    "transport": "trnsp tpt transp trpt", "services": "service serv svcs svc servs", "construction": "constn constr const construc",
    "electricals": "elecs electrical elec elect", "plastics": "plastic plast", "manufacturing": "mfg manufg mfrg manuf mfrs manufacturers", "chemicals": "chem chemical chems",
    "textiles": "textile tex text txtls", "office": "off", "supplies": "supply supp sply", "ceramics": "ceramic cer ceram", "engineering": "engg eng engrg engng",
    "works": "work wks wrks", "hardware": "h/w hrdware hw hdwr", "stores": "store strs", "furniture": "furn furnt", "house": "hse",
    "agro": "agri", "foods": "food fds", "auto": "automotive automobile", "components": "compnts comps component cmpnts", "steel": "stl", "industries": "industry indus inds ind industires",
    "traders": "trdrs trader trading trd trds", "cable": "cables cbl", "packaging": "pkg packing pkgg", "solutions": "soln solns solution sol", "software": "s/w sw softw",
    "timber": "tmbr", "merchants": "merch mrchts merchant mcht", "company": "", "builders": "bldrs", "medical": "med", "motors": "motor", "sales": "", "agency": "agencies agcy",
    "exports": "export exp", "imports": "import imp", "technologies": "technology tech techno", "systems": "system sys", "logistics": "logistic log", "jewellers": "jeweller",
    "garments": "garment", "metals": "metal", "machinery": "machineries mach", "tools": "tool", "tiles": "tile", "glass": "", "oil": "oils", "dairy": "", "seeds": "seed",
}
_EXPAND = {abbr: word for word, abbrs in TRADE.items() for abbr in [word, *abbrs.split()] if word != "company"}
_WORDS = sorted(set(_EXPAND.values()), key=len)


@lru_cache(100_000)
def _trade_word(t: str, dotted: bool, last: bool) -> str | None:
    """The trade word that a token stands for: as listed, with a slip, or cut short."""
    if t in _EXPAND:
        return _EXPAND[t]
    if len(t) >= 5:
        for w in _WORDS:
            if len(w) >= 5 and abs(len(w) - len(t)) <= 2 and near(t, w, 1 if len(w) < 8 else 2):
                return w
    if (last and len(t) >= 2) or (dotted and len(t) >= 3):
        hits = [w for w in _WORDS if w.startswith(t)]
        if len(hits) == 1 or (hits and len(t) >= 4):
            return hits[0]
    return None


def parse_name(raw: str) -> tuple[str, list[str], list[str], list[str], list[str]]:
    """(kind, core tokens, trade words, initials, legal words); kind is ``firm`` or ``person``."""
    s = plain(raw).strip()
    s = re.sub(r"\s*\([^)]{3,}\)\s*$", "", s)  # a branch in brackets
    s = re.sub(r"\s+-\s+[a-z]+\s*$", "", s)  # a branch after a dash
    s = s.replace("&", " and ").replace("(p)", " private ").replace("pvt.ltd", " private limited ").replace("l.l.p", "llp")
    comma = s.find(",")
    branch = re.search(r",\s*[A-Za-z]{4,}\.?\s*$", raw)  # a branch after a comma, behind a name that is whole without it
    if branch:
        whole = parse_name(raw[: branch.start()])
        if whole[0] == "firm" and len("".join(whole[1])) >= 5 and (whole[2] or whole[3]):
            return whole
    s = re.sub(r"(?<=[a-z0-9])-+(?=[a-z0-9])(?=[a-z0-9])", "", s)
    pieces = re.findall(r"[a-z0-9'/]+(?:\.[a-z0-9]\b)*\.?|,", s)
    words = [w for w in pieces if w != ","]
    legal: list[str] = []
    trade: list[str] = []
    initials: list[str] = []
    core: list[str] = []
    n = len(words)
    for i, w in enumerate(words):
        dotted = w.endswith(".")
        flat = w.replace(".", "")
        if flat in COURTESY or w.rstrip(".") in COURTESY:
            continue
        if "." in w[:-1] and len(flat) <= 3:  # p.p., c.s
            initials.append(flat)
            continue
        if flat == "company" or flat in ("co", "coy", "comp"):
            before = trade[-1] if trade else ""
            if before == "construction" and "company" not in trade:
                trade.append("company")
                continue
        if flat in LEGAL and (flat not in ("p", "n", "ind") or n > 2) and not (flat == "p" and dotted):
            legal.append(LEGAL[flat])
            continue
        t = _trade_word(flat, dotted, i == n - 1 and i > 0)
        if t:
            trade.append(t)
            continue
        if i > 0 and i == n - 1 and len(flat) >= 2 and any(x.startswith(flat) for x in ("private", "limited", "enterprises", "company", "sons", "and")) and (trade or initials):
            legal.append(next(x for x in ("private", "limited", "enterprises", "company", "sons", "and") if x.startswith(flat)))
            continue
        if i > 0 and i == n - 1 and len(flat) <= 4 and (trade or legal) and core and raw.isupper():
            continue  # the first letters of a word cut off by a fixed width
        if len(flat) >= 5 and any(near(flat, x, 1) for x in ("private", "limited", "enterprises", "company")):
            legal.append(next(x for x in ("private", "limited", "enterprises", "company") if near(flat, x, 1)))
            continue
        if flat:
            core.append(flat)
    # Two capital letters beside a long word of a firm are the initials of its trade.
    if not initials and not trade:
        short = [c for c in core if len(c) == 2 and any(len(x) >= 5 for x in core)]
        if short and (legal or re.search(rf"\b{short[0].upper()}\b", raw)):
            initials.append(short[0])
            core.remove(short[0])
    # Two single dotted letters beside one long word and a legal form are initials as well ("P. P.").
    firm = bool(trade or initials or (legal and set(legal) - {"private"}))
    if len(initials) == 1 and not trade and not legal and len(core) == 1 and "." in raw and comma < 0 and not re.search(r"[a-zA-Z]{4,}\W+[A-Za-z]\.?\s?[A-Za-z]\.?\W*$", raw):
        firm = False
    if not firm:
        given = [c for i in initials for c in i] + legal_letters(words, legal)
        core = given + core
        initials, legal = [], []
    if not firm and comma > 0:
        surname = re.findall(r"[a-z0-9']+", s[:comma].replace(".", ""))
        rest = [c for c in core if c not in surname]
        core = rest + [c for c in core if c in surname]
    return ("firm" if firm else "person"), core, trade, initials, legal


def legal_letters(words: list[str], legal: list[str]) -> list[str]:
    """Single letters of a person's name that were read as a legal form ("P", "N")."""
    return [w.replace(".", "") for w in words if w.replace(".", "") in ("p", "n")] if legal else []


def class_key(parsed: tuple) -> str:
    """Strings with the same key differ only in punctuation, case, abbreviation and order of parts."""
    kind, core, trade, initials, legal = parsed
    if kind == "firm":
        return "f|" + "".join(core) + "|" + " ".join(sorted(trade)) + "|" + " ".join(initials)
    return "p|" + " ".join(core)


def surnames(core: list[str]) -> list[str]:
    """The names of a person that may be the surname by their place: the last one, or the first before initials."""
    if not core:
        return []
    return [core[-1]] if len(core[-1]) > 1 else [core[0]]


def stems(parsed: tuple) -> list[str]:
    """The distinctive parts that variants share: a firm's own name, a person's longest name and surname."""
    if parsed[0] == "firm":
        return ["".join(parsed[1])]
    return list(dict.fromkeys([max(parsed[1], key=len, default=""), *surnames(parsed[1])]))


def _initials_of(words: list[str]) -> str:
    return "".join(w[0] for w in words)


def _same_core(a: str, b: str) -> bool:
    if a == b:
        return True
    shortest = min(len(a), len(b))
    if shortest < 4:
        return False
    return near(a, b, 1 if shortest < 8 else 2)


def _given_alike(a: str, b: str) -> bool:
    if a == b or a[0] == b[0] and (len(a) == 1 or len(b) == 1):
        return True
    if min(len(a), len(b)) < 3:
        return False
    for x, y in ((a, b), (b, a)):  # short forms: the first letters, often with -i or -y
        stem = re.sub(r"(i|y|ie|u|oo)$", "", x)
        if len(x) < len(y) and len(x) <= 5 and len(stem) >= 2 and y.startswith(stem) and (x != stem or len(x) >= 3):
            return True
    return near(a, b, 1)


def _persons(a: list[str], b: list[str]) -> bool:
    """Surname and given names in any order of the surname; a middle name may be missing."""
    def split(x: list[str]) -> list[tuple[str, list[str], bool]]:
        """(surname, given names, does its place say that it is the surname)."""
        ends = {x[-1], x[0]} if len(x) > 1 else set()
        return [(s, [t for j, t in enumerate(x) if j != x.index(s)], s in surnames(x)) for s in sorted(ends, key=len, reverse=True) if len(s) > 1]

    for sa, ga, placed_a in split(a):
        for sb, gb, placed_b in split(b):
            if min(len(sa), len(sb)) < 6:
                # Short surnames are near many others: they must stand where surnames stand, and be equal or one slip apart beside an equal given name.
                if not (placed_a and placed_b and (sa == sb or (min(len(sa), len(sb)) >= 4 and near(sa, sb, 1) and ga == gb and len(ga[0]) >= 3))):
                    continue
            elif not _same_core(sa, sb):
                continue
            if ga and gb and _given_alike(ga[0], gb[0]):
                short, long = sorted((ga[1:], gb[1:]), key=len)
                if len(short) == len(long) and all(_given_alike(x, y) for x, y in zip(short, long)):
                    return True
                if not short:
                    return True
            # Two given names written without their order: "Surname M. F."
            if len(ga) == len(gb) == 2 and _given_alike(ga[0], gb[1]) and _given_alike(ga[1], gb[0]) and max(map(len, ga + gb)) > 1:
                return True
    return False


def compatible(pa: tuple, pb: tuple) -> bool:
    """Do two parsed names denote one party?"""
    (ka, ca, ta, ia, la), (kb, cb, tb, ib, lb) = pa, pb
    if ka != kb:
        return False
    if ka == "person":
        return _persons(ca, cb) or ("".join(sorted(ca)) == "".join(sorted(cb)))
    if not ca or not cb:
        return False
    if not (_same_core("".join(ca), "".join(cb)) or _same_core("".join(sorted(ca)), "".join(sorted(cb)))):
        return False
    wa, wb = sorted(set(ta)), sorted(set(tb))
    if ia and tb and not ta:
        return sorted(ia[0]) == sorted(_initials_of(tb)) or ia[0] in _initials_of(tb)
    if ib and ta and not tb:
        return sorted(ib[0]) == sorted(_initials_of(ta)) or ib[0] in _initials_of(ta)
    if ia and ib and not ta and not tb:
        return sorted(ia[0]) == sorted(ib[0])
    if wa == wb:
        return True
    # Cut off at the end of a fixed-width field: a part of the words is missing.
    return bool(wa and wb) and (set(wa) <= set(wb) or set(wb) <= set(wa))


_CLASS_SCHEMA = "name string, class_key string, stems array<string>, kind string, core array<string>, trade array<string>, initials array<string>, legal array<string>"


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for name in pdf["name"]:
            p = parse_name(name)
            rows.append((name, class_key(p), stems(p), *p))
        yield pd.DataFrame(rows, columns=["name", "class_key", "stems", "kind", "core", "trade", "initials", "legal"])


def parse_names(names: DataFrame) -> DataFrame:
    """Distinct non-blank strings of column ``name`` with their parse."""
    distinct = spread(names.select("name").where(F.trim("name") != ""), "name").dropDuplicates(["name"])
    return distinct.mapInPandas(_parse_batches, _CLASS_SCHEMA)


def cosine_pairs(vectors: DataFrame, min_cosine: float) -> DataFrame:
    """All pairs (a, b, cosine) with a < b of rows (id bigint, grams) whose tf-idf cosine is at least ``min_cosine``.

    A sparse matrix product by gram: document frequencies cover all rows, every gram is posted, and
    the dot products are summed before the pairs leave the map side. Vectors are of unit length, so
    the sum is the cosine and nothing has to be looked up again.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    if n == 0:
        return spark.createDataFrame([], "a bigint, b bigint, cosine double")
    # A gram of many rows is met in blocks of its rows, each in a task of its own.
    blocks = F.ceil(F.col("df") / BLOCK).cast("int")
    post = vectors.select("id", F.explode("grams").alias("g"))
    df = post.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    norm = Window.partitionBy("id")
    # A gram of one row meets nothing but counts in the row's length.
    weighted = post.join(df, "g", "left").select("id", F.xxhash64("g").alias("g"), "df", F.log(1 + F.lit(n) / F.coalesce("df", F.lit(1))).alias("w"))
    units = cut(weighted.select("id", "g", "df", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(norm))).alias("u")).where("df > 1").select("id", "g", "u", blocks.alias("blocks")))
    left = units.select(F.col("id").alias("a"), "g", F.col("u").alias("ua"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = units.select(F.col("id").alias("b"), "g", F.col("u").alias("ub"), F.pmod(F.hash("id"), F.col("blocks")).alias("block"))
    met = left.join(right, ["g", "block"]).where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.sum(F.col("ua") * F.col("ub")).alias("cosine"))
    return met.where(F.col("cosine") >= min_cosine)


def edit_pairs(forms: DataFrame, two_from: int) -> DataFrame:
    """All pairs (a, b) with a < b of rows (id bigint, form string) whose forms may be ``near``, and some that are not."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                some = pdf.iloc[at : at + 500]
                yield pd.DataFrame([(k, i) for i, f in zip(some["id"], some["form"]) for k in edit_keys(f, two_from)], columns=["key", "id"])

    keys = cut(spread(forms.where(F.length("form") >= 4), "form").mapInPandas(run, "key bigint, id bigint"))
    return keys.withColumnRenamed("id", "a").join(keys.withColumnRenamed("id", "b"), "key").where("a < b").select("a", "b").distinct()


def average_linkage(links: list[tuple[str, str, float]], least: float) -> dict[str, str]:
    """Clusters of the ids in ``links`` by average linkage; unlinked pairs count 0. Named by the least id."""
    size: dict[str, int] = {}
    total: dict[str, dict[str, float]] = {}
    for a, b, sim in links:
        for x, y in ((a, b), (b, a)):
            size[x] = 1
            total.setdefault(x, {})[y] = sim
    member = {x: [x] for x in size}
    heap = [(-sim, a, b, 1, 1) for a, m in total.items() for b, sim in m.items() if a < b]
    heapq.heapify(heap)
    while heap:
        neg, a, b, na, nb = heapq.heappop(heap)
        if -neg < least:
            break
        if size.get(a) != na or size.get(b) != nb:
            continue
        # b joins a (a < b, so the cluster keeps its least id).
        mine, theirs = total[a], total.pop(b)
        for x, sim in theirs.items():
            if x != a:
                mine[x] = mine.get(x, 0.0) + sim
                total[x].pop(b, None)
        mine.pop(b, None)
        size[a] += size.pop(b)
        member[a] += member.pop(b)
        for x, sim in mine.items():
            total[x][a] = sim
            lo, hi = min(a, x), max(a, x)
            heapq.heappush(heap, (-sim / (size[a] * size[x]), lo, hi, size[lo], size[hi]))
    return {x: c for c, xs in member.items() for x in xs}


def _linkage_rounds(links: DataFrame, least: float) -> DataFrame:
    """Average linkage in distributed rounds: pairs that are each other's best neighbour merge.

    Group average is a reducible linkage, so merging mutual best neighbours at once gives the same
    clusters as merging one pair at a time. Equal means go to the pair of smaller ids, as in ``average_linkage``.
    """
    member = links.select(F.col("a").alias("id")).union(links.select("b")).distinct().select("id", F.col("id").alias("cluster"))
    member, now = cut(member), cut(links.select("a", "b", F.col("sim").alias("total")))
    while True:
        size = member.groupBy("cluster").agg(F.count("*").alias("n"))
        sided = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b"), "total"))
        sided = sided.join(size.select(F.col("cluster").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("cluster").alias("b"), F.col("n").alias("nb")), "b")
        mean = F.col("total") / (F.col("na") * F.col("nb"))
        best = sided.groupBy("a").agg(F.min_by("b", F.struct(-mean, F.least("a", "b"), F.greatest("a", "b"))).alias("b"), F.max(mean).alias("mean"))
        best = best.where(F.col("mean") >= least)
        back = best.select(F.col("b").alias("a"), F.col("a").alias("b"))
        merge = cut(best.join(back, ["a", "b"], "left_semi").where("a < b").select(F.col("b").alias("cluster"), F.col("a").alias("into")))
        if merge.isEmpty():
            return member
        member = cut(member.join(merge, "cluster", "left").select("id", F.coalesce("into", "cluster").alias("cluster")))
        ma, mb = merge.select(F.col("cluster").alias("a"), F.col("into").alias("ia")), merge.select(F.col("cluster").alias("b"), F.col("into").alias("ib"))
        moved = now.join(ma, "a", "left").join(mb, "b", "left").select(F.coalesce("ia", "a").alias("x"), F.coalesce("ib", "b").alias("y"), "total").where("x <> y")
        now = cut(moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("total").alias("total")))


def cluster_links(links: DataFrame, least: float) -> DataFrame:
    """(id, cluster) by average linkage over a link table (a, b, sim); the ids may be of any type with an order."""
    links, kind = cut(links), dict(links.dtypes)["a"]
    comp = connected_components(links)
    placed = links.join(comp.withColumnRenamed("id", "a"), "a")
    placed = cut(placed.join(placed.groupBy("component").agg(F.count("*").alias("n_links")), "component"))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for links in pdf["links"]:
                if len(links) == 1:
                    a, b, sim = links[0]["a"], links[0]["b"], links[0]["sim"]
                    out += [(a, min(a, b)), (b, min(a, b))] if sim >= least else [(a, a), (b, b)]
                else:
                    out += average_linkage([(x["a"], x["b"], x["sim"]) for x in links], least).items()
            yield pd.DataFrame(out, columns=["id", "cluster"])

    # One row for each small component, many of them in one batch.
    gathered = spread(placed.where(F.col("n_links") <= LOCAL_LINKS), "component").groupBy("component").agg(F.collect_list(F.struct("a", "b", "sim")).alias("links"))
    small = gathered.select("links").mapInPandas(local, f"id {kind}, cluster {kind}")
    large = placed.where(F.col("n_links") > LOCAL_LINKS).select("a", "b", "sim")
    return small if large.isEmpty() else small.union(_linkage_rounds(large, least))


def name_parties(names: DataFrame) -> DataFrame:
    """(name, class_key, party): every distinct non-blank string of column ``name`` with the party it names."""
    parsed = cut(parse_names(names))
    # Strings with one key may differ in their legal form only; the least parse stands for all.
    classes = parsed.groupBy("class_key").agg(F.min(F.struct("kind", "core", "trade", "initials", "legal", "stems")).alias("p")).select("class_key", "p.*")
    classes = cut(classes.withColumn("stem", F.explode("stems")).withColumn("sid", F.xxhash64("stem")))

    def to_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["sid"], "grams": [grams([x], GRAM) if x else [] for x in pdf["stem"]]})

    vectors = cut(classes.select("sid", "stem").distinct().mapInPandas(to_grams, "id bigint, grams array<string>"))
    joined, in_order = F.concat_ws("", "core"), F.concat_ws("", F.array_sort("core"))
    forms = classes.select("sid", F.explode(F.when(F.col("kind") == "firm", F.array(joined, in_order)).otherwise(F.array("stem"))).alias("form")).distinct()
    slips = edit_pairs(forms.withColumnRenamed("sid", "id"), 8).withColumn("cosine", F.lit(MIN_COSINE))
    pairs = cut(cosine_pairs(vectors, MIN_COSINE).union(slips).groupBy("a", "b").agg(F.max("cosine").alias("cosine")))
    # Stems meet in both directions, and every stem meets itself: sister firms and relatives share one.
    stems = pairs.union(pairs.select("b", "a", "cosine")).union(vectors.select("id", "id", F.lit(1.0)))
    parts = classes.select("class_key", "sid", F.struct("kind", "core", "trade", "initials", "legal").alias("p"))
    pa = parts.select(F.col("sid").alias("a"), F.col("class_key").alias("ka"), F.col("p").alias("pa"))
    pb = parts.select(F.col("sid").alias("b"), F.col("class_key").alias("kb"), F.col("p").alias("pb"))
    # Two persons may meet by surname and by their longest names: once is enough, with the better cosine.
    met = stems.join(pa.drop("pa"), "a").join(pb.drop("pb"), "b").where(F.col("ka") < F.col("kb")).groupBy("ka", "kb").agg(F.max("cosine").alias("cosine"))
    whole = classes.select("class_key", F.struct("kind", "core", "trade", "initials", "legal").alias("p")).dropDuplicates(["class_key"])
    both = met.join(whole.toDF("ka", "pa"), "ka").join(whole.toDF("kb", "pb"), "kb").select(F.col("ka").alias("a"), F.col("kb").alias("b"), "cosine", "pa", "pb")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["pa"], pdf["pb"]):
                pa, pb = ((r["kind"], list(r["core"]), list(r["trade"]), list(r["initials"]), list(r["legal"])) for r in (x, y))
                keep.append(compatible(pa, pb))
            yield pdf.loc[keep, ["a", "b", "cosine"]].rename(columns={"cosine": "sim"})

    links = spread(both, "a").mapInPandas(verify, "a string, b string, sim double")
    clusters = cluster_links(links, MIN_LINKAGE)
    out = parsed.select("name", "class_key").join(clusters.withColumnRenamed("id", "class_key"), "class_key", "left")
    return out.select("name", "class_key", F.coalesce("cluster", "class_key").alias("party"))


def name_pairs(names: DataFrame) -> DataFrame:
    """(name_a, name_b): all pairs of different strings of one party, the smaller first."""
    party = cut(name_parties(names).select("name", "party"))
    a, b = party.withColumnRenamed("name", "name_a"), party.withColumnRenamed("name", "name_b")
    return a.join(b, "party").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
