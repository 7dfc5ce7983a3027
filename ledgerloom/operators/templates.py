"""Three-stage template retrieval: exact hash, indexed candidates, score of four factors, decision by margin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Candidates that each index gives at most, the size from which no geometry is asked, and the most in all.
BY_KEY, BY_ANCHOR, BY_BUCKET, ENOUGH, MOST = 20, 30, 5, 10, 50
# Weights of anchors, positions, regions and key, and bounds of the decision.
W_ANCHOR, W_SPATIAL, W_REGION, W_KEY = 0.35, 0.35, 0.20, 0.10
EXACT, FAMILY, SPATIAL, MARGIN = 0.88, 0.70, 0.85, 0.05


def _top(df: DataFrame, key: list[str], order: list, n: int) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def postings(templates: DataFrame) -> DataFrame:
    """(anchor, template): the inverted index of anchors."""
    return templates.select(F.col("id").alias("template"), F.explode(F.map_keys("anchors")).alias("anchor"))


def candidates(profiles: DataFrame, templates: DataFrame) -> DataFrame:
    """(id, template): at most ``MOST`` per profile, by key, by shared anchors, and by geometry only where those give few.

    The limits are the retrieval's definition. Heads of the key and bucket indexes are cut before they are joined, so a
    key that a third of all templates share costs no more than any other.
    """
    by_key = _top(templates.where("key IS NOT NULL").select("key", F.col("id").alias("template")), ["key"], ["template"], BY_KEY)
    keyed = profiles.select("id", "key").join(by_key, "key").select("id", "template")
    asked = profiles.select("id", F.explode(F.map_keys("anchors")).alias("anchor"))
    hits = asked.join(postings(templates), "anchor").groupBy("id", "template").agg(F.count("*").alias("hits"))
    anchored = _top(hits, ["id"], [F.desc("hits"), "template"], BY_ANCHOR).select("id", "template")
    found = keyed.union(anchored).distinct()
    few = profiles.select("id", "bucket").join(found.groupBy("id").agg(F.count("*").alias("n")), "id", "left").where(F.coalesce("n", F.lit(0)) < ENOUGH)
    heads = _top(templates.select("bucket", F.col("id").alias("template")), ["bucket"], ["template"], BY_BUCKET)
    near = few.select("id", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket")).join(heads, "bucket").select("id", "template")
    return _top(found.union(near).distinct(), ["id"], ["template"], MOST)


def _same_anchors(c: DataFrame) -> DataFrame:
    """Adds ``jaccard`` and ``spatial`` of two anchor maps (anchor -> struct x, y)."""
    shared = F.array_intersect(F.map_keys("anchors"), F.map_keys("t_anchors"))
    either = F.size("anchors") + F.size("t_anchors") - F.size(shared)
    reach = F.transform(shared, lambda a: F.greatest(F.lit(0.0), 1 - F.sqrt(F.pow(F.col("anchors")[a]["x"] - F.col("t_anchors")[a]["x"], 2) + F.pow(F.col("anchors")[a]["y"] - F.col("t_anchors")[a]["y"], 2)) / 300.0))
    mean = F.aggregate(reach, F.lit(0.0), lambda s, x: s + x) / F.size(shared)
    return c.withColumns({"jaccard": F.when(either == 0, 1.0).otherwise(F.size(shared) / either), "spatial": F.when(F.size(shared) > 0, mean).otherwise(0.5)})


def _same_regions(c: DataFrame) -> DataFrame:
    """Adds ``region`` of two region maps (label -> array of four): labels in common, closeness and overlap of their boxes."""
    shared = F.array_intersect(F.map_keys("regions"), F.map_keys("t_regions"))
    labels = F.size(shared) / F.size(F.array_union(F.map_keys("regions"), F.map_keys("t_regions")))

    def alike(label):  # noqa: ANN001, ANN202
        a, b = F.col("regions")[label], F.col("t_regions")[label]
        gap = F.sqrt(F.pow((a[0] + a[2]) / 2.0 - (b[0] + b[2]) / 2.0, 2) + F.pow((a[1] + a[3]) / 2.0 - (b[1] + b[3]) / 2.0, 2))
        common = reduce(lambda x, y: x * y, [F.greatest(F.lit(0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i])) for i in (0, 1)])
        area = lambda r: F.greatest(F.lit(1), (r[2] - r[0]) * (r[3] - r[1]))
        return 0.6 * F.greatest(F.lit(0.0), 1 - gap / 500.0) + 0.4 * common / (area(a) + area(b) - common)

    mean = F.aggregate(F.transform(shared, alike), F.lit(0.0), lambda s, x: s + x) / F.size(shared)
    score = F.when((F.size("regions") == 0) & (F.size("t_regions") == 0), 1.0).when((F.size("regions") == 0) | (F.size("t_regions") == 0), 0.5).when(F.size(shared) == 0, labels * 0.5).otherwise(0.4 * labels + 0.6 * mean)
    return c.withColumn("region", F.round(score + 1e-9, 3))


def scored(profiles: DataFrame, templates: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, template, jaccard, spatial, region, score) of candidate pairs whose numbers of pages are compatible."""
    t = templates.select(F.col("id").alias("template"), F.col("key").alias("t_key"), F.col("anchors").alias("t_anchors"), F.col("regions").alias("t_regions"), F.col("pages").alias("t_pages"), "samples", "success")
    c = pairs.join(profiles, "id").join(t, "template").where((F.abs(F.col("pages") - F.col("t_pages")) <= 1) | (F.col("pages") == 1) | (F.col("t_pages") == 1))
    c = _same_regions(_same_anchors(c))
    same_key = F.coalesce(F.upper("key") == F.upper("t_key"), F.lit(False)).cast("int")
    composite = W_ANCHOR * F.col("jaccard") + W_SPATIAL * F.col("spatial") + W_REGION * F.col("region") + W_KEY * same_key
    weight = 0.90 + 0.10 * F.when(F.col("samples") >= 3, F.col("success")).otherwise(1.0)
    return c.select("id", "template", "jaccard", "spatial", "region", F.round(composite * weight + 1e-9, 3).alias("score"))


def decide(scores: DataFrame) -> DataFrame:
    """Best template of every profile and what the match is worth: a close runner-up lowers it and rules out an exact match."""
    w = Window.partitionBy("id").orderBy(F.desc("score"), "template")
    best = scores.withColumns({"_rn": F.row_number().over(w), "next": F.lead("score").over(w)}).where("_rn = 1")
    best = best.withColumn("ambiguous", F.coalesce(F.round(F.col("score") - F.col("next"), 6) < MARGIN, F.lit(False)))
    best = best.withColumn("confidence", F.round(F.col("score") * F.when(F.col("ambiguous"), 0.9).otherwise(1.0) + 1e-9, 3))
    kind = F.when((F.col("confidence") >= EXACT) & ~F.col("ambiguous") & (F.col("spatial") >= SPATIAL), "exact_version").when(F.col("confidence") >= FAMILY, "family_anchor").otherwise("none")
    return best.select("id", F.when(kind != "none", F.col("template")).alias("template"), kind.alias("match"), F.when(kind == "exact_version", F.least(F.lit(0.99), F.col("confidence"))).when(kind == "none", F.col("score")).otherwise(F.col("confidence")).alias("confidence"), "ambiguous")


def retrieve(profiles: DataFrame, templates: DataFrame) -> DataFrame:
    """(id, template, match, confidence, ambiguous, stage) of every profile.

    Both sides have id, print (exact fingerprint), key, bucket, pages, anchors (map of anchor to x and y) and regions
    (map of label to a box in thousandths); templates also samples and success. Profiles without candidates are ``none``.
    Ties go to the smaller template id; null keys and prints match nothing.
    """
    prints = templates.where("print IS NOT NULL").groupBy("print").agg(F.min("id").alias("template"))
    hit = profiles.where("print IS NOT NULL").join(prints, "print").select("id", "template", F.lit("exact_version").alias("match"), F.lit(0.99).alias("confidence"), F.lit(False).alias("ambiguous"), F.lit("exact_hash").alias("stage"))
    open_ = profiles.join(hit.select("id"), "id", "left_anti")
    ranked = decide(scored(open_, templates, candidates(open_, templates)))
    rest = open_.select("id").join(ranked, "id", "left").select("id", "template", F.coalesce("match", F.lit("none")).alias("match"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), F.when(F.col("match").isNull(), "indexed_pruning").otherwise("scored").alias("stage"))
    return hit.union(rest)


def layout_signature(aspect, key, regions):  # noqa: ANN001, ANN201
    """Signature of a page: aspect ratio, key of 15 characters, the first 12 regions by place on a grid of 10 x 10; ``regions`` are (y, x, label) sorted."""
    cells = F.transform(F.slice(regions, 1, 12), lambda r: F.concat_ws("_", r["label"], (r["x"] / 100).cast("int"), (r["y"] / 100).cast("int")))
    parts = F.concat(F.array(F.concat(F.lit("ar:"), F.format_string("%.2f", aspect))), F.when(F.length(F.trim(key)) == 15, F.array(F.concat(F.lit("v:"), F.upper(F.trim(key))))).otherwise(F.array().cast("array<string>")), cells)
    return F.concat(F.lit("tpl_"), F.substring(F.sha2(F.array_join(parts, "|"), 256), 1, 12))
