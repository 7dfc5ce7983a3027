"""Queries on templates: retrieval of every document's template among those of all families, listings, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import layout
from ledgerloom.operators.templates import candidates, layout_signature, retrieve
from ledgerloom.plans.jobs import _JOBS, jobs
from ledgerloom.plans.layout import _INSIDE, _TOKENS, _ZONES, tokens, zones
from ledgerloom.session import cut, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_P = f"""tok AS (SELECT * FROM {_TOKENS}),
anc AS (SELECT doc_id, lower(text) AS anchor, arg_min((x1 + x2) / 2.0, seq) AS x, arg_min((y1 + y2) / 2.0, seq) AS y FROM tok WHERE regexp_matches(text, '^[A-Za-z]{{8,}}$') GROUP BY 1, 2),
reg AS (SELECT doc_id, label, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM tok JOIN {_ZONES} ON page = 1 AND {_INSIDE} GROUP BY 1, 2),
ext AS (SELECT doc_id, max(page) AS pages, CAST(floor(10.0 * max(y2) FILTER (WHERE page = 1) / max(x2) FILTER (WHERE page = 1)) AS INT) AS bucket FROM tok GROUP BY 1),
ap AS (SELECT doc_id, count(*) AS na, sha256(string_agg(anchor || '@' || CAST(x AS INT) || ',' || CAST(y AS INT), '|' ORDER BY anchor)) AS print FROM anc GROUP BY 1),
prof AS (SELECT d.doc_id AS id, d.template_family_id AS family, j.vendor_gstin AS key, e.pages, e.bucket, ap.print, coalesce(ap.na, 0) AS na FROM documents d JOIN ext e USING (doc_id) LEFT JOIN (SELECT job_id, vendor_gstin FROM {_JOBS}) j ON d.job_id = j.job_id LEFT JOIN ap USING (doc_id)),
first AS (SELECT family, min(id) AS id FROM prof WHERE family IS NOT NULL GROUP BY 1),
stat AS (SELECT template_family_id AS family, count(*) AS samples, count(*) FILTER (WHERE ground_truth_source <> 'human_corrected' OR ground_truth_source IS NULL) / count(*) AS success FROM {_JOBS} WHERE template_family_id IS NOT NULL GROUP BY 1),
tpl AS (SELECT p.*, coalesce(s.samples, 0) AS samples, coalesce(s.success, 1.0) AS success FROM prof p JOIN first f ON p.id = f.id LEFT JOIN stat s ON p.family = s.family),
qry AS (SELECT * FROM prof WHERE id NOT IN (SELECT id FROM first))"""

_C = """hit AS (SELECT q.id, min(t.id) AS template FROM qry q JOIN tpl t ON q.print = t.print GROUP BY 1),
opn AS (SELECT * FROM qry WHERE id NOT IN (SELECT id FROM hit)),
ck AS (SELECT o.id, t.id AS template FROM opn o JOIN (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY id) AS rn FROM tpl WHERE key IS NOT NULL) t ON o.key = t.key AND rn <= 20),
ca AS (SELECT id, template FROM (SELECT id, template, row_number() OVER (PARTITION BY id ORDER BY hits DESC, template) AS rn FROM (SELECT o.id, t.id AS template, count(*) AS hits FROM opn o JOIN anc a ON a.doc_id = o.id JOIN anc b ON a.anchor = b.anchor JOIN tpl t ON b.doc_id = t.id GROUP BY 1, 2)) WHERE rn <= 30),
found AS (SELECT * FROM ck UNION SELECT * FROM ca),
cb AS (SELECT o.id, t.id AS template FROM (SELECT o.id, o.bucket FROM opn o LEFT JOIN (SELECT id, count(*) AS n FROM found GROUP BY 1) f ON o.id = f.id WHERE coalesce(n, 0) < 10) o JOIN (SELECT bucket, id, row_number() OVER (PARTITION BY bucket ORDER BY id) AS rn FROM tpl) t ON abs(o.bucket - t.bucket) <= 1 AND rn <= 5),
cand AS (SELECT id, template FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY template) AS rn FROM (SELECT * FROM found UNION SELECT * FROM cb)) WHERE rn <= 50)"""

_S = """sh AS (SELECT c.id, c.template, count(*) AS shared, avg(greatest(0.0, 1 - sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 300.0)) AS near FROM cand c JOIN anc a ON a.doc_id = c.id JOIN anc b ON b.doc_id = c.template AND a.anchor = b.anchor GROUP BY 1, 2),
rn AS (SELECT doc_id, count(*) AS n FROM reg GROUP BY 1),
ov AS (SELECT c.id, c.template, a.*, b.x1 AS u1, b.y1 AS v1, b.x2 AS u2, b.y2 AS v2, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter FROM cand c JOIN reg a ON a.doc_id = c.id JOIN reg b ON b.doc_id = c.template AND a.label = b.label),
rs AS (SELECT id, template, count(*) AS k, avg(0.6 * greatest(0.0, 1 - sqrt(pow((x1 + x2) / 2.0 - (u1 + u2) / 2.0, 2) + pow((y1 + y2) / 2.0 - (v1 + v2) / 2.0, 2)) / 500.0) + 0.4 * inter / (greatest(1, (x2 - x1) * (y2 - y1)) + greatest(1, (u2 - u1) * (v2 - v1)) - inter)) AS m FROM ov GROUP BY 1, 2),
sc AS (SELECT c.id, c.template, coalesce(sh.near, 0.5) AS spatial, CASE WHEN q.na + t.na = 0 THEN 1.0 ELSE coalesce(sh.shared, 0) / (q.na + t.na - coalesce(sh.shared, 0)) END AS jaccard,
 round(CASE WHEN ra.n IS NULL AND rb.n IS NULL THEN 1.0 WHEN ra.n IS NULL OR rb.n IS NULL THEN 0.5 WHEN rs.k IS NULL THEN 0.0 ELSE 0.4 * rs.k / (ra.n + rb.n - rs.k) + 0.6 * rs.m END + 1e-9, 3) AS region, coalesce(upper(q.key) = upper(t.key), false) AS same, CASE WHEN t.samples >= 3 THEN t.success ELSE 1.0 END AS ok
 FROM cand c JOIN opn q ON c.id = q.id JOIN tpl t ON c.template = t.id LEFT JOIN sh ON sh.id = c.id AND sh.template = c.template LEFT JOIN rn ra ON ra.doc_id = c.id LEFT JOIN rn rb ON rb.doc_id = c.template LEFT JOIN rs ON rs.id = c.id AND rs.template = c.template WHERE abs(q.pages - t.pages) <= 1 OR q.pages = 1 OR t.pages = 1),
fin AS (SELECT id, template, spatial, round((0.35 * jaccard + 0.35 * spatial + 0.20 * region + 0.10 * CAST(same AS INT)) * (0.90 + 0.10 * ok) + 1e-9, 3) AS score FROM sc),
bst AS (SELECT *, coalesce(round(score - nxt, 6) < 0.05, false) AS ambiguous FROM (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS nxt FROM fin WINDOW w AS (PARTITION BY id ORDER BY score DESC, template)) WHERE r = 1),
dec AS (SELECT *, CASE WHEN conf >= 0.88 AND NOT ambiguous AND spatial >= 0.85 THEN 'exact_version' WHEN conf >= 0.70 THEN 'family_anchor' ELSE 'none' END AS match FROM (SELECT *, round(score * CASE WHEN ambiguous THEN 0.9 ELSE 1.0 END + 1e-9, 3) AS conf FROM bst))"""


def _profiles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(documents that ask, templates): the first document of every family is its template."""
    t = tokens(spark, d)
    cx, cy = (F.col("x1") + F.col("x2")) / 2.0, (F.col("y1") + F.col("y2")) / 2.0
    word = t.where(F.col("text").rlike("^[A-Za-z]{8,}$")).groupBy("doc_id", F.lower("text").alias("anchor")).agg(F.min_by(F.struct(cx.alias("x"), cy.alias("y")), "seq").alias("at"))
    sign = F.concat("anchor", F.lit("@"), F.round(F.col("at.x")).cast("int"), F.lit(","), F.round(F.col("at.y")).cast("int"))
    anchors = word.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("anchor", "at"))).alias("anchors"), F.sha2(F.array_join(F.array_sort(F.collect_list(sign)), "|"), 256).alias("print"))
    box = layout.in_regions(t.where("page = 1"), zones(spark)).groupBy("doc_id", "label").agg(F.array(F.min("x1"), F.min("y1"), F.max("x2"), F.max("y2")).alias("box"))
    regions = box.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "box"))).alias("regions"))
    first_page = lambda c: F.max(F.when(F.col("page") == 1, F.col(c)))
    extent = t.groupBy("doc_id").agg(F.max("page").alias("pages"), F.floor(10.0 * first_page("y2") / first_page("x2")).cast("int").alias("bucket"))
    docs = table(spark, d, "documents", ["doc_id", "template_family_id", "job_id"]).join(extent, "doc_id").join(jobs(spark, d, ["vendor_gstin"]).select("job_id", "vendor_gstin"), "job_id", "left")
    none_a, none_r = F.create_map().cast("map<string,struct<x:double,y:double>>"), F.create_map().cast("map<string,array<int>>")
    p = docs.join(anchors, "doc_id", "left").join(regions, "doc_id", "left")
    p = cut(p.select(F.col("doc_id").alias("id"), F.col("template_family_id").alias("family"), F.col("vendor_gstin").alias("key"), "pages", "bucket", "print", F.coalesce("anchors", none_a).alias("anchors"), F.coalesce("regions", none_r).alias("regions")))
    first = p.where("family IS NOT NULL").groupBy("family").agg(F.min("id").alias("id"))
    ok = F.count_if(F.col("ground_truth_source").isNull() | (F.col("ground_truth_source") != "human_corrected"))
    stat = jobs(spark, d, ["template_family_id", "ground_truth_source"]).where("template_family_id IS NOT NULL").groupBy(F.col("template_family_id").alias("family")).agg(F.count("*").alias("samples"), (ok / F.count("*")).alias("success"))
    templates = p.join(first.select("id"), "id").join(stat, "family", "left").na.fill({"samples": 0, "success": 1.0})
    return p.join(first.select("id"), "id", "left_anti"), templates


@query(f"WITH {_P}, {_C} SELECT id, count(*) AS n, min(template) AS least FROM cand GROUP BY 1")
def template_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Templates that the indexes give each document before any is scored (those with an exact fingerprint aside)."""
    profiles, templates = _profiles(spark, d)
    asked = profiles.join(templates.where("print IS NOT NULL").select("print").distinct(), "print", "left_anti")
    return candidates(asked, templates).groupBy("id").agg(F.count("*").alias("n"), F.min("template").alias("least"))


@query(f"WITH {_P}, {_C}, {_S} SELECT id, template, 'exact_version' AS match, 0.99 AS confidence, false AS ambiguous, 'exact_hash' AS stage FROM hit UNION ALL SELECT o.id, CASE WHEN match <> 'none' THEN template END, coalesce(match, 'none'), coalesce(CASE match WHEN 'exact_version' THEN least(0.99, conf) WHEN 'none' THEN score ELSE conf END, 0.0), coalesce(ambiguous, false), CASE WHEN match IS NULL THEN 'indexed_pruning' ELSE 'scored' END FROM opn o LEFT JOIN dec ON o.id = dec.id")
def template_match_decision(spark: SparkSession, d: str) -> DataFrame:
    """Every document against the templates of all families: hash, candidates, score of four factors, decision by margin."""
    return retrieve(*_profiles(spark, d))


@query(f"""WITH {_P}, rg AS (SELECT doc_id, list('' || label || '_' || CAST(x1 // 100 AS INT) || '_' || CAST(y1 // 100 AS INT) ORDER BY y1, x1, label)[1:12] AS cells FROM reg GROUP BY 1), pg AS (SELECT doc_id, max(y2) / max(x2) AS ar FROM tok WHERE page = 1 GROUP BY 1)
SELECT p.id, 'tpl_' || substr(sha256(array_to_string(list_concat(['ar:' || printf('%.2f', ar)], CASE WHEN length(trim(key, ' ')) = 15 THEN ['v:' || upper(trim(key, ' '))] ELSE [] END, coalesce(cells, [])), '|')), 1, 12) AS signature FROM prof p JOIN pg ON pg.doc_id = p.id LEFT JOIN rg ON rg.doc_id = p.id""")
def layout_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Signature of the first page of every document by aspect ratio, vendor and regions on a grid."""
    t = tokens(spark, d).where("page = 1")
    box = layout.in_regions(t, zones(spark)).groupBy("doc_id", "label").agg(F.min("x1").alias("x"), F.min("y1").alias("y"))
    regions = box.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "label"))).alias("r"))
    aspect = t.groupBy("doc_id").agg((F.max("y2") / F.max("x2")).alias("ar"))
    docs = table(spark, d, "documents", ["doc_id", "job_id"]).join(aspect, "doc_id").join(jobs(spark, d, ["vendor_gstin"]).select("job_id", "vendor_gstin"), "job_id", "left").join(regions, "doc_id", "left")
    none = F.array().cast("array<struct<y:int,x:int,label:string>>")
    return docs.select(F.col("doc_id").alias("id"), layout_signature(F.col("ar"), F.col("vendor_gstin"), F.coalesce("r", none)).alias("signature"))
