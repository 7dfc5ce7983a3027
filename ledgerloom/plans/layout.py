"""Queries on tokens with positions, over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.geometry import centre_size, iou
from ledgerloom.operators import layout
from ledgerloom.operators.retrieval import fingerprint, inverted_candidates, jaccard
from ledgerloom.operators.segments import page_signals, segment_pages
from ledgerloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Page zones in reading order (label, order, box).
ZONES = [("header", 0, 0, 0, 1000, 150), ("vendor", 1, 0, 100, 500, 300), ("buyer", 2, 500, 100, 1000, 300), ("items", 3, 0, 250, 1000, 700), ("totals", 4, 500, 650, 1000, 880), ("footer", 5, 0, 850, 1000, 1000)]
PHRASES = ["invoice no", "tax invoice", "delivery note", "purchase order", "total", "payment", "contract price"]

_TOKENS = """(SELECT doc_id, CAST(seq // 200 + 1 AS INT) AS page, CAST(seq // 10 AS INT) AS line_no, seq, text, CAST(seq % 10 * 100 AS INT) AS x1, CAST(seq // 10 % 20 * 50 AS INT) AS y1,
 CAST(seq % 10 * 100 + least(95, length(text) * 9) AS INT) AS x2, CAST(seq // 10 % 20 * 50 + 40 AS INT) AS y2 FROM (
 SELECT doc_id, CAST(generate_subscripts(w, 1) - 1 AS INT) AS seq, unnest(w) AS text FROM (SELECT doc_id, string_split(regexp_replace(trim(text, ' '), '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ') AS w FROM documents WHERE trim(text, ' ') <> '')) WHERE text <> '')"""
_ZONES = "(VALUES " + ", ".join(str(z) for z in ZONES) + ") z(label, ord, rx1, ry1, rx2, ry2)"
_INSIDE = "(x1 + x2) / 2 BETWEEN rx1 AND rx2 AND (y1 + y2) / 2 BETWEEN ry1 AND ry2"
_LINES = f"(SELECT doc_id, page, line_no, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, string_agg(text, ' ' ORDER BY x1, seq) AS line, count(*) AS n_tokens FROM {_TOKENS} GROUP BY 1, 2, 3)"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return layout.tokens_of(table(spark, d, "documents", ["doc_id", "text"]))


def zones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ZONES, "label string, ord int, x1 int, y1 int, x2 int, y2 int")


@query(f"SELECT doc_id, page, string_agg(line, chr(10) ORDER BY line_no) AS page_text FROM {_LINES} GROUP BY 1, 2")
def full_text_rebuild(spark: SparkSession, d: str) -> DataFrame:
    return layout.rebuild_text(tokens(spark, d))


@query(f"SELECT label, doc_id, count(*) AS n_tokens, min(seq) AS first_seq FROM {_TOKENS} JOIN {_ZONES} ON {_INSIDE} GROUP BY 1, 2")
def tokens_in_box(spark: SparkSession, d: str) -> DataFrame:
    return layout.in_regions(tokens(spark, d), zones(spark)).groupBy("label", "doc_id").agg(F.count("*").alias("n_tokens"), F.min("seq").alias("first_seq"))


@query(f"SELECT label, count(*) AS n_tokens, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, seq, arg_min(label, ord) AS label FROM {_TOKENS} JOIN {_ZONES} ON {_INSIDE} GROUP BY 1, 2) GROUP BY 1")
def region_assign_first(spark: SparkSession, d: str) -> DataFrame:
    return layout.first_region(tokens(spark, d), zones(spark)).groupBy("label").agg(F.count("*").alias("n_tokens"), F.countDistinct("doc_id").alias("n_docs"))


@query(f"SELECT doc_id, label, count(*) AS n_tokens, sum(greatest(least(x2, rx2) - greatest(x1, rx1), 0) * greatest(least(y2, ry2) - greatest(y1, ry1), 0)) AS area FROM {_TOKENS} JOIN {_ZONES} ON greatest(least(x2, rx2) - greatest(x1, rx1), 0) * greatest(least(y2, ry2) - greatest(y1, ry1), 0) > 0 GROUP BY 1, 2")
def region_overlap_multi(spark: SparkSession, d: str) -> DataFrame:
    return layout.overlapping_regions(tokens(spark, d), zones(spark)).groupBy("doc_id", "label").agg(F.count("*").alias("n_tokens"), F.sum("area").alias("area"))


@query(f"SELECT doc_id, count(*) AS kept FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, page, x1 // 50, y1 // 50, lower(text) ORDER BY seq) rn FROM {_TOKENS}) WHERE rn = 1 GROUP BY 1")
def token_dedupe_grid(spark: SparkSession, d: str) -> DataFrame:
    return layout.dedupe_grid(tokens(spark, d), 50).groupBy("doc_id").agg(F.count("*").alias("kept"))


@query(f"""SELECT doc_id, line_no, part, count(*) AS n_tokens, min(x1) AS x1, max(x2) AS x2 FROM (SELECT *, CAST(sum(wide) OVER (PARTITION BY doc_id, page, line_no ORDER BY x1, seq) AS INT) AS part FROM (
SELECT *, coalesce(CAST(x1 - lag(x2) OVER (PARTITION BY doc_id, page, line_no ORDER BY x1, seq) > 55 AS INT), 0) AS wide FROM {_TOKENS})) GROUP BY 1, 2, 3""")
def line_gap_split(spark: SparkSession, d: str) -> DataFrame:
    return layout.split_lines(tokens(spark, d), 55).groupBy("doc_id", "line_no", "part").agg(F.count("*").alias("n_tokens"), F.min("x1").alias("x1"), F.max("x2").alias("x2"))


@query(f"""SELECT doc_id, page, block_no, count(*) AS n_lines, min(y1) AS y1, max(y2) AS y2 FROM (SELECT *, CAST(sum(s) OVER (PARTITION BY doc_id, page ORDER BY y1, line_no) AS INT) AS block_no FROM (
SELECT *, coalesce(CAST((y1 - lag(y2) OVER w < 0) OR (y1 - lag(y2) OVER w > 0.2 * (lag(y2) OVER w - lag(y1) OVER w)) AS INT), 0) AS s FROM {_LINES} WINDOW w AS (PARTITION BY doc_id, page ORDER BY y1, line_no))) GROUP BY 1, 2, 3""")
def block_cluster(spark: SparkSession, d: str) -> DataFrame:
    return layout.blocks(layout.line_boxes(tokens(spark, d)), 0.2).groupBy("doc_id", "page", "block_no").agg(F.count("*").alias("n_lines"), F.min("y1").alias("y1"), F.max("y2").alias("y2"))


@query(f"SELECT doc_id, page, line_no, reading_rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN y2 <= 380 THEN 0 ELSE 1 END, CASE WHEN y2 <= 380 AND x1 >= 500 THEN 1 ELSE 0 END, y1, x1, line_no) AS reading_rank FROM {_LINES})")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return layout.reading_order(layout.line_boxes(tokens(spark, d))).select("doc_id", "page", "line_no", "reading_rank")


@query(f"""WITH t AS (SELECT *, lead(w0, 1) OVER w AS w1, lead(w0, 2) OVER w AS w2 FROM (SELECT *, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS w0 FROM {_TOKENS}) WINDOW w AS (PARTITION BY doc_id, page ORDER BY seq))
SELECT doc_id, phrase, count(*) AS n, min(seq) AS first_seq FROM t JOIN (VALUES {", ".join("('" + p + "', " + ", ".join(["'" + x + "'" for x in p.split()] + ["NULL"] * (3 - len(p.split()))) + ")" for p in PHRASES)}) p(phrase, p0, p1, p2)
ON t.w0 = p0 AND (p1 IS NULL OR t.w1 = p1) AND (p2 IS NULL OR t.w2 = p2) GROUP BY 1, 2""")
def anchor_ngram_match(spark: SparkSession, d: str) -> DataFrame:
    return layout.phrase_matches(tokens(spark, d), PHRASES).groupBy("doc_id", "phrase").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query(f"""WITH v AS (SELECT doc_id, page, seq, text, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM {_TOKENS} WHERE regexp_matches(text, '^[0-9]+\\.[0-9]{{2}}$')),
l AS (SELECT doc_id, page, seq AS label_seq, text AS label_text, (x1 + x2) / 2 AS lx, (y1 + y2) / 2 AS ly FROM {_TOKENS} WHERE regexp_matches(lower(text), '^total|amount|price')),
n AS (SELECT v.*, label_seq, label_text, round(sqrt(pow(cx - lx, 2) + pow(cy - ly, 2)), 6) AS dist FROM v JOIN l USING (doc_id, page))
SELECT doc_id, seq, text, label_seq, label_text, dist FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, seq, text ORDER BY dist, label_seq) rn FROM n) WHERE rn = 1""")
def nearest_label(spark: SparkSession, d: str) -> DataFrame:
    return layout.nearest_label(tokens(spark, d), "^total|amount|price", r"^[0-9]+\.[0-9]{2}$")


@query(f"""WITH a AS (SELECT DISTINCT doc_id, lower(text) AS w FROM {_TOKENS} WHERE regexp_matches(text, '^[A-Za-z]{{8,}}$'))
SELECT doc_id, substr(sha256(string_agg(w, '|' ORDER BY w)), 1, 16) AS anchor_fingerprint, count(*) AS n_anchors FROM a GROUP BY 1""")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    a = tokens(spark, d).where(F.col("text").rlike("^[A-Za-z]{8,}$")).select("doc_id", F.lower("text").alias("w")).distinct()
    return a.groupBy("doc_id").agg(F.array_sort(F.collect_list("w")).alias("ws")).select("doc_id", fingerprint([F.array_join("ws", "|")]).alias("anchor_fingerprint"), F.size("ws").cast("bigint").alias("n_anchors"))


_FAMILY = "SELECT template_family_id AS id, list_sort(list(DISTINCT field_name || ':' || CAST(page AS VARCHAR))) AS s FROM extracted_fields WHERE template_family_id IS NOT NULL GROUP BY 1"


@query("""WITH a AS (SELECT DISTINCT template_family_id AS id, source || ':' || field_name || ':' || CAST(page AS VARCHAR) AS anchor FROM extracted_fields WHERE template_family_id IS NOT NULL)
SELECT id, other, hits FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits DESC, other) AS rn FROM (SELECT x.id, y.id AS other, count(*) AS hits FROM a x JOIN a y ON x.anchor = y.anchor AND x.id <> y.id GROUP BY 1, 2)) WHERE rn <= 30""")
def inverted_index_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The 30 families that share most anchors with each family (the cut of the retrieval)."""
    f = table(spark, d, "extracted_fields", ["template_family_id", "field_name", "source", "page"]).where("template_family_id IS NOT NULL")
    a = f.select(F.col("template_family_id").alias("id"), F.concat(F.col("source"), F.lit(":"), F.col("field_name"), F.lit(":"), F.col("page")).alias("anchor")).where("anchor IS NOT NULL").distinct()
    return inverted_candidates(a, a, 30)


@query("""WITH w AS (SELECT doc_id, list_distinct(string_split(regexp_replace(lower(trim(text, ' ')), '[^a-z]+', ' ', 'g'), ' ')) AS s, template_family_id FROM documents WHERE template_family_id IS NOT NULL AND trim(text, ' ') <> ''),
f AS (SELECT template_family_id, arg_min(s, doc_id) AS first_set, min(doc_id) AS first_doc FROM w GROUP BY 1)
SELECT w.doc_id, f.first_doc, round(CAST(len(list_intersect(w.s, f.first_set)) AS DOUBLE) / len(list_distinct(list_concat(w.s, f.first_set))), 6) AS anchor_jaccard FROM w JOIN f USING (template_family_id)""")
def anchor_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Word-set similarity of every document with the first one of its template family."""
    docs = table(spark, d, "documents", ["doc_id", "text", "template_family_id"]).where("template_family_id IS NOT NULL").where(F.trim("text") != "")
    w = docs.select("doc_id", "template_family_id", F.array_distinct(F.split(F.regexp_replace(F.lower(F.trim("text")), "[^a-z]+", " "), " ")).alias("s"))
    f = w.groupBy("template_family_id").agg(F.min_by("s", "doc_id").alias("first_set"), F.min("doc_id").alias("first_doc"))
    return w.join(f, "template_family_id").select("doc_id", "first_doc", F.round(jaccard(F.col("s"), F.col("first_set")), 6).alias("anchor_jaccard"))


_B = "SELECT DISTINCT reading_id, job_id, field_name, page, source, CAST(least(bbox[1], bbox[3]) AS INT) AS x1, CAST(least(bbox[2], bbox[4]) AS INT) AS y1, CAST(greatest(bbox[1], bbox[3]) AS INT) AS x2, CAST(greatest(bbox[2], bbox[4]) AS INT) AS y2 FROM extracted_fields WHERE len(bbox) = 4"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "extracted_fields", ["reading_id", "job_id", "field_name", "page", "source", "bbox"]).where("size(bbox) = 4")
    pick = lambda fn, i, j: fn(F.col("bbox")[i], F.col("bbox")[j]).cast("int")
    return f.select("reading_id", "job_id", "field_name", "page", "source", pick(F.least, 0, 2).alias("x1"), pick(F.least, 1, 3).alias("y1"), pick(F.greatest, 0, 2).alias("x2"), pick(F.greatest, 1, 3).alias("y2")).distinct()


@query(f"""WITH b AS ({_B}) SELECT a.reading_id AS reading_a, c.reading_id AS reading_b, round(coalesce(i / nullif((a.x2 - a.x1) * (a.y2 - a.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) - i, 0), 0), 6) AS iou
FROM b a JOIN b c ON a.job_id = c.job_id AND a.field_name = c.field_name AND a.page = c.page AND a.reading_id < c.reading_id, LATERAL (SELECT CAST(greatest(least(a.x2, c.x2) - greatest(a.x1, c.x1), 0) * greatest(least(a.y2, c.y2) - greatest(a.y1, c.y1), 0) AS DOUBLE) AS i)""")
def box_iou(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of the boxes that readings of one field on one page give; a field has few readings."""
    b = _boxes(spark, d)
    a = b.select("job_id", "field_name", "page", F.col("reading_id").alias("reading_a"), *[F.col(c).alias("a_" + c) for c in ("x1", "y1", "x2", "y2")])
    c = b.select("job_id", "field_name", "page", F.col("reading_id").alias("reading_b"), *[F.col(c).alias("b_" + c) for c in ("x1", "y1", "x2", "y2")])
    box = lambda p: tuple(F.col(p + c) for c in ("x1", "y1", "x2", "y2"))
    return a.join(c, ["job_id", "field_name", "page"]).where("reading_a < reading_b").select("reading_a", "reading_b", F.round(iou(box("a_"), box("b_")), 6).alias("iou"))


@query(f"SELECT reading_id, round((x1 + x2) / 2 / 1000, 6) AS cx, round((y1 + y2) / 2 / 1000, 6) AS cy, round((x2 - x1) / 1000, 6) AS w, round((y2 - y1) / 1000, 6) AS h FROM ({_B})")
def box_centre_size(spark: SparkSession, d: str) -> DataFrame:
    cols = centre_size(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), F.lit(1000.0), F.lit(1000.0))
    return _boxes(spark, d).select("reading_id", *[c.alias(n) for c, n in zip(cols, ("cx", "cy", "w", "h"))])


@query()
def line_cluster_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Order-dependent: checked against brute force on a fixture."""
    return layout.greedy_lines(tokens(spark, d)).groupBy("doc_id", "page").agg(F.countDistinct("cluster").alias("n_lines"), F.count("*").alias("n_tokens"))


@query()
def segment_pages_fold(spark: SparkSession, d: str) -> DataFrame:
    """A fold with state: checked against brute force on a fixture."""
    return segment_pages(page_signals(layout.rebuild_text(tokens(spark, d))))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d)
    number, name = F.col("text").rlike("^[0-9][0-9.,]*$"), F.col("text").rlike("^[A-Z][a-z]+$")
    kind = F.when(number, "NUM").when(name, "NAME")
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("seq")
    t = t.withColumn("k", kind)
    label = F.when(F.col("k").isNull(), "O").when(F.col("k").eqNullSafe(F.lag("k").over(w)), F.concat(F.lit("I-"), "k")).otherwise(F.concat(F.lit("B-"), "k"))
    return t.select("doc_id", "seq", label.alias("label"), F.round(F.length("text") / (F.length("text") + 2), 6).alias("confidence"))


_K = f"SELECT doc_id, seq, text, CASE WHEN regexp_matches(text, '^[0-9][0-9.,]*$') THEN 'NUM' WHEN regexp_matches(text, '^[A-Z][a-z]+$') THEN 'NAME' END AS k FROM {_TOKENS}"
_L = f"SELECT doc_id, seq, k, round(length(text) / (length(text) + 2), 6) AS confidence, CASE WHEN k IS NULL THEN 'O' WHEN k IS NOT DISTINCT FROM lag(k) OVER (PARTITION BY doc_id ORDER BY seq) THEN 'I-' || k ELSE 'B-' || k END AS label FROM ({_K})"


@query(f"""WITH l AS ({_L}), s AS (SELECT *, sum(CAST(label LIKE 'B-%' AS INT)) OVER (PARTITION BY doc_id ORDER BY seq) AS span FROM l)
SELECT doc_id, span, k AS kind, min(seq) AS from_seq, max(seq) AS to_seq, count(*) AS n_tokens FROM s WHERE k IS NOT NULL GROUP BY 1, 2, 3""")
def bio_spans(spark: SparkSession, d: str) -> DataFrame:
    return layout.bio_spans(_labelled(spark, d))


@query(f"""WITH l AS ({_L}), c AS (SELECT *, unnest(range(greatest(0, CAST(ceil((seq - 63) / 32) AS INT)), seq // 32 + 1)) AS chunk FROM l),
s AS (SELECT *, round(confidence * least(1.0, (least(seq - chunk * 32, 63 - (seq - chunk * 32)) + 1) / 16.0), 6) AS sure FROM c)
SELECT doc_id, seq, label, sure, n_chunks FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, seq) AS n_chunks, row_number() OVER (PARTITION BY doc_id, seq ORDER BY CAST(label <> 'O' AS INT) DESC, sure DESC, chunk) rn FROM s) WHERE rn = 1""")
def chunk_windows_vote(spark: SparkSession, d: str) -> DataFrame:
    return layout.chunk_votes(_labelled(spark, d), 64, 32)


_T = f"SELECT f.run_id, f.template_family_id AS fam, j.vendor_gstin AS key, f.field_name AS anchor, avg((least(bbox[1], bbox[3]) + greatest(bbox[1], bbox[3])) / 2) AS x, avg((least(bbox[2], bbox[4]) + greatest(bbox[2], bbox[4])) / 2) AS y FROM (SELECT DISTINCT reading_id, run_id, job_id, template_family_id, field_name, bbox FROM extracted_fields WHERE len(bbox) = 4 AND template_family_id IS NOT NULL) f JOIN (SELECT job_id, vendor_gstin FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY received_at DESC, batch_no) rn FROM invoice_facts) WHERE rn = 1 AND vendor_gstin <> '') j ON f.job_id = j.job_id GROUP BY 1, 2, 3, 4"


@query(f"""WITH b AS ({_T}), h AS (SELECT key, fam, row_number() OVER (PARTITION BY key ORDER BY n DESC, fam) AS rn FROM (SELECT key, fam, count(*) AS n FROM b GROUP BY 1, 2)),
t AS (SELECT fam, anchor, avg(x) AS bx, avg(y) AS byy FROM b GROUP BY 1, 2), nq AS (SELECT run_id, count(DISTINCT anchor) AS nq FROM b GROUP BY 1), nt AS (SELECT fam, count(*) AS nt FROM t GROUP BY 1),
s AS (SELECT b.run_id, h.fam, avg(greatest(0.0, 1 - sqrt(pow(b.x - t.bx, 2) + pow(b.y - t.byy, 2)) / 300.0)) AS spatial, count(*) AS shared FROM b JOIN h ON b.key = h.key AND h.rn <= 20 JOIN t ON t.fam = h.fam AND t.anchor = b.anchor GROUP BY 1, 2),
c AS (SELECT s.run_id, s.fam, round(0.5 * shared / (nq + nt - shared) + 0.5 * spatial, 4) AS score FROM s JOIN nq USING (run_id) JOIN nt USING (fam))
SELECT run_id AS id, fam AS template, score, round(score - coalesce(nxt, 0), 6) AS margin, round(score - coalesce(nxt, 0), 6) < 0.05 AS ambiguous FROM (SELECT *, lead(score) OVER w AS nxt, row_number() OVER w AS rn FROM c WINDOW w AS (PARTITION BY run_id ORDER BY score DESC, fam)) WHERE rn = 1""")
def template_match(spark: SparkSession, d: str) -> DataFrame:
    """Every run against the template families of its vendor: anchors are its fields, placed by their boxes."""
    from ledgerloom.operators.retrieval import match_templates
    from ledgerloom.plans.jobs import jobs

    f = table(spark, d, "extracted_fields", ["reading_id", "run_id", "job_id", "template_family_id", "field_name", "bbox"]).distinct().where("size(bbox) = 4 AND template_family_id IS NOT NULL")
    mid = lambda i, k: (F.least(F.col("bbox")[i], F.col("bbox")[k]) + F.greatest(F.col("bbox")[i], F.col("bbox")[k])) / 2
    b = f.join(jobs(spark, d, ["vendor_gstin"]).where("vendor_gstin <> ''").select("job_id", F.col("vendor_gstin").alias("key")), "job_id")
    b = b.groupBy("run_id", "template_family_id", "key", F.col("field_name").alias("anchor")).agg(F.avg(mid(0, 2)).alias("x"), F.avg(mid(1, 3)).alias("y"))
    from pyspark.sql import Window

    heavy = b.withColumn("weight", F.count("*").over(Window.partitionBy("key", "template_family_id")))
    return match_templates(b.select(F.col("run_id").alias("id"), "key", "anchor", "x", "y"), heavy.select(F.col("template_family_id").alias("id"), "key", "anchor", "x", "y", "weight"))


@query()
def token_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of documents that belong to a job, tagged with that job's field values (checked on a fixture)."""
    from ledgerloom.operators.extraction import tag_tokens
    from ledgerloom.plans.jobs import jobs

    docs = table(spark, d, "documents", ["doc_id", "job_id"]).where("job_id IS NOT NULL")
    names = ["invoice_number", "invoice_date", "vendor_name", "buyer_name", "vendor_gstin"]
    fields = jobs(spark, d, names).select("job_id", F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value"), F.lit(i).alias("ord")) for i, n in enumerate(names)])))
    values = docs.join(fields.where("value <> ''"), "job_id").select("doc_id", "field", "value", "ord")
    t = tokens(spark, d).join(docs, "doc_id", "left_semi").select("doc_id", "seq", "text")
    return tag_tokens(t, values).where("label <> 'O'")
