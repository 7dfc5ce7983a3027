"""Tokens with boxes: rebuilding text, lines, blocks and regions from positions."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.geometry import inside, overlap_area

TOKEN_COLUMNS = ["doc_id", "page", "line_no", "seq", "text", "x1", "y1", "x2", "y2"]


def tokens_of(documents: DataFrame) -> DataFrame:
    """Word tokens of whole texts on a grid: ten words a line, twenty lines a page."""
    words = F.split(F.regexp_replace(F.trim("text"), r"[ \t\n\r\f]+", " "), " ")
    t = documents.where(F.trim("text") != "").select("doc_id", F.posexplode(words).alias("seq", "text")).where("text <> ''")
    x1, y1 = F.expr("cast(seq % 10 * 100 as int)"), F.expr("cast(seq div 10 % 20 * 50 as int)")
    return t.select(
        "doc_id", F.expr("cast(seq div 200 + 1 as int)").alias("page"), F.expr("cast(seq div 10 as int)").alias("line_no"), "seq", "text",
        x1.alias("x1"), y1.alias("y1"), (x1 + F.least(F.lit(95), F.length("text") * 9)).cast("int").alias("x2"), (y1 + 40).cast("int").alias("y2"),
    )


def _box(prefix: str = "") -> tuple:
    return tuple(F.col(prefix + c) for c in ("x1", "y1", "x2", "y2"))


def rebuild_text(tokens: DataFrame) -> DataFrame:
    """Text of every page, lines in order of position."""
    lines = tokens.groupBy("doc_id", "page", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x1", "seq", "text"))), lambda e: e["text"]), " ").alias("line"))
    return lines.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda e: e["line"]), "\n").alias("page_text"))


def in_regions(tokens: DataFrame, regions: DataFrame) -> DataFrame:
    """Every token with every region that holds its centre; ``regions`` is a fixed list of page zones."""
    r = F.broadcast(regions.select(F.col("label"), F.col("ord"), *[F.col(c).alias("r_" + c) for c in ("x1", "y1", "x2", "y2")]))
    return tokens.join(r, inside(_box(), _box("r_")))


def first_region(tokens: DataFrame, regions: DataFrame) -> DataFrame:
    """The first region, in list order, that holds a token's centre."""
    hit = in_regions(tokens, regions)
    return hit.groupBy("doc_id", "seq").agg(F.min_by("label", "ord").alias("label"))


def overlapping_regions(tokens: DataFrame, regions: DataFrame) -> DataFrame:
    """Tokens with all regions they overlap, and the area in common."""
    r = F.broadcast(regions.select("label", *[F.col(c).alias("r_" + c) for c in ("x1", "y1", "x2", "y2")]))
    area = overlap_area(_box(), _box("r_"))
    return tokens.join(r, area > 0).select("doc_id", "seq", "label", area.alias("area"))


def dedupe_grid(tokens: DataFrame, cell: int = 5) -> DataFrame:
    """One token per page, grid cell and lower-case text, the earliest first."""
    cellx, celly = F.expr(f"x1 div {cell}"), F.expr(f"y1 div {cell}")
    w = Window.partitionBy("doc_id", "page", cellx, celly, F.lower("text")).orderBy("seq")
    return tokens.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def split_lines(tokens: DataFrame, gap: int) -> DataFrame:
    """Lines are cut where the gap to the token on the left is wider than ``gap``; adds ``part`` from 0."""
    w = Window.partitionBy("doc_id", "page", "line_no").orderBy("x1", "seq")
    wide = (F.col("x1") - F.lag("x2").over(w) > gap).cast("int")
    return tokens.withColumn("_wide", F.coalesce(wide, F.lit(0))).withColumn("part", F.sum("_wide").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_wide")


def line_boxes(tokens: DataFrame) -> DataFrame:
    """Union box, text and token count of every line."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x1", "seq", "text"))), lambda e: e["text"]), " ")
    return tokens.groupBy("doc_id", "page", "line_no").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), text.alias("line"), F.count("*").alias("n_tokens"))


def blocks(lines: DataFrame, factor: float = 1.8) -> DataFrame:
    """Blocks of consecutive lines whose vertical gap is at most ``factor`` times the height of the line before."""
    w = Window.partitionBy("doc_id", "page").orderBy("y1", "line_no")
    gap, height = F.col("y1") - F.lag("y2").over(w), F.lag("y2").over(w) - F.lag("y1").over(w)
    starts = F.coalesce(((gap < 0) | (gap > factor * height)).cast("int"), F.lit(0))
    return lines.withColumn("_s", starts).withColumn("block_no", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_s")


def reading_order(lines: DataFrame, top: int = 380, middle: int = 500) -> DataFrame:
    """Rank of a line: in the top band left column before right, below it by position."""
    band = F.when(F.col("y2") <= top, 0).otherwise(1)
    column = F.when((F.col("y2") <= top) & (F.col("x1") >= middle), 1).otherwise(0)
    w = Window.partitionBy("doc_id", "page").orderBy(band, column, "y1", "x1", "line_no")
    return lines.withColumn("reading_rank", F.row_number().over(w))


def phrase_matches(tokens: DataFrame, phrases: list[str]) -> DataFrame:
    """Occurrences of whole phrases as runs of tokens on one page (case and punctuation aside)."""
    clean = F.regexp_replace(F.lower("text"), "[^a-z0-9]", "")
    w = Window.partitionBy("doc_id", "page").orderBy("seq")
    split = {p: "".join(c if c.isalnum() else " " for c in p.lower()).split() for p in phrases}
    longest = max(map(len, split.values()), default=1)
    t = tokens.withColumn("w0", clean).withColumns({f"w{k}": F.lead(clean, k).over(w) for k in range(1, longest)})
    out = None
    for p, words in split.items():
        hit = F.col("w0") == words[0]
        for k, word in enumerate(words[1:], 1):
            hit = hit & (F.col(f"w{k}") == word)
        part = F.when(hit, F.lit(p))
        out = [part] if out is None else [*out, part]
    return t.select("doc_id", "page", "seq", F.explode(F.array_compact(F.array(*out))).alias("phrase"))


def nearest_label(tokens: DataFrame, label: str, value: str) -> DataFrame:
    """For every token that looks like ``value`` (pattern) the nearest token on its page that matches ``label``."""
    keep = ["doc_id", "page", "seq", "text", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy")]
    v = tokens.where(F.col("text").rlike(value)).select(*keep)
    lab = tokens.where(F.lower("text").rlike(label)).select("doc_id", "page", F.col("seq").alias("label_seq"), F.col("text").alias("label_text"), keep[4].alias("lx"), keep[5].alias("ly"))
    d = F.sqrt(F.pow(F.col("cx") - F.col("lx"), 2) + F.pow(F.col("cy") - F.col("ly"), 2))
    near = v.join(lab, ["doc_id", "page"]).withColumn("dist", F.round(d, 6))
    best = F.min_by(F.struct("label_seq", "label_text", "dist"), F.struct("dist", "label_seq"))
    return near.groupBy("doc_id", "seq", "text").agg(best.alias("b")).select("doc_id", "seq", "text", "b.label_seq", "b.label_text", "b.dist")


def greedy_lines(tokens: DataFrame, overlap: float = 0.45) -> DataFrame:
    """Greedy line clustering: tokens by (y, x) join the first line they overlap enough vertically.

    The assignment depends on how each line has grown so far, so a page is worked off in one piece;
    a page holds a bounded number of tokens by nature.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lines: list[list[float]] = []
        out = []
        for r in pdf.sort_values(["y1", "x1", "seq"]).itertuples():
            at = None
            for i, (top, bottom) in enumerate(lines):
                common, least = min(bottom, r.y2) - max(top, r.y1), max(1, min(bottom - top, r.y2 - r.y1))
                if common / least >= overlap or abs((top + bottom) / 2 - (r.y1 + r.y2) / 2) <= overlap * least:
                    at = i
                    break
            if at is None:
                lines.append([r.y1, r.y2])
                at = len(lines) - 1
            else:
                lines[at] = [min(lines[at][0], r.y1), max(lines[at][1], r.y2)]
            out.append((r.doc_id, r.page, r.seq, at))
        return pd.DataFrame(out, columns=["doc_id", "page", "seq", "cluster"])

    return tokens.groupBy("doc_id", "page").applyInPandas(run, "doc_id bigint, page int, seq int, cluster int")


def chunk_votes(labelled: DataFrame, size: int, stride: int) -> DataFrame:
    """Overlapping windows over a sequence: every token is seen in each chunk it falls into and the surest label wins.

    ``labelled`` has doc_id, seq, label and confidence; confidence fades towards a chunk's borders.
    """
    chunks = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("seq") - size + 1) / stride).cast("int")), F.floor(F.col("seq") / stride).cast("int"))
    seen = labelled.withColumn("chunk", F.explode(chunks))
    edge = F.least(F.col("seq") - F.col("chunk") * stride, F.lit(size - 1) - (F.col("seq") - F.col("chunk") * stride))
    seen = seen.withColumn("sure", F.round(F.col("confidence") * F.least(F.lit(1.0), (edge + 1) / (size / 4.0)), 6))
    best = F.max_by(F.struct("label", "sure", "chunk"), F.struct((F.col("label") != "O").cast("int"), F.col("sure"), -F.col("chunk")))
    return seen.groupBy("doc_id", "seq").agg(best.alias("b"), F.count("*").alias("n_chunks")).select("doc_id", "seq", "b.label", "b.sure", "n_chunks")


def bio_spans(labelled: DataFrame) -> DataFrame:
    """Runs of B-/I- labels: a B, or an I of another kind, opens a span; O closes it."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    kind = F.when(F.col("label") != "O", F.substring("label", 3, 100))
    df = labelled.withColumn("kind", kind)
    opens = F.col("kind").isNotNull() & (F.col("label").startswith("B-") | ~F.col("kind").eqNullSafe(F.lag("kind").over(w)))
    df = df.withColumn("span", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.where("kind is not null").groupBy("doc_id", "span", "kind").agg(F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq"), F.count("*").alias("n_tokens"))


