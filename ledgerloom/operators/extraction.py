"""Line items and amounts out of plain text lines; candidates by anchor rules; windows of agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A line of an item listing ends in quantity, rate and amount.
ITEM = r"^\s*(\d+)[\s|.)]+(.*?)[\s|]+(\d+(?:\.\d+)?)[\s|]+(\d+\.\d{2})[\s|]+(\d+\.\d{2})[\s|]*$"


def text_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of whole texts."""
    return documents.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def line_items(lines: DataFrame) -> DataFrame:
    """Position, description, quantity, rate and amount of the lines that list an item."""
    g = lambda i: F.regexp_extract("line", ITEM, i)
    return lines.where(F.col("line").rlike(ITEM)).select(
        "doc_id", "line_no", g(1).try_cast("int").alias("pos"), F.trim(g(2)).alias("description"), g(3).try_cast("double").alias("quantity"), g(4).try_cast("double").alias("rate"), g(5).try_cast("double").alias("amount")
    )


def labelled_values(lines: DataFrame, labels: dict[str, str], value: str) -> DataFrame:
    """Candidates by rule: for every label pattern the first value behind it on its line; (doc_id, field, value, line_no)."""
    found = [F.struct(F.lit(f).alias("field"), F.nullif(F.regexp_extract("line", f"(?i){p}[^0-9A-Za-z]*{value}", 1), F.lit("")).alias("value")) for f, p in labels.items()]
    return lines.select("doc_id", "line_no", F.inline(F.array(*found))).where(F.col("value").isNotNull())


def best_labelled(candidates: DataFrame) -> DataFrame:
    """The earliest candidate of every document and field, with the number of candidates."""
    w = Window.partitionBy("doc_id", "field")
    df = candidates.withColumn("n", F.count("*").over(w)).withColumn("_rn", F.row_number().over(w.orderBy("line_no", "value")))
    return df.where("_rn = 1").drop("_rn")


def tag_tokens(tokens: DataFrame, values: DataFrame) -> DataFrame:
    """BIO labels of tokens by known field values; ``values`` has doc_id, field, value and ord.

    Fields are placed in their order and a token is taken once, so a document is worked off in one
    piece (its tokens and fields are bounded by nature). The first free run of tokens that spells a
    value is taken; values that are not found label nothing.
    """
    import pandas as pd

    def run(key: tuple, t: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("seq")
        words = ["".join(c for c in str(x).lower() if c.isalnum()) for x in t["text"]]
        labels = ["O"] * len(words)
        for r in v.sort_values(["ord", "field"]).itertuples():
            want = [w for w in ("".join(c for c in x.lower() if c.isalnum()) for x in str(r.value).split()) if w]
            n = len(want)
            for i in range(len(words) - n + 1):
                if n and words[i : i + n] == want and all(x == "O" for x in labels[i : i + n]):
                    labels[i : i + n] = [f"B-{r.field}"] + [f"I-{r.field}"] * (n - 1)
                    break
        return pd.DataFrame({"doc_id": t["doc_id"].tolist(), "seq": t["seq"].tolist(), "label": pd.Series(labels, dtype=object)})

    return tokens.groupBy("doc_id").cogroup(values.groupBy("doc_id")).applyInPandas(run, "doc_id bigint, seq int, label string")
