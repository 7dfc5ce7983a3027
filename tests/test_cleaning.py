"""Cleaners, boxes and comparisons on cases worked out by hand."""

import math

from pyspark.sql import functions as F

from ledgerloom.functions import boxes, cleaning, money
from ledgerloom.operators import evaluation
from ledgerloom.operators.layout import phrase_matches
from ledgerloom.operators.templates import retrieve
from ledgerloom.operators.timestamps import normalise_timestamps


def values(spark, f, rows, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


def test_names_numbers_and_dates(spark):
    assert values(spark, cleaning.clean_vendor, ["TAX INVOICE\nKuberan Mills", "Invoice : Kuberan Mills Plot No 7, Pune", "60", "", None]) == ["INVOICE", "Kuberan Mills", "60", "", None]
    assert values(spark, cleaning.clean_buyer, ["Bill To:\nM/s Kolm Traders GSTIN 12", "Buyer Name: A. B. & Co."]) == ["Kolm Traders", "A. B. & Co"]
    assert values(spark, cleaning.clean_place, ["Place of Supply: Medhor (66) Phone 1", "0khabet"]) == ["Medhor (66)", "0khabet"]
    assert values(spark, cleaning.clean_invoice_number, ["Invoice No: MIM/26-27/340 Date 1", "Bill # 7", "A-1 12-03-2026"]) == ["MIM/26-27/340", "7", "A-1"]
    assert values(spark, cleaning.clean_date, ["on 3-Aug-26.", "7 Sept 2026", "due 2026-01-05 noon", " net 30 "]) == ["03/08/2026", "07/09/2026", "2026-01-05", "net 30"]
    assert values(spark, cleaning.clean_words, ["Amount in words: Rupees Ten Only", "Total Amount", "bolts"]) == ["Rupees Ten Only", None, None]


def test_amounts_and_codes(spark):
    assert values(spark, cleaning.clean_amount, ["Rs. 1,560.00", "(12.5)", "18%", "x", "-3"]) == [1560.0, -12.5, None, None, -3.0]
    assert values(spark, cleaning.digits_float, ["-Rs 1,2.5", "1.2.3", ""]) == [-12.5, None, None] and values(spark, cleaning.cell_number, ["3,000.00 kg", None, "-"]) == [3000.0, 0.0, 0.0]
    assert values(spark, cleaning.bank_code, ["sahyO123456", "DEPT0123456", "short"]) == ["SAHY0123456", None, None]
    assert values(spark, money.amount_in_words, [1250.5, 0.0, 0.25, 2345678901.0], "double") == ["Rupees One Thousand Two Hundred Fifty and Fifty Paise Only", "", "Rupees Twenty Five Paise Only", "Rupees Two Hundred Thirty Four Crore Fifty Six Lakh Seventy Eight Thousand Nine Hundred One Only"]
    pairs = spark.createDataFrame([(100.0, 102.0), (102.1, 100.0), (None, None), (1.0, None)], "a double, b double")
    assert [tuple(r) for r in pairs.select(cleaning.share_match(F.col("a"), F.col("b")), cleaning.close_variant(F.col("a"), F.col("b"), 0.5, 0.01)).collect()] == [(True, False), (False, False), (None, True), (None, False)]


def test_boxes(spark):
    rows = [[0.0, 0.0, 620.0, 877.0], [1239.0, 10.0, 1240.0, 10.0], [0.1, 0.2, 0.3, 0.4], [10.0, 10.0, 10.0, 20.0]]
    w, h = F.lit(1240), F.lit(1754)
    assert values(spark, lambda b: boxes.to_thousandths(b, w, h), rows, "array<double>")[:2] == [[0, 0, 500, 500], [999, 5, 1000, 7]]
    assert values(spark, lambda b: boxes.auto_thousandths(b, w, h), rows, "array<double>")[1:] == [[999, 6, 1000, 8], [100, 200, 300, 400], [10, 10, 12, 20]]
    assert values(spark, lambda b: boxes.with_margin(b, w, h), rows, "array<double>")[0] == [0, 0, 651, 920]
    assert values(spark, boxes.sound, [[0.0, 0.0, 1.0, 1.0], [1.0, 0.0, 1.0, 1.0], None, [1.0]], "array<double>") == [True, False, False, False]


def test_whole_phrases_count(spark):
    t = spark.createDataFrame([(1, 1, i, w) for i, w in enumerate("place of supply nowhere place of supply State:".split())], "doc_id int, page int, seq int, text string")
    assert [(r.phrase, r.seq) for r in phrase_matches(t, ["place of supply state"]).collect()] == [("place of supply state", 4)]


def test_margins_triples_and_word_errors(spark):
    r = spark.createDataFrame([(1, "j", "vendor_gstin", "A", 0.9), (2, "j", "vendor_gstin", "B", 0.8), (3, "k", "grand_total", "5.00", 0.9), (4, "k", "grand_total", "5.01", 0.9), (5, "l", "x", "a", 0.5)], "reading_id int, job_id string, field_name string, value string, confidence double")
    got = {r.job_id: r.calibrated for r in evaluation.with_margin_penalty(r).collect()}
    assert math.isclose(got["j"], 0.9 * 0.85, abs_tol=1e-4) and got["k"] == 0.9 and got["l"] == 0.5
    c = spark.createDataFrame([("a", [1.0, 100.0], [18.0], [1.0, 118.0]), ("b", [5.0], [], [5.0]), ("c", [5.0], [1.0], [5.0])], "job_id string, subs array<double>, taxes array<double>, totals array<double>")
    assert sorted(tuple(r) for r in evaluation.accounting_triples(c).collect()) == [("a", 100.0, 18.0, 118.0), ("b", 5.0, 0.0, 5.0)]
    w = spark.createDataFrame([("a b c", "a x c"), ("", ""), ("a", ""), (None, "a b")], "t string, r string")
    assert [round(r[0], 4) for r in w.select(evaluation.word_error_rate("t", "r")).collect()] == [0.3333, 0.0, 1.0, 1.0]


def test_retrieval_decides(spark):
    kind = "id bigint, print string, key string, bucket int, pages int, anchors map<string,struct<x:double,y:double>>, regions map<string,array<int>>"
    at = lambda *ws, dx=0.0: {w: (10.0 * i + dx, 5.0) for i, w in enumerate(ws)}
    box = {"header": [0, 0, 1000, 150]}
    t = spark.createDataFrame([(1, "p1", "K" * 15, 14, 1, at("alpha", "beta", "gamma"), box, 5, 1.0), (2, "p2", None, 9, 1, at("delta"), {}, 0, 1.0)], kind + ", samples int, success double")
    q = spark.createDataFrame([(10, "p1", None, 0, 1, at("z"), {}), (11, "x", "k" * 15, 14, 1, at("alpha", "beta", "gamma", dx=3.0), box), (12, None, None, 90, 1, {}, {}), (13, "y", None, 14, 1, at("alpha", "q", "r", "s"), box)], kind)
    got = {r.id: r for r in retrieve(q, t).collect()}
    assert (got[10].match, got[10].stage, got[10].template) == ("exact_version", "exact_hash", 1)
    assert got[11].match == "exact_version" and got[11].template == 1 and got[11].confidence > 0.95
    assert (got[12].match, got[12].stage, got[12].confidence) == ("none", "indexed_pruning", 0.0)
    assert got[13].match == "none" and got[13].template is None


def test_a_declared_order_is_outweighed_by_enough_values(spark):
    rows = [("s", f"{m:02d}/{d:02d}/2026") for m in range(1, 13) for d in range(13, 29)] * 12 + [("s", "03/04/2026"), ("t", "03/04/2026"), ("u", "03/04/2026")]
    df = spark.createDataFrame([(s, v, None, "DMY" if s != "u" else None) for s, v in rows], "src string, v string, zone string, declared string")
    got = {(r.src, r.v): (r.ts_normal, r.ts_status) for r in normalise_timestamps(df, "v", "src", "zone", "declared").collect()}
    assert got[("s", "03/04/2026")][0] == "2026-03-04" and got[("t", "03/04/2026")][0] == "2026-04-03"
    assert got[("u", "03/04/2026")] == ("2026-04-03", "ambiguous")
    fixed = normalise_timestamps(df, "v", "src", "zone", "declared", declared_counts=math.inf)
    assert fixed.where("src = 's' AND v = '03/04/2026'").first().ts_normal == "2026-04-03"
