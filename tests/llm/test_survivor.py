from ledgerloom.llm.survivor import best_values

SCHEMA = "reading_id bigint, job_id string, field_name string, value string, confidence double, source string, candidates array<struct<text:string,confidence:double,source:string>>, selection_reason string, pattern string"


def test_survivors(spark):
    rows, n = [], iter(range(1, 10_000))

    def add(job, field, *readings):
        for v, conf, source, cands, why in readings:
            rows.append((next(n), job, field, v, conf, source, cands, why, "x"))

    for i in range(60):  # what makes two readers reliable and two copy each other
        add(f"g{i}", "vendor_name", ("Kuberan Mills", 0.9, "native_pdf", [], None), ("Kuberan Mills", 0.8, "tie_template", [], None), (f"Kuber{i}n Mills" if i % 3 == 0 else "Kuberan Mills", 0.8, "trocr", [], None))
        if i % 2:
            add(f"h{i}", "vendor_name", ("Samudra Foods", 0.9, "native_pdf", [], None), ("Samudra Foods", 0.8, "tie_template", [], None), ("Samndra Foods", 0.9, "llm", [], None), ("Samndra Foods", 0.9, "heuristic", [], None))
    add("a", "buyer_name", ("Wrong Name", 0.99, "native_pdf", [], None), ("Wrong Name", 0.9, "tie_template", [], None), ("Right Name", 0.9, "human_corrected", [], None))
    add("b", "buyer_name", ("Kuberan Ban", 0.95, "native_pdf", [], None), ("Kuberan Bank", 0.7, "trocr", [], None))
    add("c", "buyer_name", (None, 0.2, "llm", [("Kuberan Bank", 0.9, "llm"), ("Kuhran Bank", 0.3, "llm")], "low_confidence"), ("", 0.3, "trocr", None, None))
    add("d", "buyer_name", ("Samndra", 0.8, "llm", [], None), ("Samndra", 0.8, "heuristic", [], None), ("Samudra", 0.8, "native_pdf", [], None))
    add("e", "buyer_name", ("once", 0.8, "llm", [], None))
    add("f", "buyer_name", (None, 0.8, "llm", [], None), ("-", 0.8, "trocr", None, None))
    rows += rows[:5]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.job_id: r.best_value for r in best_values(df).collect()}
    assert got["a"] == "Right Name" and got["b"] == "Kuberan Bank" and got["c"] == "Kuberan Bank" and got["d"] == "Samudra"
    assert "e" not in got and got["f"] is None and got["h1"] == "Samudra Foods"
    assert best_values(df.limit(0)).count() == 0


def test_sources_may_hold_any_character(spark):
    rows = []
    for i, source in enumerate(("ocr,v2", "ocr;v2", "ocr:1|2", "value|x|sure", "", None)):
        rows += [(10 * i + k, f"j{i}", "buyer_name", v, 0.9, s, [], None, "x") for k, (v, s) in enumerate((("Kuberan Bank", source), ("Kuberan Bank", "native_pdf"), ("Kuhran Bank", "llm")))]
    got = {r.job_id: r.best_value for r in best_values(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {f"j{i}": "Kuberan Bank" for i in range(6)}


def test_ties_go_to_the_smaller_string(spark):
    rows = [(k, "j", "buyer_name", v, 0.9, s, [], None, "x") for k, (v, s) in enumerate((("Beta Bank", "ocr"), ("Alpha Bank", "ocr")))]
    assert [r.best_value for r in best_values(spark.createDataFrame(rows, SCHEMA)).collect()] == ["Alpha Bank"]
