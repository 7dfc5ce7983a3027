import math
import random

from ledgerloom.llm.mixing import mix_documents, mix_plan, mix_report, temperature, tempered
from ledgerloom.llm.packing import pack, plan_patterns
from ledgerloom.llm.reading import apply_isotonic, is_running, isotonic, reading_levels
from ledgerloom.llm.tokens import TOKENIZERS, count, encoding, with_tokens


def test_packing(spark):
    rnd = random.Random(4)
    sizes = [(i, rnd.choice([0, 3, 700, 41, rnd.randrange(1, 2500)])) for i in range(400)] + [(7, 41)]
    out = pack(spark.createDataFrame(sizes, "doc_id bigint, tokens bigint"), [128, 512, 1024, 512, 0]).collect()
    fill, cap = {}, {}
    for r in out:
        fill[r.container] = fill.get(r.container, 0) + r.tokens
        assert cap.setdefault(r.container, r.capacity) == r.capacity
    assert all(fill[c] <= cap[c] for c in fill) and sum(fill.values()) == sum(t for _, t in sizes)
    split = {r.doc_id for r in out if r.piece > 0}
    assert split <= {i for i, t in sizes if t > 1024} and sum(fill.values()) / sum(cap.values()) > 0.85
    assert pack(spark.createDataFrame([], "doc_id bigint, tokens bigint"), [5]).count() == 0
    assert plan_patterns({5: 3}, [8]) == [(8, 3, [(5, 1)])]


def test_mixing(spark):
    rows = [(f"{s}{i}", s, t) for s, n, t in (("a", 50, 10), ("b", 5, 10), ("hot", 300, 7)) for i in range(n)] + [("z", None, 9), ("y", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id string, source string, tokens bigint")
    targets = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.3, 3), (1, "gone", 0.2, 2)], "mix_id int, source string, target_share double, max_repeats int")
    plan = mix_plan(docs, targets)
    rep = {r.source: r for r in mix_report(plan, mix_documents(docs, plan)).collect()}
    assert abs(rep["a"].actual_share - 0.625) < 0.02 and rep["b"].most_copies == 3 and rep["gone"].mixed_tokens == 0
    assert mix_documents(docs, plan).groupBy("doc_id").count().where("count > 1").count() == 0
    w, t, _ = tempered({"a": 0.5, "b": 0.5}, {"a": 900, "b": 100}, {"a": 1, "b": 2}, 900.0)
    assert 0 < t < 1 and w["b"] * 900 <= 200 + 1e-6
    assert mix_report(plan.limit(0), mix_documents(docs.limit(0), plan)).count() == 0


def test_tokens(spark):
    enc = encoding(TOKENIZERS)
    text = "Invoice no. 42: thanks\n"
    assert enc.decode(enc.encode_ordinary(text)) == text and count(enc, None) == 0 and count(enc, " ") == 0
    got = with_tokens(spark.createDataFrame([(1, text), (2, None), (3, "x " * 20_000)], "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.tokens for r in got}[2] == 0


def test_reading(spark):
    easy, hard = ["The man sent the form.", "We need it by Monday.", "The boxes are here.", "He paid the bill."], ["Subrogation is jurisdictionally indeterminate.", "The novation extinguishes antecedent encumbrances.", "Estoppel precludes contributory restitution."]
    rnd, docs, labels = random.Random(1), [], []
    for i in range(80):
        pool = easy if i % 2 else hard
        docs.append((i, " ".join(rnd.choice(pool) for _ in range(6)), 1.0))
        if i < 50:
            labels.append((i, "r1", 1 if i % 2 else 5))
    docs += [(100, None, 1.0), (101, "", 1.0), (102, "TAX INVOICE\nInvoice No: A-1  Date: 1/2/2026\n1 bolt M8 3 10.00 30.00\n2 | nut | 4 | 5.00 | 20.00", 1.0), (103, "The man sent the form. " * 3000, 1.0)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, score double")
    lab = spark.createDataFrame(labels, "doc_id bigint, rater string, reading_level int")
    got = {r.doc_id: r.reading_level for r in reading_levels(d, lab).collect()}
    assert all(got[i] == (1 if i % 2 else 5) for i in range(50, 80)) and got[103] == 1
    assert not {100, 101, 102} & set(got)
    assert reading_levels(d.limit(0), lab).count() == 0 and reading_levels(d, lab.limit(0)).count() == 0


def test_isotonic():
    x, y = [1, 2, 3, 4, 5], [1, 3, 2, 2, 5]
    curve = isotonic(x, y)
    fit = [apply_isotonic(curve, v) for v in x]
    assert fit == sorted(fit) and fit[0] == 1 and fit[-1] == 5 and abs(fit[1] - 7 / 3) < 1e-9
    assert not is_running("n/a") and is_running("The man at the gate took the boxes.")


def test_mixing_fills_past_a_document_that_does_not_fit(spark):
    docs = spark.createDataFrame([(f"a{i}", "a", 1000 if i < 3 else 10) for i in range(300)] + [(f"b{i}", "b", 10) for i in range(100)], "doc_id string, source string, tokens bigint")
    targets = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.5, 1)], "mix_id int, source string, target_share double, max_repeats int")
    plan = mix_plan(docs, targets)
    got = mix_documents(docs, plan)
    rep = {r.source: r for r in mix_report(plan, got).collect()}
    assert abs(rep["a"].actual_share - 0.5) < 0.005 and rep["a"].most_copies == 1
    assert got.select("order_key").distinct().count() > 60


def test_temperature():
    tokens, limit = {"a": 800, "b": 150, "c": 50, "gone": 0}, {"a": 9, "b": 9, "c": 9, "gone": 9}
    flat = math.log(3)
    w, a, _ = temperature(tokens, limit, flat, 100.0)
    assert a == 0 and abs(w["a"] - 1 / 3) < 1e-9 and w["gone"] == 0
    goal = 0.9
    w, a, _ = temperature(tokens, limit, goal, 100.0)
    assert 0 < a < 1 and abs(-sum(x * math.log(x) for x in w.values() if x) - goal) < 1e-6
    w, a, budget = temperature(tokens, {"a": 1, "b": 1, "c": 2, "gone": 1}, flat, 1000.0)
    assert a > 0.9 and budget * w["c"] <= 100 + 1e-6
    assert temperature({"a": 0}, {"a": 1}, 0.5, 10.0)[0] == {"a": 0.0}


def test_kinds_of_one_capacity_give_every_piece_once(spark, tmp_path):
    from ledgerloom.llm.plans_corpus import p8_containers

    spark.createDataFrame([(i, "word " * (i * 40 + 1)) for i in range(20)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("wide", 512), ("large", 512), ("small", 128)], "container_kind string, capacity_tokens int").write.parquet(f"{tmp_path}/containers.parquet")
    rows = p8_containers(spark, str(tmp_path)).collect()
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows) and {r.container_kind for r in rows} <= {"large", "small"}


def test_mixing_fills_whatever_the_number_of_sizes(spark, monkeypatch):
    from ledgerloom.llm import mixing

    docs = spark.createDataFrame([(f"a{i}", "a", 1000 if i < 3 else 10 + i % 7) for i in range(300)] + [(f"b{i}", "b", 10) for i in range(100)], "doc_id string, source string, tokens bigint")
    targets = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.5, 1)], "mix_id int, source string, target_share double, max_repeats int")
    plan = mix_plan(docs, targets)
    whole = sorted(mix_documents(docs, plan).collect())
    monkeypatch.setattr(mixing, "MAX_FILL", 1, raising=False)
    assert sorted(mix_documents(docs, plan).collect()) == whole
    assert abs(sum(r.tokens * r.copies for r in whole if r.source == "a") - 1000) < 10
