import random

from ledgerloom.llm.history import EDITS, build_segments, entries, number_core, probe, probes, same_invoice, segments, tax_core
from ledgerloom.llm.text import distance


def test_segments_find_everything_within_the_bound():
    rnd = random.Random(2)
    for _ in range(400):
        s = "".join(rnd.choice("AB12") for _ in range(rnd.randrange(4, 14)))
        t = list(s)
        for _ in range(EDITS):
            k, op = rnd.randrange(len(t)), rnd.randrange(3)
            t[k : k + 1] = {0: [], 1: ["X"], 2: [t[k], "X"]}[op]
        t = "".join(t)
        if len(t) > EDITS:
            assert any((len(s), i, x) in probes(t) for i, x in segments(s)), (s, t)


def test_forms():
    assert {number_core(x) for x in ("MIM/26-27/340", "mim_26-27_340", "Inv# MIM/26-27/00340", "MIM/26-27/340 (copy)", "TI/MIM/26-27/340", "MIM/Z6-27/340")} == {"MIM2627340"}
    assert tax_core("57yurly55o1p1z3")[:11] == tax_core("57 YURLY 5501P1Z3")[:11] and number_core(None) == "" and tax_core("x") == ""
    assert distance("abcd", "abdc") == 1


def rec(**x):
    return {"number": "INV183", "serial": "183", "tax": tax_core("57YURLY5501P1Z3"), "total": "578900", "day": "2026-06-17", "buyer": "Shujunepus Pharma Distributors", "vendor": "Tehuvudik Steel"} | x


def test_verdicts():
    assert same_invoice(rec(), rec(tax=""))
    assert same_invoice(rec(), rec(total=""))
    assert same_invoice(rec(), rec(number="", serial=""))
    assert not same_invoice(rec(), rec(number="INV184", serial="184", day="2026-07-17", buyer="Kolm Traders"))
    assert not same_invoice(rec(), rec(day="2026-01-02", total="99", buyer="Kolm Traders"))
    assert not same_invoice(rec(), rec(tax=tax_core("41ANGXQ4341T1Z1")))


def test_probe_looks_only_back(spark):
    rows = [("a", 1, True, *rec().values()), ("b", 2, True, *rec().values()), ("c", 2, False, *rec(number="INV188", serial="188").values()), ("d", 3, False, "", "", "", "", "", "", "")]
    df = spark.createDataFrame(rows, "job_id string, batch_no int, accepted boolean, number string, serial string, tax string, total string, day string, buyer string, vendor string")
    held, jobs = entries(df)
    name = {r.entry: r.job_id for r in jobs.collect()}
    got = {(name[r.entry_a], name[r.entry_b]) for r in probe(held, build_segments(held)).collect()}
    assert got == {("a", "b"), ("a", "c")}
    assert probe(held.limit(0), build_segments(held.limit(0))).count() == 0
