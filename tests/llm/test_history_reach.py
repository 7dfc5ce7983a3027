import random

from ledgerloom.llm.history import _keys, append_batch, batch_pairs, find_repeats, same_invoice, serial_of, tax_core

COLUMNS = "job_id string, batch_no int, accepted boolean, number string, serial string, tax string, total string, day string, buyer string, vendor string"


def rec(**x):
    return {"number": "INV183", "serial": "183", "tax": tax_core("57YURLY5501P1Z3"), "total": "578900", "day": "2026-06-17", "buyer": "Shujunepus Pharma Distributors", "vendor": "Tehuvudik Steel"} | x


def test_every_accepted_pair_is_reached(spark, tmp_path):
    """Probe and verify together, one pair for each clause of ``same_invoice``."""
    kolm, near = "Kolm Traders", "Shujunepus Pharma Distrs"
    blank = {"number": "", "serial": ""}
    first = rec(number="MIM2627340", serial="340")
    cases = [
        (first, first | {"buyer": kolm}),
        (first, first | {"total": "579000", "day": "2026-01-01"}),
        (first | {"total": "99999950"}, first | {"total": "100000049", "day": "2026-01-01"}),
        (first | {"total": "123456789"}, first | {"total": "213465798", "day": ""}),
        (first, first | {"total": "", "day": "2026-06-18", "buyer": ""}),
        (first | {"tax": ""}, first | {"total": "", "day": "", "buyer": near}),
        (first | {"day": ""}, first | {"total": "", "tax": tax_core("75YRULY5501P1Z3")}),
        (first, first | {"total": "", "day": "2026-01-01"}),
        (first, first | {"total": "1", "tax": tax_core("57YURLY5501P1Q8")}),
        (first, first | {"number": "MMI2672340"}),
        (first | {"number": "7", "serial": "7"}, first | {"number": "17", "serial": "17"}),
        (first, first | {"number": "MIM340", "day": "", "buyer": near}),
        (first, first | {"number": "MI2627340", "total": "578901"}),
        (first, first | {"number": "MIM340", "total": "579900"}),
        (first, first | {"number": "MIM340", "total": ""}),
        (first | {"tax": ""}, first | blank),
        (first, first | blank | {"tax": ""}),
        (first, first | blank | {"buyer": ""}),
        (first, first | blank | {"day": "", "tax": tax_core("75YRULY5501P1Z3")}),
        (first, first | blank | {"total": "587900"}),
        (first | blank, first | {"total": "578990", "day": "2026-06-16"}),
    ]
    assert [i for i, (a, b) in enumerate(cases) if not same_invoice(a, b)] == []
    order = list(rec())
    rows = [(f"{i}{x}", k, True, *(r[c] for c in order)) for i, p in enumerate(cases) for k, (x, r) in enumerate(zip("ab", p))]
    df = spark.createDataFrame(rows, COLUMNS)
    got = {(r.job_id_a, r.job_id_b) for r in batch_pairs(df, str(tmp_path)).collect()}
    held, asked = [r for r in rows if r[1] == 0], [r for r in rows if r[1] == 1]
    want = {(a[0], b[0]) for a in held for b in asked if same_invoice(dict(zip(order, a[3:])), dict(zip(order, b[3:])))}
    assert got == want and all((f"{i}a", f"{i}b") in got for i in range(len(cases)))


def test_keys_meet_whatever_is_accepted():
    rnd = random.Random(4)

    def damaged(s):
        if rnd.random() < 0.25:
            return ""
        t = list(s)
        for _ in range(rnd.choice((0, 0, 1, 1, 2))):
            k, op = rnd.randrange(max(1, len(t))), rnd.randrange(4)
            if op == 3:
                t[k : k + 2] = t[k : k + 2][::-1]
            else:
                t[k : k + 1] = {0: [], 1: [rnd.choice("0123")], 2: [*t[k : k + 1], rnd.choice("0123")]}[op]
        return "".join(t)

    seen = 0
    for _ in range(6000):
        x = rec(number=rnd.choice(("MIM2627340", "17", "INV0A12")), total=rnd.choice(("578900", "1000049", "50")))
        y = x | {"number": damaged(x["number"]), "day": rnd.choice(("2026-06-17", "2026-06-18", "2026-06-30", "")), "tax": tax_core(damaged("57YURLY5501P1Z3")), "total": damaged(x["total"])}
        y = y | {"total": str(int(y["total"])) if y["total"] else "", "serial": serial_of(y["number"]), "buyer": rnd.choice((x["buyer"], "", "Shujunepus Pharma Distrs"))}
        x = x | {"serial": serial_of(x["number"]), **({k: "" for k in ("day", "tax", "total") if rnd.random() < 0.15})}
        for a, b in ((x, y), (y, x)):
            if same_invoice(a, b):
                seen += 1
                f = ("number", "serial", "tax", "total", "day")
                assert _keys(*(a[k] for k in f), True) & _keys(*(b[k] for k in f), False), (a, b)
    assert seen > 1000


def test_batches_appended_one_by_one_give_what_all_at_once_gives(spark, tmp_path):
    first = rec(number="MIM2627340", serial="340")
    rows = [(f"{b}{i}", b, i != 2, *r.values()) for b in (1, 2, 3) for i, r in enumerate((first, first, first, first | {"total": "578901"}, rec(number=f"X{b}99", serial=f"{b}99", total=f"{b}77001")))]
    df = spark.createDataFrame(rows, COLUMNS)
    whole = {tuple(r) for r in batch_pairs(df, str(tmp_path / "whole")).collect()}
    path, got = str(tmp_path / "steps"), set()
    append_batch(df.where("batch_no = 1"), path)
    for b in (2, 3):
        batch = df.where(f"batch_no = {b}")
        got |= {tuple(r) for r in find_repeats(batch, path).collect()}  # reads the index, no older batch
        append_batch(batch, path)
        append_batch(batch, path)  # a job that is run again changes nothing
    assert got == whole and ("10", "21") in got and ("12", "21") not in got and ("10", "22") in got
    assert not any(a[0] == b[0] for a, b in got)
    assert batch_pairs(df.limit(0), str(tmp_path / "none")).count() == 0


def test_many_copies_are_one_entry(spark, tmp_path):
    rows = [(f"{b}-{i}", b, True, *rec().values()) for b in (1, 2) for i in range(200)]
    df = spark.createDataFrame(rows, COLUMNS)
    append_batch(df, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/records").count() == 2
    assert find_repeats(df, str(tmp_path)).count() == 200 * 200


def test_short_numbers_of_a_day_are_no_candidates():
    """Numbers such as INV17 recur at every vendor: near numbers of one day with different totals share no key."""
    f = ("number", "serial", "tax", "total", "day")
    a, b = rec(number="INV17", serial="17"), rec(number="INV18", serial="18", total="99123", tax=tax_core("41ANGXQ4341T1Z1"))
    assert not same_invoice(a, b)
    assert not _keys(*(a[k] for k in f), True) & _keys(*(b[k] for k in f), False)
    assert _keys(*(a[k] for k in f), True) & _keys(*((b | {"number": "INV17"})[k] for k in f), False)
