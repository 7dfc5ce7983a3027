from ledgerloom.llm.canonical import Matcher, canonical_rows

BANKS = [(31, "Sahyog Meridian Bank", "SAMK", None), (32, "Bank of Talgiri", "BATK", None), (33, "Talgiri Gramin Bank", "TAGK", None)]
UNITS = [(58, "PCS", None, "Pieces"), (66, "SQM", None, "Square metres"), (63, "MTR", None, "Metres"), (76, "SET", None, "Sets"), (82, "SHT", None, "Sheets")]


def test_banks():
    m = Matcher("bank_name", BANKS)
    for v, want in [("talgiri gramin bank", 33), ("Bank, Talgiri Gramin", 33), ("Talgiri Grramin Bank", 33), ("Bank of Tlgiri", 32), ("BATK", 32), ("Sahyog Meridian Bank - Shalhekot", 31), ("Saho. Meri. Bank", 31), ("cash", 0), ("Quaystone Bank of Ferrol", 0), ("x" * 3000, 0), ("--", 0)]:
        assert m.match(v) == want, v


def test_units():
    m = Matcher("unit", UNITS)
    for v, want in [("pc.", 58), ("piees", 58), ("Sqare metres", 66), ("sq. mtr", 66), ("set(s)", 76), ("se(s)", 76), ("seets", 76), ("Shets", 82), ("lot", 0), ("L.S.", 0)]:
        assert m.match(v) == want, v


def test_rows(spark):
    ref = spark.createDataFrame([("unit", *u) for u in UNITS] + [("bank_name", *b) for b in BANKS], "list_name string, ref_id int, canonical string, code string, long_name string")
    facts = spark.createDataFrame([("j", None, "BATK", 1), ("j", None, "BATK", 2), ("k", "  ", "Bank of Talgiri", 1)], "job_id string, place_of_supply string, bank_name string, ref_id int")
    lines = spark.createDataFrame([("j", 1, "pcs"), ("j", 2, "PCS"), ("j", 3, None), ("j", 4, "lot")], "job_id string, line_no int, unit string")
    got = sorted(map(tuple, canonical_rows(facts, lines, ref).collect()))
    assert got == [("j", 0, "bank_name", 32), ("j", 1, "unit", 58), ("j", 4, "unit", 0)]
    assert canonical_rows(facts.limit(0), lines.limit(0), ref).count() == 0
    assert {r.ref_id for r in canonical_rows(facts, lines, ref.limit(0)).collect()} == {0}


def test_units_beside_other_words():
    m = Matcher("unit", UNITS)
    for v, want in [("rate per metre", 63), ("100 sheets approx", 82), ("pieces or sheets", 0), ("sqare metres", 66)]:
        assert m.match(v) == want, v
