import random

from ledgerloom.llm.names import name_pairs
from ledgerloom.llm.text import edit_keys, near


def test_near_strings_share_a_key():
    rnd = random.Random(6)
    seen = 0
    for _ in range(4000):
        s = "".join(rnd.choice("abcdo0rnmwe") for _ in range(rnd.choice((4, 6, 7, 8, 9, 12, 39, 40, 41, 42, 43, 60))))
        t = list(s)
        for _ in range(rnd.randrange(1, 3)):
            k, op = rnd.randrange(len(t)), rnd.randrange(4)
            if op == 3:
                t[k : k + 2] = t[k : k + 2][::-1]
            else:
                t[k : k + 1] = {0: [], 1: ["x"], 2: [t[k], "x"]}[op]
        t = "".join(t)
        for two_from in (7, 8):
            if min(len(s), len(t)) >= 4 and near(s, t, 1 if min(len(s), len(t)) < two_from else 2):
                seen += 1
                assert edit_keys(s, two_from) & edit_keys(t, two_from), (s, t)
    assert seen > 3000


def test_slips_below_the_cosine_in_a_large_table(spark):
    """The first pair has no gram in common, the second one of eleven, so both cosines are below the cut."""
    rnd = random.Random(7)
    many = ["".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(4)).title() + " Ceramics" for _ in range(400)]
    names = ["Khbougorul Steel", "Khobugoul Steel", "Vachbez Timber", "Vahcbez Timber", *many]
    got = {(r.name_a, r.name_b) for r in name_pairs(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert {("Khbougorul Steel", "Khobugoul Steel"), ("Vachbez Timber", "Vahcbez Timber")} <= got
