import random

from ledgerloom.llm.addresses import _alike, near_streets
from ledgerloom.llm.names import average_linkage, cluster_links


def test_streets_meet_in_slices_as_in_one(spark):
    rnd = random.Random(3)
    names = {"".join(rnd.choice(("kho", "bu", "go", "rul", "di")) for _ in range(rnd.randrange(1, 5))) for _ in range(60)}
    rows = [(number, name) for number in ("7", "7a") for name in names] + [("8", "khobugo")]
    want = {(number, a, b) for number in ("7", "7a") for a in names for b in names if a < b and _alike(a, b)}
    df = spark.createDataFrame(rows, "number string, street string")
    for per_slice in (1_000, 9):
        got = [tuple(r) for r in near_streets(df, per_slice).collect()]
        assert set(got) == want and len(got) == len(want) >= 20
    assert near_streets(df.limit(0)).count() == 0


def test_links_may_have_numbers_for_ids(spark):
    links = [(1, 2, 1.0), (2, 10, 1.0), (20, 30, 0.1)]
    got = {r.id: r.cluster for r in cluster_links(spark.createDataFrame(links, "a bigint, b bigint, sim double"), 0.2).collect()}
    assert got == average_linkage(links, 0.2)
