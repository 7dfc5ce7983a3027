import random

from ledgerloom.operators import retrieval
from ledgerloom.operators.retrieval import inverted_candidates


def test_candidates_in_blocks_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "RIGHT_IDS", 16, raising=False)
    rnd = random.Random(3)
    sets = {f"f{i}": {f"a{rnd.randrange(12)}" for _ in range(rnd.randrange(1, 9))} | ({f"rare{i // 3}"} if i % 3 else set()) for i in range(90)}
    sets["none shared"] = {"alone"}
    rows = spark.createDataFrame([(i, a) for i, s in sets.items() for a in s], "id string, anchor string")
    got = inverted_candidates(rows, rows, 5)
    # No table of pairs: what is moved is the ids with their anchors.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    want = set()
    for i, s in sets.items():
        hits = sorted((-len(s & t), j) for j, t in sets.items() if i != j and s & t)
        want |= {(i, j, -n) for n, j in hits[:5]}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    other = rows.where("id < 'f4'")
    assert {r.other for r in inverted_candidates(rows, other, 3).collect()} <= {i for i in sets if i < "f4"}
    assert inverted_candidates(rows.limit(0), rows, 3).count() == 0 and inverted_candidates(rows, rows.limit(0), 3).count() == 0
