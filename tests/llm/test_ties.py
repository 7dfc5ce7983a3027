from ledgerloom.llm.names import _linkage_rounds, average_linkage


def test_ties_are_the_same_in_rounds(spark):
    """Links that are all 1.0: a path, and a ring with a chord."""
    ids = "abcdefg"
    path = [(x, y, 1.0) for x, y in zip(ids, ids[1:])]
    ring = [(x.upper(), y.upper(), 1.0) for x, y in zip(ids, ids[1:])] + [("A", "G", 1.0), ("B", "E", 1.0)]
    for links in (path, ring):
        far = {r.id: r.cluster for r in _linkage_rounds(spark.createDataFrame(links, "a string, b string, sim double"), 0.2).collect()}
        assert far == average_linkage(links, 0.2)


def test_estimates_stay_bounded_over_rounds_of_joins(spark):
    """A clique of equal links merges one pair a round; every round's joins multiply the estimated sizes."""
    from ledgerloom.session import cut

    df = spark.range(3).selectExpr("cast(id as string) id")
    for _ in range(9):
        df = cut(df.join(df.selectExpr("id", "id as other"), "id").select("id"))
    assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 64 and df.count() == 3
