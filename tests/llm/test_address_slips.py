from ledgerloom.llm.addresses import address_pairs


def test_streets_without_a_common_gram(spark):
    """One street with two slips and no gram in common, beside others of the same number and one of another."""
    a, b = "Shop No. 7, Khbougorul Marg, Medhor Nagar, Bhavsagar - 620059", "Shop No. 7, Khobugoul Marg, Medhor Nagar, Bhavsagar - 620059"
    other = ["Shop No. 8, Khobugoul Marg, Medhor Nagar, Bhavsagar - 620059", "Shop No. 7, Khobidaul Marg, Medhor Nagar, Bhavsagar - 620059"]
    got = {(r.address_a, r.address_b) for r in address_pairs(spark.createDataFrame([(x,) for x in (a, b, *other)], "address string")).collect()}
    assert got == {(a, b)}
