from ledgerloom.llm.addresses import address_pairs, parse_address


def test_pairs(spark):
    a = "Shop No. 7, 2nd Floor, Givusajem Marg, Near Gol Water Tank, Medhor Nagar, Murdhesar, Bhavsagar - 620059"
    same = [a, "SHOP#7 - GIVUSAJEM MRG - MEDHOR NGR", "Medhor Nagar; Givussajem Marg; Sh. No.7; Murdhesar; 620 059"]
    other = ["Shop No. 7A, Givusajem Marg, Medhor Nagar", "Shop No. 7, Givusajem Marg, Tachel Estate, Povowadi, Thirunadu - 685049", "Shop No. 8, Givusajem Marg, Medhor Nagar", "nowhere", "", None, "x" * 20_000]
    df = spark.createDataFrame([(x, "e") for x in same * 2 + other], "address string, location string")
    got = {(r.address_a, r.address_b) for r in address_pairs(df).collect()}
    s = sorted(same)
    assert got == {(s[0], s[1]), (s[0], s[2]), (s[1], s[2])}
    assert address_pairs(df.limit(0)).count() == 0


def test_parse():
    assert parse_address("U-171B, Vuthubhotas St., Chuchar Estate")[:4] == ("171b", "vuthubhotas", "street", "chuchar")


def test_streets_without_a_known_kind(spark):
    rows = ["12 Broadway, Springfield 560001", "12, Broadwya, Springfield - 560001", "5 Rue de Rivoli, Paris", "5, Rue de Rivolli, Paris", "12/4 MG Road, Pune 411001", "12/4, M.G. Rd., Pune - 411001", "12/5 MG Road, Pune 411001"]
    got = {(r.address_a, r.address_b) for r in address_pairs(spark.createDataFrame([(a,) for a in rows], "address string")).collect()}
    assert got == {tuple(sorted(rows[i : i + 2])) for i in (0, 2, 4)}
