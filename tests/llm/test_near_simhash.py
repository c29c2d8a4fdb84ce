"""The near stage's SimHash step: pairs within two bits, and no link that the sets don't bear out."""

from strata.llm import near


def test_fingerprints_within_two_bits_meet(spark):
    groups = spark.createDataFrame([(10, 5), (11, 5), (12, 5), (20, 5 - (1 << 63)), (30, 5 ^ 0b11000), (40, 5 ^ 0b111 << 20), (50, -1)], "fp long, sim long")
    got = {(r.a, r.b) for r in near.simhash_pairs(groups).collect()}
    assert {(11, 10), (12, 10), (20, 10), (30, 10)} <= got
    assert not any(x in p for p in got for x in (40, 50))


def test_simhash_links_are_verified(spark, monkeypatch):
    asked, pairs = [], near.simhash_pairs
    monkeypatch.setattr(near, "simhash_pairs", lambda g: asked.append(1) or g.select("fp").alias("x").crossJoin(g.select("fp").alias("y")).toDF("a", "b").where("a > b").unionByName(pairs(g)))
    text = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "quite another text of seven words"), (4, "x y")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near.near_components(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert asked
