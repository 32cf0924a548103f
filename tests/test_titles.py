import pytest
from pyspark.sql import functions as F

from loomspark.functions import names, titles

PLACES = [("1st Ann - Storm - E", 1, "title-single"), ("3-4th Bo - X - E", 3, "title-range"), ("4/3 Bo - X - E", 3, "title-range"), ("Top 8 Cy - X - E", 8, "title-single"), ("5th/19 Di - X", 5, "title-range"), ("Xth/31 Di - X", 31, "title-single"), ("Ed - X - E", None, "none"), ("x Ed - X", None, "none"), ("1234 Ed - X", None, "none"), (None, None, "none")]


def test_placement_from_title(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in PLACES], "t string").select(titles.placement_from_title(F.col("t")).alias("p")).select("p.*")
    assert [(r.placement, r.rule) for r in df.collect()] == [(p, r) for _, p, r in PLACES]


def test_tier_width(spark):
    cases = [("Top 8 A - B", None), ("5-8th A - B", 4), ("3rd A - B", 1), ("A - B", None), ("x/31 A - B", None)]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string").select(titles.tier_width(F.col("t")).alias("w"))
    assert [r.w for r in df.collect()] == [w for _, w in cases]


def test_cut_placements_nest(spark):
    rows = [(f"a{i}", "Top 4 A - B", "E", 2) for i in range(4)] + [(f"b{i}", "Top 8 A - B", "E", None) for i in range(4)] + [("c", "9th C - D", "E", 9)]
    df = spark.createDataFrame(rows, "deckId string, name string, event string, placement long").withColumn("placementImputed", F.lit(None).cast("string"))
    got = {r.deckId: r.placement for r in titles.cut_placements(df).collect()}
    assert got["a0"] == 1 and got["b3"] == 5 and got["c"] == 9


def test_name_from_title(spark):
    cases = [("1st Ann B - Storm - E1", "Storm", "E1", "Ann B"), ("2nd Ann B Storm E1", "Storm", "E1", "Ann B"), ("3rd  - Bo – X", "X", "E", "Bo"), ("4th 7pts deck - X", "X", "E", None), (None, "X", "E", None), ("5th ", "X", "E", None)]
    df = spark.createDataFrame(cases, "t string, d string, e string, want string").select("want", titles.name_from_title(F.col("t"), F.col("d"), F.col("e")).alias("got"))
    for r in df.collect():
        assert (r.got or None) == r.want


@pytest.mark.parametrize(("a", "b", "want"), [("Ann Bell", "ann bell", "exact"), ("Ann Bell", "Annie Bell", "nickname"), ("Ann Bell", "Anm Bell", "typo"), ("Jhon Bell", "John Bell", "typo"), ("Ann", "Ann Bell", "first-name"), ("AnnB", "Anna B", "handle"), ("Ann Bell", "Ann Cole", None), ("Ann", "Bo", None)])
def test_relation(a, b, want):
    assert names.relation(a, b) == want == names.relation(b, a)


def test_edits_and_display():
    assert names.edits("abcd", "acbd") == 1 and names.edits("", "ab") == 2 and names.edits("abc", "abc") == 0
    assert names.display_name(["Ann B", "Anne B", "Ann B", None], "x")[0] == "Ann B"
    assert names.display_name([None], "x") == ("x", {})


def test_careers_follow_lists():
    a, b = frozenset("abc"), frozenset("xyz")
    got = names.thread_careers([("d1", "E1", 1, a), ("d2", "E1", 1, b), ("d3", "E2", 2, b), ("d4", "E2", 2, a)])
    assert got["d1"] == got["d4"] == 0 and got["d2"] == got["d3"] == 1
