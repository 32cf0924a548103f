import pytest
from pyspark.sql import functions as F

from loomspark.functions.titles import cleansed
from loomspark.operators import build, identity, ingest
from loomspark.plans import ingest_plan
from loomspark.plans.specs import MetaShare, run_query, run_series
from loomspark.sources import brief, curation, snapshot
from tests.snapshots import card, deck, write

CARDS = [card("a"), card("b", "Lands"), card("c", points=2, companion=3)]


@pytest.fixture
def three(spark, tmp_path):
    """A deck that changes, one that goes, one that goes and comes back changed."""
    one = [deck("d1"), deck("d2", "p2", "2nd Bo C - Storm - E1"), deck("d3", "p3", "3rd Cy D - Storm - E1")]
    lists = {"d1": {"m": [0, 1], "s": [2]}, "d2": {"m": [0], "s": []}, "d3": {"m": [1], "s": [1]}}
    write(tmp_path, "20240101T000000Z", one, CARDS, lists)
    write(tmp_path, "20240201T000000Z", [deck("d1"), deck("d4", "p4", "4th Di E - Storm - E2", "E2")], CARDS, {"d1": {"m": [0, 2], "s": [2]}, "d4": {"m": [0], "s": []}})
    write(tmp_path, "20240301T000000Z", [deck("d1"), deck("d3", "p9", "3rd Cy D - Storm - E1")], CARDS[::-1], {"d1": {"m": [2, 0], "s": [0]}, "d3": {"m": [1], "s": [1]}})
    return str(tmp_path)


def test_positions_resolve_inside_their_file(spark, three):
    last = snapshot.load_checked(spark, snapshot.snapshot_dirs(three)[2])
    assert {r.canon for r in last.contains.where("deckId = 'd1' and board = 'Main'").collect()} == {"a", "c"}


def test_gate_and_union(spark, three):
    held = [snapshot.load_checked(spark, p) for p in snapshot.snapshot_dirs(three)]
    whole, flags = ingest.gated_union(held)
    assert {(r.kind, r.entity, r.id) for r in flags.collect()} == {("changed", "deck", "d1"), ("dropped", "deck", "d2"), ("dropped", "deck", "d3"), ("changed", "deck", "d3"), ("dropped", "deck", "d4")}
    rows = whole.decks.orderBy("deck_ord").collect()
    assert [r.deckId for r in rows] == ["d1", "d2", "d3", "d4"] and rows[2].pilot == "p3"
    assert {r.canon for r in whole.contains.where("deckId = 'd1' and board = 'Main'").collect()} == {"a", "b"}


def test_an_emptied_list_stays_empty(spark, tmp_path):
    """The newest record of a deck may have no cards; a pinned deck keeps its first list."""
    for k, lists in enumerate([{"d1": {"m": [0], "s": []}, "d2": {"m": [], "s": []}}, {"d1": {"m": [], "s": []}, "d2": {"m": [1], "s": []}}]):
        write(tmp_path, f"2024010{k + 1}T000000Z", [deck("d1"), deck("d2", "p2")], CARDS, lists)
    held = [snapshot.load_checked(spark, p) for p in snapshot.snapshot_dirs(str(tmp_path))]
    assert [(r.deckId, r.canon) for r in ingest.union_snapshots(held).contains.collect()] == [("d2", "b")]
    whole, flags = ingest.gated_union(held)
    assert {r.id for r in flags.collect()} == {"d1", "d2"} and [(r.deckId, r.canon) for r in whole.contains.collect()] == [("d1", "a")]


def test_bad_snapshots_are_refused(spark, tmp_path):
    bad = write(tmp_path / "x", "20240101T000000Z", [deck("d1")], CARDS, {"d1": {"m": [7], "s": []}})
    with pytest.raises(snapshot.SchemaError):
        snapshot.load_checked(spark, bad)
    no_points = [{k: v for k, v in card("a").items() if k != "pointsCompanion"}]
    bad = write(tmp_path / "y", "20240101T000000Z", [deck("d1")], no_points, {})
    with pytest.raises(snapshot.SchemaError):
        snapshot.load_checked(spark, bad)
    with pytest.raises(snapshot.SchemaError):
        snapshot.load_checked(spark, str(tmp_path))


def test_corrected_field(spark):
    cases = [("Teams", 10, 40, 50, 10, None), ("Tournament", None, 5, 3, 24, "C"), ("Tournament", 30, 31, 3, 31, "A"), ("Tournament", 30, 3, 40, 40, "A"), ("Tournament", 8, 5, 8, 24, "B"), ("Tournament", 9, 5, 8, 9, None)]
    df = spark.createDataFrame(cases, "k string, s long, p long, d long, want long, rule string")
    for r in df.select("want", "rule", build.corrected_field(F.col("k"), F.col("s"), F.col("p"), F.col("d")).alias("f")).collect():
        assert (r.f.fieldSize, r.f.fieldImputed) == (r.want, r.rule)


def test_whole_ingest(spark, three, tmp_path):
    g = ingest_plan.run(spark, three, str(tmp_path / "none.toml"), str(tmp_path / "out" / "graph"))
    assert g.counts()["deck"] == 4 and g.pilot.count() == 4
    assert len(g.counts()) == 18 and g.counts()["colour"] == 5 and g.counts()["macro"] == 1 and g.counts()["card_type"] == 2
    assert {(r.deckId, r.colour) for r in g.deck_colour.collect()} == {(f"d{k}", x) for k in range(1, 5) for x in "UB"}
    assert {(r.canon, r.colour) for r in g.card_colour.collect()} == {(x, "U") for x in "abc"} and g.has_type.count() == 3
    assert {r.tag for r in run_series(g, MetaShare()).collect()} == {"storm"}
    norms = {r.deckId: (r.norm, r.normImputed) for r in g.deck.collect()}
    assert norms["d1"] == (0.0, "minted") and norms["d2"][0] == pytest.approx(1 / 31)
    with pytest.raises(TypeError):
        run_query(g, "nothing")


def test_guards(spark, tmp_path):
    decks = [deck("d1"), deck("d2", "p2", "1st Bo C - Storm - E1"), deck("d3", "p3", "2nd Cy - X - E3", "E3"), deck("d4", "p4", "3rd Di - X - E3", "E3", "2025-01-01T00:00:00+00:00")]
    s = snapshot.load_checked(spark, write(tmp_path, "20240101T000000Z", decks, CARDS, {}))
    rows = cleansed(s.decks.withColumn("placementImputed", F.lit(None).cast("string")))
    with pytest.raises(build.TwoWinners):
        build.check_sole_winner(rows)
    with pytest.raises(build.YearStraddle):
        build.event_years(rows)


def test_identity(spark, tmp_path):
    decks = [
        deck("d1", "p1", "1st Ann Bell - Storm - E1"), deck("d2", "p1", "2nd Ann Bell - Storm - E2", "E2"), deck("d3", None, "3rd Ann Bell - Storm - E3", "E3"), deck("d4", "p2", "4th Annie Bell - Storm - E4", "E4"),
        deck("d5", "p5", "5th Bo Cole - Storm - E1"), deck("d6", "p5", "6th Bo Cole - Storm - E1"), deck("d7", "p5", "7th Bo Cole - Storm - E1"), deck("d8", "n/a", "8th ", "E5"),
    ]
    lists = {"d5": {"m": [0], "s": []}, "d6": {"m": [1], "s": []}, "d7": {"m": [0], "s": []}}
    s = snapshot.load_checked(spark, write(tmp_path, "20240101T000000Z", decks, CARDS, lists))
    r = identity.resolve(s.decks, s.contains)
    who = {x.deckId: x.pilot for x in r.deck_pilot.collect()}
    assert who["d1"] == who["d2"] == who["d3"] == "p1" and who["d4"] == "p2"
    assert {who["d5"], who["d6"]} == {"p5", "p5#2"} and "d7" not in who
    assert [(x.deckId, x.kept) for x in r.dropped.collect()] == [("d7", "d5")]
    assert [(x.a, x.b, x.relation, x.state) for x in r.candidates.collect()] == [("p1", "p2", "nickname", "candidate")]
    assert r.names.count() == 0 and "nickname: `p1` and `p2`" in brief.brief(r)
    merged = identity.resolve(s.decks, s.contains, curation.parse({"merge": [{"ids": ["p1", "p2"], "canonical": "p2"}]}))
    assert {x.deckId: x.pilot for x in merged.deck_pilot.collect()}["d1"] == "p2"


def test_several_families_and_fired_holds(spark, tmp_path):
    decks = [deck("d1", "p1", "1st Ann Bell - S - E1"), deck("d2", "p1", "2nd Zed Quint - S - E2", "E2"), deck("d3", "p2", "3rd Bo Cole - S - E1")]
    s = snapshot.load_checked(spark, write(tmp_path, "20240101T000000Z", decks, CARDS, {}))
    c = curation.parse({"hold": [{"ids": ["p1", "p2"], "settles_on": "shared_event", "as_of": "20240101T000000Z"}]})
    r = identity.resolve(s.decks, s.contains, c)
    assert [(x.pid, x.kind, x.names) for x in r.names.collect()] == [("p1", "multi-name", ["Ann Bell", "Zed Quint"])]
    assert [(x.a, x.b, x.trigger) for x in r.fired.collect()] == [("p1", "p2", "shared_event")]


def test_holds_fire_on_any_evidence(spark, tmp_path):
    decks = [deck("d1", "p1", "1st Ann Bell - S - E1"), deck("d2", "p2", "3rd Bo Cole - S - E1"), deck("d3", "p3", "1st Cy Dorn - S - E2", "E2"), deck("d4", "p3", "2nd Di Eck - S - E2", "E2"), deck("d5", "p4", "1st Flo Gray - S - E3", "E3"), deck("d6", "p5", "1st Hal Ives - S - E4", "E4"), deck("d7", "p6", "1st Jo Kent - S - E5", "E5"), deck("d8", "p7", "1st Jo Kent - S - E6", "E6")]
    s = snapshot.load_checked(spark, write(tmp_path, "20240101T000000Z", decks, CARDS, {d["deckId"]: {"m": [i % 3], "s": []} for i, d in enumerate(decks)}))
    hold = lambda settles, *ids: {"ids": list(ids), "settles_on": settles, "as_of": "20240101T000000Z"}
    c = curation.parse({"hold": [hold("joined_name", "p1", "p2"), hold("new_decks", "p3"), hold("event_split", "p4"), hold("event_split", "p5"), hold("shared_event", "p6", "p7")]})
    seen = spark.createDataFrame([("20240101T000000Z", f"d{i}") for i in (1, 2, 3, 4, 6, 7, 8)], "stamp string, deckId string")
    fired = identity.resolve(s.decks, s.contains, c, seen).fired.collect()
    assert {(x.a, x.b, x.trigger) for x in fired} == {("p1", "p2", "shared_event"), ("p3", None, "event_split"), ("p4", None, "new_decks"), ("p6", "p7", "joined_name")} and len(fired) == 4


@pytest.mark.parametrize("bad", [
    {"merge": [{"ids": ["a", "b"], "canonical": "c"}]}, {"merge": [{"ids": ["a"], "canonical": "a"}]}, {"odd": []}, {"reject": [{"ids": ["a", "b"]}], "merge": [{"ids": ["a", "b"], "canonical": "a"}]},
    {"merge": [{"ids": ["a", "b"], "canonical": "a"}, {"ids": ["b", "c"], "canonical": "c"}]}, {"hold": [{"ids": ["a"], "settles_on": "x", "as_of": "2024"}]}, {"name": [{"pilot": "a", "display_name": "x"}, {"pilot": "a", "display_name": "y"}]},
])
def test_contradictions_are_refused(bad):
    with pytest.raises(curation.CurationError):
        curation.parse(bad)
