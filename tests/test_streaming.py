from loomspark.sources import artifact
from loomspark.streaming.follow import follow
from tests.snapshots import card, deck, write


def test_a_new_snapshot_rebuilds_once(spark, tmp_path):
    root, out = tmp_path / "snaps", str(tmp_path / "graph")
    write(root, "20240101T000000Z", [deck("d1")], [card("a")], {"d1": {"m": [0], "s": []}})

    def run():
        follow(spark, str(root), str(tmp_path / "none.toml"), out, str(tmp_path / "checkpoint")).awaitTermination(240)

    run()
    assert artifact.read_graph(spark, out).deck.count() == 1
    write(root, "20240201T000000Z", [deck("d2", "p2", "2nd Bo C - S - E1")], [card("a")], {})
    run()
    assert {r.deckId for r in artifact.read_graph(spark, out).deck.collect()} == {"d1", "d2"}
