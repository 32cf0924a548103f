import pytest

from loomspark.plans import specs
from loomspark.sources import tpch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def g(spark):
    return tpch.graph(spark, SF)


@pytest.mark.parametrize("spec", [specs.PilotNeighbourhood(1), specs.PilotNeighbourhood(1, 2), specs.CardUsage(1), specs.CardUsage(1, "Main"), specs.CardCooccurrence(1), specs.CardCooccurrence(1, 2, drop_lands=True), specs.HiddenGems(), specs.PilotAffinity(1)])
def test_every_query_dispatches(g, spec):
    assert all(df.columns for df in specs.run_query(g, spec).values())


def test_series_dispatch(g):
    assert specs.run_series(g, specs.MetaShare()).columns == ["tag", "archetype", "year", "n", "share", "year_total"]
    assert "share" in specs.run_series(g, specs.CardAdoption(1)).columns
    with pytest.raises(TypeError):
        specs.run_series(g, specs.HiddenGems())
    with pytest.raises(TypeError):
        specs.run_query(g, specs.MetaShare())


def test_unknown_card_and_board(g):
    assert specs.run_query(g, specs.CardCooccurrence(-1))["nodes"].count() == 0
    rows = specs.run_series(g, specs.CardAdoption(-1)).collect()
    assert rows and all(r["count"] == 0 and r["share"] == 0 for r in rows)
