"""Queries on the star-schema binding against DuckDB running their SQL."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from loomspark.operators import gems, series
from loomspark.plans import golden, registry
from loomspark.plans.graph import NotEnoughHistory
from loomspark.sources import artifact, tpch

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()
NAMES = ["meta_share", "card_adoption_board", "cut_only_events", "tail_bounds", "pilot_performance", "head_to_head", "landscape", "archetype_timeline_pair", "leaderboard_scores", "card_usage", "cooccur_pair", "pilot_affinity", "deck_points", "gem_candidates", "gate_flags", "norm_mint", "graph_counts", "projection_lists", "projection_flags", "hidden_gems", "gem_screened", "gem_picture_edges", "card_usage_nodes", "cooccur_pair_nodes", "cooccur_apart_nodes", "affinity_lone_nodes"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    plain = lambda v: None if pd.isna(v) else (str(v) if isinstance(v, (bool, str)) or not hasattr(v, "__float__") else f"{float(v):.6f}")
    return sorted((tuple(plain(v) for v in r) for r in df.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and len(got) > 0


def test_thin_evidence_is_refused(spark):
    g = tpch.graph(spark, "/root/testdata/sf0.001")
    with pytest.raises(NotEnoughHistory) as e:
        series.pilot_performance(g, -1)
    assert e.value.found == 0
    with pytest.raises(ValueError):
        series.head_to_head(g, 1, 1)


def test_gem_tails():
    assert gems.tails(((10, 2, 3),))[0] == pytest.approx(1) and gems.tails(((10, 2, 3),))[2] == pytest.approx(8 / 120)
    two = gems.tails(((4, 1, 1), (6, 3, 1)))
    assert two[2] == pytest.approx(0.125) and two[1] == pytest.approx(1 - 0.75 * 0.5)
    assert gems.deflated(0.01, 6, 6) == 0.01 and gems.deflated(0.01, 6, 3) > 0.01


def test_expected_by_luck_takes_the_bar_of_the_drawn_list(spark, monkeypatch):
    g = tpch.graph(spark, SF)
    monkeypatch.setattr(gems.c, "MAX_GEM_LUCK", 0.5)
    rows = gems.screened(g).toPandas()
    monkeypatch.setattr(gems.c, "MAX_GEM_NODES", 40)
    drawn = gems.hidden_gems(g).toPandas()
    assert 0 < len(drawn) < (rows.luck <= 0.5).sum()
    bar = rows.merge(drawn[["tag", "canon"]]).luck.max()
    assert gems.expected_by_luck(g).first().expected == pytest.approx(gems.screened(g, bar).toPandas().clears.sum())
    assert bar < 0.5 and gems.expected_by_luck(g).first().expected < rows.clears.sum()


def test_golden_compare():
    a = {"x": [{"k": 1, "v": 0.5}, {"k": 2, "v": 1.0}]}
    assert golden.compare(a, {"x": [{"k": 2, "v": 1.0}, {"k": 1, "v": 0.5 + 1e-12}]}) == {}
    assert golden.compare(a, {"x": [{"k": 1, "v": 0.6}, {"k": 2, "v": 1.0}]})["x"]
    assert golden.compare(a, {"x": a["x"][::-1]}, frozenset({"x"}))["x"] and golden.compare(a, {})["x"] == ["only before"]


def test_artifact_is_promoted_whole(spark, tmp_path):
    g = tpch.graph(spark, "/root/testdata/sf0.001")
    out = str(tmp_path / "graph")
    for _ in range(2):
        artifact.write_graph(g, out, {"report": {"n": 1}})
    assert artifact.read_graph(spark, out).counts() == g.counts()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["graph", "graph.backup"]


def test_everything_else_works_without_the_llm_parts():
    code = "import sys; sys.modules['loomspark.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert 'meta_share' in e.queries() and not any(k.startswith('op') for k in e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, env=os.environ | {"PYTHONPATH": str(root)})
