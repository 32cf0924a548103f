"""What a query of the union writes on its way."""

from loomspark.operators import ingest
from loomspark.plans import etl_queries


def test_only_the_part_asked_for_is_written(spark, monkeypatch):
    labels, keep = [], ingest.materialised
    count = lambda df, label="step": labels.append(label) or keep(df, label)
    monkeypatch.setattr(ingest, "materialised", count)
    monkeypatch.setattr(etl_queries, "materialised", count, raising=False)
    assert etl_queries.projection_union(spark, "/root/testdata/sf0.001").count() == 1500
    assert labels == ["lists", "flags", "union"]
