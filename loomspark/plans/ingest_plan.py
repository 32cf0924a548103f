"""Entry point: snapshot folders and a dictionary in, artifact out."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.titles import cleansed
from loomspark.operators import build, identity, ingest
from loomspark.plans.graph import Graph
from loomspark.session import materialised
from loomspark.sources import artifact, curation, snapshot


def build_graph(s: snapshot.Snapshot, c: curation.Curation, seen: DataFrame | None = None) -> tuple[Graph, identity.Resolution]:
    """The passes in their order: overrides, people, years, duplicates, winners, fields, norms."""
    spark = s.decks.sparkSession
    decks = cleansed(s.decks.withColumn("placementImputed", F.lit(None).cast("string"))).withColumn("normImputed", F.lit(None).cast("string"))
    if c.deck_archetypes:
        decks = build.override_archetypes(decks, spark.createDataFrame([(k, *v) for k, v in c.deck_archetypes.items()], "deckId string, newName string, engine string, label string"))
    if c.deck_events:
        decks = build.reassign_events(decks, spark.createDataFrame(list(c.deck_events.items()), "deckId string, toEvent string"))
    decks = materialised(decks, "cleansed")
    people = identity.resolve(decks, s.contains, c, seen)
    build.event_years(decks)  # before duplicates go: they must not hide a straddle
    decks = decks.join(people.dropped.select("deckId"), "deckId", "left_anti")
    build.check_sole_winner(decks)
    fields = materialised(build.event_fields(decks, people.deck_pilot), "fields")
    return build.to_graph(s, build.normalised(decks, fields), people.deck_pilot, people.pilots, fields), people


def run(spark: SparkSession, root: str, dictionary: str, out: str) -> Graph:
    """Validate all, gate, build, promote; nothing is written if anything is refused."""
    paths = snapshot.snapshot_dirs(root)
    held = [snapshot.load_checked(spark, p) for p in paths]
    if not held:
        raise snapshot.SchemaError(f"{root} holds no snapshot")
    whole, flags = ingest.gated_union(held)
    seen = reduce(DataFrame.unionByName, [x.decks.select(F.lit(Path(p).name).alias("stamp"), "deckId") for p, x in zip(paths, held, strict=True)])
    g, people = build_graph(whole, curation.load_curation(dictionary), seen)
    reports = {"ingest": [r.asDict() for r in flags.collect()], "reconciliation": {"joined": [r.asDict() for r in people.joined.collect()], "candidates": [r.asDict() for r in people.candidates.collect()], "fired": [r.asDict() for r in people.fired.collect()]}}
    artifact.write_graph(g, out, reports)
    return artifact.read_graph(spark, out)
