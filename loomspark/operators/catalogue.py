"""Catalogues, coverage and deck points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.constants import MIN_GEM_SLICE
from loomspark.plans.graph import Graph


def pilot_catalogue(g: Graph) -> DataFrame:
    return g.pilot.select("pilot", "displayName").orderBy("displayName", "pilot")


def card_catalogue(g: Graph) -> DataFrame:
    return g.card.select("canon", "name").orderBy("name", "canon")


def gem_archetypes(g: Graph) -> DataFrame:
    counts = g.ranked.join(g.primary, "deckId").groupBy("tag").agg(F.countDistinct("deckId").alias("decks"))
    return counts.where(F.col("decks") >= MIN_GEM_SLICE).join(g.archetype, "tag").select("tag", "name")


def coverage(g: Graph) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = one(g.event, "events").crossJoin(one(g.pilot, "pilots")).crossJoin(one(g.deck, "decks")).crossJoin(one(g.card, "cards"))
    return out.crossJoin(g.in_year.agg(F.min("year").alias("first_year"), F.max("year").alias("last_year")))


def deck_points(g: Graph) -> DataFrame:
    """Points of each deck's distinct cards, and the dearest companion on its side board on top."""
    points = g.card.select("canon", "points", "pointsCompanion")
    own = g.contains.select("deckId", "canon").distinct().join(points, "canon").groupBy("deckId").agg(F.sum("points").alias("points"))
    side = g.contains.where(F.col("board") == "Side").join(points.where("pointsCompanion > 0"), "canon").groupBy("deckId").agg(F.max(F.col("pointsCompanion") - F.col("points")).alias("extra"))
    rows = g.deck.select("deckId").join(own, "deckId", "left").join(side, "deckId", "left")
    return rows.select("deckId", (F.coalesce("points", F.lit(0)) + F.coalesce("extra", F.lit(0))).alias("points"))


def naive_points(g: Graph) -> DataFrame:
    """Points summed over every membership, both boards: the baseline that grading compares with."""
    return g.contains.join(g.card.select("canon", "points"), "canon").groupBy("deckId").agg(F.sum("points").alias("points"))


def points_agreement(derived: DataFrame, source: DataFrame) -> DataFrame:
    """One row: decks with a source total, how many agree, and the share."""
    both = derived.join(source.withColumnRenamed("points", "source_points"), "deckId").where("source_points is not null")
    rows = both.agg(F.count("*").alias("graded"), F.count_if(F.col("points") == F.col("source_points")).alias("agree"))
    return rows.withColumn("share", F.when(F.col("graded") > 0, F.col("agree") / F.col("graded")))
