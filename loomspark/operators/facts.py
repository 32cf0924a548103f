"""Facts that several analyses share: coverage, dates, bounds, spread, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.constants import INTERVAL_Z, MIN_FIELD_COVERAGE, MIN_SPREAD_FINISHES
from loomspark.plans.graph import Graph


def field_slots(g: Graph) -> DataFrame:
    """One row an event: decks, ranked decks, deepest placement, distinct placements, field."""
    rows = g.played_at.join(g.deck, "deckId").groupBy("event")
    rows = rows.agg(F.count("*").alias("decks"), F.count("norm").alias("ranked"), F.max("placement").alias("deepest"), F.countDistinct("placement").alias("places"), F.min("createdAt").alias("date"))
    return rows.join(g.event, "event")


def covered(slots: DataFrame) -> Column:
    """Recorded finishes: at team events several decks share one."""
    return F.when(F.col("eventType") == "Teams", F.col("places")).otherwise(F.col("ranked"))


def cut_only_events(g: Graph) -> DataFrame:
    """Events of which under half the field has a finish. An event without any is not among them."""
    slots = field_slots(g)
    return slots.where((F.col("ranked") > 0) & (covered(slots) < MIN_FIELD_COVERAGE * F.col("fieldSize"))).select("event")


def tail_bounds(g: Graph, skip: DataFrame | None = None) -> DataFrame:
    """Best finish an unranked deck can have had: behind everyone recorded."""
    slots = field_slots(g)
    slots = slots.join(skip if skip is not None else cut_only_events(g), "event", "left_anti")
    slot = F.greatest(F.coalesce("deepest", F.lit(0)), covered(slots))
    rows = slots.where((F.col("ranked") < F.col("decks")) & (F.col("fieldSize") >= 2)).withColumn("slot", slot)
    return rows.where((F.col("slot") >= 1) & (F.col("slot") < F.col("fieldSize"))).select("event", (F.col("slot") / (F.col("fieldSize") - 1)).alias("bound"))


def event_dates(g: Graph) -> DataFrame:
    return g.played_at.join(g.deck.select("deckId", "createdAt"), "deckId").groupBy("event").agg(F.min("createdAt").alias("date"))


def pooled_sd(rows: DataFrame, key: str, value: str, least: int = 2) -> DataFrame:
    """One row ``sd``: within-group spread pooled over groups of ``least`` or more; null without freedom."""
    groups = rows.groupBy(key).agg(F.count(value).alias("n"), F.var_samp(value).alias("v")).where(F.col("n") >= max(2, least))
    total = groups.agg(F.sum(F.col("v") * (F.col("n") - 1)).alias("ss"), F.sum(F.col("n") - 1).alias("dof"))
    return total.select(F.when(F.col("dof") > 0, F.sqrt(F.col("ss") / F.col("dof"))).alias("sd"))


def within_pilot_sd(g: Graph, skip: DataFrame) -> DataFrame:
    rows = g.ranked.join(g.piloted_by, "deckId").join(g.played_at, "deckId").join(skip, "event", "left_anti")
    return pooled_sd(rows, "pilot", "norm", MIN_SPREAD_FINISHES)


def within_archetype_sd(g: Graph, year: int, skip: DataFrame) -> DataFrame:
    rows = g.ranked.join(g.primary, "deckId").join(g.deck_year.where(F.col("year") == year), "deckId").join(skip, "event", "left_anti")
    return pooled_sd(rows, "tag", "norm")


def interval(mean: Column, n: Column, sd: Column) -> tuple[Column, Column]:
    """mean -+ z sd / sqrt(n), within [0, 1]; null without a spread or an observation."""
    half = F.when(mean.isNotNull() & sd.isNotNull() & (n >= 1), F.lit(INTERVAL_Z) * sd / F.sqrt(n))
    return F.when(half.isNotNull(), F.greatest(F.lit(0.0), mean - half)), F.when(half.isNotNull(), F.least(F.lit(1.0), mean + half))


def drawn(own: Column, other: Column, bound: Column) -> Column:
    """A finish as drawn: its own, or the bound where only the other side has one."""
    return F.coalesce(own, F.when(other.isNotNull(), bound))


def beats_a_coin(led: Column, of: Column) -> Column:
    return F.abs(led - of / 2) - 0.5 > F.lit(INTERVAL_Z) * F.sqrt(of) / 2
