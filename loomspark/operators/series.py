"""Series by year, by event and by date. Every operator is lazy but for its refusal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.constants import (
    MIN_ARCHETYPE_EVENTS,
    MIN_LANDSCAPE_ARCHETYPES,
    MIN_PILOT_YEAR_EVENTS,
    MIN_QUALIFYING_YEARS,
    MIN_SHARED_EVENTS,
)
from loomspark.operators import facts
from loomspark.plans.graph import Graph, require


def year_totals(g: Graph) -> DataFrame:
    return g.deck_year.groupBy("year").agg(F.countDistinct("deckId").alias("year_total"))


def year_shape(g: Graph, year: int) -> DataFrame:
    """Decks and events of a year; zeros for a year that isn't there."""
    return g.deck_year.where(F.col("year") == year).agg(F.countDistinct("deckId").alias("decks"), F.countDistinct("event").alias("events"))


def meta_share(g: Graph) -> DataFrame:
    """Share of each archetype in each year; absent pairs are zeros, unclassified decks dilute."""
    counts = g.primary.join(g.deck_year, "deckId").groupBy("tag", "year").agg(F.countDistinct("deckId").alias("n"))
    # archetypes and years are dimensions of a few rows; the product is the output itself
    frame = g.archetype.crossJoin(year_totals(g))
    rows = frame.join(counts, ["tag", "year"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("tag", F.col("name").alias("archetype"), "year", "n", (F.col("n") / F.col("year_total")).alias("share"), "year_total")


def card_adoption(g: Graph, canon, board: str | None = None) -> DataFrame:
    """Share of each year's decks that hold a card; the board narrows the numerator only."""
    held = g.contains.where(F.col("canon") == canon)
    if board:
        held = held.where(F.col("board") == board)
    counts = held.join(g.deck_year, "deckId").groupBy("year").agg(F.countDistinct("deckId").alias("count"))
    rows = year_totals(g).join(counts, "year", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return rows.select("year", "count", (F.col("count") / F.col("year_total")).alias("share"), "year_total")


def pilot_performance(g: Graph, pilot) -> DataFrame:
    """Mean finish of a pilot for each year played; means of under two events are withheld."""
    skip = facts.cut_only_events(g)
    mine = g.piloted_by.where(F.col("pilot") == pilot).select("deckId").join(g.deck_year, "deckId")
    scored = g.ranked.join(mine, "deckId").join(skip, "event", "left_anti").groupBy("year").agg(F.avg("norm").alias("mean"), F.countDistinct("event").alias("events"))
    rows = mine.select("year").distinct().join(scored, "year", "left").withColumn("events", F.coalesce("events", F.lit(0)))
    rows = rows.withColumn("mean_norm", F.when(F.col("events") >= MIN_PILOT_YEAR_EVENTS, F.col("mean")))
    require(rows.where("mean_norm is not null"), MIN_QUALIFYING_YEARS, "qualifying years")
    rows = rows.crossJoin(F.broadcast(facts.within_pilot_sd(g, skip)))
    low, high = facts.interval(F.col("mean_norm"), F.col("events"), F.col("sd"))
    return rows.select("year", "mean_norm", "events", low.alias("mean_low"), high.alias("mean_high"))


def head_to_head(g: Graph, a, b) -> DataFrame:
    """Every event both pilots entered, brackets included; bounds stand in for missing finishes.
    Pairs of decks whose finishes are the same in every column are one row."""
    if a == b:
        raise ValueError("a pilot can't be compared with itself")

    def side(pilot, mark: str) -> DataFrame:
        rows = g.piloted_by.where(F.col("pilot") == pilot).select("deckId").join(g.played_at, "deckId").join(g.deck, "deckId")
        return rows.select("event", *[F.col(c).alias(f"{c}_{mark}") for c in ("placement", "norm", "placementImputed", "normImputed")])

    rows = side(a, "a").join(side(b, "b"), "event").distinct()
    rows = rows.join(g.event.select("event", "fieldSize", "fieldImputed"), "event").join(facts.event_dates(g), "event").join(facts.tail_bounds(g), "event", "left")
    rows = rows.withColumn("bound_a", F.when(F.col("norm_a").isNull(), F.col("bound"))).withColumn("bound_b", F.when(F.col("norm_b").isNull(), F.col("bound"))).drop("bound")
    comparable = rows.where(facts.drawn(F.col("norm_a"), F.col("norm_b"), F.col("bound_a")).isNotNull() & facts.drawn(F.col("norm_b"), F.col("norm_a"), F.col("bound_b")).isNotNull())
    require(comparable, MIN_SHARED_EVENTS, "comparable events")
    return rows


def archetype_landscape(g: Graph, year: int) -> DataFrame:
    """Share against mean finish of every archetype seen in a year."""
    skip = facts.cut_only_events(g)
    shape = year_shape(g, year).select(F.col("decks").alias("year_total"), F.col("events").alias("year_events"))
    here = g.deck_year.where(F.col("year") == year)
    counts = g.primary.join(here, "deckId").groupBy("tag").agg(F.countDistinct("deckId").alias("n"))
    means = g.ranked.join(g.primary, "deckId").join(here, "deckId").join(skip, "event", "left_anti").groupBy("tag")
    means = means.agg(F.avg("norm").alias("mean_norm"), F.count("*").alias("scored"), F.countDistinct("event").alias("events"))
    rows = counts.join(means, "tag", "left").join(g.archetype, "tag").na.fill(0, ["scored", "events"])
    require(rows.where("mean_norm is not null"), MIN_LANDSCAPE_ARCHETYPES, "archetypes with a mean")
    rows = rows.crossJoin(F.broadcast(shape)).crossJoin(F.broadcast(facts.within_archetype_sd(g, year, skip)))
    low, high = facts.interval(F.col("mean_norm"), F.col("events"), F.col("sd"))
    return rows.select("tag", F.col("name").alias("archetype"), F.lit(year).alias("year"), "n", (F.col("n") / F.col("year_total")).alias("share"), "year_total", "year_events", "mean_norm", "scored", "events", low.alias("mean_low"), high.alias("mean_high"))


def archetype_events(g: Graph, tag: str, skip: DataFrame) -> DataFrame:
    """Events an archetype attended: mean finish (null if none is known) and ranked decks."""
    rows = g.primary.where(F.col("tag") == tag).join(g.played_at, "deckId").join(skip, "event", "left_anti").join(g.deck.select("deckId", "norm"), "deckId")
    return rows.groupBy("event").agg(F.avg("norm").alias("mean_norm"), F.count("norm").alias("decks"))


def archetype_timeline(g: Graph, a: str, b: str | None = None) -> DataFrame:
    """Mean finish by event, alone or against another archetype at shared events."""
    skip = facts.cut_only_events(g)
    left = archetype_events(g, a, skip).select("event", F.col("mean_norm").alias("mean_norm_a"), F.col("decks").alias("decks_a"))
    if b is None:
        rows = left.withColumn("mean_norm_b", F.lit(None).cast("double")).withColumn("decks_b", F.lit(0).cast("long"))
    else:
        rows = left.join(archetype_events(g, b, skip).select("event", F.col("mean_norm").alias("mean_norm_b"), F.col("decks").alias("decks_b")), "event")
    rows = rows.join(facts.event_dates(g), "event").join(g.event.select("event", "fieldImputed"), "event").join(facts.tail_bounds(g, skip), "event", "left")
    rows = rows.withColumn("bound_a", F.when(F.col("mean_norm_a").isNull(), F.col("bound")))
    rows = rows.withColumn("bound_b", F.when(F.col("mean_norm_b").isNull() & F.lit(b is not None), F.col("bound"))).drop("bound")
    ready = rows.where("mean_norm_a is not null")
    if b is not None:
        ready = rows.where(facts.drawn(F.col("mean_norm_a"), F.col("mean_norm_b"), F.col("bound_a")).isNotNull() & facts.drawn(F.col("mean_norm_b"), F.col("mean_norm_a"), F.col("bound_b")).isNotNull())
    require(ready, MIN_ARCHETYPE_EVENTS, "comparable events")
    return rows


def pilots_with_history(g: Graph) -> DataFrame:
    """Pilots with two or more years of two or more ranked events each."""
    rows = g.ranked.join(g.piloted_by, "deckId").join(g.deck_year, "deckId").join(facts.cut_only_events(g), "event", "left_anti")
    years = rows.groupBy("pilot", "year").agg(F.countDistinct("event").alias("n")).where(F.col("n") >= MIN_PILOT_YEAR_EVENTS)
    return years.groupBy("pilot").count().where(F.col("count") >= MIN_QUALIFYING_YEARS).join(g.pilot, "pilot").select("pilot", "displayName")


def archetypes_with_history(g: Graph) -> DataFrame:
    rows = g.ranked.join(g.primary, "deckId").join(g.played_at, "deckId").join(facts.cut_only_events(g), "event", "left_anti")
    return rows.groupBy("tag").agg(F.countDistinct("event").alias("n")).where(F.col("n") >= MIN_ARCHETYPE_EVENTS).join(g.archetype, "tag").select("tag", "name")


def latest_deck_year(shares: DataFrame) -> DataFrame:
    return shares.where("n > 0").agg(F.max("year").alias("year"))


def share_cut(shares: DataFrame, cut: float) -> DataFrame:
    """The largest archetypes of the latest year until their decks reach ``cut`` of its classified
    decks; the one that crosses is in."""
    last = shares.where("n > 0").join(F.broadcast(latest_deck_year(shares)), "year", "left_semi")
    order = Window.orderBy(F.desc("n"), "tag")  # one year's archetypes
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy())
    return last.withColumn("keep", before < cut * total).where("keep").select("tag", "year", "n")
