"""From gated snapshots to the graph: overrides, field sizes, norms, guards, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.constants import COLOURS, MIN_CUT_FIELD
from loomspark.functions.titles import tier_width
from loomspark.plans.graph import Graph
from loomspark.sources.snapshot import Snapshot, code, colours_in


class YearStraddle(ValueError):
    """An event whose decks lie in two years."""


class TwoWinners(ValueError):
    """A tournament with more first places than its titles allow."""


def override_archetypes(decks: DataFrame, overrides: DataFrame) -> DataFrame:
    """``overrides`` (deckId, newName, engine, label): one primary archetype at weight 100 instead of all."""
    rows = decks.join(F.broadcast(overrides), "deckId", "left")  # the curated dictionary: hundreds of rows
    hit = F.col("engine").isNotNull()
    new = {
        "deckName": F.col("newName"), "engineTags": F.array("engine"), "engineTagLabels": F.create_map("engine", "label"),
        "primaryTag": F.col("engine"), "primaryTagWeights": F.create_map(F.col("engine"), F.lit(100).cast("long")),
    }
    return rows.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in decks.columns])


def reassign_events(decks: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves`` (deckId, toEvent): the deck takes id, type and size of the last other deck there,
    and its norm is no longer its own."""
    rows = decks.join(F.broadcast(moves), "deckId", "left")
    speaker = rows.where("toEvent is null").groupBy(F.col("event").alias("toEvent")).agg(F.max_by(F.struct("eventId", "eventType", "eventSize"), "deck_ord").alias("s_"))
    lost = moves.join(decks, "deckId", "left_semi").join(speaker, "toEvent", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"deck {lost[0]['deckId']} can't move to unknown event {lost[0]['toEvent']}")
    rows = rows.join(speaker, "toEvent", "left")
    hit = F.col("s_").isNotNull()
    new = {"event": F.col("toEvent"), "eventId": F.col("s_.eventId"), "eventType": F.col("s_.eventType"), "eventSize": F.col("s_.eventSize"), "placementNorm": F.lit(None).cast("double"), "normImputed": F.lit("reassigned")}
    return rows.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in decks.columns])


def event_years(decks: DataFrame) -> DataFrame:
    """(event, year), refusing an event that straddles two."""
    years = decks.groupBy("event").agg(F.countDistinct(F.year("createdAt")).alias("n"), F.min(F.year("createdAt")).cast("long").alias("year"))
    bad = years.where("n > 1").limit(1).collect()
    if bad:
        raise YearStraddle(bad[0]["event"])
    return years.select("event", "year")


def check_sole_winner(decks: DataFrame) -> None:
    first = decks.where((F.col("eventType") == "Tournament") & (F.col("placement") == 1)).withColumn("w_", tier_width(F.col("name")))
    bad = first.groupBy("event").agg(F.count("*").alias("n"), F.max("w_").alias("w"), F.bool_or(F.col("w_").isNull()).alias("open")).where((F.col("n") > F.col("w")) & ~F.col("open")).limit(1).collect()
    if bad:
        raise TwoWinners(f"{bad[0]['event']}: {bad[0]['n']} first places")


def corrected_field(kind: Column, size: Column, pilots: Column, deepest: Column) -> Column:
    """struct(fieldSize, fieldImputed): what a tournament's field must have been at least."""
    wide = F.greatest(pilots, deepest, F.lit(MIN_CUT_FIELD))
    rule = F.when(kind != "Tournament", None).when(size.isNull(), "C").when((pilots > size) | (deepest > size), "A").when(size <= 8, "B")
    value = F.when(rule == "B", F.greatest(pilots, F.lit(MIN_CUT_FIELD))).when(rule.isNotNull(), wide).otherwise(size)
    return F.struct(value.cast("long").alias("fieldSize"), rule.alias("fieldImputed"))


def event_fields(decks: DataFrame, deck_pilot: DataFrame) -> DataFrame:
    """A row an event: last id and type, first known size, corrected field."""
    rows = decks.join(deck_pilot.select("deckId", F.col("pilot").alias("p_")), "deckId", "left").groupBy("event")
    rows = rows.agg(F.countDistinct("p_").alias("pilots"), F.coalesce(F.max("placement"), F.lit(0)).alias("deepest"), F.min_by("eventSize", F.when(F.col("eventSize").isNotNull(), F.col("deck_ord"))).alias("size"), F.max_by("eventType", "deck_ord").alias("eventType"), F.max_by("eventId", "deck_ord").alias("eventId"))
    return rows.withColumn("f_", corrected_field(F.col("eventType"), F.col("size"), F.col("pilots"), F.col("deepest"))).select("event", "eventId", "eventType", "f_.fieldSize", "f_.fieldImputed")


def normalised(decks: DataFrame, fields: DataFrame) -> DataFrame:
    """Norms rescaled where the field was corrected, minted where the source has none."""
    rows = decks.join(fields.select("event", "fieldSize", "fieldImputed"), "event", "left")
    place, field = F.col("placement"), F.col("fieldSize")
    usable = place.isNotNull() & field.isNotNull() & (field > 1) & place.between(1, field)
    formula = F.when(usable, (place - 1) / (field - 1))
    has = F.col("placementNorm").isNotNull()
    rescale = has & F.col("fieldImputed").isNotNull() & place.isNotNull() & usable
    rule = F.when(rescale, "rescaled").when(has, F.col("normImputed")).when(usable, F.coalesce("normImputed", F.lit("minted"))).otherwise("none")
    norm = F.when(rescale, formula).when(has, F.col("placementNorm")).otherwise(formula)
    return rows.withColumn("rule_", rule).withColumn("placementNorm", norm).withColumn("normImputed", F.col("rule_")).drop("rule_", "fieldSize", "fieldImputed")


def imputed_values(rows: DataFrame, key: str, rule: str) -> DataFrame:
    """(rule, n, keys): what was decided, by rule."""
    return rows.where(F.col(rule).isNotNull()).groupBy(F.col(rule).alias("rule")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(key)).alias("keys"))


def to_graph(s: Snapshot, decks: DataFrame, deck_pilot: DataFrame, pilots: DataFrame, fields: DataFrame) -> Graph:
    """Node and edge tables; an edge whose end is missing isn't kept."""
    years = event_years(decks)
    tags = decks.select("deckId", "deck_ord", F.explode("engineTags").alias("raw"), "engineTagLabels", "primaryTagWeights", "primaryTag")
    tags = tags.select("deckId", "deck_ord", code(F.col("raw")).alias("tag"), F.coalesce(F.col("engineTagLabels")[F.col("raw")], F.col("raw")).alias("name"), F.coalesce(F.col("primaryTagWeights")[F.col("raw")], F.lit(0)).alias("weight"), (F.col("raw") == F.col("primaryTag")).alias("isPrimary"))
    return Graph(
        deck=decks.select("deckId", "deckName", "placement", F.col("placementNorm").alias("norm"), "placementImputed", "normImputed", "createdAt"),
        card=s.cards.select("canon", "name", "type", "manaValue", "reserved", "priceUsd", "points", "pointsCompanion"),
        pilot=pilots, event=fields, archetype=tags.groupBy("tag").agg(F.max_by("name", "deck_ord").alias("name")),
        piloted_by=deck_pilot.join(decks, "deckId", "left_semi").join(pilots, "pilot", "left_semi").select("deckId", "pilot"),
        contains=s.contains.join(decks, "deckId", "left_semi").join(s.cards, "canon", "left_semi").select("deckId", "canon", "board"),
        played_at=decks.select("deckId", "event"), has_archetype=tags.select("deckId", "tag", "weight", "isPrimary").distinct(),
        has_macro=decks.select("deckId", code(F.col("macro")).alias("macro")), in_year=years,
        macro=decks.select(code(F.col("macro")).alias("macro")).distinct(), colour=all_colours(decks.sparkSession),
        card_type=s.cards.select("type").distinct(), year=years.select("year").distinct(),
        deck_colour=decks.select("deckId", F.explode(colours_in(code(F.col("colour")))).alias("colour")),
        card_colour=s.cards.select("canon", F.explode("colours").alias("colour")), has_type=s.cards.select("canon", "type"),
    )


def all_colours(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in COLOURS], "colour string")
