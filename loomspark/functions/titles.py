"""Placements and names that titles spell out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NUMBER = r"([0-9xX?]+)(?:st|nd|rd|th)?h?"
TOKEN = rf"(?i)^[\s]*[*]?[\s]*-?[\s]*(?:top[\s]*)?{_NUMBER}(?:[\s]*[/-][\s]*{_NUMBER})?[\s]+"
TOP = r"(?i)^[\s]*[*]?[\s]*-?[\s]*top[\s]*([0-9]+)"


def _parts(title: Column) -> tuple[Column, Column, Column]:
    """Whether the title starts with a placement, and its two numbers ('' if absent)."""
    t = F.coalesce(title, F.lit(""))
    return t.rlike(TOKEN), F.regexp_extract(t, TOKEN, 1), F.regexp_extract(t, TOKEN, 2)


def _digits(c: Column) -> Column:
    return c.rlike("^[0-9]+$")


def placement_from_title(title: Column) -> Column:
    """struct(placement, rule): the better end of a range, else the only number of three digits at most."""
    held, low, high = _parts(title)
    ranged = (high != "") & _digits(low) & _digits(high)
    pick = F.when(ranged, F.least(low.try_cast("decimal(38,0)"), high.try_cast("decimal(38,0)")).cast("string")).when(high != "", high).otherwise(low)
    good = held & _digits(pick) & (F.length(pick) <= 3)
    return F.struct(F.when(good, pick.try_cast("long")).alias("placement"), F.when(~good, "none").when(ranged, "title-range").otherwise("title-single").alias("rule"))


def tier_width(title: Column) -> Column:
    """How many decks may share the placement; null if the title doesn't bound it."""
    held, low, high = _parts(title)
    top = F.coalesce(title, F.lit("")).rlike(TOP)
    ranged = (high != "") & _digits(low) & _digits(high)
    return F.when(top | ~held, None).when(ranged, F.abs(high.try_cast("long") - low.try_cast("long")) + 1).when(_digits(low), F.lit(1)).cast("long")


def cut_placements(decks: DataFrame) -> DataFrame:
    """Decks titled "Top N" take the best rank of their tier, the tiers of an event being nested."""
    bound = F.when(F.coalesce("name", F.lit("")).rlike(TOP), F.regexp_extract("name", TOP, 1).try_cast("long"))
    rows = decks.withColumn("cut_", bound)
    tiers = rows.where("cut_ is not null").select("event", "cut_").distinct()
    best = F.coalesce(F.lag("cut_").over(Window.partitionBy("event").orderBy("cut_")), F.lit(0)) + 1
    rows = rows.join(tiers.withColumn("best_", best), ["event", "cut_"], "left")
    rows = rows.withColumn("placement", F.coalesce("best_", "placement")).withColumn("placementImputed", F.when(F.col("best_").isNotNull(), "cohort-cut").otherwise(F.col("placementImputed")))
    return rows.select(*decks.columns)


def cleansed(decks: DataFrame) -> DataFrame:
    """Placements from titles where the source has none, then the cuts."""
    found = decks.withColumn("t_", placement_from_title(F.col("name")))
    imputed = F.when(F.col("placement").isNull(), F.col("t_.rule"))
    found = found.withColumn("placementImputed", imputed).withColumn("placement", F.coalesce("placement", "t_.placement")).drop("t_")
    return cut_placements(found)


def name_from_title(title: Column, deck_name: Column, event: Column) -> Column:
    """The person a title names, or null: first segment that isn't empty; a title without
    separators loses the event and the deck's name at its end; a points marker is no name."""
    bare = F.regexp_replace(title, TOKEN, "")
    segments = F.split(bare, r"[\s]+[-–—][\s]*|[\s]*[-–—][\s]+")
    first = F.try_element_at(F.filter(F.transform(segments, lambda s: F.trim(F.regexp_replace(s, r"^[\s]+|[\s]+$", ""))), lambda s: s != ""), F.lit(1))

    def without(name: Column, end: Column) -> Column:
        lower, tail = F.lower(name), F.lower(end)
        fits = end.isNotNull() & (end != "") & lower.endswith(tail) & (F.length(name) > F.length(end))
        return F.when(fits, F.rtrim(F.substring(name, F.lit(1), F.length(name) - F.length(end)))).otherwise(name)

    name = F.when(F.size(segments) > 1, first).otherwise(without(without(first, event), deck_name))
    return F.when(name.rlike(r"(?i)^[78][\s]*pts?\b"), None).otherwise(name)
