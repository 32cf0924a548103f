"""Versioned JSON snapshots: a directory of decks and a card index, under a fixed schema."""

from __future__ import annotations

from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.constants import COLOURS

DECK_SCHEMA = "deckId string, name string, deckName string, pilot string, event string, eventId string, eventType string, placement long, placementNorm double, eventSize long, createdAt string, colour string, macro string, engineTags array<string>, engineTagLabels map<string,string>, primaryTag string, primaryTagWeights map<string,long>, pointsToday long"
INDEX_SCHEMA = "v int, cards array<struct<canon: string, name: string, type: string, manaCost: string, manaValue: double, reserved: boolean, priceUsd: double, points: long, pointsCompanion: long>>, decks map<string, struct<m: array<int>, s: array<int>>>"
REQUIRED_DECK = ("deckId", "name", "eventType", "createdAt", "colour", "macro", "engineTags", "engineTagLabels", "primaryTag", "primaryTagWeights")
REQUIRED_CARD = ("canon", "name", "type", "manaValue", "reserved", "points", "pointsCompanion")


class SchemaError(ValueError):
    """A snapshot that doesn't have the agreed shape."""


@dataclass(frozen=True)
class Snapshot:
    """Rows of one snapshot. ``deck_ord`` keeps the file's order, on which some picks depend."""

    decks: DataFrame
    cards: DataFrame
    contains: DataFrame

    def at(self, index: int) -> Snapshot:
        mark = lambda df: df.withColumn("snap", F.lit(index))
        return replace(self, decks=mark(self.decks), cards=mark(self.cards), contains=mark(self.contains))


def snapshot_dirs(root: str) -> list[str]:
    """Snapshots by name, that is by time; hidden folders are staging areas."""
    return [str(p) for p in sorted(Path(root).iterdir()) if p.is_dir() and not p.name.startswith(".")]


def colours_in(column: F.Column) -> F.Column:
    """The colours whose letters a text has, in their fixed order."""
    held = F.filter(F.array(*map(F.lit, COLOURS)), lambda c: column.contains(c))
    return F.when(column.isNull(), F.array().cast("array<string>")).otherwise(held)


def code(column: F.Column) -> F.Column:
    """What follows the first colon."""
    return F.regexp_replace(column, "^[^:]*:", "")


def load_snapshot(spark: SparkSession, path: str) -> Snapshot:
    """Read lazily; nothing is checked before ``load_checked``."""
    read = lambda schema, name: spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(f"{path}/{name}")
    decks = read(DECK_SCHEMA, "decks.json").withColumn("deck_ord", F.monotonically_increasing_id())
    for c in ("pilot", "event", "deckName"):
        decks = decks.withColumn(c, F.coalesce(c, F.lit("nan")))
    decks = decks.withColumn("createdAt", F.to_timestamp("createdAt"))
    index = read(INDEX_SCHEMA, "cards_index.json")
    cards = index.select(F.posexplode("cards").alias("pos", "c")).select("pos", "c.*").withColumn("colours", colours_in(F.col("manaCost")))
    lists = index.select(F.explode("decks").alias("deckId", "boards"))
    ids = lists.select("deckId", F.explode(F.map_from_arrays(F.array(F.lit("Main"), F.lit("Side")), F.array("boards.m", "boards.s"))).alias("board", "ids")).select("deckId", "board", F.explode("ids").alias("pos"))
    # positions are ids within this file only; an unknown one must not pass silently
    contains = ids.join(cards.select("pos", "canon"), "pos", "left").select("deckId", "board", "canon", "pos").distinct()
    return Snapshot(decks, cards, contains)


def load_checked(spark: SparkSession, path: str) -> Snapshot:
    """Read and refuse: files missing or not JSON, required fields absent, positions without a card."""
    for name in ("decks.json", "cards_index.json"):
        if not (Path(path) / name).is_file():
            raise SchemaError(f"{path}: no {name}")
    s = load_snapshot(spark, path)
    try:
        for df, names in ((s.decks, REQUIRED_DECK), (s.cards, REQUIRED_CARD)):
            missing = df.select(*[F.count_if(F.col(n).isNull()).alias(n) for n in names]).first().asDict()
            if bad := [n for n, k in missing.items() if k]:
                raise SchemaError(f"{path}: without {', '.join(bad)}")
        lost = s.contains.where("canon is null").limit(1).collect()
    except SchemaError:
        raise
    except Exception as e:  # Spark reports malformed JSON in several ways
        raise SchemaError(f"{path}: {str(e).splitlines()[0]}") from e
    if lost:
        raise SchemaError(f"{path}: deck {lost[0]['deckId']} names card {lost[0]['pos']}, which is not in the index")
    return replace(s, contains=s.contains.select("deckId", "canon", "board"), cards=s.cards.drop("pos"))
