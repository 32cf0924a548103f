"""The typed graph as tables: what every operator takes."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """Node and edge tables. Decks carry their one pilot, event and macro as edge tables of one
    row a deck; ``contains`` may list a card on both boards of a deck."""

    deck: DataFrame  # deckId, deckName, placement, norm, placementImputed, normImputed, createdAt
    card: DataFrame  # canon, name, type, points, pointsCompanion
    pilot: DataFrame  # pilot, displayName
    event: DataFrame  # event, eventType, fieldSize, fieldImputed
    archetype: DataFrame  # tag, name
    piloted_by: DataFrame  # deckId, pilot
    contains: DataFrame  # deckId, canon, board
    played_at: DataFrame  # deckId, event
    has_archetype: DataFrame  # deckId, tag, weight, isPrimary
    has_macro: DataFrame  # deckId, macro
    in_year: DataFrame  # event, year
    macro: DataFrame  # macro
    colour: DataFrame  # colour: all five, whoever holds them
    card_type: DataFrame  # type
    year: DataFrame  # year
    deck_colour: DataFrame  # deckId, colour
    card_colour: DataFrame  # canon, colour
    has_type: DataFrame  # canon, type

    @property
    def ranked(self) -> DataFrame:
        return self.deck.where(F.col("norm").isNotNull())

    @property
    def primary(self) -> DataFrame:
        """deckId, tag of each deck's primary archetype; some decks have none."""
        return self.has_archetype.where("isPrimary").select("deckId", "tag")

    @property
    def deck_year(self) -> DataFrame:
        return self.played_at.join(self.in_year, "event")

    def counts(self) -> dict[str, int]:
        """Rows of the nine node and nine edge tables."""
        return {f.name: getattr(self, f.name).count() for f in fields(self)}


class NotEnoughHistory(ValueError):
    """The evidence is too thin for an answer; ``found`` says how much there is."""

    def __init__(self, what: str, found: int):
        super().__init__(f"{what}: found {found}")
        self.found = found


def require(df: DataFrame, least: int, what: str) -> None:
    found = df.limit(least).count()
    if found < least:
        raise NotEnoughHistory(what, found)
