"""Query specifications: frozen records of what to ask, and their dispatch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from loomspark.constants import TOP_PARTNERS
from loomspark.operators import gems, leaderboard, pictures, series, subgraph
from loomspark.plans.graph import Graph


@dataclass(frozen=True)
class PilotNeighbourhood:
    pilot: object
    other: object | None = None


@dataclass(frozen=True)
class CardUsage:
    canon: object
    board: str | None = None


@dataclass(frozen=True)
class CardCooccurrence:
    canon: object
    other: object | None = None
    top_n: int = TOP_PARTNERS
    drop_lands: bool = False


@dataclass(frozen=True)
class HiddenGems:
    pass


@dataclass(frozen=True)
class PilotAffinity:
    pilot: object


@dataclass(frozen=True)
class MetaShare:
    pass


@dataclass(frozen=True)
class CardAdoption:
    canon: object
    board: str | None = None


@dataclass(frozen=True)
class PilotPerformance:
    pilot: object


@dataclass(frozen=True)
class HeadToHead:
    a: object
    b: object


@dataclass(frozen=True)
class Landscape:
    year: int


@dataclass(frozen=True)
class ArchetypeTimeline:
    a: str
    b: str | None = None


@dataclass(frozen=True)
class Leaderboard:
    pass


def run_query(g: Graph, spec) -> dict[str, DataFrame]:
    """``nodes`` and ``edges`` for every query; gems also say how many luck explains."""
    match spec:
        case PilotNeighbourhood(a, b):
            return {"nodes": subgraph.neighbourhood_nodes(g, a, b), "edges": subgraph.neighbourhood_edges(g, a, b)}
        case CardUsage(canon, board):
            found = pictures.card_usage(g, canon, board)
        case CardCooccurrence(a, b, top, lands):
            found = pictures.cooccurrence(g, a, top, lands) if b is None else pictures.shared_cooccurrence(g, a, b, top, lands)
        case HiddenGems():
            found = pictures.hidden_gems(g)
            return {"nodes": found[0], "edges": found[1], "expected": gems.expected_by_luck(g)}
        case PilotAffinity(pilot):
            found = pictures.pilot_affinity(g, pilot)
        case _:
            raise TypeError(f"no such query: {spec!r}")
    return {"nodes": found[0], "edges": found[1]}


def run_series(g: Graph, spec) -> DataFrame:
    match spec:
        case MetaShare():
            return series.meta_share(g)
        case CardAdoption(canon, board):
            return series.card_adoption(g, canon, board)
        case PilotPerformance(pilot):
            return series.pilot_performance(g, pilot)
        case HeadToHead(a, b):
            return series.head_to_head(g, a, b)
        case Landscape(year):
            return series.archetype_landscape(g, year)
        case ArchetypeTimeline(a, b):
            return series.archetype_timeline(g, a, b)
        case Leaderboard():
            return leaderboard.leaderboard(g)
    raise TypeError(f"no such series: {spec!r}")
