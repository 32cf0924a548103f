"""Results as graphs to draw: one shape of nodes and one of edges for every subgraph query.

nodes: id, label, kind, grp, decks, total_decks, events, x, y     edges: source, target, label, decks, total_decks, events
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.constants import TOP_PARTNERS
from loomspark.operators import gems as gem
from loomspark.operators import subgraph
from loomspark.operators.subgraph import node_id, ordinal, percent
from loomspark.plans.graph import Graph
from loomspark.session import materialised

SEED_X, SEED_DY, HUB_X, CARD_X = 800.0, 150.0, 350.0, 300.0
NODE = {"grp": "string", "decks": "long", "total_decks": "long", "events": "long", "x": "double", "y": "double"}
EDGE = {"decks": "long", "total_decks": "long", "events": "long"}


def _columns(known: dict[str, Column], kinds: dict[str, str]) -> list[Column]:
    return [known.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in kinds.items()]


def nodes(rows: DataFrame, id_: Column, label: Column, kind: str, **more: Column) -> DataFrame:
    return rows.select(id_.alias("id"), label.cast("string").alias("label"), F.lit(kind).alias("kind"), *_columns(more, NODE))


def edges(rows: DataFrame, source: Column, target: Column, label: Column, **more: Column) -> DataFrame:
    return rows.select(source.alias("source"), target.alias("target"), label.alias("label"), *_columns(more, EDGE))


def rate_edges(rows: DataFrame, source: Column, target: Column, decks: Column, total: Column) -> DataFrame:
    return edges(rows, source, target, F.when(total > 0, percent(decks / total)).otherwise("0%"), decks=decks, total_decks=total)


def plays_edges(rows: DataFrame, source: Column, target: Column) -> DataFrame:
    return edges(rows, source, target, F.concat(F.lit("PLAYS:"), F.col("events").cast("string")), events=F.col("events"))


def card_usage(g: Graph, canon, board: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Card, macros and archetypes with the share of their decks that run the card; each
    archetype hangs under its dominant macro. An unknown card gives nothing."""
    rows = subgraph.card_usage(g, canon, board).join(g.archetype.select(F.col("tag").alias("key"), F.col("name").alias("named")), "key", "left")
    card = g.card.where(F.col("canon") == canon).select(F.col("name").alias("card"))
    rows = rows.crossJoin(F.broadcast(card))  # one row, or none
    runs, total = F.col("runs"), F.col("total")
    name = F.coalesce("named", "key")
    tier = lambda k: rows.where(F.col("tier") == k)
    top, macro, tag = node_id("card", F.lit(canon)), node_id("macro", "key"), node_id("arch", "key")
    counts = {"decks": runs, "total_decks": total}
    out = nodes(tier("meta"), top, F.concat("card", F.lit(" ("), F.when(total > 0, F.col("label")).otherwise("0%"), F.lit(" of meta)")), "card", **counts)
    out = out.unionByName(nodes(tier("macro"), macro, F.concat("key", F.lit(" · "), "label"), "macro", **counts)).unionByName(nodes(tier("archetype"), tag, F.concat(name, F.lit(" · "), "label"), "archetype", **counts))
    links = rate_edges(tier("macro"), top, macro, runs, total).unionByName(rate_edges(tier("archetype"), node_id("macro", "parent"), tag, runs, total))
    return out, links


def _seed(g: Graph, canon) -> DataFrame:
    return subgraph.seed_decks(g, canon).select(F.lit(canon).alias("seed"), "name", "decks")


def cooccurrence(g: Graph, canon, top_n: int = TOP_PARTNERS, drop_lands: bool = False) -> tuple[DataFrame, DataFrame]:
    """A card and what shares its boards. An unknown card gives nothing."""
    rows = subgraph.cooccurrence(g, canon, top_n, drop_lands)
    me = node_id("card", F.lit(canon))
    out = nodes(_seed(g, canon), me, F.col("name"), "card", grp=node_id("seed", F.lit(canon)))
    out = out.unionByName(nodes(rows, node_id("card", "canon"), F.col("name"), "card", grp=F.lit("cooccur")))
    return out, rate_edges(rows, me, node_id("card", "canon"), F.col("shared"), F.col("seed_decks"))


def shared_cooccurrence(g: Graph, a, b, top_n: int = TOP_PARTNERS, drop_lands: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two cards, a hub of the decks that run both, and what these also run. One card twice, or an
    unknown second card, is the picture of the first alone; two that share no deck stand apart."""
    if a == b or not g.card.where(F.col("canon") == b).limit(1).count():
        return cooccurrence(g, a, top_n, drop_lands)
    decks = lambda x: g.contains.where(F.col("canon") == x).select("deckId").distinct()
    both = materialised(decks(a).join(decks(b), "deckId", "left_semi").agg(F.count("*").alias("both")).where("both > 0"), "both")  # a row, or none
    known = g.card.where(F.col("canon") == a).select(F.lit(1).alias("known"))  # an unknown first card: nothing
    rows = subgraph.shared_cooccurrence(g, a, b, top_n, drop_lands)
    hub = F.lit(f"both:{a}|{b}")
    out, links = None, None
    for canon, up in ((a, SEED_DY), (b, -SEED_DY)):
        seed = _seed(g, canon).crossJoin(F.broadcast(known)).join(both, F.lit(True), "left")
        pinned = F.col("both").isNotNull()
        mine = nodes(seed, node_id("card", "seed"), F.col("name"), "card", grp=node_id("seed", "seed"), x=F.when(pinned, F.lit(-SEED_X)), y=F.when(pinned, F.lit(up)))
        edge = rate_edges(seed.where(pinned), node_id("card", "seed"), hub, F.col("both"), F.col("decks"))
        out, links = (mine, edge) if out is None else (out.unionByName(mine), links.unionByName(edge))
    out = out.unionByName(nodes(both, hub, F.concat(F.lit("Both · "), F.col("both").cast("string"), F.lit(" decks")), "intersection", decks=F.col("both"), x=F.lit(-HUB_X), y=F.lit(0.0)))
    out = out.unionByName(nodes(rows, node_id("card", "canon"), F.col("name"), "card", grp=F.lit("cooccur"), x=F.lit(CARD_X), y=F.col("y")))
    return out, links.unionByName(rate_edges(rows, hub, node_id("card", "canon"), F.col("shared"), F.col("both_decks")))


def pilot_affinity(g: Graph, pilot) -> tuple[DataFrame, DataFrame]:
    """A pilot, the macros and archetypes played, by events. Without decks the pilot stands
    alone; an unknown pilot gives nothing."""
    rows = materialised(subgraph.pilot_affinity(g, pilot), "affinity")
    me, macro, tag = node_id("pilot", F.lit(pilot)), node_id("macro", "macro"), node_id("arch", "tag")
    tier = lambda k: rows.where(F.col("tier") == k)
    out = nodes(g.pilot.where(F.col("pilot") == pilot), me, F.col("displayName"), "pilot")
    out = out.unionByName(nodes(tier("macro"), macro, F.col("macro"), "macro", events=F.col("events")))
    out = out.unionByName(nodes(tier("archetype").join(g.archetype, "tag"), tag, F.col("name"), "archetype", events=F.col("events")))
    return out, plays_edges(tier("macro"), me, macro).unionByName(plays_edges(tier("macro x archetype"), macro, tag))


def hidden_gems(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Archetypes, their gems, and every deck that topped with one, labelled by pilot and finish."""
    held = materialised(gem.slices(g), "slices")
    found = materialised(gem.hidden_gems(g, held), "gems")
    tag, card, deck = node_id("arch", "tag"), F.concat(F.lit("card:"), F.col("tag").cast("string"), F.lit(":"), F.col("canon").cast("string")), node_id("deck", "deckId")
    boards = g.contains.join(F.broadcast(found.select("canon").distinct()), "canon", "left_semi").groupBy("deckId", "canon").agg(F.array_join(F.sort_array(F.collect_set("board")), "/").alias("board"))
    tops = held.where("top").select("tag", "deckId").join(found.select("tag", "canon"), "tag").join(boards, ["deckId", "canon"])
    who = tops.select("deckId").distinct().join(g.deck.select("deckId", "placement"), "deckId").join(g.piloted_by, "deckId").join(g.pilot, "pilot")
    label = F.when(F.col("placement").isNull(), F.col("displayName")).otherwise(F.concat("displayName", F.lit(" · "), ordinal(F.col("placement"))))
    out = nodes(found.select("tag", "total").distinct().join(g.archetype, "tag"), tag, F.col("name"), "archetype", decks=F.col("total"))
    out = out.unionByName(nodes(found.join(g.card.select("canon", "name"), "canon"), card, F.col("name"), "card", decks=F.col("decks"), total_decks=F.col("total")))
    out = out.unionByName(nodes(who, deck, label, "deck"))
    within = F.concat(F.lit("IN:"), F.col("decks").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" decks"))
    links = edges(found, tag, card, within, decks=F.col("decks"), total_decks=F.col("total"))
    return out, links.unionByName(edges(tops, deck, card, F.concat(F.lit("CONTAINS:"), F.col("board"))))


def gem_table(g: Graph) -> DataFrame:
    """Gems in the order of the table: archetype, luck, card; ``ord`` from 1."""
    rows = gem.hidden_gems(g).join(g.archetype.select("tag", F.col("name").alias("archetype")), "tag").join(g.card.select("canon", F.col("name").alias("card")), "canon")
    by = Window.orderBy("archetype", "luck", "card", "canon")  # a short list
    return rows.select(F.row_number().over(by).alias("ord"), "archetype", "card", "canon", "decks", "hits", "pilots", F.round("luck", 9).alias("luck"))
