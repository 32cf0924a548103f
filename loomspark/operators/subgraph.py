"""Subgraph queries: nodes and edges as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.constants import LAND_TYPE, RENDER_THRESHOLD, TOP_PARTNERS
from loomspark.plans.graph import Graph


def node_id(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(kind + ":"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def percent(share: Column) -> Column:
    """Half-even whole percent; anything above zero that rounds to none is ``<1%``."""
    whole = F.bround(share * 100).cast("long")
    return F.when((share > 0) & (share * 100 < 0.5), "<1%").otherwise(F.concat(whole.cast("string"), F.lit("%")))


def ordinal(n: Column) -> Column:
    tail = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), tail)


def neighbourhood_rows(g: Graph, a, b=None) -> DataFrame:
    """Deck rows of one pilot, or of two at the events both entered."""
    pair = [a] if b is None or b == a else [a, b]
    rows = g.piloted_by.where(F.col("pilot").isin(pair)).join(g.deck.select("deckId", "deckName", "placement", "placementImputed"), "deckId").join(g.played_at, "deckId").join(g.pilot, "pilot")
    if len(pair) == 2:
        both = rows.groupBy("event").agg(F.countDistinct("pilot").alias("n")).where("n = 2").select("event")
        rows = rows.join(both, "event", "left_semi")
    return rows


def neighbourhood_nodes(g: Graph, a, b=None) -> DataFrame:
    rows = neighbourhood_rows(g, a, b)
    group = F.when(F.lit(b is not None and b != a), F.col("pilot").cast("string"))
    place = F.concat(ordinal(F.col("placement")), F.when(F.col("placementImputed").isNotNull(), "*").otherwise(""))
    parts = [
        rows.select(node_id("pilot", "pilot").alias("id"), F.col("displayName").alias("label"), F.lit("pilot").alias("kind"), group.alias("grp")),
        rows.select(node_id("event", "event"), "event", F.lit("event"), F.lit(None).cast("string")),
        rows.select(node_id("deck", "deckId"), "deckName", F.lit("deck"), group),
        rows.where("placement is not null").select(node_id("placement", "deckId"), place, F.lit("placement"), group),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def neighbourhood_edges(g: Graph, a, b=None) -> DataFrame:
    rows = neighbourhood_rows(g, a, b)
    pilot, event, deck = node_id("pilot", "pilot"), node_id("event", "event"), node_id("deck", "deckId")
    out = rows.select(pilot.alias("source"), event.alias("target"), F.lit("entered").alias("label"))
    out = out.union(rows.select(event, deck, F.lit("played"))).union(rows.where("placement is not null").select(deck, node_id("placement", "deckId"), F.lit("finished")))
    return out.distinct()


def card_usage(g: Graph, canon, board: str | None = None) -> DataFrame:
    """Adoption of a card over all decks, by macro and by primary archetype: runs, total, share and
    label, with each archetype's dominant macro. Archetypes and macros without a run are left out."""
    held = g.contains.where(F.col("canon") == canon)
    if board:
        held = held.where(F.col("board") == board)
    runs = held.select("deckId").distinct()
    decks = g.deck.select("deckId").join(g.has_macro, "deckId").join(g.primary, "deckId", "left").join(runs.withColumn("run", F.lit(1)), "deckId", "left")
    # one pass over decks; the three tiers come from grouping sets
    tiers = decks.cube("macro", "tag").agg(F.count("*").alias("total"), F.count("run").alias("runs"), F.grouping_id("macro", "tag").alias("gid"))
    overall = tiers.where("gid = 3").select(F.lit("meta").alias("tier"), F.lit("all").alias("key"), "total", "runs", F.lit(None).cast("string").alias("parent"))
    macros = tiers.where("gid = 1 and runs > 0").select(F.lit("macro"), "macro", "total", "runs", F.lit(None).cast("string"))
    best = Window.partitionBy("tag").orderBy(F.desc("runs"), "macro")
    home = tiers.where("gid = 0 and tag is not null and runs > 0").withColumn("k", F.row_number().over(best)).where("k = 1").select("tag", F.col("macro").alias("parent"))
    tags = tiers.where("gid = 2 and tag is not null and runs > 0").select("tag", "total", "runs").join(home, "tag").select(F.lit("archetype"), "tag", "total", "runs", "parent")
    share = F.col("runs") / F.col("total")
    return overall.union(macros).union(tags).select("tier", "key", "runs", "total", "parent", share.alias("share"), percent(share).alias("label"))


def _no_lands(g: Graph, rows: DataFrame, drop_lands: bool) -> DataFrame:
    cards = g.card.select("canon", "name", "type")
    if drop_lands:
        cards = cards.where(F.col("type") != LAND_TYPE)
    return rows.join(cards, "canon")


def seed_decks(g: Graph, canon) -> DataFrame:
    """One row (name, decks) of a known card, zero decks if nobody plays it; none if unknown."""
    card = g.card.where(F.col("canon") == canon).select("canon", "name")
    return card.join(g.contains, "canon", "left").groupBy("canon", "name").agg(F.countDistinct("deckId").alias("decks")).select("name", "decks")


def cooccurrence(g: Graph, canon, top_n: int = TOP_PARTNERS, drop_lands: bool = False) -> DataFrame:
    """Cards on the same board of the same decks as a seed, most shared first."""
    seed = g.contains.where(F.col("canon") == canon).select("deckId", "board")
    pairs = g.contains.where(F.col("canon") != canon).join(seed, ["deckId", "board"])
    counts = pairs.groupBy("canon").agg(F.countDistinct("deckId").alias("shared"))
    top = _no_lands(g, counts, drop_lands).orderBy(F.desc("shared"), "name", "canon").limit(top_n)
    total = seed.agg(F.countDistinct("deckId").alias("seed_decks"))
    share = F.col("shared") / F.col("seed_decks")
    return top.crossJoin(F.broadcast(total)).select("canon", "name", "shared", "seed_decks", share.alias("share"), percent(share).alias("label"))


def shared_cooccurrence(g: Graph, a, b, top_n: int = TOP_PARTNERS, drop_lands: bool = False) -> DataFrame:
    """Cards of the decks that hold two seeds, on any board; ``y`` lays them out in a column."""
    decks = lambda c: g.contains.where(F.col("canon") == c).select("deckId").distinct()
    both = decks(a).join(decks(b), "deckId", "left_semi")
    counts = g.contains.where(~F.col("canon").isin([a, b])).join(both, "deckId", "left_semi").groupBy("canon").agg(F.countDistinct("deckId").alias("shared"))
    top = _no_lands(g, counts, drop_lands).orderBy(F.desc("shared"), "name", "canon").limit(top_n)
    order = Window.orderBy(F.desc("shared"), "name", "canon")  # top_n rows
    rows = top.withColumn("ord", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    return rows.crossJoin(F.broadcast(both.agg(F.count("*").alias("both_decks")))).select("canon", "name", "shared", "both_decks", "ord", ((F.col("ord") - (F.col("n") - 1) / 2) * 80.0).alias("y"))


def pilot_affinity(g: Graph, pilot) -> DataFrame:
    """Distinct events of a pilot by macro, by archetype and by both."""
    rows = g.piloted_by.where(F.col("pilot") == pilot).select("deckId").join(g.has_macro, "deckId").join(g.played_at, "deckId").join(g.primary, "deckId", "left")
    sets = rows.cube("macro", "tag").agg(F.countDistinct("event").alias("events"), F.grouping_id("macro", "tag").alias("gid")).where("gid < 3")
    return sets.where("gid = 1 or tag is not null").select(F.when(F.col("gid") == 0, "macro x archetype").when(F.col("gid") == 1, "macro").otherwise("archetype").alias("tier"), "macro", "tag", "events")


def result_size(nodes: DataFrame) -> DataFrame:
    """One row: number of nodes, whether to draw them, and the most frequent kind."""
    kinds = nodes.groupBy("kind").count()
    return kinds.agg(F.sum("count").alias("nodes"), F.max_by("kind", F.struct("count", "kind")).alias("dominant")).withColumn("draw", F.coalesce("nodes", F.lit(0)) <= RENDER_THRESHOLD)
