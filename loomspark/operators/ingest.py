"""Union of snapshots and the gate: newest wins, what vanished stays, what changed is flagged."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.session import materialised
from loomspark.sources.snapshot import Snapshot


def stacked(snapshots: list[Snapshot]) -> Snapshot:
    """All snapshots' rows with ``snap``, their index."""
    marked = [s.at(k) for k, s in enumerate(snapshots)]
    join = lambda part: reduce(DataFrame.unionByName, [getattr(s, part) for s in marked])
    return Snapshot(join("decks"), join("cards"), join("contains"))


def _pick(rows: DataFrame, key: str, first: DataFrame | None) -> DataFrame:
    """One row a key: from the newest snapshot, or from the first for keys in ``first``."""
    by = Window.partitionBy(key)
    rows = rows.withColumn("old_", F.min("snap").over(by)).withColumn("new_", F.max("snap").over(by))
    if first is not None:
        rows = rows.join(first.select(F.col("id").alias(key)).distinct().withColumn("pin_", F.lit(True)), key, "left")
    else:
        rows = rows.withColumn("pin_", F.lit(None).cast("boolean"))
    at = F.when(F.col("pin_"), F.col("old_")).otherwise(F.col("new_"))
    return rows.where(F.col("snap") == at).drop("old_", "new_", "pin_")


def union_snapshots(snapshots: list[Snapshot], pinned: DataFrame | None = None) -> Snapshot:
    """The newest record of every id ever seen, in first-seen order (``deck_ord``); ids flagged as
    changed in ``pinned`` (entity, id) keep their first record with its memberships."""
    s = stacked(snapshots)
    of = lambda kind: None if pinned is None else pinned.where(F.col("entity") == kind)
    seen = s.decks.groupBy("deckId").agg(F.min(F.struct("snap", "deck_ord")).alias("seen_"))
    picked = _pick(s.decks, "deckId", of("deck"))
    decks = picked.drop("deck_ord").join(seen, "deckId").withColumn("deck_ord", F.struct("seen_.snap", "seen_.deck_ord")).drop("seen_")
    # the list of the very record that was picked, which may be empty
    lists = s.contains.join(picked.select("deckId", "snap"), ["deckId", "snap"], "left_semi")
    return Snapshot(decks.drop("snap"), _pick(s.cards, "canon", of("card")).drop("snap"), lists.drop("snap"))


def first_seen(decks: DataFrame) -> DataFrame:
    """(deckId, first_seen) from rows of (deckId, stamp): known as of every stamp from then on."""
    return decks.groupBy("deckId").agg(F.min("stamp").alias("first_seen"))


def projections(s: Snapshot) -> DataFrame:
    """(entity, id, snap, digest) of what must never change: a deck's pilot, event, placement, date
    and memberships; a card's name and type."""
    lists = s.contains.groupBy("deckId", "snap").agg(F.sort_array(F.collect_list(F.struct("canon", "board"))).alias("list"))
    deck = s.decks.join(lists, ["deckId", "snap"], "left")
    digest = lambda *c: F.sha2(F.to_json(F.struct(*c), {"ignoreNullFields": "false"}), 256)
    decks = deck.select(F.lit("deck").alias("entity"), F.col("deckId").alias("id"), "snap", digest("pilot", "event", "placement", "createdAt", "list").alias("digest"))
    return decks.unionByName(s.cards.select(F.lit("card").alias("entity"), F.col("canon").alias("id"), "snap", digest("name", "type").alias("digest")))


def gate_flags(rows: DataFrame, last: int) -> DataFrame:
    """(kind, entity, id) over the whole sequence in one pass: ``changed`` if two successive
    appearances differ, ``dropped`` if any snapshot after the first appearance lacks the id."""
    by = Window.partitionBy("entity", "id").orderBy("snap")
    step = rows.withColumn("before_", F.lag("digest").over(by))
    found = step.groupBy("entity", "id").agg(F.bool_or(F.col("before_").isNotNull() & (F.col("before_") != F.col("digest"))).alias("changed"), F.min("snap").alias("first"), F.count("*").alias("times"))
    found = found.withColumn("dropped", F.col("times") < last - F.col("first") + 1)
    kinds = F.array_compact(F.array(F.when(F.col("dropped"), F.lit("dropped")), F.when(F.col("changed"), F.lit("changed"))))
    return found.select(F.explode(kinds).alias("kind"), "entity", "id")


def gated_union(snapshots: list[Snapshot], parts: tuple[str, ...] = ("decks", "cards", "contains")) -> tuple[Snapshot, DataFrame]:
    """The union with changed ids pinned to their first record, and the flags. ``parts`` are
    written; the others stay plans."""
    flags = gate_flags(projections(stacked(snapshots)), len(snapshots) - 1)
    flags = materialised(flags, "flags")
    whole = union_snapshots(snapshots, flags.where("kind = 'changed'"))
    return replace(whole, **{x: materialised(getattr(whole, x), "union") for x in parts}), flags
