"""Gate, union, build passes and display figures on three versions of the orders, and their SQL."""

from __future__ import annotations

from dataclasses import fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import display
from loomspark.operators import build, ingest, series
from loomspark.plans.series_queries import SQL as SERIES_SQL
from loomspark.plans.series_queries import TAG_A, TAG_B, YEAR, busiest_pilots, on
from loomspark.session import materialised, table
from loomspark.sources import tpch
from loomspark.sources.snapshot import Snapshot


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three snapshots: one lacks every tenth order, one every seventh and changes every eleventh."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    status = F.when((F.col("snap") == 1) & (key % 11 == 0), "X").otherwise(F.col("o_orderstatus"))
    gone = ((F.col("snap") == 0) & (key % 10 == 0)) | ((F.col("snap") == 1) & (key % 7 == 0))
    parts = [orders.withColumn("snap", F.lit(k)) for k in range(3)]
    return reduce(DataFrame.unionByName, parts).where(~gone).select(key.alias("deckId"), "snap", F.col("o_custkey").alias("pilot"), status.alias("status"), F.col("o_totalprice").alias("price"))


def _digests(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit("deck").alias("entity"), F.col("deckId").cast("string").alias("id"), "snap", F.sha2(F.to_json(F.struct("pilot", "status")), 256).alias("digest"))


def gate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.gate_flags(_digests(versions(spark, sf_dir)), 2)


def snapshot_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest record, or the first for ids that changed."""
    rows = versions(spark, sf_dir)
    pins = ingest.gate_flags(_digests(rows), 2).where("kind = 'changed'").select(F.col("id").cast("long").alias("id"))
    return ingest._pick(rows, "deckId", pins).select("deckId", "snap", "pilot", "status")


def snapshots(spark: SparkSession, sf_dir: str, keep: bool = False) -> list[Snapshot]:
    """The three versions as snapshots; ``keep`` writes the lists that they share. Decks of every thirteenth order lose their list in the
    last one, and every seventeenth card has another type in the middle one."""
    rows, lines, part = versions(spark, sf_dir), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    lists = lines.select(F.col("l_orderkey").alias("deckId"), F.col("l_partkey").alias("canon"), F.when(F.col("l_linestatus") == "O", "Main").otherwise("Side").alias("board")).distinct()
    lists = materialised(lists, "lists") if keep else lists
    out = []
    for k in range(3):
        mine = rows.where(F.col("snap") == k)
        decks = mine.select("deckId", F.col("pilot"), F.concat(F.lit("E"), F.col("status")).alias("event"), (F.col("deckId") % 9).alias("placement"), F.lit("2024-01-01").alias("createdAt"), F.col("deckId").alias("deck_ord"))
        held = lists if k < 2 else lists.where(F.col("deckId") % 13 != 0)
        cards = part.select(F.col("p_partkey").alias("canon"), F.col("p_name").alias("name"), F.when((F.lit(k) == 1) & (F.col("p_partkey") % 17 == 0), "Odd").otherwise(F.col("p_type")).alias("type"))
        out.append(Snapshot(decks, cards, held))
    return out


def projection_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over real projections: a deck's facts and list, a card's name and type."""
    held = snapshots(spark, sf_dir, keep=True)
    rows = ingest.projections(ingest.stacked(held))
    return ingest.gate_flags(rows.withColumn("id", F.col("id").cast("string")), len(held) - 1)


def _united(spark: SparkSession, sf_dir: str, part: str) -> Snapshot:
    return ingest.gated_union(snapshots(spark, sf_dir, keep=True), (part,))[0]


def projection_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _united(spark, sf_dir, "decks").decks.select("deckId", "pilot", "event", F.col("deck_ord.snap").alias("first_seen"))


def projection_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _united(spark, sf_dir, "contains").contains.groupBy("deckId").agg(F.count("*").alias("cards"), F.sum("canon").alias("canons"))


def deck_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(deckId, first_seen): since which snapshot a deck is known."""
    return ingest.first_seen(ingest.stacked(snapshots(spark, sf_dir)).decks.withColumnRenamed("snap", "stamp"))


def _raw_decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decks as a source would have them: some norms and sizes missing, some sizes too small."""
    rows = tpch.entries(table(spark, sf_dir, "orders"))
    size = F.when(F.col("month") % 3 == 0, None).when(F.col("month") % 3 == 1, F.col("fieldSize") - 20).otherwise(8).cast("long")
    norm = F.when(F.col("deckId") % 2 == 0, F.col("norm"))
    return rows.select("deckId", "pilot", "event", F.col("deckId").alias("deck_ord"), F.lit("Tournament").alias("eventType"), F.col("event").alias("eventId"), size.alias("eventSize"), "placement", norm.alias("placementNorm"), F.lit(None).cast("string").alias("normImputed"), "createdAt")


def corrected_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    decks = _raw_decks(spark, sf_dir)
    return build.event_fields(decks, decks.select("deckId", "pilot")).select("event", "fieldSize", "fieldImputed")


def norm_mint(spark: SparkSession, sf_dir: str) -> DataFrame:
    decks = _raw_decks(spark, sf_dir)
    return build.normalised(decks, build.event_fields(decks, decks.select("deckId", "pilot"))).select("deckId", "placementNorm", "normImputed")


def imputed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = build.imputed_values(norm_mint(spark, sf_dir), "deckId", "normImputed")
    return rows.select("rule", "n", F.element_at("keys", 1).alias("first_key"), F.element_at("keys", -1).alias("last_key"))


def event_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.event_years(tpch.entries(table(spark, sf_dir, "orders")).select("event", "createdAt"))


def graph_counts(g) -> DataFrame:
    """(table, n) of every node and edge table."""
    return reduce(DataFrame.unionByName, [getattr(g, f.name).agg(F.count("*").alias("n")).select(F.lit(f.name).alias("table"), "n") for f in fields(g)])


QUERIES = {
    "gate_flags": gate_flags, "snapshot_union": snapshot_union, "corrected_field": corrected_field, "norm_mint": norm_mint, "imputed_values": imputed_values, "event_years": event_years,
    "label_distinguish": on(lambda g: display.distinct_labels(g.card.select("canon", "name"), "name", "canon")),
    "landscape_top": on(lambda g: display.landscape_top(series.archetype_landscape(g, YEAR), 3).select("tag", "n", "mean_norm")),
    "landscape_claims": on(lambda g: display.landscape_claims(series.archetype_landscape(g, YEAR))),
    "career_standing": on(lambda g: display.career_standing(series.pilot_performance(g, busiest_pilots(g)[0]))),
    "timeline_headline": on(lambda g: display.timeline_headline(series.archetype_timeline(g, TAG_A, TAG_B))),
    "line_crossings": on(lambda g: display.line_crossings(series.archetype_timeline(g, TAG_A, TAG_B)).select("event", "from", "to", "crosses")),
    "latest_deck_year": on(lambda g: series.latest_deck_year(series.meta_share(g))),
    "graph_counts": on(graph_counts), "deck_colours": on(lambda g: g.deck_colour), "card_colours": on(lambda g: g.card_colour),
    "projection_union": projection_union, "projection_lists": projection_lists, "projection_flags": projection_flags, "deck_history": deck_history,
}

_V = "WITH v AS (SELECT o_orderkey AS deckId, snap, o_custkey AS pilot, CASE WHEN snap = 1 AND o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders, range(3) AS g(snap) WHERE NOT (snap = 0 AND o_orderkey % 10 = 0) AND NOT (snap = 1 AND o_orderkey % 7 = 0)), l AS (SELECT *, lag(pilot || '/' || status) OVER (PARTITION BY deckId ORDER BY snap) AS b FROM v), f AS (SELECT deckId, bool_or(b IS NOT NULL AND b <> pilot || '/' || status) AS changed, min(snap) AS first, max(snap) AS last, count(*) AS n FROM l GROUP BY deckId)"
_E = ", z AS (SELECT deckId, pilot, event, placement, CASE WHEN deckId % 2 = 0 THEN norm END AS pn, CAST(CASE WHEN mon % 3 = 0 THEN NULL WHEN mon % 3 = 1 THEN fieldSize - 20 ELSE 8 END AS BIGINT) AS size FROM d), y AS (SELECT event, max(size) AS size, count(DISTINCT pilot) AS p, coalesce(max(placement), 0) AS m FROM z GROUP BY event), x AS (SELECT event, CASE WHEN size IS NULL THEN greatest(p, m, 24) WHEN p > size OR m > size THEN greatest(p, m, 24) WHEN size <= 8 THEN greatest(p, 24) ELSE size END AS fs, CASE WHEN size IS NULL THEN 'C' WHEN p > size OR m > size THEN 'A' WHEN size <= 8 THEN 'B' END AS fi FROM y), w AS (SELECT *, placement IS NOT NULL AND fs > 1 AND placement BETWEEN 1 AND fs AS ok FROM z JOIN x USING (event)), nm AS (SELECT deckId, CASE WHEN pn IS NOT NULL AND (fi IS NULL OR NOT ok) THEN pn WHEN ok THEN (placement - 1) / CAST(fs - 1 AS DOUBLE) END AS norm2, CASE WHEN pn IS NOT NULL AND fi IS NOT NULL AND ok THEN 'rescaled' WHEN pn IS NOT NULL THEN NULL WHEN ok THEN 'minted' ELSE 'none' END AS rule FROM w)"
_COLOURS = ", col AS (SELECT unnest(['W', 'U', 'B', 'R', 'G']) AS colour), dcol AS (SELECT deckId, colour FROM d, col WHERE contains(upper(tag), colour)), ccol AS (SELECT canon, colour FROM c, col WHERE contains(upper(name), colour))"
#: lists of (snap, deck): empty ones where the last snapshot lost them; a deck changes where status or list does
_U = _V.replace("WITH v AS", "WITH ct AS (SELECT DISTINCT l_orderkey AS deckId, l_partkey AS canon, CASE WHEN l_linestatus = 'O' THEN 'Main' ELSE 'Side' END AS board FROM lineitem), hl AS (SELECT DISTINCT deckId FROM ct), v AS").replace("pilot || '/' || status)", "pilot || '/' || status || '/' || (snap = 2 AND deckId % 13 = 0 AND deckId IN (SELECT deckId FROM hl)))").replace("<> pilot || '/' || status)", "<> pilot || '/' || status || '/' || (snap = 2 AND deckId % 13 = 0 AND deckId IN (SELECT deckId FROM hl)))")
_U += ", w AS (SELECT v.*, first FROM v JOIN f ON v.deckId = f.deckId AND v.snap = CASE WHEN changed THEN first ELSE last END)"
_PAIR = "SELECT * FROM (" + SERIES_SQL["archetype_timeline_pair"] + ")"

SQL = {
    "gate_flags": _V + " SELECT 'dropped' AS kind, 'deck' AS entity, CAST(deckId AS VARCHAR) AS id FROM f WHERE n < 3 - first UNION ALL SELECT 'changed', 'deck', CAST(deckId AS VARCHAR) FROM f WHERE changed",
    "snapshot_union": _V + " SELECT v.deckId, v.snap, v.pilot, v.status FROM v JOIN f ON v.deckId = f.deckId AND v.snap = CASE WHEN changed THEN first ELSE last END",
    "projection_flags": _U + " SELECT 'dropped' AS kind, 'deck' AS entity, CAST(deckId AS VARCHAR) AS id FROM f WHERE n < 3 - first UNION ALL SELECT 'changed', 'deck', CAST(deckId AS VARCHAR) FROM f WHERE changed UNION ALL SELECT 'changed', 'card', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 17 = 0 AND p_type <> 'Odd'",
    "projection_union": _U + " SELECT deckId, pilot, 'E' || status AS event, CAST(first AS INTEGER) AS first_seen FROM w",
    "projection_lists": _U + " SELECT deckId, count(*) AS cards, CAST(sum(canon) AS BIGINT) AS canons FROM w JOIN ct USING (deckId) WHERE NOT (snap = 2 AND deckId % 13 = 0) GROUP BY deckId",
    "deck_history": _V + " SELECT deckId, CAST(first AS INTEGER) AS first_seen FROM f",
    "corrected_field": tpch.SQL + _E + " SELECT event, CAST(fs AS BIGINT) AS fieldSize, fi AS fieldImputed FROM x",
    "norm_mint": tpch.SQL + _E + " SELECT deckId, norm2 AS placementNorm, rule AS normImputed FROM nm",
    "imputed_values": tpch.SQL + _E + " SELECT rule, count(*) AS n, min(deckId) AS first_key, max(deckId) AS last_key FROM nm WHERE rule IS NOT NULL GROUP BY rule",
    "event_years": tpch.SQL + " SELECT event, year FROM ev",
    "label_distinguish": tpch.SQL + " SELECT canon, name, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || ' (' || canon || ')' ELSE name END AS shown FROM c",
    "landscape_top": "SELECT tag, n, mean_norm FROM (SELECT * FROM (" + SERIES_SQL["landscape"] + ") ORDER BY n DESC, tag LIMIT 3) WHERE mean_norm IS NOT NULL",
    "landscape_claims": "SELECT count(*) FILTER (mean_norm < 0.5) AS above, count(*) FILTER (mean_high < 0.5) AS settled FROM (" + SERIES_SQL["landscape"] + ")",
    "career_standing": "SELECT CAST(sum(events) AS BIGINT) AS events, sum((1 - mean_norm) * events) / sum(events) AS standing FROM (" + SERIES_SQL["pilot_performance"] + ") WHERE mean_norm IS NOT NULL",
    "timeline_headline": "SELECT count(*) AS compared, count(*) FILTER (a < b) AS a_leads, count(*) FILTER (b < a) AS b_leads, abs(greatest(count(*) FILTER (a < b), count(*) FILTER (b < a)) - count(*) / 2.0) - 0.5 > 1.645 * sqrt(count(*)) / 2 AS beyond_chance FROM (SELECT coalesce(mean_norm_a, CASE WHEN mean_norm_b IS NOT NULL THEN bound_a END) AS a, coalesce(mean_norm_b, CASE WHEN mean_norm_a IS NOT NULL THEN bound_b END) AS b FROM (" + _PAIR + ")) WHERE a IS NOT NULL AND b IS NOT NULL",
    "line_crossings": "SELECT event, \"from\", \"to\", gf * g < 0 AS crosses FROM (SELECT event, date AS \"to\", lag(date) OVER (ORDER BY date, event) AS \"from\", lag(g) OVER (ORDER BY date, event) AS gf, g FROM (SELECT event, date, mean_norm_a - mean_norm_b AS g FROM (" + _PAIR + ")) WHERE g IS NOT NULL) WHERE \"from\" IS NOT NULL",
    "latest_deck_year": tpch.SQL + " SELECT max(year) AS year FROM ev",
    "deck_colours": tpch.SQL + _COLOURS + " SELECT deckId, colour FROM dcol",
    "card_colours": tpch.SQL + _COLOURS + " SELECT canon, colour FROM ccol",
    "graph_counts": tpch.SQL + _COLOURS + " SELECT * FROM (VALUES ('deck', (SELECT count(*) FROM d)), ('card', (SELECT count(*) FROM c)), ('pilot', (SELECT count(*) FROM customer)), ('event', (SELECT count(*) FROM ev)), ('archetype', (SELECT count(DISTINCT tag) FROM d)), ('piloted_by', (SELECT count(*) FROM d)), ('contains', (SELECT count(*) FROM ct)), ('played_at', (SELECT count(*) FROM d)), ('has_archetype', (SELECT count(*) FROM d)), ('has_macro', (SELECT count(*) FROM hm)), ('in_year', (SELECT count(*) FROM ev)), ('macro', (SELECT count(DISTINCT macro) FROM hm)), ('colour', 5), ('card_type', (SELECT count(DISTINCT type) FROM c)), ('year', (SELECT count(DISTINCT year) FROM ev)), ('deck_colour', (SELECT count(*) FROM dcol)), ('card_colour', (SELECT count(*) FROM ccol)), ('has_type', (SELECT count(*) FROM c))) AS t(\"table\", n)",
}
