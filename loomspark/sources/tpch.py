"""The graph bound to star-schema tables: orders are decks, customers pilots, months events,
parts cards, line items memberships."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.operators.build import all_colours
from loomspark.plans.graph import Graph
from loomspark.session import table
from loomspark.sources.snapshot import colours_in


def entries(orders: DataFrame) -> DataFrame:
    """A row an order with its event, field and finish; one window over the event."""
    month = F.month("o_orderdate")
    rows = orders.select(F.col("o_orderkey").alias("deckId"), F.col("o_custkey").alias("pilot"), F.date_format("o_orderdate", "yyyy-MM").alias("event"), F.year("o_orderdate").cast("long").alias("year"), F.col("o_orderdate").alias("createdAt"), F.col("o_orderpriority").alias("tag"), F.col("o_totalprice").alias("price"), (F.col("o_orderstatus") != "P").alias("open"), month.alias("month"))
    field = Window.partitionBy("event")
    order = field.orderBy(F.desc("price"), "deckId")
    rows = rows.withColumn("fieldSize", F.count("*").over(field)).withColumn("seat", F.row_number().over(order))
    rows = rows.withColumn("isRanked", F.col("open") & ((F.col("month") % 4 != 0) | (F.col("seat") * 5 <= F.col("fieldSize"))))
    among = F.sum(F.col("isRanked").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    place = F.when(F.col("month") == 7, F.floor((among - 1) / 3) + 1).otherwise(among)
    rows = rows.withColumn("placement", F.when(F.col("isRanked"), place).cast("long"))
    return rows.withColumn("norm", F.when(F.col("fieldSize") > 1, (F.col("placement") - 1) / (F.col("fieldSize") - 1)))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    rows = entries(table(spark, sf_dir, "orders"))
    customer, part, lines = (table(spark, sf_dir, t) for t in ("customer", "part", "lineitem"))
    none = F.lit(None).cast("string")
    points = F.col("p_size").cast("long") % 8
    kind = F.when(F.col("p_size") % 6 == 0, "Lands").otherwise(F.col("p_type"))
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("deckId"), F.date_format("o_orderdate", "yyyy-MM").alias("event"), F.col("o_custkey").alias("pilot"), F.col("o_orderpriority").alias("tag"), F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").alias("month"))
    events = keys.groupBy("event", "year", "month").agg(F.count("*").alias("fieldSize"))
    return Graph(
        deck=rows.select("deckId", F.concat(F.lit("order "), F.col("deckId")).alias("deckName"), "placement", "norm", none.alias("placementImputed"), F.when(F.col("norm").isNull(), "none").alias("normImputed"), "createdAt"),
        card=part.select(F.col("p_partkey").alias("canon"), F.col("p_name").alias("name"), kind.alias("type"), points.alias("points"), F.when(F.col("p_size") % 5 == 0, points + 2).otherwise(F.lit(0)).cast("long").alias("pointsCompanion")),
        pilot=customer.select(F.col("c_custkey").alias("pilot"), F.col("c_name").alias("displayName")),
        event=events.select("event", F.when(F.col("month") == 7, "Teams").otherwise("Tournament").alias("eventType"), "fieldSize", F.when(F.col("month") == 5, "A").alias("fieldImputed")),
        archetype=keys.select("tag").distinct().select("tag", F.col("tag").alias("name")),
        piloted_by=keys.select("deckId", "pilot"),
        contains=lines.select(F.col("l_orderkey").alias("deckId"), F.col("l_partkey").alias("canon"), F.when(F.col("l_linestatus") == "O", "Main").otherwise("Side").alias("board")).distinct(),
        played_at=keys.select("deckId", "event"),
        has_archetype=keys.select("deckId", "tag", F.lit(100).cast("long").alias("weight"), F.lit(True).alias("isPrimary")),
        has_macro=keys.join(customer.select(F.col("c_custkey").alias("pilot"), F.col("c_mktsegment").alias("macro")), "pilot").select("deckId", "macro"),
        in_year=events.select("event", "year"),
        macro=keys.join(customer.select(F.col("c_custkey").alias("pilot"), F.col("c_mktsegment").alias("macro")), "pilot").select("macro").distinct(),
        colour=all_colours(spark), card_type=part.select(kind.alias("type")).distinct(), year=events.select("year").distinct(),
        deck_colour=keys.select("deckId", F.explode(colours_in(F.upper("tag"))).alias("colour")),
        card_colour=part.select(F.col("p_partkey").alias("canon"), F.explode(colours_in(F.upper("p_name"))).alias("colour")),
        has_type=part.select(F.col("p_partkey").alias("canon"), kind.alias("type")),
    )


#: The same binding for DuckDB; every oracle starts with it.
SQL = """
WITH e0 AS (SELECT o_orderkey AS deckId, o_custkey AS pilot, strftime(o_orderdate, '%Y-%m') AS event, CAST(year(o_orderdate) AS BIGINT) AS year, o_orderdate AS createdAt, o_orderpriority AS tag,
  month(o_orderdate) AS mon, o_orderstatus <> 'P' AS open_, count(*) OVER (PARTITION BY strftime(o_orderdate, '%Y-%m')) AS fieldSize,
  row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_totalprice DESC, o_orderkey) AS seat FROM orders),
e1 AS (SELECT *, open_ AND (mon % 4 <> 0 OR seat * 5 <= fieldSize) AS rk FROM e0),
e2 AS (SELECT *, sum(CASE WHEN rk THEN 1 ELSE 0 END) OVER (PARTITION BY event ORDER BY seat ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS among FROM e1),
e3 AS (SELECT *, CASE WHEN rk THEN CAST(CASE WHEN mon = 7 THEN (among - 1) // 3 + 1 ELSE among END AS BIGINT) END AS placement FROM e2),
d AS (SELECT *, CASE WHEN fieldSize > 1 THEN (placement - 1) / CAST(fieldSize - 1 AS DOUBLE) END AS norm, CASE WHEN mon = 7 THEN 'Teams' ELSE 'Tournament' END AS eventType, CASE WHEN mon = 5 THEN 'A' END AS fieldImputed FROM e3),
r AS (SELECT * FROM d WHERE norm IS NOT NULL),
ev AS (SELECT event, year, fieldSize, eventType, fieldImputed, min(createdAt) AS date FROM d GROUP BY ALL),
ct AS (SELECT DISTINCT l_orderkey AS deckId, l_partkey AS canon, CASE WHEN l_linestatus = 'O' THEN 'Main' ELSE 'Side' END AS board FROM lineitem),
c AS (SELECT p_partkey AS canon, p_name AS name, CASE WHEN p_size % 6 = 0 THEN 'Lands' ELSE p_type END AS type, CAST(p_size % 8 AS BIGINT) AS points, CAST(CASE WHEN p_size % 5 = 0 THEN p_size % 8 + 2 ELSE 0 END AS BIGINT) AS pc FROM part),
hm AS (SELECT deckId, c_mktsegment AS macro FROM d JOIN customer ON c_custkey = pilot),
slots AS (SELECT event, count(*) AS n, count(norm) AS ranked, max(placement) AS deep, count(DISTINCT placement) AS places FROM d GROUP BY event),
cut AS (SELECT event FROM ev JOIN slots USING (event) WHERE ranked > 0 AND CASE WHEN eventType = 'Teams' THEN places ELSE ranked END < 0.5 * fieldSize),
bound AS (SELECT event, greatest(coalesce(deep, 0), CASE WHEN eventType = 'Teams' THEN places ELSE ranked END) AS slot, fieldSize FROM ev JOIN slots USING (event)
  WHERE event NOT IN (SELECT event FROM cut) AND ranked < n AND fieldSize >= 2),
tb AS (SELECT event, slot / CAST(fieldSize - 1 AS DOUBLE) AS bound FROM bound WHERE slot >= 1 AND slot < fieldSize),
pa AS (SELECT pilot FROM d GROUP BY pilot ORDER BY count(*) DESC, pilot LIMIT 1),
pb AS (SELECT y.pilot FROM d x JOIN d y USING (event) WHERE x.pilot = (SELECT pilot FROM pa) AND y.pilot <> x.pilot GROUP BY y.pilot ORDER BY count(DISTINCT event) DESC, y.pilot LIMIT 1),
k1 AS (SELECT canon FROM ct GROUP BY canon ORDER BY count(DISTINCT deckId) DESC, canon LIMIT 1),
k2 AS (SELECT y.canon FROM ct x JOIN ct y USING (deckId) WHERE x.canon = (SELECT canon FROM k1) AND y.canon <> x.canon GROUP BY y.canon ORDER BY count(DISTINCT deckId) DESC, y.canon LIMIT 1)
"""
