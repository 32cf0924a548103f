"""Figures that views derive from results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.facts import beats_a_coin, drawn


def distinct_labels(rows: DataFrame, label: str, value: str) -> DataFrame:
    """Labels that occur more than once get their value in brackets."""
    many = F.count("*").over(Window.partitionBy(label)) > 1
    return rows.withColumn("shown", F.when(many, F.concat(F.col(label), F.lit(" ("), F.col(value).cast("string"), F.lit(")"))).otherwise(F.col(label)))


def landscape_top(rows: DataFrame, most: int = 25) -> DataFrame:
    """The most played archetypes, then those of them with a mean."""
    return rows.orderBy(F.desc("n"), "tag").limit(most).where("mean_norm is not null")


def landscape_claims(rows: DataFrame) -> DataFrame:
    """One row: archetypes above the middle, and those whose whole interval is."""
    return rows.agg(F.count_if(F.col("mean_norm") < 0.5).alias("above"), F.count_if(F.col("mean_high") < 0.5).alias("settled"))


def career_standing(years: DataFrame) -> DataFrame:
    """One row: event-weighted mean of one minus the mean finish over years that have one."""
    held = years.where("mean_norm is not null")
    return held.agg(F.sum("events").alias("events"), (F.sum((1 - F.col("mean_norm")) * F.col("events")) / F.nullif(F.sum("events"), F.lit(0))).alias("standing"))


def timeline_headline(rows: DataFrame, left: str = "mean_norm_a", right: str = "mean_norm_b") -> DataFrame:
    """One row: events that either side leads, of those that compare, and whether chance would do."""
    a, b = drawn(F.col(left), F.col(right), F.col("bound_a")), drawn(F.col(right), F.col(left), F.col("bound_b"))
    held = rows.withColumn("a_", a).withColumn("b_", b).where("a_ is not null and b_ is not null")
    out = held.agg(F.count("*").alias("compared"), F.count_if(F.col("a_") < F.col("b_")).alias("a_leads"), F.count_if(F.col("b_") < F.col("a_")).alias("b_leads"))
    return out.withColumn("beyond_chance", beats_a_coin(F.greatest("a_leads", "b_leads"), F.col("compared")))


def line_crossings(rows: DataFrame, date: str = "date", a: str = "mean_norm_a", b: str = "mean_norm_b") -> DataFrame:
    """Stretches between neighbouring points and whether the lines cross in them."""
    by = Window.orderBy(date, "event")  # the points of one picture
    gap = F.col(a) - F.col(b)
    return rows.where(gap.isNotNull()).select("event", F.col(date).alias("to"), F.lag(date).over(by).alias("from"), F.lag(gap).over(by).alias("gap_from"), gap.alias("gap_to")).where(F.col("from").isNotNull()).withColumn("crosses", F.col("gap_from") * F.col("gap_to") < 0)


def leaderboard_table(rows: DataFrame, most: int = 50) -> DataFrame:
    """Last row of each pilot, best first."""
    last = rows.groupBy("pilot").agg(F.max_by(F.struct("rank", "score", "majors", "rank_low", "rank_high"), F.coalesce("as_of", F.lit("1970-01-01").cast("timestamp"))).alias("r"))
    return last.select("pilot", "r.*").orderBy("rank", "pilot").limit(most)


def score_text(c: Column) -> Column:
    return F.format_string("%.3f", c)


def marker_size(events: Column) -> Column:
    return F.least(F.lit(28.0), F.greatest(F.lit(11.0), 8 + 3.2 * F.sqrt(events)))
