"""Leaderboard of major finishes: shrunken scores, ranks as of dates, bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark import constants as c
from loomspark.operators import facts
from loomspark.operators.resampling import rank_bounds
from loomspark.plans.graph import Graph, require


def majors(g: Graph) -> DataFrame:
    """Events of over 64 entries, brackets apart."""
    return g.event.where(F.col("fieldSize") > c.MAJOR_FIELD_SIZE).select("event").join(facts.cut_only_events(g), "event", "left_anti")


def major_finishes(g: Graph) -> DataFrame:
    """(pilot, event, date, score): one minus the mean finish at each major."""
    rows = g.ranked.join(g.piloted_by, "deckId").join(g.played_at, "deckId").join(majors(g), "event")
    return rows.groupBy("pilot", "event").agg((1 - F.avg("norm")).alias("score")).join(facts.event_dates(g), "event").select("pilot", "event", "date", "score")


def anchor(g: Graph) -> DataFrame:
    """One row: the date of the newest event of all."""
    return facts.event_dates(g).agg(F.max("date").alias("anchor"))


def contenders(finishes: DataFrame, newest: DataFrame) -> DataFrame:
    """Finishes of pilots with five majors, two of them in the year before the newest event."""
    since = F.col("anchor") - F.make_ym_interval(F.lit(0), F.lit(c.RACE_RECENCY_MONTHS))
    dated = finishes.crossJoin(F.broadcast(newest))
    held = dated.groupBy("pilot").agg(F.count("*").alias("majors"), F.count(F.when(F.col("date") > since, 1)).alias("recent"))
    held = held.where((F.col("majors") >= c.MIN_CAREER_MAJORS) & (F.col("recent") >= c.MIN_RECENT_MAJORS))
    return finishes.join(held.select("pilot"), "pilot", "left_semi")


def exact(value: Column) -> Column:
    """A sum that does not depend on the order of rows."""
    return F.sum(value.cast("decimal(38,20)")).cast("double")


def shrinkage(finishes: DataFrame) -> DataFrame:
    """One row (mu, k): grand mean and strength of the pull towards it; k null pulls all the way.
    Sums over all finishes are exact: ``between`` is a small difference, and noise in it would move every score."""
    groups = finishes.groupBy("pilot").agg(F.count("*").alias("n"), F.avg("score").alias("m"), F.var_samp("score").alias("v"), F.sum(F.col("score").cast("decimal(38,20)")).alias("s"))
    total = groups.agg(F.sum("n").alias("N"), F.count("*").alias("G"), F.sum("s").cast("double").alias("S"), exact(F.col("v") * (F.col("n") - 1)).alias("ssw"), F.sum(F.col("n") * F.col("n")).alias("nn")).withColumn("mu", F.col("S") / F.col("N"))
    off = F.col("m") - F.col("mu")
    apart = groups.select("n", "m").crossJoin(F.broadcast(total.select("mu"))).agg(exact(F.col("n") * off * off).alias("ssb"))
    total = total.crossJoin(F.broadcast(apart)).withColumn("within", F.col("ssw") / (F.col("N") - F.col("G"))).withColumn("across", F.col("ssb") / (F.col("G") - 1))
    total = total.withColumn("typical", (F.col("N") - F.col("nn") / F.col("N")) / (F.col("G") - 1)).withColumn("between", (F.col("across") - F.col("within")) / F.col("typical"))
    return total.select("mu", F.when(F.col("between") > 0, F.col("within") / F.col("between")).alias("k"))


def shrunk(finishes: DataFrame, pull: DataFrame, *keys: str) -> DataFrame:
    """Score of each pilot: its finishes and k times the grand mean, averaged."""
    rows = finishes.groupBy("pilot", *keys).agg(F.count("*").alias("majors"), exact(F.col("score")).alias("total")).crossJoin(F.broadcast(pull))
    score = F.when(F.col("k").isNull(), F.col("mu")).otherwise((F.col("total") + F.col("k") * F.col("mu")) / (F.col("majors") + F.col("k")))
    return rows.withColumn("score", score).drop("total", "mu", "k")


def rounded(score: Column) -> Column:
    """To 12 digits, as SQL does it: by the product, not by the decimal digits."""
    return F.round(score * 1e12) / 1e12


def scores(g: Graph) -> DataFrame:
    """(pilot, rank, score, majors, major_events); equal scores share the better rank. Scores
    are rounded to 12 digits first: float noise must not split a tie."""
    finishes = contenders(major_finishes(g), anchor(g))
    require(finishes.select("pilot").distinct(), c.MIN_RACE_CONTENDERS, "contenders")
    rows = shrunk(finishes, shrinkage(finishes)).withColumn("score", rounded(F.col("score")))
    rows = rows.crossJoin(F.broadcast(majors(g).agg(F.count("*").alias("major_events"))))
    # contenders only: a ranking needs one order
    return rows.withColumn("rank", F.rank().over(Window.orderBy(F.desc("score"))).cast("long")).select("pilot", "rank", "score", "majors", "major_events")


def as_of(g: Graph) -> DataFrame:
    """Scores and ranks at five dates, half a year apart and the last the newest event's; with
    the career's own mean and pull, from two majors up."""
    finishes, newest = contenders(major_finishes(g), anchor(g)), anchor(g)
    steps = newest.select(F.explode(F.array(*[F.lit(c.RACE_STEP_MONTHS * k) for k in range(c.RACE_POINTS)])).alias("back"), "anchor")
    dates = steps.select((F.col("anchor") - F.expr("make_ym_interval(0, back)")).alias("as_of"))
    known = finishes.join(F.broadcast(dates), F.col("date") <= F.col("as_of"))  # five rows
    rows = shrunk(known, shrinkage(finishes), "as_of").where(F.col("majors") >= c.MIN_SCORED_MAJORS).withColumn("as_of_score", rounded(F.col("score")))
    by = Window.partitionBy("as_of")
    return rows.select("pilot", "as_of", "as_of_score", F.col("majors").alias("as_of_majors"), F.rank().over(by.orderBy(F.desc("as_of_score"))).cast("long").alias("as_of_rank"), F.count("*").over(by).alias("as_of_contenders"))


def rank_intervals(finishes: DataFrame, resamples: int = c.RACE_RESAMPLES, seed: int = c.RACE_SEED) -> DataFrame:
    """(pilot, rank_low, rank_high): each contender's finishes redrawn, everything refitted. The
    draws share one seeded stream in the order of pilots."""
    tail = (1 - c.RACE_INTERVAL) / 2
    return rank_bounds(finishes, resamples, seed, int(tail * resamples), min(resamples - 1, resamples - 1 - int(tail * resamples)))


def leaderboard(g: Graph) -> DataFrame:
    """Everything together: a row a contender and date."""
    finishes = contenders(major_finishes(g), anchor(g))
    return scores(g).join(rank_intervals(finishes), "pilot").join(as_of(g), "pilot", "left")
