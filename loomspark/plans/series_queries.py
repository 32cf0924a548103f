"""Series queries on the star-schema binding, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import facts, leaderboard, series
from loomspark.plans.graph import Graph
from loomspark.sources import tpch

YEAR, TAG_A, TAG_B = 1997, "1-URGENT", "2-HIGH"


def busiest_pilots(g: Graph) -> tuple:
    """The pilot with most decks, and who shares most events with it; two rows reach the driver."""
    a = g.piloted_by.groupBy("pilot").count().orderBy(F.desc("count"), "pilot").first()["pilot"]
    rows = g.piloted_by.join(g.played_at, "deckId")
    mine = rows.where(F.col("pilot") == a).select("event").distinct()
    b = rows.where(F.col("pilot") != a).join(mine, "event").groupBy("pilot").agg(F.countDistinct("event").alias("n")).orderBy(F.desc("n"), "pilot").first()["pilot"]
    return a, b


def busiest_cards(g: Graph) -> tuple:
    a = g.contains.groupBy("canon").agg(F.countDistinct("deckId").alias("n")).orderBy(F.desc("n"), "canon").first()["canon"]
    mine = g.contains.where(F.col("canon") == a).select("deckId").distinct()
    b = g.contains.where(F.col("canon") != a).join(mine, "deckId").groupBy("canon").agg(F.countDistinct("deckId").alias("n")).orderBy(F.desc("n"), "canon").first()["canon"]
    return a, b


def on(operator):
    return lambda spark, sf_dir: operator(tpch.graph(spark, sf_dir))


def _h2h(g: Graph) -> DataFrame:
    return series.head_to_head(g, *busiest_pilots(g))


QUERIES = {
    "meta_share": on(series.meta_share),
    "year_totals": on(series.year_totals),
    "year_shape": on(lambda g: series.year_shape(g, YEAR)),
    "card_adoption": on(lambda g: series.card_adoption(g, busiest_cards(g)[0])),
    "card_adoption_board": on(lambda g: series.card_adoption(g, busiest_cards(g)[0], "Main")),
    "cut_only_events": on(facts.cut_only_events),
    "tail_bounds": on(facts.tail_bounds),
    "event_dates": on(facts.event_dates),
    "within_pilot_sd": on(lambda g: facts.within_pilot_sd(g, facts.cut_only_events(g))),
    "pilot_performance": on(lambda g: series.pilot_performance(g, busiest_pilots(g)[0])),
    "head_to_head": on(_h2h),
    "landscape": on(lambda g: series.archetype_landscape(g, YEAR)),
    "archetype_timeline": on(lambda g: series.archetype_timeline(g, TAG_A)),
    "archetype_timeline_pair": on(lambda g: series.archetype_timeline(g, TAG_A, TAG_B)),
    "pilots_with_history": on(series.pilots_with_history),
    "archetypes_with_history": on(series.archetypes_with_history),
    "major_finishes": on(leaderboard.major_finishes),
    "shrinkage": on(lambda g: leaderboard.shrinkage(leaderboard.contenders(leaderboard.major_finishes(g), leaderboard.anchor(g)))),
    "leaderboard_scores": on(leaderboard.scores),
    "leaderboard_asof": on(leaderboard.as_of),
    "leaderboard_intervals": on(lambda g: leaderboard.rank_intervals(leaderboard.contenders(leaderboard.major_finishes(g), leaderboard.anchor(g)))),
    "share_cut": on(lambda g: series.share_cut(series.meta_share(g), 0.5)),
}

_LEAST = "1.645"
_FINISHES = ", mj AS (SELECT event FROM ev WHERE fieldSize > 64 AND event NOT IN (SELECT event FROM cut)), mf AS (SELECT pilot, event, ev.date, 1 - avg(norm) AS score FROM r JOIN ev USING (event) WHERE event IN (SELECT event FROM mj) GROUP BY pilot, event, ev.date), an AS (SELECT max(date) AS anchor FROM ev)"
_CONTEND = _FINISHES + ", ok AS (SELECT pilot FROM mf, an GROUP BY pilot HAVING count(*) >= 5 AND count(*) FILTER (date > anchor - INTERVAL 12 MONTH) >= 2), cf AS (SELECT * FROM mf WHERE pilot IN (SELECT pilot FROM ok))"
_SHRINK = _CONTEND + """, gr AS (SELECT pilot, count(*) AS n, avg(score) AS m, sum(score) AS s, list(score) AS xs FROM cf GROUP BY pilot),
t1 AS (SELECT sum(n) AS nn, count(*) AS g, sum(s) / sum(n) AS mu, sum(n * n) AS n2 FROM gr),
t2 AS (SELECT (SELECT sum((score - m) * (score - m)) FROM cf JOIN gr USING (pilot)) / (nn - g) AS within_, (SELECT sum(n * (m - mu) * (m - mu)) FROM gr) / (g - 1) AS across_, (nn - n2 / nn) / (g - 1) AS typical, mu FROM t1),
sk AS (SELECT mu, CASE WHEN (across_ - within_) / typical > 0 THEN within_ / ((across_ - within_) / typical) END AS k FROM t2)"""
_SCORE = "CASE WHEN k IS NULL THEN mu ELSE (sum(score) + k * mu) / (count(*) + k) END"
_SD = "CASE WHEN sum(n - 1) > 0 THEN sqrt(sum(v * (n - 1)) / sum(n - 1)) END"


def _interval(mean: str, n: str, sd: str) -> str:
    return f"CASE WHEN {sd} IS NOT NULL AND {n} >= 1 AND {mean} IS NOT NULL THEN greatest(0.0, {mean} - {_LEAST} * {sd} / sqrt({n})) END AS mean_low, CASE WHEN {sd} IS NOT NULL AND {n} >= 1 AND {mean} IS NOT NULL THEN least(1.0, {mean} + {_LEAST} * {sd} / sqrt({n})) END AS mean_high"


def _adoption(board: str) -> str:
    return f"SELECT year, coalesce(n, 0) AS count, coalesce(n, 0) / CAST(t AS DOUBLE) AS share, t AS year_total FROM (SELECT year, count(*) AS t FROM d GROUP BY year) LEFT JOIN (SELECT year, count(DISTINCT deckId) AS n FROM d JOIN ct USING (deckId) WHERE canon = (SELECT canon FROM k1) {board} GROUP BY year) USING (year)"


_SIDE = "SELECT event, placement AS placement_{0}, norm AS norm_{0}, CAST(NULL AS VARCHAR) AS \"placementImputed_{0}\", CASE WHEN norm IS NULL THEN 'none' END AS \"normImputed_{0}\" FROM d WHERE pilot = (SELECT pilot FROM p{0})"
_AE = "(SELECT event, avg(norm) AS mean_norm_{0}, count(norm) AS decks_{0} FROM d WHERE tag = '{1}' AND event NOT IN (SELECT event FROM cut) GROUP BY event)"

SQL = {k: tpch.SQL + v for k, v in {
    "meta_share": ", y AS (SELECT year, count(*) AS t FROM d GROUP BY year) SELECT tag, tag AS archetype, y.year, coalesce(n, 0) AS n, coalesce(n, 0) / CAST(t AS DOUBLE) AS share, t AS year_total FROM (SELECT DISTINCT tag FROM d) CROSS JOIN y LEFT JOIN (SELECT tag, year, count(*) AS n FROM d GROUP BY tag, year) USING (tag, year)",
    "year_totals": "SELECT year, count(DISTINCT deckId) AS year_total FROM d GROUP BY year",
    "year_shape": f"SELECT count(DISTINCT deckId) AS decks, count(DISTINCT event) AS events FROM d WHERE year = {YEAR}",
    "card_adoption": _adoption(""),
    "card_adoption_board": _adoption("AND board = 'Main'"),
    "cut_only_events": "SELECT event FROM cut",
    "tail_bounds": "SELECT event, bound FROM tb",
    "event_dates": "SELECT event, date FROM ev",
    "within_pilot_sd": f"SELECT {_SD} AS sd FROM (SELECT pilot, count(*) AS n, var_samp(norm) AS v FROM r WHERE event NOT IN (SELECT event FROM cut) GROUP BY pilot HAVING count(*) >= 5)",
    "pilot_performance": f", sd AS (SELECT {_SD} AS sd FROM (SELECT pilot, count(*) AS n, var_samp(norm) AS v FROM r WHERE event NOT IN (SELECT event FROM cut) GROUP BY pilot HAVING count(*) >= 5)), s AS (SELECT year, avg(norm) AS m, count(DISTINCT event) AS events FROM r WHERE pilot = (SELECT pilot FROM pa) AND event NOT IN (SELECT event FROM cut) GROUP BY year), y AS (SELECT year, coalesce(events, 0) AS events, CASE WHEN events >= 2 THEN m END AS mean_norm FROM (SELECT DISTINCT year FROM d WHERE pilot = (SELECT pilot FROM pa)) LEFT JOIN s USING (year)) SELECT year, mean_norm, events, {_interval('mean_norm', 'events', 'sd')} FROM y, sd",
    "head_to_head": f", a AS ({_SIDE.format('a')}), b AS ({_SIDE.format('b')}) SELECT DISTINCT a.*, b.* EXCLUDE (event), ev.fieldSize, ev.fieldImputed, ev.date, CASE WHEN norm_a IS NULL THEN bound END AS bound_a, CASE WHEN norm_b IS NULL THEN bound END AS bound_b FROM a JOIN b USING (event) JOIN ev USING (event) LEFT JOIN tb USING (event)",
    "landscape": f", sd AS (SELECT {_SD} AS sd FROM (SELECT tag, count(*) AS n, var_samp(norm) AS v FROM r WHERE year = {YEAR} AND event NOT IN (SELECT event FROM cut) GROUP BY tag HAVING count(*) >= 2)), t AS (SELECT count(*) AS year_total, count(DISTINCT event) AS year_events FROM d WHERE year = {YEAR}), n AS (SELECT tag, count(*) AS n FROM d WHERE year = {YEAR} GROUP BY tag), m AS (SELECT tag, avg(norm) AS mean_norm, count(*) AS scored, count(DISTINCT event) AS events FROM r WHERE year = {YEAR} AND event NOT IN (SELECT event FROM cut) GROUP BY tag) SELECT tag, tag AS archetype, {YEAR} AS year, n, n / CAST(year_total AS DOUBLE) AS share, year_total, year_events, mean_norm, coalesce(scored, 0) AS scored, coalesce(events, 0) AS events, {_interval('mean_norm', 'events', 'sd')} FROM n LEFT JOIN m USING (tag), t, sd",
    "archetype_timeline": f"SELECT event, mean_norm_a, decks_a, CAST(NULL AS DOUBLE) AS mean_norm_b, 0 AS decks_b, ev.date, ev.fieldImputed, CASE WHEN mean_norm_a IS NULL THEN bound END AS bound_a, CAST(NULL AS DOUBLE) AS bound_b FROM {_AE.format('a', TAG_A)} JOIN ev USING (event) LEFT JOIN tb USING (event)",
    "archetype_timeline_pair": f"SELECT event, mean_norm_a, decks_a, mean_norm_b, decks_b, ev.date, ev.fieldImputed, CASE WHEN mean_norm_a IS NULL THEN bound END AS bound_a, CASE WHEN mean_norm_b IS NULL THEN bound END AS bound_b FROM {_AE.format('a', TAG_A)} JOIN {_AE.format('b', TAG_B)} USING (event) JOIN ev USING (event) LEFT JOIN tb USING (event)",
    "pilots_with_history": "SELECT pilot, c_name AS \"displayName\" FROM (SELECT pilot, year FROM r WHERE event NOT IN (SELECT event FROM cut) GROUP BY pilot, year HAVING count(DISTINCT event) >= 2) JOIN customer ON c_custkey = pilot GROUP BY pilot, c_name HAVING count(*) >= 2",
    "archetypes_with_history": "SELECT tag, tag AS name FROM r WHERE event NOT IN (SELECT event FROM cut) GROUP BY tag HAVING count(DISTINCT event) >= 2",
    "major_finishes": _FINISHES + " SELECT pilot, event, date, score FROM mf",
    "shrinkage": _SHRINK + " SELECT mu, k FROM sk",
    "leaderboard_scores": _SHRINK + f", s AS (SELECT pilot, round({_SCORE}, 12) AS score, count(*) AS majors FROM cf, sk GROUP BY pilot, mu, k) SELECT pilot, rank() OVER (ORDER BY score DESC) AS rank, score, majors, (SELECT count(*) FROM mj) AS major_events FROM s",
    "leaderboard_asof": _SHRINK + f", dt AS (SELECT anchor - to_months(CAST(6 * i AS INTEGER)) AS as_of FROM an, range(5) AS g(i)), s AS (SELECT pilot, as_of, round({_SCORE}, 12) AS as_of_score, count(*) AS as_of_majors FROM cf JOIN dt ON date <= as_of CROSS JOIN sk GROUP BY pilot, as_of, mu, k HAVING count(*) >= 2) SELECT *, rank() OVER (PARTITION BY as_of ORDER BY as_of_score DESC) AS as_of_rank, count(*) OVER (PARTITION BY as_of) AS as_of_contenders FROM s",
    "share_cut": ", n AS (SELECT tag, year, count(*) AS n FROM d WHERE year = (SELECT max(year) FROM d) GROUP BY tag, year) SELECT tag, year, n FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY n DESC, tag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_, sum(n) OVER () AS total FROM n) WHERE before_ < 0.5 * total",
}.items()}
