"""Subgraph, catalogue and gem queries on the star-schema binding, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators import catalogue, gems, pictures, subgraph
from loomspark.plans.graph import Graph
from loomspark.plans.series_queries import busiest_cards, busiest_pilots, on
from loomspark.sources import tpch



def stranger(g: Graph):
    """The first card that shares no deck with the busiest one."""
    decks = g.contains.where(F.col("canon") == busiest_cards(g)[0]).select("deckId")
    met = g.contains.join(decks, "deckId", "left_semi").select("canon")
    return g.card.join(met, "canon", "left_anti").agg(F.min("canon")).first()[0]


def alone(g: Graph) -> tuple[Graph, object]:
    """The graph with the busiest pilot's decks given up, and that pilot."""
    pilot = busiest_pilots(g)[0]
    return replace(g, piloted_by=g.piloted_by.where(F.col("pilot") != pilot)), pilot


def picture(draw, names: str) -> dict:
    """``draw(g)`` gives nodes and edges; an entry for each."""
    return {f"{names}_{part}": on(lambda g, k=k: draw(g)[k]) for k, part in enumerate(("nodes", "edges"))}


def judged(g: Graph) -> DataFrame:
    return gems.screened(g).withColumn("luck", F.round("luck", 6)).withColumn("clears", F.round("clears", 6))


PICTURES = {
    **picture(lambda g: pictures.card_usage(g, busiest_cards(g)[0]), "card_usage"),
    **picture(lambda g: pictures.cooccurrence(g, busiest_cards(g)[0]), "cooccur_single"),
    **picture(lambda g: pictures.shared_cooccurrence(g, *busiest_cards(g)), "cooccur_pair"),
    **picture(lambda g: pictures.shared_cooccurrence(g, busiest_cards(g)[0], stranger(g)), "cooccur_apart"),
    **picture(lambda g: pictures.pilot_affinity(g, busiest_pilots(g)[0]), "affinity"),
    **picture(lambda g: pictures.pilot_affinity(*alone(g)), "affinity_lone"),
    **picture(pictures.hidden_gems, "gem_picture"),
}

QUERIES = PICTURES | {
    "pilot_neighbourhood_nodes": on(lambda g: subgraph.neighbourhood_nodes(g, busiest_pilots(g)[0])),
    "pilot_neighbourhood_edges": on(lambda g: subgraph.neighbourhood_edges(g, busiest_pilots(g)[0])),
    "pilot_h2h_edges": on(lambda g: subgraph.neighbourhood_edges(g, *busiest_pilots(g))),
    "card_usage": on(lambda g: subgraph.card_usage(g, busiest_cards(g)[0])),
    "card_usage_board": on(lambda g: subgraph.card_usage(g, busiest_cards(g)[0], "Side")),
    "seed_decks": on(lambda g: subgraph.seed_decks(g, busiest_cards(g)[0])),
    "cooccur_single": on(lambda g: subgraph.cooccurrence(g, busiest_cards(g)[0])),
    "cooccur_single_no_lands": on(lambda g: subgraph.cooccurrence(g, busiest_cards(g)[0], drop_lands=True)),
    "cooccur_pair": on(lambda g: subgraph.shared_cooccurrence(g, *busiest_cards(g))),
    "pilot_affinity": on(lambda g: subgraph.pilot_affinity(g, busiest_pilots(g)[0])),
    "result_size": on(lambda g: subgraph.result_size(subgraph.neighbourhood_nodes(g, busiest_pilots(g)[0]))),
    "pilot_catalogue": on(catalogue.pilot_catalogue),
    "card_catalogue": on(catalogue.card_catalogue),
    "gem_archetypes": on(catalogue.gem_archetypes),
    "coverage": on(catalogue.coverage),
    "deck_points": on(catalogue.deck_points),
    "naive_points": on(catalogue.naive_points),
    "points_agreement": on(lambda g: catalogue.points_agreement(catalogue.deck_points(g), catalogue.naive_points(g))),
    "gem_slices": on(gems.slices),
    "gem_candidates": on(lambda g: gems.candidates(g, gems.slices(g))),
    "gem_strata": on(lambda g: gems.strata(g, gems.slices(g), gems.candidates(g, gems.slices(g))).selectExpr("tag", "canon", "size(strata) AS events", "aggregate(strata, 0L, (a, s) -> a + s.held * 10007 + s.topped * 101 + s.drawn) AS sums")),
    "gem_screened": on(judged),
    "hidden_gems": on(lambda g: gems.hidden_gems(g).withColumn("luck", F.round("luck", 9))),
    "gem_table": on(pictures.gem_table),
    "gem_expected_by_luck": on(lambda g: gems.expected_by_luck(g).select(F.round("expected", 6).alias("expected"))),
    "gem_sweep": on(gems.sweep),
}

_PCT = "CASE WHEN {0} > 0 AND {0} * 100 < 0.5 THEN '<1%' ELSE CAST(CAST(round_even({0} * 100, 0) AS BIGINT) AS VARCHAR) || '%' END"
_ORD = "CAST(placement AS VARCHAR) || CASE WHEN placement % 100 BETWEEN 11 AND 13 THEN 'th' WHEN placement % 10 = 1 THEN 'st' WHEN placement % 10 = 2 THEN 'nd' WHEN placement % 10 = 3 THEN 'rd' ELSE 'th' END"
_MINE = ", nb AS (SELECT d.*, c_name FROM d JOIN customer ON c_custkey = pilot WHERE pilot = (SELECT pilot FROM pa))"
_BOTH = ", n0 AS (SELECT * FROM d WHERE pilot IN (SELECT pilot FROM pa UNION SELECT pilot FROM pb)), nb AS (SELECT * FROM n0 WHERE event IN (SELECT event FROM n0 GROUP BY event HAVING count(DISTINCT pilot) = 2))"
_EDGES = " SELECT DISTINCT 'pilot:' || pilot AS source, 'event:' || event AS target, 'entered' AS label FROM nb UNION SELECT 'event:' || event, 'deck:' || deckId, 'played' FROM nb UNION SELECT 'deck:' || deckId, 'placement:' || deckId, 'finished' FROM nb WHERE placement IS NOT NULL"
_NODES = f" SELECT 'pilot:' || pilot AS id, c_name AS label, 'pilot' AS kind, CAST(NULL AS VARCHAR) AS grp FROM nb UNION SELECT 'event:' || event, event, 'event', NULL FROM nb UNION SELECT 'deck:' || deckId, 'order ' || deckId, 'deck', NULL FROM nb UNION SELECT 'placement:' || deckId, {_ORD}, 'placement', NULL FROM nb WHERE placement IS NOT NULL"


def _usage(board: str) -> str:
    share = _PCT.format("runs / CAST(total AS DOUBLE)")
    return f""", run AS (SELECT DISTINCT deckId FROM ct WHERE canon = (SELECT canon FROM k1) {board}), x AS (SELECT d.deckId, macro, tag, run.deckId IS NOT NULL AS hit FROM d JOIN hm USING (deckId) LEFT JOIN run USING (deckId)),
dom AS (SELECT tag, macro FROM (SELECT tag, macro, row_number() OVER (PARTITION BY tag ORDER BY count(*) DESC, macro) AS k FROM x WHERE hit GROUP BY tag, macro) WHERE k = 1),
t AS (SELECT 'meta' AS tier, 'all' AS key, count(*) AS total, count(*) FILTER (hit) AS runs, CAST(NULL AS VARCHAR) AS parent FROM x UNION ALL SELECT 'macro', macro, count(*), count(*) FILTER (hit), NULL FROM x GROUP BY macro HAVING bool_or(hit)
UNION ALL SELECT 'archetype', x.tag, count(*), count(*) FILTER (hit), any_value(dom.macro) FROM x JOIN dom USING (tag) GROUP BY x.tag)
SELECT tier, key, runs, total, parent, runs / CAST(total AS DOUBLE) AS share, {share} AS label FROM t"""


def _cooccur(lands: str) -> str:
    return f", s AS (SELECT deckId, board FROM ct WHERE canon = (SELECT canon FROM k1)), n AS (SELECT count(DISTINCT deckId) AS seed_decks FROM s) SELECT canon, name, shared, seed_decks, shared / CAST(seed_decks AS DOUBLE) AS share, {_PCT.format('shared / CAST(seed_decks AS DOUBLE)')} AS label FROM (SELECT canon, name, count(DISTINCT deckId) AS shared FROM ct JOIN s USING (deckId, board) JOIN c USING (canon) WHERE canon <> (SELECT canon FROM k1) {lands} GROUP BY canon, name ORDER BY shared DESC, name, canon LIMIT 15), n"


_SLICES = ", s0 AS (SELECT tag, deckId, event, norm, pilot, count(*) OVER (PARTITION BY tag) AS total, row_number() OVER (PARTITION BY tag ORDER BY norm, deckId) AS k FROM r), sl AS (SELECT tag, deckId, event, norm, pilot, total, k <= greatest(1, CAST(round_even(total * 0.2, 0) AS BIGINT)) AS top FROM s0 WHERE total >= 34), dc AS (SELECT DISTINCT deckId, canon FROM ct), ca AS (SELECT tag, canon, count(*) AS decks, count(*) FILTER (top) AS hits, count(DISTINCT pilot) AS pilots, max(total) AS total FROM sl JOIN dc USING (deckId) GROUP BY tag, canon HAVING count(*) >= 5 AND count(*) <= 0.15 * max(total))"
_POINTS = ", own AS (SELECT deckId, sum(points) AS p FROM (SELECT DISTINCT deckId, canon FROM ct) JOIN c USING (canon) GROUP BY deckId), sd AS (SELECT deckId, max(pc - points) AS x FROM ct JOIN c USING (canon) WHERE board = 'Side' AND pc > 0 GROUP BY deckId), dp AS (SELECT deckId, CAST(coalesce(p, 0) + coalesce(x, 0) AS BIGINT) AS points FROM d LEFT JOIN own USING (deckId) LEFT JOIN sd USING (deckId)), nv AS (SELECT deckId, CAST(sum(points) AS BIGINT) AS points FROM ct JOIN c USING (canon) GROUP BY deckId)"



def _horner(r: str, *coefficients: float) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {r} + {c!r})"
    return out


def _quantile(p: str) -> str:
    """The normal quantile by Wichura's rational functions (algorithm AS 241)."""
    middle = f"({_horner('r', 2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.3871328727963666080)} * q / {_horner('r', 5226.4952788528545610, 28729.085735721942674, 39307.895800092710610, 21213.794301586595867, 5394.1960214247511077, 687.18700749205790830, 42.313330701600911252, 1.0)})"
    outer = f"(sign(q) * {_horner('(t - 1.6)', 0.000774545014278341407640, 0.0227238449892691845833, 0.241780725177450611770, 1.27045825245236838258, 3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734)} / {_horner('(t - 1.6)', 1.05075007164441684324e-9, 0.000547593808499534494600, 0.0151986665636164571966, 0.148103976427480074590, 0.689767334985100004550, 1.67638483018380384940, 2.05319162663775882187, 1.0)})"
    return f"(SELECT CASE WHEN abs(q) <= 0.425 THEN {middle} ELSE {outer} END FROM (SELECT {p} - 0.5 AS q, 0.180625 - ({p} - 0.5) * ({p} - 0.5) AS r, sqrt(-ln(least({p}, 1 - {p}))) AS t))"


#: the draws of each event convolved, tails summed from the far end, deflated for shared pilots;
#: the normal distribution by Simpson's rule
_LC = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"
_PMF = f"list_transform(range(0, drawn + 1), lambda i: CASE WHEN i <= topped AND drawn - i <= held - topped THEN exp({_LC.format('topped', 'i')} + {_LC.format('(held - topped)', '(drawn - i)')} - {_LC.format('held', 'drawn')}) ELSE CAST(0 AS DOUBLE) END)"
_SIMPSON = "(0.5 - sign(z) * (SELECT sum(CASE WHEN n IN (0, 1000) THEN 1 WHEN n % 2 = 1 THEN 4 ELSE 2 END * exp(-power(z * n / 1000.0, 2) / 2)) * abs(z) / 3000.0 / sqrt(2 * pi()) FROM range(1001) AS g(n)))"


def _lucks(held: str = "sl", candidates: str = "ca", tag: str = "", bars: tuple[float, ...] = (0.010,)) -> str:
    # a chance that equals a bar exactly must not lose it to the last digits of lgamma
    return f""", pe{tag} AS (SELECT tag, event, count(*) AS held, count(*) FILTER (top) AS topped FROM {held} GROUP BY tag, event),
dr{tag} AS (SELECT tag, canon, event, count(*) AS drawn FROM {held} JOIN dc USING (deckId) JOIN (SELECT tag, canon FROM {candidates}) USING (tag, canon) GROUP BY tag, canon, event),
ms{tag} AS (SELECT tag, canon, list_reduce(list({_PMF}), lambda m, p: list_transform(range(0, len(m) + len(p) - 1), lambda i: list_sum(list_transform(range(greatest(0, i - len(p) + 1), least(i, len(m) - 1) + 1), lambda j: m[j + 1] * p[i - j + 1])))) AS mass FROM dr{tag} JOIN pe{tag} USING (tag, event) GROUP BY tag, canon),
tl{tag} AS (SELECT tag, canon, decks, hits, pilots, total, k, least(1.0, list_sum(mass[k + 1:])) AS tail FROM (SELECT *, unnest(range(0, len(mass))) AS k FROM ms{tag} JOIN {candidates} USING (tag, canon))),
zs{tag} AS (SELECT *, CASE WHEN pilots >= decks THEN NULL ELSE {_quantile('(1 - greatest(least(tail, 1 - 1e-15), 1e-15))')} / sqrt(1 + (decks / CAST(pilots AS DOUBLE) - 1) * 0.226) END AS z FROM tl{tag}),
ch{tag} AS (SELECT *, CASE WHEN z IS NULL THEN tail ELSE {_SIMPSON} END AS chance FROM zs{tag}),
sc{tag} AS (SELECT tag, canon, any_value(decks) AS decks, any_value(hits) AS hits, any_value(pilots) AS pilots, any_value(total) AS total, max(chance) FILTER (k = hits) AS luck, {', '.join(f'coalesce(max(chance) FILTER (chance <= {b} + 1e-12), 0) AS clears{k or ""}' for k, b in enumerate(bars))} FROM ch{tag} GROUP BY tag, canon)"""


_GEMS = _SLICES + _lucks() + """, ad AS (SELECT *, row_number() OVER (ORDER BY round(luck, 12), tag, canon) AS ord FROM sc WHERE luck <= 0.010),
tp AS (SELECT DISTINCT sl.tag, sl.deckId, sl.pilot, ad.canon, ad.ord FROM sl JOIN dc USING (deckId) JOIN ad ON ad.tag = sl.tag AND ad.canon = dc.canon WHERE top),
nd AS (SELECT ord, count(*) AS fresh FROM (SELECT deckId, min(ord) AS ord FROM tp GROUP BY deckId) GROUP BY ord),
sp AS (SELECT ad.*, sum(1 + CASE WHEN row_number_ = 1 THEN 1 ELSE 0 END + coalesce(fresh, 0)) OVER (ORDER BY ord) AS spent FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY ord) AS row_number_ FROM ad) AS ad LEFT JOIN nd USING (ord)),
hg AS (SELECT * FROM sp WHERE ord < coalesce((SELECT min(ord) FROM sp WHERE spent > 250), 1000000000))"""


def _sweep() -> str:
    """Every setting's gems, archetypes and expectation."""
    out, cells = "WITH dc AS (SELECT DISTINCT deckId, canon FROM ct), rm AS (SELECT r.tag, r.deckId, r.event, r.norm, r.pilot, r.fieldSize > 64 AS major, count(*) OVER (PARTITION BY r.tag) AS total FROM r)", []
    for k, (mode, cut) in enumerate((m, x) for m in gems.SWEEP_MAJORS for x in gems.SWEEP_CUTS):
        pool = "major" if mode == "pool" else "true"
        out += f", rk{k} AS (SELECT *, count(*) FILTER ({pool}) OVER (PARTITION BY tag) AS pool, row_number() OVER (PARTITION BY tag, {pool} ORDER BY norm, deckId) AS k FROM rm WHERE total >= 34), s{k}_ AS (SELECT *, {pool} AND k <= greatest(1, CAST(round_even(pool * {cut}, 0) AS BIGINT)){' AND major' if mode == 'cut' else ''} AS top FROM rk{k}), s{k} AS (SELECT * FROM s{k}_ WHERE tag IN (SELECT tag FROM s{k}_ WHERE top))"
        out += f", c{k} AS (SELECT tag, canon, count(*) AS decks, count(*) FILTER (top) AS hits, count(DISTINCT pilot) AS pilots, max(total) AS total FROM s{k} JOIN dc USING (deckId) GROUP BY tag, canon HAVING count(*) >= 5 AND count(*) <= 0.15 * max(total))" + _lucks(f"s{k}", f"c{k}", str(k), gems.SWEEP_LUCKS)
        cells.append(f"SELECT '{mode}' AS mode, {cut} AS cut, * FROM sc{k}")
    grid = f", sw AS ({' UNION ALL '.join(cells)}), gr AS (SELECT majors, CAST(top_cut AS DOUBLE) AS top_cut, CAST(max_share AS DOUBLE) AS max_share, CAST(min_decks AS INTEGER) AS min_decks, CAST(max_luck AS DOUBLE) AS max_luck FROM (SELECT unnest({list(gems.SWEEP_MAJORS)}) AS majors), (SELECT unnest({list(gems.SWEEP_CUTS)}) AS top_cut), (SELECT unnest({list(gems.SWEEP_SHARES)}) AS max_share), (SELECT unnest({list(gems.SWEEP_FLOORS)}) AS min_decks), (SELECT unnest({list(gems.SWEEP_LUCKS)}) AS max_luck))"
    clears = "CASE " + " ".join(f"WHEN max_luck = {b} THEN clears{k or ''}" for k, b in enumerate(gems.SWEEP_LUCKS)) + " END"
    return out.replace("WITH dc", ", dc", 1) + grid + f" SELECT majors, top_cut, max_share, min_decks, max_luck, count(canon) FILTER (luck <= max_luck + 1e-12) AS gems, count(DISTINCT tag) FILTER (luck <= max_luck + 1e-12) AS archetypes, round(coalesce(sum({clears}), 0), 6) AS expected FROM gr LEFT JOIN sw ON mode = majors AND cut = top_cut AND decks >= min_decks AND decks <= max_share * total AND total >= ceil(min_decks / max_share) GROUP BY ALL"


_NODE = "CAST({grp} AS VARCHAR) AS grp, CAST({decks} AS BIGINT) AS decks, CAST({total} AS BIGINT) AS total_decks, CAST({events} AS BIGINT) AS events, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y"


def _node(**known: str) -> str:
    return _NODE.format(**({k: "NULL" for k in ("grp", "decks", "total", "events", "x", "y")} | known))


def _edge(decks: str = "NULL", total: str = "NULL", events: str = "NULL") -> str:
    return f"CAST({decks} AS BIGINT) AS decks, CAST({total} AS BIGINT) AS total_decks, CAST({events} AS BIGINT) AS events"


def _pct(share: str, total: str) -> str:
    return f"CASE WHEN {total} > 0 THEN {_PCT.format(share)} ELSE '0%' END"


def _cooccur_rows(mine: str) -> str:
    return f", k AS (SELECT {mine} AS canon FROM k1), s AS (SELECT deckId, board FROM ct WHERE canon = (SELECT canon FROM k)), n AS (SELECT count(DISTINCT deckId) AS seed_decks FROM s), p AS (SELECT canon, name, count(DISTINCT deckId) AS shared FROM ct JOIN s USING (deckId, board) JOIN c USING (canon) WHERE canon <> (SELECT canon FROM k) GROUP BY canon, name ORDER BY shared DESC, name, canon LIMIT 15)"


_USED = ", u AS (" + _usage("").replace(", run AS", "WITH run AS", 1) + ")"
_PAIRED = ", b AS (SELECT deckId FROM ct WHERE canon = (SELECT canon FROM k1) INTERSECT SELECT deckId FROM ct WHERE canon = (SELECT canon FROM k2)), bn AS (SELECT count(*) AS both_ FROM b), t AS (SELECT canon, name, count(DISTINCT deckId) AS shared FROM ct JOIN b USING (deckId) JOIN c USING (canon) WHERE canon NOT IN (SELECT canon FROM k1 UNION SELECT canon FROM k2) GROUP BY canon, name ORDER BY shared DESC, name, canon LIMIT 15), o AS (SELECT *, row_number() OVER (ORDER BY shared DESC, name, canon) - 1 AS ord, count(*) OVER () AS n FROM t), se AS (SELECT canon, name, up, (SELECT count(DISTINCT deckId) FROM ct WHERE ct.canon = c.canon) AS decks FROM c JOIN (SELECT canon, 150.0 AS up FROM k1 UNION ALL SELECT canon, -150.0 FROM k2) USING (canon))"
_HUB = "'both:' || (SELECT canon FROM k1) || '|' || (SELECT canon FROM k2)"
_AFF = ", m AS (SELECT macro, tag, event FROM d JOIN hm USING (deckId) WHERE pilot = (SELECT pilot FROM pa))"
_APART = "SELECT min(canon) FROM c WHERE canon NOT IN (SELECT y.canon FROM ct x JOIN ct y USING (deckId) WHERE x.canon = (SELECT canon FROM k1))"
_DRAWN = ", wd AS (SELECT DISTINCT hg.tag, hg.canon, sl.deckId, sl.pilot FROM hg JOIN sl USING (tag) JOIN dc ON dc.deckId = sl.deckId AND dc.canon = hg.canon WHERE top)"

_PICTURES = {
    "card_usage_nodes": _USED + f" SELECT 'card:' || k1.canon AS id, name || ' (' || label || ' of meta)' AS label, 'card' AS kind, {_node(decks='runs', total='total')} FROM u, k1 JOIN c USING (canon) WHERE tier = 'meta' UNION ALL SELECT 'macro:' || key, key || ' · ' || label, 'macro', {_node(decks='runs', total='total')} FROM u WHERE tier = 'macro' UNION ALL SELECT 'arch:' || key, key || ' · ' || label, 'archetype', {_node(decks='runs', total='total')} FROM u WHERE tier = 'archetype'",
    "card_usage_edges": _USED + f" SELECT 'card:' || canon AS source, 'macro:' || key AS target, label, {_edge('runs', 'total')} FROM u, k1 WHERE tier = 'macro' UNION ALL SELECT 'macro:' || parent, 'arch:' || key, label, {_edge('runs', 'total')} FROM u WHERE tier = 'archetype'",
    "cooccur_single_nodes": _cooccur_rows("canon") + f" SELECT 'card:' || canon AS id, name AS label, 'card' AS kind, {_node(grp=chr(39) + 'seed:' + chr(39) + ' || canon')} FROM c JOIN k USING (canon) UNION ALL SELECT 'card:' || canon, name, 'card', {_node(grp=chr(39) + 'cooccur' + chr(39))} FROM p",
    "cooccur_single_edges": _cooccur_rows("canon") + f" SELECT 'card:' || (SELECT canon FROM k) AS source, 'card:' || canon AS target, {_pct('shared / CAST(seed_decks AS DOUBLE)', 'seed_decks')} AS label, {_edge('shared', 'seed_decks')} FROM p, n",
    "cooccur_pair_nodes": _PAIRED + f" SELECT 'card:' || canon AS id, name AS label, 'card' AS kind, {_node(grp=chr(39) + 'seed:' + chr(39) + ' || canon', x='-800.0', y='up')} FROM se UNION ALL SELECT {_HUB}, 'Both · ' || both_ || ' decks', 'intersection', {_node(decks='both_', x='-350.0', y='0.0')} FROM bn UNION ALL SELECT 'card:' || canon, name, 'card', {_node(grp=chr(39) + 'cooccur' + chr(39), x='300.0', y='(ord - (n - 1) / 2.0) * 80.0')} FROM o",
    "cooccur_pair_edges": _PAIRED + f" SELECT 'card:' || canon AS source, {_HUB} AS target, {_pct('both_ / CAST(decks AS DOUBLE)', 'decks')} AS label, {_edge('both_', 'decks')} FROM se, bn UNION ALL SELECT {_HUB}, 'card:' || canon, {_pct('shared / CAST(both_ AS DOUBLE)', 'both_')}, {_edge('shared', 'both_')} FROM o, bn",
    "cooccur_apart_nodes": f", k0 AS ({_APART}) SELECT 'card:' || canon AS id, name AS label, 'card' AS kind, {_node(grp=chr(39) + 'seed:' + chr(39) + ' || canon')} FROM c WHERE canon IN (SELECT canon FROM k1 UNION SELECT * FROM k0)",
    "cooccur_apart_edges": f" SELECT 'a' AS source, 'b' AS target, 'c' AS label, {_edge()} WHERE false",
    "affinity_nodes": _AFF + f" SELECT 'pilot:' || c_custkey AS id, c_name AS label, 'pilot' AS kind, {_node()} FROM customer WHERE c_custkey = (SELECT pilot FROM pa) UNION ALL SELECT 'macro:' || macro, macro, 'macro', {_node(events='count(DISTINCT event)')} FROM m GROUP BY macro UNION ALL SELECT 'arch:' || tag, tag, 'archetype', {_node(events='count(DISTINCT event)')} FROM m GROUP BY tag",
    "affinity_edges": _AFF + f" SELECT 'pilot:' || (SELECT pilot FROM pa) AS source, 'macro:' || macro AS target, 'PLAYS:' || count(DISTINCT event) AS label, {_edge(events='count(DISTINCT event)')} FROM m GROUP BY macro UNION ALL SELECT 'macro:' || macro, 'arch:' || tag, 'PLAYS:' || count(DISTINCT event), {_edge(events='count(DISTINCT event)')} FROM m GROUP BY macro, tag",
    "affinity_lone_nodes": f" SELECT 'pilot:' || c_custkey AS id, c_name AS label, 'pilot' AS kind, {_node()} FROM customer WHERE c_custkey = (SELECT pilot FROM pa)",
    "affinity_lone_edges": f" SELECT 'a' AS source, 'b' AS target, 'c' AS label, {_edge()} WHERE false",
    "gem_picture_nodes": _GEMS + _DRAWN + f" SELECT 'arch:' || tag AS id, tag AS label, 'archetype' AS kind, {_node(decks='max(total)')} FROM hg GROUP BY tag UNION ALL SELECT 'card:' || tag || ':' || canon, name, 'card', {_node(decks='decks', total='total')} FROM hg JOIN c USING (canon) UNION ALL SELECT 'deck:' || deckId, c_name || ' · ' || {_ORD}, 'deck', {_node()} FROM (SELECT DISTINCT deckId, pilot FROM wd) AS w JOIN (SELECT deckId, placement FROM d) AS dp USING (deckId) JOIN customer ON c_custkey = w.pilot",
    "gem_picture_edges": _GEMS + _DRAWN + f" SELECT 'arch:' || tag AS source, 'card:' || tag || ':' || canon AS target, 'IN:' || decks || ' of ' || total || ' decks' AS label, {_edge('decks', 'total')} FROM hg UNION ALL SELECT 'deck:' || deckId, 'card:' || tag || ':' || canon, 'CONTAINS:' || (SELECT string_agg(board, '/' ORDER BY board) FROM ct WHERE ct.deckId = wd.deckId AND ct.canon = wd.canon), {_edge()} FROM wd",
    "gem_screened": _SLICES + _lucks() + " SELECT tag, canon, decks, hits, pilots, total, round(luck, 6) AS luck, round(clears, 6) AS clears FROM sc",
    "hidden_gems": _GEMS + " SELECT CAST(ord AS INTEGER) AS ord, tag, canon, decks, hits, pilots, total, round(luck, 9) AS luck FROM hg",
    "gem_table": _GEMS + " SELECT CAST(row_number() OVER (ORDER BY tag, luck, name, canon) AS INTEGER) AS ord, tag AS archetype, name AS card, canon, decks, hits, pilots, round(luck, 9) AS luck FROM hg JOIN c USING (canon)",
    "gem_sweep": _sweep(),
    "gem_expected_by_luck": _SLICES + _lucks() + " SELECT round(sum(clears), 6) AS expected FROM sc",
}

SQL = {k: tpch.SQL + v for k, v in _PICTURES.items()} | {k: tpch.SQL + v for k, v in {
    "pilot_neighbourhood_nodes": _MINE + _NODES,
    "pilot_neighbourhood_edges": _MINE + _EDGES,
    "pilot_h2h_edges": _BOTH + _EDGES,
    "card_usage": _usage(""),
    "card_usage_board": _usage("AND board = 'Side'"),
    "seed_decks": "SELECT name, count(DISTINCT deckId) AS decks FROM c LEFT JOIN ct USING (canon) WHERE canon = (SELECT canon FROM k1) GROUP BY name",
    "cooccur_single": _cooccur(""),
    "cooccur_single_no_lands": _cooccur("AND type <> 'Lands'"),
    "cooccur_pair": ", b AS (SELECT deckId FROM ct WHERE canon = (SELECT canon FROM k1) INTERSECT SELECT deckId FROM ct WHERE canon = (SELECT canon FROM k2)), t AS (SELECT canon, name, count(DISTINCT deckId) AS shared FROM ct JOIN b USING (deckId) JOIN c USING (canon) WHERE canon NOT IN (SELECT canon FROM k1 UNION SELECT canon FROM k2) GROUP BY canon, name ORDER BY shared DESC, name, canon LIMIT 15), o AS (SELECT *, row_number() OVER (ORDER BY shared DESC, name, canon) - 1 AS ord, count(*) OVER () AS n FROM t) SELECT canon, name, shared, (SELECT count(*) FROM b) AS both_decks, ord, (ord - (n - 1) / 2.0) * 80.0 AS y FROM o",
    "pilot_affinity": ", x AS (SELECT macro, tag, event FROM d JOIN hm USING (deckId) WHERE pilot = (SELECT pilot FROM pa)) SELECT 'macro x archetype' AS tier, macro, tag, count(DISTINCT event) AS events FROM x GROUP BY macro, tag UNION ALL SELECT 'macro', macro, NULL, count(DISTINCT event) FROM x GROUP BY macro UNION ALL SELECT 'archetype', NULL, tag, count(DISTINCT event) FROM x GROUP BY tag",
    "result_size": _MINE + f", nodes AS ({_NODES}), k AS (SELECT kind, count(*) AS n FROM nodes GROUP BY kind) SELECT CAST(sum(n) AS BIGINT) AS nodes, (SELECT kind FROM k ORDER BY n DESC, kind DESC LIMIT 1) AS dominant, sum(n) <= 250 AS draw FROM k",
    "pilot_catalogue": "SELECT c_custkey AS pilot, c_name AS \"displayName\" FROM customer",
    "card_catalogue": "SELECT canon, name FROM c",
    "gem_archetypes": "SELECT tag, tag AS name FROM r GROUP BY tag HAVING count(DISTINCT deckId) >= 34",
    "coverage": "SELECT (SELECT count(*) FROM ev) AS events, (SELECT count(*) FROM customer) AS pilots, (SELECT count(*) FROM d) AS decks, (SELECT count(*) FROM c) AS cards, (SELECT min(year) FROM ev) AS first_year, (SELECT max(year) FROM ev) AS last_year",
    "deck_points": _POINTS + " SELECT deckId, points FROM dp",
    "naive_points": _POINTS + " SELECT deckId, points FROM nv",
    "points_agreement": _POINTS + " SELECT count(*) AS graded, count(*) FILTER (dp.points = nv.points) AS agree, count(*) FILTER (dp.points = nv.points) / CAST(count(*) AS DOUBLE) AS share FROM dp JOIN nv USING (deckId)",
    "gem_slices": _SLICES + " SELECT tag, deckId, event, norm, total, top FROM sl",
    "gem_candidates": _SLICES + " SELECT tag, canon, decks, hits, pilots, total FROM ca",
    "gem_strata": _SLICES + ", pe AS (SELECT tag, event, count(*) AS held, count(*) FILTER (top) AS topped FROM sl GROUP BY tag, event), dr AS (SELECT tag, canon, event, count(*) AS drawn FROM sl JOIN dc USING (deckId) JOIN (SELECT tag, canon FROM ca) USING (tag, canon) GROUP BY tag, canon, event) SELECT tag, canon, count(*) AS events, CAST(sum(held * 10007 + topped * 101 + drawn) AS BIGINT) AS sums FROM dr JOIN pe USING (tag, event) GROUP BY tag, canon",
}.items()}
