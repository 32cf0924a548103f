"""A review brief in Markdown: what the curated dictionary could still decide."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators.identity import Resolution

_ORDER = {"typo": 0, "nickname": 1, "exact": 2, "first-name": 3, "handle": 4}


def brief(r: Resolution, most: int = 200) -> str:
    """Open pairs by relation, pilots that occur in several pairs, and names without explanation.
    Lists are cut at ``most`` lines, and say so."""
    open_pairs = r.candidates.where("state = 'candidate'")
    total = open_pairs.count()
    pairs = sorted(open_pairs.orderBy("a", "b").limit(most).collect(), key=lambda p: (_ORDER.get(p.relation, 9), p.a, p.b))
    ends = open_pairs.select(F.explode(F.array("a", "b")).alias("pilot")).groupBy("pilot").count().where("count > 1")
    hubs = ends.orderBy(F.desc("count"), "pilot").limit(most).collect()
    odd = r.names.orderBy("kind", "pid").limit(most).collect()
    lines = ["# Review", "", f"## Pairs ({len(pairs)} of {total})", "", *[f"- {p.relation}: `{p.a}` and `{p.b}`" for p in pairs], "", "## In several pairs", "", *[f"- `{h.pilot}`: {h['count']}" for h in hubs]]
    return "\n".join([*lines, "", "## Names", "", *[f"- {o.kind}: `{o.pid}` ({o.displayName}): {', '.join(o.names)}" for o in odd], ""])
