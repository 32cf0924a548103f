"""Who played: from raw pilot ids and titles to pilots."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import names as n
from loomspark.functions.titles import name_from_title
from loomspark.session import materialised
from loomspark.sources.curation import Curation, CurationError, components


def fold(column) -> Column:
    """Casefolded; ``lower`` differs on some letters."""

    def run(s: pd.Series) -> pd.Series:
        return s.str.casefold()

    return F.pandas_udf(run, "string")(column)


@dataclass(frozen=True)
class Resolution:
    """deck_pilot (deckId, pilot), pilots (pilot, displayName, lowConfidence), dropped (deckId, kept)
    and the reports: variants, joined, splits, candidates, repeats, names, fired holds."""

    deck_pilot: DataFrame
    pilots: DataFrame
    dropped: DataFrame
    variants: DataFrame
    joined: DataFrame
    splits: DataFrame
    candidates: DataFrame
    repeats: DataFrame
    names: DataFrame  # name_reports
    fired: DataFrame


def _map(spark, rows: dict, *columns: str) -> DataFrame:
    """A map of the curated dictionary as rows; hundreds at most, so joins broadcast it."""
    return F.broadcast(spark.createDataFrame(list(rows.items()), ", ".join(f"{c} string" for c in columns)))


def signatures(contains: DataFrame) -> DataFrame:
    """(deckId, sig, cards): a deck's list as a hash by board, and its cards."""
    lists = contains.groupBy("deckId").agg(F.sort_array(F.collect_set(F.struct("board", "canon"))).alias("list"))
    return lists.select("deckId", F.sha2(F.to_json("list"), 256).alias("sig"), F.array_distinct(F.transform("list", lambda x: x["canon"])).alias("cards"))


def named(decks: DataFrame, contains: DataFrame, c: Curation) -> DataFrame:
    """Decks with resolved id, name from the title and signature."""
    spark = decks.sparkSession
    rows = decks.join(_map(spark, c.deck_pilots, "deckId", "over_"), "deckId", "left").withColumn("id_", F.coalesce("over_", "pilot"))
    rows = rows.join(_map(spark, c.merges, "id_", "to_"), "id_", "left").withColumn("pid", F.coalesce("to_", "id_"))
    rows = rows.withColumn("person", name_from_title(F.col("name"), F.col("deckName"), F.col("event")))
    rows = rows.join(signatures(contains), "deckId", "left").withColumn("sig", F.coalesce("sig", "deckId"))
    return rows.select("deckId", "pid", F.col("pilot").alias("raw"), "person", fold(F.coalesce("person", F.lit(""))).alias("folded"), "event", "createdAt", "placement", "sig", "cards", "deck_ord")


def drop_duplicates(rows: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Of decks equal in ``keys`` the best placed stays, then the smallest id."""
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("placement"), "deckId")
    marked = rows.withColumn("k_", F.row_number().over(order)).withColumn("kept", F.first("deckId").over(order))
    return marked.where("k_ = 1").drop("k_", "kept"), marked.where("k_ > 1").select("deckId", "kept")


def displays(rows: DataFrame) -> DataFrame:
    """(pid, displayName, spellings) by fuzzy majority, one group a pilot."""

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("at")
        shown, held = n.display_name(g["person"].tolist(), g["pid"].iloc[0])
        return pd.DataFrame({"pid": [g["pid"].iloc[0]], "displayName": [shown], "spellings": [sorted(held)]})

    at = F.row_number().over(Window.partitionBy("pid").orderBy("deck_ord"))
    return rows.select("pid", "person", at.alias("at")).groupBy("pid").applyInPandas(choose, "pid string, displayName string, spellings array<string>")


def name_reports(rows: DataFrame) -> DataFrame:
    """(pid, displayName, kind, names): ids whose titles name several families over several events,
    else ids with spellings that nothing relates to the one shown."""

    def report(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("at")
        pid, people = g["pid"].iloc[0], g["person"].tolist()
        shown, held = n.display_name(people, pid)
        named_at = [(x, e, n.full(x)) for x, e in zip(people, g["event"], strict=True) if x]
        families = {n.surname_key(f[1]) for _, _, f in named_at if f} - {""}
        out = []
        if len(families) > 1 and len({e for _, e, f in named_at if f}) > 1:
            out.append((pid, shown, "multi-name", sorted({x for x, _, _ in named_at})))
        elif odd := sorted(x for x in {x for x, _, _ in named_at} - set(held) if not n.relation(x, shown)):
            out.append((pid, shown, "unexplained", odd))
        return pd.DataFrame(out, columns=["pid", "displayName", "kind", "names"])

    at = F.row_number().over(Window.partitionBy("pid").orderBy("deck_ord"))
    return rows.select("pid", "person", "event", at.alias("at")).groupBy("pid").applyInPandas(report, "pid string, displayName string, kind string, names array<string>")


def fired_holds(c: Curation, moved: DataFrame, rows: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(a, b, settles_on, as_of, trigger): holds whose evidence moved, whatever was guessed to settle
    them; b is null where one id is held. Pairs are read where equal names joined them: both on one
    pilot, else met at one event. A single id is read by its own decks: two families at one event.
    Else either has decks that its ``as_of`` snapshot (``seen``: stamp, deckId) lacks. Holds are
    written by hand, so their decks are few and read on the driver."""
    spark = rows.sparkSession
    schema = "a string, b string, settles_on string, as_of string, trigger string"
    if not c.holds:
        return spark.createDataFrame([], schema)
    ids = sorted({c.canonical(x) for k in c.holds for x in k})
    target = {r.pid: r.target for r in moved.where(F.col("pid").isin(ids)).select("pid", "target").collect()}
    held = rows.where(F.col("pid").isin(ids) | F.col("target").isin(sorted(set(target.values())))).select("deckId", "event", "person", "pid", "target").collect()
    stamps: set = set()
    known: set = set()
    if seen is not None:
        asked = seen.where(F.col("stamp").isin(sorted({as_of for _, as_of in c.holds.values()})))
        stamps = {r.stamp for r in asked.select("stamp").distinct().collect()}
        decks = spark.createDataFrame([(r.deckId,) for r in held], "deckId string")
        known = {tuple(r) for r in asked.join(F.broadcast(decks), "deckId", "left_semi").select("stamp", "deckId").collect()}
    families = lambda r: n.surname_key(f[1]) if r.person and (f := n.full(r.person)) else ""
    out = []
    for key, (settles_on, as_of) in sorted(c.holds.items()):
        base = [c.canonical(x) for x in key]
        nodes = [target.get(x, x) for x in base]
        events = [{r.event for r in held if r.target == x} - {"nan", None} for x in nodes]
        mine = [r for r in held if (r.pid == base[0] if len(key) == 1 else r.target in nodes)]
        trigger = None
        if len(key) == 1:
            told: dict = {}
            for r in mine:
                if r.event not in ("nan", None) and families(r):
                    told.setdefault(r.event, set()).add(families(r))
            if any(len(x) > 1 for x in told.values()):
                trigger = "event_split"
        elif nodes[0] == nodes[1]:
            trigger = "joined_name"
        elif events[0] & events[1]:
            trigger = "shared_event"
        if trigger is None and as_of in stamps and any((as_of, r.deckId) not in known for r in mine):
            trigger = "new_decks"
        if trigger:
            out.append((key[0], key[1] if len(key) == 2 else None, settles_on, as_of, trigger))
    return spark.createDataFrame(out, schema)


def join_identical(pilots: DataFrame, decks: DataFrame, c: Curation) -> tuple[DataFrame, DataFrame]:
    """Pilots of one folded name become one, but for ids kept apart. (pid, target, displayName,
    lowConfidence) and (displayName, pilot, ids) of what was joined."""
    sizes = decks.groupBy("pid").agg(F.count("*").alias("decks"))
    rows = pilots.join(sizes, "pid").withColumn("key", F.when(F.col("pid").startswith("nan:deck:"), F.col("pid")).otherwise(fold("displayName")))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        ids = g["pid"].tolist()
        real = sorted(i for i in ids if not i.startswith("nan:"))
        apart = any(c.apart(a, b) for k, a in enumerate(real) for b in real[k + 1 :])
        if apart:
            root = components([[i] for i in real] + [[a, b] for k, a in enumerate(real) for b in real[k + 1 :] if not c.apart(a, b)])
            if any(c.apart(a, b) and root.get(a, a) == root.get(b, b) for k, a in enumerate(real) for b in real[k + 1 :]):
                raise CurationError(f"{real} are kept apart, but another id joins them again")
            part = {i: root.get(i, i) for i in ids}
        else:
            part = dict.fromkeys(ids, "")
        decks_of, shown = dict(zip(g["pid"], g["decks"], strict=True)), dict(zip(g["pid"], g["displayName"], strict=True))
        out = []
        for i in ids:
            mates = [j for j in ids if part[j] == part[i]]
            best = max(mates, key=lambda j: (not j.startswith("nan:"), decks_of[j], j))
            out.append((i, best, shown[best], all(j.startswith("nan:") for j in mates)))
        return pd.DataFrame(out, columns=["pid", "target", "displayName", "lowConfidence"])

    moved = rows.select("key", "pid", "displayName", "decks").groupBy("key").applyInPandas(one, "pid string, target string, displayName string, lowConfidence boolean")
    joined = moved.groupBy(F.col("target").alias("pilot"), "displayName").agg(F.sort_array(F.collect_list("pid")).alias("ids")).where(F.size("ids") > 1)
    return moved, joined


def split_events(rows: DataFrame) -> DataFrame:
    """(deckId, pilot, slot): two decks of one id at one event are two people, followed through
    events by what they play. Sequential for one id, in parallel over ids."""

    def thread(g: pd.DataFrame) -> pd.DataFrame:
        decks = [(d, e, t, frozenset(x if x is not None else ())) for d, e, t, x in zip(g["deckId"], g["event"], g["createdAt"], g["cards"], strict=True)]
        slots = n.thread_careers(decks)
        pid = g["target"].iloc[0]
        return pd.DataFrame({"deckId": list(slots), "pid": pid, "pilot": [pid if s == 0 else f"{pid}#{s + 1}" for s in slots.values()], "slot": list(slots.values())})

    return rows.select("target", "deckId", "event", "createdAt", "cards").groupBy("target").applyInPandas(thread, "deckId string, pid string, pilot string, slot int")


def under_merges(pilots: DataFrame, c: Curation) -> DataFrame:
    """(a, b, relation, state): related names that are still two pilots. Only names that share a
    block are compared."""
    spark = pilots.sparkSession

    def key_lists(s: pd.Series) -> pd.Series:
        return s.map(n.block_keys)

    def relations(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([n.relation(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    keys, related = F.pandas_udf(key_lists, "array<string>"), F.pandas_udf(relations, "string")
    blocks = pilots.select("pilot", "displayName", F.explode(keys("displayName")).alias("block"))
    pairs = blocks.alias("x").join(blocks.alias("y"), (F.col("x.block") == F.col("y.block")) & (F.col("x.pilot") < F.col("y.pilot"))).select(F.col("x.pilot").alias("a"), F.col("y.pilot").alias("b"), F.col("x.displayName").alias("na"), F.col("y.displayName").alias("nb")).distinct()
    pairs = pairs.withColumn("relation", related("na", "nb")).where("relation is not null")
    decided = [(*p, "rejected") for p in c.rejected] + [(*p, "held") for p in c.holds if len(p) == 2]
    return pairs.join(F.broadcast(spark.createDataFrame(decided, "a string, b string, state string")), ["a", "b"], "left").select("a", "b", "relation", F.coalesce("state", F.lit("candidate")).alias("state"))


def resolve(decks: DataFrame, contains: DataFrame, c: Curation | None = None, seen: DataFrame | None = None) -> Resolution:
    """The whole of it, in order: ids, duplicates, names, null ids, equal names, events, reports."""
    c = c or Curation()
    spark = decks.sparkSession
    rows, gone = drop_duplicates(materialised(named(decks, contains, c), "named"), "pid", "event", "folded", "sig")
    rows = materialised(rows, "entries")
    nobody = fold("pid").isin(*n.NULL_IDS)
    own = F.when(F.col("person").isNotNull(), F.concat(F.lit("nan:"), "folded")).otherwise(F.concat(F.lit("nan:deck:"), "deckId"))
    real = displays(rows.where(~nobody)).join(_map(spark, c.names, "pid", "given_"), "pid", "left")
    reports = name_reports(rows.where(~nobody))
    variants = real.where(F.size("spellings") > 1).select("pid", "displayName", "spellings")
    rows = rows.withColumn("pid", F.when(nobody, own).otherwise(F.col("pid")))
    unnamed = rows.where(F.col("pid").startswith("nan:")).groupBy("pid").agg(F.min_by(F.coalesce("person", F.lit(n.UNNAMED)), "deck_ord").alias("displayName"))
    names = materialised(real.select("pid", F.coalesce("given_", "displayName").alias("displayName")).unionByName(unnamed), "names")
    moved, joined = join_identical(names, rows, c)
    moved = materialised(moved, "moved")
    rows = rows.join(moved, "pid")
    # copies of one list at one event that different ids handed in; copies of one id are two people
    best = Window.partitionBy("target", "event", "sig").orderBy(F.asc_nulls_last("placement"), "deckId")
    marked = rows.withColumn("kept", F.first("deckId").over(best)).withColumn("keeper_", F.first("raw").over(best))
    late = marked.where(F.col("raw") != F.col("keeper_")).select("deckId", "kept")
    rows = rows.join(late, "deckId", "left_anti")
    slots = materialised(split_events(rows), "slots")
    people = slots.select("pid", "pilot", "slot").distinct()
    many = people.groupBy("pid").agg(F.count("*").alias("people"))
    base = moved.select(F.col("target").alias("pid"), "displayName", "lowConfidence").distinct()
    pilots = people.join(many, "pid").join(base, "pid").select("pilot", F.when(F.col("people") > 1, F.concat("displayName", F.lit(" "), (F.col("slot") + 1).cast("string"))).otherwise(F.col("displayName")).alias("displayName"), (F.col("lowConfidence") | (F.col("people") > 1)).alias("lowConfidence"))
    splits = many.where("people > 1").join(base, "pid").select(F.col("pid").alias("pilot"), "displayName", "people")
    whole = base.where(~F.col("pid").startswith("nan:")).select(F.col("pid").alias("pilot"), "displayName")
    repeats = decks.groupBy("pilot", "event").agg(F.count("*").alias("decks")).where("decks > 1")
    return Resolution(slots.select("deckId", "pilot"), pilots, reduce(DataFrame.unionByName, [gone, late]), variants, joined, splits, under_merges(whole, c), repeats, reports, fired_holds(c, moved, rows, seen))
