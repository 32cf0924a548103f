"""The dictionary of recorded decisions: read, validated, turned into maps and pairs."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from itertools import combinations
from pathlib import Path

_STAMP = re.compile(r"\d{8}T\d{6}Z\Z")
_KEYS = {
    "merge": {"ids", "canonical"}, "reject": {"ids"}, "split": {"ids"}, "hold": {"ids", "settles_on", "as_of"}, "name": {"pilot", "display_name"},
    "deck_pilot": {"deck", "pilot"}, "deck_event": {"deck", "event"}, "deck_archetype": {"deck", "deck_name", "engine", "engine_label"},
}


class CurationError(ValueError):
    """A decision that is malformed or contradicts another."""


def pair(a: str, b: str) -> tuple[str, str]:
    return (a, b) if a <= b else (b, a)


@dataclass(frozen=True)
class Curation:
    merges: dict[str, str] = field(default_factory=dict)
    rejected: frozenset = frozenset()
    splits: frozenset = frozenset()
    holds: dict[tuple, tuple[str, str]] = field(default_factory=dict)
    names: dict[str, str] = field(default_factory=dict)
    deck_pilots: dict[str, str] = field(default_factory=dict)
    deck_events: dict[str, str] = field(default_factory=dict)
    deck_archetypes: dict[str, tuple[str, str, str]] = field(default_factory=dict)

    def canonical(self, pilot: str) -> str:
        return self.merges.get(pilot, pilot)

    def apart(self, a: str, b: str) -> bool:
        return pair(a, b) in self.splits or pair(a, b) in self.rejected


def components(groups: list[list[str]]) -> dict[str, str]:
    """Union-find over a dictionary's groups: hundreds of rows, so on the driver."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for ids in groups:
        for other in ids[1:]:
            root[find(other)] = find(ids[0])
    return {x: find(x) for x in root}


def load_curation(path: str) -> Curation:
    """A missing file is an empty dictionary; anything wrong in it is refused."""
    if not Path(path).exists():
        return Curation()
    try:
        held = tomllib.loads(Path(path).read_text())
    except tomllib.TOMLDecodeError as e:
        raise CurationError(f"{path}: {e}") from e
    return parse(held)


def _once(found: dict, key, value, what: str) -> None:
    if key in found:
        raise CurationError(f"{what} {key!r} is decided twice")
    found[key] = value


def parse(held: dict) -> Curation:
    for kind, rows in held.items():
        if kind not in _KEYS or not isinstance(rows, list):
            raise CurationError(f"unknown decision {kind!r}")
        for row in rows:
            missing = _KEYS[kind] - row.keys()
            extra = row.keys() - _KEYS[kind] - {"note", "reason"}
            if missing or extra:
                raise CurationError(f"{kind}: missing {sorted(missing)}, unknown {sorted(extra)}")
            ids = row.get("ids")
            if ids is not None and (len(set(ids)) != len(ids) or len(ids) < (1 if kind == "hold" else 2)):
                raise CurationError(f"{kind}: needs distinct ids, has {ids}")
    rows = lambda kind: held.get(kind, [])
    for row in rows("merge"):
        if row["canonical"] not in row["ids"]:
            raise CurationError(f"merge: {row['canonical']!r} isn't one of {row['ids']}")
    root = components([r["ids"] for r in rows("merge")])
    named: dict[str, str] = {}
    for row in rows("merge"):
        if named.setdefault(root[row["canonical"]], row["canonical"]) != row["canonical"]:
            raise CurationError(f"merge: {row['canonical']!r} and {named[root[row['canonical']]]!r} both stand for one pilot")
    merges = {x: named[r] for x, r in root.items() if x != named[r]}
    pairs = lambda kind: [pair(a, b) for r in rows(kind) for a, b in combinations(r["ids"], 2)]
    rejected, splits = frozenset(pairs("reject")), frozenset(pairs("split"))
    for a, b in rejected | splits:
        if merges.get(a, a) == merges.get(b, b):
            raise CurationError(f"{a!r} and {b!r} are merged and kept apart")
    holds: dict = {}
    for r in rows("hold"):
        if not _STAMP.match(str(r["as_of"])):
            raise CurationError(f"hold: as_of {r['as_of']!r} is no snapshot stamp")
        keys = [pair(a, b) for a, b in combinations(r["ids"], 2)] or [(r["ids"][0],)]
        for key in keys:
            _once(holds, key, (r["settles_on"], r["as_of"]), "hold")
            if key in rejected or key in splits or (len(key) == 2 and merges.get(key[0], key[0]) == merges.get(key[1], key[1])):
                raise CurationError(f"{key} is held and decided")
    names: dict = {}
    deck_pilots: dict = {}
    deck_events: dict = {}
    deck_archetypes: dict = {}
    for r in rows("name"):
        _once(names, r["pilot"], r["display_name"], "name")
    for r in rows("deck_pilot"):
        _once(deck_pilots, r["deck"], r["pilot"], "deck_pilot")
    for r in rows("deck_event"):
        _once(deck_events, r["deck"], r["event"], "deck_event")
    for r in rows("deck_archetype"):
        _once(deck_archetypes, r["deck"], (r["deck_name"], r["engine"], r["engine_label"]), "deck_archetype")
    return Curation(merges, rejected, splits, holds, names, deck_pilots, deck_events, deck_archetypes)


def dead_entries(c: Curation, pilots: set[str], decks: set[str]) -> list[tuple[str, str]]:
    """Decisions whose keys the data no longer has, sorted."""
    used = [("merge", x) for x in {*c.merges, *c.merges.values()}] + [("name", x) for x in c.names] + [("reject", x) for p in c.rejected for x in p] + [("split", x) for p in c.splits for x in p] + [("hold", x) for p in c.holds for x in p]
    dead = {(k, x) for k, x in used if x not in pilots}
    dead |= {(k, x) for k, m in (("deck_pilot", c.deck_pilots), ("deck_event", c.deck_events), ("deck_archetype", c.deck_archetypes)) for x in m if x not in decks}
    return sorted(dead)
