"""Golden outputs: capture results as JSON and compare later ones within a tolerance."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame

from loomspark.constants import GOLDEN_TOLERANCE


def capture(results: dict[str, DataFrame]) -> dict[str, list[dict]]:
    """Result sets of bounded size, collected."""
    return {name: [_plain(r.asDict(True)) for r in df.collect()] for name, df in results.items()}


def _plain(value):
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def _identity(row: dict) -> str:
    return json.dumps({k: v for k, v in row.items() if not isinstance(v, float)}, sort_keys=True)


def _same(a, b, tolerance: float) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= tolerance
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k], tolerance) for k in a)
    return a == b


def compare(before: dict[str, list[dict]], after: dict[str, list[dict]], ordered: frozenset[str] = frozenset(), tolerance: float = GOLDEN_TOLERANCE) -> dict[str, list[str]]:
    """What differs, by result: rows on one side only, rows that changed, rows out of order."""
    out: dict[str, list[str]] = {}
    for name in sorted({*before, *after}):
        a, b, said = before.get(name), after.get(name), []
        if a is None or b is None:
            said.append("only " + ("after" if a is None else "before"))
        elif name in ordered and len(a) == len(b):
            said += [f"row {i} changed" for i, (x, y) in enumerate(zip(a, b, strict=True)) if not _same(x, y, tolerance)]
        else:
            x, y = {_identity(r): r for r in a}, {_identity(r): r for r in b}
            said += [f"only before: {k}" for k in sorted(x.keys() - y.keys())] + [f"only after: {k}" for k in sorted(y.keys() - x.keys())]
            said += [f"changed: {k}" for k in sorted(x.keys() & y.keys()) if not _same(x[k], y[k], tolerance)]
            if not said and len(a) != len(b):
                said.append(f"{len(a)} rows before, {len(b)} after")
        if said:
            out[name] = said
    return out


def source_digest(paths: list[str]) -> str:
    """Digest of what a build depends on, each part with its length in front."""
    h = hashlib.sha256()
    for p in sorted(paths):
        data = Path(p).read_bytes()
        for part in (Path(p).name.encode(), data):
            h.update(len(part).to_bytes(8, "big") + part)
    return h.hexdigest()


def stale(stamp: dict, paths: list[str]) -> bool:
    return stamp.get("digest") != source_digest(paths)
