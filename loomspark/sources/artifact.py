"""A built graph on disk: tables as Parquet, reports as JSON, promoted in one rename."""

from __future__ import annotations

import json
import os
import shutil
from dataclasses import fields
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession

from loomspark.plans.graph import Graph


def write_graph(g: Graph, out: str, reports: dict[str, object] | None = None) -> None:
    """Write beside the live artifact, keep that as ``.backup``, then rename. The folder is one
    that driver and executors share."""
    if Path(out).is_file():
        raise FileExistsError(f"{out} is a file")
    incoming, backup = f"{out}.incoming", f"{out}.backup"
    shutil.rmtree(incoming, ignore_errors=True)
    for f in fields(g):
        getattr(g, f.name).write.parquet(f"{incoming}/{f.name}")
    for name, report in (reports or {}).items():
        Path(incoming, f"{name}.json").write_text(json.dumps(report, indent=1, default=str))
    if Path(out).exists():
        shutil.rmtree(backup, ignore_errors=True)
        os.rename(out, backup)
    os.rename(incoming, out)


def read_graph(spark: SparkSession, path: str) -> Graph:
    if not Path(path).is_dir():
        raise FileNotFoundError(f"{path} is no artifact")
    return Graph(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(Graph)})


def stamp(digest: str) -> dict:
    return {"digest": digest, "built_at": datetime.now(UTC).isoformat(timespec="seconds")}
