"""Operator 9, incremental substring dedup with a log-structured fingerprint index.

Documents arrive in batches. The index keeps, as immutable runs sorted and bucketed by hash,
the fingerprints of every window of 50 words seen so far (anchors with their contexts, see
``windows``), each with the first place that has it. A batch is judged against history:

1. its fingerprints are bucketed and sorted like the runs;
2. each run is merge-joined with them bucket by bucket; the run is not shuffled;
3. windows with an equal context in history, or earlier in the batch, are repeats; where only
   the anchors agree the texts are fetched and their windows compared byte by byte;
4. what is new becomes a run of level 0. ``FANOUT`` runs of one level are compacted into one of
   the next, which keeps one row for each fingerprint; so a fingerprint is rewritten as often
   as there are levels, the logarithm of the number of batches.

The manifest names the runs that count. It is replaced after new runs are complete and before
old ones go, so a crash at any point leaves an index that opens, as it was or as it is.

Result: the spans of words of each document that stand earlier in the corpus. Documents
arrive by doc_id: a batch holds larger ids than every batch before it, and a batch that
doesn't is refused. Runs and manifest lie in the shared folder; ``open`` finds them again.

Defined cases: rows with a null doc_id or text take no part; a text of under 50 words has no
window; rows with one doc_id and one text are one document, and several texts of one doc_id
are several; a passage that repeats inside one document counts; an empty batch changes
nothing; rows of ``history`` with a null doc_id or text, or a doc_id beyond the batch, are not
looked at; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.textops import Words, qualified, shared_dir, stored
from loomspark.llm.tokenfiles import _write, open_folder
from loomspark.llm.windows import ANCHOR_SCHEMA, JUDGED_SCHEMA, SPAN_SCHEMA, WINDOW, anchors, contexts, judge_anchors, merged, repeat_sql, repeats_in

FANOUT, BATCHES = 3, 4


def compared_windows(window: int = WINDOW):
    """Numbers windows by their bytes."""

    def number(texts: list[bytes], counts: np.ndarray) -> np.ndarray:
        out, seen = np.zeros(int(counts.sum()), np.int64), {}
        at = 0
        for text, n in zip(texts, counts.tolist(), strict=True):
            w = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            starts, ends = w.starts.tolist(), w.ends.tolist()
            for k in range(n):
                out[at] = seen.setdefault(text[starts[k] : ends[k + window - 1]], len(seen))
                at += 1
        return out

    return number


def first_places(rows: DataFrame) -> DataFrame:
    """The first place of each fingerprint; on bucketed rows no shuffle."""
    least = rows.groupBy("h", "c").agg(F.min(F.struct("doc_id", "tag", "at", "lo", "hi")).alias("p_"))
    return least.select("h", "c", "p_.doc_id", "p_.tag", "p_.at", "p_.lo", "p_.hi")


class FingerprintIndex:
    """Runs of fingerprints in one folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None, window: int = WINDOW, fanout: int = FANOUT):
        self.spark, self.folder = spark, qualified(spark, folder) if folder else shared_dir(spark, "fingerprints")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.window, self.fanout = window, fanout
        self.runs: list[tuple[str, int]] = []  # names and levels, oldest first
        self.high: int | None = None

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FingerprintIndex:
        system, path = open_folder(qualified(spark, folder))
        with system.open_input_stream(f"{path}/manifest.json") as f:
            held = json.loads(f.read())
        index = cls(spark, folder, held["buckets"], held["window"], held["fanout"])
        index.high = held["high"]
        index.runs = [(index._attach(name), level) for name, level in held["runs"]]
        return index

    def _attach(self, name: str) -> str:
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({ANCHOR_SCHEMA}) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        return name

    def _bucketed(self, rows: DataFrame) -> str:
        """Write rows as one sorted file a bucket; the table's name."""
        name = f"run_{uuid.uuid4().hex}"
        rows.repartition(self.buckets, "h").sortWithinPartitions("h", "c", "doc_id", "at").write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _plain(self, name: str) -> DataFrame:
        return self.spark.read.schema(ANCHOR_SCHEMA).parquet(f"{self.folder}/{name}")

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        system, path = open_folder(f"{self.folder}/{name}")
        system.delete_dir(path)

    def _manifest(self) -> None:
        _write(self.folder, "manifest.json", json.dumps({"buckets": self.buckets, "window": self.window, "fanout": self.fanout, "high": self.high, "runs": self.runs}).encode())

    def ingest(self, batch: DataFrame, history: DataFrame) -> DataFrame:
        """Judge a batch, add it, and return its spans (doc_id, tag, start_word, end_word), already
        written. ``history`` is where texts of earlier documents can be read."""
        spark, window = self.spark, self.window
        bounds = batch.where("doc_id is not null and text is not null").agg(F.min("doc_id"), F.max("doc_id")).first()
        if bounds[0] is None:
            return spark.createDataFrame([], "doc_id long, tag int, start_word int, end_word int")
        if self.high is not None and bounds[0] <= self.high:
            raise ValueError(f"doc_id {bounds[0]} arrived after {self.high}")
        fresh = self._bucketed(anchors(batch, window))
        new = spark.table(fresh)
        # read by path here: a union of bucketed scans claims their partitioning, and the shuffle below would go
        rows = self._plain(fresh)
        for run, _ in self.runs:  # both sides are bucketed by h: a merge join without a shuffle
            held = spark.table(run)
            rows = rows.unionByName(held.hint("merge").join(new.select("h"), "h", "left_semi"))
        judged = stored(rows.repartition("h").mapInArrow(judge_anchors, JUDGED_SCHEMA), "judged")
        mine = F.col("doc_id") >= F.lit(bounds[0])
        whole = judged.where("dup").where(mine).select("doc_id", "tag", F.col("lo").alias("start"), (F.col("hi") + window).alias("end"))
        # only hashes that a row of this batch has with another context need their texts
        asked = judged.where("mixed").where(mine).select("h").distinct()
        mixed = judged.where("mixed").join(asked, "h", "left_semi").select("h", "doc_id", "tag", "lo", "hi")
        texts = contexts(history.where(F.col("doc_id") <= F.lit(bounds[1])), mixed, window)
        part = texts.repartition("h").mapInArrow(repeats_in(compared_windows(window), window), SPAN_SCHEMA).where(mine)
        spans = stored(merged(whole.unionByName(part)), "spans")
        self.runs.append((self._bucketed(first_places(new)), 0))
        self.high = bounds[1]
        self._manifest()
        self._drop(fresh)
        self.compact()
        return spans

    def compact(self) -> None:
        """While a level has ``fanout`` runs, these as one of the next level; a fingerprint that
        several have keeps its first place."""
        while True:
            level = next((v for v in sorted({v for _, v in self.runs}) if sum(w == v for _, w in self.runs) >= self.fanout), None)
            if level is None:
                return
            old = [name for name, v in self.runs if v == level]
            rows = self._plain(old[0])
            for name in old[1:]:
                rows = rows.unionByName(self._plain(name))
            one = (self._bucketed(first_places(rows)), level + 1)
            at = next(k for k, (_, v) in enumerate(self.runs) if v == level)
            rest = [r for r in self.runs if r[1] != level]
            self.runs = [*rest[:at], one, *rest[at:]]
            self._manifest()
            for name in old:
                self._drop(name)


def incremental_spans(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW) -> DataFrame:
    """All documents through a new index, in ``batches`` of equal ranges of doc_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    out = spark.createDataFrame([], "doc_id long, tag int, start_word int, end_word int")
    if low is None:
        return out
    index, step = FingerprintIndex(spark, window=window), (high - low) // batches + 1
    for k in range(batches):
        inside = (F.col("doc_id") >= low + k * step) & (F.col("doc_id") < low + (k + 1) * step)
        out = out.unionByName(index.ingest(docs.where(inside), docs))
    return out


def op9_lsm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("tag")


QUERIES = {"op9_lsm_dedup": op9_lsm_dedup}
SQL = {"op9_lsm_dedup": repeat_sql()}
