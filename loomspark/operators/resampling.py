"""Ranks under resampling, as one seeded stream of ``random.Random`` deals it out, by many tasks.

A draw below n takes the leading bits of the stream's next word until they are below n, so
where a resample begins depends on all draws before. One task follows the stream without
drawing and notes where each chunk of resamples begins (``marks``); the chunks are then drawn,
refitted and ranked anywhere, and the ranks of a block of pilots meet in one row.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.session import materialised

WORDS = 1 << 18  # of the stream at a time
CHUNK, BLOCK = 20, 4096  # resamples of a task, pilots of a row
_MARK = pa.schema([("r", pa.int64()), ("key", pa.binary()), ("pos", pa.int64()), ("at", pa.int64())])


@lru_cache(maxsize=None)
def _taken(n: int):
    """Matches the leading bytes of the words that n draws below n < 256 take."""
    bound = n << (8 - n.bit_length())
    return re.compile(b"(?:[\\x%02x-\\xff]*+[\\x00-\\x%02x]){%d}" % (bound, bound - 1, n), re.DOTALL).match


class Stream:
    """The 32-bit words of a Mersenne twister, a stretch of them at hand."""

    def __init__(self, key: np.ndarray, pos: int, at: int = 0):
        self.bits, self.at, self.held = np.random.MT19937(), at, []
        self.bits.state = {"bit_generator": "MT19937", "state": {"key": key, "pos": pos}}
        self.more()

    @classmethod
    def of(cls, seed: int) -> Stream:
        *key, pos = random.Random(seed).getstate()[1]
        return cls(np.array(key, np.uint32), pos)

    def more(self) -> None:
        while self.at >= WORDS and self.held:
            self.held.pop(0)
            self.at -= WORDS
        state = self.bits.state["state"]
        self.held.append((state["key"], state["pos"], self.bits.random_raw(WORDS).astype(np.uint32)))
        self.words = np.concatenate([x[2] for x in self.held])
        self.heads = (self.words >> np.uint32(24)).astype(np.uint8).tobytes()

    def mark(self) -> tuple[bytes, int, int]:
        key, pos, _ = self.held[0]
        return key.tobytes(), int(pos), self.at

    def _slow(self, n: int) -> int | None:
        at, shift = self.at, 32 - n.bit_length()
        for _ in range(n):
            while at < len(self.words) and int(self.words[at]) >> shift >= n:
                at += 1
            at += 1
        return at if at <= len(self.words) else None

    def take(self, sizes: list[int], drawing: bool = False) -> np.ndarray | None:
        """Past n draws below n for every n of ``sizes``; what was drawn, in order, if asked for."""
        out: list[np.ndarray] = []
        k = 0
        while k < len(sizes):
            begin, start, ends = self.at, k, []
            heads, at = self.heads, self.at
            for n in sizes[k:]:
                if n < 256:
                    found = _taken(n)(heads, at)
                    end = found.end() if found else None
                else:
                    self.at = at
                    end = self._slow(n)
                if end is None:
                    break
                at = end
                ends.append(at)
            self.at, k = at, k + len(ends)
            if drawing and ends:
                mine = np.array(sizes[start:k], np.int64)
                width = np.diff([begin, *ends])
                shift = (32 - np.frexp(mine)[1]).astype(np.uint32)
                drawn = self.words[begin:at] >> np.repeat(shift, width)
                out.append(drawn[drawn < np.repeat(mine, width)].astype(np.int64))
            if k < len(sizes):
                self.more()
        return np.concatenate(out) if drawing and out else None


def sums(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each stretch, as Python's ``sum`` of floats compensates it."""
    total, lost = values[first].copy(), np.zeros(len(first))
    for j in range(1, int(sizes.max())):
        on = np.flatnonzero(sizes > j)
        x, hi = values[first[on] + j], total[on]
        t = hi + x
        lost[on] += np.where(np.abs(hi) >= np.abs(x), (hi - t) + x, (x - t) + hi)
        total[on] = t
    return total + lost


def refit(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Shrunken scores of all pilots from what each drew."""
    n, many = int(sizes.sum()), len(sizes)
    total = sums(values, first, sizes)
    means = total / sizes
    mu = sum(total.tolist()) / n
    apart, off = values - np.repeat(means, sizes), means - mu
    within = sum(x**2 for x in apart.tolist()) / (n - many)  # the power of floats, not a product: ties hang on its last digit
    across = sum(k * x**2 for k, x in zip(sizes.tolist(), off.tolist(), strict=True)) / (many - 1)
    typical = (n - int((sizes * sizes).sum()) / n) / (many - 1)
    between = (across - within) / typical
    if between <= 0:
        return np.full(many, mu)
    k = within / between
    return (total + k * mu) / (sizes + k)


def ranks(scores: np.ndarray) -> np.ndarray:
    """1 for the largest; equal ones share the better rank."""
    return (len(scores) + 1 - np.searchsorted(np.sort(scores), scores, "right")).astype(np.int32)


def rank_bounds(finishes: DataFrame, resamples: int, seed: int, low: int, high: int) -> DataFrame:
    """(pilot, rank_low, rank_high): of each pilot's ranks in order, those at ``low`` and ``high``."""
    kind = finishes.schema["pilot"].dataType.simpleString()

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("pilot", "date", "score")])
        runs = pc.run_end_encode(table["pilot"].combine_chunks())
        sizes = np.diff(runs.run_ends.to_numpy(), prepend=0).astype(np.int64)
        stream, found = Stream.of(seed), []
        counts = sizes.tolist()
        for r in range(resamples):
            if r % CHUNK == 0:
                found.append((r, *stream.mark()))
            if r < (resamples - 1) // CHUNK * CHUNK:  # where the last chunk ends nobody asks
                stream.take(counts)
        marks = pa.array([dict(zip(_MARK.names, x, strict=True)) for x in found], pa.struct(_MARK))
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x, pa.list_(pa.field("element", x.type)))
        values = table["score"].to_numpy().astype(np.float64)
        return pa.table({"pilots": one(runs.values), "sizes": pa.array([sizes.tobytes()]), "scores": pa.array([values.tobytes()]), "marks": one(marks)})

    held = finishes.where("pilot is not null").select("pilot", "date", F.col("score").cast("double").alias("score"))
    held = materialised(held.groupBy().applyInArrow(pack, f"pilots array<{kind}>, sizes binary, scores binary, marks array<struct<r: long, key: binary, pos: long, at: long>>"), "contenders")
    packed = held.select("sizes", "scores")
    marks = held.select(F.explode("marks").alias("m")).select("m.*")
    chunks = -(-resamples // CHUNK)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                sizes, values = np.frombuffer(row["sizes"].as_buffer(), np.int64), np.frombuffer(row["scores"].as_buffer(), np.float64)
                counts, first = sizes.tolist(), np.concatenate(([0], np.cumsum(sizes)[:-1]))
                stream = Stream(np.frombuffer(row["key"].as_buffer(), np.uint32), row["pos"].as_py(), row["at"].as_py())
                at = np.repeat(first, sizes)
                found = np.stack([ranks(refit(values[at + stream.take(counts, True)], first, sizes)) for _ in range(min(CHUNK, resamples - row["r"].as_py()))], axis=1)
                cuts = range(0, len(sizes), BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([b // BLOCK for b in cuts], pa.int64()), pa.array([found[b : b + BLOCK].tobytes() for b in cuts], pa.binary()), pa.array([found.shape[1]] * len(cuts), pa.int64())], names=["block", "ranks", "times"])

    def bounds(table: pa.Table) -> pa.Table:
        found = np.concatenate([np.frombuffer(x, np.int32).reshape(-1, t) for x, t in zip(table["ranks"].to_pylist(), table["times"].to_pylist(), strict=True)], axis=1)
        found = np.partition(found, (low, high), axis=1).astype(np.int64)
        number = table["block"][0].as_py() * BLOCK + np.arange(len(found))
        return pa.table({"number": number, "rank_low": found[:, low], "rank_high": found[:, high]})

    drawn = marks.repartition(chunks, "r").crossJoin(F.broadcast(packed)).mapInArrow(draw, "block long, ranks binary, times long")
    rows = drawn.groupBy("block").applyInArrow(bounds, "number long, rank_low long, rank_high long")
    pilots = held.select(F.posexplode("pilots").alias("number", "pilot")).withColumn("number", F.col("number").cast("long"))
    return pilots.join(rows, "number").select("pilot", "rank_low", "rank_high")
