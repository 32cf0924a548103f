"""Operator 2, quality classifier: random Fourier features, ridge, isotonic calibration.

A document becomes ``STATS`` numbers (shares of kinds of characters and words, repetition,
lengths, hits in a learned list of words of toxic documents). ``FEATURES`` random cosines of
the standardised numbers approximate a Gaussian kernel; ridge scores come from normal
equations that each partition sums for itself; isotonic regression on held-out rows turns
scores into probabilities of being good, that is of quality 1 and not toxic. Statistics are
shares or logarithms, so none saturates on long texts; standardised ones are clipped at eight
deviations, beyond which the kernel is flat.

Training uses at most about ``TRAIN_ROWS`` labelled documents, those of smallest id hash, of
which every fifth is held out; that bound is a parameter, and it bounds the word list, the
sums and what reaches the driver. Every document is scored.

Defined cases: several labels of one doc_id count as one, the worst; labels with a null
doc_id or quality are ignored, a null toxic is 0; a null or wordless text has probability 0
and is not kept; without labels, or with labels of one kind only, every document with words
gets their rate (1 without any); a null doc_id is scored like any other row; repeated rows
are each scored; other columns are ignored, or kept by ``kept``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.decontaminate import normalised
from loomspark.llm.textops import Words, flat, slices, stored

TRAIN_ROWS, FEATURES, RIDGE, SEED, CUT = 20_000, 256, 1e-3, 11, 0.5
STATS = ("log_words", "mean_word", "upper", "digit", "punct", "symbol", "line", "short", "long", "repeat", "repeat2", "capital_words", "symbol_words", "wide", "toxic_rate", "toxic_hits", "distinct", "max_word")
_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 digit, 3 punctuation of prose, 4 other symbol, 5 line feed, 6 part of a character
_KIND[65:91], _KIND[48:58], _KIND[10], _KIND[128:192] = 1, 2, 5, 6
for _b in range(33, 127):
    if not chr(_b).isalnum():
        _KIND[_b] = 3 if chr(_b) in ".,;:'\"-()?" else 4


def _sum(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))[offs])


def statistics(raw: np.ndarray, offs: np.ndarray, toxic_words: np.ndarray) -> np.ndarray:
    """(documents, STATS); all zero where there is no word."""
    words = Words(raw, offs)
    kind = _KIND[raw]
    size = np.maximum(np.diff(offs), 1)
    length = (words.ends - words.starts).astype(np.float64)
    count = np.maximum(words.counts, 1)
    per_word = lambda x: _sum(x, words.first) / count
    per_byte = [_sum(kind == k, offs) / size for k in (1, 2, 3, 4, 5, 6)]
    hashes, doc = words.hashes(), words.doc_of()
    same = lambda gap: np.concatenate((np.zeros(min(gap, len(doc)), bool), (hashes[gap:] == hashes[:-gap]) & (doc[gap:] == doc[:-gap])))
    upper, symbol = np.concatenate(([0], np.cumsum(kind == 1))), np.concatenate(([0], np.cumsum(kind == 4)))
    capital = (upper[words.ends] - upper[words.starts]) > 1
    odd = (symbol[words.ends] - symbol[words.starts]) > 0
    clean = normalised(raw, offs)
    if len(toxic_words):
        found = clean.hashes()
        at = np.minimum(np.searchsorted(toxic_words, found), len(toxic_words) - 1)
        hits = _sum(toxic_words[at] == found, clean.first)
    else:
        hits = np.zeros(len(offs) - 1)
    # distinct words: logarithm of their number over that of all, which long texts don't saturate
    slots = np.zeros(len(offs) - 1)
    if len(doc):
        keys = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        slots = np.log1p(np.bincount((keys[new] >> np.uint64(40)).astype(np.int64), minlength=len(offs) - 1)) / np.log1p(count)
    longest = np.zeros(len(offs) - 1)
    has = words.counts > 0
    if has.any():
        longest[has] = np.maximum.reduceat(length, words.first[:-1][has])
    out = np.stack([np.log1p(words.counts), np.log1p(per_word(length)), *per_byte[:5], per_word(length <= 3), per_word(length >= 15), per_word(same(1)), per_word(same(2)), per_word(capital), per_word(odd), per_byte[5], hits / count, np.log1p(hits), slots, np.log1p(longest)], axis=1)
    out[~has] = 0
    return out


@dataclass
class Model:
    toxic_words: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None  # of the random features; None: the rate for all
    knots: np.ndarray  # scores and probabilities of the calibration
    levels: np.ndarray

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        d = len(STATS)
        rng = np.random.default_rng(SEED)
        omega, phase = rng.normal(0, 1 / np.sqrt(d), (d, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.concatenate((np.sqrt(2 / FEATURES) * np.cos(z @ omega + phase), np.ones((len(z), 1))), axis=1)

    def score(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ridge scores and calibrated probabilities."""
        if self.weights is None:
            scores = np.full(len(stats), self.levels[0])
        else:
            scores = np.round(self.cosines(stats) @ self.weights, 6)
        good = np.interp(scores, self.knots, self.levels)
        good[stats[:, 0] == 0] = 0.0
        return scores, np.round(good, 6)


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; ties in score are pooled first. Knots and levels to interpolate."""
    values, at = np.unique(scores, return_inverse=True)
    weight, total = np.bincount(at).astype(float), np.bincount(at, labels)
    blocks: list[list[float]] = []  # weight, sum, first, last
    for v, w, t in zip(values.tolist(), weight.tolist(), total.tolist(), strict=True):
        blocks.append([w, t, v, v])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, t2, _, last = blocks.pop()
            blocks[-1][0] += w2
            blocks[-1][1] += t2
            blocks[-1][3] = last
    knots = [x for b in blocks for x in ((b[2], b[3]) if b[2] < b[3] else (b[2],))]
    levels = [b[1] / b[0] for b in blocks for _ in range(2 if b[2] < b[3] else 1)]
    return np.array(knots), np.array(levels)


def _typed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sampled(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, good, toxic and held-out flag of the training sample."""
    rows = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    rows = rows.agg(F.min(F.col("quality").cast("int")).alias("q_"), F.max(F.coalesce(F.col("toxic").cast("int"), F.lit(0))).alias("toxic_"))
    share = min(1.0, train_rows / max(1, rows.count()))
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = rows.where(bucket < int(share * (1 << 30))).select("doc_id", ((F.col("q_") == 1) & (F.col("toxic_") == 0)).alias("good_"), (F.col("toxic_") == 1).alias("toxic_"), (F.pmod(bucket, F.lit(5)) == 0).alias("held_"))
    # by construction about train_rows rows at most, so it may be broadcast
    return _typed(docs).where("text is not null").join(F.broadcast(chosen), "doc_id")


def toxic_list(sample: DataFrame, least_z: float = 6.0) -> np.ndarray:
    """Hashes of the words that stand out in toxic training documents: how many of the documents
    with the word are toxic lies ``least_z`` deviations above what the overall rate explains.
    All that stand out are in it; the sample's bound bounds their number."""
    schema = pa.schema([("word", pa.int64()), ("toxic", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            w = normalised(*flat(part.column("text")))
            doc, h = w.doc_of(), w.hashes()
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))[: len(doc)]
            toxic = part.column("toxic_").to_numpy(zero_copy_only=False).astype(np.int64)[doc[new]]
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(toxic)], schema=schema)

    train = sample.where("not held_")
    rate = train.agg(F.avg(F.col("toxic_").cast("double"))).first()[0]
    if not rate or rate >= 1:
        return np.zeros(0, np.uint64)
    words = train.select("text", "toxic_").mapInArrow(run, "word long, toxic long").groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    z = (F.col("t") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    rows = words.where((F.col("t") >= 4) & (z >= least_z)).select("word").collect()
    return np.sort(np.array([r.word for r in rows], np.int64).view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, ridge: float = RIDGE) -> Model:
    d = len(STATS)
    flat_model = lambda p: Model(np.zeros(0, np.uint64), np.zeros(d), np.ones(d), None, np.array([0.0, 1.0]), np.array([p, p]))
    sample = stored(sampled(docs, labels, train_rows), "train")
    seen = sample.agg(F.count("*"), F.avg(F.col("good_").cast("double"))).first()
    if not seen[0] or seen[1] in (0.0, 1.0):
        return flat_model(1.0 if not seen[0] else seen[1])
    toxic = toxic_list(sample)
    names = [f"s{k}" for k in range(d)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            stats = statistics(*flat(part.column("text")), toxic)
            keep = [part.column(c) for c in ("doc_id", "good_", "held_")]
            yield pa.RecordBatch.from_arrays([*keep, *[pa.array(stats[:, k]) for k in range(d)]], names=["doc_id", "good_", "held_", *names])

    rows = sample.select("doc_id", "text", "good_", "held_").mapInArrow(run, "doc_id long, good_ boolean, held_ boolean, " + ", ".join(f"{n} double" for n in names))
    # a bounded sample: eight partitions, in a fixed order so that sums never vary
    rows = stored(rows.repartition(8, "doc_id").sortWithinPartitions("doc_id", *names), "stats")
    moments = rows.where("not held_").agg(*[F.avg(n) for n in names], *[F.stddev_pop(n) for n in names]).first()
    if moments[0] is None:
        return flat_model(seen[1])
    mean, scale = np.round(np.array(moments[:d], float), 9), np.array(moments[d:], float)
    model = Model(toxic, mean, np.where(scale > 1e-9, np.round(scale, 9), 1.0), np.zeros(FEATURES + 1), np.array([0.0]), np.array([seen[1]]))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            stats = np.stack([batch.column(n).to_numpy() for n in names], axis=1)
            z = model.cosines(stats)
            y = batch.column("good_").to_numpy(zero_copy_only=False).astype(float) * 2 - 1
            gram += z.T @ np.concatenate((z, y[:, None]), axis=1)
        yield pa.RecordBatch.from_pydict({"gram": pa.array([gram.ravel()], pa.list_(pa.float64()))})

    parts = sorted(tuple(r.gram) for r in rows.where("not held_").select("good_", *names).mapInArrow(sums, "gram array<double>").collect())
    gram = np.sum(np.array(parts), axis=0).reshape(FEATURES + 1, FEATURES + 2)
    count = gram[-1, -2]
    model.weights = np.linalg.solve(gram[:, :-1] + ridge * count * np.eye(FEATURES + 1) / FEATURES, gram[:, -1])
    held = rows.where("held_").toPandas()  # a fifth of the bounded sample
    if len(held):
        scores = np.round(model.cosines(held[names].to_numpy()) @ model.weights, 6)
        model.knots, model.levels = isotonic(scores, held["good_"].to_numpy(float))
    else:
        model.knots, model.levels = np.array([-1.0, 1.0]), np.array([0.0, 1.0])
    return model


def scored(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """doc_id, score, good (probability) and keep for every document; no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("good", pa.float64()), ("keep", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            scores, good = model.score(statistics(*flat(part.column("text")), model.toxic_words))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores), pa.array(good), pa.array(good >= cut)], schema=schema)

    return _typed(docs).mapInArrow(run, "doc_id long, score double, good double, keep boolean")


def kept(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """``docs`` without the rows that the model rejects; all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            _, good = model.score(statistics(*flat(part.column("text")), model.toxic_words))
            yield part.filter(pa.array(good >= cut))

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op2_quality": op2_quality}
SQL: dict[str, str] = {}
