"""Operator 3, SimHash near-dedup with pivot distance tables.

A document has two fingerprints of 128 bits, the signs of sums of hashed bits: one over its
words, one over its pairs of neighbouring words. Function words of up to ``LIGHT`` bytes
count only beside another word; the others count at every occurrence. Two documents are near copies if the first differ
in at most ``MOST`` bits and the second in at most ``MOST_PAIRS``: the same words, in much
the same order. Groups are the connected components, named by their smallest doc_id.

Pivot tables: the Hamming distances from each fingerprint to ``PIVOTS`` reference
fingerprints. By the triangle inequality a pair whose coordinates differ by more than MOST
anywhere is no near copy. Of a pair a word of the first fingerprint and the second one are
asked before the table, which costs more; what survives is verified bit by bit. The table alone would need all pairs, so bands of
fingerprint bits first choose the pairs: each of ``BANDS`` samples of bits or more routes a row
to a bucket, in which rows are compared that agree in one of the band's sub-bands of further
bits as well. A bucket has about ``BUCKET`` rows at most: bands get wider, and more, with the
corpus. So do sub-bands, and at every size they are so many that a pair at distance MOST is
compared with probability ``RECALL``; sub-bands cost computing, no shuffle. A worker holds a
bucket at a time.

Equal fingerprints count once and join their group directly, so thousands of copies make
no pairs. Defined cases: a null doc_id is never grouped; a null text neither; a text without
a word of over ``LIGHT`` bytes is compared by its exact text only; rows with one doc_id and
one text are one document; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.textops import Words, flat, mix, ranges, release, slices, stored

BITS, MOST, MOST_PAIRS, PIVOTS, BANDS, LIGHT = 128, 28, 36, 32, 48, 3
ROUTE, BUCKET, RECALL = 8, 1 << 20, 0.95
LEADERS, LEAD = 3, 32  # rows that are compared first with all of a run, and runs they are chosen in
HOLD = 1 << 17  # rows of small buckets that are worked through together
WORDS64 = 4  # two for words, two for pairs of words
_FP = [f"f{k}" for k in range(WORDS64)]
_SEEDS = mix(np.arange(1, WORDS64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
# a byte's bits as eight 8-bit lanes of one number: eight counters are added at once
_LANES = np.array([sum(((b >> (7 - k)) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)
_SEGMENT = 255  # what a lane can count


def fingerprints_of(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, 4) unsigned words, and which documents have any weight."""
    words = Words(raw, offs)
    heavy = words.ends - words.starts > LIGHT
    doc, hashes, n = words.doc_of(), words.hashes(), len(offs) - 1
    prints, has = np.zeros((n, WORDS64), np.uint64), np.zeros(n, bool)
    has[doc[heavy]] = True
    pairs = mix(hashes + mix(np.concatenate((hashes[1:], hashes[:1]))))
    inner = np.zeros(len(words), bool)
    inner[:-1] = (doc[1:] == doc[:-1]) & (heavy[1:] | heavy[:-1])
    for parts, use, values in (((0, 1), heavy, hashes), ((2, 3), inner, pairs)):
        d, x = doc[use], values[use]
        if not len(d):
            continue
        new = np.concatenate(([True], d[1:] != d[:-1]))
        heads = np.flatnonzero(new)
        counts = np.diff(np.concatenate((heads, [len(d)])))
        cuts = np.flatnonzero((np.arange(len(d)) - np.repeat(heads, counts)) % _SEGMENT == 0)
        owner = np.flatnonzero(new[cuts])
        for k in parts:
            lanes = np.take(_LANES, (x if k % 2 == 0 else mix(x ^ _SEEDS[k])).view(np.uint8)).reshape(-1, 8)
            ones = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8)
            ones = np.add.reduceat(ones, owner, axis=0, dtype=np.int64)
            prints[d[heads], k] = np.packbits(2 * ones > counts[:, None], axis=1).view(np.uint64).ravel()
    return prints, has


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, exact (hash of the text) and the fingerprint's four words, null where it has no weight."""
    schema = pa.schema([("doc_id", pa.int64()), *[(f, pa.int64()) for f in _FP], ("exact", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            prints, has = fingerprints_of(*flat(part.column("text")))
            columns = [pa.array(prints[:, k].view(np.int64), mask=~has) for k in range(WORDS64)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, part.column("exact")], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where("doc_id is not null and text is not null").withColumn("exact", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{f} long" for f in _FP) + ", exact long")


def pivot_prints(prints: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """The fingerprints of smallest hash: at most ``pivots`` rows reach the driver."""
    rows = prints.where("f0 is not null").select(*_FP).orderBy(F.xxhash64(*_FP)).limit(pivots).collect()
    found = np.array([list(r) for r in rows], np.int64).reshape(-1, WORDS64)
    return found.view(np.uint64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def sharing(width: int, distance: int, bits: int = BITS) -> float:
    """The probability that fingerprints at a distance agree in ``width`` of ``bits`` bits."""
    return math.prod(max(0, bits - distance - i) / (bits - i) for i in range(width))


def band_plan(count: int, bands: int = BANDS, most: int = MOST) -> tuple[int, int, int, int]:
    """(bands, bits that route a row, further bits of a sub-band, sub-bands of each band) with
    which a pair at distance ``most`` is compared with probability ``RECALL`` at least."""
    width = max(10, math.ceil(math.log2(count + 1)) - 2)
    route = min(max(ROUTE, math.ceil(math.log2(max(1, count) / BUCKET))), BITS - most - 1)
    share = sharing(route, most)
    bands = max(bands, math.ceil(math.log(1 - RECALL) / math.log1p(-0.6 * share)))
    each = 1 - (1 - RECALL) ** (1 / bands)
    fine = max(1, min(width, BITS - most) - route)
    return bands, route, fine, math.ceil(math.log(1 - each / share) / math.log1p(-sharing(fine, most, BITS - route)))


def dealt_bits(rng: np.random.Generator, rows: int, width: int, banned: list[int]) -> list[list[int]]:
    """``rows`` samples of bits, dealt without repeating until all have been used."""
    out: list[list[int]] = []
    deck: list[int] = []
    for _ in range(rows):
        row: list[int] = []
        while len(row) < width:
            if not deck:
                deck = [b for b in rng.permutation(BITS).tolist() if b not in row and b not in banned]
            row.append(deck.pop())
        out.append(row)
    return out


def masks_of(samples: list[list[int]]) -> np.ndarray:
    """(samples, 2) words with the sampled bits set."""
    out = np.zeros((len(samples), 2), np.uint64)
    for k, sample in enumerate(samples):
        for bit in sample:
            out[k, bit // 64] |= np.uint64(1) << np.uint64(bit % 64)
    return out


def band_masks(bands: int, route: int, fine: int, subs: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the bands, (bands, 2), and of their sub-bands, (bands, subs, 2)."""
    rng = np.random.default_rng(7)
    coarse = dealt_bits(rng, bands, route, [])
    return masks_of(coarse), np.stack([masks_of(dealt_bits(rng, subs, fine, c)) for c in coarse])


def keys_of(prints: np.ndarray, masks: np.ndarray, seed: np.ndarray | int = 0) -> np.ndarray:
    """A key of the masked bits; masks and seed broadcast against the fingerprints."""
    return mix((prints[..., 0] & masks[..., 0]) + mix((prints[..., 1] & masks[..., 1]) + mix(np.asarray(seed, np.uint64))))


def sums_of(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Keys of two masked words within a bucket. The factors are odd and the first product is
    folded, else the top bits would be lost."""
    key = first * (_SEEDS[0] | np.uint64(1))
    return (key ^ (key >> np.uint64(32))) + second * (_SEEDS[1] | np.uint64(1))


def near(a: np.ndarray, b: np.ndarray, most: int = MOST, most_pairs: int = MOST_PAIRS) -> np.ndarray:
    """The definition of a near copy, on fingerprints of shape (..., 4)."""
    return (distances(a[..., :2], b[..., :2]) <= most) & (distances(a[..., 2:], b[..., 2:]) <= most_pairs)


def pairs_in(key: np.ndarray, prints: np.ndarray, table: np.ndarray, most: int, most_pairs: int, chunk: int = 1 << 17, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Near pairs among rows with equal keys (sorted), and how many pairs were formed and how
    many the pivot table let through. Works through every pair, ``chunk`` at a time, or, with
    ``group`` (sorted within a key), through every pair of different groups. A word of the first
    fingerprint and then the second one are asked before the table: they cost less."""
    n = len(key)
    edge = key[1:] != key[:-1]
    cut = np.flatnonzero(np.concatenate(([True], edge, [True])))
    follow = np.arange(1, n + 1)
    if group is not None:
        block = np.flatnonzero(np.concatenate(([True], edge | (group[1:] != group[:-1]), [True])))
        follow = np.repeat(block[1:], np.diff(block))
    later = np.repeat(cut[1:], np.diff(cut)) - follow
    left, right, formed, let = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], int(later.sum()), 0
    at, sums = 0, np.concatenate(([0], np.cumsum(later)))
    words = [np.ascontiguousarray(prints[:, k]) for k in range(WORDS64)]
    while at < n:
        to = max(at + 1, int(np.searchsorted(sums, sums[at] + chunk, "right")) - 1)
        size = later[at:to]
        b = ranges(follow[at:to], size)
        some = np.flatnonzero(np.bitwise_count(np.repeat(words[0][at:to], size) ^ words[0][b]) <= most)
        a, b = np.repeat(np.arange(at, to), size)[some], b[some]
        some = np.flatnonzero(np.bitwise_count(words[2][a] ^ words[2][b]) + np.bitwise_count(words[3][a] ^ words[3][b]) <= most_pairs)
        a, b = a[some], b[some]
        for k in range(table.shape[1]):
            close = np.abs(table[a, k] - table[b, k]) <= most
            if not close.all():
                a, b = a[close], b[close]
        let += len(a)
        close = near(prints[a], prints[b], most, most_pairs)
        left.append(a[close])
        right.append(b[close])
        at = to
    return np.concatenate(left), np.concatenate(right), formed, let


def led(key: np.ndarray, group: np.ndarray, prints: np.ndarray, most: int, most_pairs: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of one row of each run of equal keys with the run's other groups: copies of one
    text join it before pairs among themselves are formed. ``turn`` chooses the row."""
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size = np.diff(cut)
    leader = np.repeat(cut[:-1] + (turn * 0x9E3779B1 % (1 << 32) * size >> 32), size)
    row = np.flatnonzero(group != group[leader])
    row = row[near(prints[row], prints[leader[row]], most, most_pairs)]
    return leader[row], row


def forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its component) for the pairs of rows a, b: what a bucket has to tell."""
    nodes, back = np.unique(np.concatenate((ids[a], ids[b])), return_inverse=True)
    root = np.arange(len(nodes))
    x, y = back[: len(a)], back[len(a) :]
    while True:
        low = root.copy()
        np.minimum.at(low, x, root[y])
        np.minimum.at(low, y, root[x])
        low = low[low]
        if np.array_equal(low, root):
            break
        root = low
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def grouped(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root``, each row's group, after the rows of the pairs a, b were joined."""
    if not len(a):
        return root
    root = root.copy()
    node, low = forest(root, a, b)
    root[node] = low
    return root[root]


def near_edges(prints: DataFrame, most: int = MOST, most_pairs: int = MOST_PAIRS, bands: int = BANDS) -> DataFrame:
    """(src, dst) edges, dst < src, that connect all near fingerprints found. ``prints`` has
    each distinct fingerprint once, with the smallest doc_id that has it as ``doc_id``."""
    bands, route, fine, subs = band_plan(prints.count(), bands, most)
    coarse, masks = band_masks(bands, route, fine, subs)
    pivots = pivot_prints(prints)

    def bands_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "band", "doc_id", *_FP]
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                fp = np.stack([part.column(f).to_numpy() for f in _FP], axis=1).view(np.uint64)
                keys = keys_of(fp[:, None], coarse[None], np.arange(bands))
                doc = np.repeat(part.column("doc_id").to_numpy(), bands)
                flat_fp = np.repeat(fp, bands, axis=0).view(np.int64)
                band = np.tile(np.arange(bands, dtype=np.int32), len(fp))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(band), pa.array(doc), *[pa.array(flat_fp[:, k]) for k in range(WORDS64)]], names=names)

    def edges(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        held = pa.Table.from_batches(parts)
        fp = np.stack([held[f].to_numpy() for f in _FP], axis=1).view(np.uint64)
        routed, band = held["key"].to_numpy().view(np.uint64), held["band"].to_numpy()
        ids, who = np.unique(held["doc_id"].to_numpy(), return_inverse=True)
        table = np.stack([distances(fp[:, :2], p[:2]) for p in pivots], axis=1).astype(np.int16)
        root = np.arange(len(ids))
        first, second = np.ascontiguousarray(fp[:, 0]), np.ascontiguousarray(fp[:, 1])
        for k in range(subs):
            key = sums_of(first & masks[:, k, 0][band], second & masks[:, k, 1][band]) + routed
            by = np.argsort(key)
            key = key[by]
            # runs of equal keys whose documents aren't all in one group already
            heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            of, sizes = root[who[by]], np.diff(np.concatenate((heads, [len(key)])))
            open_ = np.minimum.reduceat(of, heads) < np.maximum.reduceat(of, heads)
            by, sizes = by[np.repeat(open_, sizes)], sizes[open_]
            run = np.repeat(np.arange(len(sizes)), sizes)
            large = np.flatnonzero(np.repeat(sizes > LEAD, sizes))
            for turn in range(LEADERS if len(large) else 0):
                a, b = led(run[large], root[who[by[large]]], fp[by[large]], most, most_pairs, turn * subs + k + 1)
                root = grouped(root, who[by[large[a]]], who[by[large[b]]])
            order = np.argsort(run * len(ids) + root[who[by]])
            by, run = by[order], run[order]
            a, b, _, _ = pairs_in(run, fp[by], table[by], most, most_pairs, group=root[who[by]])
            root = grouped(root, who[by[a]], who[by[b]])
        keep = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(ids[root[keep]])], names=["src", "dst"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows, last = [], 0, None
        for batch in batches:  # sorted by key: worked through at the end of a bucket, when enough is held
            keys = batch.column("key").to_numpy()
            at = 0
            if rows >= HOLD and len(keys):
                at = int(np.searchsorted(keys, last, "right"))
                if at < len(keys):
                    yield edges([*parts, batch.slice(0, at)])
                    parts, rows = [], 0
                    release()
                else:
                    at = 0
            parts.append(batch.slice(at))
            rows += len(keys) - at
            last = keys[-1] if len(keys) else last
        if rows:
            yield edges(parts)
            release()

    long4 = ", ".join(f"{f} long" for f in _FP)
    rows = prints.select("doc_id", *_FP).mapInArrow(bands_out, f"key long, band int, doc_id long, {long4}")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(join, "src long, dst long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, group_id) for all nodes of ``edges``: the component's smallest node. Alternates
    large-star and small-star; every round is written to the shared folder."""
    now = stored(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst").distinct()
        lowest = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(lowest, "src").select(F.when(F.col("dst") == F.col("low"), F.col("src")).otherwise(F.col("dst")).alias("src"), F.col("low").alias("dst"))
        now = stored(small.where("src <> dst").distinct(), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("src").alias("doc_id"), F.col("dst").alias("group_id"))
        before = mark


def near_groups(docs: DataFrame, most: int = MOST, most_pairs: int = MOST_PAIRS, bands: int = BANDS) -> DataFrame:
    """(doc_id, group_id) for every document that has a near copy; group_id is the group's smallest doc_id."""
    prints = stored(fingerprints(docs), "prints")
    shape = F.coalesce("f0", F.col("exact"))  # without weight only the exact text counts
    keyed = prints.select("doc_id", *_FP, F.when(F.col("f0").isNull(), F.col("exact")).alias("only"), shape.alias("shape"))
    heads = stored(keyed.groupBy(*_FP, "only").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "heads")
    same = [keyed[c].eqNullSafe(heads[c]) for c in (*_FP, "only")]
    shared = heads.where("copies > 1")
    condition = (keyed["shape"] == F.coalesce(shared["f0"], shared["only"])) & same[0]
    for c in same[1:]:
        condition &= c
    equal = keyed.join(shared, condition).where(keyed["doc_id"] != shared["doc_id"]).select(keyed["doc_id"].alias("src"), shared["doc_id"].alias("dst"))
    close = near_edges(heads.where("f0 is not null"), most, most_pairs, bands)
    found = components(close.unionByName(equal))
    return found.unionByName(found.select(F.col("group_id").alias("doc_id"), "group_id")).distinct()


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` without all but one document of each group: the one whose doc_id names it.
    Documents in no group stay as they are, and rows that share a doc_id stay or go together."""
    losers = groups.where("doc_id <> group_id").select(F.col("doc_id").alias("key_"))
    return docs.join(losers, docs["doc_id"].cast("long") == losers["key_"], "left_anti")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_simhash": op3_simhash}
SQL: dict[str, str] = {}
