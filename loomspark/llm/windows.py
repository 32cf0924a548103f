"""Repeated word windows: winnowed anchors, and exact comparison where anchors disagree.

Every window of ``window`` words has one anchor: the smallest hash among its grams of
``gram`` words, the leftmost on ties. The choice depends on the window's words alone, so
equal windows have equal anchors, and neighbouring windows mostly share theirs: about one
word in 20 is an anchor. A document becomes a list of (anchor hash, context hash), the
context being all windows with that anchor. Equal contexts repeat each other whole; only
where one anchor has several contexts does the text have to be compared.

A document is a pair of doc_id and text: ``tag`` holds 32 bits of the text's hash, which tell
the texts of one doc_id apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.textops import Words, flat, mix, prefix, ranges, release, sized_join, slices, span_hash

WINDOW, GRAM = 50, 8
ANCHOR_SCHEMA = "h long, c long, doc_id long, tag int, at int, lo int, hi int"
SPAN_SCHEMA = "doc_id long, tag int, start int, end int"
_ARROW_ANCHORS = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int32()), ("at", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])
_ARROW_SORTED = pa.schema([*_ARROW_ANCHORS, ("dup", pa.bool_()), ("mixed", pa.bool_())])


def anchors_of(raw: np.ndarray, offs: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Anchors of a slice of documents, as arrays: doc (row), at, lo, hi (words in it), h, c."""
    words = Words(raw, offs)
    n = len(words)
    valid = np.zeros(max(n, 1), bool)[:n]
    long = words.counts >= window
    valid[ranges(words.first[:-1][long], words.counts[long] - window + 1)] = True
    at = np.flatnonzero(valid)
    if not len(at):
        return {k: np.zeros(0, np.int64) for k in ("doc", "at", "lo", "hi", "h", "c")}
    sums = prefix(words.hashes())
    first = np.arange(n - gram + 1)
    grams = span_hash(sums, first, first + gram)
    bits = np.uint64(max(1, int(n).bit_length()))
    keys = (grams >> bits << bits) | first.astype(np.uint64)
    low, size, width = keys, 1, window - gram + 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    best = np.minimum(low[at], low[at + width - size])
    anchor = (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)))
    lo, hi, anchor = at[new], at[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(at) - 1]))], anchor[new]
    doc = np.searchsorted(words.first, lo, "right") - 1
    context = mix(span_hash(sums, lo, hi + window) ^ mix((anchor - lo).astype(np.uint64) * np.uint64(1 << 20) + (hi - lo).astype(np.uint64)))
    base = words.first[doc]
    return {"doc": doc, "at": anchor - base, "lo": lo - base, "hi": hi - base, "h": grams[anchor].view(np.int64), "c": context.view(np.int64)}


def tag_of(text: str | Column = "text") -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def typed(docs: DataFrame) -> DataFrame:
    """doc_id, tag and text of the documents that have an id and a text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.where("doc_id is not null and text is not null").select("doc_id", tag_of().alias("tag"), "text")


def anchors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Anchors of all documents with an id and a text; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            got = anchors_of(*flat(part.column("text")), window, gram)
            ids, tags = (part.column(c).to_numpy(zero_copy_only=False)[got["doc"]] for c in ("doc_id", "tag"))
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip((got["h"], got["c"], ids, tags, got["at"], got["lo"], got["hi"]), _ARROW_ANCHORS, strict=True)], schema=_ARROW_ANCHORS)

    return typed(docs).mapInArrow(run, ANCHOR_SCHEMA)


def same_before(*columns: np.ndarray) -> np.ndarray:
    """For sorted columns: is the row equal to the one before it?"""
    out = np.ones(len(columns[0]), bool)
    out[:1] = False
    for x in columns:
        out[1:] &= x[1:] == x[:-1]
    return out


def judge_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """On a partition that holds whole anchor hashes: anchors that repeat, each marked ``dup``
    (an earlier place has its context) or ``mixed`` (its hash has several contexts)."""
    held = pa.Table.from_batches(list(batches), _ARROW_ANCHORS)
    if not held.num_rows:
        return
    columns = [x.to_numpy() for x in held.columns]
    order = np.lexsort([columns[k] for k in (4, 3, 2, 1, 0)])
    columns = [x[order] for x in columns]
    again = same_before(*columns[:5])  # a row that came twice is one document
    columns = [x[~again] for x in columns]
    dup, same = same_before(*columns[:2]), same_before(columns[0])
    group = np.cumsum(~same) - 1
    contexts = np.bincount(group, ~dup)
    mixed = ~dup & (contexts[group] > 1)
    keep = dup | mixed
    yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (*columns, dup, mixed)], schema=_ARROW_SORTED)
    del held, columns, order, again, dup, same, group, mixed, keep
    release()


JUDGED_SCHEMA = ANCHOR_SCHEMA + ", dup boolean, mixed boolean"
_ARROW_CONTEXTS = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("words", pa.string())])


def contexts(docs: DataFrame, mixed: DataFrame, window: int = WINDOW) -> DataFrame:
    """The words around each mixed anchor, one blank between them. Only documents that have
    one are looked at; their ids are broadcast if their measured bytes are few enough."""
    wanted = mixed.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("h", "lo", "hi")).alias("wanted_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            raw, offs = flat(part.column("text"))
            words = Words(raw, offs)
            ids, tags, wants = part.column("doc_id").to_pylist(), part.column("tag").to_pylist(), part.column("wanted_")
            out: list[list] = [[], [], [], [], [], []]
            whole = raw.tobytes()
            for d, (doc_id, tag) in enumerate(zip(ids, tags, strict=True)):
                base = words.first[d]
                for w in wants[d].as_py():
                    a, b = words.starts[base + w["lo"]], words.ends[base + w["hi"] + window - 1]
                    for col, x in zip(out, (w["h"], doc_id, tag, w["lo"], w["hi"], b" ".join(whole[a:b].split()).decode("utf-8", "replace")), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(out, _ARROW_CONTEXTS, strict=True)], schema=_ARROW_CONTEXTS)

    return sized_join(typed(docs), wanted, ["doc_id", "tag"]).select("doc_id", "tag", "text", "wanted_").mapInArrow(run, "h long, doc_id long, tag int, lo int, hi int, words string")


def repeats_in(equal_windows: Callable[[list[bytes], np.ndarray], np.ndarray], window: int = WINDOW):
    """A partition function over contexts: windows that an earlier (doc_id, word) has too.
    ``equal_windows(texts, counts)`` numbers all windows of the texts, ``counts`` of them in
    each; equal windows get one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), _ARROW_CONTEXTS)
        if not held.num_rows:
            return
        held = held.take(pa.array(np.lexsort([held[k].to_numpy() for k in ("lo", "tag", "doc_id", "h")])))
        ids, tags, lo, hi = (held[k].to_numpy() for k in ("doc_id", "tag", "lo", "hi"))
        by = np.lexsort((tags, ids))
        doc = np.empty(len(by), np.int64)  # documents numbered in their order
        doc[by] = np.cumsum(~same_before(ids[by], tags[by]))
        counts = (hi - lo + 1).astype(np.int64)
        number = equal_windows([x.encode() for x in held["words"].to_pylist()], counts)
        start, of, row = ranges(lo, counts), np.repeat(doc, counts), np.repeat(np.arange(len(doc)), counts)
        order = np.lexsort((start, of, number))
        dup = same_before(number[order])
        # the same place may come twice, from a row that came twice; it is not its own copy
        head = np.maximum.accumulate(np.where(dup, 0, np.arange(len(order))))
        dup &= (of[order] != of[order][head]) | (start[order] != start[order][head])
        hit = np.sort(order[dup])
        if not len(hit):
            return
        begins = np.concatenate(([True], (np.diff(hit) != 1) | (of[hit][1:] != of[hit][:-1]) | (np.diff(start[hit]) != 1)))
        last = np.concatenate((np.flatnonzero(begins)[1:] - 1, [len(hit) - 1]))
        row = row[hit][begins]
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[row], pa.int64()), "tag": pa.array(tags[row], pa.int32()), "start": pa.array(start[hit][begins], pa.int32()), "end": pa.array(start[hit][last] + window, pa.int32())})
        del held, ids, tags, by, doc, lo, hi, number, start, of, row, order, dup
        release()

    return run


def merged(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans of each document as one, in JVM code. Documents are told
    apart by all columns but start and end."""
    from pyspark.sql import Window

    keys = [c for c in spans.columns if c not in ("start", "end")]
    by = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("new_", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    rows = rows.withColumn("island_", F.sum("new_").over(by))
    return rows.groupBy(*keys, "island_").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word")).select(*keys, "start_word", "end_word")


def repeat_sql(window: int = WINDOW) -> str:
    """DuckDB: spans of windows that an earlier (doc_id, word) has too, merged."""
    return f"""
WITH w AS (SELECT DISTINCT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\v\\f]+'), lambda x: x <> '') AS ws
           FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT doc_id, i AS start_, array_to_string(list_slice(ws, i + 1, i + {window}), ' ') AS win
      FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - {window} + 1)) AS i FROM w WHERE len(ws) >= {window})),
r AS (SELECT doc_id, start_, row_number() OVER (PARTITION BY win ORDER BY doc_id, start_) AS k FROM g),
d AS (SELECT doc_id, start_, start_ + {window} AS end_ FROM r WHERE k > 1),
b AS (SELECT *, max(end_) OVER (PARTITION BY doc_id ORDER BY start_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_ FROM d),
i AS (SELECT *, sum(CASE WHEN before_ IS NULL OR start_ > before_ THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start_) AS island FROM b)
SELECT doc_id, CAST(min(start_) AS INTEGER) AS start_word, CAST(max(end_) AS INTEGER) AS end_word
FROM i GROUP BY doc_id, island
"""
