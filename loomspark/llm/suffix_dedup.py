"""Operator 7, suffix-array dedup by deep-shallow sorting.

Result: the spans of words that every later copy of a repeated passage takes up. A window
of 50 words counts as repeated if the same words stand at an earlier (doc_id, word).

Suffixes are sorted only where it can matter. One pass finds each window's anchor
(``windows``); anchors whose whole context repeats are settled by its hash. Suffixes of the
contexts that remain are sorted deep-shallow: multikey quicksort with keys of eight bytes
down to a shallow depth, then a blind trie for each group that is still tied.

Defined cases: rows with a null doc_id or text take no part; a text of under 50 words has
no window; rows with one doc_id and one text are one document, and several texts of one doc_id
are several, in the order of their hashes; a passage that repeats inside one document counts;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.textops import Words, flat, ranges, slices, stored
from loomspark.llm.windows import ANCHOR_SCHEMA, JUDGED_SCHEMA, SPAN_SCHEMA, WINDOW, anchors, contexts, judge_anchors, merged, repeat_sql, repeats_in, tag_of

SHALLOW = 48


class BlindTrie:
    """Orders byte strings that share a long prefix. Inner nodes hold only a depth and the
    bytes that branch there; a search goes down blindly, compares with one leaf, and then
    knows where the new string leaves the path."""

    __slots__ = ("root", "strings")

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None  # leaf: [-1, ids]; inner node: [depth, {byte: node}]

    def add(self, i: int) -> None:
        new = self.strings[i]
        if self.root is None:
            self.root = [-1, [i]]
            return
        node = self.root
        while node[0] >= 0:
            node = node[1].get(new[node[0]] if node[0] < len(new) else -1) or next(iter(node[1].values()))
        old = self.strings[node[1][0]]
        if new == old:
            node[1].append(i)
            return
        at = common(new, old)
        parent, node = None, self.root
        while 0 <= node[0] < at:
            parent, node = (node, new[node[0]]), node[1][new[node[0]]]
        mine = new[at] if at < len(new) else -1
        if node[0] == at:
            node[1][mine] = [-1, [i]]
            return
        split = [at, {old[at] if at < len(old) else -1: node, mine: [-1, [i]]}]
        if parent is None:
            self.root = split
        else:
            parent[0][1][parent[1]] = split

    def ordered(self) -> Iterator[list[int]]:
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                yield node[1]
            else:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, found by doubling and halving slices."""
    lo, hi, step = 0, min(len(a), len(b)), 16
    while lo < hi and a[lo : lo + step] == b[lo : lo + step]:
        lo = min(lo + step, hi)
        step *= 2
    hi = min(hi, lo + step)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def deep_shallow(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings text[start:end], and for each place in it whether its string equals the one before."""
    n = len(starts)
    order, group = np.arange(n), np.zeros(n, np.int64)
    alone = np.zeros(n, bool)
    padded = np.concatenate((text.astype(np.uint8), np.zeros(8, np.uint8)))
    for depth in range(0, shallow, 8):  # multikey quicksort: a pass splits every tied group by its next eight bytes
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        at, left = starts[order[tied]] + depth, np.clip(ends[order[tied]] - starts[order[tied]] - depth, 0, 8)
        key = np.zeros(len(tied), np.uint64)
        for b in range(8):
            byte = padded[np.minimum(at + b, len(padded) - 1)].astype(np.uint64)
            key = (key << np.uint64(8)) | np.where(b < left, byte, np.uint64(0))
        by = np.lexsort((left, key, group[tied]))
        order[tied], key, left, inside = order[tied][by], key[by], left[by], group[tied][by]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (inside[1:] != inside[:-1]) | (left[1:] != left[:-1])))
        head = np.zeros(n, bool)
        head[tied[new]] = True
        head[alone] = True
        group = np.cumsum(head)
        sizes = np.bincount(group, minlength=group[-1] + 1)
        alone = sizes[group] == 1
    same = np.zeros(n, bool)
    tied = np.flatnonzero(~alone)
    if len(tied):
        whole = text.tobytes()
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(group[tied]) != 0, [True])))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            places, members = tied[a:b], order[tied[a:b]]
            trie = BlindTrie([whole[s:e] for s, e in zip(starts[members].tolist(), ends[members].tolist(), strict=True)])
            for i in range(len(members)):
                trie.add(i)
            at = 0
            for leaf in trie.ordered():
                order[places[at : at + len(leaf)]] = members[leaf]
                same[places[at + 1 : at + len(leaf)]] = True
                at += len(leaf)
    return order, same


def sorted_windows(window: int = WINDOW):
    """Numbers windows through the sorted suffixes of their contexts."""

    def number(texts: list[bytes], counts: np.ndarray) -> np.ndarray:
        raw = np.frombuffer(b"".join(texts), np.uint8)
        offs = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
        words = Words(raw, offs)
        at = ranges(words.first[:-1], counts)
        order, same = deep_shallow(raw, words.starts[at], words.ends[at + window - 1])
        out = np.zeros(len(at), np.int64)
        out[order] = np.cumsum(~same)
        return out

    return number


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, tag, start_word, end_word): what copies take up, all but each passage's first
    place. ``tag`` tells texts of one doc_id apart."""
    found = stored(anchors(docs, window).repartition("h").mapInArrow(judge_anchors, JUDGED_SCHEMA), "suffix-anchors")
    whole = found.where("dup").select("doc_id", "tag", F.col("lo").alias("start"), (F.col("hi") + window).alias("end"))
    mixed = found.where("mixed").select("h", "doc_id", "tag", "lo", "hi")
    part = contexts(docs, mixed, window).repartition("h").mapInArrow(repeats_in(sorted_windows(window), window), SPAN_SCHEMA)
    return merged(whole.unionByName(part))


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` without the words of ``spans`` (doc_id, tag, start_word, end_word); a document of
    which nothing is left goes. Rows with a null doc_id or text stay as they are."""
    mark = "cuts_"
    while mark in docs.columns:  # the documents' own columns may have any name
        mark += "_"
    lists = spans.groupBy(F.col("doc_id").alias("key_"), F.col("tag").alias("tag_")).agg(F.collect_list(F.struct("start_word", "end_word")).alias(mark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            raw, offs = flat(part.column("text"))
            cuts = part.column(mark)
            words, whole = Words(raw, offs), raw.tobytes()
            texts = part.column("text").to_pylist()
            for d in np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False)).tolist():
                base, end, at, kept = words.first[d], offs[d + 1], offs[d], []
                for a, b in sorted((x["start_word"], x["end_word"]) for x in cuts[d].as_py()):
                    if base + a < words.first[d + 1]:
                        kept.append(whole[at : words.starts[base + a]])
                        at = words.starts[base + b] if base + b < words.first[d + 1] else end
                texts[d] = b"".join([*kept, whole[at:end]]).decode("utf-8", "replace")
            columns = [pa.array(texts, pa.string()) if k == "text" else part.column(k) for k in part.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    both = docs.join(lists, (docs["doc_id"].cast("long") == lists["key_"]) & (tag_of(docs["text"].cast("string")) == lists["tag_"]), "left").select(*[docs[c] for c in docs.columns], lists[mark])
    schema = both.schema
    out = both.mapInArrow(run, schema)
    out = out.where(F.col(mark).isNull() | F.col("text").isNull() | (F.trim(F.regexp_replace("text", r"\s", "")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(mark).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("tag")


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
SQL = {"op7_suffix_dedup": repeat_sql()}
