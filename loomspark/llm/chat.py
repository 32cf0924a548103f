"""Operator 6, chat formatting by token-level assembly.

A conversation's turns, in order, become one list of token ids and a loss mask. Header and
content of each turn are encoded separately and reserved ids are spliced between them:

    BOS  then for each turn  START role-ids HEAD content-ids END

The mask marks the content and END of assistant turns; it comes from prefix sums over
segment starts, not from a loop over tokens. Reserved ids lie above the vocabulary, and text
is encoded as ordinary text, so no content can produce them; a control string in content is
still escaped, with a backslash after its ``<`` (and one more where backslashes stand there
already), so that the text never shows one either. ``unescaped`` undoes that exactly.

Defined cases: turns sort by (turn, role, text), nulls first, so ties have one order; a null
turn number sorts first; a null role is "user"; a null text is an empty turn; repeated rows
are repeated turns; rows with a null conv_id form one conversation; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.tokenfiles import RANKS, encoder

CONTROL = ("<|bos|>", "<|start|>", "<|head|>", "<|end|>")
_NAMES = "|".join(regex.escape(c[2:-2]) for c in (*CONTROL, "<|endoftext|>", "<|im_start|>", "<|im_end|>"))
_PLAIN = regex.compile(rf"<(\\*)(?=\|(?:{_NAMES})\|>)")
_DONE = regex.compile(rf"<\\(\\*)(?=\|(?:{_NAMES})\|>)")


def escaped(text: str) -> str:
    return _PLAIN.sub(r"<\\\1", text)


def unescaped(text: str) -> str:
    return _DONE.sub(r"<\1", text)


def reserved(ranks: str = RANKS) -> dict[str, int]:
    """Ids above the vocabulary; 50256 of a 50,256-entry file stays free for end of text."""
    base = encoder(ranks).n_vocab + 1
    return {c: base + k for k, c in enumerate(CONTROL)}


def assemble(conversations: list[list[tuple[str, str]]], ranks: str = RANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, mask, offsets of conversations and number of escaped contents in each, for
    conversations as lists of (role, text)."""
    encode, ids = encoder(ranks).encode_ordinary, reserved(ranks)
    bos, start, head, end = (ids[c] for c in CONTROL)
    roles: dict[str, list[int]] = {}
    segments: list[list[int]] = []
    learn: list[bool] = []
    first, changed = [0], []
    for turns in conversations:
        segments.append([bos])
        learn.append(False)
        count = 0
        for role, text in turns:
            if role not in roles:
                roles[role] = encode(escaped(role))
            safe = escaped(text)
            count += safe != text
            segments += [[start, *roles[role], head], encode(safe), [end]]
            learn += [False, role == "assistant", role == "assistant"]
        first.append(len(segments))
        changed.append(count)
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    flat_ids = np.fromiter((i for s in segments for i in s), np.int32, int(bounds[-1]))
    step = np.zeros(int(bounds[-1]) + 1, np.int64)  # +1 where a learned segment starts, -1 where it ends
    on = np.flatnonzero(learn)
    np.add.at(step, bounds[on], 1)
    np.add.at(step, bounds[on + 1], -1)
    return flat_ids, np.cumsum(step)[:-1].astype(np.int8), bounds[np.array(first)], np.array(changed, np.int32)


def chats(conversations: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(conv_id, n_turns, n_tokens, ids, mask, escaped) for every conversation. Turns are
    brought together by one shuffle on conv_id; sorting happens inside each conversation."""
    c = conversations
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    grouped = c.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int32()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.int8())), ("escaped", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                part = whole.slice(at, 1024)
                rows = [[(t["role"] or "user", t["text"] or "") for t in turns] for turns in part.column("turns").to_pylist()]
                ids, mask, offs, changed = assemble(rows, ranks)
                o = pa.array(offs, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), pa.array([len(r) for r in rows], pa.int32()), pa.array(np.diff(offs), pa.int32()), pa.ListArray.from_arrays(o, pa.array(ids)), pa.ListArray.from_arrays(o, pa.array(mask)), pa.array(changed)], schema=schema)

    return grouped.mapInArrow(run, "conv_id long, n_turns int, n_tokens int, ids array<int>, mask array<byte>, escaped int")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op6_chat": op6_chat}
SQL: dict[str, str] = {}
