"""Operator 5, token-id files: flat unsigned integers plus 64-bit document offsets.

Each partition writes ``part-NNNNN-U.bin`` (its documents' ids one after the other, little
endian, two bytes where the vocabulary fits, else four) and ``part-NNNNN-U.idx`` (64-bit
offsets into the part, one more than it has documents). Prefix sums over the partitions'
counts give every part its base: document offsets in the whole corpus are base plus offset.
``meta.json`` holds type, parts, their files, counts and bases; ``TokenFiles`` maps the files
into memory.

Every attempt of a task writes files of its own name U. The rows of the attempt that Spark
commits name them, and ``meta.json``, written last and by a rename, lists those and no others;
files of lost attempts, or of earlier runs into the same folder, are never read. Until a new
run is complete, ``meta.json`` is the earlier run's. The folder lies in
``spark.checkpoint.dir``, is resolved as Spark resolves it, and may be local, NFS or anything
pyarrow.fs opens by URI; where files can't be mapped they are read.

Defined cases: null and empty texts have no ids and equal offsets; a null doc_id stays null
in the result; repeated rows are written each; an empty table gives no parts and no rows;
control strings in a text are ordinary text; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.textops import prefix, qualified, shared_dir, slices, span_hash

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(ranks: str = RANKS):
    """The byte-level BPE of a public rank file; built once in each process."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(ranks, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def _write(folder: str, name: str, data: memoryview | bytes) -> None:
    """A whole file, there at once or not at all."""
    system, path = open_folder(folder)
    system.create_dir(path, recursive=True)
    hidden = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(hidden) as out:
        out.write(data)
    system.move(hidden, f"{path}/{name}")


def write_tokens(docs: DataFrame, folder: str, ranks: str = RANKS) -> DataFrame:
    """Write the parts; (part, file, doc, doc_id, start, end), offsets within the part."""
    size = np.dtype("<u2") if encoder(ranks).n_vocab <= 1 << 16 else np.dtype("<u4")
    schema = pa.schema([("part", pa.int32()), ("file", pa.string()), ("doc", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, counts, ids = TaskContext.get().partitionId(), [], [np.zeros(1, np.int64)], []
        encode = encoder(ranks).encode_ordinary
        for batch in slices(batches):
            lists = [encode(t) if t else () for t in batch.column("text").to_pylist()]
            counts.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            held.append(np.fromiter((i for x in lists for i in x), size, int(counts[-1].sum())))
            ids.append(batch.column("doc_id"))
        if not ids:
            return
        offsets, file = np.cumsum(np.concatenate(counts)), f"part-{part:05d}-{uuid.uuid4().hex}"
        _write(folder, f"{file}.bin", np.concatenate(held).tobytes())
        _write(folder, f"{file}.idx", offsets.astype("<i8").tobytes())
        n = len(offsets) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.DictionaryArray.from_arrays(np.zeros(n, np.int32), [file]).cast(pa.string()), pa.array(np.arange(n)), pa.concat_arrays(ids), pa.array(offsets[:-1]), pa.array(offsets[1:])], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "part int, file string, doc long, doc_id long, start long, end long")


@dataclass
class TokenFiles:
    """A written folder, mapped into memory part by part."""

    folder: str

    def __post_init__(self):
        system, path = open_folder(self.folder)
        with system.open_input_stream(f"{path}/meta.json") as f:
            self.meta = json.loads(f.read())
        self.parts = {p["part"]: p for p in self.meta["parts"]}

    def _map(self, name: str, dtype: str) -> np.ndarray:
        system, path = open_folder(self.folder)
        if isinstance(system, fs.LocalFileSystem):
            import os

            return np.memmap(f"{path}/{name}", dtype, "r") if os.path.getsize(f"{path}/{name}") else np.zeros(0, dtype)
        with system.open_input_stream(f"{path}/{name}") as f:
            return np.frombuffer(f.read(), dtype)

    def part(self, part: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of a part."""
        file = self.parts[part]["file"]
        return self._map(f"{file}.bin", self.meta["dtype"]), self._map(f"{file}.idx", "<i8")

    def document(self, part: int, doc: int) -> np.ndarray:
        ids, offsets = self.part(part)
        return ids[offsets[doc] : offsets[doc + 1]]


def token_files(docs: DataFrame, folder: str | None = None, ranks: str = RANKS) -> tuple[DataFrame, str]:
    """Write the files; a row (doc_id, part, doc, start_token, end_token, n_tokens, token_hash) for each
    document, offsets in the whole corpus and the hash taken from the mapped file, and the folder."""
    spark = docs.sparkSession
    folder = qualified(spark, folder) if folder else shared_dir(spark, "tokens")
    listing = f"{folder}/documents-{uuid.uuid4().hex}"
    write_tokens(docs, f"{folder}/files", ranks).write.parquet(listing)
    rows = spark.read.parquet(listing)
    # one row a part reaches the driver: its documents and ids
    parts = [r.asDict() for r in rows.groupBy("part").agg(F.max("file").alias("file"), F.count("*").alias("docs"), F.max("end").alias("ids")).orderBy("part").collect()]
    bases = np.concatenate(([0], np.cumsum([p["ids"] for p in parts], dtype=np.int64)))
    for p, base in zip(parts, bases.tolist(), strict=False):
        p["base"] = base
    dtype = "<u2" if encoder(ranks).n_vocab <= 1 << 16 else "<u4"
    _write(f"{folder}/files", "meta.json", json.dumps({"dtype": dtype, "ids": int(bases[-1]), "docs": sum(p["docs"] for p in parts), "parts": parts}).encode())
    base_of = {p["part"]: p["base"] for p in parts}
    files = f"{folder}/files"
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("doc", pa.int64()), ("start_token", pa.int64()), ("end_token", pa.int64()), ("n_tokens", pa.int64()), ("token_hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, opened = TokenFiles(files), {}
        for batch in batches:
            part = batch.column("part").to_numpy()
            for at, stop in _runs(part):
                piece, number = batch.slice(at, stop - at), int(part[at])
                if number not in opened:
                    opened = {number: (prefix_of(held.part(number)[0]), held.part(number)[1])}
                sums, offsets = opened[number]
                doc = piece.column("doc").to_numpy()
                start, end = offsets[doc], offsets[doc + 1]
                digest = span_hash(sums, start, end).view(np.int64)
                base = base_of[number]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("part"), piece.column("doc"), pa.array(start + base), pa.array(end + base), pa.array(end - start), pa.array(digest)], schema=schema)

    return rows.mapInArrow(run, "doc_id long, part int, doc long, start_token long, end_token long, n_tokens long, token_hash long"), folder


def prefix_of(ids: np.ndarray) -> np.ndarray:
    return prefix(np.asarray(ids))


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True]))) if len(values) else np.zeros(1, int)
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]


QUERIES = {"op5_token_files": op5_token_files}
SQL: dict[str, str] = {}
