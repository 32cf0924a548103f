"""Operator 8, SentencePiece encoding and decoding by batched numpy Viterbi.

Texts are cut before each run of blanks, where no piece can reach across; equal words are
encoded once: words of up to ``SHORT`` bytes are told apart by a 64-bit hash, longer ones, for
which colliding texts are easy to write, by a cryptographic one. Words of equal length advance together, a character at a time:
hashes of all substrings probe the sorted piece keys, and for every end position a vectorised
maximum over the pieces that end there stores the backpointer.

A Viterbi over summed piece scores gives the library's ids for unigram models only. In a BPE
model, such as the one at hand, scores are merge ranks, so the maximum runs over another
quantity: a piece may follow the best path's last piece only if merging the two pieces' text
gives those two pieces again. Every prefix then has exactly one admissible last piece (a
prefix of an encoding is the encoding of its text), and the ids are the library's. The
admissibility test is vectorised too: it undoes merges, latest first. For a unigram model the
same forward pass takes the maximum of summed scores.

Defined cases: a null text gives null ids; an empty one gives no ids; a null doc_id stays;
repeated rows are each encoded; U+2581 in a text decodes as a blank, as in the library, and
``exact`` is then false; characters without a piece become bytes, or <unk> in models without
byte pieces; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.textops import flat, prefix, ranges, slices, span_hash

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
NONE = np.int64(1) << np.int64(40)
SHORT = 64


class WordCache:
    """The words this process has encoded lately, sorted by hash. It only saves time: when it
    is full it starts again from the last slice's words."""

    MOST = 400_000

    def __init__(self):
        self.keys, self.counts, self.first, self.ids = np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def __reduce__(self):
        return WordCache, ()

    def add(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(np.concatenate((self.keys, keys)), kind="stable")
        self.first = np.concatenate((self.first, len(self.ids) + np.cumsum(counts) - counts))[order]
        self.keys, self.counts = np.concatenate((self.keys, keys))[order], np.concatenate((self.counts, counts))[order]
        self.ids = np.concatenate((self.ids, ids))

    def trim(self, keys: np.ndarray) -> None:
        if len(self.keys) > self.MOST:
            at = np.searchsorted(self.keys, keys)
            counts, ids = self.counts[at], self.ids[ranges(self.first[at], self.counts[at])]
            self.__init__()
            self.add(keys, counts, ids)


_caches: dict[str, WordCache] = {}


@dataclass
class Pieces:
    """A model as arrays. Ranks number single characters first, then merges in their order;
    rank 0 stands for any character without a piece."""

    unigram: bool
    longest: int
    keys: np.ndarray  # sorted hashes of the pieces' code points
    key_rank: np.ndarray
    ids: np.ndarray  # rank -> id
    left: np.ndarray  # rank -> rank of the last merge's halves; itself for characters
    right: np.ndarray
    joins: np.ndarray  # sorted left << 20 | right of all pairs that make a piece
    joined: np.ndarray
    score: np.ndarray
    byte_ids: np.ndarray | None
    unk: int
    starts: np.ndarray  # id -> its bytes in raw
    raw: np.ndarray
    table: dict[str, int]  # piece -> rank
    cut_lines: bool  # no longer piece has a line feed
    name: str

    @property
    def cache(self) -> WordCache:
        return _caches.setdefault(self.name, WordCache())


def merge(chars: str, table: dict[str, int]) -> list[str]:
    """BPE of one word by a heap of pairs: the lowest rank first, the leftmost on ties."""
    n = len(chars)
    text, after, before, alive = list(chars), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            both = text[i] + text[j]
            rank = table.get(both)
            if rank is not None:
                heapq.heappush(heap, (rank, i, both))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or text[i] + text[j] != both:
            continue
        text[i], alive[j], after[i] = both, False, after[j]
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [t for t, a in zip(text, alive, strict=True) if a]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def load(path: str = MODEL) -> Pieces:
    """Read a model through the library and turn it into arrays; nothing is trained."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    special = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
    is_byte = [sp.is_byte(i) for i in range(size)]
    pieces = {sp.id_to_piece(i): i for i in range(size) if i not in special and not is_byte[i]}
    score = {p: sp.get_score(i) for p, i in pieces.items()}
    unigram = _model_type(sp.serialized_model_proto()) == 1
    chars = [p for p in pieces if len(p) == 1]
    longer = sorted((p for p in pieces if len(p) > 1), key=lambda p: (-score[p], pieces[p]))
    order = ["\0", *chars, *longer]
    table = {p: r for r, p in enumerate(order) if r}
    ties = {p: table[longer[k]] for k in range(len(longer)) for p in [longer[k]]}
    for a, b in zip(longer, longer[1:], strict=False):  # equal scores merge leftmost first
        if score[a] == score[b]:
            ties[b] = ties[a]
    left, right = np.arange(len(order)), np.arange(len(order))
    usable = np.ones(len(order), bool)
    joins: dict[int, int] = {}
    for p in longer:
        for k in range(1, len(p)):
            a, b = table.get(p[:k]), table.get(p[k:])
            if a and b:
                joins[a << 20 | b] = table[p]
    if not unigram:
        for p in longer:
            if len(merge(p, ties)) > 1:
                usable[table[p]] = False
                continue
            halves = _last_halves(p, ties)
            left[table[p]], right[table[p]] = table[halves[0]], table[halves[1]]
    named = [p for p in order[1:] if usable[table[p]]]
    flat_points = np.concatenate([_points(p) for p in named])
    ends = np.cumsum([len(p) for p in named])
    keys = span_hash(prefix(flat_points), np.concatenate(([0], ends[:-1])), ends)
    by = np.argsort(keys)
    join_keys = np.array(sorted(joins), np.int64)
    raw = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if is_byte[i] else b"" if i in special and not sp.is_unknown(i) else sp.id_to_piece(i).replace(BLANK, " ").encode() for i in range(size)]
    if sp.unk_id() >= 0:
        raw[sp.unk_id()] = " ⁇ ".encode()
    byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]) if any(is_byte) else None
    return Pieces(
        unigram=unigram, longest=max(map(len, order)), keys=keys[by], key_rank=np.array([table[p] for p in named])[by],
        ids=np.array([sp.unk_id(), *(pieces[p] for p in order[1:])]), left=left, right=right, joins=join_keys, joined=np.array([ties[order[joins[int(k)]]] for k in join_keys], np.int64),
        score=np.array([min(score.values()) - 10.0, *(score[p] for p in order[1:])]), byte_ids=byte_ids, unk=sp.unk_id(),
        starts=np.concatenate(([0], np.cumsum([len(x) for x in raw]))), raw=np.frombuffer(b"".join(raw), np.uint8), table=ties | {c: table[c] for c in chars},
        cut_lines=not any("\n" in piece for piece in longer), name=path,
    )


def _last_halves(piece: str, table: dict[str, int]) -> tuple[str, str]:
    """The two parts whose merge was the last step of merging a whole piece."""
    blocked = {k: v for k, v in ((piece[i:j], table.get(piece[i:j])) for i in range(len(piece)) for j in range(i + 2, len(piece) + 1)) if v is not None and k != piece}
    a, b = merge(piece, blocked)
    return a, b


def _model_type(proto: bytes) -> int:
    """trainer_spec.model_type of a serialised model: 1 unigram (also if absent), 2 BPE."""

    def number(b: bytes, i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (b[i] & 127) << shift
            shift += 7
            i += 1
            if b[i - 1] < 128:
                return value, i

    def fields(b: bytes):
        i = 0
        while i < len(b):
            tag, i = number(b, i)
            if tag & 7 == 2:
                size, i = number(b, i)
                value, i = b[i : i + size], i + size
            elif tag & 7 == 0:
                value, i = number(b, i)
            else:
                step = 4 if tag & 7 == 5 else 8
                value, i = b[i : i + step], i + step
            yield tag >> 3, value

    trainer = next((v for k, v in fields(proto) if k == 2), b"")
    return next((v for k, v in fields(trainer) if k == 3), 1)


def lookup(sorted_keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: int) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == wanted, values[at], missing)


def admissible(p: Pieces, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For ranks a, b: does merging their text give a, b again? Undoes the later of both
    pieces' last merges and asks whether the halves that meet would have merged before."""
    ok = np.ones(len(a), bool)
    act, limit = np.arange(len(a)), np.full(len(a), NONE)
    while len(act):
        joined = lookup(p.joins, p.joined, (a << 20) | b, NONE)
        fine = (joined >= limit) | (joined == NONE)
        ok[act[~fine]] = False
        a, b, limit, act = a[fine], b[fine], limit[fine], act[fine]
        first = a > b
        split_a, split_b = p.right[a], p.left[b]
        can_a, can_b = split_a != a, split_b != b
        do_a = np.where(first, can_a, can_a & ~can_b)
        do_b = ~do_a & can_b
        limit = np.where(do_a, a, np.where(do_b, b + 1, limit))
        a, b = np.where(do_a, split_a, a), np.where(do_b, split_b, b)
        more = do_a | do_b
        a, b, limit, act = a[more], b[more], limit[more], act[more]
    return ok


def encode_words(p: Pieces, points: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of all words' pieces, how many each word has, and each piece's first code point."""
    sums = prefix(points)
    back = np.zeros(len(points), np.int64)  # length of the piece that ends at each code point
    rank_at = np.zeros(len(points), np.int64)
    for size in np.unique(counts).tolist():
        words = np.flatnonzero(counts == size)
        for chunk in range(0, len(words), max(1, (1 << 18) // size)):
            begin = starts[words[chunk : chunk + max(1, (1 << 18) // size)]]
            last, best = np.zeros((size + 1, len(begin)), np.int64), np.zeros((size + 1, len(begin)))
            for end in range(1, size + 1):
                reach = min(p.longest, end)
                lens = np.arange(1, reach + 1)
                s = begin[None, :] + end - lens[:, None]
                rank = lookup(p.keys, p.key_rank, span_hash(sums, s.ravel(), np.broadcast_to(begin + end, s.shape).ravel()), -1).reshape(s.shape)
                rank[0] = np.maximum(rank[0], 0)
                row, col = np.nonzero(rank >= 0)
                found, at = rank[row, col], end - lens[row]
                if p.unigram:
                    value = best[at, col] + p.score[found]
                else:
                    inner = at > 0
                    value = np.full(len(found), -1.0)
                    value[~inner] = lens[row[~inner]]
                    ok = admissible(p, last[at[inner], col[inner]], found[inner])
                    value[inner] = np.where(ok, lens[row[inner]], -1.0)
                grid = np.full(rank.shape, -np.inf)
                grid[row, col] = value
                pick = grid.argmax(axis=0)
                every = np.arange(len(begin))
                best[end], last[end] = grid[pick, every], rank[pick, every]
                back[begin + end - 1], rank_at[begin + end - 1] = lens[pick], last[end]
    at, stop = (starts + counts - 1).copy(), starts
    live = np.arange(len(starts))[counts > 0]
    seen_word, seen_rank, seen_at = [], [], []
    while len(live):  # walk the backpointers of all words at once
        here = at[live]
        seen_word.append(live)
        seen_rank.append(rank_at[here])
        seen_at.append(here - back[here] + 1)
        at[live] = here - back[here]
        live = live[at[live] >= stop[live]]
    if not seen_word:
        return np.zeros(0, np.int64), np.zeros(len(starts), np.int64), np.zeros(0, np.int64)
    word, rank, first = np.concatenate(seen_word), np.concatenate(seen_rank), np.concatenate(seen_at)
    order = np.argsort(first, kind="stable")
    return rank[order], np.bincount(word, minlength=len(starts)), first[order]


def encode(p: Pieces, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and n + 1 offsets."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if pc.any(pc.match_substring(column, BLANK)).as_py():
        column = pc.replace_substring(column, BLANK, " ")
    empty = pc.equal(column, "")
    raw, offs = flat(pc.if_else(empty, column, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string()))))
    n = len(offs) - 1
    if not len(raw):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    blank = raw == 32
    start = blank.copy()
    start[1:] &= ~blank[:-1]
    start[offs[:-1][np.diff(offs) > 0]] = True
    if p.cut_lines:
        start[1:] |= raw[:-1] == 10
    begin = np.flatnonzero(start)
    end = np.concatenate((begin[1:], [len(raw)]))
    keys, long = span_hash(prefix(raw), begin, end), np.flatnonzero(end - begin > SHORT)
    if len(long):
        whole = raw.tobytes()
        digests = [blake2b(whole[a:b], digest_size=8).digest() for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True)]
        keys[long] = np.frombuffer(b"".join(digests), np.uint64)
    hashes, where, which = np.unique(keys, return_index=True, return_inverse=True)
    cache = p.cache
    new = lookup(cache.keys, np.ones(len(cache.keys), np.int64), hashes, 0) == 0
    where = where[new]
    sizes = end[where] - begin[where]
    text = raw[ranges(begin[where], sizes)]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    lead = (text & 0xC0) != 0x80
    chars = np.concatenate(([0], np.cumsum(lead)))[bounds]
    string = text.tobytes().decode("utf-8").replace(" ", BLANK)
    points = _points(string)
    counts = np.diff(chars)
    plain = np.ones(len(where), bool)
    many = np.flatnonzero((sizes > 1) & (text[bounds[:-1]] == 32))
    plain[many[text[bounds[:-1][many] + 1] == 32]] = p.unigram  # runs of blanks have tied merges: heap
    word_of, tokens = [], []
    rank, per, first = encode_words(p, points, chars[:-1][plain], counts[plain])
    ids = p.ids[rank].astype(np.int64)
    width = np.ones(len(rank), np.int64)
    byte_at = np.concatenate((np.flatnonzero(lead), [len(text)]))
    gone = rank == 0
    if p.byte_ids is not None and gone.any():
        width[gone] = np.diff(byte_at)[first[gone]]
        out = np.repeat(ids, width)
        spots = ranges((np.cumsum(width) - width)[gone], width[gone])
        out[spots] = p.byte_ids[text[ranges(byte_at[first[gone]], width[gone])]]
        ids = out
    total = np.zeros(len(where), np.int64)
    owner = np.repeat(np.flatnonzero(plain), per)
    total[plain] = np.bincount(owner, width, minlength=len(where)).astype(np.int64)[plain]
    word_of.append(np.repeat(owner, width))
    tokens.append(ids)
    for w in np.flatnonzero(~plain).tolist():
        own: list[int] = []
        for piece in merge(string[chars[w] : chars[w + 1]], p.table):
            r = p.table.get(piece)
            own.extend([piece_id(p, piece)] if r else p.byte_ids[list(piece.encode())].tolist() if p.byte_ids is not None else [p.unk])
        total[w] = len(own)
        word_of.append(np.full(len(own), w))
        tokens.append(np.array(own, np.int64))
    flat_ids, flat_word = np.concatenate(tokens), np.concatenate(word_of)
    if len(tokens) > 1:
        flat_ids = flat_ids[np.argsort(flat_word, kind="stable")]
    if len(where):
        cache.add(hashes[new], total, flat_ids.astype(np.int32))
    at = np.searchsorted(cache.keys, hashes)[which]
    amount = cache.counts[at]
    out = cache.ids[ranges(cache.first[at], amount)]
    cache.trim(hashes)
    doc_first = np.searchsorted(begin, offs)
    return out, np.concatenate(([0], np.cumsum(amount)))[doc_first]


def piece_id(p: Pieces, piece: str) -> int:
    key = span_hash(prefix(_points(piece)), np.array([0]), np.array([len(piece)]))
    return int(p.ids[lookup(p.keys, p.key_rank, key, 0)[0]])


def decode(p: Pieces, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and n + 1 offsets; the blank that encoding put in front goes."""
    sizes = (p.starts[1:] - p.starts[:-1])[ids]
    raw = p.raw[ranges(p.starts[ids], sizes)]
    ends = np.concatenate(([0], np.cumsum(sizes)))[offs]
    heads = ends[:-1][np.diff(ends) > 0]
    keep = np.ones(len(raw), bool)
    keep[heads[raw[heads] == 32]] = False
    return raw[keep], np.concatenate(([0], np.cumsum(keep)))[ends]


def encoded(docs: DataFrame, model: str | Pieces = MODEL) -> DataFrame:
    """doc_id, ids, n_tokens, and whether decoding gives the text again; no shuffle."""
    p = load(model) if isinstance(model, str) else model
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int32()), ("exact", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=2 << 20):
            column = part.column("text")
            ids, offs = encode(p, column)
            back, ends = decode(p, ids, offs)
            raw, own = flat(column)
            null = column.is_null().to_numpy(zero_copy_only=False)
            exact = np.diff(ends) == np.diff(own)
            if len(raw) == len(back) and exact.all():
                wrong = np.flatnonzero(raw != back)
                exact[np.searchsorted(own, wrong, "right") - 1] = False
            else:
                whole, again = raw.tobytes(), back.tobytes()
                exact = np.array([whole[own[d] : own[d + 1]] == again[ends[d] : ends[d + 1]] for d in range(part.num_rows)])
            lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids), mask=pa.array(null)) if null.any() else pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(np.diff(offs).astype(np.int32), mask=null), pa.array(exact, mask=null)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_tokens int, exact boolean")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_pieces": op8_pieces}
SQL: dict[str, str] = {}
