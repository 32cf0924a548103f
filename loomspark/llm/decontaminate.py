"""Operator 10, benchmark decontamination with a generalised suffix automaton.

Benchmark items and documents are normalised to words: runs of letters, marks and digits of any
script, lowered character by character; everything else, such as curly quotes and dashes, is a gap.
One automaton holds all items; a document's words stream through it and at each word the
length of the longest match ending there is known. Words are marked

- where a match is at least ``LENGTH`` words long, and
- where ``GRAM`` words match an item of which at least the share ``COVERAGE`` of all
  stretches of GRAM words occurs in the document.

Only stretches whose neighbouring words are neighbours in some item are walked through the
automaton; a bitmap of word pairs finds them at numpy speed, and any match of two words or
more lies inside one, so nothing is missed. Documents are never shuffled.

Items reach the workers with the function. A count of their words is checked first: beyond
``ITEM_WORDS`` they are dealt into several automata, each with a pass of its own; the rules
look at one item at a time, so the union of the passes is the same result.

Defined cases: null doc_id or null text: the row stays as it is and gives no spans; null or
wordless items match nothing; items of under GRAM words match nothing; repeated rows are
each treated; a document of which no word is left goes; other columns stay as they are.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.textops import Words, flat, mix, slices
from loomspark.llm.windows import merged

LENGTH, GRAM, COVERAGE, ITEM_WORDS = 13, 6, 0.6, 2_000_000
_tables: list[np.ndarray] = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its small letter, and whether it is a gap. Built once in each process."""
    if not _tables:
        points = [chr(c) for c in range(sys.maxunicode + 1)]
        _tables.append(np.fromiter((ord(c.lower()[0]) for c in points), np.uint32, len(points)))
        _tables.append(np.fromiter((category(c)[0] not in "LMN" for c in points), bool, len(points)))
    return _tables[0], _tables[1]


_MASK = np.uint64((1 << 22) - 1)


class Normal(Words):
    """Words of normalised text; ``raw`` and all positions are characters, not bytes."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        small, gap = tables()
        lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        self.text = raw.tobytes().decode("utf-8", "replace")
        points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        super().__init__(small[points], lead[offs], gap)

    def strings(self) -> str:
        """The normalised characters; words are its slices."""
        return self.raw.tobytes().decode("utf-32-le", "surrogatepass")


def normalised(raw: np.ndarray, offs: np.ndarray) -> Normal:
    return Normal(raw, offs)


def words_of(text: str | None) -> list[str]:
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    w = normalised(raw, np.array([0, len(raw)]))
    whole = w.strings()
    return [whole[a:b] for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]


def pair_hashes(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes[:-1] + mix(hashes[1:]))


class SuffixAutomaton:
    """Generalised suffix automaton over hashable symbols: ``add`` one sequence after the other."""

    __slots__ = ("next", "link", "length")

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, symbols) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for s in symbols:
            to = nexts[last].get(s)
            if to is not None and length[to] == length[last] + 1:
                last = to
                continue
            if to is None:
                new = len(nexts)
                nexts.append({})
                length.append(length[last] + 1)
                link.append(0)
                p = last
                while p >= 0 and s not in nexts[p]:
                    nexts[p][s] = new
                    p = link[p]
                last = new
                if p < 0:
                    continue
                q = nexts[p][s]
                if length[q] == length[p] + 1:
                    link[new] = q
                    continue
            else:
                p, q, new = last, to, -1
            clone = len(nexts)
            nexts.append(nexts[q].copy())
            length.append(length[p] + 1)
            link.append(link[q])
            link[q] = clone
            if new >= 0:
                link[new] = clone
            else:
                last = clone
            while p >= 0 and nexts[p].get(s) == q:
                nexts[p][s] = clone
                p = link[p]


class Matcher:
    """The automaton of some items, and the bitmap of their word pairs."""

    def __init__(self, items: list[tuple[int, str]], length: int, gram: int, coverage: float):
        self.length, self.gram, self.coverage = length, gram, coverage
        self.automaton, self.places = SuffixAutomaton(), defaultdict(set)
        self.stretches: dict[int, int] = {}
        self.bitmap = np.zeros(int(_MASK) + 1, bool)
        for k, (_, text) in enumerate(items):
            raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
            words, hashes = words_of(text), normalised(raw, np.array([0, len(raw)])).hashes()
            self.automaton.add(words)
            self.stretches[k] = len(words) - gram + 1
            for at in range(self.stretches[k]):
                self.places[tuple(words[at : at + gram])].add((k, at))
            if len(words) > 1:
                self.bitmap[(pair_hashes(hashes) & _MASK).astype(np.int64)] = True

    def lengths(self, words: list[str]) -> list[int]:
        """Length of the longest match that ends at each word."""
        nexts, link, length = self.automaton.next, self.automaton.link, self.automaton.length
        state = size = 0
        out = []
        for w in words:
            to = nexts[state].get(w)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nexts[state].get(w)
            if to is not None:
                state, size = to, size + 1
            out.append(size)
        return out

    def marks(self, w: Normal) -> np.ndarray:
        """For every word of the slice: is it to go?"""
        n = len(w)
        marked = np.zeros(n, bool)
        if n < self.gram:
            return marked
        near = self.bitmap[(pair_hashes(w.hashes()) & _MASK).astype(np.int64)]
        inner = w.first[1:-1]
        near[inner[(inner > 0) & (inner < n)] - 1] = False
        edges = np.flatnonzero(np.diff(np.concatenate(([False], near, [False])).astype(np.int8)))
        begin, end = edges[::2], edges[1::2] + 1  # words, end exclusive
        keep = end - begin >= self.gram
        begin, end = begin[keep], end[keep]
        if not len(begin):
            return marked
        whole, doc_of = w.strings(), np.searchsorted(w.first, begin, "right") - 1
        per_doc: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for a, b, d in zip(begin.tolist(), end.tolist(), doc_of.tolist(), strict=True):
            words = [whole[s:e] for s, e in zip(w.starts[a:b].tolist(), w.ends[a:b].tolist(), strict=True)]
            for i, size in enumerate(self.lengths(words)):
                if size >= self.length:
                    marked[a + i + 1 - self.length : a + i + 1] = True
                if size >= self.gram:
                    for item, at in self.places[tuple(words[i + 1 - self.gram : i + 1])]:
                        per_doc[d][item].append((at, a + i + 1 - self.gram))
        for items in per_doc.values():
            for item, found in items.items():
                if len({at for at, _ in found}) >= self.coverage * self.stretches[item]:
                    for _, at in found:
                        marked[at : at + self.gram] = True
        return marked


_built: dict[tuple, Matcher] = {}


def matcher(items: list[tuple[int, str]], *rules) -> Matcher:
    """Built once in each worker process."""
    key = (hash(tuple(items)), *rules)
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(items, *rules)
    return _built[key]


def dealt(benchmark: DataFrame, most_words: int) -> list[list[tuple[int, str]]]:
    """The items in lists of at most ``most_words`` words, one list at a time on the driver."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    lists, count = [[]], 0
    for item_id, text in rows.orderBy("item_id", "text").toLocalIterator():
        n = text.count(" ") + 1
        if count + n > most_words and lists[-1]:
            lists.append([])
            count = 0
        lists[-1].append((item_id, text))
        count += n
    return lists


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, gram: int = GRAM, coverage: float = COVERAGE, item_words: int = ITEM_WORDS) -> DataFrame:
    """(doc_id, start_word, end_word) of marked stretches, counted in normalised words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def pass_over(items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = matcher(items, length, gram, coverage)
            for part in slices(batches):
                w = normalised(*flat(part.column("text")))
                doc, begin, end = stretches(found.marks(w), w)
                ids = part.column("doc_id").to_numpy()[doc]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(begin - w.first[doc], pa.int32()), pa.array(end - w.first[doc], pa.int32())], schema=schema)

        return rows.mapInArrow(run, "doc_id long, start int, end int")

    passes = [pass_over(items) for items in dealt(benchmark, item_words)]
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    return merged(out)


def stretches(marked: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, begin, end) of each run of marked words; a run ends with its document."""
    edge = np.zeros(len(marked) + 1, bool)
    edge[w.first] = True
    before = np.concatenate(([False], marked)) & ~edge
    begin = np.flatnonzero(np.concatenate((marked, [False])) & ~before)
    after = np.concatenate((marked, [False])) & ~edge
    end = np.flatnonzero(np.concatenate(([False], marked)) & ~after)
    return np.searchsorted(w.first, begin, "right") - 1, begin, end


def decontaminated(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, gram: int = GRAM, coverage: float = COVERAGE, item_words: int = ITEM_WORDS) -> DataFrame:
    """``docs`` without the marked words; n_chars follows. All lists of items mark the words of
    the original text, which is cut once."""
    lists, rules = dealt(benchmark, item_words), (length, gram, coverage)
    names, has_count = docs.columns, "n_chars" in docs.columns

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Normal, np.ndarray]]:
        parts = slices(batches)
        if len(lists) > 1:  # held, so that each automaton is built once and sees the texts as they were
            parts = list(parts)
            marks = [np.zeros(0, bool)] * len(parts)
            for items in lists:
                found = matcher(items, *rules)
                for k, part in enumerate(parts):
                    more = found.marks(normalised(*flat(part.column("text"))))
                    marks[k] = marks[k] | more if len(marks[k]) else more
        for k, part in enumerate(parts):
            w = normalised(*flat(part.column("text")))
            yield part, w, marks[k] if len(lists) > 1 else matcher(lists[0], *rules).marks(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w, marks in marked(batches):
            doc, begin, end = stretches(marks, w)
            if len(doc):
                known = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                texts, keep, whole, offs = part.column("text").to_pylist(), np.ones(part.num_rows, bool), w.text, w.offs
                changed = np.zeros(part.num_rows, bool)
                for d in np.unique(doc).tolist():
                    if not known[d]:
                        continue
                    at, kept, left = offs[d], [], w.counts[d]
                    for a, b in zip(begin[doc == d].tolist(), end[doc == d].tolist(), strict=True):
                        kept.append(whole[at : w.starts[a]])
                        at = w.starts[b] if b < w.first[d + 1] else offs[d + 1]
                        left -= b - a
                    texts[d], changed[d], keep[d] = "".join([*kept, whole[at : offs[d + 1]]]), True, left > 0
                columns = dict(zip(names, part.columns, strict=True))
                columns["text"] = pa.array(texts, pa.string())
                if has_count:
                    sizes = [len(t) if c else n for t, c, n in zip(texts, changed, part.column("n_chars").to_pylist(), strict=True)]
                    columns["n_chars"] = pa.array(sizes, part.column("n_chars").type)
                part = pa.RecordBatch.from_arrays(list(columns.values()), names=names).filter(pa.array(keep))
            yield part

    return docs.mapInArrow(run, docs.schema)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def contamination_sql(length: int = LENGTH, gram: int = GRAM, coverage: float = COVERAGE) -> str:
    words = "regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+')"
    return f"""
WITH dw AS (SELECT DISTINCT doc_id, {words} AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, text, {words} AS ws FROM benchmark WHERE text IS NOT NULL),
dg AS (SELECT doc_id, i, list_slice(ws, i + 1, i + {gram}) AS g FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - {gram} + 1)) AS i FROM dw WHERE len(ws) >= {gram})),
bg AS (SELECT item_id, text, i, n, list_slice(ws, i + 1, i + {gram}) AS g FROM (SELECT item_id, text, ws, len(ws) - {gram} + 1 AS n, unnest(range(0, len(ws) - {gram} + 1)) AS i FROM bw WHERE len(ws) >= {gram})),
hit AS (SELECT dg.doc_id, dg.i AS di, bg.item_id, bg.text, bg.i AS bi, bg.n FROM dg JOIN bg USING (g)),
cov AS (SELECT doc_id, item_id, text FROM hit GROUP BY doc_id, item_id, text, n HAVING count(DISTINCT bi) >= {coverage} * n),
d13 AS (SELECT doc_id, i, list_slice(ws, i + 1, i + {length}) AS g FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - {length} + 1)) AS i FROM dw WHERE len(ws) >= {length})),
b13 AS (SELECT DISTINCT list_slice(ws, i + 1, i + {length}) AS g FROM (SELECT ws, unnest(range(0, len(ws) - {length} + 1)) AS i FROM bw WHERE len(ws) >= {length})),
s AS (SELECT doc_id, i AS s, i + {length} AS e FROM d13 JOIN b13 USING (g)
      UNION SELECT doc_id, di, di + {gram} FROM hit JOIN cov USING (doc_id, item_id, text)),
b AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s),
k AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e) AS island FROM b)
SELECT doc_id, CAST(min(s) AS INTEGER) AS start_word, CAST(max(e) AS INTEGER) AS end_word FROM k GROUP BY doc_id, island
"""


QUERIES = {"op10_decontamination": op10_decontamination}
SQL = {"op10_decontamination": contamination_sql()}
