"""Operators 7, 9, 10 and 3 on small tables, against brute force."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm import decontaminate, lsm_dedup, simhash, suffix_dedup, windows
from loomspark.llm.textops import Words, prefix, span_hash

SCHEMA = "doc_id long, text string, h long, src long, cuts_ string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA)


def corpus(seed=1):
    rng = random.Random(seed)
    words = lambda n: [rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + str(rng.randint(0, 40)) for _ in range(n)]
    passage, other = words(70), words(55)
    rows = [(i, " ".join(words(rng.randint(1, 160)))) for i in range(12)]
    rows += [(20 + i, " ".join(words(20) + passage + words(i))) for i in range(4)]
    rows += [(30, " ".join(passage[5:62])), (31, " ".join(passage[:49])), (32, "\n".join(other) + "  " + " ".join(other)), (33, " ".join(words(10) + other)), (34, "same " * 300), (35, "same\tsame " * 40)]
    rows += [(40, rows[3][1]), (41, rows[3][1]), (41, rows[3][1]), (50, None), (None, rows[3][1]), (51, ""), (52, "   "), (53, "x" * 50_000), (54, " ".join(words(9000)))]
    return rows


def brute_repeats(rows, window):
    docs = sorted({(i, t) for i, t in rows if i is not None and t is not None})
    seen, hit = set(), defaultdict(set)
    places = sorted((i, p, tuple(t.split()[p : p + window])) for i, t in docs for p in range(len(t.split()) - window + 1))
    for i, p, w in places:
        if w in seen:
            hit[i].update(range(p, p + window))
        seen.add(w)
    return {(i, p) for i, ps in hit.items() for p in ps}


def covered(rows):
    return {(r["doc_id"], p) for r in rows for p in range(r["start_word"], r["end_word"])}


def test_suffix_dedup_is_exact(spark):
    rows = corpus()
    df = table(spark, rows)
    got = suffix_dedup.repeated_spans(df).collect()
    assert covered(got) == brute_repeats(rows, 50)
    cleaned = suffix_dedup.remove_spans(df, suffix_dedup.repeated_spans(df))
    assert cleaned.columns == df.columns
    left = {(r.doc_id, r.text) for r in cleaned.collect()}
    assert (50, None) in left and (None, rows[3][1]) in left and (3, rows[3][1]) in left
    assert not any(i in (40, 41) for i, _ in left) or len(rows[3][1].split()) < 50
    assert suffix_dedup.repeated_spans(df.limit(0)).count() == 0
    assert not brute_repeats([(r.doc_id, r.text) for r in cleaned.collect()], 50) & {(i, 0) for i in (21, 22, 23)}


def test_texts_of_one_doc_id_keep_their_own_words(spark):
    rng = random.Random(6)
    a, b = (" ".join(f"{k}{rng.randint(0, 900)}" for _ in range(80)) for k in "ab")
    rows = [(1, a), (2, a), (2, b), (3, b + " " + a)]
    docs = table(spark, rows)
    for spans in (suffix_dedup.repeated_spans(docs), lsm_dedup.incremental_spans(docs, batches=2)):
        left = sorted((r.doc_id, r.text) for r in suffix_dedup.remove_spans(docs, spans).collect())
        assert left == [(1, a), (2, b)]
    assert suffix_dedup.remove_spans(docs, suffix_dedup.repeated_spans(docs).limit(0)).count() == 4


def test_lsm_dedup_is_exact_in_any_number_of_batches(spark):
    rows = corpus(2)
    df = table(spark, rows)
    assert covered(lsm_dedup.incremental_spans(df, batches=4).collect()) == brute_repeats(rows, 50)
    assert lsm_dedup.incremental_spans(df.limit(0)).count() == 0


def test_lsm_index_reopens_and_refuses_late_documents(spark):
    rows = [(i, t) for i, t in corpus(3) if i is not None and i < 40]
    df = table(spark, rows)
    index = lsm_dedup.FingerprintIndex(spark)
    index.ingest(df.where("doc_id < 22"), df)
    again = lsm_dedup.FingerprintIndex.open(spark, index.folder)
    assert again.high == index.high and len(again.runs) == 1
    spans = again.ingest(df.where("doc_id >= 22"), df).collect()
    assert covered(spans) == {x for x in brute_repeats(rows, 50) if x[0] >= 22}
    with pytest.raises(ValueError):
        again.ingest(df.where("doc_id = 5"), df)
    assert again.ingest(df.limit(0), df).count() == 0


def test_lsm_levels_and_crashes(spark, monkeypatch):
    """Runs of one level are merged, older and larger ones stay; a crash leaves an index that opens."""
    rows = [(i, t) for i, t in corpus(3) if i is not None and t and i < 40]
    df, want = table(spark, rows), brute_repeats(rows, 50)
    index, got = lsm_dedup.FingerprintIndex(spark, fanout=2), set()
    history = spark.createDataFrame([*rows, (None, "no id"), (1, None)], "doc_id long, text string")
    for k, (low, high) in enumerate([(0, 4), (4, 8), (8, 21), (21, 24), (24, 34)]):
        batch = df.where(f"doc_id >= {low} and doc_id < {high}")
        if k == 3:  # dies while runs are merged: the new run is written, the manifest isn't
            drop, manifest, calls = index._drop, index._manifest, []

            def dies():
                calls.append(1)
                if len(calls) > 1:
                    raise OSError("lost")
                manifest()

            monkeypatch.setattr(index, "_manifest", dies)
            with pytest.raises(OSError):
                index.ingest(batch, history)
            index = lsm_dedup.FingerprintIndex.open(spark, index.folder)
            assert index.high == 23 and [v for _, v in index.runs] == [1, 0, 0]
            got |= {x for x in want if 21 <= x[0] < 24}
            continue
        got |= covered(index.ingest(batch, history).collect())
    assert [v for _, v in index.runs] == [2, 0] or [v for _, v in index.runs] == [1, 1, 0] or [v for _, v in index.runs] == [2]
    assert got == {x for x in want if x[0] < 34}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=90), max_size=12), st.sampled_from([8, 16, 48]))
def test_deep_shallow_order(strings, shallow):
    raw = "".join(strings).encode()
    ends = np.cumsum([len(s) for s in strings], dtype=np.int64) if strings else np.zeros(0, np.int64)
    starts = ends - np.array([len(s) for s in strings], np.int64)
    order, same = suffix_dedup.deep_shallow(np.frombuffer(raw, np.uint8), starts, ends, shallow)
    got = [strings[i] for i in order]
    assert got == sorted(strings)
    assert [bool(x) for x in same] == [i > 0 and got[i] == got[i - 1] for i in range(len(got))]


def test_words_and_hashes():
    text = "a b\n a  b\tc".encode()
    w = Words(np.frombuffer(text, np.uint8), np.array([0, 4, len(text)]))
    assert w.counts.tolist() == [2, 3]
    h = w.hashes()
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3
    sums = prefix(h)
    assert span_hash(sums, np.array([0]), np.array([2]))[0] == span_hash(sums, np.array([2]), np.array([4]))[0]


def test_every_window_has_one_anchor():
    text = " ".join(f"w{i % 37}" for i in range(300)).encode()
    got = windows.anchors_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert sorted(p for a, b in zip(got["lo"], got["hi"]) for p in range(a, b + 1)) == list(range(251))


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen."), (2, "alpha beta gamma delta epsilon zeta eta theta"), (3, None), (4, "short one"), (5, "")]


def brute_marks(text, items, length=13, gram=6, coverage=0.6):
    words = decontaminate.words_of(text)
    marks = set()
    for _, item in items:
        iw = decontaminate.words_of(item)
        for n, rule in ((length, "length"), (gram, "gram")):
            grams = [tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)]
            at = [p for p in range(len(words) - n + 1) if tuple(words[p : p + n]) in set(grams)]
            found = sum(g in {tuple(words[p : p + n]) for p in at} for g in grams)
            if rule == "length" or (grams and found >= coverage * len(grams)):
                marks |= {p + k for p in at for k in range(n)}
    return marks


def test_decontamination(spark):
    body = "x y z " * 30
    rows = [(1, body + "ONE, two; three four five six seven eight nine ten eleven twelve thirteen" + body), (2, "alpha beta gamma delta epsilon zeta eta theta"), (3, body + " alpha beta gamma delta epsilon zeta " + body), (4, "two three four five six seven"), (5, None), (None, ITEMS[0][1]), (6, ""), (7, "é" * 9000), (8, body), (1, body), (9, "Ünö one two three four five six. alpha beta gamma delta epsilon zeta eta")]
    docs, bench = table(spark, rows), spark.createDataFrame(ITEMS, "item_id long, text string")
    for most in (decontaminate.ITEM_WORDS, 10):  # one automaton, or several passes
        got = covered(decontaminate.contaminated_spans(docs, bench, item_words=most).collect())
        assert got == {(i, p) for i, t in rows if i is not None and t for p in brute_marks(t, ITEMS)}
    out = decontaminate.decontaminated(docs, bench)
    left = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == docs.columns and 2 not in [i for i, _ in left]
    assert (5, None) in left and (None, ITEMS[0][1]) in left and (4, rows[3][1]) in left and (8, body) in left
    assert decontaminate.contaminated_spans(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated_spans(docs, bench.limit(0)).count() == 0


def test_words_of_any_script_against_sql(spark, tmp_path):
    """Capitals, curly quotes and dashes outside ASCII, by the operator and by its SQL."""
    import duckdb

    item = "«Привет, мир» — сказал “Иван”, и ушёл домой быстро; потом вернулся ночью опять один"
    items = [(1, item), (2, "Ça va bien — très “bien” aujourd’hui, École d’été à Paris"), (3, "e\u0301te\u0301 ΑΒΓ αβγ ΣΑΣ one two three")]
    rows = [(1, "x " + item.upper() + " y"), (2, item.replace(" — ", "—").replace("“", '"')), (3, "ça VA bien très bien aujourd hui école d été à paris"), (4, "E\u0301TE\u0301 αβγ αβγ one,two"), (5, "İstanbul ßẞ ﬁ １２ 𝔄"), (6, "nothing here"), (7, None)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontaminate.contaminated_spans(docs, bench).collect()))
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("benchmark", bench.toPandas())
    assert got == sorted(con.execute(decontaminate.contamination_sql()).fetchall()) and {1, 2, 3} <= {r[0] for r in got}
    left = {r.doc_id: r.text for r in decontaminate.decontaminated(docs, bench).collect()}
    assert left[1] == "x «y" and 3 not in left and left[5] == rows[4][1]


def test_near_groups_against_all_pairs(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(4, 9))) for _ in range(3000)]
    base = [rng.choices(vocab, k=rng.randint(80, 200)) for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i in range(30):
        w = list(base[i])
        for _ in range(len(w) // 40):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, rows[50][1]) for i in range(40)] + [(300, None), (None, rows[1][1]), (301, ""), (302, ""), (303, "a b"), (304, "a b"), (305, "of the"), (5, rows[5][1]), (306, "long " * 30000)]
    got = {r.doc_id: r.group_id for r in simhash.near_groups(table(spark, rows)).collect()}
    fp, has = zip(*[(p[0], h[0]) for p, h in [simhash.fingerprints_of(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())])) for _, t in rows]])
    root = {i: i for i, t in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, (i, s)), (b, (j, t)) in itertools.combinations(enumerate(rows), 2):
        if i is None or j is None or s is None or t is None:
            continue
        if s == t or (has[a] and has[b] and simhash.near(fp[a], fp[b])):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    sizes = defaultdict(int)
    for i in root:
        sizes[find(i)] += 1
    want = {i: find(i) for i in root if sizes[find(i)] > 1}
    assert len(want) > 90 and sum(got.get(i) == g for i, g in want.items()) >= 0.95 * len(want) and set(got) <= set(want)
    kept = [r.doc_id for r in simhash.keep_one(table(spark, rows), simhash.near_groups(table(spark, rows))).collect()]
    assert None in kept and 300 in kept and 305 in kept and 304 not in kept and 50 in kept and 200 not in kept
    assert simhash.near_groups(table(spark, rows).limit(0)).count() == 0


def test_pivot_table_only_discards_what_is_far():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 63, (300, 4), dtype=np.uint64)
    prints[1::2] = prints[::2] ^ np.uint64(5)
    table_ = np.stack([simhash.distances(prints[:, :2], p[:2]) for p in prints[:20]], axis=1).astype(np.int16)
    a, b, formed, let = simhash.pairs_in(np.zeros(300, np.int64), prints, table_, 28, 36)
    assert formed == 300 * 299 // 2 and let < formed
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if simhash.near(prints[i], prints[j])}
    assert set(zip(a.tolist(), b.tolist())) == want


def test_pairs_within_a_group_are_not_formed_again():
    """Copies that are one group already, and words in common without their order, cost no pairs of copies."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (6, 4), dtype=np.uint64)
    prints = np.repeat(base, [300, 40, 1, 1, 1, 1], axis=0)
    prints[:, :2] = base[0, :2]  # the same words, six orders
    prints[:, 1] ^= rng.integers(0, 1 << 10, len(prints), dtype=np.uint64)
    key, group = np.repeat([7, 8], [342, 2]), np.repeat(np.arange(6), [300, 40, 1, 1, 1, 1])
    table_ = np.stack([simhash.distances(prints[:, :2], p[:2]) for p in prints[:5]], axis=1).astype(np.int16)
    all_a, all_b, formed, _ = simhash.pairs_in(key, prints, table_, 28, 36)
    a, b, fewer, _ = simhash.pairs_in(key, prints, table_, 28, 36, group=group)
    assert formed == 342 * 341 // 2 + 1 and fewer == 300 * 42 + 40 * 2 + 1 + 1 and len(a) == len(b) == 0
    assert len(all_a) == 300 * 299 // 2 + 40 * 39 // 2 == len(set(zip(all_a.tolist(), all_b.tolist())))
    alone = np.arange(len(key))
    root = simhash.grouped(alone, *simhash.led(key, alone, prints, 28, 36, 1))
    assert len(np.unique(root[:342])) < 342 and {tuple(np.unique(group[root == r])) for r in root} == {(g,) for g in range(6)}
    again = simhash.pairs_in(key, prints, table_, 28, 36, group=alone)
    assert set(zip(*map(np.ndarray.tolist, again[:2]))) == set(zip(all_a.tolist(), all_b.tolist()))


def test_sub_band_keys_keep_every_bit():
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    none = np.zeros(64, np.uint64)
    assert len(set(simhash.sums_of(one, none).tolist()) | set(simhash.sums_of(none, one).tolist()) | {0}) == 129
    assert len(set(simhash.sums_of(one[:, None], one[None]).ravel().tolist())) == 64 * 64


@pytest.mark.parametrize("count", [100, 10_000, 240_000, 14_000_000, 1_000_000_000, 100_000_000_000])
def test_recall_at_the_threshold_stays_as_the_corpus_grows(count):
    rng = np.random.default_rng(9)
    one = rng.integers(0, 1 << 63, (800, 4), dtype=np.uint64)
    flips = [rng.choice(simhash.BITS, simhash.MOST, replace=False).tolist() for _ in one]
    two = one.copy()
    two[:, :2] ^= simhash.masks_of(flips)
    assert (simhash.distances(one[:, :2], two[:, :2]) == simhash.MOST).all()
    coarse, fine = simhash.band_masks(*simhash.band_plan(count))
    met = np.zeros(len(one), bool)
    for band, subs in zip(coarse, fine, strict=True):
        routed = simhash.keys_of(one, band) == simhash.keys_of(two, band)
        met |= routed & (simhash.keys_of(one[:, None], subs) == simhash.keys_of(two[:, None], subs)).any(axis=1)
    assert met.mean() >= 0.9
    bands, route, _, _ = simhash.band_plan(count)
    assert count >> route <= 2 * simhash.BUCKET and bands <= 500


@pytest.mark.parametrize("hold", [simhash.HOLD, 50])
def test_pairs_at_the_threshold_are_found_when_bands_are_wide(spark, monkeypatch, hold):
    monkeypatch.setattr(simhash, "HOLD", hold)
    rng = np.random.default_rng(10)
    one = rng.integers(0, 1 << 63, (300, 4), dtype=np.uint64)
    two = one.copy()
    two[:, :2] ^= simhash.masks_of([rng.choice(simhash.BITS, simhash.MOST, replace=False).tolist() for _ in one])
    rows = [(2 * i + k, *map(int, p.view(np.int64))) for i, ps in enumerate(zip(one, two, strict=True)) for k, p in enumerate(ps)]
    plan = simhash.band_plan
    monkeypatch.setattr(simhash, "band_plan", lambda count, *more: plan(14_000_000, *more))
    got = {(r.src, r.dst) for r in simhash.near_edges(spark.createDataFrame(rows, "doc_id long, f0 long, f1 long, f2 long, f3 long")).collect()}
    assert got <= {(2 * i + 1, 2 * i) for i in range(300)} and len(got) >= 0.9 * 300


def test_several_automata_cut_what_one_cuts(spark):
    shared = [f"w{i}" for i in range(13)]
    items = [(1, " ".join([*shared, *(f"a{i}" for i in range(10))])), (2, " ".join([*shared, *(f"b{i}" for i in range(9))])), *ITEMS]
    rows = [(1, f"before {items[1][1]} after"), (2, items[0][1]), (3, "x y " + " ".join(shared)), (4, f"{items[0][1]} {items[1][1]}"), (5, None), (None, items[1][1]), (6, "z " * 40)]
    docs, bench = table(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    cut = lambda most: sorted(((r.doc_id, r.text) for r in decontaminate.decontaminated(docs, bench, item_words=most).collect()), key=repr)
    assert cut(10) == cut(decontaminate.ITEM_WORDS) and (1, "before after") in cut(10)
