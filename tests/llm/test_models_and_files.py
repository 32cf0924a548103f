"""Operators 2, 4, 5 and 6, and the pipeline's stages."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from loomspark.llm import chat, neighbours, quality, tokenfiles

SF = "/root/testdata/sf0.01"


# quality ---------------------------------------------------------------------------------
def brute_isotonic(scores, labels):
    """Min-max formula over distinct scores."""
    values = sorted(set(scores))
    mean = lambda a, b: np.mean([y for s, y in zip(scores, labels) if values[a] <= s <= values[b]])
    return {v: max(min(mean(a, b) for b in range(k, len(values))) for a in range(k + 1)) for k, v in enumerate(values)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 1)), min_size=1, max_size=20))
def test_isotonic(rows):
    scores, labels = np.array([float(s) for s, _ in rows]), np.array([float(y) for _, y in rows])
    knots, levels = quality.isotonic(scores, labels)
    for v, want in brute_isotonic(scores, labels).items():
        assert np.interp(v, knots, levels) == pytest.approx(want)


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    got = quality.scored(docs, model).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (got.keep == ((got.quality == 1) & (got.toxic == 0))).mean() > 0.93
    odd = spark.createDataFrame([(1, None, 1.0), (1, None, 1.0), (None, "Plain words, of a sort.", 2.0), (2, "", 3.0), (3, "\n\t ", 3.0), (4, "word " * 40_000, 3.0)], "doc_id long, text string, score double")
    rows = quality.scored(odd, model).collect()
    assert len(rows) == 6 and all(not r.keep and r.good == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert quality.kept(odd, model).columns == odd.columns
    assert quality.scored(odd.limit(0), model).count() == 0


def test_labels_of_one_kind_or_none(spark):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(6)] + [(None, "x")], "doc_id long, text string")
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    good = lambda labels: {r.good for r in quality.scored(docs, quality.fit(docs, labels)).collect()}
    assert good(make([])) == {1.0}
    assert good(make([(0, 1, None), (1, 1, 0), (None, 0, 0), (2, None, 0)])) == {1.0}
    assert good(make([(0, 0, 0)])) == {0.0}


def test_normal_equations_equal_a_direct_solve(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    sample = quality.sampled(docs, labels).where("not held_").toPandas()
    raw = [t.encode() for t in sample.text]
    stats = np.concatenate([quality.statistics(np.frombuffer(r, np.uint8), np.array([0, len(r)]), model.toxic_words) for r in raw])
    z, y = model.cosines(stats), sample.good_.to_numpy(float) * 2 - 1
    w = np.linalg.solve(z.T @ z + quality.RIDGE * len(y) * np.eye(z.shape[1]) / quality.FEATURES, z.T @ y)
    assert np.abs(z @ w - z @ model.weights).max() < 1e-4


# neighbours ------------------------------------------------------------------------------
@pytest.mark.parametrize("top", [neighbours.TOP, 1])
def test_recall_over_several_cells(spark, monkeypatch, top):
    monkeypatch.setattr(neighbours, "VISITS", 64)
    monkeypatch.setattr(neighbours, "PAIRS", 128)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(300, 24)), rng.normal(size=(20, 24)).repeat(15, axis=0) + rng.normal(size=(300, 24)) * 0.05]).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(600), "embedding": x.tolist(), "cell": 1}), "vec_id long, embedding array<float>, cell int")
    got = neighbours.neighbours(df, k=5, cell=100, top=top).toPandas()
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = {i: set(np.argsort(d[i], kind="stable")[:5].tolist()) for i in range(600)}
    held = got.groupby("vec_id").neighbour_id.apply(set)
    assert len(got) == 3000 and sum(len(held[i] & want[i]) for i in range(600)) / 3000 >= 0.9
    assert np.allclose(got.distance, [d[a, b] for a, b in zip(got.vec_id, got.neighbour_id)], atol=1e-5)


def test_one_query_in_fifty_against_all_vectors(spark, tmp_path):
    """The registered query: its rows are the queries alone, and their neighbours come from every row."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    ids = np.arange(1500) * 5 - 500
    spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": x.tolist()}), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = neighbours.op4_neighbours(spark, str(tmp_path)).toPandas()
    several = neighbours.neighbours(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), cell=100, every=50).toPandas()
    asked = ids[ids % 50 == 0]
    d = np.sqrt(((x[ids % 50 == 0, None].astype(float) - x[None]) ** 2).sum(-1))
    d[ids[None] == asked[:, None]] = np.inf
    want = {(int(q), int(n)) for q, row in zip(asked, d) for n in ids[np.argsort(row, kind="stable")[:10]]}
    for found in (got, several):
        assert set(found.vec_id) == set(asked.tolist()) and len(found) == 10 * len(asked)
        assert len(want & set(zip(found.vec_id, found.neighbour_id))) >= 0.9 * len(want)
    assert any(n % 50 for n in got.neighbour_id)


def test_boxes_within_reach():
    rng = np.random.default_rng(4)
    points, z = rng.normal(size=(500, 3)), rng.normal(size=(40, 3))
    splits = neighbours.Splits(points, 4)
    at = splits.cell(points)
    cells = np.unique(at)[:-1]  # a cell may be empty
    low, high = (np.stack([f(points[at == c], axis=0) for c in cells]) for f in (np.min, np.max))
    most = rng.uniform(0, 2, 40)
    got = {(int(r), int(c)) for rows, found in neighbours.Boxes(4, cells, low, high).within(z, most, pairs=7) for r, c in zip(rows, found)}
    far = neighbours.box_distances(z, low, high)
    assert got == {(r, int(cells[c])) for r in range(40) for c in range(len(cells)) if far[r, c] < most[r]}


def test_many_equal_and_long_vectors(spark):
    """More copies of one vector than a cell holds, and vectors of 3,000 numbers."""
    rows = [(i, [1.0] * 3000) for i in range(90)] + [(100 + i, [float(i + 2)] * 3000) for i in range(5)]
    got = neighbours.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3, cell=20).toPandas()
    assert len(got) == 95 * 3
    assert got[got.vec_id == 50].neighbour_id.tolist() == [0, 1, 2] and (got[got.vec_id < 90].distance == 0).all()
    assert got[got.vec_id == 104].neighbour_id.tolist() == [103, 102, 101]


def test_odd_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [float("nan"), 1.0]), (7, [1.0]), (None, [0.0, 0.0]), (8, [None, 1.0]), (9, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.vec_id, r["rank"], r.neighbour_id, r.distance) for r in neighbours.neighbours(df).orderBy("vec_id", "rank").collect()]
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 1.0), (2, 1, 3, 0.0), (2, 2, 1, 1.0), (3, 1, 2, 0.0), (3, 2, 1, 1.0)]
    assert neighbours.neighbours(df.limit(0)).count() == 0


def test_chi_square_quantile():
    rng = np.random.default_rng(3)
    draws = (rng.normal(size=(200_000, 8)) ** 2).sum(axis=1)
    assert (draws <= neighbours.chi2_quantile(0.95)).mean() == pytest.approx(0.95, abs=0.003)


# token files -----------------------------------------------------------------------------
def test_round_trip_and_offsets(spark):
    rows = [(1, "The cat sat."), (2, None), (None, "é <|endoftext|> x"), (3, ""), (1, "The cat sat."), (4, "long " * 20_000)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, part int").repartition(3)
    out, folder = tokenfiles.token_files(df)
    got, files, enc = out.collect(), tokenfiles.TokenFiles(f"{folder}/files"), tokenfiles.encoder()
    assert len(got) == 6 and files.meta["docs"] == 6 and files.meta["dtype"] == "<u2"
    want = {i: t or "" for i, t in rows}
    for r in got:
        assert enc.decode(files.document(r["part"], r["doc"]).tolist()) == want[r.doc_id]
    order = sorted(got, key=lambda r: (r["part"], r["doc"]))
    assert order[0].start_token == 0 and all(a.end_token == b.start_token for a, b in zip(order, order[1:])) and order[-1].end_token == files.meta["ids"]
    empty, _ = tokenfiles.token_files(df.limit(0))
    assert empty.count() == 0


def test_a_second_run_never_reads_the_first_ones_files(spark, tmp_path):
    """The first run dies before its listing; the second writes other documents into the folder."""
    folder = str(tmp_path / "tokens")
    one = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta")], "doc_id long, text string").repartition(1)
    tokenfiles.write_tokens(one, f"file://{folder}/files").write.format("noop").mode("overwrite").save()
    for rows in ([(7, "one")], [(8, "two three"), (9, None)]):
        two, where = tokenfiles.token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(1), folder)
        files = tokenfiles.TokenFiles(f"{where}/files")
        got = {r.doc_id: tokenfiles.encoder().decode(files.document(r["part"], r["doc"]).tolist()) for r in two.collect()}
        assert got == {i: t or "" for i, t in rows} and files.meta["docs"] == len(rows)


# chat ------------------------------------------------------------------------------------
@settings(max_examples=80, deadline=None)
@given(st.text(max_size=20) | st.sampled_from(["<|start|>", "a<\\|end|>b", "<\\\\|bos|><|x|>", "<|head|><|head|>"]))
def test_escape_is_reversible_and_complete(text):
    text = text.encode("utf-8", "ignore").decode()
    assert chat.unescaped(chat.escaped(text)) == text
    assert not any(c in chat.escaped(text) for c in chat.CONTROL)


def test_assembly_against_a_loop(spark):
    enc, ids = tokenfiles.encoder(), chat.reserved()
    bos, start, head, end = (ids[c] for c in chat.CONTROL)
    rows = [(1, 0, "system", "Be brief."), (1, 2, "assistant", "Yes <|end|>!"), (1, 1, "user", "Hi"), (2, None, None, None), (2, 0, "assistant", ""), (None, 0, "user", "x"), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, 0, "assistant", "w " * 9000)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, turns int")
    got = {r.conv_id: r for r in chat.chats(df).collect()}
    by = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((r or "user", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        want, mask = [bos], [0]
        for role, text in turns:
            for part, on in (([start, *enc.encode_ordinary(role), head], 0), (enc.encode_ordinary(chat.escaped(text)), 1), ([end], 1)):
                want += part
                mask += [int(on and role == "assistant")] * len(part)
        assert got[c].ids == want and list(got[c]["mask"]) == mask and got[c].n_tokens == len(want)
    assert got[1].escaped == 1 and got[3].n_turns == 2
    assert chat.chats(df.limit(0)).count() == 0


# pipeline --------------------------------------------------------------------------------
def test_pipeline_stages_follow_each_other(spark):
    """Each stage's rows against its own operator applied to what the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    labels = docs.sparkSession.read.parquet(f"{SF}/labels.parquet").toPandas()
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "test-stage")
        sizes.append(docs.count())
        if stage is not corpus_pipeline.encoding:
            assert docs.columns == names
        if stage is corpus_pipeline.classify:
            good = set(labels[(labels.quality == 1) & (labels.toxic == 0)].doc_id)
            kept = {r.doc_id for r in docs.select("doc_id").collect()}
            assert len(good & kept) / len(good) > 0.95
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and sizes[2] < sizes[1]
    rows = docs.collect()
    assert all(r.exact and r.n_tokens == len(r.ids) for r in rows)
    assert random.Random(1).sample(rows, 1)[0].n_tokens > 0
