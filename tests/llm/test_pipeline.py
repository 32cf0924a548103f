"""Every stage of the pipeline against a brute-force version, on real and odd rows."""

import itertools
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from loomspark.llm import pieces, quality, simhash
from tests.llm.test_text_dedup import ITEMS, brute_marks, brute_repeats

SF = "/root/testdata/sf0.001"
CLASHES = "key_ string, tag string, cuts_ int, score double, h long"


def flat(text):
    raw = (text or "").encode()
    return np.frombuffer(raw, np.uint8), np.array([0, len(raw)])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents, labels and benchmark of the smallest scale, with odd rows added."""
    out = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    long = max(texts.values(), key=len)
    odd = [(9001, None), (9002, ""), (9003, " \n\t "), (None, texts[0]), (None, None), (9004, texts[1]), (9004, texts[1]), (9005, long + " " + long), (9006, "x" * 30_000), (9007, texts[2] + " " + ITEMS[0][1] + " " + texts[3]), (9008, ITEMS[1][1]), (0, texts[0])]
    rows = spark.createDataFrame([(i, t, "en", "web", 0) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    whole = docs.unionByName(rows.select(*[rows[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns]))
    extra = [c.split() for c in CLASHES.split(", ")]
    whole.selectExpr("*", *[f"cast(1 as {kind}) as {name}" for name, kind in extra]).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{out}/labels.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bench.unionByName(spark.createDataFrame(ITEMS, "item_id long, text string").select(*[c for c in bench.columns])).write.parquet(f"{out}/benchmark.parquet")
    return out


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_every_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before, held = docs, pairs(docs) if "text" in docs.columns else None
        docs = corpus_pipeline.stored(stage(spark, docs, folder), "test-stage")
        after[name] = (before, held, docs)
        if stage is not corpus_pipeline.encoding:
            assert docs.columns == names
    # 2: each text scored by itself
    before, held, kept = after["quality classifier"]
    model = quality.fit(before, spark.read.parquet(f"{folder}/labels.parquet"))
    good = lambda t: model.score(quality.statistics(*flat(t), model.toxic_words))[1][0] >= quality.CUT
    assert pairs(kept) == Counter({k: n for k, n in held.items() if good(k[1])})
    # 3: all pairs
    before, held, kept = after["SimHash near-dedup"]
    rows = sorted({(i, t) for i, t in held if i is not None and t is not None})
    prints = [simhash.fingerprints_of(*flat(t)) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, (i, s)), (b, (j, t)) in itertools.combinations(enumerate(rows), 2):
        if s == t or (prints[a][1][0] and prints[b][1][0] and simhash.near(prints[a][0][0], prints[b][0][0])):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    assert pairs(kept) == Counter({k: n for k, n in held.items() if k[0] is None or k[1] is None or find(k[0]) == k[0]})
    # 7 and 10: words that are marked go
    for name, marks in (("suffix-array dedup", None), ("benchmark decontamination", spark.read.parquet(f"{folder}/benchmark.parquet"))):
        before, held, kept = after[name]
        want = Counter()
        if marks is None:
            gone = brute_repeats(list(held), 50)
            for (i, t), n in held.items():
                left = [w for p, w in enumerate((t or "").split()) if (i, p) not in gone]
                want[i, " ".join(left)] += n if left or t is None or i is None or not t.split() else 0
            assert Counter({(i, " ".join((t or "").split())): n for (i, t), n in pairs(kept).items()}) == +want
        else:
            items = [(r.item_id, r.text) for r in marks.collect() if r.text]
            from loomspark.llm.decontaminate import words_of

            for (i, t), n in held.items():
                gone = brute_marks(t, items) if i is not None and t else set()
                left = [w for p, w in enumerate(words_of(t)) if p not in gone]
                want[i, " ".join(left)] += n if left or not gone else 0
            assert Counter({(i, " ".join(words_of(t))): n for (i, t), n in pairs(kept).items()}) == +want
    # 8: the library
    import sentencepiece

    before, held, out = after["SentencePiece encoding"]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = Counter((r.doc_id, tuple(r.ids)) for r in out.collect())
    assert got == Counter({k: n for k, n in ((k, n) for k, n in _encoded(library, held).items())}) and sum(got.values()) == before.count()


def _encoded(library, held):
    out = Counter()
    for (i, t), n in held.items():
        out[i, tuple(library.encode(t))] += n
    return out


def test_stages_on_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
    kept = pairs(corpus_pipeline.classify(spark, docs, str(tmp_path)))
    assert kept == Counter({k: n for k, n in pairs(docs).items() if (k[1] or "").split()})  # nothing is known: all with words stay
    assert pairs(corpus_pipeline.decontamination(spark, docs, str(tmp_path))) == pairs(docs)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
