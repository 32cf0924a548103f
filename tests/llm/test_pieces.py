import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm import pieces as m

sentencepiece = pytest.importorskip("sentencepiece")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=m.MODEL)
PIECES = m.load()


def ids_of(texts):
    ids, offs = m.encode(PIECES, pa.array(texts, pa.string()))
    return [ids[offs[i] : offs[i + 1]].tolist() for i in range(len(texts))]


ODD = ["", " ", "  a", "Hello  world\nFoo bar\t café ﬁ 🎉 ", "\n\n\na   b    ", "a" * 300, "日本語テキスト", "x\x00y", " " * 37 + "z", "word " * 20000, "x" * 3000, "a\r\n\r\nb", "▁x▁"]


def test_ids_are_the_librarys():
    assert ids_of(ODD) == [LIBRARY.encode(t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30) | st.text("aeth inor.\n", max_size=60), min_size=1, max_size=5))
def test_random_texts(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert ids_of(texts) == [LIBRARY.encode(t) for t in texts]


def test_colliding_words_have_their_own_ids():
    """Thue-Morse words have equal polynomial hashes modulo 2**64, whatever the base."""
    for n in (512, 1024, 2048):
        one = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
        two = one.translate(str.maketrans("ab", "ba"))
        assert ids_of([one, two, f"x {two} {one}"]) == [LIBRARY.encode(t) for t in (one, two, f"x {two} {one}")]


def test_decoding_gives_the_text_again():
    texts = [t for t in ODD if "▁" not in t]
    ids, offs = m.encode(PIECES, pa.array(texts))
    raw, ends = m.decode(PIECES, ids, offs)
    assert [raw[ends[i] : ends[i + 1]].tobytes().decode() for i in range(len(texts))] == texts


def test_unigram_pass_takes_the_best_sum():
    """The same forward pass on a unigram model against all segmentations."""
    rng = random.Random(5)
    from dataclasses import replace

    uni = replace(PIECES, unigram=True, name="unigram-test", score=PIECES.score / 1000)
    for _ in range(60):
        word = "▁" + "".join(rng.choices("thinedor", k=rng.randint(1, 9)))
        points = m._points(word)
        rank, per, _ = m.encode_words(uni, points, np.array([0]), np.array([len(word)]))
        got = uni.score[rank].sum()

        def best(s):
            if not s:
                return 0.0
            held = [(m.lookup(uni.keys, uni.key_rank, m.span_hash(m.prefix(m._points(s[:k])), np.array([0]), np.array([k])), -1)[0], k) for k in range(1, min(16, len(s)) + 1)]
            return max(uni.score[r] + best(s[k:]) for r, k in held if r >= 0)

        assert got == pytest.approx(best(word))


def test_table_of_odd_rows(spark):
    rows = [(1, "the cat", 5), (1, "the cat", 5), (2, None, 6), (None, "a  b", 7), (3, "", 8), (4, "x" * 20_000 + " long " * 9000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {(r.doc_id, r.n_tokens): r for r in m.encoded(df).collect()}
    assert len(m.encoded(df).collect()) == 6
    assert got[(2, None)].ids is None and got[(3, 0)].ids == []
    assert all(r.exact for r in got.values() if r.ids is not None)
    assert m.encoded(df.limit(0)).count() == 0
