import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidejoin.llm import sentencepiece_dropout as S

VOCABULARY = S.Vocabulary(S.default_model())
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=S.default_model())
PLAIN, VARIED = S.Encoder(VOCABULARY, 0.0, 1, 8), S.Encoder(VOCABULARY, 0.3, 1, 8)
PAIRS, RANKS, CHARACTERS = VOCABULARY.arrays()


def encode(encoder, text, key):
    return encoder.encode([text], [key])[0]


TEXTS = ["", " ", "thererble onthat. The", "a  b   c\n\n d ", "  lead", "trail  ", "\t\r\x00", "wörld 你好 𐍈", "x" * 3000, "ab " * 500, "<s> </s> <0x41>", "▁ a▁b", "á"]


@pytest.mark.parametrize("text", [t for t in TEXTS if "▁" not in t])
def test_without_dropout_it_is_the_librarys_own(text):
    assert encode(PLAIN, text, "1").tolist() == LIBRARY.encode(text)


@given(st.text(st.characters(exclude_characters="▁", exclude_categories=["Cs"]), max_size=60))
@settings(max_examples=200, deadline=None)
def test_any_text(text):
    assert encode(PLAIN, text, "1").tolist() == LIBRARY.encode(text)
    assert VOCABULARY.decode(encode(VARIED, text, "1")) == text


@pytest.mark.parametrize("text", TEXTS)
def test_lossless_with_dropout(text):
    assert VOCABULARY.decode(encode(VARIED, text, "7")) == text


def test_varied_and_seeded():
    text = "understanding international organisations " * 8
    first = encode(VARIED, text, "1").tolist()
    assert encode(S.Encoder(VOCABULARY, 0.3, 1, 8), text, "1").tolist() == first
    assert encode(S.Encoder(VOCABULARY, 0.3, 2, 8), text, "1").tolist() != first
    assert encode(VARIED, text, "2").tolist() != first
    assert len(first) > len(encode(PLAIN, text, "1"))
    assert len({tuple(encode(VARIED, "international", str(k)).tolist()) for k in range(60)}) > 2
    # All candidates fall out: characters and bytes remain.
    assert len(encode(S.Encoder(VOCABULARY, 1.0, 1, 1), "abc def", "1")) == 8


def test_documents(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "no id", ""), (99, None, ""), (1, " ", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = S.encode_documents(docs)
    out = {r.doc_id: r for r in got.collect()}
    assert all(r.lossless for r in out.values()) and out[99].ids is None and out[0].ids == [] and got.count() == len(rows)
    back = {r.doc_id: r.text for r in S.decode_documents(got).collect()}
    assert back == {i: t for i, t, _ in rows}
    assert S.encode_documents(docs.limit(0)).count() == 0


@given(st.lists(st.tuples(st.text("abehinorst ", min_size=9, max_size=9), st.integers(0, 2**64 - 1)), max_size=8), st.sampled_from([-1, 2**61, 2**63, 2**64 - 1]))
@settings(max_examples=300, deadline=None)
def test_arrays_segment_as_one_token_does(rows, limit):
    ids = np.array([[CHARACTERS[ord(c)] for c in t] for t, _ in rows], np.int32).reshape(-1, 9)
    pieces, counts = S.segment_all(ids, PAIRS, RANKS, np.array([b for _, b in rows], np.uint64), limit)
    one_by_one = [S.segment(t, VOCABULARY.ranks, b, limit) for t, b in rows]
    assert counts.tolist() == [len(x) for x in one_by_one]
    assert pieces.tolist() == [int.from_bytes(VOCABULARY.packed[p], "little") for x in one_by_one for p in x]


def test_texts_together_are_as_alone_and_caches_dont_matter(monkeypatch):
    texts = [t * 3 + str(i) for i, t in enumerate(TEXTS)] + ["the cat international " * 40]
    keys = [str(i) for i in range(len(texts))]
    alone = [encode(S.Encoder(VOCABULARY, 0.3, 1, 8), t, k).tolist() for t, k in zip(texts, keys)]
    assert [x.tolist() for x in S.Encoder(VOCABULARY, 0.3, 1, 8).encode(texts, keys)] == alone
    monkeypatch.setattr(S, "KEPT", 3)
    small = S.Encoder(VOCABULARY, 0.3, 1, 8)
    assert [encode(small, t, k).tolist() for t, k in zip(texts * 2, keys * 2)] == alone * 2


def test_pairs_are_found():
    left, right, made = VOCABULARY.pairs.T
    assert (PAIRS.find(left, right) == made).all()
    known = {(a, b) for a, b, _ in VOCABULARY.pairs.tolist()}
    others = [(a, b) for a, b in zip(left.tolist(), made.tolist()) if (a, b) not in known]
    assert (PAIRS.find(*np.array(others).T) == -1).all()
