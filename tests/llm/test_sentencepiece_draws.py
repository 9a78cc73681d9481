from tidejoin.llm import sentencepiece_dropout as S

VOCABULARY = S.Vocabulary(S.default_model())


def variants(streams, documents, dropout=0.3):
    encoder = S.Encoder(VOCABULARY, dropout, 1, streams)
    texts = [" ".join(["internationalisation"] * 100)] * documents
    out = encoder.encode(texts, [str(i) for i in range(documents)])
    assert [VOCABULARY.decode(x) for x in out] == texts
    return out


def test_every_occurrence_draws():
    assert S.STREAMS == 0
    blanks = lambda x: [i for i, k in enumerate(x.tolist()) if VOCABULARY.table[k].startswith(b" ")]
    kinds = lambda out: len({tuple(x[i:j].tolist()) for x in out for i, j in zip(blanks(x), [*blanks(x)[1:], len(x)])})
    assert kinds(variants(8, 30)) <= 8 < 100 < kinds(variants(S.STREAMS, 30))
    # No two documents draw alike.
    assert len({x.tobytes() for x in variants(S.STREAMS, 30)}) == 30 and len({x.tobytes() for x in variants(8, 30)}) <= 8


def test_kept_pieces_are_those_of_the_draws(monkeypatch):
    texts, keys = ["the cat international understanding of it " * 20, "wörld 你好 " + "x" * 50], ["1", "2"]
    want = [x.tolist() for x in S.Encoder(VOCABULARY, 0.1, 1, 0).encode(texts, keys)]
    encoder = S.Encoder(VOCABULARY, 0.1, 1, 0)
    assert [encoder.encode([t], [k])[0].tolist() for t, k in zip(texts, keys)] == want
    # With no merges kept, every occurrence is segmented by its draws.
    encoder.short.data[:] = False
    assert [x.tolist() for x in encoder.encode(texts, keys)] == want
