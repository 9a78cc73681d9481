import random

from pyspark.sql import functions as F

from tidejoin.llm import toxicity as T


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    words = [a + b for a in ("ba", "to", "ne", "li", "ru") for b in ("ka", "mi", "so", "ve", "du")]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        text = [rng.choice(words) for _ in range(40)]
        for _ in range(3 * toxic):
            text[rng.randrange(40)] = rng.choice(["zagblorf", "zagplix", "zagmunt", "Quorn"])
        rows.append((i, " ".join(text) + ".", int(toxic)))
    return rows


def test_learns_words_and_stems(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(900, None, ""), (901, "", ""), (902, "zagnovel. mi. zagnovel", ""), (None, "quorn quorn", "")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(900, None), (None, 1), (0, 1)], "doc_id long, toxic int")
    model = T.fit(docs, labels, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in T.score_documents(docs, model, F.lit(False)).collect()}
    held = [i for i in range(400) if i % 5 == 0]
    assert all(got[i].predicted == rows[i][2] for i in held)
    assert got[900].predicted == got[901].predicted == 0 and got[900].score == got[901].score < 0.5
    assert got[902].predicted == got[None].predicted == 1
    kept = {r.doc_id for r in T.without_toxic(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r.predicted == 0}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = T.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert [r.score for r in T.score_documents(docs, model, F.lit(True)).collect()] == [0.0]


def test_grammar():
    machine, lexicon = T.grammar(), T.Lexicon({"fool": 1.0}, {"blag": 0.5})
    score = lambda t: T.clause_scores(t, lexicon, machine)
    assert score("what a fool.") == [1.0] and score("fools footfool") == []
    assert score("you are a fool") == [1.5] and score("not a fool") == [0.25] and score("not at all a big fool") == [1.0]
    assert score("she said what a fool") == [0.5] and score("she said. what a fool") == [1.0]
    assert score("Blaggers, and a fool") == [0.5, 1.0]
    assert score("kill the weeds") == [] and score("you i will kill") == [1.5]
    whole = lambda t: T.clause_scores(t, lexicon, machine, T.following())
    assert whole("i kill you") == [1.5]
    assert score("") == score(None) == [] and score("fool " * 3) == [1.0] and score("not fool. fool") == [1.0]


def test_composition_is_the_cascade():
    """The composed machine says what its parts say one after the other."""
    rng = random.Random(4)
    negation = T._counting("not", T.NOT_REACH, {"insult": "negated", "threat": "other", "faced insult": "negated", "faced threat": "other"}, ("reported",))
    target = T._counting("target", T.TARGET_REACH, {"insult": "aimed", "threat": "aimed threat"}, ("reported", "negated"))
    insult = T.Transducer({0: {k: ("match", w, 0) for k, w in (T.MARKED | {"faced insult": T.MARKED["aimed"]}).items()}})
    threat = T.Transducer({0: {"aimed threat": ("match", 1.5, 0), "faced threat": ("match", 1.5, 0)}})
    parts, machine = [T._reported(), negation, target, insult, threat], T.grammar()
    for _ in range(300):
        states, state = [0] * 5, 0
        for _ in range(30):
            symbol = rng.choice(T.SYMBOLS)
            said, weight, state = machine.step(state, symbol)
            w = 1.0
            for i, part in enumerate(parts):
                symbol, own, states[i] = part.step(states[i], symbol)
                w *= own
            assert (said, weight) == (symbol, w)


def test_other_labels_and_no_rows(spark):
    rows = corpus(40)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    for value in (0, 1, 2):
        model = T.fit(docs, spark.createDataFrame([(i, value) for i in range(40)], "doc_id long, toxic int"), F.lit(True))
        got = {r.score for r in T.score_documents(docs, model, F.lit(True)).collect()}
        assert len(got) == 1 and (got.pop() > 0.9) == (value > 0)
    mixed = spark.createDataFrame([(i, 2 * y + (i % 8 == 4)) for i, _, y in rows], "doc_id long, toxic int")
    assert T.score_documents(docs, T.fit(docs, mixed, F.lit(True)), F.lit(True)).count() == 40
    assert T.score_documents(docs.limit(0), model, F.lit(True)).count() == 0 and T.without_toxic(docs.limit(0), model).count() == 0
    long = spark.createDataFrame([(1, "ba to. " * 100_000 + "i will kill you")], docs.schema)
    assert T.score_documents(long, model, F.lit(True)).count() == 1


def test_held_out_documents_of_the_table(spark):
    """At sf0.01 the held-out toxic documents score above the clean ones."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    part = T.remainder("doc_id", 5)
    got = T.score_documents(docs, T.fit(docs, labels, part != 0), part == 0).where("held_out").join(labels, "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in got) / len(got)
    assert right > 0.97 and not any(r.predicted for r in got if r.toxic == 0)
