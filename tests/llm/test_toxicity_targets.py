from tidejoin.llm import toxicity as T


def test_targets_that_follow_reports_and_learned_threats():
    lexicon = T.Lexicon({"fool": 1.0, "stab": 0.5}, {"blag": 0.5})
    score = lambda t: T.clause_scores(t, lexicon, T.grammar(), T.following())
    assert score("i will kill you") == score("You I will kill.") == [1.5] and score("ich werde dich töten") == [1.5]
    assert score("kill the weeds") == [] and score("kill one two three four you") == [] and score("kill it. you") == score("kill it, you") == []
    assert score("i will not kill you") == [] and score("she said i will kill you") == []
    assert score("fool that you are") == [1.5] and score("a fool") == [1.0] and score("not a fool like you") == [0.25]
    # A reporting word reaches over commas and colons, to the end of the sentence.
    assert score("she said: what a fool") == score("as he wrote, long ago, what a fool") == [0.5]
    assert score("a fool, she said, a blaggard: i kill you") == [1.0, 0.25]
    assert score("she said: so; what a fool") == score("he wrote, a fool! fool") == [1.0]
    # What labels say of a threat word stands.
    assert score("stab the weeds") == [0.5] and score("i stab you") == [0.75]
    assert T.Lexicon({}, {"kil": 0.5}).hits("kill") == {0: ("insult", 0.5)}
    # Without following(), only targets that come first count.
    assert T.clause_scores("i will kill you", lexicon, T.grammar()) == []
