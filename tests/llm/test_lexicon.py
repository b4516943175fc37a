from tallyforge.llm import toxicity


def test_a_length_that_only_exact_terms_have():
    lex = toxicity.Lexicon(["stupid", "worthlessly"], frozenset({"worthlessly"}))
    assert lex.find("worthlessly") == ("worthlessly", 0) and lex.find("stupit") == ("stupid", 1)
    assert lex.find("worthlessli") is None and lex.find("something") is None
