"""Language ID and toxicity: held-out accuracy on the small tables, and edge cases."""

import random
import zlib

from tallyforge.llm import language_id, toxicity

SF = "/root/testdata/sf0.01"


def naive_phrases(sample, s):
    """Longest-match parsing by substring search."""
    n, i = 0, 0
    while i < len(s):
        k = 1
        while i + k <= len(s) and s[i : i + k] in sample:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_automaton_parses_like_substring_search(monkeypatch):
    rnd = random.Random(2)
    sample = "".join(rnd.choice("abc ") for _ in range(300))
    m = language_id.Model({"x": [sample]})
    symbols = language_id.SymbolMap(m.letters)
    own, _ = symbols.symbols([sample])
    table = "".join(map(chr, own[: language_id.SYMBOLS_PER_DOC].tolist() + [0]))
    texts = ["".join(rnd.choice("abcd ") for _ in range(rnd.randrange(1, 200))) for _ in range(40)]
    texts += ["".join(rnd.choice(a) for _ in range(5000)) for a in ("abc ", "abcd ", "ab", "d", "aaaaaaaab")] + [sample * 9]
    for segment in (language_id.SEGMENT, 7, 1):
        monkeypatch.setattr(language_id, "SEGMENT", segment)
        s, bounds = symbols.symbols(texts)
        got = m.phrases(s, bounds)[:, 0]
        for k, _ in enumerate(texts):
            part = "".join(map(chr, s[bounds[k] : bounds[k + 1]].tolist()))
            assert got[k] == naive_phrases(table, part)


def test_languages_of_other_scripts(spark):
    words = {"el": "και το να δεν είναι για με που", "ru": "и в не на что он как это", "ja": "これは日本語の文章です 私たちは東京", "ar": "في من على هذا التي كان", "en": "the and of to in is that it", "de": "der die und das nicht ist mit ein"}
    rnd = random.Random(3)
    rows = [(k, " ".join(rnd.choice(w.split()) for _ in range(30)), la) for k in range(60) for la, w in words.items()]
    df = spark.createDataFrame([(i, t, la) for i, (_, t, la) in enumerate(rows)], "doc_id long, text string, lang string")
    truth = {i: la for i, (_, _, la) in enumerate(rows)}
    assert all(r.lang_pred == truth[r.doc_id] for r in language_id.predicted(df).collect())


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in d.select("doc_id", "lang").collect()}
    got = language_id.predicted(d).collect()
    assert len(got) == len(lang) and all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95


def test_language_edge_cases(spark):
    rows = [(k, t, la, "s", 0) for k, (t, la) in enumerate([("der die und das ist nicht", "de"), ("the and of this is not", "en")] * 20)]
    rows += [(100, None, "de", None, 0), (101, "", None, "s", 0), (102, "123 ... !!", "en", "s", 0), (103, "the and " * 30_000, None, "s", 0), (None, "und das", None, "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")
    got = {r.doc_id: (r.lang_pred, r.held_out) for r in language_id.predicted(df).collect()}
    assert [got[k][0] for k in (100, 101, 102, 103, None)] == ["und", "und", "und", "en", "de"] and got[None][1] is False
    assert language_id.accepted(df).columns == df.columns
    assert sorted(r.doc_id for r in language_id.accepted(df).where("doc_id >= 100").collect()) == [103]
    assert language_id.predicted(df.limit(0)).count() == 0
    unlabelled = df.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in language_id.predicted(unlabelled).collect()} == {"und"}


def test_toxicity_held_out_accuracy(spark):
    d, y = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in y.collect()}
    got = [r for r in toxicity.scored(d, toxicity.fit(d, y)).collect()]
    assert len(got) == d.count() and all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.9


def edits(word):
    letters = "abcdefghijklmnopqrstuvwxyz"
    for k in range(len(word) + 1):
        yield from (word[:k] + c + word[k:] for c in letters)
        if k < len(word):
            yield word[:k] + word[k + 1 :]
            yield from (word[:k] + c + word[k + 1 :] for c in letters)


def test_trie_and_automaton_find_all_single_edits():
    lex = toxicity.Lexicon(["worthless", "stupid", "vequ*", "lowei*"])
    for term in ("worthless", "stupid"):
        assert lex.find(term) == (term, 0)
        assert all(lex.find(w) for w in set(edits(term)))
    assert lex.find("veqution") == ("vequ*", 0) and lex.find("loweibach")[0] == "lowei*" and lex.find("liweibach") == ("lowei*", 1)
    assert lex.find("stopped") is None and lex.find("worth") is None and lex.find("") is None


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_words_found_equal_plain_distances_to_the_lexicon():
    rnd = random.Random(12)
    terms = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(3, 9))) for _ in range(40)})
    exact_only = frozenset(terms[::7])
    lex = toxicity.Lexicon(terms, exact_only)
    for _ in range(3000):
        w = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 10)))
        near = [t for t in terms if len(t) >= toxicity.FUZZY_FROM and t not in exact_only and distance(w, t) <= 1]
        got = lex.find(w)
        assert got == (w, 0) if w in terms else (got is not None and got[0] in near and got[1] == 1) if near else got is None


def test_more_evidence_scores_higher():
    model = toxicity.Model(["stupid", "idiot", "worthless"], {})
    s = toxicity.Scorer(model.terms, model.exact_only, model.score)
    texts = ["clean", None, 'the word "stupid" is rude', "stupiid", "stupid", "stupid worthles", "stupid idiot", "stupid idiot worthless"]
    got = s(texts)
    assert got[0] == got[1] and got[1:] == sorted(got[1:]) and len(set(got)) == 7 and all(0 <= x <= 1 for x in got)


def test_quotation_weighs_less():
    lex = toxicity.Lexicon(["stupid", "idiot"])
    assert toxicity.evidence(lex, "you are a stupid person") == "one"
    assert toxicity.evidence(lex, 'the word "stupid" is rude') == "quoted"
    assert toxicity.evidence(lex, "they said stupid things") == "quoted"
    assert toxicity.evidence(lex, "stupid idiot") == "more"
    assert toxicity.evidence(lex, "a clean line") == "none"


def test_toxicity_edge_cases(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "some text")], "doc_id long, text string")
    got = toxicity.scored(df, toxicity.fit(df, labels)).collect()
    assert len(got) == 4 and {r.predicted for r in got} == {0} and len({r.score for r in got}) == 1
    assert toxicity.scored(df.limit(0), toxicity.Model([], {})).count() == 0
