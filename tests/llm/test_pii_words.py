from tallyforge.llm import pii


def test_terms_beside_a_letter_whose_lower_case_is_longer():
    assert pii.all_spans("\u0130zmir and Zorbly", frozenset({"zorbly"})) == ([], [(10, 16, 4)])


def test_both_paths_have_the_same_words(spark):
    text = "\u0130zmir Zorbly x\u00b2\u00b3\u00b9abcd \u2160\u2161\u2162\u2163\u2164 caf\u00e9s"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    assert {r.term for r in pii.words_of(df).collect()} == pii.words(text)


def test_contexts_hold_whole_words_only():
    long = "w" * 160
    got = {t for _, t, _ in pii.contexts(f"{long} a@b.co then", pii.base_spans(f"{long} a@b.co then"))}
    assert got == {long, "then"}
    far = "first " + "- " * 400 + "a@b.co" + " ." * 400 + " last"
    assert {t for _, t, _ in pii.contexts(far, pii.base_spans(far))} == {"first", "last"}


def test_contexts_equal_brute_force():
    import random
    import re

    r = random.Random(3)
    for _ in range(200):
        text = "".join(r.choice(["word", "ab", "Ünder", " ", ", ", "a@b.co", "10.0.0.1", "x1", "-"]) + r.choice(["", " "]) for _ in range(r.randrange(40)))
        spans = pii.base_spans(text)
        expected = []
        for s, e, k in spans:
            words = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W\d_]{4,}", text)]
            near = [w for a, z, w in words if z <= s][-6:] + [w for a, z, w in words if a >= e][:6]
            expected += sorted((f"{pii.KINDS[k]}:{text[s:e]}", w) for w in set(near))
        assert sorted((x, w) for x, w, _ in pii.contexts(text, spans)) == sorted(expected)
