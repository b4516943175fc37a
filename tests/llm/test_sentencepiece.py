import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from tallyforge.llm import sentencepiece_bpe as S

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=MODEL)
PARTS = ["the", " ", "  ", "a", "é", "ß", "\n", "\t", "漢", "🙂", "in", "▁", "x", "tion", "0", "12", "!!", "ﬁ", "\x00", "ing", "aa", "s", "ss", "on", "="]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join) | st.text(max_size=40))
def test_encoding_and_decoding_equal_the_library(text):
    t = S.table(MODEL)
    ids = LIBRARY.encode(text)
    assert t.encode(text) == ids
    assert t.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31_999), max_size=12))
def test_decoding_any_ids(ids):
    assert S.table(MODEL).decode(ids) == LIBRARY.decode(ids)


def test_operator(spark):
    rows = [(1, "Hello wörld"), (2, None), (3, ""), (4, "  two  spaces ▁ "), (5, "s" * 20_000), (5, "s" * 20_000), (None, "漢字 🙂")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_tokens int, ids string")
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in S.encoded(df, ids=True).collect()), key=str)
    expected = []
    for i, t in rows:
        ids = LIBRARY.encode(t or "")
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest(), ids))
    assert got == sorted(expected, key=str)
    assert S.encoded(spark.createDataFrame([], "doc_id long, text string")).count() == 0
