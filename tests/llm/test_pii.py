import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import pii

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub(r"[^0-9]", "", m.group())
            ok = True
            if k == 1:
                ok = all(int(x) <= 255 for x in m.group().split("."))
            if k == 2:
                total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
                ok = 14 <= len(d) <= 19 and total % 10 == 0
            if k == 3:
                ok = 10 <= len(d) <= 15
            if ok:
                out.append((m.start(), m.end(), k))
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab@.-+_0123456789 ()é\n", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_counts_digests_and_terms(spark):
    rows = [(1, "write to jo.x@mail.org now, card 4111 1111 1111 1111"), (2, None), (3, ""), (4, "ip 10.0.0.256 and 10.0.0.1, +1 (262) 555-3752")]
    # one word stands in many contexts of one entity and hardly anywhere else
    rows += [(10 + i, f"filler{'abcdefgh'[i]}aa wordy{'abcdefgh'[i]} zorbly pat@home.net plain{'abcdefgh'[i]}bb") for i in range(8)]
    rows += [(100 + i, f"nothing here {i} of interest") for i in range(600)]
    rows += [(900, "a clean line about zorbly")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, term string, n long").repartition(3)
    got = {r.doc_id: r for r in pii.found(df, texts=True).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        base = plain(t or "")
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(k == x for *_, k in base) for x in range(4))
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, e, k in base).encode()).hexdigest()
    assert got[900].spans == "term:19:25" and got[900].clean == "a clean line about "
    assert "zorbly" not in got[10].clean and "<email>" in got[10].clean
    assert got[100].spans == "" and got[2].clean is None


def secret_rows():
    rnd = __import__("random").Random(4)
    value = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f"some words{i % 7} here passkey = \"{value()}\" and others{i % 5} follow") for i in range(20)]
    rows += [(50 + k, rows[3][1]) for k in range(200)]  # copies of one text
    rows += [(300 + i, f"plain words{i % 7} here, file {value()} stands alone{i % 3}") for i in range(5)]
    return rows + [(400 + i, f"some nothing here words{i % 7} and others{i % 5} follow, plain file stands alone{i % 3}") for i in range(2000)]


def test_secrets_with_a_learned_cue(spark):
    rows = secret_rows()
    got = {r.doc_id: r for r in pii.found(spark.createDataFrame(rows, "doc_id long, text string"), texts=True).collect()}
    assert all(got[i].n_secret == 1 and got[i].n_term == 1 for i, t in rows if "passkey" in t)
    assert all(got[i].n_secret == 0 and got[i].n_term == 0 for i, t in rows if "passkey" not in t)
    assert "<secret>" in got[0].clean and "passkey" not in got[0].clean and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    s, e = re.search(r"[0-9a-f]{40}", rows[0][1]).span()
    assert f"secret:{s}:{e}" in got[0].spans.split(",")


def test_terms_and_secrets_of_the_tables(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in pii.found(d).collect()}
    planted = {r.doc_id for r in d.where("text rlike '(?i)token = .[0-9a-f]{40}'").collect()}
    assert planted and {i for i, r in got.items() if r.n_secret} == planted


def test_join_path_gives_the_same(spark, monkeypatch):
    rows = [(10 + i, f"filler{'abcdefgh'[i]}aa wordy{'abcdefgh'[i]} zorbly pat@home.net plain{'abcdefgh'[i]}bb") for i in range(8)]
    rows += [(100 + i, f"nothing here {i} of interest") for i in range(600)] + [(900, "zorbly again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    usual = sorted(map(tuple, pii.found(df).collect()))
    more = spark.createDataFrame(secret_rows(), "doc_id long, text string")
    secrets = sorted(map(tuple, pii.found(more).collect()))
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 0)
    assert sorted(map(tuple, pii.found(df).collect())) == usual
    assert sorted(map(tuple, pii.found(more).collect())) == secrets


def test_empty_table(spark):
    assert pii.found(spark.createDataFrame([], "doc_id long, text string")).count() == 0
