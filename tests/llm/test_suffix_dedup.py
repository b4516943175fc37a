import hashlib
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import suffix_dedup


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array_is_the_sorted_suffixes(s):
    assert suffix_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(rows, n=suffix_dedup.LENGTH):
    rows = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[s : s + n] for _, t in rows for s in range(len(t) - n + 1))
    out = []
    for i, t in rows:
        mark = bytearray(len(t))
        for s in range(len(t) - n + 1):
            if seen[t[s : s + n]] > 1:
                mark[s : s + n] = b"\1" * n
        spans = sum(1 for k in range(len(t)) if mark[k] and (k == 0 or not mark[k - 1]))
        out.append((i, len(t), sum(mark), spans, hashlib.sha256(bytes(x for x, m in zip(t, mark) if not m)).hexdigest()))
    return sorted(out, key=str)


def test_removed_bytes_equal_brute_force(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(2, 9))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, other = text(120), text(90)
    rows = [(0, None), (1, ""), (2, "short"), (3, "a" * 399), (4, "a" * 401), (5, "b" * 400), (6, "xy" * 700), (None, text(50))]
    for i in range(10, 60):
        parts = [text(rnd.randrange(0, 60))]
        for _ in range(rnd.randrange(0, 3)):
            p = rnd.choice([passage, other])
            a = rnd.randrange(0, len(p) // 2)
            parts += [p[a : a + rnd.randrange(380, 700)], text(rnd.randrange(0, 40))]
        rows.append((i, " ".join(parts)))
    rows += [(99, rows[20][1]), (100, rows[20][1]), (100, rows[20][1]), (101, rows[30][1] + " tail"), (102, passage + passage)]
    df = spark.createDataFrame([(i, t, 1, "r", 5) for i, t in rows], "doc_id long, text string, th int, runs string, n_bytes int").repartition(4)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed(df).collect()), key=str)
    assert got == brute(rows)


def shared_words(rows, n=suffix_dedup.PASSAGE):
    texts = {(t or "") for _, t in rows}
    words = {t: [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t)) if w] for t in texts}
    times = Counter(t or "" for _, t in rows)
    holders = Counter()
    for t, w in words.items():
        for x in {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}:
            holders[x] += 2 if times[t] > 1 else 1
    out = []
    for i, t in rows:
        w, inside = words[t or ""], set()
        for k in range(len(w) - n + 1):
            if holders[tuple(w[k : k + n])] > 1:
                inside |= set(range(k, k + n))
        out.append((i, len(inside)))
    return sorted(out, key=str)


def test_shared_words_equal_brute_force(spark):
    rnd = random.Random(15)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 6))) for _ in range(300)]
    some = lambda n: [rnd.choice(words) for _ in range(n)]
    passages = [some(n) for n in (49, 50, 51, 70, 120)]
    rows = [(0, None), (1, ""), (2, "a " * 49), (3, "a " * 60), (4, "b " * 30)]
    for i in range(10, 70):
        t = some(rnd.randrange(0, 60))
        for _ in range(rnd.randrange(0, 3)):
            p = list(rnd.choice(passages))
            if rnd.random() < 0.3:
                p[rnd.randrange(len(p))] = "edit"
            t += p + some(rnd.randrange(0, 20))
        rows.append((i, rnd.choice([" ", "\n", " \t"]).join(t)))
    rows += [(90, rows[20][1]), (91, rows[20][1]), (92, rows[22][1].upper() if rows[22][1].isascii() else rows[22][1]), (93, "b " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.n_shared_words) for r in suffix_dedup.removed(df).collect()), key=str)
    assert got == shared_words(rows)


def test_empty_table(spark):
    assert suffix_dedup.removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
