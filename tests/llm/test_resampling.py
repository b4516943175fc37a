import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import resampling

SCHEMA = "doc_id long, text string, weight string, rank int, part int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def buckets(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_force(docs, target):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(buckets(x)[1])
    for x in target:
        t.update(buckets(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10_000.0) / ((s[b] + 1.0) * (t_all + 10_000.0)))) for b in s}
    rows = []
    for i, x in docs:
        n, f = buckets(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(may[: 5 * len(may) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def check(spark, docs, target):
    table = spark.createDataFrame([(i, x, "clash", 1, 2) for i, x in docs], SCHEMA).repartition(3)
    got = resampling.resampled(table, spark.createDataFrame([(x,) for x in target], "text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    assert rows == brute_force(docs, target)
    return rows


def test_resampled_equals_brute_force(spark):
    r = random.Random(1)
    vocabulary = ["".join(r.choices("abcdeÉüß中9", k=r.randrange(1, 12))) for _ in range(400)] + ["x" * 17, "é" * 40, "y" * 64, "z" * 65, "Q" * 300]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]

    def text():
        return "".join(w + r.choice([" ", ".", "\n", "\x00", "-"]) for w in r.choices(vocabulary, weights, k=r.choice([0, 1, 2, 19, 20, 60, 200])))

    docs = [(i, text()) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "..."), (None, text() + " a" * 30), (5, docs[5][1]), (5, docs[5][1])]
    docs += [(2000, docs[7][1] + " word" * 25)] * 150  # a third of all rows is one
    rows = check(spark, docs, [text() for _ in range(30)] + [None, ""])
    assert sum(x[4] is not None for x in rows) == 5 * sum(buckets(x)[0] >= 20 for _, x in docs) // 100


def test_one_text_in_pieces_equals_brute_force(spark, monkeypatch):
    r = random.Random(2)
    text = " ".join("".join(r.choices("abcé", k=r.randrange(1, 9))) for _ in range(6000)) + " " + "w" * 500 + " tail"
    data = pa.RecordBatch.from_pydict({"text": [text]})
    monkeypatch.setattr(resampling, "PIECE", 700)
    head = resampling.Head([b"a", b"ab"], [(0, 0), (0, 1)])
    found = Counter()
    for _, _, w in resampling.blocks(data):
        for _, b in resampling.features(w, head):
            found.update(b.tolist())
    assert found == Counter(buckets(text)[1])


def test_no_separator_in_a_very_long_text(monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", 64)
    for text in ("a" * 1000, "a" * 1000 + " b", " " * 500, "b c " + "a" * 400):
        found = Counter()
        for _, _, w in resampling.blocks(pa.RecordBatch.from_pydict({"text": [text]})):
            for _, b in resampling.features(w, resampling.Head([], [])):
                found.update(b.tolist())
        assert found == Counter(buckets(text)[1])


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert resampling.resampled(none, spark.createDataFrame([], "text string")).collect() == []
    check(spark, [(i, "Some words here " * 8) for i in range(30)], [])


def test_states_join(spark):
    a, b = b"h\xc3\xa9llo", b"w" * 40
    joined = resampling.joined(resampling.spaced(np.array([zlib.crc32(a)], np.uint32)), np.array([len(b)]), np.array([zlib.crc32(b)], np.uint32))
    assert joined[0] == zlib.crc32(a + b" " + b)


@pytest.mark.parametrize("most", [4, 100])
def test_frequent_keeps_the_most_frequent(most):
    f = resampling.Frequent(most)
    for _ in range(50):
        k = np.concatenate((np.arange(3), np.random.default_rng(0).integers(10, 10_000, 50))).astype(np.uint64)
        f.add(k, k, k)
    a, _, n = f.rows()
    assert {0, 1, 2} <= set(a.tolist()) and len(a) <= most and n.max() >= 50
