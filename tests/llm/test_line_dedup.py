import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import line_dedup


def grams(line):
    return {line[k : k + 5] for k in range(max(1, len(line) - 4))}


def similarity(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


def brute(rows):
    """Kept lines by comparing all pairs of distinct lines."""
    lines = {}
    for i, t in rows:
        for pos, line in enumerate((t or "").split("\n") if t is not None else []):
            s = line.strip(" \t\r")
            if s:
                lines.setdefault(s, []).append((i, pos))
    names = sorted(lines)
    sets = {s: grams(s) for s in names}
    parent = {s: s for s in names}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for x, a in enumerate(names):
        for b in names[x + 1 :]:
            c = len(sets[a] & sets[b])
            if c and c >= 0.8 * (len(sets[a]) + len(sets[b]) - c):
                parent[root(b)] = root(a)
    first = {}
    for s in names:
        r = root(s)
        first[r] = min([*lines[s], first.get(r, (1 << 60, 0))])
    drop = {p for s in names for p in lines[s] if p != first[root(s)]}
    out = {}
    for i, t in rows:
        kept = [x for pos, x in enumerate((t or "").split("\n")) if (i, pos) not in drop]
        out[i] = hashlib.sha256("\n".join(kept).encode()).hexdigest()
    return out


def test_kept_lines_equal_brute_force(spark):
    rnd = random.Random(4)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 12))) for _ in range(500)] + ["漢字", "日本語テキスト"]
    base = [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(1, 60))) for _ in range(30)]
    rows = []
    for i in range(120):
        part = []
        for _ in range(rnd.randrange(0, 6)):
            w = rnd.choice(base).split(" ")
            if rnd.random() < 0.6:
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            part.append(rnd.choice(["", " ", "\t"]) + " ".join(w))
        rows.append((i, "\n".join(part) if part else rnd.choice(["", None, "\n\n"])))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, id int, line string").repartition(3)
    got = {r.doc_id: r.kept_sha256 for r in line_dedup.deduped(df).collect()}
    assert got == brute(rows)


def lines_kept(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return sum(r.n_kept for r in line_dedup.deduped(df).collect())


@pytest.mark.parametrize(
    "a,b",
    [("la " * 20 + "lu", "la " * 80 + "lu"), ("zo " * 80 + "zu", "zo " * 110 + "zu")],
)
def test_lines_of_unlike_length_with_equal_shingles_join(spark, a, b):
    assert similarity(a, b) == 1 and lines_kept(spark, [a, b]) == 1


def near(rnd, length, low, high):
    """Two lines of one length whose similarity lies between low and high."""
    letters = "abcdefghijklmnopqrstuvwxyz   "
    while True:
        a = "x" + "".join(rnd.choice(letters) for _ in range(length - 2)) + "x"
        b = a
        while similarity(a, b) > high:
            k = rnd.randrange(1, length - 1)
            b = b[:k] + rnd.choice("0123456789") + b[k + 1 :]
        if low <= similarity(a, b):
            return a, b


@pytest.mark.parametrize("low,high,share", [(0.8, 0.85, 0.98), (0.85, 0.9, 0.995), (0.9, 0.97, 0.999)])
def test_recall_of_near_lines(spark, low, high, share):
    rnd = random.Random(int(100 * low))
    pairs = [near(rnd, length, low, high) for length in (100, 160, 300) for _ in range(150)]
    df = spark.createDataFrame([(i, x) for i, p in enumerate(pairs) for x in p], "pair long, line string").select("pair", "line", F.xxhash64("line").alias("id"))
    groups = line_dedup.line_components(df.select("id", "line"))
    got = df.join(groups, "id").groupBy("pair").agg(F.count("*").alias("n"), F.countDistinct("component").alias("c")).where("n = 2 and c = 1").count()
    assert got >= share * len(pairs)


def test_clashing_columns_and_many_lines(spark):
    names = ("key", "drop", "row", "kept", "_lines", "_rest", "id", "hit")
    row = lambda i, t: (i, t, *[f"{n}{i}" for n in names])
    many = "\n".join(f"number {k} {hashlib.md5(str(k).encode()).hexdigest()}" for k in range(3000))
    df = spark.createDataFrame([row(1, many), row(2, many + "\nand more"), row(3, None)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = {r.doc_id: r for r in line_dedup.kept_documents(df).collect()}
    assert line_dedup.kept_documents(df).columns == df.columns
    assert got[1].text == many and got[2].text == "and more" and got[3].text is None and got[2].key == "key2" and got[2].row == "row2"


def test_edge_cases(spark):
    assert line_dedup.deduped(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = "z" * 200_000
    df = spark.createDataFrame([(1, None), (2, ""), (3, "same\n\nsame"), (3, "same\n\nsame"), (4, long), (5, long), (None, "alone")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_lines, r.n_kept) for r in line_dedup.deduped(df).collect()), key=str)
    assert got == [(1, 0, 0), (2, 1, 1), (3, 3, 2), (3, 3, 2), (4, 1, 1), (5, 1, 0), (None, 1, 1)]
    kept = line_dedup.kept_documents(df.withColumnRenamed("doc_id", "doc_id"))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 3, 3, 4, None]
