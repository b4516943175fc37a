"""Text joins and groups against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import components as C
from tallyforge.operators import textjoin as J


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


def names(seed, n, letters="ab c"):
    r = random.Random(seed)
    out = ["".join(r.choices(letters, k=r.randrange(0, 14))) for _ in range(n)]
    for _ in range(n // 2):  # near copies
        w = list(r.choice(out))
        if w:
            w[r.randrange(len(w))] = r.choice(letters)
        out.append("".join(w))
    return out


def frames(spark, seed, letters):
    left = [(k % 2, v) for k, v in enumerate(names(seed, 60, letters))] + [(None, "x"), (0, None)]
    right = [(k % 2, v) for k, v in enumerate(names(seed + 1, 60, letters) + ["common " + v for _, v in left[:20]])]
    return left, right, spark.createDataFrame(left, "t int, l string"), spark.createDataFrame(right, "t int, r string")


def pairs(left, right, ok):
    return {(t, a, b) for t, a in left for u, b in right if t is not None and t == u and a and b and ok(a, b)}


@pytest.mark.parametrize(("seed", "letters"), [(1, "ab"), (2, "abcdefgh "), (3, "é公a#1")])
def test_joins_equal_brute_force(spark, seed, letters):
    left, right, x, y = frames(spark, seed, letters)
    got = {tuple(r) for r in J.containing(x, "l", y, "r", ["t"]).collect()}
    assert got == pairs(left, right, lambda a, b: a in b) and got
    for above in (0.85, 0.6):
        got = {tuple(r) for r in J.similar(x, "l", y, "r", ["t"], above).collect()}
        assert got == pairs(left, right, lambda a, b, above=above: 1 - distance(a, b) / max(len(a), len(b)) > above)


def test_shared_words_equal_brute_force(spark):
    r = random.Random(4)
    w = ["tea", "green", "large", "box", "500g", "mix"]
    left = [(k % 2, " ".join(r.choices(w, k=r.randrange(1, 6)))) for k in range(80)]
    right = [(k % 2, "  ".join(r.choices(w, k=r.randrange(1, 6)))) for k in range(80)]
    x, y = spark.createDataFrame(left, "t int, l string"), spark.createDataFrame(right, "t int, r string")
    for least in (0.78, 0.5, 1.0):
        got = {tuple(g) for g in J.sharing_words(x, "l", y, "r", ["t"], least).collect()}

        def ok(a, b, least=least):
            p, q = set(a.split()), set(b.split())
            return len(p & q) / max(len(p), len(q)) >= least

        assert got == pairs(left, right, ok) and got


def test_empty_sides(spark):
    none = spark.createDataFrame([], "t int, l string")
    some = spark.createDataFrame([(1, "abc")], "t int, l string")
    for f in (J.containing, J.similar, J.sharing_words):
        assert f(none, "l", some, "l", ["t"]).collect() == [] and f(some, "l", none, "l", ["t"]).collect() == []


def test_components_equal_union_find(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(1000 + k, 1001 + k) for k in range(60)] + [(7, k) for k in range(2000, 2100)] + [(5, 5), (None, 3), (3, None)]
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {g.id: g.component for g in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in root}
    assert C.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_ends_of_chains_and_circles(spark):
    steps = [(k, k + 1) for k in range(1, 50)] + [(100, 101), (101, 102), (102, 100), (103, 101), (104, 103), (200, 200), (300, 301), (None, 1), (5000, None)]
    got = {r.source: r.target for r in C.ends(spark.createDataFrame(steps, "source long, target long")).collect()}
    assert got == {**{k: 50 for k in range(1, 50)}, **{k: 100 for k in range(100, 105)}, 200: 200, 300: 301}
    assert C.ends(spark.createDataFrame([], "source long, target long")).where(F.lit(True)).collect() == []


def test_near_pairs_of_names_with_one_beginning_and_repeated_rows_equal_sql(spark, tmp_path):
    """A row for each pair of rows, as in the SQL, whether a pair meets by name, by telephone number or by both."""
    import duckdb

    from tallyforge import catalog

    rows = [(k, f"Customer#{k * 37 % 1000:09d}", k % 2, 1.0, "X") for k in range(90)] + [(200, "Ab", 0, 1.0, "X"), (201, "Ab", 0, 1.0, "X"), (202, None, 0, 1.0, "X")]
    rows += rows[:3]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute("".join(f"CREATE VIEW {t} AS FROM '/root/testdata/sf0.001/{t}.parquet';" for t in ("orders", "lineitem", "part", "supplier", "events")) + f"CREATE VIEW customer AS FROM '{tmp_path}/customer.parquet/*.parquet'")
    expected = sorted(con.execute("SELECT a, b FROM (" + catalog.oracle_sql()["supplier_near_pairs"] + ")").fetchall())
    assert sorted(map(tuple, catalog.queries()["supplier_near_pairs"](spark, str(tmp_path)).collect())) == expected
    assert len(set(expected)) < len(expected)


def test_what_is_made_of_texts_is_never_broadcast(spark, capsys):
    """Runs and segments are many times the size of the rows that the planner knows; the joins by them deal both sides out."""
    x = C.cut(spark.createDataFrame([(1, "abcdefgh")], "t int, l string"))
    y = C.cut(spark.createDataFrame([(1, "xabcdefghi")], "t int, r string"))
    J.containing(x, "l", y, "r", ["t"]).explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out
    J.similar(x, "l", y, "r", ["t"], 0.75).explain()
    joins = [line for line in capsys.readouterr().out.splitlines() if "Join [" in line and ("part#" in line or "gram#" in line)]
    assert joins and all("SortMergeJoin" in line and "part#" in line for line in joins)
