import re
from collections import defaultdict

from tallyforge.llm import mixing


def targets(size, share=1.5, most=2.0):
    """Share by weight, cap, and share the excess again until none is above."""
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    total, full = share * sum(size.values()), {}
    while True:
        open_ = [s for s in order if s not in full]
        level = (total - sum(full.values())) / max(1e-9, sum(w[s] for s in open_))
        over = [s for s in open_ if level * w[s] >= most * size[s]]
        if not over or not open_:
            return full | {s: level * w[s] for s in open_}
        full |= {s: most * size[s] for s in over}


def test_targets_and_taken(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 50)), ["a", "b", "c", "é", "z", None][min(5, i % 9)]) for i in range(2000)]
    rows += [(5000, None, "a"), (5001, "", None), (5002, " \t\n", "empty"), (5003, "x" * 100_000, "b")]
    df = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], "doc_id long, text string, source string, size int, key int").repartition(7)
    got = mixing.mix(df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(3)).collect())) if all(r.source for r in got) else True
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    expected = targets(size)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - expected[r.source]) < 1e-6 * max(1, expected[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows)
    assert all(taken[s] == int(expected[s] + 1e-9) for s in size)
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(3)).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_documents_follow_what_is_taken(spark):
    rows = [(i, "w " * (1 + i % 30), "ab"[i % 2]) for i in range(300)] + [(900, None, "a"), (None, "w", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.doc_id: round(r.taken / r.size) if r.size else 0 for r in mixing.mix(df).collect() if r.doc_id is not None}
    copies = defaultdict(int)
    for r in mixing.mixed_documents(df).collect():
        copies[r.doc_id] += 1
    assert dict(copies) == {k: v for k, v in taken.items() if v}


def test_empty_table_and_repeated_rows(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    df = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (1, "a b c", "s")], "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == 3 and sum(r.taken for r in got) == 10


def test_rows_without_id_leave_no_source_short_and_names_may_clash(spark):
    rows = [(None if k % 3 == 0 else k, f"word{k} " * (1 + k % 7), "ab"[k % 2], k, "x") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _copies long, row string")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    assert set(got) <= {r for r in rows if r[0] is not None}
    size = defaultdict(int)
    for i, t, s, *_ in rows:
        size[s] += len(t.split()) if i is not None else 0
    for s, wanted in targets(size).items():
        assert abs(sum(len(t.split()) for _, t, x, *_ in got if x == s) - wanted) <= 7
