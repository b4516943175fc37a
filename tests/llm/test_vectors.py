import math
import random

import numpy as np

from tallyforge.llm import ann, exact_topk

SF = "/root/testdata/sf0.01"
BAD = [(9001, None), (9002, [1.0, None, 2.0, 0.0]), (9003, [float("nan"), 0.0, 0.0, 0.0]), (9004, [float("inf"), 0.0, 0.0, 0.0]), (9005, []), (9006, [1.0, 2.0])]


def rows(seed, n=400, dim=4):
    rnd = random.Random(seed)
    out = [(i, [rnd.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    return out + [(1000 + i, out[7][1]) for i in range(60)] + BAD + [(9007, [0.0] * dim)]


def expect(data, score, top=20):
    good = [(i, np.array(v)) for i, v in data if v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in good:
        if q % 20:
            continue
        found = sorted((-score(a, b), i) for i, b in good if i != q and len(a) == len(b))
        out[q] = [(i, -s) for s, i in found[:top]]
    return out


def test_exact_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "CANDIDATES", 100)
    monkeypatch.setattr(exact_topk, "QUERIES", 10)
    for seed, dense in ((1, 0.05), (2, 2.0)):
        monkeypatch.setattr(exact_topk, "DENSE", dense)
        data = rows(seed)
        df = spark.createDataFrame([(i, v, 1, 2) for i, v in data], "vec_id long, embedding array<float>, dim int, cb int").repartition(3)
        data = [(r.vec_id, r.embedding) for r in df.collect()]
        floor = lambda v: np.floor(64 * np.array(v, dtype=float))
        got = {}
        for r in exact_topk.top_scores(df).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == expect(data, lambda a, b: int(floor(a) @ floor(b)))


def test_neighbours_have_recall_and_exact_scores(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, dtype=float) for r in df.collect()}
    got = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        assert abs(r.score - x[r.query_id] @ x[r.vec_id]) < 1e-12
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    hits = 0
    for q, found in got.items():
        assert found == sorted(found)
        true = sorted((-(x[q] @ v), i) for i, v in x.items() if i != q)[:20]
        hits += len({i for _, i in true} & {i for _, i in found})
    assert hits >= 0.9 * 20 * len([q for q in x if q % 20 == 0])


def test_neighbours_of_unlike_lengths_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATES", 50)
    rnd = random.Random(3)
    data = [(i, [rnd.gauss(0, 1) * (1 + i % 5) for _ in range(4)]) for i in range(300)] + BAD + [(9007, [0.0] * 4)]
    df = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<double>, bucket string")
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    true = expect([d for d in data if d[0] != 9007], lambda a, b: float(a @ b))
    assert set().union(*got.values()) <= {i for i, _ in data[:300]}
    assert sum(len(got[q] & {i for i, _ in true[q]}) for q in got) >= 0.9 * sum(len(v) for q, v in true.items() if q < 300)


def test_index_follows_the_data(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(150, 32))
    data = (centers[rng.integers(0, 150, 6000)] + 0.15 * rng.normal(size=(6000, 32))).astype(np.float32)
    x = data.astype(float)
    u = x / np.sqrt((x * x).sum(1))[:, None]
    fine, probes, recall, share = ann.fitted(u, u, np.arange(len(u)), 20, ann.TABLES, len(u))
    assert recall >= ann.RECALL and share < 0.15  # close neighbours: a small share of the rows is looked at
    assert ann.fitted(u, u, np.arange(len(u)), 20, ann.TABLES, 10**8)[3] <= share + 1e-9
    noise = rng.normal(size=(2000, 32))
    v = noise / np.sqrt((noise * noise).sum(1))[:, None]
    assert ann.fitted(v, v, np.arange(len(v)), 20, ann.TABLES, len(v))[2] >= ann.RECALL
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(u)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    near = u[::20] @ u.T
    near[np.arange(len(near)), np.arange(0, len(u), 20)] = -9
    true = np.argsort(-near, 1)[:, :20]
    assert sum(len(got[20 * k] & set(t.tolist())) for k, t in enumerate(true)) >= 0.9 * true.size


def test_finer_buckets_hold_the_row_itself():
    x = np.random.default_rng(2).normal(size=(50, 16))
    for fine in (1, 8):
        all_ = ann.buckets(x, 1, 32 * fine, fine)
        assert (np.sort(all_, 1) == np.arange(32 * fine)).all() and (ann.buckets(x, 1, 1, fine)[:, 0] == all_[:, 0]).all()
        assert (ann.buckets(x, 1, 5, fine) == all_[:, :5]).all()


def test_hadamard_rotation_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 11))
    assert np.allclose((ann.rotate(x, 3) ** 2).sum(1), (x**2).sum(1))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert exact_topk.top_scores(df).count() == 0 and ann.nearest(df).count() == 0
