import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, component int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "clash", 9) for i, v in rows], SCHEMA)


def grid(vectors):
    return [[math.floor(1024 * float(c)) + 100_000 for c in np.asarray(v, np.float32)] for v in vectors]


def check(spark, vectors, components=8):
    """Against numpy's eigenvectors and Python's integers."""
    rows = whitening.whitened(frame(spark, enumerate(vectors)), components).collect()
    x = grid(vectors)
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    c = np.array([[n * r[j] - sums[j] for j in range(d)] for r in x], np.float64) / n
    values, turn = np.linalg.eigh(c.T @ c / n)
    values, turn = values[::-1], turn[:, ::-1]
    k = min(d, components)
    assert sorted((r.vec_id, r.component) for r in rows) == [(i, j) for i in range(n) for j in range(1, k + 1)]
    got = {(r.vec_id, r.component): r for r in rows}
    for i in range(n):
        assert int(got[i, 1].deviation) == sum((n * x[i][j] - sums[j]) ** 2 for j in range(d))
    trace = values.sum()
    for j in range(1, k + 1):
        assert got[0, j].n == n and got[0, j].explained == pytest.approx(max(values[j - 1], 0) / trace, rel=1e-9, abs=1e-12)
        mine = [got[i, j].whitened for i in range(n)]
        if values[j - 1] > 1e-12 * trace:
            expected = c @ turn[:, j - 1] / math.sqrt(values[j - 1])
            sign = np.sign(np.dot(mine, expected))
            assert np.abs(sign * np.array(mine) - expected).max() < 1e-7
            assert got[0, j].identity_error < 1e-9
        else:
            assert mine == [None] * n
    return got


def test_whitened_equals_numpy_on_flat_and_steep_spectra(spark):
    r = np.random.default_rng(3)
    flat = r.standard_normal((400, 48))
    check(spark, flat / np.linalg.norm(flat, axis=1, keepdims=True))
    check(spark, r.standard_normal((300, 40)) * np.geomspace(1, 1e-3, 40))
    check(spark, np.concatenate([r.standard_normal((90, 36)), np.tile(r.standard_normal(36), (45, 1))]))  # one vector holds a third of the rows


def test_fewer_dimensions_or_vectors_than_components(spark):
    r = np.random.default_rng(4)
    check(spark, r.standard_normal((50, 3)))
    check(spark, r.standard_normal((4, 40)))
    check(spark, [[0.5, 0.25], [0.5, 0.25], [0.25, 0.5]])


def test_equal_vectors_have_no_whitened_value(spark):
    rows = whitening.whitened(frame(spark, [(1, [0.5] * 10), (2, [0.5] * 10)])).collect()
    assert len(rows) == 16 and all(r.whitened is None and r.identity_error is None and r.explained == 0 and r.deviation == 0 for r in rows)


def test_nulls_repeats_other_lengths_and_empty_tables(spark):
    r = np.random.default_rng(5)
    good = [(7, r.standard_normal(5)), (7, r.standard_normal(5)), (None, r.standard_normal(5)), (9, [3e38, 0, 0, 0, 1])]
    bad = [(1, None), (2, [0.1, None, 0, 0, 0]), (3, [float("nan")] * 5), (4, [float("inf")] * 5), (5, []), (6, [0.5])]
    rows = whitening.whitened(frame(spark, good + bad)).collect()
    assert sorted((str(x.vec_id), x.component) for x in rows) == sorted((str(i), j) for i, _ in good for j in range(1, 6))
    assert {x.n for x in rows} == {4}
    assert whitening.whitened(frame(spark, [])).collect() == [] and whitening.whitened(frame(spark, bad[:5])).collect() == []


def test_deviation_beyond_64_bits_is_exact():
    d = np.array([[3_000_000_019, -2_999_999_999], [1, 2]], np.int64)
    assert [int(v) for v in whitening._deviation(d).to_pylist()] == [3_000_000_019**2 + 2_999_999_999**2, 5]


def test_a_missed_component_is_seen():
    values = np.linspace(1, 2, 40)
    v = np.diag(values)
    random = np.random.default_rng(1)
    top = np.eye(40)[:, ::-1][:, :8]
    assert not whitening._missed(values[::-1][:8], top, lambda q: v @ q, random, 0.9, 1.5)
    without = np.eye(40)[:, ::-1][:, 1:9]
    assert whitening._missed(values[::-1][1:9], without, lambda q: v @ q, random, 0.9, 1.5)


def test_lower_bound_lies_below_the_spectrum():
    r = np.random.default_rng(2)
    for d in (2, 10, 60):
        a = r.standard_normal((3 * d, d))
        v = a.T @ a
        assert whitening._lower_bound(lambda q, v=v: v @ q, r.standard_normal(d), 8) <= np.linalg.eigvalsh(v)[0] * (1 + 1e-9) + 1e-12


def test_columns(spark):
    out = whitening.whitened(frame(spark, [(1, [0.1, 0.2]), (2, [0.3, 0.1]), (3, [0.0, 0.9])]))
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "decimal(38,0)", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert out.where(F.col("whitened").isNull()).count() == 0
