"""Exact top-k search by multi-resolution segment statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import ship
from tallyforge.llm.vectors import TOP, best, is_query, usable

#: Rows of a block of candidates and of queries; segments at each resolution.
CANDIDATES, QUERIES = 2048, 4096
SEGMENTS = (1, 4, 16)
#: Queries that a task takes at a time, and the share of survivors above which a resolution is computed for all.
STRIP, DENSE = 256, 0.05


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """For each segment its mean and the length of the deviations from it, so scaled that the product of two rows
    is never below the inner product of their vectors (and so half of the sum of squares less it bounds the distance)."""
    parts = np.array_split(x, min(segments, x.shape[1]), axis=1)
    cols = []
    for p in parts:
        m = p.mean(1)
        cols += [m * np.sqrt(p.shape[1]), np.sqrt(((p - m[:, None]) ** 2).sum(1))]
    return np.stack(cols, 1)


def search(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``top`` candidates of each query in one block, exact. Vectors hold integers."""
    stats = [(statistics(q, s), statistics(c, s)) for s in SEGMENTS]
    out = [[], [], []]
    for lo in range(0, len(q), STRIP):
        strip = slice(lo, lo + STRIP)
        qs, qi = q[strip], q_ids[strip]
        bound = stats[0][0][strip] @ stats[0][1].T
        own = qi[:, None] == c_ids[None, :]
        bound[own] = -np.inf
        k = min(top, c.shape[0])
        # the exact scores of the k best bounds give a score that the k-th best has at least
        first = np.argpartition(-bound, k - 1, axis=1)[:, :k]
        exact = np.einsum("qd,qkd->qk", qs, c[first])
        exact[np.take_along_axis(own, first, 1)] = -np.inf
        least = exact.min(1)
        slack = 1e-9 * (1 + np.abs(bound[np.isfinite(bound)]).max(initial=0.0))
        alive = (bound + slack >= least[:, None]) & ~own
        for sq, sc in [*((x[strip], y) for x, y in stats[1:]), (qs, c)]:  # the last resolution is the vector itself
            last = sc is c
            if alive.mean() > DENSE:
                bound = sq @ sc.T
                alive &= bound + slack >= least[:, None]
                if last:
                    bound[~alive] = -np.inf
                    alive &= bound >= np.partition(bound, len(c) - k, axis=1)[:, len(c) - k, None]
                    qa, ca = np.nonzero(alive)
                    score = bound[qa, ca]
            else:
                qa, ca = np.nonzero(alive)
                score = np.empty(len(qa))
                for a in range(0, len(qa), 1 << 17):
                    part = slice(a, a + (1 << 17))
                    score[part] = np.einsum("ij,ij->i", sq[qa[part]], sc[ca[part]])
                if not last:
                    alive[qa, ca] = score + slack >= least[qa]
        order = np.lexsort((c_ids[ca], -score, qa))
        qa, ca, score = qa[order], ca[order], score[order]
        place = np.arange(len(qa)) - np.searchsorted(qa, qa, "left")
        keep = place < top
        for o, v in zip(out, (qi[qa[keep]], c_ids[ca[keep]], score[keep]), strict=True):
            o.append(v)
    return tuple(np.concatenate(o) if o else np.zeros(0) for o in out)


def top_scores(embeddings: DataFrame, top: int = TOP, queries: DataFrame | None = None) -> DataFrame:
    """query_id, rank, vec_id and score: for every query (see vectors.QUERY_STEP) its ``top`` highest inner products.

    Components become floor(64 * x). Candidates are dealt into blocks by a hash of the row and each block meets each
    block of queries; a task holds one block of either. The work is that of a stated query set against all rows.
    Vectors null or holding null or non-finite components take no part; vectors of different lengths never meet;
    of repeated ids each row is a candidate, but none of a query's own id. Other columns are ignored; an empty table
    gives an empty result.
    """
    ship(embeddings.sparkSession)
    rows = usable(embeddings).withColumn("dim", F.size("embedding"))
    asked = rows.where(is_query(F.col("vec_id"))) if queries is None else usable(queries).withColumn("dim", F.size("embedding"))
    n, m = rows.count(), asked.count()
    nc, nq = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))
    hashed = F.xxhash64("vec_id", "embedding")
    c = rows.withColumn("cb", F.pmod(hashed, F.lit(nc))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    q = asked.withColumn("qb", F.pmod(hashed, F.lit(nq)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nc - 1).cast("long"))))

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        from tallyforge.llm.exact_topk import search
        from tallyforge.llm.vectors import ids, matrix

        if left.num_rows and right.num_rows:
            a, b, s = search(ids(right), np.floor(64 * matrix(right)), ids(left), np.floor(64 * matrix(left)), top)
        else:
            a = b = s = np.zeros(0)
        return pa.Table.from_pydict({"query_id": pa.array(a.astype(np.int64)), "vec_id": pa.array(b.astype(np.int64)), "score": pa.array(s.astype(np.int64))})

    keys = ("dim", "cb", "qb")
    found = c.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(block, "query_id bigint, vec_id bigint, score bigint")
    return best(found, top)
