"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import lean, ship
from tallyforge.llm.vectors import TOP, best, ids, is_query, matrix, usable

#: Hash tables, and rows of a block of one bucket (candidates, queries).
TABLES = 8
CANDIDATES, QUERIES = 4096, 2048
SEED = 20
#: The index is fitted on so many rows at most: axes of the second hash (1: none) and probes a table, so that the sample's own queries
#: have this recall at the least cost: products, and copies of the query, each counted as so many products. More rows only bring the
#: neighbours closer.
SAMPLE, SAMPLE_QUERIES, RECALL, COPY = 16_384, 128, 0.94, 50
FINE = (1, 8, 32)
PROBED = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, 256, 512, 1024)


def rotate(x: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform, over a power of two of coordinates."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    y = np.zeros((n, size))
    y[:, :d] = x
    rng = np.random.default_rng((seed, table))
    for _ in range(3):
        y *= rng.choice((-1.0, 1.0), size)
        h = 1
        while h < size:
            z = y.reshape(n, size // (2 * h), 2, h)
            y = np.stack((z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]), 2).reshape(n, size)
            h *= 2
        y /= np.sqrt(size)
    return y


def signed(y: np.ndarray) -> np.ndarray:
    return np.concatenate((y, -y), 1)


def buckets(x: np.ndarray, table: int, probes: int, fine: int = 1) -> np.ndarray:
    """The nearest buckets of each row, nearest first, up to ``probes``.

    A bucket is a signed axis of one rotation, and with ``fine`` a signed axis among the first coordinates of another rotation too. How far a
    bucket is from a row is the sum of squares of what the row's own axes have more than the bucket's.
    """
    v = signed(rotate(x, table))
    probes = min(probes, v.shape[1] * fine)
    first = min(probes, v.shape[1])
    p = np.argpartition(-v, first - 1, axis=1)[:, :first]
    p = np.take_along_axis(p, np.argsort(-np.take_along_axis(v, p, 1), axis=1, kind="stable"), 1)
    if fine == 1:
        return p
    far = np.take_along_axis(v, p, 1)
    far = (far[:, :1] - far) ** 2
    w = rotate(x, table, SEED + 1)
    w = signed(np.pad(w, ((0, 0), (0, max(0, fine // 2 - w.shape[1]))))[:, : fine // 2])
    cost = (far[:, :, None] + ((w.max(1, keepdims=True) - w) ** 2)[:, None, :]).reshape(len(x), -1)
    k = np.argpartition(cost, probes - 1, axis=1)[:, :probes] if probes < cost.shape[1] else np.argsort(cost, axis=1)
    k = np.take_along_axis(k, np.argsort(np.take_along_axis(cost, k, 1), axis=1, kind="stable"), 1)
    return np.take_along_axis(p, k // fine, 1) * fine + k % fine


def fitted(indexed: np.ndarray, asked: np.ndarray, ids: np.ndarray, top: int, tables: int, total: int) -> tuple[int, int, float, float]:
    """Axes of the second hash, probes a table, the recall and the share of the rows that a query is compared with, on a sample.

    ``indexed`` and ``asked`` are the sample's unit vectors as rows of the index and as queries; ``total`` is the number of all rows.
    """
    n = len(indexed)
    q = np.arange(0, n, max(1, n // SAMPLE_QUERIES))[:SAMPLE_QUERIES]
    near = asked[q] @ indexed.T
    near[ids[q][:, None] == ids[None, :]] = -np.inf
    k = min(top, n - 1)
    if k < 1:
        return 1, 1, 1.0, 1.0
    true = np.argpartition(-near, k - 1, axis=1)[:, :k]
    axes = 2 * rotate(indexed[:1], 0).shape[1]
    best, least = None, np.inf
    for fine in FINE:
        home = [buckets(indexed, t, 1, fine)[:, 0] for t in range(tables)]
        probes = [x for x in PROBED if x < axes * fine] + [axes * fine]
        probed = [buckets(asked[q], t, probes[-1], fine) for t in range(tables)]
        # in which probe a query meets each row, by table
        met = np.empty((tables, len(q), n), np.int32)
        place = np.empty((len(q), axes * fine), np.int32)
        for t in range(tables):
            np.put_along_axis(place, probed[t], np.arange(probed[t].shape[1], dtype=np.int32)[None, :], 1)
            met[t] = place[:, home[t]]
        first = np.take_along_axis(met.min(0), true, 1)
        for x in probes:
            recall = (first < x).mean()
            share = (met < x).mean() * tables
            if recall >= RECALL or x == probes[-1]:
                cost = share * total + COPY * tables * x
                if best is None or (recall >= RECALL and cost < least):
                    best, least = (fine, x, float(recall), float(share)), cost
                break
    return best


def lifted(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Unit vectors whose order of nearness is that of the inner product, even for vectors of unlike lengths."""
    norm = np.sqrt((x * x).sum(1))
    if query:
        return np.concatenate((x / norm[:, None], np.zeros((len(x), 1))), 1)
    rest = np.sqrt(np.maximum(0, longest * longest - norm * norm))
    return np.concatenate((x, rest[:, None]), 1) / longest


def search(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The exact inner products of a block, the ``top`` of each query."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    out = [[], [], []]
    for lo in range(0, len(q), 256):
        qs, qi = q[lo : lo + 256], q_ids[lo : lo + 256]
        near = qs @ c.T
        near[qi[:, None] == c_ids[None, :]] = -np.inf
        k = min(top, len(c))
        least = np.partition(near, len(c) - k, axis=1)[:, len(c) - k]
        qa, ca = np.nonzero(near >= np.maximum(least - 1e-9 * np.maximum(1, np.abs(least)), np.finfo(float).min)[:, None])
        score = np.empty(len(qa))
        for a in range(0, len(qa), 1 << 16):
            part = slice(a, a + (1 << 16))
            score[part] = (qs[qa[part]] * c[ca[part]]).sum(1)
        order = np.lexsort((c_ids[ca], -score, qa))
        qa, ca, score = qa[order], ca[order], score[order]
        keep = np.arange(len(qa)) - np.searchsorted(qa, qa, "left") < top
        for o, v in zip(out, (qi[qa[keep]], c_ids[ca[keep]], score[keep]), strict=True):
            o.append(v)
    return tuple(np.concatenate(o) if o else np.zeros(0) for o in out)


def unit(x: np.ndarray, even: bool, longest: float, query: bool) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None] if even else lifted(x, longest, query)


def sample_fit(rows: DataFrame, count: int, even: bool, longest: float, top: int, tables: int) -> tuple[int, int, float, float]:
    """:func:`fitted` on at most SAMPLE rows of the most common length, chosen by hash."""
    part = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, count)) * (1 << 30)))
    got = part.select("vec_id", "embedding", "dim").limit(2 * SAMPLE).toArrow()
    if not got.num_rows:
        return 1, 1, 1.0, 1.0
    dims = got.column("dim").to_numpy()
    got = got.filter(pa.compute.equal(got.column("dim"), int(np.bincount(dims).argmax())))
    x = matrix(got)
    return fitted(unit(x, even, longest, False), unit(x, even, longest, True), ids(got), top, tables, count)


def nearest(embeddings: DataFrame, top: int = TOP, tables: int = TABLES, probes: int | None = None, fine: int = 1) -> DataFrame:
    """query_id, rank, vec_id and score: for every query (see vectors.QUERY_STEP) the ``top`` nearest rows found.

    Every row is indexed in every table under its nearest signed axes; a query looks at its ``probes`` nearest buckets of each. Without
    ``probes`` they and ``fine`` are fitted on a bounded sample: where rows have close neighbours, few small buckets do; where all rows are
    about equally far apart, no index can spare much.
    A bucket is split into blocks by its count, so the rows of a very common vector don't meet in one task; a block
    gives each of its queries its best exact products, and the best of all blocks remain.
    Vectors null, zero or holding null or non-finite components take no part; vectors of different lengths never meet;
    of repeated ids each row is indexed, but the result has an id once a query. Other columns are ignored; an empty
    table gives an empty result. A query with fewer rows in its buckets than ``top`` gets those.
    """
    spark = embeddings.sparkSession
    ship(spark)
    rows = usable(embeddings, nonzero=True).withColumn("dim", F.size("embedding"))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    ends = rows.select(F.sqrt(square).alias("n"), "dim").agg(F.max("n").alias("hi"), F.min("n").alias("lo"), F.count("*").alias("rows")).first()
    longest = float(ends["hi"] or 1.0)
    even = longest - float(ends["lo"] or 0.0) < 1e-3 * longest
    if probes is None:
        fine, probes, _, _ = sample_fit(rows, ends["rows"], even, longest, top, tables)

    def placed(query: bool):
        """Arrow tables of rows with one table's buckets of each, nearest first."""

        def work(batches):
            from tallyforge.llm.ann import buckets, unit
            from tallyforge.llm.vectors import matrix

            for b in batches:
                t = pa.Table.from_batches([b])
                for dim in set(t.column("dim").to_pylist()):
                    part = t.filter(pa.compute.equal(t.column("dim"), dim))
                    for lo in range(0, part.num_rows, 4096):
                        some = part.slice(lo, 4096).combine_chunks()
                        x = unit(matrix(some), even, longest, query)
                        for k in range(tables):
                            yield some, dim, k, buckets(x, k, probes if query else 1, fine)

        return work

    def index(query: bool):
        def work(batches):
            for some, _, k, h in placed(query)(batches):
                cols = [some.column(n).combine_chunks() for n in ("vec_id", "embedding", "dim")]
                for p in range(h.shape[1]):
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(h), k, np.int32)), pa.array(h[:, p].astype(np.int32))], ["vec_id", "embedding", "dim", "t", "bucket"])

        return work

    def counted(query: bool):
        def work(batches):
            for _, dim, k, h in placed(query)(batches):
                bucket, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), v, np.int32)) for v in (dim, k)] + [pa.array(bucket.astype(np.int32)), pa.array(n.astype(np.int64))], ["dim", "t", "bucket", "n"])

        return work

    element = embeddings.schema["embedding"].dataType.elementType.simpleString()
    id_kind = embeddings.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_kind}, embedding array<{element}>, dim int, t int, bucket int"
    keys = ["dim", "t", "bucket"]
    asking = rows.where(is_query(F.col("vec_id")))
    c = rows.mapInArrow(lean(index(False)), schema)
    q = asking.mapInArrow(lean(index(True)), schema)
    # at most tables * axes * fine * lengths rows
    short = "dim int, t int, bucket int, n bigint"
    size = rows.select("embedding", "dim").mapInArrow(lean(counted(False)), short).groupBy(*keys).agg(F.sum("n").alias("n"))
    asked = asking.select("embedding", "dim").mapInArrow(lean(counted(True)), short).groupBy(*keys).agg(F.sum("n").alias("m"))
    plan = size.join(asked, keys).select(*keys, F.ceil(F.col("n") / CANDIDATES).cast("int").alias("cs"), F.ceil(F.col("m") / QUERIES).cast("int").alias("qs"))
    plan_rows, kinds = plan.collect(), f"{', '.join(k + ' int' for k in keys)}, cs int, qs int"
    hashed = F.xxhash64("vec_id", "embedding")
    c = c.join(F.broadcast(spark.createDataFrame(plan_rows, kinds)), keys).withColumn("cb", F.pmod(hashed, F.col("cs"))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qs").cast("long") - 1))).drop("cs", "qs")
    q = q.join(F.broadcast(spark.createDataFrame(plan_rows, kinds)), keys).withColumn("qb", F.pmod(hashed, F.col("qs"))).withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cs").cast("long") - 1))).drop("cs", "qs")

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        from tallyforge.llm.ann import search
        from tallyforge.llm.vectors import ids, matrix

        if left.num_rows and right.num_rows:
            a, b, s = search(ids(right), matrix(right), ids(left), matrix(left), top)
        else:
            a = b = s = np.zeros(0)
        return pa.Table.from_pydict({"query_id": pa.array(a.astype(np.int64)), "vec_id": pa.array(b.astype(np.int64)), "score": pa.array(s.astype(np.float64))})

    keys += ["cb", "qb"]
    found = c.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(block, "query_id bigint, vec_id bigint, score double")
    return best(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), top)
