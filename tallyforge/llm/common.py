"""Shared helpers: the folder all machines share, code shipping, and text as numpy arrays."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Where none is set, a local session gets a temporary one and a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="tallyforge-ckpt-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to a new table in the shared folder and read it again (columns are pruned on reading)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that tasks can import it anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_tallyforge_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tallyforge-zip-"), "tallyforge_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("tallyforge", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._tallyforge_shipped = True


#: Rows of a table of bits, and bits of a row.
WORDS, BITS = 1 << 19, 64


def near_rows(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` that may have a partner in ``keys`` (column id), and rows that surely have none.

    The test is a bit for each remainder of the key, 64 to a row, so what is broadcast never has more than WORDS rows, whatever the number of
    keys; the rows without a partner stay out of the shuffle of a join. A million keys set 3 of 100 bits, 16 million 39; where all would be
    set, every row may have a partner, and nothing is broadcast. A null key has no partner.
    """
    if keys.count() > WORDS * BITS:
        return df, df.where(F.lit(False))
    place = lambda k: F.pmod(k, F.lit(WORDS * BITS).cast("long"))
    word, bit = F.expr("shiftright(_place, 6)"), F.expr("shiftleft(1L, cast(_place & 63L as int))")
    marks = keys.where("id is not null").select(place(F.col("id")).alias("_place")).select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    row = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_row"), place(key).alias("_place")).select("_row", word.alias("_own"), bit.alias("_bit"))
    hit = (F.col("_own") == F.col("_word")) & (F.col("_bits").bitwiseAND(F.col("_bit")) != 0)
    near, far = row.join(F.broadcast(marks), hit, "left_semi"), row.join(F.broadcast(marks), hit, "left_anti")
    return near.select("_row.*"), far.select("_row.*")


def lean(work):
    """A task function over batches that gives its unused memory back when it ends: workers live on, idle or in other stages."""

    def run(batches):
        yield from work(batches)
        release()

    return run


def release() -> None:
    """Return unused memory of Arrow and of the C library to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- text as arrays -------------------------------------------------------------------------

#: Bytes of text that are turned into arrays at a time (one longer document is taken alone).
CHUNK_BYTES = 1 << 20

SEP = np.zeros(256, bool)
SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MUL = np.uint64(0x9E3779B97F4A7C15)
_pw = np.ones(1, np.uint64)
_ipw = np.ones(1, np.uint64)
_BASE = 0x27D4EB2F165667C5
_INV = pow(_BASE, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    global _pw, _ipw
    if len(_pw) < n:
        m = max(n, 2 * len(_pw), 1 << 16)
        out = []
        for base in (_BASE, _INV):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _pw, _ipw = out
    return _pw[:n], _ipw[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of (byte + 1) * base**k for i <= k < j."""
    pw, _ = powers(len(b) + 1)
    p = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * pw[: len(b)], out=p[1:])
    return p


def span_hash(p: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes s to e, with the length mixed in."""
    _, ipw = powers(len(p))
    return mix((p[e] - p[s]) * ipw[s] + (e - s).astype(np.uint64) * _MUL)


def text_chunks(batch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds) of an Arrow batch; a null text is empty."""
    import pyarrow as pa

    col = batch.column(column)
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    n = len(col)
    if not n:
        return
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_hashes(b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, and the number of its document."""
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    b = LOWER[b]
    sep = SEP[b]
    cutoff = np.zeros(len(b) + 1, bool)
    cutoff[bounds] = True
    before = np.empty(len(b), bool)
    before[0] = True
    before[1:] = sep[:-1]
    start = np.flatnonzero(~sep & (before | cutoff[:-1]))
    after = np.empty(len(b), bool)
    after[-1] = True
    after[:-1] = sep[1:]
    end = np.flatnonzero(~sep & (after | cutoff[1:])) + 1
    return span_hash(prefix_hash(b), start, end), np.searchsorted(bounds, start, "right") - 1


def shingle_hashes(b: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the n-word shingles of each document, sorted within it, and the offsets of
    the documents. A document of fewer words has the whole sequence as its one shingle."""
    h, doc = word_hashes(b, bounds)
    docs = len(bounds) - 1
    words = np.bincount(doc, minlength=docs)
    if len(h) >= n:
        m = len(h) - n + 1
        g = h[:m].copy()
        for k in range(1, n):
            g = mix(g * _MUL + h[k : m + k])
        ok = doc[:m] == doc[n - 1 :]
        g, gd = g[ok], doc[:m][ok]
    else:
        g, gd = h[:0], doc[:0]
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):
        first = np.concatenate(([0], np.cumsum(words)))[short]
        s = np.full(len(short), 77, np.uint64)
        for k in range(n - 1):
            on = words[short] > k
            s[on] = mix(s[on] * _MUL + h[first[on] + k] + np.uint64(k + 1))
        g, gd = np.concatenate((g, s)), np.concatenate((gd, short))
    order = np.lexsort((g, gd))
    g, gd = g[order], gd[order]
    if len(g):
        keep = np.ones(len(g), bool)
        keep[1:] = (g[1:] != g[:-1]) | (gd[1:] != gd[:-1])
        g, gd = g[keep], gd[keep]
    return g, np.concatenate(([0], np.cumsum(np.bincount(gd, minlength=docs))))
