"""Shared parts of the vector searches: usable vectors, blocks, and the merge of partial results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The stated query set: rows whose id is divisible by this.
QUERY_STEP = 20
TOP = 20


def is_query(vec_id: Column) -> Column:
    return F.pmod(vec_id, F.lit(QUERY_STEP)) == 0


def usable(embeddings: DataFrame, nonzero: bool = False) -> DataFrame:
    """vec_id and embedding of the vectors that take part: not null, without null or non-finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = embeddings.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    return out.where(F.exists("embedding", lambda x: x != 0)) if nonzero else out


def matrix(table: pa.Table, column: str = "embedding") -> np.ndarray:
    """The vectors of a block, all of one length, as rows of doubles."""
    col = table.column(column).combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(table.num_rows, -1) if table.num_rows else flat.reshape(0, 0)


def ids(table: pa.Table) -> np.ndarray:
    return table.column("vec_id").to_numpy().astype(np.int64)


def best(found: DataFrame, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the highest scores of each query, ties to the smaller vec_id.

    Each block gives at most ``top`` rows a query, and Spark cuts each partition's share again before the shuffle.
    """
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
