"""Versions of a table: the latest row per key, upserts, and conflict rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order (which must break all ties)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows without those that come again, and all incoming rows."""
    return stored.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def accept(stored: DataFrame, incoming: DataFrame, key: str = "id", clock: str = "updated_at") -> DataFrame:
    """Last write wins: each key's surviving row, and whether the incoming row was a conflict.

    A stored row that is newer stays and makes the incoming one a conflict; equal times accept the incoming row.
    """
    s = stored.select(F.col(key), F.struct(*stored.columns).alias("s"))
    i = incoming.select(F.col(key), F.struct(*incoming.columns).alias("i"))
    both = s.join(i, key, "full_outer")
    newer = F.coalesce(F.col(f"s.{clock}") > F.col(f"i.{clock}"), F.lit(False))
    pick = F.when(F.col("i").isNull() | newer, F.col("s")).otherwise(F.col("i"))
    return both.select(pick.alias("r"), (F.col("i").isNotNull() & newer).alias("conflict")).select("r.*", "conflict")


def differences(stored: DataFrame, fresh: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(kind, key, and each column before and after): the rows that make ``stored`` equal to ``fresh``: insert, update, delete.

    Two 64-bit hashes of a row's columns find what changed; only changed rows are joined with their columns. One row a key on either side.
    """
    mark = [F.xxhash64(F.lit(k), *columns).alias(f"_{k}") for k in (1, 2)]
    s, f = stored.select(key, *mark), fresh.select(key, *mark)
    old, new = s.select(F.col(key), F.struct("_1", "_2").alias("s")), f.select(F.col(key), F.struct("_1", "_2").alias("f"))
    kind = F.when(F.col("s").isNull(), "insert").when(F.col("f").isNull(), "delete").when(F.col("s") != F.col("f"), "update")
    changed = old.join(new, key, "full_outer").select(key, kind.alias("kind")).where("kind is not null")
    before = stored.select(key, *[F.col(k).alias(f"old_{k}") for k in columns])
    after = fresh.select(key, *[F.col(k).alias(f"new_{k}") for k in columns])
    return changed.join(before, key, "left").join(after, key, "left")
