"""References by any of several ids: one key map, then a plain equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def key_map(df: DataFrame, ids: list[str], canonical: str, scope: list[str]) -> DataFrame:
    """(scope, key, canonical): a row for each distinct id of a record, one record per key (the smallest canonical id)."""
    keys = df.select(*scope, canonical, F.explode(F.array_distinct(F.array_compact(F.array(*[F.nullif(F.col(i).cast("string"), F.lit("")) for i in ids])))).alias("key"))
    return keys.groupBy(*scope, "key").agg(F.min(canonical).alias(canonical))


def resolve(df: DataFrame, column: str, keys: DataFrame, canonical: str, scope: list[str]) -> DataFrame:
    """``column`` becomes the canonical id; an unknown value is kept."""
    k = keys.withColumnRenamed("key", column).withColumnRenamed(canonical, "_canonical")
    return df.join(k, [*scope, column], "left").withColumn(column, F.coalesce(F.col("_canonical").cast("string"), column)).drop("_canonical")


def first_in_order(df: DataFrame, keys: list[str], *order) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
