"""Mixing sources to target weights, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import cut

#: Fixed values of the mix: weights of the sources in code-point order, repeating; share of all words; most epochs.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS) -> DataFrame:
    """One row per source: its words, documents and target.

    The sources share ``share`` times all words by weight; a target stops at ``max_epochs`` times its
    source, and the excess goes to the others by weight until none is above. That limit is water-filling:
    with the sources in order of cap over weight, those before the first that the level doesn't fill are full.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("whole", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("whole") - F.col("full")) / F.col("left_weight"))
        .withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
        .withColumn("final", F.max(F.when(F.col("open"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight")))
    return s.select("source", "source_size", "n_docs", target.alias("target"))


def mix(documents: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, source, size, source_size, target, and taken: the words of each document that the mix takes.

    Every document gets a hash-random key; a source's keys fall into ranges (as many as the square root of
    its documents, so neither a range nor a source's list of ranges is large); a prefix sum over range totals
    and one within each range give every document its place. The target holds whole epochs and a rest: documents
    that end before the rest are taken once more, and the one that crosses it gives just the words that are missing.

    A null text has size 0 and gives nothing; a null source is a source of its own, last in order; equal rows share
    a key and are ordered by size; an empty table gives an empty result. Other columns are ignored.
    """
    spark = documents.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = cut(documents.select("doc_id", "source", size.alias("size")))
    targets = source_targets(sizes)
    key = F.xxhash64(F.lit(seed), "doc_id")
    # 2**-64 of the key, as a place from 0 to 1
    place = F.col("key").cast("double") / F.lit(2.0**64) + F.lit(0.5)
    keyed = (
        sizes.withColumn("key", key)
        .join(F.broadcast(targets) if _few(spark, targets) else targets, sizes["source"].eqNullSafe(targets["source"]))
        .drop(targets["source"])
        .withColumn("range", F.least(F.floor(place * F.ceil(F.sqrt("n_docs"))), F.ceil(F.sqrt("n_docs")) - 1))
    )
    ranges = keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    ordered = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("range_before", F.coalesce(F.sum("range_size").over(ordered), F.lit(0)))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inner = keyed.withColumn("inner_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    r = ranges.select(F.col("source").alias("r_source"), F.col("range").alias("r_range"), "range_before")
    placed = inner.join(r, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range")))
    before = F.col("range_before") + F.col("inner_before")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor("target") - F.col("epochs") * F.col("source_size")
    more = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - before))
    return placed.withColumn("epochs", epochs).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + more).cast("long").alias("taken")
    )


def _few(spark, targets: DataFrame, most: int = 10_000) -> bool:
    """Whether the table of sources is small enough to broadcast."""
    return targets.limit(most + 1).count() <= most


def mixed_documents(documents: DataFrame, seed: int = 1) -> DataFrame:
    """The mix as rows of ``documents``: a document comes as often as its words are taken, in whole copies.

    Only the one document that crosses a source's budget is rounded. As the places follow the hash keys, a
    source's epochs and its last key taken once more decide for every document, so no text is shuffled.
    Documents with no words or a null doc_id are never taken, and the latter don't count in their source's target either, so no source
    comes out short for them; equal rows are taken alike. Columns may have any names.
    """
    columns = documents.columns
    named = documents.where("doc_id is not null")
    taken = mix(named, seed).where("size > 0")
    copies = F.round(F.col("taken") / F.col("size"))
    epochs = F.floor(F.floor("target") / F.col("source_size"))
    last = taken.groupBy(F.col("source").alias("of")).agg(F.max(epochs).cast("int").alias("epochs"), F.max(F.when(copies > epochs, F.xxhash64(F.lit(seed), "doc_id"))).alias("last"))
    last = F.broadcast(last) if _few(documents.sparkSession, last) else last
    out = named.where(F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    out = out.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("source"), F.xxhash64(F.lit(seed), "doc_id").alias("key"))
    out = out.join(last, out["source"].eqNullSafe(F.col("of")))
    once_more = F.coalesce((F.col("key") <= F.col("last")).cast("int"), F.lit(0))
    out = out.withColumn("copies", F.col("epochs") + once_more).where("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
