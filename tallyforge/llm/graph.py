"""Connected components with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import cut

#: A node is a hub from so many links on, or from the total over HUBS on; so there are at most 2 * HUBS hubs.
HUB_LINKS, HUBS = 1000, 10_000


def _with_least(links: DataFrame, total: int) -> DataFrame:
    """(a, b, m) of links (a, b): m is the least of a and the nodes it is linked with.

    The links of a hub stay where they are, as the table of hubs is bounded; so no task gets more than a hub's worth of one node.
    """
    low = links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    many = max(HUB_LINKS, total // HUBS)
    hubs = F.broadcast(low.where(F.col("n") > many).select("a", "m"))
    rest = links.join(hubs.select("a"), "a", "left_anti").join(low.where(F.col("n") <= many).select("a", "m"), "a")
    return links.join(hubs, "a").select("a", "b", "m").union(rest.select("a", "b", "m"))


def _shape(e: DataFrame) -> tuple[int, int, bool]:
    """Of links (a, b): their number, the most links of a node, and whether each node hangs below one node that hangs below none."""
    ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    nodes = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"), F.count("*").alias("n"))
    amid = F.max(F.expr("up > 1 or up = 1 and down = 1"))
    links, most, other = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(amid, F.lit(False))).first()
    return links, most, not other


def _round(e: DataFrame, links: int, most: int) -> DataFrame:
    """Links (a, b) after a large-star and a small-star operation; may hold loops and repeated links.

    Where no node is a hub, a window finds the least neighbour, so each operation is one shuffle; only where there are hubs they are joined apart.
    """
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if most > max(HUB_LINKS, 2 * links // HUBS):
        least = lambda x: _with_least(x, 2 * links)
        once = lambda x: x.distinct()
    else:
        least = lambda x: x.withColumn("m", F.least(F.min("b").over(Window.partitionBy("a")), F.col("a")))
        once = lambda x: x
    # large-star: larger neighbours are linked to the smallest neighbour of their node
    big = once(least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
    # small-star: a node and its smaller neighbours are linked to the smallest of them
    return least(big).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")


def shortened(edges: DataFrame, rounds: int) -> tuple[DataFrame, bool]:
    """Links (a, b), b < a, with the components of ``edges`` after so many rounds at most, and whether all are stars by then.

    A round: every node is hung below the smallest neighbour of its root, then paths are halved (alternating large-star and small-star
    operations). A node of very many links is pre-aggregated and joined by a bounded broadcast. Each round is cut with a checkpoint.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        links, most, settled = _shape(e)
        if settled:
            return e, True
        e = cut(_round(e, links, most).where("a <> b").distinct())
    return e, False


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (id, component) for the nodes of ``edges`` (columns a, b); component is the smallest id reachable.

    Distributed union-find by :func:`shortened`, until every node hangs below its component's smallest. Loops, repeated and null edges are
    ignored; an empty input gives an empty table.
    """
    e, settled = shortened(edges, rounds)
    if not settled:
        raise RuntimeError("components have not settled")
    tails = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return tails.union(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
