"""Joins of texts: containment, edit similarity and shared words, without losing a pair and without comparing all.

All work on the distinct values of a column within a scope (such as a tenant) and return pairs of values, so a name that
many rows have is compared once. Candidates meet by what is rare: a text's frequent parts never make a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.components import cut, dealt

c = F.col


def distinct_values(df: DataFrame, column: str, scope: Sequence[str], name: str) -> DataFrame:
    """The non-empty values of a column in each scope, under ``name``."""
    return df.where(F.length(column) > 0).select(*scope, c(column).alias(name)).distinct()


def pieces(text: Column, size: Column | int) -> Column:
    """(gram, at) for each run of ``size`` characters; a shorter text is one run."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.greatest(F.length(text) - size + 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda k: F.struct(F.substring(text, k, size).alias("gram"), k.alias("at")))


def containing(needles: DataFrame, needle: str, texts: DataFrame, text: str, scope: Sequence[str] = (), size: int = 3) -> DataFrame:
    """(scope, needle, text): the pairs of values in which the text contains the needle, case and all.

    A needle looks for the rarest of its runs of ``size`` characters (itself, if shorter) among those of the texts; where
    that stands, the whole needle is compared at its place. A needle with a run that no text has ends there.
    """
    scope = list(scope)
    n = distinct_values(needles, needle, scope, "needle").withColumn("size", F.least(F.length("needle"), F.lit(size)))
    t = distinct_values(texts, text, scope, "text")
    sizes = [r[0] for r in n.select("size").distinct().collect()]  # at most ``size`` numbers
    if not sizes:
        sizes = [size]
    runs = F.flatten(F.array(*[F.when(F.length("text") >= k, pieces(c("text"), k)).otherwise(F.array().cast("array<struct<gram:string,at:int>>")) for k in sorted(sizes)]))
    gram = lambda p: F.xxhash64(p["gram"]).alias("gram")  # noqa: E731  the whole needle is compared later, so a hash will do
    have = dealt(t, "text").select(*scope, F.xxhash64("text").alias("id"), F.explode(runs).alias("p")).select(*scope, "id", gram(c("p")), "p.at")
    often = have.groupBy(*scope, "gram").agg(F.count("*").alias("often"))
    want = n.select(*scope, "needle", F.explode(pieces(c("needle"), c("size"))).alias("p")).select(*scope, "needle", gram(c("p")), c("p.at").alias("offset"))
    # what is made of the rows is many times their size, which the planner can't know: no side is broadcast whole
    want = want.hint("merge").join(often, [*scope, "gram"], "left").groupBy(*scope, "needle")
    rare = want.agg(F.min_by(F.struct("gram", "offset", "often"), F.struct(F.coalesce("often", F.lit(0)), "offset")).alias("r")).where("r.often is not null")
    rare = rare.select(*scope, "needle", "r.gram", "r.offset")
    met = have.hint("merge").join(rare, [*scope, "gram"])
    met = met.select(*scope, "needle", "id", (c("at") - c("offset") + 1).alias("start")).where("start > 0")
    keyed = t.withColumn("id", F.xxhash64("text"))
    found = met.hint("merge").join(keyed, [*scope, "id"]).where(F.substring(c("text"), c("start"), F.length("needle")) == c("needle"))
    return found.select(*scope, "needle", "text").distinct()


def edit_similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b).cast("double") / F.greatest(F.length(a), F.length(b))


def similar(left: DataFrame, a: str, right: DataFrame, b: str, scope: Sequence[str] = (), above: float = 0.85) -> DataFrame:
    """(scope, a, b): the pairs of values whose edit similarity is more than ``above``, equal ones included.

    Two texts of which the longer has n characters have at most k = floor(n * (1 - above)) edits. Cut into k + 1 segments, the longer has one
    that no edit touches, so the shorter has that segment too, moved by at most what the edits and the lengths allow: the two meet in a
    segment of its number, length and text. What all texts of a scope begin with is left out first, as it changes no distance.
    """
    scope = list(scope)
    if not 0.5 < above < 1:
        raise ValueError("above must lie between 0.5 and 1")
    x, y = distinct_values(left, a, scope, "v").withColumn("side", F.lit(0)), distinct_values(right, b, scope, "v").withColumn("side", F.lit(1))
    both = dealt(cut(x.unionByName(y)), "v")
    low, high = F.min("v").alias("low"), F.max("v").alias("high")
    ends = both.groupBy(*scope).agg(low, high) if scope else both.agg(low, high)
    same = F.aggregate(F.sequence(F.lit(1), F.length("low")), F.lit(0), lambda n, k: F.when((n == k - 1) & (F.substring("low", k, F.lit(1)) == F.substring("high", k, F.lit(1))), k).otherwise(n))
    ends = ends.where("low is not null").select(*scope, F.substring(c("low"), F.lit(1), same).alias("begin"))
    both = both.join(ends, scope) if scope else both.crossJoin(ends)
    both = both.withColumn("n", F.length("v")).withColumn("cut", F.length("begin")).withColumn("rest", F.substring(c("v"), c("cut") + 1, c("n")))
    edits = lambda n: F.floor(n * F.lit(1 - above) + 1e-9).cast("int")
    # of m characters in k + 1 segments the i-th (from 0) starts after floor(i * m / (k + 1))
    start = lambda m, k, i: F.floor(i * m / (k + 1)).cast("int")
    numbers = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    k, m = edits(c("n")), c("n") - c("cut")
    cuts = F.transform(F.sequence(F.lit(0), k), lambda i: F.struct(i.alias("i"), c("rest").substr(start(m, k, i) + 1, start(m, k, i + 1) - start(m, k, i)).alias("part")))
    longer = both.select(*scope, "side", "rest", c("n").alias("size"), F.explode(cuts).alias("s")).select(*scope, "side", "rest", "size", "s.i", "s.part")
    # the lengths that the longer one may have, then its segments, then the places at which they may stand in the shorter one
    sizes = numbers(c("n"), F.ceil(c("n") / F.lit(above) + 1e-9).cast("int"))
    s = both.select(*scope, "side", "n", "cut", "rest", F.explode(sizes).alias("size")).where(c("size") - c("n") <= edits(c("size")))
    k, m, less = edits(c("size")), c("size") - c("cut"), c("size") - c("n")
    s = s.select("*", F.explode(F.sequence(F.lit(0), k)).alias("i")).withColumn("at", start(m, k, c("i"))).withColumn("long", start(m, k, c("i") + 1) - c("at"))
    places = numbers(F.greatest(F.lit(0), c("at") - F.floor((k + less) / 2).cast("int")), F.least(c("n") - c("cut") - c("long"), c("at") + F.floor((k - less) / 2).cast("int")))
    found = F.array_distinct(F.transform(places, lambda p: c("rest").substr(p + 1, c("long"))))
    shorter = s.select(*scope, "side", "rest", "size", "i", F.explode(found).alias("part"))
    # what is made of the rows is many times their size, which the planner can't know: no side is broadcast whole
    keys = [*scope, "size", "i", "part"]
    met = None
    for near, other in ((0, 1), (1, 0)):  # equal lengths meet in the first turn
        p, q = shorter.where(c("side") == near).select(*keys, c("rest").alias("p")), longer.where(c("side") == other).select(*keys, c("rest").alias("q"))
        d = p.hint("merge").join(q, keys)
        if near:
            d = d.where(F.length("p") < F.length("q"))
        d = d.where(1 - F.levenshtein("p", "q").cast("double") / c("size") > above).select(*scope, c("p" if near == 0 else "q").alias("a"), c("q" if near == 0 else "p").alias("b"))
        met = d if met is None else met.unionByName(d)
    met = met.distinct()
    met = met.join(ends, scope) if scope else met.crossJoin(ends)
    return met.select(*scope, F.concat("begin", "a").alias("a"), F.concat("begin", "b").alias("b"))


def words(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(x, r"\s+"), lambda w: w != ""))


def sharing_words(left: DataFrame, a: str, right: DataFrame, b: str, scope: Sequence[str] = (), least: float = 0.78) -> DataFrame:
    """(scope, a, b): the pairs of values whose common words are at least ``least`` of the larger set of words.

    Such a pair lacks at most the floor of (1 - least) of either's words, so it shares one of that many plus one rarest words.
    """
    scope = list(scope)
    x, y = distinct_values(left, a, scope, "v").withColumn("side", F.lit(0)), distinct_values(right, b, scope, "v").withColumn("side", F.lit(1))
    g = x.unionByName(y).withColumn("n", F.size(words(c("v")))).select(*scope, "side", "v", "n", F.explode(words(c("v"))).alias("word"))
    often = g.groupBy(*scope, "word").agg(F.count("*").alias("often"))
    rarest = Window.partitionBy(*scope, "side", "v").orderBy("often", "word")
    g = g.join(often, [*scope, "word"]).withColumn("k", F.row_number().over(rarest)).where(c("k") <= F.floor(c("n") * (1 - least) + 1e-9) + 1)
    p = g.where("side = 0").select(*scope, "word", c("v").alias("a"), c("n").alias("na"))
    q = g.where("side = 1").select(*scope, "word", c("v").alias("b"), c("n").alias("nb"))
    met = p.join(q, [*scope, "word"]).where(F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb") - 1e-9).select(*scope, "a", "b").distinct()
    return met.where(F.size(F.array_intersect(words(c("a")), words(c("b")))) / F.greatest(F.size(words(c("a"))), F.size(words(c("b")))) >= least)
