"""Fuzzy line dedup by MinHash, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import cut, near_rows, stored
from tallyforge.llm.graph import components, shortened

#: A shingle is so many characters of a line, from each of its characters on; a shorter line is one shingle.
SHINGLE = 5
#: Bands and hashes of a band. At similarity 0.8 a pair of lines shares a band with probability 0.999.
BANDS, ROWS = 20, 6
#: Lines of a block of a bucket.
BLOCK = 1024
#: Words of 64 bits in a line's bitmap.
WORDS = 32
#: Rounds that join the lines of the first links. Where more were needed, some lines are compared that are joined already.
SHORTENED = 3
#: Lines link from this similarity on.
SIMILARITY = 0.8

#: Points at even distances on the circle of 64-bit hashes. A band is the hashes that follow its point.
_POINTS = [(k * (1 << 64) // BANDS) - (1 << 63) + 1 for k in range(BANDS)]


def _lines(rows: DataFrame) -> DataFrame:
    """key, doc_id, pos and line: every line that isn't blank, trimmed, of rows (key, doc_id, text)."""
    out = rows.where("text is not null").select("doc_id", "key", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return out.withColumn("line", F.btrim("line", F.lit(" \t\r"))).where("line <> ''")


def _keyed(documents: DataFrame) -> DataFrame:
    """key, doc_id and text; equal rows have one key."""
    return documents.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


def _shingles(line: Column) -> Column:
    """The distinct shingles of a line, as hashes.

    The line is coded in four bytes a character, so that a shingle is found without walking through the line; the array of one element
    gives the coded line a name, or it would be coded again for each shingle.
    """

    def hashes(coded: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(coded) - 4 * SHINGLE + 1, F.lit(1)), F.lit(4))
        return F.transform(starts, lambda k: F.xxhash64(F.substring(coded, k, F.lit(4 * SHINGLE))))

    return F.array_distinct(F.flatten(F.transform(F.array(F.encode(line, "UTF-32")), hashes)))


def _bands(lines: DataFrame) -> DataFrame:
    """(band, id, n) of lines (id, line): the key of each band of each line, and its number of shingles.

    The hashes of a line and the points lie on one circle. A band's key is the next ROWS places from its point on: the least hashes in the order that
    begins there, which two lines share if the least of all their shingles are common ones. Where a line has few shingles, other points are among the
    places, so a band of a short line has fewer hashes.
    """
    points = F.array(*[F.lit(p) for p in _POINTS])
    s = lines.select("id", _shingles(F.col("line")).alias("a"))
    s = s.select("id", F.size("a").alias("n"), F.sort_array(F.concat("a", points)).alias("a"))
    s = s.select("id", "n", F.concat("a", F.slice("a", 1, ROWS)).alias("a"), F.explode(points).alias("point"))
    places = F.slice("a", F.array_position("a", F.col("point")).cast("int") + 1, F.lit(ROWS))
    return s.select(F.xxhash64("point", places).alias("band"), "id", "n")


def _alike_in_size(n: Column, m: Column) -> Column:
    """Only sets with such sizes can reach the similarity."""
    return F.least(n, m) >= SIMILARITY * F.greatest(n, m)


def _members(lines: DataFrame) -> DataFrame:
    """(band, id, n) of the lines that share a bucket with others."""
    w = Window.partitionBy("band").orderBy("id")
    b = _bands(lines).select("band", "id", "n", F.lag("id").over(w).alias("back"), F.lead("id").over(w).alias("ahead"))
    return stored(b.where("back is not null or ahead is not null").select("band", "id", "n"), "line-members")


def _candidates(members: DataFrame, weights: DataFrame) -> DataFrame:
    """Pairs (a, b) of lines of one bucket: each line with the bucket's first, so a bucket of n lines gives fewer than n pairs.

    First is the line that stands most often in the texts (weights: id, copies; 1 where it isn't named), as edited copies of a line
    are near it and not always near each other.
    """
    w = Window.partitionBy("band").orderBy(F.coalesce("copies", F.lit(1)).desc(), "id").rowsBetween(Window.unboundedPreceding, 0)
    e = members.join(weights, "id", "left").select("id", "n", F.first("id").over(w).alias("head"), F.first("n").over(w).alias("m"))
    e = e.where((F.col("id") != F.col("head")) & _alike_in_size(F.col("n"), F.col("m")))
    return e.select(F.greatest("id", "head").alias("a"), F.least("id", "head").alias("b")).distinct()


def _sketches(texts: DataFrame) -> DataFrame:
    """(id, ones, s0, s1, ...): a bitmap of 64 * WORDS bits for each line, in which each shingle sets one, and its number of ones."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("coded") - 4 * SHINGLE + 1, F.lit(1)), F.lit(4))
    h = texts.select("id", F.encode("line", "UTF-32").alias("coded")).select("id", "coded", F.explode(starts).alias("k"))
    h = h.select("id", F.xxhash64(F.substring("coded", F.col("k"), F.lit(4 * SHINGLE))).alias("h"))
    h = h.select("id", F.pmod(F.shiftright("h", 6), F.lit(WORDS)).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    h = h.groupBy("id", "word").agg(F.bit_or("bit").alias("bits"))
    words = [F.coalesce(F.max(F.when(F.col("word") == k, F.col("bits"))), F.lit(0).cast("long")).alias(f"s{k}") for k in range(WORDS)]
    return h.groupBy("id").agg(F.sum(F.bit_count("bits")).cast("int").alias("ones"), *words)


def _may_reach() -> Column:
    """Whether the sets of x and y, by their bitmaps, may reach the similarity: a bit of one that the other lacks stands for a shingle it lacks.

    The common bits are counted once for both; twice as long an expression isn't compiled any more.
    """
    common = F.lit(0)
    for k in range(WORDS):
        common = common + F.bit_count(F.col(f"x.s{k}").bitwiseAND(F.col(f"y.s{k}")))
    # so many shingles in common at most, against what the similarity asks for
    most = common + F.least(F.col("x.n") - F.col("x.ones"), F.col("y.n") - F.col("y.ones"))
    return most * (1 + SIMILARITY) >= SIMILARITY * (F.col("x.n") + F.col("y.n")) - 1e-6


def _apart(members: DataFrame, joined: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b): all lines of one bucket that aren't in one component yet and may be near.

    Most buckets are one component by now. In one that isn't, the lines outside its largest component meet all its lines, which are dealt
    into blocks, so that a large bucket doesn't meet in one task and lines of one component aren't paired. A pair whose bitmaps rule it out
    ends there.
    """
    m = members.join(joined, "id", "left").select("band", "id", "n", F.coalesce("component", "id").alias("c"))
    m = stored(m, "line-component-members")
    parts = m.groupBy("band", "c").agg(F.count("*").alias("k"))
    mixed = parts.groupBy("band").agg(F.max(F.struct("k", "c")).alias("most"), F.sum("k").alias("all"), F.count("*").alias("parts"))
    mixed = mixed.where("parts > 1").select("band", F.col("most.c").alias("largest"), F.ceil(F.col("all") / BLOCK).alias("blocks"))
    m = m.join(mixed, "band")
    sketches = stored(_sketches(texts.join(m.select("id").distinct(), "id", "left_semi")), "line-sketches")
    m = m.join(sketches, "id")
    marks = ["ones", *[f"s{k}" for k in range(WORDS)]]
    few = m.where("c <> largest").withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    every = m.withColumn("p", F.pmod(F.xxhash64("id"), F.col("blocks")))
    x, y = few.select("band", "p", "id", "c", "n", *marks).alias("x"), every.select("band", "p", "id", "c", "n", *marks).alias("y")
    same = (F.col("x.band") == F.col("y.band")) & (F.col("x.p") == F.col("y.p")) & (F.col("x.c") != F.col("y.c"))
    both = x.join(y, same & _alike_in_size(F.col("x.n"), F.col("y.n")) & _may_reach())
    return both.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose sets of shingles reach the similarity. Both sides read the same columns, so that the lines are dealt out once."""
    a = texts.select(F.col("id").alias("a"), F.col("line").alias("x"))
    b = texts.select(F.col("id").alias("b"), F.col("line").alias("y"))
    met = pairs.join(a, "a").join(b, "b").select("a", "b", _shingles(F.col("x")).alias("x"), _shingles(F.col("y")).alias("y"))
    met = met.select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("common"))
    return met.where(F.col("common") >= SIMILARITY * (F.col("n") + F.col("m") - F.col("common"))).select("a", "b")


def line_components(lines: DataFrame, weights: DataFrame | None = None, again: DataFrame | None = None) -> DataFrame:
    """(id, component) of the lines that have a near copy, of distinct lines (id, line); for weights see :func:`_candidates`.

    again: the same lines, but possibly several times each, where they are cheaper to read like that.
    """
    members = _members(lines)
    if weights is None:
        weights = members.limit(0).select("id", F.lit(1).alias("copies"))
    pairs = stored(_candidates(members, weights), "line-candidates")
    ids = stored(members.select("id").distinct(), "line-member-ids")
    maybe, _ = near_rows(lines if again is None else again, F.col("id"), ids)
    # the lines that share a bucket
    texts = stored(maybe.join(ids, "id", "left_semi").select("id", "line").dropDuplicates(["id"]), "line-texts")
    links, _ = shortened(_verified(pairs, texts), SHORTENED)
    joined = links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    rest = stored(_apart(members, joined, texts).join(pairs, ["a", "b"], "left_anti"), "line-rest")
    return components(links.union(_verified(rest, texts)))


def _struck(lost: DataFrame) -> DataFrame:
    """(id, drop) of rows (key, pos): the positions that a row loses; id is its key."""
    return lost.groupBy(F.col("key").alias("id")).agg(F.collect_list("pos").alias("drop"))


def _without(text: Column, drop: Column) -> Column:
    """The lines of a text but for those at the positions ``drop`` (null: none)."""
    rest = lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), drop), lambda i: F.get(ls, i))
    return F.when(drop.isNull(), F.split(text, "\n")).otherwise(F.flatten(F.transform(F.array(F.split(text, "\n")), rest)))


def dropped_lines(documents: DataFrame) -> DataFrame:
    """(id, drop): for each key of ``documents`` that loses lines, their positions.

    Equal lines are collapsed by their hash first, so that each distinct line has one signature.
    """
    rows = _keyed(documents)
    lines = stored(_lines(rows).select("doc_id", "key", "pos", F.xxhash64("line").alias("id")), "line-ids")
    place = F.struct("doc_id", "key", "pos")
    facts = stored(lines.groupBy("id").agg(F.min(place).alias("first"), F.count("*").alias("n")), "line-facts")
    # a line that stands once is read where it stands; only the others are collapsed
    every = _lines(rows).select(F.xxhash64("line").alias("id"), "line")
    repeated = facts.where("n > 1").select("id", F.col("n").alias("copies"), "first")
    maybe, single = near_rows(every, F.col("id"), repeated)
    distinct = single.union(maybe.dropDuplicates(["id"]))

    groups = cut(line_components(distinct, repeated.select("id", "copies"), every))
    placed = facts.join(groups, "id").select("id", "first", "component")
    low = placed.groupBy("component").agg(F.min("first").alias("least"))
    fuzzy = placed.join(low, "component").select("id", F.col("least").alias("first"))
    keep = stored(repeated.join(groups, "id", "left_anti").select("id", "first").union(fuzzy), "line-groups")
    maybe, _ = near_rows(lines, F.col("id"), keep)
    return _struck(maybe.join(keep, "id").where(~place.eqNullSafe(F.col("first"))).select("key", "pos").distinct())


def _marked(rows: DataFrame) -> DataFrame:
    """rows (key, text, and others) with a column drop, null where no line goes."""
    drops = stored(dropped_lines(rows), "line-drops")
    maybe, sure = near_rows(rows, F.col("key"), drops)
    hit = maybe.join(drops.withColumnRenamed("id", "key"), "key", "left").select(*rows.columns, "drop")
    return hit.union(sure.withColumn("drop", F.lit(None).cast("array<int>")))


def deduped(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept and kept_sha256 (of the kept lines joined by line feeds, in UTF-8) of every row.

    Lines end at line feeds and are compared without white space at their ends. Two lines link when they are equal, or when
    banding finds them and their sets of 5-character shingles, one from each character on, have a Jaccard similarity of 0.8 or
    more. Of each component of linked lines the one with the smallest (doc_id, key, position) stays, and all other lines go.
    Blank lines always stay. All lines of a bucket are compared that other links haven't joined, so banding is the only step
    that may miss a pair.

    A null text has no lines and gives the digest of an empty text; very long lines and texts are taken whole; rows
    equal in doc_id and text count as one and keep the same lines; a null doc_id comes before all others. Other
    columns don't matter; an empty table gives an empty result.
    """
    rows = _marked(_keyed(documents))
    none, zero = F.col("text").isNull(), F.lit(0).cast("long")
    all_ = F.size(F.split("text", "\n")).cast("long")
    gone = F.coalesce(F.size("drop"), F.lit(0))
    kept = F.when(F.col("drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(_without(F.col("text"), F.col("drop")), "\n"))
    return rows.select(
        "doc_id",
        F.when(none, zero).otherwise(all_).alias("n_lines"),
        F.when(none, zero).otherwise(all_ - gone).alias("n_kept"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


def kept_documents(documents: DataFrame) -> DataFrame:
    """``documents`` with only the kept lines in ``text``; rows that lose all they had go.

    Where ``n_chars`` is a column it follows the text. Rows with a null or blank text stay as they are; columns of any name
    are passed on. For ties, repeated rows and null ids see :func:`deduped`.
    """
    columns = documents.columns
    rows = documents.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    rows = _marked(rows)
    kept = F.array_join(_without(F.col("text"), F.col("drop")), "\n")
    rows = rows.select("row", "drop", F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept).alias("kept"))
    rows = rows.where(F.col("drop").isNull() | (F.btrim("kept", F.lit(" \t\r\n")) != ""))
    new = {"text": F.col("kept")}
    if "n_chars" in columns:
        new["n_chars"] = F.when(F.col("drop").isNull(), F.col("row.n_chars")).otherwise(F.length("kept")).cast(documents.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])
