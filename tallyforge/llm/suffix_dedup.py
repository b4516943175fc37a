"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere go."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import lean, mix, near_rows, partitions, powers, prefix_hash, ship, span_hash, stored, word_hashes

#: Bytes of a repeated string.
LENGTH = 400
#: Bytes of an anchor. Every string of LENGTH bytes has one: the anchor in it with the least hash, the leftmost of equals.
ANCHOR = 200
#: Words of a passage, and of its anchor.
PASSAGE, PASSAGE_ANCHOR = 50, 10
#: Bytes of a text that can hold a passage.
LEAST = min(LENGTH, 2 * PASSAGE - 1)
WORD = r"[^\x20\x09-\x0D]+"
#: Spans that meet in one group of the comparison, on average.
TOGETHER = 4096


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of integers of 0 or more, in linear grouping construction.

    First phase: suffixes stand in ordered groups, at first by their first symbol. The groups are taken in descending
    order. For each suffix of the group, the previous suffix of a smaller group is found along pointers; it begins with its
    own group's context followed by one or more contexts of the group taken, so it moves to a new group right above
    its own, by the number of repetitions. In the end a group holds the suffixes of one Lyndon prefix.
    Second phase: suffixes are emitted in ascending order. When one is emitted, the suffixes that continue with it (the one
    before it and then along the pointers) take the next places of their groups. Nothing is renamed or sorted again.
    """
    n = len(text)
    first: dict[int, list[int]] = defaultdict(list)
    for i, c in enumerate(text):
        first[c].append(i)
    members: list[list[int]] = [[n]]
    above = [-1]  # linked list of groups in ascending order
    below = [-1]
    group = [0] * (n + 1)
    for c in sorted(first):
        g = len(members)
        members.append(first[c])
        below.append(g - 1)
        above[g - 1] = g
        above.append(-1)
        for i in first[c]:
            group[i] = g
    done = bytearray(n + 1)
    previous = [-1] * (n + 1)
    count = [0] * (n + 1)
    g = len(members) - 1
    while g > 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        if own:
            own.sort()
            for i in own:
                done[i] = 1
            met = []
            for i in own:
                j = i - 1
                while j >= 0 and done[j]:
                    j = previous[j]
                previous[i] = j
                if j >= 0:
                    if not count[j]:
                        met.append(j)
                    count[j] += 1
            moved: dict[tuple[int, int], list[int]] = {}
            for j in met:
                key = (group[j], count[j])
                if key in moved:
                    moved[key].append(j)
                else:
                    moved[key] = [j]
                count[j] = 0
            # the most repetitions are the largest, so smaller counts are put in later and closer to the old group
            for (h, _), some in sorted(moved.items(), key=lambda x: (x[0][0], -x[0][1])):
                new = len(members)
                members.append(some)
                up = above[h]
                above.append(up)
                below.append(h)
                above[h] = new
                if up >= 0:
                    below[up] = new
                for j in some:
                    group[j] = new
        g = below[g]
    place = [0] * len(members)
    at, g = 1, above[0]
    while g >= 0:
        place[g] = at
        at += len(members[g])
        g = above[g]
    out = [0] * (n + 1)
    out[0] = n
    emitted = bytearray(n + 1)
    for k in range(n + 1):
        j = out[k] - 1
        while j >= 0 and not emitted[j]:
            g = group[j]
            out[place[g]] = j
            place[g] += 1
            emitted[j] = 1
            j = previous[j]
    return out[1:]


def anchor_runs(p: np.ndarray, bounds: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of each run of windows of ``length`` symbols with one anchor: document, anchor hash, first and last window, and hash of all its symbols.

    ``p`` is the prefix hash of all symbols, ``bounds`` the offsets of the documents. Positions count from the beginning of the document.
    """
    none = np.zeros(0, np.int64)
    total = len(p) - 1
    if total < length:
        return none, none.astype(np.uint64), none, none, none.astype(np.uint64)
    m = total - anchor + 1
    h = span_hash(p, np.arange(m), np.arange(anchor, anchor + m))
    bits = np.uint64(int(m).bit_length())
    v = (h >> bits << bits) | np.arange(m, dtype=np.uint64)
    # the least of each window of w values, from running minima of blocks to either side
    w = length - anchor + 1
    size = -(-m // w) * w
    pad = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    pad[:m] = v
    blocks = pad.reshape(-1, w)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    windows = total - length + 1
    least = np.minimum(right[:windows], left[w - 1 : w - 1 + windows])
    pos = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    doc = np.searchsorted(bounds, np.arange(windows), "right") - 1
    ok = np.arange(windows) + length <= bounds[doc + 1]
    s = np.flatnonzero(ok)
    if not len(s):
        return none, none.astype(np.uint64), none, none, none.astype(np.uint64)
    new = np.ones(len(s), bool)
    new[1:] = (pos[s[1:]] != pos[s[:-1]]) | (doc[s[1:]] != doc[s[:-1]])
    first = np.flatnonzero(new)
    lo, hi = s[first], s[np.concatenate((first[1:], [len(s)])) - 1]
    at = pos[lo]
    whole = span_hash(p, lo, hi + length) + (at - lo).astype(np.uint64)
    d = doc[lo]
    return d, h[at], lo - bounds[d], hi - bounds[d], whole


def anchors(b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """The runs of windows of LENGTH bytes."""
    return anchor_runs(prefix_hash(b), bounds, LENGTH, ANCHOR)


def words_of(b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prefix hash of the words of all documents, and the offsets of the documents in words."""
    h, doc = word_hashes(b, bounds)
    pw, _ = powers(len(h) + 1)
    p = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h) * pw[: len(h)], out=p[1:])
    return p, np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(bounds) - 1))))


def shared_windows(spans: list[bytes], counts: list[int]) -> list[list[tuple[int, int]]]:
    """For each of the distinct spans of one anchor: its runs (first, last) of windows that also start elsewhere.

    A hash of each window picks what may be shared; a suffix array of the strings picked, each once, decides by their bytes.
    """
    size = np.array([len(x) for x in spans], np.int64)
    b = np.frombuffer(b"".join(spans), np.uint8)
    bounds = np.concatenate(([0], np.cumsum(size)))
    p = prefix_hash(b)
    s = np.concatenate([np.arange(x, y - LENGTH + 1) for x, y in zip(bounds[:-1], bounds[1:], strict=True)])
    owner = np.repeat(np.arange(len(spans)), size - LENGTH + 1)
    _, at, times = np.unique(span_hash(p, s, s + LENGTH), return_inverse=True, return_counts=True)
    maybe = times[at] > 1
    out: list[list[tuple[int, int]]] = [[] for _ in spans]
    k = np.flatnonzero(maybe)
    if not len(k):
        return out
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1] + 1) | (owner[k[1:]] != owner[k[:-1]])
    first = np.flatnonzero(new)
    strings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    for x, y in zip(k[first], k[np.concatenate((first[1:], [len(k)])) - 1], strict=True):
        strings[b[s[x] : s[y] + LENGTH].tobytes()].append((int(owner[x]), int(s[x] - bounds[owner[x]])))
    symbols: list[int] = []
    base: list[int] = []
    for text in strings:
        base.append(len(symbols))
        symbols += [c + 1 for c in text] + [0]
    raw = b"\0".join(strings) + b"\0"
    valid = bytearray(len(symbols))
    for start, text in zip(base, strings, strict=True):
        valid[start : start + len(text) - LENGTH + 1] = b"\1" * (len(text) - LENGTH + 1)
    order = [i for i in suffix_array(symbols) if valid[i]]
    again = bytearray(len(symbols))
    for i, j in zip(order, order[1:], strict=False):
        if raw[i : i + LENGTH] == raw[j : j + LENGTH]:
            again[i] = again[j] = 1
    for start, (text, places) in zip(base, strings.items(), strict=True):
        many = len(places) > 1 or counts[places[0][0]] > 1
        flags = b"\1" * (len(text) - LENGTH + 1) if many else bytes(again[start : start + len(text) - LENGTH + 1])
        runs, i = [], flags.find(1)
        while i >= 0:
            j = flags.find(0, i)
            j = len(flags) if j < 0 else j
            runs.append((i, j - 1))
            i = flags.find(1, j)
        for who, off in places:
            out[who] += [(off + x, off + y) for x, y in runs]
    return out


def anchored(texts: DataFrame) -> DataFrame:
    """(words, h, whole, th, lo, hi, all): the runs of windows of distinct texts (th, text), of bytes and of words, whose anchor has more than one."""
    ship(texts.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallyforge.llm.common import text_chunks
        from tallyforge.llm.suffix_dedup import PASSAGE, PASSAGE_ANCHOR, anchor_runs, anchors, words_of

        for b in batches:
            th = b.column("th").to_numpy()
            for i, _, data, bounds in text_chunks(b):
                for words, (d, h, lo, hi, whole) in enumerate((anchors(data, bounds), anchor_runs(*words_of(data, bounds), PASSAGE, PASSAGE_ANCHOR))):
                    cols = [pa.array(np.full(len(d), words, bool)), pa.array(h.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(th[i + d]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, ["words", "h", "whole", "th", "lo", "hi"])

    found = stored(texts.mapInArrow(lean(find), "words boolean, h bigint, whole bigint, th bigint, lo int, hi int"), "anchors")
    many = stored(found.groupBy("h").agg(F.count("*").alias("all")).where("all > 1"), "anchors-again")
    maybe, _ = near_rows(found, F.col("h"), many.select(F.col("h").alias("id")))
    return stored(maybe.join(many, "h"), "runs")


def shared_passages(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(th, n): words of each distinct text that lie in a passage which another text has too.

    Runs that are equal as a whole are shared; of other runs with a shared anchor, each window is compared by its hash.
    """
    runs = found.where("words").select("h", "whole", "th", "lo", "hi")
    both = runs.groupBy("h", "whole").agg(F.min("th").alias("t1"), F.max("th").alias("t2"))
    wide = both.groupBy("h").agg(F.min("t1").alias("low"), F.max("t2").alias("high"), F.count("*").alias("kinds")).where("low <> high").select("h", "kinds")
    known = both.join(wide, "h").select("h", "whole", "t1", "kinds", (F.col("t1") != F.col("t2")).alias("equal"))
    met = stored(runs.join(known, ["h", "whole"]), "passage-runs")
    # of equal runs the one in the first text stands for all
    unlike = stored(met.where("not equal or kinds > 1 and th = t1").groupBy("th").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")), "passage-unlike")
    some, _ = near_rows(texts, F.col("th"), unlike.select(F.col("th").alias("id")))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallyforge.llm.common import span_hash, text_chunks
        from tallyforge.llm.suffix_dedup import PASSAGE, words_of

        for b in batches:
            th = b.column("th").to_numpy()
            for i, j, data, bounds in text_chunks(b):
                p, at = words_of(data, bounds)
                for k in range(i, j):
                    pos = np.unique(np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in b.column("runs")[k].as_py()]))
                    first = pos + at[k - i]
                    yield pa.RecordBatch.from_arrays([pa.array(span_hash(p, first, first + PASSAGE).view(np.int64)), pa.array(np.full(len(pos), th[k])), pa.array(pos.astype(np.int32))], ["w", "th", "lo"])

    each = stored(some.join(unlike, "th").select("th", "text", "runs").mapInArrow(lean(windows), "w bigint, th bigint, lo int"), "passage-windows")
    again = each.groupBy("w").agg(F.min("th").alias("t1"), F.max("th").alias("t2")).where("t1 <> t2").select("w")
    hit = met.where("equal").select("th", "lo", "hi").union(each.join(again, "w").select("th", "lo", F.col("lo").alias("hi")))
    spans = F.array_sort(F.collect_list(F.struct("lo", (F.col("hi") + PASSAGE).alias("end"))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, r: F.struct(F.greatest(a["end"], r["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(a["end"], r["lo"]))).alias("n"))
    return hit.groupBy("th").agg(F.aggregate(spans, start, step)["n"].alias("n"))


def repeated_windows(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(th, lo, hi): runs of windows of bytes that also start elsewhere, of distinct texts (th, text)."""
    found = found.where("not words").select("h", "whole", "th", "lo", "hi", "all")
    # equal spans are one, with a count; spans of one anchor that differ are compared by their suffixes
    spans = stored(found.groupBy("h", "whole").agg(F.count("*").alias("c"), F.max("all").alias("all"), F.min(F.struct("th", "lo", "hi")).alias("rep")), "spans")
    copies = spans.where("c > 1").select(F.col("whole").alias("id"), "h")
    maybe, _ = near_rows(found, F.col("whole"), copies)
    equal = maybe.join(copies.withColumnRenamed("id", "whole"), ["h", "whole"], "left_semi").select("th", "lo", "hi")
    unlike = spans.where("c < all").select("h", "c", "rep.th", "rep.lo", "rep.hi")
    wanted = stored(unlike.groupBy("th").agg(F.collect_list(F.struct("h", "c", "lo", "hi")).alias("spans")), "unlike-spans")
    parts = max(partitions(texts.sparkSession), 8, unlike.count() // TOGETHER)
    some, _ = near_rows(texts, F.col("th"), wanted.select(F.col("th").alias("id")))
    cut_out = some.join(wanted, "th").select("th", "text", "spans")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for th, text, spans_ in zip(b.column("th").to_pylist(), b.column("text").cast(pa.large_binary()).to_pylist(), b.column("spans").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([x["h"] % parts for x in spans_], pa.int32()),
                        "h": pa.array([x["h"] for x in spans_], pa.int64()),
                        "c": pa.array([x["c"] for x in spans_], pa.int64()),
                        "th": pa.array([th] * len(spans_), pa.int64()),
                        "lo": pa.array([x["lo"] for x in spans_], pa.int32()),
                        "raw": pa.array([text[x["lo"] : x["hi"] + LENGTH] for x in spans_], pa.binary()),
                    }
                )

    def compare(table: pa.Table) -> pa.Table:
        from tallyforge.llm.suffix_dedup import shared_windows

        table = table.sort_by("h")
        h = table.column("h").to_numpy()
        start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        th, lo, c, raw = table.column("th").to_pylist(), table.column("lo").to_pylist(), table.column("c").to_pylist(), table.column("raw").to_pylist()
        out = ([], [], [])
        for x, y in zip(start, np.concatenate((start[1:], [len(h)])), strict=True):
            if y - x < 2:
                continue
            for k, runs in enumerate(shared_windows(raw[x:y], c[x:y])):
                if c[x + k] == 1:
                    for a, b in runs:
                        out[0].append(th[x + k])
                        out[1].append(lo[x + k] + a)
                        out[2].append(lo[x + k] + b)
        return pa.Table.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], ["th", "lo", "hi"])

    rows = cut_out.mapInArrow(lean(slices), "part int, h bigint, c bigint, th bigint, lo int, raw binary")
    return equal.union(rows.groupBy("part").applyInArrow(compare, "th bigint, lo int, hi int"))


def removed(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_shared_words of every row.

    A byte goes if some LENGTH bytes that hold it also start anywhere else, in the same or another row; this is judged on
    the input. Equal texts are collapsed first: such a text of LENGTH bytes or more goes whole. Of distinct texts, each
    window of LENGTH bytes belongs to its anchor; the windows of one anchor run form a span. Equal spans are all repeated;
    spans that share an anchor but differ are compared through a suffix array. Texts, spans and windows are matched
    by 64-bit hashes before bytes are compared.

    n_shared_words counts the words (A-Z lower-cased) that lie in a passage of PASSAGE words which another row has too; such a passage
    may be shorter than LENGTH bytes, and nothing is removed for it.

    A null text counts as empty: no bytes, no spans, the digest of nothing. Texts below LENGTH bytes stay whole; very long
    ones are taken whole. Repeated rows are repeats of each other. A null doc_id is kept as it is. Other columns are
    ignored; an empty table gives an empty result.
    """
    ship(documents.sparkSession)
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    long_rows = rows.where(F.col("n_bytes") >= LEAST)
    copies = stored(long_rows.groupBy("th").agg(F.count("*").alias("m")).where("m > 1").select(F.col("th").alias("id")), "copies")
    maybe, sure = near_rows(long_rows.select("th", "text"), F.col("th"), copies)
    texts = sure.union(maybe.dropDuplicates(["th"]))
    found = anchored(texts)
    merged = repeated_windows(texts, found).groupBy("th").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    marks = merged.join(shared_passages(texts, found), "th", "full").withColumnRenamed("th", "id").join(copies, "id", "left_anti")
    marks = marks.withColumn("copied", F.lit(False))
    marks = stored(marks.unionByName(copies.withColumn("copied", F.lit(True)), allowMissingColumns=True), "marks")

    maybe, sure = near_rows(rows, F.col("th"), marks)
    empty = hashlib.sha256(b"").hexdigest()

    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallyforge.llm.suffix_dedup import struck

        for b in batches:
            got = [struck(t, r) for t, r in zip(b.column("text").cast(pa.large_binary()).to_pylist(), b.column("runs").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.string()), b.column("n")],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    zero = F.lit(0).cast("long")
    hit = maybe.join(marks.withColumnRenamed("id", "th"), "th", "left").withColumn("copied", F.coalesce("copied", F.lit(False)))
    # a text that other rows have too is shared as a whole
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    hit = hit.withColumn("n", F.when(F.col("copied"), F.when(words >= PASSAGE, words).otherwise(zero)).otherwise(F.coalesce("n", zero)))

    def plain(df: DataFrame) -> DataFrame:
        n = F.col("n") if "n" in df.columns else zero
        return df.select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), n.alias("n_shared_words"))

    whole = F.col("copied") & (F.col("n_bytes") >= LENGTH)
    gone = hit.where(whole).select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(empty).alias("kept_sha256"), F.col("n").alias("n_shared_words"))
    part = hit.where(~whole & F.col("runs").isNotNull()).select("doc_id", "n_bytes", "text", "runs", "n")
    part = part.mapInArrow(lean(strike), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_shared_words bigint")
    return plain(sure).union(plain(hit.where(~whole & F.col("runs").isNull()))).union(gone).union(part)


def struck(text: bytes, runs: list[dict]) -> tuple[int, int, str]:
    """Removed bytes, removed runs and the digest of the rest."""
    kept = hashlib.sha256()
    done = removed_ = spans = 0
    for lo, hi in sorted((r["lo"], r["hi"] + LENGTH) for r in runs):
        if lo > done or not spans:
            kept.update(text[done:lo])
            spans += 1
            removed_ += hi - lo
            done = hi
        elif hi > done:
            removed_ += hi - done
            done = hi
    kept.update(text[done:])
    return removed_, spans, kept.hexdigest()
