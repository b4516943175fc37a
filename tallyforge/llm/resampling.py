"""Importance resampling towards a target distribution, by hashed n-grams.

Every feature's CRC is exact. The head-tail vocabulary spares most of the work: frequent words carry their CRC state in a broadcast
table, frequent pairs of them their joined state and bucket; longer features are joined from states (CRC is linear: the state of A+B is that of
A moved on by the length of B, XORed with that of B). Words outside the head take the direct CRC of their bytes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import LOWER, lean, mix, partitions, stored, text_chunks

#: Fixed values of the method: buckets, longest run of words, seed of the draw, its share in percent, least words of a document that may be drawn.
BUCKETS, RUN, SEED, PERCENT, LEAST_WORDS = 10_000, 3, 42, 5, 20
#: Size of the head: words (of at most HEAD_BYTES bytes) and pairs, their tables' slots, and what a task reports for each. The head steers cost, never results.
HEAD_WORDS, HEAD_PAIRS, SLOTS, REPORTED = 1 << 16, 1 << 16, 1 << 18, 1 << 14
HEAD_BYTES = 16
#: Bytes of a document that are taken at a time.
PIECE = 1 << 20
#: Longest word whose state is moved by table; features with a longer one are hashed whole.
MOVED = 64

IN_WORD = np.ones(256, bool)
IN_WORD[:0x30] = IN_WORD[0x3A:0x61] = IN_WORD[0x7B:0x80] = False
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The table of one byte, and tables that move a state on by 0 to MOVED bytes: moved[length, byte of the state, its value]."""
    step = np.array([_linear_step(i) for i in range(256)], np.uint32)
    moved = np.zeros((MOVED + 1, 4, 256), np.uint32)
    for k in range(4):
        moved[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, MOVED + 1):
        moved[n] = step[moved[n - 1] & np.uint32(255)] ^ (moved[n - 1] >> np.uint32(8))
    return step, moved


def _linear_step(i: int) -> int:
    """The state with low byte i after eight zero bits."""
    for _ in range(8):
        i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
    return i


STEP, MOVE = _crc_tables()


def spaced(crc: np.ndarray) -> np.ndarray:
    """CRC of the same bytes and a space."""
    c = crc ^ np.uint32(0xFFFFFFFF)
    return STEP[(c ^ np.uint32(32)) & np.uint32(255)] ^ (c >> np.uint32(8)) ^ np.uint32(0xFFFFFFFF)


def joined(crc: np.ndarray, length: np.ndarray, following: np.ndarray) -> np.ndarray:
    """CRC of A+B from those of A and of B, whose length is at most MOVED."""
    low = np.uint32(255)
    return MOVE[length, 0, crc & low] ^ MOVE[length, 1, (crc >> np.uint32(8)) & low] ^ MOVE[length, 2, (crc >> np.uint32(16)) & low] ^ MOVE[length, 3, crc >> np.uint32(24)] ^ following


@dataclass
class Words:
    """The words of a block of text: places, number of document, and first 16 bytes as two numbers (exact up to that length, as no word holds a zero byte)."""

    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    doc: np.ndarray
    low: np.ndarray
    high: np.ndarray
    carried: int = 0  # so many words at the start belong to the piece before

    def bytes(self, i: int) -> bytes:
        s = self.start[i]
        return self.text[s : s + self.length[i]].tobytes()

    @property
    def key(self) -> np.ndarray:
        return mix(self.low ^ mix(self.high ^ self.length.astype(np.uint64)))


def words_of(text: np.ndarray, bounds: np.ndarray, carried: int = 0) -> Words:
    """Words of lower-cased bytes; none crosses the bounds of a document."""
    n = len(text)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = text
    inside = np.zeros(n + 2, bool)
    inside[1 : n + 1] = IN_WORD[text]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    start = np.flatnonzero(inside[1 : n + 1] & (~inside[:n] | edge[:n]))
    end = np.flatnonzero(inside[1 : n + 1] & (~inside[2:] | edge[1:])) + 1
    length = end - start
    eight = np.ndarray(n + 9, "<u8", padded, 0, (1,))
    low = eight[start] & _MASK[np.minimum(length, 8)]
    high = eight[start + 8] & _MASK[np.clip(length - 8, 0, 8)]
    return Words(text, start, length, np.searchsorted(bounds, start, "right") - 1, low, high, carried)


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Words]]:
    """(first row, rows, words) over a batch. A long document comes in pieces, each with the last two words of the piece before."""
    for i, j, text, bounds in text_chunks(batch, limit=PIECE):
        text = LOWER[text]
        if len(text) <= 2 * PIECE:
            yield i, j - i, words_of(text, bounds)
            continue
        before, at = np.zeros(0, np.uint8), 0
        while at < len(text):
            end = min(len(text), at + PIECE)
            while end < len(text):  # a cut lies at a separator
                gap = np.flatnonzero(~IN_WORD[text[end : end + PIECE]])
                if len(gap):
                    end += int(gap[0])
                    break
                end = min(len(text), end + PIECE)
            piece = np.concatenate((before, text[at:end]))
            w = words_of(piece, np.array([0, len(piece)]), int(len(before) > 0) and len(words_of(before, np.array([0, len(before)])).start))
            yield i, 1, w
            tail = [np.append(piece[s : s + n], np.uint8(32)) for s, n in zip(w.start[-2:], w.length[-2:], strict=True)]
            before, at = np.concatenate(tail) if tail else before[:0], end


class Head:
    """Frequent words with their CRC states, and frequent pairs of them with their joined states; both tables hold one entry a slot, the more frequent first."""

    def __init__(self, words: list[bytes], pairs: list[tuple[int, int]]):
        self.words = words
        w = words_of(np.frombuffer(b" ".join(words), np.uint8), np.array([0, sum(map(len, words)) + max(0, len(words) - 1)]))
        self.key = w.key
        self.low, self.high = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.state, self.id = np.zeros(SLOTS, np.uint32), np.full(SLOTS, -1, np.int64)
        slot = (w.key[::-1] & np.uint64(SLOTS - 1)).astype(np.int64)  # the last that is written stays
        self.low[slot], self.high[slot] = w.low[::-1], w.high[::-1]
        crc = np.array([zlib.crc32(x) for x in words], np.uint32)
        self.state[slot], self.id[slot] = crc[::-1], np.arange(len(words))[::-1]
        self.pair, self.pair_state, self.pair_bucket = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.uint32), np.zeros(SLOTS, np.int64)
        if pairs:
            a, b = np.array(pairs, np.int64)[::-1].T
            state = joined(spaced(crc[a]), w.length[b], crc[b])
            slot = self.pair_slot(a, b)
            self.pair[slot], self.pair_state[slot], self.pair_bucket[slot] = a << 32 | b, state, state % np.uint32(BUCKETS)

    @staticmethod
    def pair_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (mix((a << 32 | b).astype(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)

    def states(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """CRC and number in the head (-1: tail) of every word."""
        slot = (w.key & np.uint64(SLOTS - 1)).astype(np.int64)
        known = (self.low[slot] == w.low) & (self.high[slot] == w.high) & (w.length <= HEAD_BYTES) & (self.id[slot] >= 0)
        crc = self.state[slot]
        tail = np.flatnonzero(~known)
        crc[tail] = direct(w, tail)
        return crc, np.where(known, self.id[slot], -1)


def direct(w: Words, which: np.ndarray) -> np.ndarray:
    """CRC of the bytes of these words, one place of all of them at a time; long ones one by one."""
    start, length = w.start[which], w.length[which]
    out = np.zeros(len(which), np.uint32)
    for i in np.flatnonzero(length > MOVED):
        out[i] = zlib.crc32(w.bytes(which[i]))
    order = np.argsort(-np.where(length > MOVED, 0, length), kind="stable")
    start, length = start[order], np.where(length > MOVED, 0, length)[order]
    c = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for at in range(int(length.max(initial=0))):
        n = int(np.searchsorted(-length, -at, "left"))  # words longer than ``at``
        b = w.text[start[:n] + at]
        c[:n] = STEP[(c[:n] ^ b) & np.uint32(255)] ^ (c[:n] >> np.uint32(8))
    short = length > 0
    out[order[short]] = c[short] ^ np.uint32(0xFFFFFFFF)
    return out


def features(w: Words, head: Head) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of all features: single words, pairs, runs of three; a feature belongs to the piece of its last word."""
    crc, number = head.states(w)
    n, c = len(crc), w.carried
    yield w.doc[c:], (crc[c:] % np.uint32(BUCKETS)).astype(np.int64)
    if n < 2:
        return
    long = w.length > MOVED
    length = np.minimum(w.length, MOVED)
    first, second = number[:-1], number[1:]
    slot = Head.pair_slot(first, second)
    known = (head.pair[slot] == (first << 32 | second)) & (first >= 0) & (second >= 0)
    state, bucket = head.pair_state[slot], head.pair_bucket[slot]
    rest = np.flatnonzero(~known)
    state[rest] = joined(spaced(crc[rest]), length[rest + 1], crc[rest + 1])
    for i in np.flatnonzero(long[1:]):  # a state can't be moved so far
        state[i] = zlib.crc32(w.bytes(i + 1), zlib.crc32(b" ", int(crc[i])))
    bucket[rest] = state[rest] % np.uint32(BUCKETS)
    same = w.doc[:-1] == w.doc[1:]
    same[: max(0, c - 1)] = False
    yield w.doc[1:][same], bucket[same]
    if n < 3:
        return
    three = joined(spaced(state[:-1]), length[2:], crc[2:])
    for i in np.flatnonzero(long[2:]):
        three[i] = zlib.crc32(w.bytes(i + 2), zlib.crc32(b" ", int(state[i])))
    same = w.doc[:-2] == w.doc[2:]
    same[: max(0, c - 2)] = False
    yield w.doc[2:][same], (three[same] % np.uint32(BUCKETS)).astype(np.int64)


class Frequent:
    """The most frequent keys of a stream, with counts and two numbers each, in bounded memory."""

    def __init__(self, most: int):
        self.most = most
        self.key, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.a, self.b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def add(self, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        k, first, n = np.unique(key, return_index=True, return_counts=True)
        self._merge(k, n, a[first], b[first])

    def _merge(self, key, n, a, b) -> None:
        key, a, b, n = np.concatenate((self.key, key)), np.concatenate((self.a, a)), np.concatenate((self.b, b)), np.concatenate((self.n, n))
        self.key, first, where = np.unique(key, return_index=True, return_inverse=True)
        self.n = np.bincount(where, n, len(self.key)).astype(np.int64)
        self.a, self.b = a[first], b[first]
        if len(self.key) > 16 * self.most:
            self._keep(8 * self.most)

    def _keep(self, most: int) -> None:
        if len(self.key) > most:
            on = np.sort(np.argpartition(-self.n, most)[:most])
            self.key, self.n, self.a, self.b = self.key[on], self.n[on], self.a[on], self.b[on]

    def rows(self):
        self._keep(self.most)
        return self.a.view(np.int64), self.b.view(np.int64), self.n


def fit_head(documents: DataFrame) -> Head:
    """The head of the corpus: every document is read once; a task reports its most frequent words and pairs, Spark adds these up."""
    kinds = "kind int, a long, b long, n long"

    def count(batches):
        words, pairs = Frequent(REPORTED), Frequent(REPORTED)
        for batch in batches:
            for _, _, w in blocks(batch):
                key, c = w.key, w.carried
                short = w.length <= HEAD_BYTES
                ok = short.copy()
                ok[:c] = False
                words.add(key[ok], w.low[ok], w.high[ok])
                ok = short[1:] & short[:-1] & (w.doc[1:] == w.doc[:-1])
                ok[: max(0, c - 1)] = False
                pairs.add(mix(key[:-1][ok] + np.uint64(3) * key[1:][ok]), key[:-1][ok], key[1:][ok])
        for kind, found in ((0, words), (1, pairs)):
            a, b, n = found.rows()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(n)], names=["kind", "a", "b", "n"])

    counts = stored(documents.select("text").where("text is not null").mapInArrow(lean(count), kinds).groupBy("kind", "a", "b").agg(F.sum("n").alias("n")), "head")

    def top(kind: int, most: int):
        return counts.where(F.col("kind") == kind).orderBy(F.desc("n"), "a", "b").limit(most).select("a", "b").collect()

    signed = lambda v: int(v) & (1 << 64) - 1
    words = [(signed(r.a).to_bytes(8, "little") + signed(r.b).to_bytes(8, "little")).rstrip(b"\0") for r in top(0, HEAD_WORDS)]
    ids = {int(k): i for i, k in enumerate(Head(words, []).key)} if words else {}
    pairs = [(ids.get(signed(r.a)), ids.get(signed(r.b))) for r in top(1, HEAD_PAIRS)]
    return Head(words, [p for p in pairs if None not in p])


def bucket_totals(texts: DataFrame, head: Head) -> np.ndarray:
    """Features in each bucket over all texts, exact: one sum of buckets a task, added up by Spark."""
    shared = texts.sparkSession.sparkContext.broadcast((head.words, _pairs(head)))

    def count(batches):
        own, total = Head(*shared.value), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, w in blocks(batch):
                for _, bucket in features(w, own):
                    total += np.bincount(bucket, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select("text").where("text is not null").mapInArrow(lean(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def _pairs(head: Head) -> list[tuple[int, int]]:
    p = head.pair[head.pair >= 0]
    return list(zip((p >> 32).tolist(), (p & 0xFFFFFFFF).tolist(), strict=True))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t+1)(S+B) / ((s+1)(T+B)))) of each bucket, in doubles."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(t + 1) * s_all) / (float(s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(documents: DataFrame, head: Head, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document."""
    shared = documents.sparkSession.sparkContext.broadcast((head.words, _pairs(head), gain))

    def weigh(batches):
        words, pairs, gain = shared.value
        own = Head(words, pairs)
        for batch in batches:
            n = batch.num_rows
            count, found, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i, rows, w in blocks(batch):
                count[i : i + rows] += np.bincount(w.doc[w.carried :], minlength=rows)
                for doc, bucket in features(w, own):
                    found[i : i + rows] += np.bincount(doc, minlength=rows)
                    weight[i : i + rows] += np.bincount(doc, gain[bucket], minlength=rows).astype(np.int64)  # whole numbers, exact in doubles
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index("doc_id")).cast(pa.int64()), pa.array(count), pa.array(found), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return documents.select("doc_id", "text").mapInArrow(lean(weigh), "doc_id long, n_words long, n_features long, weight long")


def drawn(weights: DataFrame, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank: a Gumbel draw without replacement of ``percent`` of the documents with enough words.

    Rows alike in all that is returned are counted first and come back at the end, so a doc_id that many rows share is one row in the
    sort. Ranges of falling scores are sorted each for itself; the sums of the ranges give each its first rank, and only ranges within the draw are ranked.
    """
    spark = weights.sparkSession
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = weights.withColumn("score", F.col("weight") + gumbel).withColumn("may", F.col("n_words") >= least_words)
    alike = rows.groupBy("may", "doc_id", "n_features", "weight", "score").agg(F.count("*").alias("m"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")]
    ranged = stored(alike.repartitionByRange(max(1, partitions(spark)), F.col("may").desc(), *order).withColumn("part", F.spark_partition_id()), "scores")
    eligible = ranged.where("may")
    k = (eligible.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n")).first().n * percent) // 100
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = eligible.groupBy("part").agg(F.sum("m").alias("m")).select(F.col("part").alias("p"), F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("before"))
    within = parts.where(F.col("before") < k)  # one row a partition
    top = eligible.join(F.broadcast(within), F.col("part") == F.col("p"))
    inner = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    top = top.withColumn("first", F.col("before") + F.coalesce(F.sum("m").over(inner), F.lit(0)))
    rest = ranged.join(F.broadcast(within.select("p", F.lit(True).alias("may_too"))), (F.col("part") == F.col("p")) & (F.col("may") == F.col("may_too")), "left_anti")
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = top.withColumn("rank", F.explode(F.sequence(F.col("first") + 1, F.col("first") + F.col("m")))).select(*columns, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    others = rest.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(others)


def resampled(documents: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document, drawn towards the texts of ``target``.

    A null or empty text has no features and weight 0. A null doc_id is hashed as an empty one and ranks after others of its score; equal
    scores go by doc_id; repeated rows each have their own rank. Long texts are taken in pieces that lose no feature. Empty documents give an empty
    result, an empty target leaves the weights to the documents alone. Other columns are ignored.
    """
    head = fit_head(documents)
    source, wanted = bucket_totals(documents, head), bucket_totals(target, head)
    return drawn(stored(weighed(documents, head, gains(source, wanted)), "weights"))
