"""The change feed as streams: last write wins, gates, running statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.operators.state import accept, latest_per_key

c = F.col


def read_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder or over one file."""
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    # the tables are a file or a folder of files; the glob finds either from the folder above
    return reader.option("pathGlobFilter", "*.parquet").parquet(path) if not name.endswith(".parquet") else reader.parquet(f"{folder}/{name[:-8]}[.]parquet")


def run(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run to the end of what is there now, batch by batch."""
    q = stream.writeStream.outputMode(mode).foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


class VersionedTable:
    """A table that each batch writes as a new version; readers take the last complete one, after a restart too.

    A batch that is repeated reads what was there before it and writes the same again. The two last versions are kept.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self):
        """The folder's path and file system, wherever it is."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The complete versions, in order."""
        path, fs = self._folder()
        if not fs.exists(path):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        done = [n for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in done)

    def read(self, before: int | None = None, keys: DataFrame | None = None) -> DataFrame | None:
        """The whole table as of before a batch; which keys the batch has makes no difference here."""
        found = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.path}/v{found[-1]}") if found else None

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v{batch}")
        _, fs = self._folder()
        for v in self.versions()[:-2]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v}"), True)


class LayeredTable:
    """A table in layers: each batch writes only the rows it changes, and the latest layer of a key counts.

    Neighbouring layers are merged when the older is at most twice as large, so there are few of them and a row is rewritten as often as
    the logarithm of the number of batches. Only layers older than the batch are merged, so a batch that is repeated finds what
    it found before; merged layers go one batch later, when no reader needs them.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path, key

    def _folder(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _complete(self) -> list[tuple[int, int]]:
        path, fs = self._folder()
        if not fs.exists(path):
            return []
        spans = []
        for f in fs.listStatus(path):
            first, _, last = f.getPath().getName()[1:].partition("-")
            if first.isdigit() and last.isdigit() and fs.exists(self._folder(f"{f.getPath().getName()}/_SUCCESS")[0]):
                spans.append((int(first), int(last)))
        return sorted(spans)

    def layers(self, before: int | None = None) -> list[tuple[int, int]]:
        """(first batch, last batch) of the layers that count, oldest first."""
        spans = [s for s in self._complete() if before is None or s[1] < before]
        return [s for s in spans if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in spans)]

    def _size(self, span: tuple[int, int]) -> int:
        path, fs = self._folder("l%d-%d" % span)
        return fs.getContentSummary(path).getLength()

    def _latest(self, spans: list[tuple[int, int]], keys: DataFrame | None = None) -> DataFrame:
        rows = None
        for span in spans:
            d = self.spark.read.parquet(f"{self.path}/l{span[0]}-{span[1]}").withColumn("_layer", F.lit(span[1]))
            rows = d if rows is None else rows.unionByName(d)
        if keys is not None:  # after the union: Spark takes a union of joins by key for dealt by key, and then leaves layers apart
            k = keys.select(c(self.key).alias("_key")).distinct()
            rows = rows.join(k, c(self.key).eqNullSafe(c("_key")), "left_semi")
        columns = [k for k in rows.columns if k != "_layer"]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*columns), "_layer").alias("_r")).select("_r.*")

    def read(self, before: int | None = None, keys: DataFrame | None = None) -> DataFrame | None:
        """The latest row of each key, of those in ``keys`` if given, as of before a batch."""
        spans = self.layers(before)
        return self._latest(spans, keys) if spans else None

    def write(self, df: DataFrame, batch: int) -> None:
        """Add the rows that a batch changed."""
        path, fs = self._folder()
        counting = self.layers(batch)
        for span in self._complete():
            if span[1] < batch and span not in counting:
                fs.delete(self._folder("l%d-%d" % span)[0], True)
        merged = counting[-1:]
        size = self._size(merged[0]) if merged else 0
        for span in reversed(counting[:-1]):
            if self._size(span) > 2 * size:
                break
            merged, size = [span, *merged], size + self._size(span)
        if len(merged) > 1:
            self._latest(merged).write.mode("overwrite").parquet(f"{self.path}/l{merged[0][0]}-{merged[-1][1]}")
        df.write.mode("overwrite").parquet(f"{self.path}/l{batch}-{batch}")


def last_write_wins(table: VersionedTable | LayeredTable, rules: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A batch function that merges the latest change of each key into the table."""
    order = [c("updated_at").desc(), c("change_id").desc()]

    def work(batch: DataFrame, n: int) -> None:
        new = latest_per_key(batch, ["id"], order)
        stored = table.read(before=n, keys=new)
        out = new.withColumn("conflict", F.lit(False)) if stored is None else accept(stored.drop("conflict"), new)
        table.write(rules(out) if rules else out, n)

    return work


def push_versions(table: VersionedTable | LayeredTable) -> Callable[[DataFrame, int], None]:
    """A batch function for pushed changes (id, arrival, change_id, updated_at).

    A change that is older than what is stored is a conflict and changes nothing; any other replaces the row and raises its
    version by one. The changes of a batch count in the order of their arrival. A change without a time is never older; ``updated_at`` is the latest time so far.
    """
    columns = ("id", "change_id", "updated_at", "version", "conflicts")

    def work(batch: DataFrame, n: int) -> None:
        stored = table.read(before=n, keys=batch)
        if stored is None:
            stored = batch.limit(0).selectExpr("id", "change_id", "updated_at", "cast(0 as bigint) as version", "cast(0 as bigint) as conflicts")
        stored = stored.select(c("id").alias("old_id"), *[c(k).alias(f"old_{k}") for k in columns[1:]])
        same = c("id").eqNullSafe(c("old_id"))
        w = Window.partitionBy("id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
        before = F.greatest(F.max("updated_at").over(w), c("old_updated_at"))
        d = batch.join(stored.select("old_id", "old_updated_at"), same, "left").withColumn("ok", F.coalesce(c("updated_at") >= before, F.lit(True)))
        last, there = F.max_by("change_id", F.when(c("ok"), c("arrival"))), F.lit(True).alias("there")
        d = d.groupBy("id").agg(F.count_if("ok").alias("taken"), F.count_if(~c("ok")).alias("refused"), last.alias("last"), F.max("updated_at").alias("latest"), there).join(stored, same, "full_outer")
        zero = F.lit(0).cast("bigint")
        add = lambda a, b: F.coalesce(a, zero) + F.coalesce(b, zero)
        new = [F.when(c("there"), c("id")).otherwise(c("old_id")).alias("id"), F.coalesce("last", "old_change_id").alias("change_id"), F.greatest("latest", "old_updated_at").alias("updated_at")]
        table.write(d.select(*new, add(c("old_version"), c("taken")).alias("version"), add(c("old_conflicts"), c("refused")).alias("conflicts")), n)

    return work


#: State of a key whose prices are held back, and what comes out.
HELD = "n long, total long, items array<string>, places array<string>, times array<long>, prices array<double>"
ANOMALY_ROWS = "item_id string, price double, prior double"
#: The share of the earlier mean by which a price is an anomaly.
ANOMALY = 0.30


def held_prices(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Each price against the mean of those before it, in the order of event time, however the rows arrive.

    Rows (item_id, place, at, price) wait in the state until the watermark has passed their time; then all earlier ones are there, and they count in
    the order of time and place. A timer at the first waiting time wakes keys that get no more rows.
    """
    n, total, items, places, times, prices = state.get if state.exists else (0, 0, [], [], [], [])
    waiting = list(zip(times, places, items, prices, strict=True))
    if not state.hasTimedOut:
        for pdf in batches:
            waiting += zip(pdf["at"].astype("datetime64[ms]").astype("int64").tolist(), pdf["place"].tolist(), pdf["item_id"].tolist(), pdf["price"].tolist(), strict=True)
    waiting.sort()
    watermark, out, k = state.getCurrentWatermarkMs(), [], 0
    for at, _, item, price in waiting:
        if at > watermark:
            break
        k += 1
        prior = total / n / 10000 if n else 0.0
        if prior > 0 and abs(price - prior) / prior > ANOMALY:
            out.append((item, price, prior))
        n, total = n + 1, total + int(price * 10000 // 1)
    waiting = waiting[k:]
    state.update((n, total, *([list(x) for x in (zip(*[(w[2], w[1], w[0], w[3]) for w in waiting], strict=True))] or [[], [], [], []])))
    if waiting:
        state.setTimeoutTimestamp(max(waiting[0][0], watermark + 1))
    yield pd.DataFrame(out, columns=["item_id", "price", "prior"]).astype({"item_id": "object", "price": "float64", "prior": "float64"})


def price_anomalies(rows: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """Anomalies of a stream of prices (keys, item_id, at, place, price) that are at most ``delay`` late."""
    keyed = rows.withWatermark("at", delay).groupBy(*keys)
    return keyed.applyInPandasWithState(held_prices, ANOMALY_ROWS, HELD, "append", "EventTimeTimeout")


def ordered_anomalies(spark: SparkSession, folder: str, keys: list[str], delay: str) -> Callable[[DataFrame, int], None]:
    """A batch function with the same results as price_anomalies, of joins and windows alone: what comes out of batch n is in ``folder``/out/b=n.

    Rows wait in a table until their time lies before the latest one so far less the delay; then they count in the order of time and place, onto
    the number and the sum of the prices of their key, of which a batch reads and writes those of its keys. Rows that come later than the delay are left out.
    """
    waiting, clock, sums = VersionedTable(spark, folder + "/waiting"), VersionedTable(spark, folder + "/clock"), LayeredTable(spark, folder + "/sums", "key")

    def work(batch: DataFrame, n: int) -> None:
        rows = batch.select(F.struct(*keys).alias("key"), "item_id", "at", "place", "price")
        newest = rows.agg(F.max("at").alias("latest"))
        seen, held = clock.read(before=n), waiting.read(before=n)
        if seen is not None:
            rows = rows.crossJoin(F.broadcast(seen)).where(c("latest").isNull() | (c("at") >= c("latest") - F.expr(f"interval {delay}"))).drop("latest")
            newest = newest.unionByName(seen).agg(F.max("latest").alias("latest"))
        clock.write(newest, n)  # one row
        mark = F.broadcast(clock.read(before=n + 1).select((c("latest") - F.expr(f"interval {delay}")).alias("mark")))
        rows = (rows if held is None else rows.unionByName(held)).crossJoin(mark)
        ready = rows.where("at < mark").drop("mark")
        before = sums.read(before=n, keys=ready)
        if before is None:
            before = ready.limit(0).selectExpr("key", "cast(0 as bigint) as n", "cast(0 as bigint) as total")
        before = before.select(c("key").alias("of"), c("n").alias("n0"), c("total").alias("total0"))
        same, zero = c("key").eqNullSafe(c("of")), F.lit(0).cast("bigint")
        w = Window.partitionBy("key").orderBy("at", "place", "item_id").rowsBetween(Window.unboundedPreceding, -1)
        price = F.floor(c("price") * 10000)
        d = ready.withColumn("n", F.count("*").over(w)).withColumn("total", F.sum(price).over(w)).join(before, same, "left")
        count = c("n") + F.coalesce("n0", zero)
        prior = (F.coalesce("total", zero) + F.coalesce("total0", zero)).cast("double") / F.nullif(count, F.lit(0)) / 10000
        d = d.select("item_id", "price", prior.alias("prior")).where((c("prior") > 0) & (F.abs(c("price") - c("prior")) / c("prior") > ANOMALY))
        d.write.mode("overwrite").parquet(f"{folder}/out/b={n}")
        new = ready.groupBy("key").agg(F.count("*").alias("n"), F.sum(price).alias("total")).join(before, same, "left")
        sums.write(new.select("key", (c("n") + F.coalesce("n0", zero)).alias("n"), (F.coalesce("total", zero) + F.coalesce("total0", zero)).alias("total")), n)
        waiting.write(rows.where("at >= mark").drop("mark"), n)

    return work
