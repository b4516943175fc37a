"""Streams over the tables, run to the end of what is there; each gives the rows of its batch query."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.plans.prices import ANOMALIES
from tallyforge.plans.records import LATEST, shared_folder
from tallyforge.plans.registry import query
from tallyforge.streaming import feed as S

c = F.col


def feed_stream(m):
    raw = S.read_stream(m.spark, f"{m.sf_dir}/events.parquet", m.table("events").schema)
    return raw.selectExpr("event_id as change_id", "user_id as id", "cast(ts as timestamp) as updated_at", "value", "event_type = 'error' as deleted", "event_type")


@query(LATEST)
def stream_lww(m):
    """The feed merged batch by batch: the state after the last one equals the latest change of each key."""
    folder = shared_folder(m.spark)
    table = S.LayeredTable(m.spark, folder + "/state")
    S.run(feed_stream(m), S.last_write_wins(table), folder + "/checkpoint")
    return table.read().select("id", "change_id", "value", "deleted")


#: The parts in which the changes arrive, one batch each.
ARRIVALS = 4


@query(
    f"""SELECT id, COUNT(*) FILTER (ok) AS version, COUNT(*) FILTER (NOT ok) AS conflicts, arg_max(change_id, arrival) FILTER (ok) AS change_id
  FROM (SELECT *, coalesce(updated_at >= max(updated_at) OVER (PARTITION BY id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS ok
    FROM (SELECT id, change_id, updated_at, change_id % {ARRIVALS} * 1000000000000 + change_id AS arrival FROM feed)) GROUP BY 1"""
)
def stream_push_versions(m):
    """Changes pushed in several batches: the version of each row, its refused changes, and the change that stands."""
    folder = shared_folder(m.spark)
    table = S.LayeredTable(m.spark, folder + "/state")
    changes = m.feed.select("id", "change_id", "updated_at", (c("change_id") % ARRIVALS * 10**12 + c("change_id")).alias("arrival"))
    part = c("change_id") % ARRIVALS
    parts = sorted((r.part for r in changes.select(part.alias("part")).distinct().collect()), key=lambda k: (k is None, k or 0))  # below 0 for such ids, null comes last
    for k in parts:  # each part comes after the last run has ended; a run takes all that is new as one batch
        changes.where(part.eqNullSafe(F.lit(k))).write.mode("append").parquet(folder + "/in")
        S.run(S.read_stream(m.spark, folder + "/in", changes.schema, 1 << 20), S.push_versions(table), folder + "/checkpoint")
    return table.read().select("id", "version", "conflicts", "change_id")


@query(
    """SELECT 'invoice_items' AS tbl, item_id AS id, CASE WHEN b.duplicate_status = 'duplicate' THEN 'skipped_duplicate_invoice' ELSE 'accepted' END AS state FROM items i JOIN base b ON b.invoice_id = i.invoice_id
  UNION ALL SELECT 'invoice_discounts', CAST(d.invoice_id AS VARCHAR), CASE WHEN b.duplicate_status = 'duplicate' THEN 'skipped_duplicate_invoice' ELSE 'accepted' END FROM discounts d JOIN base b ON b.invoice_id = d.invoice_id
  UNION ALL SELECT 'price_history', item_id, 'skipped_generated' FROM prices"""
)
def stream_gate_rows(m):
    """What the gate does with each pushed row: lines and discounts of rejected invoices and generated price rows are skipped."""
    folder = shared_folder(m.spark)
    gate = m.base.select("invoice_id", (c("duplicate_status") == "duplicate").alias("no"))
    state = F.when(c("no"), "skipped_duplicate_invoice").otherwise("accepted").alias("state")
    lines = item_stream(m).join(gate, "invoice_id").select(F.lit("invoice_items").alias("tbl"), c("item_id").alias("id"), state)
    m.discounts.select("invoice_id").write.parquet(folder + "/discounts")
    d = S.read_stream(m.spark, folder + "/discounts", m.spark.read.parquet(folder + "/discounts").schema, 1000)
    d = d.join(gate, "invoice_id").select(F.lit("invoice_discounts").alias("tbl"), c("invoice_id").cast("string").alias("id"), state)
    p = price_stream(m).select(F.lit("price_history").alias("tbl"), c("item_id").alias("id"), F.lit("skipped_generated").alias("state"))
    for k, stream in enumerate((lines, d, p)):
        S.run(stream, lambda b, n, k=k: b.write.mode("overwrite").parquet(f"{folder}/out/s={k}/b={n}"), f"{folder}/checkpoint{k}")
    return m.spark.read.parquet(folder + "/out").select("tbl", "id", "state")


def item_stream(m):
    raw = S.read_stream(m.spark, f"{m.sf_dir}/lineitem.parquet", m.table("lineitem").schema)
    part = m.table("part").select("p_partkey", "p_name", "p_brand")
    d = raw.join(part, F.expr("l_partkey = p_partkey"))
    return d.selectExpr(
        "md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(cast(l_quantity as decimal(18,2)) as string), cast(cast(l_extendedprice as decimal(18,2)) as string))) as item_id",
        "l_orderkey as invoice_id", "l_linenumber as line_no", "l_partkey as product_id", "l_suppkey as supplier_id", "l_extendedprice / l_quantity as price", "l_discount <> 0.1D and l_returnflag <> 'R' and l_quantity > 0 as paid",
    )


@query("SELECT CASE WHEN b.duplicate_status = 'duplicate' THEN 'skipped_duplicate_invoice' ELSE 'accepted' END AS state, COUNT(*) AS n FROM items i JOIN base b ON b.invoice_id = i.invoice_id GROUP BY 1")
def stream_dup_gate(m):
    """Lines of rejected invoices are skipped as they come in."""
    folder = shared_folder(m.spark)
    gate = m.base.select("invoice_id", (c("duplicate_status") == "duplicate").alias("no"))
    d = item_stream(m).join(gate, "invoice_id").select(F.when(c("no"), "skipped_duplicate_invoice").otherwise("accepted").alias("state"))
    S.run(d, lambda b, n: b.groupBy("state").count().write.mode("overwrite").parquet(f"{folder}/out/b={n}"), folder + "/checkpoint")
    return m.spark.read.parquet(folder + "/out").groupBy("state").agg(F.sum("count").alias("n"))


@query("SELECT item_id, price FROM prices")
def stream_price_rows(m):
    """Price rows derived from the stream of lines."""
    folder = shared_folder(m.spark)
    S.run(price_stream(m).select("item_id", "price"), lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/out/b={n}"), folder + "/checkpoint")
    return m.spark.read.parquet(folder + "/out").select("item_id", "price")


def price_stream(m):
    ok = m.base.where("status = 'APPROVED' and not deleted").select("invoice_id", "company_id", "invoice_date")
    return item_stream(m).where("paid").join(ok, "invoice_id")


#: Rows arrive up to so many days after their date, in parts of a year, and a part may be split over batches; nothing is later than the delay.
JITTER, DELAY = 60, "800 days"


@query("SELECT item_id, price, prior FROM (" + ANOMALIES + ")")
def stream_price_anomaly(m):
    """Prices that arrive out of order, over several micro-batches, give the anomalies of their order in time: rows wait for the watermark.

    The last part is a heartbeat, a row of no key and a far date, which lets the watermark pass all others.
    """
    folder = shared_folder(m.spark)
    place = F.format_string("%020d-%010d-%s", "invoice_id", c("line_no").cast("int"), "item_id")
    rows = m.bare_prices.select("company_id", "supplier_id", "product_id", "item_id", c("invoice_date").cast("timestamp").alias("at"), place.alias("place"), "price")
    year = F.year(F.date_add(c("at").cast("date"), F.pmod(F.xxhash64("item_id"), F.lit(JITTER)).cast("int")))
    rows.withColumn("year", year).write.partitionBy("year").parquet(folder + "/rows")
    stored = m.spark.read.parquet(folder + "/rows")
    years = [r.year for r in stored.select("year").distinct().orderBy("year").collect()]  # some ten
    end = rows.limit(1).select(*[F.lit(None).cast(t).alias(k) if k != "at" else F.timestamp_seconds(F.lit(7_258_118_400)).alias(k) for k, t in rows.dtypes])
    schema = rows.schema
    for part in [*[stored.where(c("year") == y).drop("year") for y in years], end]:
        part.write.mode("append").parquet(folder + "/in")
        S.run(S.read_stream(m.spark, folder + "/in", schema, 64), S.ordered_anomalies(m.spark, folder, ["company_id", "supplier_id", "product_id"], DELAY), folder + "/checkpoint")
    return m.spark.read.parquet(folder + "/out").select("item_id", "price", "prior")


@query("SELECT product_id, supplier_id, min(price) AS low, max(price) AS top, CAST(SUM(CAST(floor(price * 10000) AS BIGINT)) AS DOUBLE) / COUNT(*) / 10000 AS mean, COUNT(*) AS n FROM prices GROUP BY 1, 2")
def stream_alias_stats(m):
    """Statistics in update mode: the last update of each key is its result."""
    folder = shared_folder(m.spark)
    d = price_stream(m).groupBy("product_id", "supplier_id").agg(F.min("price").alias("low"), F.max("price").alias("top"), (F.sum(F.floor(c("price") * 10000)).cast("double") / F.count("*") / 10000).alias("mean"), F.count("*").alias("n"))
    S.run(d, lambda b, n: b.withColumn("at", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/b={n}"), folder + "/checkpoint", "update")
    last = m.spark.read.parquet(folder + "/out").groupBy("product_id", "supplier_id").agg(F.max_by(F.struct("low", "top", "mean", "n"), "at").alias("s"))
    return last.select("product_id", "supplier_id", "s.*")
