"""Streams go on where they stopped, with the state they had."""

from pyspark.sql import functions as F

from tallyforge.plans import feeds
from tallyforge.sources.model import Model
from tallyforge.streaming import feed as S

SF = "/root/testdata/sf0.001"


def test_state_survives_a_restart(spark, tmp_path):
    m = Model(spark, SF)
    expected = sorted(tuple(r) for r in feeds.stream_push_versions(m).collect())
    rows = m.feed.select("id", "change_id", "updated_at", (F.col("change_id") % 4 * 10**12 + F.col("change_id")).alias("arrival"))
    folder, schema = str(tmp_path), rows.schema
    for k in range(4):  # each part comes after the last run has ended; nothing is kept in the driver between
        rows.where(F.col("change_id") % 4 == k).coalesce(1).write.mode("append").parquet(folder + "/in")
        S.run(S.read_stream(spark, folder + "/in", schema), S.push_versions(S.VersionedTable(spark, folder + "/state")), folder + "/checkpoint")
    table = S.VersionedTable(spark, folder + "/state")
    assert sorted(tuple(r) for r in table.read().select("id", "version", "conflicts", "change_id").collect()) == expected
    assert len(table.versions()) == 2 and sum(r[2] for r in expected) > 0


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    m = Model(spark, SF)
    rows = m.feed.select("id", "change_id", "updated_at", F.col("change_id").alias("arrival"))
    table = S.VersionedTable(spark, str(tmp_path))
    work = S.push_versions(table)
    work(rows.where("change_id % 2 = 0"), 0)
    work(rows.where("change_id % 2 = 1"), 1)
    once = sorted(map(tuple, table.read().collect()))
    S.push_versions(S.VersionedTable(spark, str(tmp_path)))(rows.where("change_id % 2 = 1"), 1)
    assert sorted(map(tuple, table.read().collect())) == once


def test_an_incomplete_version_is_not_read(spark, tmp_path):
    table = S.VersionedTable(spark, str(tmp_path))
    assert table.read() is None and table.versions() == []
    table.write(spark.range(3), 0)
    (tmp_path / "v1").mkdir()
    assert table.read().count() == 3


def test_layers_hold_what_batches_change(spark, tmp_path):
    """The rows that a batch writes are in the order of those it changes, few layers stay, and a repeated batch changes nothing."""
    m = Model(spark, SF)
    expected = sorted(map(tuple, feeds.stream_push_versions(m).collect()))
    rows = m.feed.select("id", "change_id", "updated_at", (F.col("change_id") % 4 * 10**12 + F.col("change_id")).alias("arrival")).cache()
    table = S.LayeredTable(spark, str(tmp_path))
    work = S.push_versions(table)
    bounds = [(p, lo) for p in range(4) for lo in range(0, 1000, 250)]  # in the order of arrival
    ids = rows.agg(F.max("change_id")).first()[0] + 1
    for n, (p, lo) in enumerate(bounds):
        batch = rows.where((F.col("change_id") % 4 == p) & (F.col("change_id") >= ids * lo // 1000) & (F.col("change_id") < ids * (lo + 250) // 1000))
        work(batch, n)
        if n % 5 == 0:
            S.push_versions(S.LayeredTable(spark, str(tmp_path)))(batch, n)
        assert spark.read.parquet(f"{tmp_path}/l{n}-{n}").count() == batch.select("id").distinct().count()
        assert len(table.layers()) <= 7
    assert sorted(map(tuple, table.read().select("id", "version", "conflicts", "change_id").collect())) == expected
    few = rows.where("id < 5").select("id").distinct()
    assert table.read(keys=few).count() == few.count()


def test_an_incomplete_layer_is_not_read(spark, tmp_path):
    table = S.LayeredTable(spark, str(tmp_path))
    assert table.read() is None and table.layers() == []
    table.write(spark.range(3), 0)
    (tmp_path / "l1-1").mkdir()
    table.write(spark.range(2, 4), 2)
    assert table.read().count() == 4 and table.read(before=2).count() == 3


def test_prices_in_any_order_over_batches_equal_the_batch_query(spark, tmp_path):
    """Wholly shuffled rows, a delay as long as their time."""
    m = Model(spark, SF)
    from tallyforge.plans.prices import price_anomalies

    expected = sorted((r.item_id, round(r.price, 9), round(r.prior, 9)) for r in price_anomalies(m).select("item_id", "price", "prior").collect())
    place = F.format_string("%020d-%010d-%s", "invoice_id", F.col("line_no").cast("int"), "item_id")
    rows = m.prices.select("company_id", "supplier_id", "product_id", "item_id", F.col("invoice_date").cast("timestamp").alias("at"), place.alias("place"), "price")
    parts = [rows.where(F.pmod(F.xxhash64("item_id"), F.lit(5)) == k) for k in range(5)]
    parts.append(rows.limit(1).select(*[F.lit(None).cast(t).alias(k) if k != "at" else F.timestamp_seconds(F.lit(7_258_118_400)).alias(k) for k, t in rows.dtypes]))
    for part in parts:
        part.write.mode("append").parquet(f"{tmp_path}/in")
        d = S.price_anomalies(S.read_stream(spark, f"{tmp_path}/in", rows.schema, 2), ["company_id", "supplier_id", "product_id"], "5000 days")
        S.run(d, lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/b={n}"), f"{tmp_path}/checkpoint")
    got = sorted((r.item_id, round(r.price, 9), round(r.prior, 9)) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == expected and expected


def test_layers_of_many_files_meet_by_key(spark, tmp_path):
    """Layers dealt alike and read for the keys of a batch give one row a key, whatever the sizes of their parts; null keys too."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = S.LayeredTable(spark, str(tmp_path))
        keys = spark.range(0, 1500, 1, 6).select(F.when(F.col("id") > 0, F.col("id")).alias("id"))
        for n, wide in enumerate((1, 200)):
            table.write(keys.repartition(6).withColumn("v", F.repeat(F.md5(F.col("id").cast("string")), wide)), n)
        got = table.read(before=2, keys=keys.union(keys))
        assert got.count() == 1500 and {r[0] for r in got.select(F.length("v")).where("id is not null").distinct().collect()} == {32 * 200}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_pushed_changes_without_id_or_time_and_with_ids_below_zero(spark, tmp_path):
    """Null and negative ids, null times and many input files give the rows of the query's SQL."""
    import duckdb

    from tallyforge import catalog

    rows = spark.range(-3000, 3000, 1, 6).withColumn("h", F.pmod(F.xxhash64("id"), F.lit(100000)))
    ts = F.when(F.col("h") % 11 != 0, F.timestamp_seconds(F.col("h")).cast("timestamp_ntz"))
    rows.select(F.col("id").alias("event_id"), ts.alias("ts"), F.when(F.col("h") % 40 > 0, F.col("h") % 40).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "part", "supplier"):
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    con.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
    expected = con.execute("SELECT id, version, conflicts, change_id FROM (" + catalog.oracle_sql()["stream_push_versions"] + ")").fetchall()
    got = [tuple(r) for r in catalog.queries()["stream_push_versions"](spark, str(tmp_path)).select("id", "version", "conflicts", "change_id").collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted(expected, key=key) and len(got) == 40


def test_ordered_anomalies_keep_no_python_state_and_survive_repeats(spark, tmp_path):
    """Shuffled rows over several batches, each of them twice, give the anomalies of their order; the query runs no Python on the rows."""
    import inspect

    from tallyforge.plans.prices import price_anomalies

    m = Model(spark, SF)
    expected = sorted((r.item_id, round(r.price, 9), round(r.prior, 9)) for r in price_anomalies(m).select("item_id", "price", "prior").collect())
    place = F.format_string("%020d-%010d-%s", "invoice_id", F.col("line_no").cast("int"), "item_id")
    rows = m.prices.select("company_id", "supplier_id", "product_id", "item_id", F.col("invoice_date").cast("timestamp").alias("at"), place.alias("place"), "price").cache()
    end = rows.limit(1).select(*[F.lit(None).cast(t).alias(k) if k != "at" else F.timestamp_seconds(F.lit(7_258_118_400)).alias(k) for k, t in rows.dtypes])
    years = [r.y for r in rows.select(F.year("at").alias("y")).distinct().orderBy("y").collect()]
    late = F.pmod(F.xxhash64("item_id"), F.lit(2))  # half of a year comes a year later
    for n, part in enumerate([*[rows.where(F.year("at") + late == y) for y in [*years, years[-1] + 1]], end]):
        for _ in range(2):
            S.ordered_anomalies(spark, str(tmp_path), ["company_id", "supplier_id", "product_id"], "800 days")(part, n)
    got = sorted((r.item_id, round(r.price, 9), round(r.prior, 9)) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == expected and expected
    assert "ordered_anomalies" in inspect.getsource(feeds)
