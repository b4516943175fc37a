"""Queries on records: scans, sinks, filters and projections."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.operators import predicates as P
from tallyforge.operators.state import latest_per_key, upsert
from tallyforge.plans.registry import query

#: Parameters of the queries: a tenant and a moment.
TENANT = "7"
SINCE = "2024-01-15 00:00:00"


def shared_folder(spark) -> str:
    """A new folder below the checkpoint folder, which all machines share. Where none is set, a local session gets a temporary one and a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="tallyforge-")
        sc.setCheckpointDir(folder)
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


@query("SELECT invoice_id, supplier_id, status FROM base WHERE company_id = '7' AND NOT deleted")
def src_active_scan(m):
    return m.base.where(P.same_tenant(F.col("company_id"), TENANT) & ~F.col("deleted")).select("invoice_id", "supplier_id", "status")


SNAPSHOT = "SELECT 'suppliers' AS tbl, COUNT(*) AS n FROM suppliers_v UNION ALL SELECT 'invoices', COUNT(*) FROM base UNION ALL SELECT 'invoice_items', COUNT(*) FROM items UNION ALL SELECT 'discounts', COUNT(*) FROM discounts UNION ALL SELECT 'price_history', COUNT(*) FROM prices UNION ALL SELECT 'changes', COUNT(*) FROM feed"


@query(SNAPSHOT)
def src_snapshot_counts(m):
    tables = {"suppliers": m.suppliers, "invoices": m.base, "invoice_items": m.items, "discounts": m.discounts, "price_history": m.prices, "changes": m.feed}
    out = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n") for name, df in tables.items()]
    result = out[0]
    for df in out[1:]:
        result = result.union(df)
    return result


@query(f"SELECT change_id, id, updated_at, deleted FROM feed WHERE updated_at > TIMESTAMP '{SINCE}'")
def src_since(m):
    return m.feed.where(F.col("updated_at") > F.lit(SINCE).cast("timestamp")).select("change_id", "id", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), "deleted")


@query("""SELECT supplier_id, len(aliases) AS n_aliases, aliases[1] AS first_alias FROM (
  SELECT supplier_id, CASE WHEN supplier_id % 2 = 0 THEN [name, segment] ELSE [name, lower(segment)] END AS aliases FROM suppliers_v)""")
def json_aliases(m):
    """A JSON list, or on bad JSON a list separated by bars."""
    raw = F.expr("case when supplier_id % 2 = 0 then to_json(array(name, segment)) else concat(name, ' | ', lower(segment)) end")
    parsed = F.coalesce(F.from_json(raw, "array<string>"), F.filter(F.transform(F.split(raw, r"\|"), lambda x: F.trim(x)), lambda x: x != ""))
    d = m.suppliers.select("supplier_id", parsed.alias("aliases"))
    return d.select("supplier_id", F.size("aliases").cast("bigint").alias("n_aliases"), F.get("aliases", F.lit(0)).alias("first_alias"))


@query("""SELECT id, tbl, n, ord FROM (SELECT id, COUNT(*) FILTER (NOT deleted) AS a, COUNT(*) FILTER (deleted) AS b FROM feed GROUP BY id),
  LATERAL (SELECT 'upserts' AS tbl, a AS n, 0 AS ord UNION ALL SELECT 'deletes', b, 1)""")
def src_flatten_changes(m):
    """A JSON change set by table becomes rows in a fixed order of tables."""
    sets = m.feed.groupBy("id").agg(F.to_json(F.create_map(F.lit("upserts"), F.count_if(~F.col("deleted")), F.lit("deletes"), F.count_if("deleted"))).alias("changes"))
    rows = sets.select("id", F.explode(F.map_entries(F.from_json("changes", "map<string,bigint>"))).alias("e"))
    return rows.select("id", F.col("e.key").alias("tbl"), F.col("e.value").alias("n"), F.when(F.col("e.key") == "upserts", 0).otherwise(1).alias("ord"))


@query("SELECT task_id, status, CAST(json_extract_string(result_json, '$.k') AS INTEGER) AS k, CAST(row_number() OVER (PARTITION BY batch ORDER BY created_at DESC, task_id DESC) AS INTEGER) AS place FROM tasks")
def recognition_tasks(m):
    """Newest first within a batch, with the nested result decoded."""
    k = F.from_json("result_json", "k int")["k"]
    w = Window.partitionBy("batch").orderBy(F.col("created_at").desc(), F.col("task_id").desc())
    return m.tasks.select("task_id", "status", k.alias("k"), F.row_number().over(w).alias("place"))


LATEST = "SELECT id, change_id, value, deleted FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, change_id DESC) AS rn FROM feed) WHERE rn = 1"


@query(LATEST)
def snk_upsert(m):
    """Changes of the first half of the feed are stored, the others upserted into a new version, which is read back."""
    early = m.feed.where(F.col("updated_at") <= F.lit(SINCE).cast("timestamp"))
    late = m.feed.where(F.col("updated_at") > F.lit(SINCE).cast("timestamp"))
    order = [F.col("updated_at").desc(), F.col("change_id").desc()]
    path = shared_folder(m.spark)
    latest_per_key(early, ["id"], order).write.parquet(f"{path}/v1")
    upsert(m.spark.read.parquet(f"{path}/v1"), latest_per_key(late, ["id"], order), ["id"]).write.parquet(f"{path}/v2")
    return m.spark.read.parquet(f"{path}/v2").select("id", "change_id", "value", "deleted")


@query("SELECT id, change_id, deleted FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, change_id DESC) AS rn FROM feed WHERE updated_at > TIMESTAMP '2024-01-15 00:00:00') WHERE rn = 1")
def snk_mirror(m):
    """Rows changed since a moment are copied to a second store, newest per key."""
    path = shared_folder(m.spark)
    feed = m.feed.where(F.col("updated_at") > F.lit(SINCE).cast("timestamp"))
    latest_per_key(feed, ["id"], [F.col("updated_at").desc(), F.col("change_id").desc()]).write.parquet(path)
    return m.spark.read.parquet(path).select("id", "change_id", "deleted")


@query("""SELECT i.item_id, b.invoice_no, b.invoice_date, s.display_name AS supplier, i.raw_name, CAST(i.quantity AS DOUBLE) AS quantity, i.unit_price, CAST(i.total AS DOUBLE) AS total
  FROM items i LEFT JOIN base b ON b.invoice_id = i.invoice_id LEFT JOIN suppliers_v s ON s.supplier_id = b.supplier_id WHERE NOT i.candidate_only""")
def export_items(m):
    b = m.base.select("invoice_id", "invoice_no", "invoice_date", F.col("supplier_id").alias("sid"))
    s = m.suppliers.select(F.col("supplier_id").alias("sid"), F.col("display_name").alias("supplier"))
    d = m.items.where("not candidate_only").join(b, "invoice_id", "left").join(s, "sid", "left")
    return d.selectExpr("item_id", "invoice_no", "invoice_date", "supplier", "raw_name", "cast(quantity as double) as quantity", "unit_price", "cast(total as double) as total")


@query(r"SELECT doc_id, md5(regexp_replace(replace(text, chr(9), ' '), '\r?\n', ' ', 'g')) AS cell FROM documents")
def export_tsv_cells(m):
    return m.table("documents").select("doc_id", F.md5(F.regexp_replace(F.replace("text", F.lit("\t"), F.lit(" ")), r"\r?\n", " ")).alias("cell"))


@query("""SELECT section, COUNT(*) AS n, COUNT(DISTINCT key) AS n_keys FROM (
  SELECT 'items' AS section, item_id AS key FROM items WHERE NOT candidate_only UNION ALL SELECT 'invoices', invoice_no FROM base WHERE NOT deleted
  UNION ALL SELECT 'suppliers', name FROM suppliers_v WHERE NOT deleted UNION ALL SELECT 'products', raw_name FROM items UNION ALL SELECT 'price_history', item_id FROM prices) GROUP BY section""")
def export_sections(m):
    """Five sections, each with its own columns; the query gives the rows of each."""
    parts = {
        "items": m.items.where("not candidate_only").select(F.col("item_id").alias("key")), "invoices": m.base.where("not deleted").select(F.col("invoice_no").alias("key")),
        "suppliers": m.suppliers.where("not deleted").select(F.col("name").alias("key")), "products": m.items.select(F.col("raw_name").alias("key")),
        "price_history": m.prices.select(F.col("item_id").alias("key")),
    }
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("section"), "key")
        out = df if out is None else out.union(df)
    return out.groupBy("section").agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_keys"))


@query("SELECT 'suppliers' AS tbl, COUNT(*) FILTER (NOT deleted) AS active, COUNT(*) AS n FROM suppliers_v UNION ALL SELECT 'invoices', COUNT(*) FILTER (NOT deleted), COUNT(*) FROM base")
def table_counts(m):
    one = lambda df, name: df.agg(F.count_if(~F.col("deleted")).alias("active"), F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "active", "n")
    return one(m.suppliers, "suppliers").union(one(m.base, "invoices"))


@query("""SELECT company_id, COUNT(*) FILTER (mark = '') AS live, COUNT(*) FILTER (mark <> '') AS dead FROM (
  SELECT company_id, CASE WHEN deleted THEN '2024-01-01' ELSE '' END AS mark FROM base) GROUP BY company_id""")
def flt_active(m):
    mark = F.when(F.col("deleted"), F.lit("2024-01-01")).when(F.col("invoice_id") % 2 == 0, F.lit(""))
    d = m.base.select("company_id", P.live(mark).alias("live"))
    return d.groupBy("company_id").agg(F.count_if("live").alias("live"), F.count_if(~F.col("live")).alias("dead"))


STATUSES = "(SELECT *, CASE WHEN invoice_id % 31 = 0 THEN 'merged' WHEN invoice_id % 37 = 0 THEN 'Hidden' WHEN invoice_id % 41 = 0 THEN 'confirmed' WHEN invoice_id % 43 = 0 THEN 'ABNORMAL' ELSE status END AS st FROM invoices)"


def _statuses(df):
    return df.withColumn("st", F.expr("case when invoice_id % 31 = 0 then 'merged' when invoice_id % 37 = 0 then 'Hidden' when invoice_id % 41 = 0 then 'confirmed' when invoice_id % 43 = 0 then 'ABNORMAL' else status end"))


@query(f"SELECT invoice_id, st FROM {STATUSES} WHERE NOT deleted AND lower(st) NOT IN ('merged', 'hidden')")
def flt_listable_invoices(m):
    return _statuses(m.base).where(~F.col("deleted") & P.listable(F.col("st"))).select("invoice_id", "st")


@query(f"SELECT invoice_id, supplier_id FROM {STATUSES} WHERE upper(st) IN ('APPROVED', 'CONFIRMED')")
def flt_approved(m):
    return _statuses(m.base).where(P.approved(F.col("st"))).select("invoice_id", "supplier_id")


@query(f"""SELECT st, duplicate_status, COUNT(*) AS n, CAST(SUM(total_amount) AS DOUBLE) AS amount FROM {STATUSES}
  WHERE lower(st) NOT IN ('merged', 'hidden', 'duplicate') AND duplicate_status NOT IN ('duplicate', 'confirmed')
    AND (upper(st) IN ('APPROVED', 'CONFIRMED') OR upper(st) NOT IN ('PENDING_REVIEW', 'ABNORMAL')) GROUP BY 1, 2""")
def flt_approved_stats(m):
    d = _statuses(m.invoices).where(P.approved_for_stats(F.col("st"), F.col("duplicate_status")))
    return d.groupBy("st", "duplicate_status").agg(F.count("*").alias("n"), F.sum("total_amount").cast("double").alias("amount"))


@query(f"SELECT invoice_id, st, duplicate_status FROM {STATUSES} WHERE upper(st) NOT IN ('APPROVED', 'CONFIRMED') AND (upper(st) = 'PENDING_REVIEW' OR duplicate_status = 'possible')")
def flt_pending(m):
    return _statuses(m.base).where(P.pending(F.col("st"), F.col("duplicate_status"))).select("invoice_id", "st", "duplicate_status")


@query(f"SELECT invoice_id, st, total_difference FROM {STATUSES} WHERE upper(st) NOT IN ('APPROVED', 'CONFIRMED') AND (upper(st) = 'ABNORMAL' OR total_difference > 0.05 OR warnings <> '')")
def flt_abnormal(m):
    return _statuses(m.invoices).where(P.abnormal(F.col("st"), F.col("total_difference"), F.col("warnings"))).select("invoice_id", "st", "total_difference")


@query("""SELECT company_id, COUNT(*) FILTER (duplicate_status = 'duplicate') AS server_dup, COUNT(*) FILTER (duplicate_status IN ('duplicate', 'confirmed')) AS local_dup,
  COUNT(*) FILTER (sync_status = 'conflict') AS conflicts, COUNT(*) FILTER (warnings LIKE '%MULTI_PAGE%') AS pages FROM base GROUP BY 1""")
def flt_issue_classes(m):
    d = F.col("duplicate_status")
    return m.base.groupBy("company_id").agg(
        F.count_if(P.duplicate(d)).alias("server_dup"), F.count_if(P.duplicate(d, local=True)).alias("local_dup"),
        F.count_if(F.col("sync_status") == "conflict").alias("conflicts"), F.count_if(P.multi_page(F.col("warnings"), F.lit("x"))).alias("pages"),
    )


NAMES = "(SELECT *, CASE WHEN line_no = 7 THEN 'needs_review' WHEN line_no = 6 THEN 'bad' ELSE 'ok' END AS name_status, brand = 'Brand#3' AS is_discount FROM items)"


def _names(df):
    return df.withColumn("name_status", F.expr("case when line_no = 7 then 'needs_review' when line_no = 6 then 'bad' else 'ok' end")).withColumn("is_discount", F.expr("brand = 'Brand#3'"))


@query(f"""SELECT line_no, COUNT(*) FILTER (NOT is_discount AND NOT candidate_only AND name_status <> 'needs_review') AS trusted,
  COUNT(*) FILTER (NOT is_discount AND NOT candidate_only AND NOT is_free) AS searchable, COUNT(*) FILTER (name_status <> 'bad') AS local_trusted FROM {NAMES} GROUP BY 1""")
def flt_trusted_items(m):
    c = F.col
    return _names(m.items).groupBy("line_no").agg(
        F.count_if(P.trusted(c("is_discount"), c("candidate_only"), c("name_status"))).alias("trusted"),
        F.count_if(P.searchable(c("is_discount"), c("candidate_only"), c("is_free"))).alias("searchable"),
        F.count_if(c("name_status") != "bad").alias("local_trusted"),
    )


@query("SELECT item_id, invoice_id, price FROM (SELECT p.*, p.price AS pr FROM prices p) WHERE price > 0 AND total > 0")
def ph_eligible(m):
    c = F.col
    ok = m.base.where(P.approved(c("status")) & ~c("deleted")).select("invoice_id")
    d = m.items.where(P.price_history_eligible(c("raw_name"), c("quantity"), c("unit_price"), c("total"), c("is_free"), c("candidate_only")))
    return d.join(ok, "invoice_id", "left_semi").select("item_id", "invoice_id", c("unit_price").alias("price"))


ROWS = "(SELECT invoice_id, raw_name AS name, CAST(total AS DOUBLE) AS amount FROM items UNION ALL SELECT invoice_id, discount_name, CAST(amount AS DOUBLE) FROM discounts)"


@query(f"SELECT invoice_id, COUNT(*) FILTER (contains(lower(name), 'discount') OR amount < 0) AS discount_rows, COUNT(*) FILTER (NOT (contains(lower(name), 'discount') OR amount < 0)) AS item_rows FROM {ROWS} GROUP BY 1")
def split_discounts(m):
    rows = m.items.selectExpr("invoice_id", "raw_name as name", "cast(total as double) as amount").union(m.discounts.selectExpr("invoice_id", "discount_name", "cast(amount as double)"))
    d = P.discount_line(F.col("name"), F.col("amount"), F.lit(0.0))
    return rows.groupBy("invoice_id").agg(F.count_if(d).alias("discount_rows"), F.count_if(~d).alias("item_rows"))


@query("""SELECT invoice_id, COUNT(*) FILTER (keep) AS kept, COUNT(*) FILTER (NOT keep) AS dropped FROM (
  SELECT invoice_id, line_no = 1 OR ship_date >= DATE '2001-01-01' OR (total > 0 AND quantity > 0) AS keep FROM items) GROUP BY 1""")
def catalog_filter(m):
    keep = P.catalog_keep(F.expr("line_no = 1"), F.expr("ship_date >= date'2001-01-01'"), F.col("total"), F.col("quantity"))
    return m.items.groupBy("invoice_id").agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"))


@query("""SELECT invoice_id, supplier_id, CAST(total_amount AS DOUBLE) AS amount FROM invoices
  WHERE NOT deleted AND invoice_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND contains(lower(invoice_no), '1') AND total_amount >= 1000 AND total_amount <= 200000 AND warnings <> ''""")
def supplier_history(m):
    return history(m.invoices.where("not deleted"), start="1996-01-01", end="1998-12-31", number="1", least=1000, most=200000, warnings=True).selectExpr("invoice_id", "supplier_id", "cast(total_amount as double) as amount")


def history(df, start=None, end=None, number=None, amount=None, least=None, most=None, warnings=None):
    """Invoices under optional conditions, all of which must hold."""
    c = F.col
    tests = [
        start and c("invoice_date") >= F.lit(start).cast("date"), end and c("invoice_date") <= F.lit(end).cast("date"),
        number and F.lower("invoice_no").contains(number.lower()), amount and F.abs(c("total_amount") - amount) < 0.01,
        least and c("total_amount") >= least, most and c("total_amount") <= most, warnings and c("warnings") != "",
    ]
    for t in tests:
        if t is not None and t is not False:
            df = df.where(t)
    return df


@query("""SELECT invoice_id, array_to_string(list_filter([CASE WHEN a < 0.7 THEN 'supplier' END, CASE WHEN b < 0.7 THEN 'number' END, CASE WHEN c < 0.7 THEN 'date' END], lambda x: x IS NOT NULL), ',') AS low FROM (
  SELECT invoice_id, CAST(invoice_id % 10 AS DOUBLE) / 10 AS a, CAST(invoice_id % 9 AS DOUBLE) / 9 AS b, CASE WHEN invoice_id % 4 = 0 THEN 1.0 ELSE CAST(invoice_id % 8 AS DOUBLE) / 8 END AS c FROM base)""")
def low_confidence(m):
    """Fields below 0.7; a missing confidence counts as 1."""
    fields = F.expr("""array(named_struct('name', 'supplier', 'value', (invoice_id % 10) / 10D), named_struct('name', 'number', 'value', (invoice_id % 9) / 9D),
      named_struct('name', 'date', 'value', case when invoice_id % 4 = 0 then null else (invoice_id % 8) / 8D end))""")
    low = F.filter(fields, lambda x: F.coalesce(x["value"], F.lit(1.0)) < 0.7)
    return m.base.select("invoice_id", F.array_join(F.transform(low, lambda x: x["name"]), ",").alias("low"))


BADGES = """SELECT invoice_id, CASE WHEN conflict THEN 'conflict' WHEN dup THEN 'duplicate' WHEN pages THEN 'multipage' WHEN ok THEN 'confirmed' WHEN abn THEN 'abnormal' WHEN pen THEN 'pending' ELSE 'saved' END AS label,
  CASE WHEN dup THEN 'duplicate' WHEN conflict THEN 'conflict' WHEN abn THEN 'abnormal' WHEN pages THEN 'multipage' WHEN pen THEN 'pending' WHEN ok THEN 'confirmed' ELSE 'saved' END AS badge FROM (
  SELECT invoice_id, sync_status = 'conflict' AS conflict, duplicate_status IN ('duplicate', 'confirmed') AS dup, contains(warnings, 'MULTI_PAGE') AS pages, status = 'APPROVED' AS ok,
    status <> 'APPROVED' AND (total_difference > 0.05 OR warnings <> '') AS abn, status <> 'APPROVED' AND (status = 'PENDING_REVIEW' OR duplicate_status = 'possible') AS pen FROM invoices)"""


@query(BADGES)
def status_badge(m):
    c = F.col
    is_ = {
        "conflict": c("sync_status") == "conflict", "duplicate": P.duplicate(c("duplicate_status"), local=True), "multipage": P.multi_page(c("warnings")),
        "confirmed": P.approved(c("status")), "abnormal": P.abnormal(c("status"), c("total_difference"), c("warnings")), "pending": P.pending(c("status"), c("duplicate_status")),
    }

    def first(*order):
        out = F.when(is_[order[0]], order[0])
        for k in order[1:]:
            out = out.when(is_[k], k)
        return out.otherwise("saved")

    return m.invoices.select("invoice_id", first("conflict", "duplicate", "multipage", "confirmed", "abnormal", "pending").alias("label"), first("duplicate", "conflict", "abnormal", "multipage", "pending", "confirmed").alias("badge"))


@query("""SELECT invoice_id, CASE WHEN reason <> '' THEN reason WHEN duplicate_status = 'duplicate' THEN 'duplicate invoice' WHEN sync_status = 'conflict' THEN 'sync conflict' ELSE '' END AS reason FROM (
  SELECT *, concat_ws(' | ', nullif(warnings, ''), CASE WHEN sync_status = 'conflict' AND invoice_id % 2 = 0 THEN 'remote is newer' END) AS reason FROM base)""")
def issue_reason(m):
    record = F.expr("case when invoice_id % 2 = 0 then '{\"reason\": \"remote is newer\"}' else '{\"reason\": \"\"}' end")
    conflict = F.when(F.col("sync_status") == "conflict", F.expr("1") * 0 == 0)
    reason = F.concat_ws(" | ", F.expr("nullif(warnings, '')"), F.when(conflict, F.nullif(F.get_json_object(record, "$.reason"), F.lit(""))))
    text = F.when(reason != "", reason).when(F.col("duplicate_status") == "duplicate", "duplicate invoice").when(F.col("sync_status") == "conflict", "sync conflict").otherwise("")
    return m.base.select("invoice_id", text.alias("reason"))


@query("SELECT item_id, CASE WHEN line_no % 3 = 0 AND unit_price <> 0 THEN unit_price * 0.5 WHEN unit_price <> 0 THEN unit_price ELSE CAST(list_price AS DOUBLE) END AS price FROM items")
def effective_price(m):
    """The first amount that isn't zero."""
    return m.items.select("item_id", first_nonzero(F.when(F.col("line_no") % 3 == 0, F.col("unit_price") * 0.5), F.col("unit_price"), F.col("list_price").cast("double")).alias("price"))


def first_nonzero(*values):
    return F.coalesce(*[F.nullif(v, F.lit(0.0)) for v in values], F.lit(0.0))


def first_text(*values):
    """The first text that isn't empty or blank."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values], F.lit(""))


@query("SELECT item_id, CASE WHEN line_no % 2 = 0 THEN raw_name ELSE brand END AS raw, CASE WHEN line_no % 3 = 0 THEN promo_group WHEN line_no % 2 = 0 THEN raw_name ELSE brand END AS standard FROM items")
def name_chains(m):
    raw = F.when(F.col("line_no") % 2 == 0, F.col("raw_name")).otherwise("  ")
    standard = F.when(F.col("line_no") % 3 == 0, F.col("promo_group"))
    return m.items.select("item_id", first_text(raw, F.lit(None).cast("string"), F.col("brand")).alias("raw"), first_text(standard, raw, F.col("brand")).alias("standard"))


@query("""SELECT change_id, CASE WHEN change_id % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE value END AS amount, CAST(CASE WHEN change_id % 3 = 0 THEN 1 ELSE greatest(1, id) END AS INTEGER) AS version, CAST(deleted AS INTEGER) AS deleted, CAST(NULL AS VARCHAR) AS note FROM feed""")
def conform_rows(m):
    """Text records cast to a schema: bad numbers become 0, versions are at least 1, flags 0 or 1, unknown columns null."""
    raw = m.feed.selectExpr("change_id", "case when change_id % 5 = 0 then 'n/a' else cast(value as string) end as amount", "case when change_id % 3 = 0 then '' else cast(id as string) end as version", "deleted")
    return raw.selectExpr("change_id", "coalesce(nanvl(try_cast(amount as double), 0D), 0D) as amount", "greatest(1, coalesce(try_cast(nullif(version, '') as int), 1)) as version", "cast(deleted as int) as deleted", "cast(null as string) as note")


@query(r"""SELECT invoice_id, trim(regexp_replace(regexp_replace(supplier_name, '[^A-Za-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) || '/' || strftime(invoice_date, '%Y-%m') || '/' || invoice_no AS path FROM base""")
def archive_path(m):
    """Folder, month and number; unsafe characters become spaces, a part has at most 80 characters."""
    safe = F.left(F.trim(F.regexp_replace(F.regexp_replace("supplier_name", r"[^A-Za-z0-9 ]", " "), " +", " ")), F.lit(80))
    return m.base.select("invoice_id", F.concat_ws("/", safe, F.coalesce(F.date_format("invoice_date", "yyyy-MM"), F.lit("undated")), "invoice_no").alias("path"))


@query("SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN '' ELSE md5(html) END AS body FROM pages")
def sanitize_payload(m):
    """Image and blob texts are blanked, binary columns dropped."""
    p = m.table("pages").withColumn("body", F.expr("case when page_id % 6 = 0 then concat(' DATA:image/png;base64,', html) when page_id % 3 = 0 then 'blob:x' else md5(html) end")).withColumn("thumb", F.encode("url", "utf-8"))
    return blank_media(p).select("page_id", "url", "body")


def blank_media(df):
    keep = [f for f in df.schema.fields if f.dataType.typeName() != "binary"]
    return df.select(*[F.when(F.lower(F.trim(f.name)).rlike(r"^(data:image/|blob:)"), "").otherwise(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "string" else f.name for f in keep])


@query("SELECT invoice_id, CASE WHEN supplier_id % 4 = 0 THEN CAST(0.35 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS supplier_conf, CASE WHEN coalesce(n_items, 0) = 0 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0.75 AS DOUBLE) END AS items_conf, CASE WHEN total_difference > 0.05 THEN CAST(0.45 AS DOUBLE) ELSE CAST(0.85 AS DOUBLE) END AS price_conf FROM invoices")
def confidence_scores(m):
    """Fixed values of confidence by what was found."""
    return m.invoices.select("invoice_id", F.when(F.col("supplier_id") % 4 == 0, 0.35).otherwise(0.8).alias("supplier_conf"), F.when(F.coalesce("n_items", F.lit(0)) == 0, 0.25).otherwise(0.75).alias("items_conf"), F.when(F.col("total_difference") > 0.05, 0.45).otherwise(0.85).alias("price_conf"))
