"""Audit, repair, templates, cascades and sync bookkeeping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.operators.keys import first_in_order
from tallyforge.operators.state import latest_per_key
from tallyforge.plans.registry import query

c = F.col

TEMPLATES = "templates AS (SELECT s_suppkey AS template_id, CAST(s_nationkey AS VARCHAR) AS company_id, s_suppkey % 10 AS supplier_id, CAST(s_acctbal AS DECIMAL(18,2)) AS score, s_suppkey % 4 = 0 AS retired, s_name AS name FROM supplier)"


def templates(m):
    return m.table("supplier").selectExpr("s_suppkey as template_id", "cast(s_nationkey as string) as company_id", "s_suppkey % 10 as supplier_id", "cast(s_acctbal as decimal(18,2)) as score", "s_suppkey % 4 = 0 as retired", "s_name as name")


@query("SELECT supplier_id, template_id, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY supplier_id ORDER BY score DESC, template_id) AS rn FROM templates WHERE NOT retired) WHERE rn = 1", TEMPLATES)
def latest_template(m):
    return first_in_order(templates(m).where("not retired"), ["supplier_id"], c("score").desc(), c("template_id")).select("supplier_id", "template_id", c("score").cast("double").alias("score"))


@query("SELECT template_id, CASE WHEN row_number() OVER (PARTITION BY supplier_id ORDER BY score DESC, template_id) = 1 THEN 'kept' ELSE 'retired' END AS state FROM templates", TEMPLATES)
def template_survivors(m):
    """One template of each supplier stays, the others are retired."""
    w = Window.partitionBy("supplier_id").orderBy(c("score").desc(), "template_id")
    return templates(m).select("template_id", F.when(F.row_number().over(w) == 1, "kept").otherwise("retired").alias("state"))


ORPHANS = "SELECT x.item_id, CASE WHEN x.invoice_id % 47 = 0 THEN 'no item' WHEN b.deleted THEN 'dead invoice' ELSE 'dead item' END AS reason FROM items x JOIN base b ON b.invoice_id = x.invoice_id WHERE NOT x.is_free AND (x.invoice_id % 47 = 0 OR b.deleted OR x.candidate_only)"


def orphans(m):
    """Price rows whose item is missing or dead, or whose invoice is dead."""
    rows = m.items.where("not is_free").select("item_id", "invoice_id")
    items = m.items.where("invoice_id % 47 <> 0").select("item_id", c("candidate_only").alias("dead"), F.lit(True).alias("there"))
    d = rows.join(items, "item_id", "left").join(m.base.select("invoice_id", "deleted"), "invoice_id", "left")
    reason = F.when(c("there").isNull(), "no item").when(c("deleted"), "dead invoice").when(c("dead"), "dead item")
    return d.select("item_id", reason.alias("reason")).where("reason is not null")


@query(ORPHANS)
def audit_orphans(m):
    return orphans(m)


DUP = "SELECT company_id, supplier_id, invoice_no, COUNT(*) AS n, string_agg(CAST(invoice_id AS VARCHAR), ',' ORDER BY invoice_id) AS ids FROM entries GROUP BY company_id, supplier_id, invoice_no, invoice_date, total_amount HAVING COUNT(*) > 1"


def dup_invoices(m):
    d = m.entries.groupBy("company_id", "supplier_id", "invoice_no", "invoice_date", c("total_amount").cast("decimal(18,2)")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("invoice_id")).alias("l"))
    return d.where("n > 1").select("company_id", "supplier_id", "invoice_no", "n", F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("ids"))


@query(DUP)
def audit_dup_invoices(m):
    return dup_invoices(m)


AMOUNTS = "SELECT invoice_id, CASE WHEN coalesce(n_items, 0) = 0 THEN 'empty' ELSE 'mismatch' END AS problem, total_difference FROM invoices WHERE NOT deleted AND (coalesce(n_items, 0) = 0 OR abs(total_amount - calculated_total) > 0.05)"


def amounts(m):
    d = m.invoices.where("not deleted").withColumn("problem", F.when(F.coalesce("n_items", F.lit(0)) == 0, "empty").when(F.abs(c("total_amount") - c("calculated_total")) > 0.05, "mismatch"))
    return d.where("problem is not null").select("invoice_id", "problem", "total_difference")


@query(AMOUNTS)
def audit_amounts(m):
    return amounts(m)


PRICES2 = "p2 AS (SELECT item_id, 0 AS copy, company_id, supplier_id, product_id, invoice_id, invoice_date, price, quantity FROM prices UNION ALL SELECT item_id, 1, company_id, supplier_id, product_id, invoice_id, invoice_date, price, quantity FROM prices WHERE line_no = 2)"
DUP_PRICES = "SELECT item_id, copy FROM (SELECT *, row_number() OVER (PARTITION BY company_id, supplier_id, product_id, invoice_id, invoice_date, price, quantity, item_id ORDER BY copy) AS rn FROM p2) WHERE rn > 1"


def dup_prices(m):
    """Of equal price rows the first stays, the others are listed."""
    p = m.prices.withColumn("copy", F.lit(0)).unionByName(m.prices.where("line_no = 2").withColumn("copy", F.lit(1)))
    w = Window.partitionBy("company_id", "supplier_id", "product_id", "invoice_id", "invoice_date", "price", "quantity", "item_id").orderBy("copy")
    return p.withColumn("rn", F.row_number().over(w)).where("rn > 1").select("item_id", "copy")


@query(DUP_PRICES, PRICES2)
def audit_dup_prices(m):
    return dup_prices(m)


#: Tables with a tenant, and the number by which some rows of each have lost it.
TENANTS = {"invoices": ("base", "invoice_id"), "suppliers": ("suppliers_v", "supplier_id"), "invoice_items": ("items", "invoice_id"), "invoice_discounts": ("discounts", "invoice_id"), "price_history": ("prices", "invoice_id"), "changes": ("feed", "change_id"), "tasks": ("tasks", "task_id"), "entries": ("entries", "invoice_id")}


@query(" UNION ALL ".join(f"SELECT '{t}' AS tbl, COUNT(*) FILTER ({key} % 33 = 0) AS n FROM {view}" for t, (view, key) in TENANTS.items()))
def audit_null_tenant(m):
    """Rows without a tenant, table by table."""
    tables = {"invoices": m.base, "suppliers": m.suppliers, "invoice_items": m.lines, "invoice_discounts": m.discounts, "price_history": m.bare_prices, "changes": m.feed, "tasks": m.tasks, "entries": m.entries}
    out = None
    for tbl, df in tables.items():
        tenant = F.when(c(TENANTS[tbl][1]) % 33 != 0, F.lit("7"))
        d = df.select(tenant.alias("company_id")).agg(F.count_if(F.coalesce("company_id", F.lit("")) == "").alias("n")).select(F.lit(tbl).alias("tbl"), "n")
        out = d if out is None else out.unionByName(d)
    return out


@query("SELECT supplier_id, supplier_id % 4 = 0 AS repeats FROM suppliers_v WHERE supplier_id % 4 = 0 OR company_id IN (SELECT company_id FROM suppliers_v GROUP BY company_id, segment HAVING COUNT(*) > 1) AND segment IN (SELECT s.segment FROM suppliers_v s WHERE s.company_id = suppliers_v.company_id GROUP BY s.segment HAVING COUNT(*) > 1)")
def audit_suspects(m):
    """Suppliers that share their key in a tenant, or whose name says itself twice."""
    name = F.when(c("supplier_id") % 4 == 0, F.concat_ws(" ", "segment", "segment")).otherwise(c("segment"))
    w = F.split(name, " ")
    half = F.floor(F.size(w) / 2).cast("int")
    d = m.suppliers.withColumn("repeats", (F.size(w) % 2 == 0) & (F.slice(w, F.lit(1), half) == F.slice(w, half + 1, half)))
    d = d.withColumn("alike", F.count("*").over(Window.partitionBy("company_id", "segment")))
    return d.where("repeats or alike > 1").select("supplier_id", "repeats")


#: Characters that stand in damaged names, and the longest name.
DAMAGED, LONGEST = "�|鍥|娴|绋|璁|鐨|渚|搴", 140
OCR_ITEMS = """read AS (SELECT item_id, is_free, line_no % 6 = 5 AS is_discount, CASE WHEN line_no = 4 THEN -total ELSE total END AS money, CASE WHEN line_no = 4 THEN -unit_price WHEN product_id % 41 = 0 THEN 0 ELSE unit_price END AS price,
  trim(CASE WHEN product_id % 50 = 0 THEN ' ' WHEN product_id % 90 = 1 THEN repeat(raw_name, 20) WHEN product_id % 30 = 2 THEN raw_name || ' 娴嬭瘯' WHEN product_id % 20 = 3 THEN raw_name || ' DISCOUNT' WHEN product_id % 20 = 5 THEN raw_name || ' 折扣' ELSE raw_name END) AS name FROM items)"""
OCR = f"""concat_ws(',', CASE WHEN name = '' THEN 'empty' END, CASE WHEN regexp_matches(name, '{DAMAGED}') THEN 'damaged' END, CASE WHEN NOT is_discount AND (contains(lower(name), 'discount') OR contains(name, '折扣')) THEN 'unflagged_discount' END,
  CASE WHEN NOT is_discount AND (money < 0 OR price < 0) THEN 'negative' END, CASE WHEN money = 0 AND price = 0 AND NOT is_free AND NOT is_discount THEN 'no_money' END, CASE WHEN length(name) > {LONGEST} THEN 'too_long' END)"""


@query(f"SELECT item_id, {OCR} AS rules FROM read WHERE {OCR} <> ''", OCR_ITEMS)
def audit_ocr_items(m):
    """Lines that a person should look at, and why: by name, by money, by length."""
    k, raw = c("product_id"), c("raw_name")
    name = (
        F.when(k % 50 == 0, " ").when(k % 90 == 1, F.repeat(raw, F.lit(20))).when(k % 30 == 2, F.concat(raw, F.lit(" 娴嬭瘯")))
        .when(k % 20 == 3, F.concat(raw, F.lit(" DISCOUNT"))).when(k % 20 == 5, F.concat(raw, F.lit(" 折扣"))).otherwise(raw)
    )
    money, price = F.when(c("line_no") == 4, -c("total")).otherwise(c("total")), F.when(c("line_no") == 4, -c("unit_price")).when(k % 41 == 0, 0).otherwise(c("unit_price"))
    d = m.items.select("item_id", "is_free", (c("line_no") % 6 == 5).alias("is_discount"), F.trim(name).alias("name"), money.alias("money"), price.alias("price"))
    plain = ~c("is_discount")
    rules = F.concat_ws(
        ",", F.when(c("name") == "", "empty"), F.when(c("name").rlike(DAMAGED), "damaged"), F.when(plain & (F.lower("name").contains("discount") | c("name").contains("折扣")), "unflagged_discount"),
        F.when(plain & ((c("money") < 0) | (c("price") < 0)), "negative"), F.when((c("money") == 0) & (c("price") == 0) & ~c("is_free") & plain, "no_money"), F.when(F.length("name") > LONGEST, "too_long"),
    )
    return d.select("item_id", rules.alias("rules")).where("rules <> ''")


@query(f"SELECT kind, COUNT(*) AS n FROM (SELECT 'duplicate' AS kind FROM ({DUP}) UNION ALL SELECT problem FROM ({AMOUNTS}) UNION ALL SELECT 'orphan price' FROM ({ORPHANS}) UNION ALL SELECT 'pending' FROM base WHERE NOT deleted AND status = 'PENDING_REVIEW') GROUP BY 1")
def audit_review_queue(m):
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"))
    d = tag(dup_invoices(m), "duplicate").union(amounts(m).select(c("problem").alias("kind"))).union(tag(orphans(m), "orphan price")).union(tag(m.base.where("not deleted and status = 'PENDING_REVIEW'"), "pending"))
    return d.groupBy("kind").agg(F.count("*").alias("n"))


@query(f"SELECT (SELECT COUNT(*) FROM ({ORPHANS})) AS orphans, (SELECT COUNT(*) FROM ({DUP_PRICES})) AS dup_prices, (SELECT COUNT(*) FROM p2) AS price_rows, (SELECT COUNT(*) FROM p2) - (SELECT COUNT(*) FROM ({DUP_PRICES})) AS left_after_fix", PRICES2)
def audit_summary(m):
    """What the audit finds, and the price rows that its fix leaves."""
    p = m.prices.select("item_id").union(m.prices.where("line_no = 2").select("item_id"))
    d = orphans(m).agg(F.count("*").alias("orphans")).crossJoin(dup_prices(m).agg(F.count("*").alias("dup_prices"))).crossJoin(p.agg(F.count("*").alias("price_rows")))
    return d.withColumn("left_after_fix", c("price_rows") - c("dup_prices"))


@query("SELECT 'invoice_items' AS tbl, COUNT(*) AS n FROM items i JOIN base b ON b.invoice_id = i.invoice_id WHERE b.deleted UNION ALL SELECT 'discounts', COUNT(*) FROM discounts d JOIN base b ON b.invoice_id = d.invoice_id WHERE b.deleted UNION ALL SELECT 'batches', COUNT(*) FROM (SELECT batch_id FROM base GROUP BY 1 HAVING bool_and(deleted))")
def delete_cascade(m):
    """Deleting invoices deletes their lines and discounts, and batches of which nothing is left."""
    gone = m.base.where("deleted").select("invoice_id")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")
    batches = m.base.where("deleted").select("batch_id").distinct().join(m.base.where("not deleted").select("batch_id"), "batch_id", "left_anti")
    return count(m.items.join(gone, "invoice_id", "left_semi"), "invoice_items").union(count(m.discounts.join(gone, "invoice_id", "left_semi"), "discounts")).union(count(batches, "batches"))


@query("SELECT invoice_id, CASE WHEN invoice_id % 6 = 0 THEN 'CONFIRMED' WHEN invoice_id % 6 = 1 THEN 'merged' ELSE status END AS status, CASE WHEN invoice_id % 6 = 0 AND duplicate_status = 'possible' THEN 'none' ELSE duplicate_status END AS duplicate_status, CASE WHEN invoice_id % 6 = 0 THEN '' ELSE warnings END AS warnings FROM base")
def confirm_decisions(m):
    """Decisions by hand override the state: confirming clears warnings and a possible duplicate."""
    decisions = m.base.where("invoice_id % 6 < 2").select("invoice_id", F.when(c("invoice_id") % 6 == 0, "confirm").otherwise("merge").alias("decision"))
    d = m.base.join(decisions, "invoice_id", "left")
    yes = F.coalesce(c("decision") == "confirm", F.lit(False))
    return d.select(
        "invoice_id", F.when(yes, "CONFIRMED").when(c("decision") == "merge", "merged").otherwise(c("status")).alias("status"),
        F.when(yes & (c("duplicate_status") == "possible"), "none").otherwise(c("duplicate_status")).alias("duplicate_status"), F.when(yes, "").otherwise(c("warnings")).alias("warnings"),
    )


@query("SELECT sync_status, COUNT(*) AS n FROM base WHERE NOT (deleted AND sync_status = 'synced') GROUP BY 1")
def purge_deleted(m):
    """Deleted rows that are synchronised go for good."""
    return m.base.where(~(c("deleted") & (c("sync_status") == "synced"))).groupBy("sync_status").agg(F.count("*").alias("n"))


@query("SELECT supplier_id, min(seq) AS lo, max(seq) AS hi, COUNT(*) AS n, 'INV-' || min(seq) || ' - INV-' || max(seq) AS label FROM (SELECT supplier_id, seq, seq - row_number() OVER (PARTITION BY supplier_id ORDER BY seq) AS g FROM (SELECT DISTINCT supplier_id % 50 AS supplier_id, invoice_id AS seq FROM base)) GROUP BY supplier_id, g HAVING COUNT(*) > 1")
def invoice_runs(m):
    """Runs of consecutive invoice numbers of a supplier; a run starts where the step isn't one."""
    seq = F.regexp_extract("invoice_no", r"(\d+)\D*$", 1).try_cast("bigint")
    d = m.base.select((c("supplier_id") % 50).alias("supplier_id"), seq.alias("seq"), "invoice_no").dropDuplicates(["supplier_id", "seq"])
    w = Window.partitionBy("supplier_id").orderBy("seq")
    d = d.withColumn("new", F.coalesce(c("seq") - F.lag("seq").over(w) != 1, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w))
    return d.groupBy("supplier_id", "run").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count("*").alias("n"), F.concat_ws(" - ", F.min_by("invoice_no", "seq"), F.max_by("invoice_no", "seq")).alias("label")).where("n > 1").drop("run")


@query("SELECT invoice_id, CASE WHEN rn = 1 THEN 'first' WHEN amount = first_amount THEN 'duplicate' ELSE 'conflict' END AS cls FROM (SELECT invoice_id, CAST(total_amount AS DOUBLE) + CASE WHEN copy AND invoice_id % 20 = 0 THEN 1 ELSE 0 END AS amount, row_number() OVER w AS rn, first_value(CAST(total_amount AS DOUBLE)) OVER w AS first_amount FROM entries WINDOW w AS (PARTITION BY company_id, invoice_no ORDER BY invoice_id))")
def batch_duplicates(m):
    """Each entry against those before it with the same number."""
    e = m.entries.withColumn("amount", c("total_amount").cast("double") + F.when(c("copy") & (c("invoice_id") % 20 == 0), 1).otherwise(0))
    w = Window.partitionBy("company_id", "invoice_no").orderBy("invoice_id")
    e = e.withColumn("rn", F.row_number().over(w)).withColumn("first_amount", F.first(c("total_amount").cast("double")).over(w))
    return e.select("invoice_id", F.when(c("rn") == 1, "first").when(c("amount") == c("first_amount"), "duplicate").otherwise("conflict").alias("cls"))


@query("SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1 THEN 'stored' ELSE 'skipped_duplicate' END AS state FROM documents")
def file_dedup(m):
    """The first file with a hash is stored; later ones are skipped."""
    w = Window.partitionBy("h").orderBy("doc_id")
    d = m.table("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.select("doc_id", F.when(F.row_number().over(w) == 1, "stored").otherwise("skipped_duplicate").alias("state"))


@query("SELECT invoice_id, CAST(unnest(generate_series(CAST(first AS BIGINT) + 1, CAST(first AS BIGINT) + pages)) AS BIGINT) AS file_no FROM (SELECT invoice_id, pages, coalesce(SUM(pages) OVER (PARTITION BY supplier_id, left(batch_id, 8) ORDER BY invoice_date, invoice_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM (SELECT *, greatest(1, invoice_id % 4) AS pages FROM base))")
def archive_sequence(m):
    """Numbers of an invoice's files within supplier and month: after all pages of earlier invoices."""
    w = Window.partitionBy("supplier_id", F.left("batch_id", F.lit(8))).orderBy("invoice_date", "invoice_id").rowsBetween(Window.unboundedPreceding, -1)
    d = m.base.withColumn("pages", F.greatest(F.lit(1).cast("bigint"), c("invoice_id") % 4)).withColumn("first", F.coalesce(F.sum("pages").over(w), F.lit(0)))
    return d.select("invoice_id", F.explode(F.sequence(c("first") + 1, c("first") + c("pages"))).alias("file_no"))


LATEST = "SELECT id, change_id, value, deleted FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, change_id DESC) AS rn FROM feed) WHERE rn = 1"


@query(LATEST)
def lww_state(m):
    return latest_per_key(m.feed, ["id"], [c("updated_at").desc(), c("change_id").desc()]).select("id", "change_id", "value", "deleted")


MERGE = """l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, change_id DESC) AS rn FROM feed WHERE event_type IN ('view', 'click')) WHERE rn = 1),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, change_id DESC) AS rn FROM feed WHERE event_type NOT IN ('view', 'click')) WHERE rn = 1)"""


@query("""SELECT coalesce(l.id, r.id) AS id, CASE WHEN l.id IS NULL THEN 'insert' WHEN r.id IS NULL THEN 'keep' WHEN l.id % 3 <> 0 THEN 'replace' WHEN l.updated_at > r.updated_at THEN 'skip' WHEN l.id % 2 = 0 THEN 'conflict' ELSE 'replace' END AS action,
  CASE WHEN r.id IS NULL OR (l.id IS NOT NULL AND l.id % 3 = 0 AND l.updated_at > r.updated_at) THEN l.value ELSE r.value END AS value FROM l FULL JOIN r ON l.id = r.id""", MERGE)
def merge_remote(m):
    """Local rows with unsent changes: newer ones win, older ones are a conflict on invoices (even ids) and else replaced."""
    order = [c("updated_at").desc(), c("change_id").desc()]
    local = latest_per_key(m.feed.where("event_type in ('view', 'click')"), ["id"], order).select("id", c("updated_at").alias("lt"), c("value").alias("lv"), F.lit(True).alias("l"))
    remote = latest_per_key(m.feed.where("event_type not in ('view', 'click')"), ["id"], order).select("id", c("updated_at").alias("rt"), c("value").alias("rv"), F.lit(True).alias("r"))
    d = local.join(remote, "id", "full_outer")
    unsent = c("id") % 3 == 0
    newer = c("lt") > c("rt")
    action = F.when(c("l").isNull(), "insert").when(c("r").isNull(), "keep").when(~unsent, "replace").when(newer, "skip").when(c("id") % 2 == 0, "conflict").otherwise("replace")
    return d.select("id", action.alias("action"), F.when(c("r").isNull() | (c("l").isNotNull() & unsent & newer), c("lv")).otherwise(c("rv")).alias("value"))


@query("SELECT event_type, COUNT(*) AS n, COUNT(*) FILTER (deleted) AS failed, COUNT(DISTINCT device_id) AS devices FROM feed GROUP BY 1")
def sync_counts(m):
    return m.feed.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("deleted").alias("failed"), F.countDistinct("device_id").alias("devices"))


@query("SELECT b.invoice_id, CASE WHEN b.invoice_id % 4 = 0 THEN 'failed' WHEN b.invoice_id % 4 = 1 THEN 'conflict' ELSE 'synced' END AS state FROM base b WHERE sync_status = 'pending'")
def sync_results(m):
    """Rows pushed against their results; rows without one have failed."""
    sent = m.base.where("sync_status = 'pending'").select("invoice_id")
    results = sent.where("invoice_id % 4 <> 0").select("invoice_id", F.when(c("invoice_id") % 4 == 1, "conflict").otherwise("synced").alias("state"))
    return sent.join(results, "invoice_id", "left").fillna("failed", ["state"])


@query("SELECT status, COUNT(*) AS n FROM base WHERE sync_status IN ('pending', 'failed') OR deleted GROUP BY 1")
def sync_pending(m):
    return m.base.where("sync_status in ('pending', 'failed') or deleted").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT sync_status AS before, CASE WHEN sync_status = 'failed' THEN 'pending' WHEN sync_status = 'pending' AND invoice_id % 2 = 0 THEN 'synced' ELSE sync_status END AS after, COUNT(*) AS n FROM base GROUP BY 1, 2")
def sync_repair(m):
    """Failed rows are tried again; pending rows that the server has are synchronised."""
    after = F.when(c("sync_status") == "failed", "pending").when((c("sync_status") == "pending") & (c("invoice_id") % 2 == 0), "synced").otherwise(c("sync_status"))
    return m.base.groupBy(c("sync_status").alias("before"), after.alias("after")).agg(F.count("*").alias("n"))


@query("SELECT invoice_id, field, before, after FROM (SELECT invoice_id, unnest(['status', 'warnings']) AS field, unnest([status, warnings]) AS before, unnest([CASE WHEN invoice_id % 3 = 0 THEN 'CONFIRMED' ELSE status END, '']) AS after FROM base) WHERE before <> after")
def corrections(m):
    """Fields that a correction changed, with the value before and after."""
    before = m.base.select("invoice_id", F.create_map(F.lit("status"), "status", F.lit("warnings"), "warnings").alias("b"))
    after = m.base.select("invoice_id", F.create_map(F.lit("status"), F.when(c("invoice_id") % 3 == 0, "CONFIRMED").otherwise(c("status")), F.lit("warnings"), F.lit("")).alias("a"))
    d = before.join(after, "invoice_id").select("invoice_id", "b", F.explode("a").alias("field", "after"))
    return d.select("invoice_id", "field", F.try_element_at("b", c("field")).alias("before"), "after").where("before <> after")


