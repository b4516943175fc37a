"""Prices and costs: gifts, discounts, learning, anomalies, timelines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.operators import costing
from tallyforge.operators.state import differences
from tallyforge.plans.records import shared_folder
from tallyforge.plans.registry import query

c = F.col
#: The share of the earlier mean by which a price is an anomaly.
ANOMALY = 0.30

GIFTS = """, gifts AS (SELECT *, CASE WHEN charged_qty > 0 THEN paid / charged_qty ELSE 0 END AS original_cost, CASE WHEN charged_qty + free_qty > 0 THEN paid / (charged_qty + free_qty) ELSE 0 END AS effective_cost FROM (
  SELECT item_id, invoice_id, promo_group, line_no, raw_name, CAST(SUM(CASE WHEN NOT is_free THEN quantity ELSE 0 END) OVER w AS DOUBLE) AS charged_qty, CAST(SUM(CASE WHEN is_free THEN quantity ELSE 0 END) OVER w AS DOUBLE) AS free_qty,
    CAST(SUM(total) OVER w AS DOUBLE) AS paid FROM items WINDOW w AS (PARTITION BY invoice_id, promo_group)))"""
GIFTS = GIFTS[2:]


@query("SELECT item_id, charged_qty, free_qty, original_cost, effective_cost FROM gifts", GIFTS)
def gift_allocation(m):
    return costing.gift_allocation(m.items).select("item_id", "charged_qty", "free_qty", "original_cost", "effective_cost")


@query("SELECT invoice_id, COUNT(*) AS n_groups, SUM(CAST(charged_qty AS DECIMAL(18,2)))::DOUBLE AS charged, SUM(CAST(free_qty AS DECIMAL(18,2)))::DOUBLE AS free FROM (SELECT DISTINCT invoice_id, promo_group, charged_qty, free_qty FROM gifts) GROUP BY 1", GIFTS)
def gift_summary(m):
    """One line stands for each promotion group, so its totals count once."""
    d = costing.gift_allocation(m.items)
    w = Window.partitionBy("invoice_id", "promo_group").orderBy("line_no", "item_id")
    d = d.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return d.groupBy("invoice_id").agg(F.count("*").alias("n_groups"), F.sum(c("charged_qty").cast("decimal(18,2)")).cast("double").alias("charged"), F.sum(c("free_qty").cast("decimal(18,2)")).cast("double").alias("free"))


@query("SELECT invoice_id, promo_group, string_agg(DISTINCT raw_name, '|' ORDER BY raw_name) AS products, max(free_qty) AS free FROM gifts GROUP BY 1, 2 HAVING max(free_qty) > 0 OR COUNT(DISTINCT raw_name) > 1", GIFTS)
def gift_rules(m):
    d = m.items.groupBy("invoice_id", "promo_group").agg(F.array_sort(F.collect_set("raw_name")).alias("names"), F.sum(F.when(c("is_free"), c("quantity")).otherwise(0)).cast("double").alias("free"))
    return d.where((c("free") > 0) | (F.size("names") > 1)).select("invoice_id", "promo_group", F.array_join("names", "|").alias("products"), "free")


MATCHES = "matches AS (SELECT i.*, d.amount FROM items i JOIN discounts d ON d.invoice_id = i.invoice_id AND contains(lower(i.raw_name), lower(split_part(d.discount_name, ' ', 1))))"


@query("SELECT i.item_id, coalesce(x.discount, 0) AS discount, (CAST(i.total AS DOUBLE) + coalesce(x.discount, 0)) / CAST(i.quantity AS DOUBLE) AS unit_cost FROM items i LEFT JOIN (SELECT item_id, CAST(SUM(amount) AS DOUBLE) AS discount FROM matches GROUP BY 1) x ON x.item_id = i.item_id", MATCHES)
def discount_allocation(m):
    return costing.discount_allocation(m.items, m.discounts).select("item_id", "discount", "unit_cost")


@query("SELECT d.invoice_id, CASE WHEN x.n = 1 THEN 'item_level' WHEN x.n > 1 THEN 'brand_level' ELSE 'invoice_level' END AS discount_type, coalesce(x.ids, '') AS ids FROM discounts d LEFT JOIN (SELECT invoice_id, COUNT(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM matches GROUP BY 1) x ON x.invoice_id = d.invoice_id", MATCHES)
def discount_types(m):
    """One matching line: item level; several: brand level; none: invoice level."""
    x = costing.discount_matches(m.items, m.discounts).groupBy("invoice_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("ids"))
    return m.discounts.select("invoice_id").join(x, "invoice_id", "left").select("invoice_id", F.when(c("n") == 1, "item_level").when(c("n") > 1, "brand_level").otherwise("invoice_level").alias("discount_type"), F.coalesce("ids", F.lit("")).alias("ids"))


INTEGRITY = """checked AS (SELECT *, CAST(total_amount - subtotal - discount AS DOUBLE) AS difference FROM (SELECT i.invoice_id, i.total_amount, i.duplicate_status, i.status, i.deleted, coalesce(x.subtotal, 0) AS subtotal, coalesce(d.amount, 0) AS discount, coalesce(x.n_valid, 0) AS n_valid
  FROM invoices i LEFT JOIN (SELECT invoice_id, SUM(total) AS subtotal, COUNT(*) FILTER (NOT is_free AND NOT candidate_only) AS n_valid FROM items GROUP BY 1) x ON x.invoice_id = i.invoice_id LEFT JOIN discounts d ON d.invoice_id = i.invoice_id))"""
WARN = "concat_ws(',', CASE WHEN n_valid = 0 THEN 'EMPTY_ITEMS' END, CASE WHEN abs(difference) > 0.05 THEN 'AMOUNT_MISMATCH' END, CASE WHEN duplicate_status = 'possible' THEN 'POSSIBLE_MULTI_PAGE_OR_DUPLICATE' END)"


@query(f"SELECT invoice_id, CAST(subtotal + discount AS DOUBLE) AS expected, difference, {WARN} AS warnings, {WARN} <> '' AS needs_review FROM checked", INTEGRITY)
def invoice_integrity(m):
    return costing.integrity(m.invoices.drop("warnings"), m.items, m.discounts).select("invoice_id", "expected", "difference", "warnings", "needs_review")


@query(f"SELECT status, {WARN} <> '' AS review, COUNT(*) AS n, CASE WHEN {WARN} <> '' THEN 'PENDING_REVIEW' ELSE 'APPROVED' END AS saved_as FROM checked WHERE NOT deleted GROUP BY ALL", INTEGRITY)
def invoice_save_status(m):
    """Invoices saved through the integrity check: what gives no warning is approved."""
    d = costing.integrity(m.invoices.where("not deleted").drop("warnings"), m.items, m.discounts)
    saved = F.when(c("needs_review"), "PENDING_REVIEW").otherwise("APPROVED")
    return d.groupBy("status", c("needs_review").alias("review"), saved.alias("saved_as")).agg(F.count("*").alias("n"))


@query("SELECT product_id, supplier_id, min(price) AS low, max(price) AS top, CAST(SUM(CAST(floor(price * 10000) AS BIGINT)) AS DOUBLE) / COUNT(*) / 10000 AS mean, COUNT(*) AS n, least(0.99, 0.82 + 0.02 * COUNT(*))::DOUBLE AS confidence FROM prices WHERE company_id <> '' GROUP BY 1, 2")
def alias_learning(m):
    return learned(m.bare_prices, ["product_id", "supplier_id"], 0.82, 0.02, 0.99)


@query("SELECT company_id, product_name, supplier_id, min(price) AS low, max(price) AS top, CAST(SUM(CAST(floor(price * 10000) AS BIGINT)) AS DOUBLE) / COUNT(*) / 10000 AS mean, COUNT(*) AS n, least(1.0, 0.75 + 0.03 * COUNT(*))::DOUBLE AS confidence FROM prices GROUP BY 1, 2, 3")
def rule_learning(m):
    return learned(m.prices, ["company_id", "product_name", "supplier_id"], 0.75, 0.03, 1.0)


def learned(prices, keys, start, step, most):
    """Price statistics per key; the confidence rises with every record, up to a limit."""
    mean = F.sum(F.floor(c("price") * 10000)).cast("double") / F.count("*") / 10000  # in whole ten-thousandths, so any order of adding gives the same
    d = prices.groupBy(*keys).agg(F.min("price").alias("low"), F.max("price").alias("top"), mean.alias("mean"), F.count("*").alias("n"))
    dec = lambda x: F.lit(str(x)).cast("decimal(4,2)")
    return d.withColumn("confidence", F.least(dec(most), dec(start) + dec(step) * c("n").cast("decimal(18,0)")).cast("double"))


ANOMALIES = """SELECT item_id, price, prior, (price - prior) / prior AS deviation FROM (SELECT item_id, price, CAST(SUM(CAST(floor(price * 10000) AS BIGINT)) OVER w AS DOUBLE) / COUNT(*) OVER w / 10000 AS prior FROM prices
  WINDOW w AS (PARTITION BY company_id, supplier_id, product_id ORDER BY invoice_date, invoice_id, line_no, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE prior > 0 AND abs(price - prior) / prior > 0.30"""


@query(ANOMALIES)
def price_anomalies(m):
    """Each price against the mean of strictly earlier ones of its supplier and product."""
    w = Window.partitionBy("company_id", "supplier_id", "product_id").orderBy("invoice_date", "invoice_id", "line_no", "item_id").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.sum(F.floor(c("price") * 10000)).over(w).cast("double") / F.nullif(F.count("*").over(w), F.lit(0)) / 10000
    d = m.bare_prices.withColumn("prior", prior).where((c("prior") > 0) & (F.abs(c("price") - c("prior")) / c("prior") > ANOMALY))
    return d.select("item_id", "price", "prior", ((c("price") - c("prior")) / c("prior")).alias("deviation"))


@query("SELECT supplier_id, product_id, arg_max(price, {'d': invoice_date, 'i': invoice_id, 'k': item_id}) AS price, max(invoice_date) AS latest FROM prices GROUP BY 1, 2")
def latest_price(m):
    return m.bare_prices.groupBy("supplier_id", "product_id").agg(F.max_by("price", F.struct("invoice_date", "invoice_id", "item_id")).alias("price"), F.max("invoice_date").alias("latest"))


@query("""SELECT key, price, origin FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY price > 0 DESC, origin DESC) AS rn FROM (
  SELECT item_id AS key, unit_price AS price, 1 AS origin FROM items WHERE NOT candidate_only UNION ALL SELECT item_id, price * 1.5, 2 FROM prices WHERE line_no <= 3)) WHERE rn = 1""")
def price_timeline(m):
    """Item rows and history rows, one per key; a later source replaces an earlier one if it has a price."""
    i = m.items.where("not candidate_only").select(c("item_id").alias("key"), c("unit_price").alias("price"), F.lit(1).alias("origin"))
    h = m.prices.where("line_no <= 3").select(c("item_id").alias("key"), (c("price") * 1.5).alias("price"), F.lit(2).alias("origin"))
    w = Window.partitionBy("key").orderBy((c("price") > 0).desc(), c("origin").desc())
    return i.unionByName(h).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


@query("SELECT p.item_id, CASE WHEN p.line_no % 2 = 0 THEN p.product_name WHEN p.line_no % 3 = 0 THEN '' ELSE x.name END AS product_name FROM prices p LEFT JOIN (SELECT product_id, min(raw_name) AS name FROM items GROUP BY 1) x ON x.product_id = p.product_id AND p.line_no % 3 <> 0")
def backfill_price_names(m):
    """Blank names of the history are filled from the item, then the product."""
    blank = m.prices.select("item_id", "line_no", "product_id", F.when(c("line_no") % 2 == 0, c("product_name")).otherwise("").alias("product_name"))
    names = m.items.groupBy("product_id").agg(F.min("raw_name").alias("name"))
    d = blank.join(names, "product_id", "left")
    known = F.when(c("line_no") % 3 != 0, c("name"))
    return d.select("item_id", F.coalesce(F.nullif("product_name", F.lit("")), known, F.lit("")).alias("product_name"))


@query("SELECT item_id, price, 'price-' || item_id AS price_id FROM prices")
def price_history_rebuild(m):
    """Price rows of the approved invoices, made anew from their lines; what was stored for them goes."""
    ok = m.base.where("status = 'APPROVED' and not deleted").select("invoice_id")
    return generated_prices(m.items.where("not is_free and not candidate_only").join(ok, "invoice_id", "left_semi"))


@query("SELECT item_id, unit_price AS price, 'price-' || item_id AS price_id FROM items WHERE NOT is_free AND NOT candidate_only AND quantity > 0 AND unit_price > 0")
def price_history_generate(m):
    """As above for every line, approved or not."""
    return generated_prices(m.items.where("not is_free and not candidate_only"))


def generated_prices(items):
    return items.where("quantity > 0 and unit_price > 0").select("item_id", c("unit_price").alias("price"), F.concat(F.lit("price-"), "item_id").alias("price_id"))


STORED = """eligible AS (SELECT i.item_id, i.unit_price, i.quantity FROM items i JOIN base b ON b.invoice_id = i.invoice_id WHERE b.status = 'APPROVED' AND NOT b.deleted AND NOT i.is_free AND NOT i.candidate_only AND i.quantity > 0 AND i.unit_price > 0),
fresh AS (SELECT DISTINCT ON (item_id) 'price-' || item_id AS price_id, unit_price AS price, quantity FROM eligible ORDER BY item_id, unit_price, quantity),
old AS (SELECT DISTINCT ON (item_id) i.item_id, 'price-' || i.item_id AS price_id, CASE WHEN i.line_no % 4 = 0 THEN i.unit_price * 2 ELSE i.unit_price END AS price, i.quantity + CASE WHEN i.line_no % 7 = 3 THEN 1 ELSE 0 END AS quantity FROM items i WHERE i.line_no % 5 <> 0 AND NOT i.is_free ORDER BY i.item_id, i.unit_price, i.quantity)"""


@query(
    """SELECT coalesce(f.price_id, o.price_id) AS price_id, CASE WHEN o.price_id IS NULL THEN 'insert' WHEN f.price_id IS NULL THEN 'delete' ELSE 'update' END AS kind, o.price AS old_price, f.price AS new_price,
  CAST(o.quantity AS DOUBLE) AS old_quantity, CAST(f.quantity AS DOUBLE) AS new_quantity FROM fresh f FULL JOIN old o ON o.price_id = f.price_id WHERE o.price_id IS NULL OR f.price_id IS NULL OR o.price <> f.price OR o.quantity <> f.quantity""",
    STORED,
)
def price_history_changes(m):
    """The rebuild of the stored price history: what is generated anew against what is stored, as inserted, changed and deleted rows."""
    one = lambda df: df.groupBy("price_id").agg(F.min(F.struct("price", "quantity")).alias("r")).select("price_id", "r.*")
    ok = m.base.where("status = 'APPROVED' and not deleted").select("invoice_id")
    lines = m.items.where("not is_free and not candidate_only and quantity > 0 and unit_price > 0").join(ok, "invoice_id", "left_semi")
    price_id = F.concat(F.lit("price-"), "item_id").alias("price_id")
    fresh = one(lines.select(price_id, c("unit_price").alias("price"), c("quantity").cast("double").alias("quantity")))
    price = F.when(c("line_no") % 4 == 0, c("unit_price") * 2).otherwise(c("unit_price")).alias("price")
    quantity = (c("quantity") + F.when(c("line_no") % 7 == 3, 1).otherwise(0)).cast("double").alias("quantity")
    folder = shared_folder(m.spark)
    one(m.lines.where("line_no % 5 <> 0 and not is_free").select(price_id, price, quantity)).write.parquet(folder)  # the stored table
    d = differences(m.spark.read.parquet(folder), fresh, "price_id", ["price", "quantity"])
    return d.select("price_id", "kind", "old_price", "new_price", "old_quantity", "new_quantity")
