"""Reports: dashboard, rankings, supplier and product views, archive, batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.operators import predicates as P
from tallyforge.plans.registry import query

c = F.col
#: Parameter: the month of the dashboard.
MONTH = "1998-06"


def money(col):
    return F.sum(col).cast("double")


@query("SELECT i.company_id, i.invoice_id, i.invoice_no, s.display_name AS supplier, i.invoice_date FROM base i LEFT JOIN suppliers_v s ON s.company_id = i.company_id AND s.supplier_id = i.supplier_id WHERE NOT i.deleted")
def invoice_list(m):
    s = m.suppliers.select("company_id", "supplier_id", c("display_name").alias("supplier"))
    return m.base.where("not deleted").join(s, ["company_id", "supplier_id"], "left").select("company_id", "invoice_id", "invoice_no", "supplier", "invoice_date")


@query("SELECT company_id, COUNT(*) AS n, COUNT(DISTINCT invoice_id) AS invoices FROM (SELECT i.invoice_id, b.company_id FROM items i JOIN base b ON b.invoice_id = i.invoice_id WHERE b.status = 'APPROVED' AND NOT b.deleted) GROUP BY company_id")
def items_of_approved(m):
    ok = m.base.where(P.approved(c("status")) & ~c("deleted")).select("invoice_id", "company_id")
    return m.items.select("invoice_id").join(ok, "invoice_id").groupBy("company_id").agg(F.count("*").alias("n"), F.countDistinct("invoice_id").alias("invoices"))


DASH = f"""SELECT company_id, CAST(SUM(total_amount) AS DOUBLE) AS total, CAST(coalesce(SUM(total_amount) FILTER (ok), 0) AS DOUBLE) AS confirmed, CAST(coalesce(SUM(total_amount) FILTER (pen), 0) AS DOUBLE) AS pending,
  CAST(coalesce(SUM(total_amount) FILTER (abn), 0) AS DOUBLE) AS abnormal, CAST(coalesce(SUM(total_amount) FILTER (ok AND strftime(invoice_date, '%Y-%m') = '{MONTH}'), 0) AS DOUBLE) AS month_confirmed,
  COUNT(*) FILTER (duplicate_status = 'duplicate') AS duplicates, COUNT(*) FILTER (sync_status = 'conflict') AS conflicts, COUNT(DISTINCT supplier_id) AS suppliers FROM (
  SELECT *, status = 'APPROVED' AS ok, status <> 'APPROVED' AND (status = 'PENDING_REVIEW' OR duplicate_status = 'possible') AS pen, status <> 'APPROVED' AND (total_difference > 0.05 OR warnings <> '') AS abn FROM invoices WHERE NOT deleted) GROUP BY company_id"""


@query(DASH)
def dashboard(m):
    ok, pen, abn = P.approved(c("status")), P.pending(c("status"), c("duplicate_status")), P.abnormal(c("status"), c("total_difference"), c("warnings"))
    part = lambda cond, name: F.coalesce(F.sum(F.when(cond, c("total_amount"))), F.lit(0)).cast("double").alias(name)
    return m.invoices.where("not deleted").groupBy("company_id").agg(
        money("total_amount").alias("total"), part(ok, "confirmed"), part(pen, "pending"), part(abn, "abnormal"),
        part(ok & (F.date_format("invoice_date", "yyyy-MM") == MONTH), "month_confirmed"),
        F.count_if(P.duplicate(c("duplicate_status"))).alias("duplicates"), F.count_if(c("sync_status") == "conflict").alias("conflicts"), F.countDistinct("supplier_id").alias("suppliers"),
    )


@query("SELECT company_id, supplier_id, CAST(SUM(total_amount) AS DOUBLE) AS amount, COUNT(*) AS n, CAST(SUM(total_amount) AS DOUBLE) / COUNT(*) AS avg_order FROM invoices WHERE status = 'APPROVED' AND NOT deleted GROUP BY 1, 2")
def supplier_ranking(m):
    d = m.invoices.where(P.approved(c("status")) & ~c("deleted")).groupBy("company_id", "supplier_id")
    return d.agg(money("total_amount").alias("amount"), F.count("*").alias("n")).withColumn("avg_order", c("amount") / c("n"))


@query("SELECT product_id, min(product_name) AS name, CAST(SUM(quantity) AS DOUBLE) AS quantity, CAST(SUM(total) AS DOUBLE) AS amount FROM prices GROUP BY 1")
def product_ranking(m):
    return m.prices.groupBy("product_id").agg(F.min("product_name").alias("name"), money("quantity").alias("quantity"), money("total").alias("amount"))


@query("""SELECT month, CAST(SUM(amount) AS DOUBLE) AS amount, CAST(SUM(quantity) AS DOUBLE) AS quantity FROM (
  SELECT strftime(invoice_date, '%Y-%m') AS month, total_amount AS amount, CAST(0 AS DECIMAL(18,2)) AS quantity FROM invoices WHERE status = 'APPROVED' AND NOT deleted
  UNION ALL SELECT strftime(invoice_date, '%Y-%m'), 0, quantity FROM items i JOIN base b ON b.invoice_id = i.invoice_id WHERE b.status = 'APPROVED' AND NOT b.deleted) GROUP BY 1""")
def monthly_spend(m):
    ok = P.approved(c("status")) & ~c("deleted")
    spend = m.invoices.where(ok).groupBy(F.date_format("invoice_date", "yyyy-MM").alias("month")).agg(F.sum("total_amount").alias("amount"))
    qty = m.items.join(m.base.where(ok).select("invoice_id", "invoice_date"), "invoice_id").groupBy(F.date_format("invoice_date", "yyyy-MM").alias("month")).agg(F.sum("quantity").alias("quantity"))
    d = spend.unionByName(qty, allowMissingColumns=True).groupBy("month")
    return d.agg(F.coalesce(money("amount"), F.lit(0.0)).alias("amount"), F.coalesce(money("quantity"), F.lit(0.0)).alias("quantity"))


@query("SELECT product_id, price, supplier_id, invoice_no, invoice_date FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, invoice_date, item_id) AS rn FROM prices WHERE price > 0) WHERE rn = 1")
def lowest_prices(m):
    best = F.min_by(F.struct("price", "supplier_id", "invoice_no", "invoice_date"), F.struct("price", "invoice_date", "item_id"))
    return m.bare_prices.where("price > 0").groupBy("product_id").agg(best.alias("b")).select("product_id", "b.*")


@query("""SELECT product_id, COUNT(*) AS records, COUNT(*) FILTER (price > 2000) AS high, min(price) AS low, max(price) AS top, CAST(SUM(total) AS DOUBLE) / CAST(SUM(quantity) AS DOUBLE) AS mean,
  arg_max(price, {'d': invoice_date, 'i': item_id}) AS latest, arg_max(supplier_id, {'d': invoice_date, 'i': item_id}) AS supplier, arg_max(invoice_no, {'d': invoice_date, 'i': item_id}) AS invoice FROM prices GROUP BY 1
  UNION ALL SELECT p_partkey, 0, 0, NULL, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey NOT IN (SELECT product_id FROM prices)""")
def price_summary(m):
    """Prices by product with the latest record; products without any are added."""
    k = F.struct("invoice_date", "item_id")
    d = m.bare_prices.groupBy("product_id").agg(
        F.count("*").alias("records"), F.count_if(c("price") > 2000).alias("high"), F.min("price").alias("low"), F.max("price").alias("top"),
        (money("total") / money("quantity")).alias("mean"), F.max_by(F.struct(c("price").alias("latest"), c("supplier_id").alias("supplier"), c("invoice_no").alias("invoice")), k).alias("l"),
    )
    d = d.select("product_id", "records", "high", "low", "top", "mean", "l.*")
    rest = m.table("part").select(c("p_partkey").alias("product_id")).join(d, "product_id", "left_anti").selectExpr("product_id", "0L as records", "0L as high")
    return d.unionByName(rest, allowMissingColumns=True)


CENTER = """SELECT s.supplier_id, coalesce(i.n, 0) AS invoices, CAST(coalesce(i.amount, 0) AS DOUBLE) AS spend, i.latest, coalesce(t.products, 0) AS products, CAST(coalesce(t.free_qty, 0) AS DOUBLE) AS free_qty, CAST(coalesce(d.discount, 0) AS DOUBLE) AS discount
  FROM suppliers_v s LEFT JOIN (SELECT supplier_id, COUNT(*) AS n, SUM(total_amount) AS amount, max(invoice_date) AS latest FROM invoices WHERE NOT deleted GROUP BY 1) i ON i.supplier_id = s.supplier_id
  LEFT JOIN (SELECT b.supplier_id, COUNT(DISTINCT product_id) AS products, SUM(CASE WHEN is_free THEN quantity ELSE 0 END) AS free_qty FROM items x JOIN base b ON b.invoice_id = x.invoice_id WHERE NOT b.deleted GROUP BY 1) t ON t.supplier_id = s.supplier_id
  LEFT JOIN (SELECT b.supplier_id, SUM(amount) AS discount FROM discounts x JOIN base b ON b.invoice_id = x.invoice_id WHERE NOT b.deleted GROUP BY 1) d ON d.supplier_id = s.supplier_id WHERE NOT s.deleted"""


def center(m):
    """Spend, products and discounts by supplier, each aggregated on its own before the joins, so none multiplies another."""
    live = m.base.where("not deleted").select("invoice_id", c("supplier_id").alias("sid"))
    i = m.invoices.where("not deleted").groupBy("supplier_id").agg(F.count("*").alias("invoices"), money("total_amount").alias("spend"), F.max("invoice_date").alias("latest"))
    t = m.items.join(live, "invoice_id").groupBy(c("sid").alias("supplier_id")).agg(F.countDistinct("product_id").alias("products"), money(F.when(c("is_free"), c("quantity")).otherwise(0)).alias("free_qty"))
    d = m.discounts.join(live, "invoice_id").groupBy(c("sid").alias("supplier_id")).agg(money("amount").alias("discount"))
    out = m.suppliers.where("not deleted").select("supplier_id").join(i, "supplier_id", "left").join(t, "supplier_id", "left").join(d, "supplier_id", "left")
    return out.fillna(0, ["invoices", "spend", "products", "free_qty", "discount"])


@query(CENTER)
def supplier_center(m):
    return center(m)


@query(f"SELECT supplier_id, invoices, spend, CASE WHEN invoices > 0 THEN spend / invoices ELSE 0 END AS avg_order FROM ({CENTER})")
def supplier_detail(m):
    return center(m).select("supplier_id", "invoices", "spend", F.coalesce(F.try_divide("spend", "invoices"), F.lit(0.0)).alias("avg_order"))


PRODUCTS = "SELECT supplier_id, product_id, COUNT(*) AS purchases, CAST(SUM(quantity) AS DOUBLE) AS quantity, min(price) AS low, max(price) AS top, arg_max(price, {'d': invoice_date, 'i': item_id}) AS latest FROM prices GROUP BY 1, 2"


@query(f"SELECT *, CAST(row_number() OVER (PARTITION BY supplier_id ORDER BY purchases DESC, product_id) AS INTEGER) AS place FROM ({PRODUCTS})")
def supplier_products(m):
    d = m.prices.groupBy("supplier_id", "product_id").agg(
        F.count("*").alias("purchases"), money("quantity").alias("quantity"), F.min("price").alias("low"), F.max("price").alias("top"), F.max_by("price", F.struct("invoice_date", "item_id")).alias("latest")
    )
    w = Window.partitionBy("supplier_id").orderBy(sorted_by("count"), "product_id")
    return d.withColumn("place", F.row_number().over(w))


#: Orders of a supplier's products.
SORTS = {"minPrice": ("low", False), "maxPrice": ("top", True), "recent": ("latest", True), "count": ("purchases", True), "quantity": ("quantity", True)}


def sorted_by(name: str):
    column, down = SORTS[name]
    return c(column).desc() if down else c(column)


@query(f"SELECT product_id, supplier_id, latest, low, purchases, CAST(row_number() OVER (PARTITION BY product_id ORDER BY latest, supplier_id) AS INTEGER) AS place FROM ({PRODUCTS})")
def supplier_compare(m):
    """The suppliers of a product by their latest price, cheapest first."""
    d = m.prices.groupBy("product_id", "supplier_id").agg(F.max_by("price", F.struct("invoice_date", "item_id")).alias("latest"), F.min("price").alias("low"), F.count("*").alias("purchases"))
    return d.withColumn("place", F.row_number().over(Window.partitionBy("product_id").orderBy("latest", "supplier_id")))


@query("""SELECT i.item_id, b.invoice_no, s.display_name AS supplier, i.unit_price FROM items i JOIN base b ON b.invoice_id = i.invoice_id LEFT JOIN suppliers_v s ON s.supplier_id = b.supplier_id
  LEFT JOIN (SELECT DISTINCT product_id FROM items WHERE brand = 'Brand#5' AND line_no = 1) h ON h.product_id = i.product_id
  WHERE NOT b.deleted AND (contains(lower(i.raw_name), 'red') OR i.product_id = 42 OR h.product_id IS NOT NULL)""")
def product_detail(m):
    """Lines whose name contains the query, whose product it is, or whose product an alias names."""
    hits = m.items.where("brand = 'Brand#5' and line_no = 1").select("product_id", F.lit(True).alias("hit")).distinct()
    b = m.base.where("not deleted").select("invoice_id", "invoice_no", c("supplier_id").alias("sid"))
    s = m.suppliers.select(c("supplier_id").alias("sid"), c("display_name").alias("supplier"))
    d = m.items.join(hits, "product_id", "left").where(F.lower("raw_name").contains("red") | (c("product_id") == 42) | c("hit"))
    return d.join(b, "invoice_id").join(s, "sid", "left").select("item_id", "invoice_no", "supplier", "unit_price")


@query("SELECT company_id, supplier_id, month, CASE WHEN GROUPING(month) = 1 THEN 1 ELSE 0 END + CASE WHEN GROUPING(supplier_id) = 1 THEN 1 ELSE 0 END AS level, COUNT(*) AS n FROM (SELECT company_id, supplier_id, strftime(invoice_date, '%Y-%m') AS month FROM base WHERE NOT deleted) GROUP BY GROUPING SETS ((company_id), (company_id, supplier_id), (company_id, supplier_id, month))")
def archive_tree(m):
    """Counts by company, supplier and month."""
    d = m.base.where("not deleted").select("company_id", "supplier_id", F.date_format("invoice_date", "yyyy-MM").alias("month"))
    d = d.groupingSets([["company_id"], ["company_id", "supplier_id"], ["company_id", "supplier_id", "month"]], "company_id", "supplier_id", "month")
    return d.agg((F.grouping("month") + F.grouping("supplier_id")).cast("int").alias("level"), F.count("*").alias("n"))


@query("SELECT month, COUNT(*) AS files, COUNT(DISTINCT supplier_id) AS suppliers, CAST(SUM(size) AS BIGINT) AS bytes FROM (SELECT strftime(invoice_date, '%Y-%m') AS month, supplier_id, invoice_id % 1000 AS size FROM base WHERE NOT deleted) GROUP BY 1")
def archive_stats(m):
    d = m.base.where("not deleted").select(F.date_format("invoice_date", "yyyy-MM").alias("month"), "supplier_id", (c("invoice_id") % 1000).alias("size"))
    return d.groupBy("month").agg(F.count("*").alias("files"), F.countDistinct("supplier_id").alias("suppliers"), F.sum("size").alias("bytes"))


@query("""SELECT source, COUNT(*) AS n, COUNT(*) FILTER (status = 'completed') AS completed, CAST(round(CAST(max(hits) AS DOUBLE) / max(alln), 4) AS DOUBLE) AS hit_rate FROM (
  SELECT *, SUM(CASE WHEN source = 'template' THEN 1 ELSE 0 END) OVER () AS hits, COUNT(*) OVER () AS alln FROM (SELECT * FROM tasks ORDER BY created_at DESC, task_id DESC LIMIT 500)) GROUP BY source""")
def recognition_stats(m):
    """Statistics of the newest tasks (a report of the last 500)."""
    top = m.tasks.orderBy(c("created_at").desc(), c("task_id").desc()).limit(500)
    alln = top.agg(F.count_if(c("source") == "template").alias("h"), F.count("*").alias("a"))
    d = top.groupBy("source").agg(F.count("*").alias("n"), F.count_if(c("status") == "completed").alias("completed"))
    return d.crossJoin(F.broadcast(alln)).select("source", "n", "completed", F.round(c("h") / c("a"), 4).alias("hit_rate"))


@query("""SELECT b.invoice_id, coalesce(x.n, 0) AS n_items, x.names, CAST(coalesce(x.total, 0) AS DOUBLE) AS item_total, coalesce(x.gifts, false) AS has_gifts, d.invoice_id IS NOT NULL AS has_discounts, b.warnings <> '' AS has_warnings FROM base b
  LEFT JOIN (SELECT invoice_id, COUNT(*) AS n, string_agg(DISTINCT raw_name, ',' ORDER BY raw_name) AS names, SUM(total) AS total, bool_or(is_free) AS gifts FROM items GROUP BY 1) x ON x.invoice_id = b.invoice_id
  LEFT JOIN discounts d ON d.invoice_id = b.invoice_id WHERE NOT b.deleted""")
def invoice_enriched(m):
    x = m.items.groupBy("invoice_id").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_set("raw_name")), ",").alias("names"), money("total").alias("item_total"), F.bool_or("is_free").alias("has_gifts"))
    d = m.discounts.select("invoice_id", F.lit(True).alias("has_discounts"))
    out = m.base.where("not deleted").select("invoice_id", (c("warnings") != "").alias("has_warnings")).join(x, "invoice_id", "left").join(d, "invoice_id", "left")
    return out.fillna(0, ["n_items", "item_total"]).fillna(False, ["has_gifts", "has_discounts"])


@query("SELECT batch_id, COUNT(DISTINCT supplier_id) AS suppliers, COUNT(*) AS invoices, CAST(SUM(total_amount) AS DOUBLE) AS amount FROM invoices WHERE NOT deleted GROUP BY 1")
def batch_totals(m):
    return m.invoices.where("not deleted").groupBy("batch_id").agg(F.countDistinct("supplier_id").alias("suppliers"), F.count("*").alias("invoices"), money("total_amount").alias("amount"))


@query("SELECT batch_id, CASE WHEN invoice_id % 9 = 0 THEN 'unknown supplier' ELSE supplier_name END AS supplier, COUNT(*) AS n, string_agg(invoice_no, ',' ORDER BY invoice_no) AS numbers FROM base GROUP BY 1, 2")
def batch_by_supplier(m):
    name = F.coalesce(F.when(c("invoice_id") % 9 != 0, c("supplier_name")), F.lit("unknown supplier"))
    return m.base.groupBy("batch_id", name.alias("supplier")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("invoice_no")), ",").alias("numbers"))


@query("SELECT company_id, invoice_id, invoice_date, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY invoice_date DESC, invoice_id DESC) AS rn FROM base WHERE NOT deleted) WHERE rn <= 20")
def search_topk(m):
    """The newest of each company: 20 without a search text."""
    w = Window.partitionBy("company_id").orderBy(c("invoice_date").desc(), c("invoice_id").desc())
    return m.base.where("not deleted").withColumn("rank", F.row_number().over(w)).where(f"rank <= {page_size(None)}").select("company_id", "invoice_id", "invoice_date", "rank")


def page_size(text: str | None, asked: int | None = None) -> int:
    """Results of a search: 100 with a text, 20 without; what a caller asks for stays from 1 to 100."""
    return min(100, max(1, asked)) if asked is not None else (100 if text else 20)


@query("SELECT invoice_id, COUNT(*) AS n_items, CAST(coalesce(max(d.amount), 0) AS DOUBLE) AS discount, string_agg(item_id, ',' ORDER BY line_no, item_id) AS ids FROM items LEFT JOIN discounts d USING (invoice_id) WHERE invoice_id IN (SELECT invoice_id FROM base WHERE NOT deleted) GROUP BY invoice_id")
def invoice_detail(m):
    """Each invoice with its lines in order and its discount."""
    x = m.items.groupBy("invoice_id").agg(F.count("*").alias("n_items"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "item_id"))), lambda s: s["item_id"]), ",").alias("ids"))
    x = x.join(m.base.where("not deleted").select("invoice_id"), "invoice_id", "left_semi").join(m.discounts.select("invoice_id", c("amount").cast("double").alias("discount")), "invoice_id", "left")
    return x.fillna(0.0, ["discount"])


PAGES = "(SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, CAST(page_id % 4 AS INTEGER) AS page_index FROM pages)"


@query(f"SELECT host, COUNT(*) AS n_pages, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_index, page_id) AS ids, CASE WHEN COUNT(*) > 1 THEN CAST(0.55 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END AS confidence FROM {PAGES} GROUP BY host")
def import_groups(m):
    """Pages of a group in order; a group of several is surer than a single page."""
    d = m.table("pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), (c("page_id") % 4).alias("page_index"))
    d = d.groupBy("host").agg(F.count("*").alias("n_pages"), F.array_sort(F.collect_list(F.struct("page_index", "page_id"))).alias("p"))
    return d.select("host", "n_pages", F.array_join(F.transform("p", lambda x: x["page_id"].cast("string")), ",").alias("ids"), F.when(c("n_pages") > 1, 0.55).otherwise(0.2).alias("confidence"))


@query("""SELECT i.item_id, i.product_id, i.raw_name FROM items i JOIN base b ON b.invoice_id = i.invoice_id
  WHERE NOT b.deleted AND (contains(lower(i.raw_name || ' ' || i.promo_group || ' ' || i.brand), 'brand#1') OR contains(lower(i.promo_group), 'promo'))""")
def product_search(m):
    """A literal, case-insensitive match over several fields."""
    d = m.items.join(m.base.where("not deleted").select("invoice_id"), "invoice_id", "left_semi")
    text = F.lower(F.concat_ws(" ", "raw_name", "promo_group", "brand"))
    return d.where(text.contains("brand#1") | F.lower("promo_group").contains("promo")).select("item_id", "product_id", "raw_name")
