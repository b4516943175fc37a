"""Uploads in sessions and groups, and the search over all name fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions.encoding import unescaped
from tallyforge.operators import imports as I
from tallyforge.operators import search as S
from tallyforge.operators.components import dealt
from tallyforge.plans.registry import query

c = F.col

UPLOADS = r"""uploads AS (SELECT user_id % 5 AS company_id, user_id, event_id AS file_id, ts AS moment, CASE WHEN event_id % 10 = 0 THEN '' ELSE md5(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)) END AS hash,
  CASE event_id % 5 WHEN 0 THEN 'scan_' || (event_id // 40) || '_p' || (event_id % 40 // 5 + 1) || 'of8.jpg' WHEN 1 THEN 'Page ' || (event_id % 7) || '.png' WHEN 2 THEN (event_id // 60) || ' - 3/5.tif' WHEN 3 THEN 'IMG' || event_id ELSE '发票' || (event_id // 50) || ' 页_' || (event_id % 3) || '.jpeg' END AS name FROM events),
timed AS (SELECT *, CASE WHEN moment - lag(moment) OVER w <= INTERVAL 1800 SECOND THEN NULL ELSE file_id END AS first FROM uploads WINDOW w AS (PARTITION BY company_id, user_id ORDER BY moment, file_id)),
sessions AS (SELECT *, last_value(first IGNORE NULLS) OVER (PARTITION BY company_id, user_id ORDER BY moment, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM timed),
pages_v AS (SELECT *, row_number() OVER (PARTITION BY company_id, user_id, session ORDER BY moment, file_id) AS page_index, hash <> '' AND row_number() OVER (PARTITION BY company_id, hash ORDER BY moment, file_id) > 1 AS copy,
  CASE file_id % 5 WHEN 0 THEN file_id % 40 // 5 + 1 WHEN 1 THEN file_id % 7 WHEN 2 THEN 3 WHEN 3 THEN 0 ELSE file_id % 3 END AS page_number, CASE file_id % 5 WHEN 0 THEN 8 WHEN 2 THEN 5 ELSE 0 END AS page_count,
  CASE file_id % 5 WHEN 0 THEN 'scan_' || (file_id // 40) WHEN 1 THEN 'Page ' || (file_id % 7) WHEN 2 THEN CAST(file_id // 60 AS VARCHAR) WHEN 3 THEN 'file:' || file_id ELSE '发票' || (file_id // 50) END AS grp FROM sessions)"""


def uploads(m):
    """Files sent by the users of a company, at the time of each event, with the names that scanners and telephones give."""
    e, n = m.table("events"), c("event_id")
    part = lambda k: F.floor(n / k).cast("string")
    text = lambda x: x.cast("string")
    name = (
        F.when(n % 5 == 0, F.concat(F.lit("scan_"), part(40), F.lit("_p"), text(F.floor(n % 40 / 5) + 1), F.lit("of8.jpg"))).when(n % 5 == 1, F.concat(F.lit("Page "), text(n % 7), F.lit(".png")))
        .when(n % 5 == 2, F.concat(part(60), F.lit(" - 3/5.tif"))).when(n % 5 == 3, F.concat(F.lit("IMG"), text(n))).otherwise(F.concat(F.lit("发票"), part(50), F.lit(" 页_"), text(n % 3), F.lit(".jpeg")))
    )
    digest = F.when(n % 10 == 0, "").otherwise(F.md5(text(F.floor("value"))))
    return e.select((c("user_id") % 5).alias("company_id"), "user_id", n.alias("file_id"), c("ts").cast("timestamp").alias("at"), digest.alias("hash"), name.alias("name"))


@query("SELECT company_id, user_id, session, file_id, CAST(page_index AS INTEGER) AS page_index, CAST(page_number AS INTEGER) AS page_number, CAST(page_count AS INTEGER) AS page_count, CASE WHEN copy THEN 'skipped_duplicate' ELSE 'waiting' END AS status, grp AS group_key FROM pages_v", UPLOADS)
def import_pages(m):
    """Uploads as pages of import sessions: order, page by file name, copies by hash, and group."""
    return I.pages(uploads(m)).select("company_id", "user_id", "session", "file_id", "page_index", "page_number", "page_count", "status", c("group").alias("group_key"))


@query("SELECT company_id, user_id, session, grp AS group_key, COUNT(*) AS n_pages, string_agg(CAST(file_id AS VARCHAR), ',' ORDER BY page_index) AS files, COUNT(*) FILTER (copy) AS copies, CASE WHEN starts_with(grp, 'file:') THEN 0.2 ELSE 0.55 END::DOUBLE AS confidence FROM pages_v GROUP BY 1, 2, 3, 4", UPLOADS)
def import_session_groups(m):
    """The groups of each import session with their files in page order; a group by name is surer than a single file."""
    return I.groups(I.pages(uploads(m))).withColumnRenamed("group", "group_key")


# --- search ---------------------------------------------------------------------------------

RECORDS = r"""rec AS (SELECT p_partkey AS product_id, p_brand || ' ' || p_name AS product_name, upper(p_name) AS original, p_brand || ' orig ' || p_name AS original_name, p_name || ' no ' || p_size AS item_name, p_name AS raw_name, p_type AS name,
    CASE WHEN p_partkey % 14 = 0 THEN '\u7eff\u8336 ' || p_size WHEN p_partkey % 7 = 0 THEN '绿茶 ' || p_size ELSE '' END AS name_cn, p_name || ' ' || p_type AS name_en, lower(p_brand) AS normalised, '(' || p_type || ') ' || p_name AS standard, p_brand || '/' || p_size AS code FROM part),
plain AS (SELECT *, CASE WHEN product_id % 14 = 0 THEN replace(replace(name_cn, '\u7eff', '绿'), '\u8336', '茶') ELSE name_cn END AS cn FROM rec),
texts_v AS (SELECT product_id, lower(concat_ws(chr(10), product_name, original, original_name, item_name, raw_name, name, name_cn, name_en, normalised, standard, code,
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(concat_ws(' ', product_name, original, original_name, item_name, raw_name, name, cn, name_en, normalised, standard, code)), '[()]', ' ', 'g'), '\s*x\s*', 'X', 'g'), '\s*/\s*', '/', 'g'), '\s+', ' ', 'g')))) AS text FROM plain),
asked AS (SELECT p_partkey AS query_id, CASE p_partkey % 5 WHEN 0 THEN upper(substr(p_name, 2, 6)) WHEN 1 THEN ' ' || p_size || ' ' WHEN 2 THEN p_type || '   ' || p_name WHEN 3 THEN '绿茶 ' || p_size ELSE 'nothing ' || p_partkey END AS q FROM part WHERE p_partkey % 97 = 3),
normal AS (SELECT *, trim(q) AS raw, trim(regexp_replace(regexp_replace(lower(trim(q)), '\s*x\s*', 'X', 'g'), '\s+', ' ', 'g')) AS norm FROM asked),
formed AS (SELECT query_id, lower(raw) AS form FROM normal UNION SELECT query_id, lower(norm) FROM normal UNION SELECT query_id, replace(replace(lower(raw), '绿', '\u7eff'), '茶', '\u8336') FROM normal)"""


def product_records(m):
    """Products with eleven name fields; some Chinese names are stored escaped."""
    p, k = dealt(m.table("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey"), c("p_partkey")
    size = c("p_size").cast("string")
    cn = F.when(k % 14 == 0, F.concat(F.lit("\\u7eff\\u8336 "), size)).when(k % 7 == 0, F.concat(F.lit("绿茶 "), size)).otherwise("")
    fields = [
        F.concat_ws(" ", "p_brand", "p_name"), F.upper("p_name"), F.concat(c("p_brand"), F.lit(" orig "), c("p_name")), F.concat(c("p_name"), F.lit(" no "), size), c("p_name"), c("p_type"), cn,
        F.concat_ws(" ", "p_name", "p_type"), F.lower("p_brand"), F.concat(F.lit("("), c("p_type"), F.lit(") "), c("p_name")), F.concat(c("p_brand"), F.lit("/"), size),
    ]
    d = p.select(k.alias("product_id"), *[f.alias(f"f{i}") for i, f in enumerate(fields)])
    names = [c(f"f{i}") for i in range(len(fields))]
    return d.select("product_id", S.searchable(names, unescaped(F.concat_ws(" ", *names))).alias("text"))


@query("SELECT DISTINCT query_id, product_id FROM formed JOIN texts_v ON contains(text, form) WHERE form <> ''", RECORDS)
def product_search_all(m):
    """Searches for many texts at once, over all name fields of the products, in the raw, normalised and escaped form."""
    k = c("p_partkey")
    q = F.when(k % 5 == 0, F.upper(F.substr("p_name", F.lit(2), F.lit(6)))).when(k % 5 == 1, F.concat(F.lit(" "), c("p_size").cast("string"), F.lit(" "))).when(k % 5 == 2, F.concat_ws("   ", "p_type", "p_name")).when(k % 5 == 3, F.concat(F.lit("绿茶 "), c("p_size").cast("string"))).otherwise(F.concat(F.lit("nothing "), k.cast("string")))
    asked = m.table("part").where(k % 97 == 3).select(k.alias("query_id"), q.alias("q"))
    return S.found(asked, "q", product_records(m), "product_id", "text").select("query_id", "product_id")


# --- snapshots and summaries ----------------------------------------------------------------

SNAPSHOT = """snapshot AS (
  SELECT 'suppliers' AS tbl, CAST(supplier_id AS VARCHAR) AS id, TIMESTAMP '2020-01-01' + INTERVAL 1 DAY * (supplier_id % 400) AS updated_at, deleted FROM suppliers_v
  UNION ALL SELECT 'products', CAST(p_partkey AS VARCHAR), TIMESTAMP '2020-01-01' + INTERVAL 1 DAY * (p_partkey % 300), false FROM part
  UNION ALL SELECT 'invoices', CAST(invoice_id AS VARCHAR), CAST(invoice_date AS TIMESTAMP), deleted FROM base
  UNION ALL SELECT 'invoice_items', item_id, CAST(ship_date AS TIMESTAMP), candidate_only FROM items
  UNION ALL SELECT 'invoice_discounts', CAST(d.invoice_id AS VARCHAR), CAST(invoice_date AS TIMESTAMP), deleted FROM discounts d JOIN base b ON b.invoice_id = d.invoice_id
  UNION ALL SELECT 'price_history', item_id, CAST(invoice_date AS TIMESTAMP), false FROM prices
  UNION ALL SELECT DISTINCT 'product_aliases', supplier_id || '-' || product_id, max(CAST(invoice_date AS TIMESTAMP)) OVER (PARTITION BY supplier_id, product_id), false FROM prices
  UNION ALL SELECT DISTINCT 'product_learning_rules', company_id || '-' || product_name, max(CAST(invoice_date AS TIMESTAMP)) OVER (PARTITION BY company_id, product_name), false FROM prices
  UNION ALL SELECT 'recognition_corrections', CAST(invoice_id AS VARCHAR), CAST(invoice_date AS TIMESTAMP), deleted FROM base WHERE invoice_id % 3 = 0
  UNION ALL SELECT 'recognition_tasks', CAST(task_id AS VARCHAR), created_at, status = 'failed' FROM tasks
  UNION ALL SELECT 'supplier_templates', CAST(supplier_id AS VARCHAR), TIMESTAMP '2020-01-01' + INTERVAL 1 DAY * (supplier_id % 400), supplier_id % 9 = 0 FROM suppliers_v
  UNION ALL SELECT DISTINCT 'purchase_batches', company_id || '/' || batch_id, max(CAST(invoice_date AS TIMESTAMP)) OVER (PARTITION BY company_id, batch_id), false FROM base
  UNION ALL SELECT 'changes', CAST(change_id AS VARCHAR), updated_at, deleted FROM feed)"""


def snapshot(m):
    """(tbl, id, updated_at, deleted): every row of the thirteen synchronised tables."""
    day = lambda n: F.expr(f"timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval({n})")
    at = lambda x: c(x).cast("timestamp_ntz")
    no = F.lit(False)
    row = lambda df, tbl, id_, when, gone=no: df.select(F.lit(tbl).alias("tbl"), id_.cast("string").alias("id"), when.alias("updated_at"), gone.alias("deleted"))
    last = lambda df, *keys: df.groupBy(*keys).agg(F.max("invoice_date").alias("invoice_date"))
    b = m.base
    tables = [
        row(m.suppliers, "suppliers", c("supplier_id"), day("supplier_id % 400"), c("deleted")), row(m.table("part"), "products", c("p_partkey"), day("p_partkey % 300")),
        row(b, "invoices", c("invoice_id"), at("invoice_date"), c("deleted")), row(m.lines, "invoice_items", c("item_id"), at("ship_date"), c("candidate_only")),
        row(m.discounts.select("invoice_id").join(b, "invoice_id"), "invoice_discounts", c("invoice_id"), at("invoice_date"), c("deleted")), row(m.bare_prices, "price_history", c("item_id"), at("invoice_date")),
        row(last(m.bare_prices, "supplier_id", "product_id"), "product_aliases", F.concat_ws("-", c("supplier_id").cast("string"), c("product_id").cast("string")), at("invoice_date")),
        row(last(m.prices, "company_id", "product_name"), "product_learning_rules", F.concat_ws("-", "company_id", "product_name"), at("invoice_date")),
        row(b.where("invoice_id % 3 = 0"), "recognition_corrections", c("invoice_id"), at("invoice_date"), c("deleted")), row(m.tasks, "recognition_tasks", c("task_id"), at("created_at"), c("status") == "failed"),
        row(m.suppliers, "supplier_templates", c("supplier_id"), day("supplier_id % 400"), c("supplier_id") % 9 == 0), row(last(b, "company_id", "batch_id"), "purchase_batches", F.concat_ws("/", "company_id", "batch_id"), at("invoice_date")),
        row(m.feed, "changes", c("change_id"), at("updated_at"), c("deleted")),
    ]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


@query("SELECT tbl, id, updated_at, deleted FROM snapshot", SNAPSHOT)
def src_snapshot_rows(m):
    """The full snapshot: the rows of all thirteen tables in one stream, by the time of their change (a range sort, nothing is gathered)."""
    return snapshot(m).orderBy("updated_at", "tbl", "id")


@query("SELECT tbl, COUNT(*) FILTER (NOT deleted) AS live, COUNT(*) AS stored FROM snapshot GROUP BY 1", SNAPSHOT)
def live_counts(m):
    """Live and stored rows of each table, from one conditional count."""
    return snapshot(m).groupBy("tbl").agg(F.count_if(~c("deleted")).alias("live"), F.count("*").alias("stored"))


def price_summaries(m, text: str | None):
    """Products with their price records that match a text (all without one); products without records are added where a text is given or nothing else was found."""
    named = m.table("part").select(c("p_partkey").alias("product_id"), F.lower(F.concat_ws(" ", "p_brand", "p_name")).alias("name"))
    asked = named.where(c("name").contains(text.lower())) if text else named
    d = m.bare_prices.groupBy("product_id").agg(F.count("*").alias("records"), F.min("price").alias("low"), F.max("price").alias("top")).join(asked.select("product_id"), "product_id", "left_semi")
    if not text and d.limit(1).count():
        return d
    rest = asked.select("product_id").join(d, "product_id", "left_anti").selectExpr("product_id", "0L as records", "cast(null as double) as low", "cast(null as double) as top")
    return d.unionByName(rest)


SUMMED = "summed AS (SELECT product_id, COUNT(*) AS records, min(price) AS low, max(price) AS top FROM prices GROUP BY 1)"


@query(
    """SELECT 'all' AS asked, * FROM summed UNION ALL SELECT 'blue', p_partkey, coalesce(records, 0), low, top FROM part LEFT JOIN summed ON product_id = p_partkey WHERE contains(lower(p_brand || ' ' || p_name), 'blue')""",
    SUMMED,
)
def price_summary_asked(m):
    """Summaries without a text and with one: only the latter has products without records."""
    return price_summaries(m, None).select(F.lit("all").alias("asked"), "*").unionByName(price_summaries(m, "BLUE").select(F.lit("blue").alias("asked"), "*"))
