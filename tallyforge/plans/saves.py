"""A batch of invoices saved over what is stored: every table's rows afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import saving as S
from tallyforge.plans.registry import query

c = F.col

#: Every third invoice is saved now; every sixth was stored before, and so were those that aren't saved now.
BATCH = r"""asked AS (SELECT invoice_id, company_id, supplier_id, invoice_date, CASE WHEN invoice_id % 9 = 0 THEN 0 ELSE total_amount END AS given, CASE invoice_id % 4 WHEN 0 THEN 'saved' WHEN 1 THEN 'CONFIRMED' WHEN 2 THEN '' ELSE 'PENDING_REVIEW' END AS asked_status,
    CASE WHEN invoice_id % 15 = 0 THEN 'low light' ELSE '' END AS payload, duplicate_status AS duplicate, invoice_id % 46 = 0 AS force FROM invoices WHERE invoice_id % 3 = 0),
named AS (SELECT *, supplier_id % 5 AS seller, brand AS family, CASE WHEN line_no = 6 THEN ' Memo ' ELSE raw_name END AS line_name, unit_price AS price, line_no <> 5 AS trusted FROM items),
sub AS (SELECT invoice_id, SUM(CASE WHEN NOT candidate_only THEN total ELSE 0 END) AS subtotal, SUM(total) AS all_lines, COUNT(*) FILTER (NOT candidate_only AND lower(trim(line_name)) NOT IN ('', 'remark', 'remarks', 'note', 'notes', 'memo', 'subtotal', 'total')) AS goods FROM named GROUP BY 1),
measured AS (SELECT a.*, coalesce(subtotal, 0) AS subtotal, coalesce(goods, 0) AS goods, CASE WHEN given > 0 THEN given ELSE coalesce(all_lines, 0) END AS total_amount,
    abs(CAST(CASE WHEN given > 0 THEN given ELSE coalesce(all_lines, 0) END - coalesce(subtotal, 0) - coalesce(d.amount, 0) AS DOUBLE)) AS difference FROM asked a LEFT JOIN sub s ON s.invoice_id = a.invoice_id LEFT JOIN discounts d ON d.invoice_id = a.invoice_id),
marked AS (SELECT *, CASE WHEN duplicate = 'duplicate' AND NOT force THEN 'blocked' WHEN duplicate = 'duplicate' THEN 'forced' ELSE 'saved' END AS outcome,
    list_filter([CASE WHEN goods = 0 THEN 'EMPTY_ITEMS' END, CASE WHEN total_amount > 0 AND difference > 0.05 THEN 'AMOUNT_MISMATCH' END, CASE WHEN duplicate = 'possible' THEN 'POSSIBLE_MULTI_PAGE_OR_DUPLICATE' END], lambda x: x IS NOT NULL) AS found FROM measured),
saved_v AS (SELECT *, CASE WHEN outcome <> 'blocked' THEN CASE WHEN len(found) > 0 THEN 'PENDING_REVIEW' WHEN asked_status IN ('', 'saved', 'PENDING_REVIEW') THEN 'APPROVED' ELSE asked_status END END AS new_status,
    CASE WHEN outcome <> 'blocked' THEN array_to_string(list_filter(list_concat([payload], found, [CASE WHEN difference > 0.05 THEN 'totalDifference=' || CAST(CAST(difference AS DECIMAL(18,4)) AS DECIMAL(18,2)) ELSE '' END]), lambda x: x <> ''), ' | ') END AS text FROM marked),
priced AS (SELECT n.*, v.company_id, v.supplier_id AS owner, v.invoice_date FROM named n JOIN saved_v v ON v.invoice_id = n.invoice_id WHERE v.new_status IN ('APPROVED', 'CONFIRMED') AND NOT is_free AND NOT candidate_only AND trusted AND quantity > 0 AND price > 0 AND n.total > 0 AND lower(trim(line_name)) NOT IN ('', 'remark', 'remarks', 'note', 'notes', 'memo', 'comment')),
history AS (SELECT n.item_id, n.invoice_id, b.company_id, b.supplier_id AS owner, n.seller, n.family, n.line_name, n.price FROM named n JOIN base b ON b.invoice_id = n.invoice_id WHERE (b.invoice_id % 3 <> 0 OR b.invoice_id % 6 = 0) AND b.status = 'APPROVED' AND NOT is_free AND price > 0),
kept AS (SELECT * FROM history WHERE invoice_id NOT IN (SELECT invoice_id FROM saved_v WHERE outcome <> 'blocked'))"""


def batch(m) -> tuple[DataFrame, DataFrame]:
    """The invoices of a batch as saved, and the lines of all invoices."""
    k = c("invoice_id")
    asked = m.invoices.where(k % 3 == 0).select(
        "invoice_id", "company_id", "supplier_id", "invoice_date", F.when(k % 9 == 0, 0).otherwise(c("total_amount")).alias("total_amount"),
        F.when(k % 4 == 0, "saved").when(k % 4 == 1, "CONFIRMED").when(k % 4 == 2, "").otherwise("PENDING_REVIEW").alias("status"),
        F.when(k % 15 == 0, "low light").otherwise("").alias("warnings"), c("duplicate_status").alias("duplicate"), (k % 46 == 0).alias("force"),
    )
    lines = m.items.select("item_id", "invoice_id", "line_no", "product_id", (c("supplier_id") % 5).alias("seller"), c("brand").alias("family"), "quantity", "total", "is_free", "candidate_only", c("unit_price").alias("price"), (c("line_no") != 5).alias("trusted"), F.when(c("line_no") == 6, " Memo ").otherwise(c("raw_name")).alias("name"))
    return S.saved(asked, lines, m.discounts), lines


def history(m, lines: DataFrame) -> DataFrame:
    """The stored price rows."""
    b = m.base.where("(invoice_id % 3 <> 0 or invoice_id % 6 = 0) and status = 'APPROVED'").select("invoice_id", "company_id", c("supplier_id").alias("owner"))
    return lines.where("not is_free and price > 0").join(b, "invoice_id")


def new_prices(saved: DataFrame, lines: DataFrame) -> DataFrame:
    return S.priced(lines, saved).join(saved.select("invoice_id", "company_id", c("supplier_id").alias("owner"), "invoice_date"), "invoice_id")


@query("SELECT invoice_id, outcome, new_status AS status, CAST(total_amount AS DOUBLE) AS total_amount, CAST(subtotal AS DOUBLE) AS calculated_total, difference, text AS warnings FROM saved_v", BATCH)
def save_invoice_rows(m):
    """What becomes of each invoice of the batch: saved, forced or blocked, its status, totals and warnings."""
    return batch(m)[0].select("invoice_id", "outcome", "status", "total_amount", "calculated_total", "difference", "warnings")


LEARN = """SELECT n.company_id, n.key, n.owner AS supplier_id, coalesce(s.n, 0) + n.n AS n, least(n.low, coalesce(s.low, n.low)) AS low, greatest(n.top, coalesce(s.top, n.top)) AS top, (coalesce(s.total, 0) + n.total)::DOUBLE / (coalesce(s.n, 0) + n.n) / 10000 AS mean,
  least({2}, CASE WHEN s.n IS NULL THEN {0} ELSE least({2}, {0} + {1} * s.n) END + {1} * n.n)::DOUBLE AS confidence, s.n IS NULL AS is_new
  FROM (SELECT company_id, lower(trim(line_name)) AS key, owner, COUNT(*) AS n, min(price) AS low, max(price) AS top, SUM(CAST(floor(price * 10000) AS BIGINT)) AS total FROM priced GROUP BY 1, 2, 3) n
  LEFT JOIN (SELECT company_id, lower(trim(line_name)) AS key, owner, COUNT(*) AS n, min(price) AS low, max(price) AS top, SUM(CAST(floor(price * 10000) AS BIGINT)) AS total FROM kept GROUP BY 1, 2, 3) s ON s.company_id = n.company_id AND s.key = n.key AND s.owner = n.owner"""


def lessons(m, confidence):
    """What the batch teaches of names, per company, name and supplier, over what was learned of the stored rows that stay."""
    saved, lines = batch(m)
    old = history(m, lines)
    old = old.join(S.retired(old, saved).select("item_id", "invoice_id").distinct(), ["item_id", "invoice_id"], "left_anti")
    keyed = lambda d: d.withColumn("key", F.lower(F.trim("name")))
    keys = ["company_id", "key", "owner"]
    start, step, most = (F.lit(v).cast("decimal(6,2)") for v in confidence)
    stored = keyed(old).groupBy(*keys).agg(F.count("*").alias("n"), F.min("price").alias("low"), F.max("price").alias("top"), F.sum(S.tenths(c("price"))).alias("sum"))
    stored = stored.withColumn("confidence", F.least(most, start + step * c("n").cast("decimal(18,0)")))
    d = S.learned(stored, keyed(new_prices(saved, lines)), keys, confidence)
    return d.select("company_id", "key", c("owner").alias("supplier_id"), "n", "low", "top", (c("sum").cast("double") / c("n") / 10000).alias("mean"), "confidence", "is_new")


@query(LEARN.format(*S.ALIAS), BATCH)
def save_alias_rows(m):
    """The aliases that the batch adds or strengthens."""
    return lessons(m, S.ALIAS)


@query(LEARN.format(*S.RULE), BATCH)
def save_rule_rows(m):
    """The rules that the batch adds or strengthens."""
    return lessons(m, S.RULE)


@query(
    """SELECT item_id, price, mean, abs(price - mean) / mean AS deviation FROM (SELECT p.item_id, p.price, (coalesce(h.total, 0) + coalesce(p.before, 0))::DOUBLE / nullif(coalesce(h.n, 0) + p.n_before, 0) / 10000 AS mean
  FROM (SELECT *, COUNT(*) OVER w AS n_before, SUM(CAST(floor(price * 10000) AS BIGINT)) OVER w AS before FROM priced WINDOW w AS (PARTITION BY company_id, seller, family ORDER BY invoice_date, invoice_id, line_no, item_id, price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) p
  LEFT JOIN (SELECT company_id, seller, family, COUNT(*) AS n, SUM(CAST(floor(price * 10000) AS BIGINT)) AS total FROM kept GROUP BY 1, 2, 3) h ON h.company_id = p.company_id AND h.seller = p.seller AND h.family = p.family)
  WHERE mean > 0 AND abs(price - mean) / mean > 0.30""",
    BATCH,
)
def save_anomaly_rows(m):
    """The prices of the batch that are far from the mean of what is stored and of what came before them, by company, seller and family of products (the tables repeat a product too rarely)."""
    saved, lines = batch(m)
    old = history(m, lines)
    old = old.join(saved.where("outcome <> 'blocked'").select("invoice_id"), "invoice_id", "left_anti")
    return S.anomalies(old, new_prices(saved, lines), ["company_id", "seller", "family"], ["invoice_date", "invoice_id", "line_no", "item_id", "price"]).select("item_id", "price", "mean", "deviation")


@query(
    """SELECT 'invoice_items' AS tbl, item_id AS id FROM items WHERE invoice_id % 6 = 0 AND invoice_id IN (SELECT invoice_id FROM saved_v WHERE outcome <> 'blocked')
  UNION ALL SELECT 'invoice_discounts', CAST(invoice_id AS VARCHAR) FROM discounts WHERE invoice_id % 6 = 0 AND invoice_id IN (SELECT invoice_id FROM saved_v WHERE outcome <> 'blocked')
  UNION ALL SELECT 'price_history', item_id FROM history WHERE invoice_id IN (SELECT invoice_id FROM saved_v WHERE outcome <> 'blocked')""",
    BATCH,
)
def save_retired_rows(m):
    """The stored rows that go because their invoice is saved again: lines, discounts and price rows."""
    saved, lines = batch(m)
    tables = {"invoice_items": (lines.where("invoice_id % 6 = 0"), "item_id"), "invoice_discounts": (m.discounts.where("invoice_id % 6 = 0"), "invoice_id"), "price_history": (history(m, lines), "item_id")}
    out = None
    for tbl, (rows, key) in tables.items():
        d = S.retired(rows, saved).select(F.lit(tbl).alias("tbl"), c(key).cast("string").alias("id"))
        out = d if out is None else out.unionByName(d)
    return out
