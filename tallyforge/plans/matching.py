"""Duplicates, suppliers and products: candidates, classes, verdicts, resolution, merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import dedup
from tallyforge.operators.keys import key_map, resolve
from tallyforge.plans.registry import query

c = F.col

SIGS = """sigs AS (SELECT invoice_id, string_agg(s, '|' ORDER BY s) AS signature, CAST(COUNT(*) AS INTEGER) AS n_paid FROM (SELECT invoice_id, lower(raw_name) || ':' || CAST(quantity AS VARCHAR) || ':' || CAST(total AS VARCHAR) AS s FROM items WHERE NOT is_free) GROUP BY 1)"""
PAIRS = SIGS + """, ent AS (SELECT e.invoice_id, company_id, supplier_id, supplier_name, invoice_no, invoice_date, total_amount, batch_id, coalesce(s.signature, '') AS signature FROM entries e LEFT JOIN sigs s ON s.invoice_id = e.invoice_id % 1000000000),
pairs AS (SELECT DISTINCT x.invoice_id AS x_invoice_id, y.invoice_id AS y_invoice_id, x.invoice_no = y.invoice_no AS same_number, abs(x.total_amount - y.total_amount) < 0.01 AS same_amount, x.signature = y.signature AS same_items,
  abs(date_diff('day', x.invoice_date, y.invoice_date)) <= 1 AS close_date, x.batch_id = y.batch_id AND x.invoice_id % 20 = 0 AS same_group, x.supplier_id = y.supplier_id AS same_supplier, y.invoice_date AS y_invoice_date
  FROM ent x JOIN ent y ON x.company_id = y.company_id AND x.invoice_id > y.invoice_id AND (x.invoice_no = y.invoice_no OR (x.supplier_id = y.supplier_id AND x.total_amount > 0 AND abs(x.total_amount - y.total_amount) < 0.01 AND abs(date_diff('day', x.invoice_date, y.invoice_date)) <= 1))),
classes AS (SELECT *, CASE WHEN NOT same_supplier THEN 'none' WHEN NOT same_number THEN CASE WHEN same_amount AND same_items AND close_date THEN 'possible_other_number' ELSE 'none' END WHEN NOT close_date THEN 'possible_date_conflict'
  WHEN NOT same_items THEN CASE WHEN same_group THEN 'multi_page' ELSE 'possible_pages' END WHEN same_amount THEN 'confirmed' ELSE 'possible_amount' END AS cls FROM pairs)"""


def pairs(m):
    # pairs are compared by the digest of the signature, which is all that the joins carry
    sig = dedup.signatures(m.items).select(c("invoice_id").alias("root"), F.sha2("signature", 256).alias("signature"))
    e = m.entries.withColumn("root", c("invoice_id") % 1_000_000_000).join(sig, "root", "left").withColumn("signature", F.coalesce("signature", F.sha2(F.lit(""), 256)))
    return dedup.candidates(e, ["invoice_id", "company_id", "supplier_id", "invoice_no", "invoice_date", "total_amount", "batch_id", "signature"])


def flags():
    return {
        "same_number": c("x_invoice_no") == c("y_invoice_no"), "same_amount": F.abs(c("x_total_amount") - c("y_total_amount")) < 0.01, "same_items": c("x_signature") == c("y_signature"),
        "close_date": F.abs(F.datediff("x_invoice_date", "y_invoice_date")) <= 1, "same_group": (c("x_batch_id") == c("y_batch_id")) & (c("x_invoice_id") % 20 == 0), "same_supplier": c("x_supplier_id") == c("y_supplier_id"),
    }


@query("SELECT x_invoice_id, y_invoice_id FROM pairs", PAIRS)
def dup_candidates(m):
    return pairs(m).select("x_invoice_id", "y_invoice_id")


@query("SELECT x_invoice_id, y_invoice_id, cls, CASE WHEN same_number AND same_supplier AND same_amount AND close_date THEN 'duplicate' ELSE 'none' END AS older FROM classes", PAIRS)
def dup_classify(m):
    f = flags()
    older = {k: f[k] for k in ("same_number", "same_amount", "close_date", "same_supplier")}
    return pairs(m).select("x_invoice_id", "y_invoice_id", dedup.classify(**f).alias("cls"), dedup.strict(**older).alias("older"))


@query("SELECT x_invoice_id AS invoice_id, y_invoice_id AS other, cls FROM (SELECT *, row_number() OVER (PARTITION BY x_invoice_id ORDER BY CASE cls WHEN 'confirmed' THEN 0 WHEN 'multi_page' THEN 1 ELSE 2 END, y_invoice_date DESC, y_invoice_id DESC) AS rn FROM classes WHERE cls NOT IN ('none', 'possible_other_number')) WHERE rn = 1", PAIRS)
def dup_verdict(m):
    return dedup.verdict(pairs(m).withColumn("cls", dedup.classify(**flags())))


@query("""SELECT x.invoice_id, min(y.invoice_id) AS other FROM ent x JOIN ent y ON x.company_id = y.company_id AND x.supplier_id = y.supplier_id AND x.invoice_no = y.invoice_no AND x.invoice_id > y.invoice_id
  WHERE abs(x.total_amount - y.total_amount) <= 0.009 AND abs(date_diff('day', x.invoice_date, y.invoice_date)) <= 1 AND x.signature = y.signature GROUP BY 1""", PAIRS)
def dup_store_verdict(m):
    """The store's own test: number, amount, date and items."""
    p = pairs(m).where((c("x_invoice_no") == c("y_invoice_no")) & (c("x_supplier_id") == c("y_supplier_id")) & (F.abs(c("x_total_amount") - c("y_total_amount")) <= 0.009) & (F.abs(F.datediff("x_invoice_date", "y_invoice_date")) <= 1) & (c("x_signature") == c("y_signature")))
    return p.groupBy(c("x_invoice_id").alias("invoice_id")).agg(F.min("y_invoice_id").alias("other"))


@query("SELECT invoice_id, md5(signature) AS signature, n_paid FROM sigs", SIGS)
def item_signature(m):
    return dedup.signatures(m.items).select("invoice_id", F.md5("signature").alias("signature"), "n_paid")


@query("""SELECT b.invoice_id, md5(concat_ws('|', upper(regexp_replace(invoice_no, '[^A-Za-z0-9]', '', 'g')), strftime(invoice_date, '%Y-%m-%d'), CAST(total_amount AS VARCHAR), CAST(x.n AS VARCHAR), x.names, CAST(x.qty AS VARCHAR))) AS print FROM invoices b
  JOIN (SELECT invoice_id, COUNT(*) AS n, string_agg(lower(raw_name), ',' ORDER BY lower(raw_name)) AS names, CAST(SUM(quantity) AS DECIMAL(18,2)) AS qty FROM items GROUP BY 1) x ON x.invoice_id = b.invoice_id""")
def fingerprint(m):
    x = m.items.groupBy("invoice_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.lower("raw_name"))), ",").alias("names"), F.sum("quantity").cast("decimal(18,2)").alias("qty"))
    no = F.upper(F.regexp_replace("invoice_no", "[^A-Za-z0-9]", ""))
    text = F.concat_ws("|", no, F.date_format("invoice_date", "yyyy-MM-dd"), c("total_amount").cast("string"), c("n").cast("string"), "names", c("qty").cast("string"))
    return m.invoices.join(x, "invoice_id").select("invoice_id", F.md5(text).alias("print"))


@query("SELECT DISTINCT x.invoice_id, y.invoice_id AS other, x.invoice_no = y.invoice_no AS likely FROM ent x JOIN ent y ON x.company_id = y.company_id AND x.invoice_id <> y.invoice_id AND ((x.batch_id = y.batch_id AND x.supplier_id = y.supplier_id) OR (x.supplier_id = y.supplier_id AND x.invoice_no = y.invoice_no))", PAIRS)
def merge_candidates(m):
    """Other invoices of the supplier in the same batch or with the same number: a union of equi-joins."""
    e = m.entries.select("invoice_id", "company_id", "supplier_id", "invoice_no", "batch_id")
    x = e.select(*[c(k).alias("x_" + k) for k in e.columns])
    base = (c("company_id") == c("x_company_id")) & (c("supplier_id") == c("x_supplier_id")) & (c("invoice_id") != c("x_invoice_id"))
    d = x.join(e, base & (c("batch_id") == c("x_batch_id"))).union(x.join(e, base & (c("invoice_no") == c("x_invoice_no"))))
    return d.select(c("x_invoice_id").alias("invoice_id"), c("invoice_id").alias("other"), (c("x_invoice_no") == c("invoice_no")).alias("likely")).distinct()


@query("SELECT invoice_id, CAST(supplier_id AS VARCHAR) AS supplier FROM base")
def resolve_refs(m):
    """A reference by any of a supplier's ids becomes the canonical id."""
    s = m.suppliers.selectExpr("company_id", "supplier_id", "concat('srv-', supplier_id) as server_id", "concat('loc-', supplier_id) as local_id")
    refs = m.base.selectExpr("company_id", "invoice_id", "case invoice_id % 3 when 0 then cast(supplier_id as string) when 1 then concat('srv-', supplier_id) else concat('loc-', supplier_id) end as supplier")
    return resolve(refs, "supplier", key_map(s, ["supplier_id", "server_id", "local_id"], "supplier_id", ["company_id"]), "supplier_id", ["company_id"]).select("invoice_id", "supplier")


@query("SELECT lower(trim(raw_name)) AS key, min(product_id) AS first_product, COUNT(*) AS n FROM items WHERE product_id % 2 = 1 AND lower(trim(raw_name)) NOT IN (SELECT lower(trim(raw_name)) FROM items WHERE product_id % 2 = 0) GROUP BY 1")
def product_dim(m):
    """Names that the product dimension doesn't have yet become products."""
    key = T.basic_name(c("raw_name"))
    known = m.items.where("product_id % 2 = 0").select(key.alias("key")).distinct()
    fresh = m.items.where("product_id % 2 = 1").groupBy(key.alias("key")).agg(F.min("product_id").alias("first_product"), F.count("*").alias("n"))
    return fresh.join(known, "key", "left_anti")


@query("SELECT key, min(product_id) AS product, arg_min(raw_name, {'p': product_id, 'n': raw_name}) AS name FROM (SELECT lower(trim(raw_name)) AS key, product_id, raw_name FROM items UNION ALL SELECT lower(trim(product_name)), product_id, product_name FROM prices) GROUP BY 1")
def product_rebuild(m):
    d = m.items.select("product_id", "raw_name").union(m.prices.select("product_id", "product_name"))
    return d.groupBy(T.basic_name(c("raw_name")).alias("key")).agg(F.min("product_id").alias("product"), F.min_by("raw_name", F.struct("product_id", "raw_name")).alias("name"))


MERGES = "merges AS (SELECT supplier_id AS source, min(supplier_id) OVER (PARTITION BY company_id, segment) AS target FROM suppliers_v WHERE supplier_id % 5 = 0)"


def merge_map(m):
    """Of the suppliers of a key the first survives; the others map to it."""
    w = Window.partitionBy("company_id", "segment")
    return m.suppliers.where("supplier_id % 5 = 0").select(c("supplier_id").alias("source"), F.min("supplier_id").over(w).alias("target"))


@query("SELECT source, target FROM merges WHERE source <> target", MERGES)
def supplier_merge_map(m):
    return merge_map(m).where("source <> target")


@query("SELECT coalesce(target, supplier_id) AS supplier_id, COUNT(*) AS invoices, CAST(SUM(total_amount) AS DOUBLE) AS amount FROM invoices LEFT JOIN merges ON source = supplier_id GROUP BY 1", MERGES)
def supplier_merge(m):
    """All references move to the surviving supplier."""
    d = m.invoices.join(merge_map(m), c("supplier_id") == c("source"), "left")
    return d.groupBy(F.coalesce("target", "supplier_id").alias("supplier_id")).agg(F.count("*").alias("invoices"), F.sum("total_amount").cast("double").alias("amount"))


@query("SELECT min(invoice_id) AS master, COUNT(*) AS merged, CAST(SUM(total_amount) AS DOUBLE) AS amount, COUNT(DISTINCT status) > 1 AS conflict FROM invoices WHERE NOT deleted GROUP BY company_id, supplier_id, left(batch_id, 6) HAVING COUNT(*) > 1")
def invoice_merge(m):
    """Invoices of a supplier and year merged into the first; unlike states are a conflict."""
    d = m.invoices.where("not deleted").groupBy("company_id", "supplier_id", F.left("batch_id", F.lit(6)).alias("year")).agg(F.min("invoice_id").alias("master"), F.count("*").alias("merged"), F.sum("total_amount").cast("double").alias("amount"), (F.countDistinct("status") > 1).alias("conflict"))
    return d.where("merged > 1").select("master", "merged", "amount", "conflict")


@query("SELECT invoice_no, COUNT(*) AS pages, CAST(SUM(total_amount) AS DOUBLE) AS amount, min(invoice_id) AS master, bool_or(invoice_id % 7 = 0) AS review FROM entries GROUP BY company_id, invoice_no HAVING COUNT(*) > 1")
def multipage_merge(m):
    """Pages of one number summed on the first; a page of low confidence asks for review."""
    d = m.entries.groupBy("company_id", "invoice_no").agg(F.count("*").alias("pages"), F.sum("total_amount").cast("double").alias("amount"), F.min("invoice_id").alias("master"), F.bool_or(c("invoice_id") % 7 == 0).alias("review"))
    return d.where("pages > 1").drop("company_id")
