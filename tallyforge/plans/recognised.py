"""Recognition results in one shape, merged, and corrected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import recognition as R
from tallyforge.plans.registry import query

c = F.col

SHAPED = r"""shaped AS (SELECT b.invoice_id, CASE WHEN b.invoice_id % 13 = 0 THEN 'Grand YC ' || b.supplier_name ELSE b.supplier_name END AS supplier, CASE WHEN b.invoice_id % 5 = 0 THEN '' ELSE b.invoice_no END AS invoice_no,
    CASE WHEN b.invoice_id % 6 = 0 THEN '' ELSE CAST(b.invoice_date AS VARCHAR) END AS invoice_date, CAST(b.total_amount AS DOUBLE) AS total,
    CASE WHEN b.invoice_id % 4 = 1 THEN 'mixed' WHEN b.invoice_id % 13 = 0 THEN 'printed_catalog_handwritten' WHEN b.invoice_id % 7 = 0 THEN 'multi_page' WHEN b.invoice_id % 11 = 0 THEN 'printed_catalog_handwritten' ELSE 'normal_invoice' END AS layout,
    CASE WHEN b.invoice_id % 7 = 0 THEN 2 ELSE 0 END AS page, CASE WHEN b.invoice_id % 7 = 0 THEN 3 ELSE 0 END AS pages, CASE WHEN b.invoice_id % 9 = 0 THEN 'given' ELSE '' END AS given_key, b.invoice_id % 2 = 0 AS warned FROM invoices b),
counted AS (SELECT invoice_id, COUNT(*) AS n, COUNT(*) FILTER (line_no % 3 = 0 OR (line_no % 2 = 0 AND total > 0)) AS n_marked, COUNT(*) FILTER (unit_price = 0 OR total = 0) AS n_free, COUNT(*) FILTER ((line_no % 3 = 0 OR (line_no % 2 = 0 AND total > 0)) AND (unit_price = 0 OR total = 0)) AS n_free_marked FROM items GROUP BY 1),
final AS (SELECT s.*, CASE WHEN layout = 'printed_catalog_handwritten' THEN coalesce(n_marked, 0) ELSE coalesce(n, 0) END AS n_items, CASE WHEN layout = 'printed_catalog_handwritten' THEN coalesce(n_free_marked, 0) ELSE coalesce(n_free, 0) END AS free_items, coalesce(n, 0) AS n_all,
    CASE WHEN given_key <> '' THEN given_key ELSE array_to_string(list_filter([regexp_replace(lower(supplier), '[^a-z0-9.]+', '', 'g'), regexp_replace(lower(invoice_no), '[^a-z0-9.]+', '', 'g'), CAST(CAST(total AS DECIMAL(18,2)) AS VARCHAR)], lambda x: x <> ''), '|') END AS group_key,
    array_to_string(list_filter([CASE WHEN warned THEN 'blurred' END, CASE WHEN layout = 'printed_catalog_handwritten' AND coalesce(n, 0) > coalesce(n_marked, 0) THEN 'Printed catalog handwritten layout: filtered ' || (n - n_marked) || ' candidate-only rows.' END], lambda x: x IS NOT NULL), ' | ') AS warnings
  FROM shaped s LEFT JOIN counted c ON c.invoice_id = s.invoice_id)"""


def results(m) -> DataFrame:
    """A result for each invoice, with dates in three ways, layouts given or told by the text, and lines that someone marked."""
    k = c("invoice_id")
    item = F.struct(F.concat(F.lit(" "), "raw_name").alias("name"), F.when(c("line_no") % 2 == 0, c("quantity").cast("double")).alias("quantity"), c("unit_price").alias("price"), c("total").cast("double").alias("amount"), (c("line_no") % 3 == 0).alias("marked"))
    lines = m.items.groupBy("invoice_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "item_id", item.alias("i")))).alias("l"))
    d = m.invoices.join(lines, "invoice_id", "left")
    date = F.when(k % 6 == 0, "soon").when(k % 3 == 1, F.date_format("invoice_date", "M/d/yyyy")).when(k % 3 == 2, F.date_format("invoice_date", "yyyy/M/d")).otherwise(c("invoice_date").cast("string"))
    text = F.when(k % 7 == 0, F.lit("Order\r\n  Invoice Page No. 2 of 3 \nend")).when(k % 11 == 0, F.lit("tick what is 勾选")).otherwise(F.lit("page 1 of 2 pages"))
    return d.select(
        "invoice_id", F.when(k % 13 == 0, F.concat(F.lit("Grand YC "), "supplier_name")).otherwise(c("supplier_name")).alias("supplier"), F.when(k % 5 != 0, c("invoice_no")).alias("invoice_no"), date.alias("invoice_date"),
        c("total_amount").cast("double").alias("total"), F.when(k % 4 == 1, "mixed").when(k % 4 == 2, "unheard of").otherwise("normal_invoice").alias("layout"), F.when(k % 9 == 0, "given").alias("key"), text.alias("text"),
        F.when(k % 2 == 0, F.array(F.lit("blurred"))).alias("warnings"), F.when(k % 3 == 0, 0.5).alias("confidence"), F.transform("l", lambda x: x["i"]).alias("items"),
    )


@query("SELECT invoice_id, supplier, invoice_no, invoice_date, total, layout, CAST(page AS INTEGER) AS page, CAST(pages AS INTEGER) AS pages, group_key, warnings, CASE WHEN invoice_id % 3 = 0 THEN 0.5 ELSE 0 END::DOUBLE AS confidence, CAST(n_items AS INTEGER) AS n_items, CAST(free_items AS INTEGER) AS n_free FROM final", SHAPED)
def recognised_results(m):
    """Each result in one shape: date, layout, page, group key, lines that count, warnings."""
    d = R.normalised(results(m))
    free = F.size(F.filter("items", lambda i: i["is_free"]))
    return d.select("invoice_id", "supplier", "invoice_no", "invoice_date", "total", "layout", "page", "pages", c("key").alias("group_key"), F.array_join("warnings", " | ").alias("warnings"), "confidence", F.size("items").alias("n_items"), free.alias("n_free"))


@query(
    f"""SELECT invoice_id, CASE WHEN supplier = '' THEN 'Second' ELSE supplier END AS supplier, CASE WHEN invoice_no = '' THEN 'X' || invoice_id ELSE invoice_no END AS invoice_no, CASE WHEN invoice_date = '' THEN '2000-01-01' ELSE invoice_date END AS invoice_date,
  CASE WHEN total > 0 THEN total ELSE 7 END::DOUBLE AS total, CASE WHEN warnings = '' THEN '' ELSE warnings || ' | ' END || 'second | {R.SECOND_NOTE}' AS warnings, CASE WHEN invoice_id % 4 = 0 THEN 0.9 WHEN invoice_id % 3 = 0 THEN 0.5 ELSE 0.1 END::DOUBLE AS confidence, 'thing ' || invoice_id AS items FROM final""",
    SHAPED,
)
def recognised_merge(m):
    """The header of a result filled from a second source, which gives the items; the warnings of both, and the higher confidence."""
    first = R.normalised(results(m)).select("invoice_id", "supplier", "invoice_no", "invoice_date", "total", "layout", "key", "warnings", "confidence")
    k = c("invoice_id")
    second = m.base.select(
        "invoice_id", F.lit("Second").alias("supplier"), F.concat(F.lit("X"), k.cast("string")).alias("invoice_no"), F.lit("2000-01-01").alias("invoice_date"), F.lit(7.0).alias("total"), F.lit("").alias("layout"), F.lit("").alias("key"),
        F.array(F.lit("second")).alias("warnings"), F.when(k % 4 == 0, 0.9).otherwise(0.1).alias("confidence"), F.array(F.struct(F.concat(F.lit("thing "), k.cast("string")).alias("name"))).alias("items"),
    )
    d = R.merged(first, second, "invoice_id")
    return d.select("invoice_id", "supplier", "invoice_no", "invoice_date", "total", F.array_join("warnings", " | ").alias("warnings"), "confidence", F.array_join(F.transform("items", lambda i: i["name"]), ",").alias("items"))


CORRECTED = """placed AS (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY line_no, item_id, quantity, total) - 1 AS k FROM items),
changed AS (SELECT invoice_id, 'items.' || k || '.name' AS path, raw_name AS before, CASE WHEN line_no % 4 = 0 THEN upper(raw_name) ELSE raw_name END AS after FROM placed WHERE line_no <> 5
  UNION ALL SELECT invoice_id, 'items.' || k || '.quantity', CAST(quantity AS VARCHAR), CAST(CASE WHEN (invoice_id + line_no) % 6 = 0 THEN quantity + 1 ELSE quantity END AS VARCHAR) FROM placed WHERE line_no <> 5
  UNION ALL SELECT invoice_id, 'status', status, CASE WHEN invoice_id % 3 = 0 THEN 'CONFIRMED' ELSE status END FROM base
  UNION ALL SELECT invoice_id, 'invoice_no', CASE WHEN invoice_id % 8 = 0 THEN '' ELSE invoice_no END, invoice_no FROM base)"""


@query("SELECT invoice_id, path, before, after FROM changed WHERE before <> after AND invoice_id NOT IN (SELECT invoice_id FROM items WHERE line_no = 5)", CORRECTED)
def correction_rows(m):
    """What a person corrected in each invoice and in every line of it, by the path of the field."""
    def side(df, name, quantity, status, number):
        i = df.groupBy("invoice_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "item_id", "quantity", "total", F.struct(name.alias("name"), quantity.alias("quantity")).alias("i")))).alias("l"))
        d = m.base.select("invoice_id", status.alias("status"), number.alias("invoice_no")).join(i, "invoice_id", "left")
        return d.select("invoice_id", "status", "invoice_no", F.transform("l", lambda x: x["i"]).alias("items"))

    short = m.items.where("line_no = 5").select("invoice_id").distinct()
    items = m.items.select("invoice_id", "line_no", "item_id", "quantity", "total", "raw_name")
    k = c("invoice_id")
    before = side(items, c("raw_name"), c("quantity"), c("status"), F.when(k % 8 != 0, c("invoice_no")))
    after = side(
        items, F.when(c("line_no") % 4 == 0, F.upper("raw_name")).otherwise(c("raw_name")), F.when((k + c("line_no")) % 6 == 0, (c("quantity") + 1).cast("decimal(18,2)")).otherwise(c("quantity")),
        F.when(k % 3 == 0, "CONFIRMED").otherwise(c("status")), c("invoice_no"),
    )
    return R.corrections(before, after, "invoice_id", ["status", "invoice_no"], ["name", "quantity"]).join(short, "invoice_id", "left_anti")


@query("SELECT p_partkey AS product_id, CASE p_partkey % 5 WHEN 0 THEN '千页豆腐 ' WHEN 1 THEN '千页豆腐 ' WHEN 2 THEN '苹果 ' WHEN 3 THEN 'itoen ' ELSE '凤梨 ' END || trim(regexp_replace(lower(p_name), '\\s*x\\s*', 'X', 'g')) AS key FROM part".replace("\\\\", "\\"))
def fn_product_corrections(m):
    """Names that are often read wrongly have the key of what they are."""
    k = c("p_partkey")
    wrong = F.when(k % 5 == 0, "干页豆腐").when(k % 5 == 1, "仟页豆腐").when(k % 5 == 2, "蘋果").when(k % 5 == 3, F.when(k % 2 == 0, "Ito  En").otherwise("I T O E N")).otherwise("鳳梨")
    return m.table("part").select(k.alias("product_id"), T.product_name(F.concat_ws(" ", wrong, "p_name")).alias("key"))
