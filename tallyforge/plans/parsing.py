"""Invoice texts: made from the tables' invoices as plain text, then parsed back to rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import textparse as X
from tallyforge.plans.registry import query

c = F.col


def texts(m):
    """The text of each invoice: supplier, number, date, its lines and a total."""
    line = F.concat_ws(" ", F.translate("raw_name", "#0123456789", ""), c("quantity").cast("decimal(18,0)").cast("string"), c("list_price").cast("decimal(18,0)").cast("string"), (c("list_price").cast("decimal(18,0)") * 2).cast("string"))
    i = m.items.groupBy("invoice_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "item_id", line.alias("t")))).alias("l"), F.sum(c("list_price").cast("decimal(18,0)") * 2).cast("string").alias("total"))
    b = m.base.join(i, "invoice_id")
    body = F.array_join(F.transform("l", lambda x: x["t"]), "\n")
    return b.select(c("invoice_id").alias("doc_id"), F.concat_ws("\n", F.concat(F.lit("Supplier "), F.translate("supplier_name", "#0123456789", "")), F.concat(F.lit("Invoice No: "), c("invoice_no")), F.concat(F.lit("Date "), c("invoice_date").cast("string")), F.lit(""), body, F.concat(F.lit("Grand Total "), c("total"))).alias("text"))


LINES = "tl AS (SELECT invoice_id AS doc_id, line_no, item_id, translate(raw_name, '#0123456789', '') AS name, CAST(CAST(quantity AS DECIMAL(18,0)) AS DOUBLE) AS quantity, CAST(CAST(list_price AS DECIMAL(18,0)) AS DOUBLE) AS price, CAST(CAST(list_price AS DECIMAL(18,0)) AS DOUBLE) * 2 AS amount FROM items), td AS (SELECT doc_id, SUM(amount) AS total, COUNT(*) AS n FROM tl GROUP BY 1)"


@query("SELECT b.invoice_id AS doc_id, 'Supplier Customer' AS supplier, b.invoice_no, CAST(b.invoice_date AS VARCHAR) AS invoice_date, td.total FROM base b JOIN td ON td.doc_id = b.invoice_id", LINES)
def doc_header_fields(m):
    return X.header(X.lines(texts(m)))


@query("SELECT doc_id, name, quantity, price, amount FROM tl", LINES)
def doc_item_lines(m):
    return X.item_lines(X.lines(texts(m))).select("doc_id", "name", "quantity", "price", "amount")


@query("SELECT doc_id, len(string_split(text, chr(10))) - len(list_filter(string_split(text, chr(10)), lambda x: trim(x) = '')) AS n_lines, regexp_extract(text, '\\+[0-9 ()-]+', 0) AS phone FROM documents WHERE trim(replace(text, chr(10), '')) <> ''".replace("\\\\", "\\"))
def doc_fallback_parse(m):
    """Without a template: the lines of a text and the first telephone number in it."""
    rows = X.lines(m.table("documents"))
    p = F.nullif(F.regexp_extract("line", r"(\+[0-9 ()-]+)", 1), F.lit(""))
    d = rows.withColumn("p", p).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.min_by("p", F.when(c("p").isNotNull(), c("pos"))).alias("phone"))
    return d.fillna("", ["phone"])


@query("SELECT td.doc_id, td.total, CASE WHEN td.doc_id % 6 = 0 THEN td.total * 0.9 ELSE td.total END AS items, CASE WHEN td.doc_id % 6 = 0 THEN CAST(0.45 AS DOUBLE) ELSE CAST(0.86 AS DOUBLE) END AS confidence FROM td", LINES)
def doc_total_check(m):
    """The parsed lines against the parsed total: over 5 percent apart lowers the confidence."""
    rows = X.lines(texts(m))
    items = X.item_lines(rows).groupBy("doc_id").agg(F.sum("amount").alias("items"))
    d = X.header(rows).join(items, "doc_id").withColumn("items", F.when(c("doc_id") % 6 == 0, c("items") * 0.9).otherwise(c("items")))
    return d.select("doc_id", "total", "items", F.when(F.abs(c("items") - c("total")) > 0.05 * c("total"), 0.45).otherwise(0.86).alias("confidence"))


@query("SELECT b.invoice_id AS doc_id, CASE WHEN b.invoice_id % 2 = 0 THEN 'Supplier Customer' ELSE b.supplier_name END AS supplier, CASE WHEN b.invoice_id % 3 = 0 THEN b.invoice_no ELSE 'INV-' || b.invoice_id END AS invoice_no, td.n AS n_items FROM base b JOIN td ON td.doc_id = b.invoice_id", LINES)
def header_merge(m):
    """Header fields of one source filled from a second, which also gives the items."""
    rows = X.lines(texts(m))
    first = X.header(rows).withColumn("supplier", F.when(c("doc_id") % 2 == 0, c("supplier")).otherwise("")).withColumn("invoice_no", F.when(c("doc_id") % 3 == 0, c("invoice_no")))
    second = m.base.select(c("invoice_id").alias("doc_id"), c("supplier_name").alias("s2"), c("invoice_no").alias("n2"))
    n = X.item_lines(rows).groupBy("doc_id").agg(F.count("*").alias("n_items"))
    d = first.join(second, "doc_id").join(n, "doc_id")
    return d.select("doc_id", F.coalesce(F.nullif("supplier", F.lit("")), "s2").alias("supplier"), F.coalesce(F.nullif("invoice_no", F.lit("")), "n2").alias("invoice_no"), "n_items")


@query("SELECT invoice_id AS doc_id, COUNT(*) AS n_items, CAST(SUM(quantity) AS DOUBLE) AS quantity, max(total) > 0 AS priced FROM items GROUP BY 1")
def result_normalize(m):
    """A recognition result in JSON is decoded by a schema, its items brought to one shape."""
    item = F.struct(c("raw_name").alias("name"), c("quantity").cast("string").alias("qty"), c("total").cast("string").alias("price"))
    docs = m.items.groupBy("invoice_id").agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("json"))
    got = docs.select("invoice_id", F.from_json("json", "items array<struct<name:string,qty:string,price:string>>").alias("r"))
    shape = F.transform("r.items", lambda x: F.struct(F.trim(x["name"]).alias("name"), F.coalesce(x["qty"].try_cast("decimal(18,2)"), F.lit(0)).alias("q"), F.coalesce(x["price"].try_cast("double"), F.lit(0.0)).alias("p")))
    d = got.select(c("invoice_id").alias("doc_id"), F.explode(shape).alias("i"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.sum("i.q").cast("double").alias("quantity"), (F.max("i.p") > 0).alias("priced"))


WORDS = "kw AS (SELECT s_suppkey AS template_id, s_suppkey % 7 AS uses, CASE s_suppkey % 5 WHEN 0 THEN 'tion' WHEN 1 THEN 'keit' WHEN 2 THEN 'mente' WHEN 3 THEN 'eaux' ELSE 'zzz' END AS word FROM supplier)"


@query("SELECT doc_id, template_id FROM (SELECT d.doc_id, t.template_id, row_number() OVER (PARTITION BY d.doc_id ORDER BY t.uses DESC, t.template_id) AS rn FROM documents d JOIN (SELECT word, arg_max(template_id, uses * 100000 - template_id) AS template_id, max(uses) AS uses FROM kw GROUP BY word) t ON contains(d.text, t.word)) WHERE rn = 1", WORDS)
def template_match(m):
    """The first template, by successes, one of whose keywords a text contains.

    Of the templates of one keyword only the best can win, so a text meets each distinct keyword once.
    """
    t = m.table("supplier").selectExpr("s_suppkey as template_id", "s_suppkey % 7 as uses", "case s_suppkey % 5 when 0 then 'tion' when 1 then 'keit' when 2 then 'mente' when 3 then 'eaux' else 'zzz' end as word")
    best = t.groupBy("word").agg(F.max(F.struct("uses", (-c("template_id")).alias("k"))).alias("b"))
    words = best.agg(F.collect_list(F.struct("word", "b.uses", "b.k")).alias("words"))  # one row for each of the few keywords
    hit = F.filter("words", lambda w: F.col("text").contains(w["word"]))
    top = F.array_max(F.transform(hit, lambda w: F.struct(w["uses"], w["k"])))
    d = m.table("documents").crossJoin(F.broadcast(words)).select("doc_id", (-top["k"]).alias("template_id"))
    return d.where("template_id is not null")


@query("""SELECT id AS template_id, COUNT(*) FILTER (NOT deleted) AS hits, COUNT(*) FILTER (deleted) AS misses, COUNT(*) FILTER (deleted) >= 3 AND COUNT(*) FILTER (NOT deleted) = 0 AS inactive,
  CAST(list_reduce(list_prepend(75, list(CASE WHEN deleted THEN -8 ELSE 2 END ORDER BY updated_at, change_id)), lambda a, x: greatest(0, least(100, a + x))) AS DOUBLE) / 100 AS score FROM feed GROUP BY 1""")
def template_scores(m):
    """A running score: +0.02 for a hit, -0.08 for a miss, kept from 0 to 1; three misses without a hit end a template."""
    step = F.when(c("deleted"), -8).otherwise(2)
    d = m.feed.groupBy(c("id").alias("template_id")).agg(F.count_if(~c("deleted")).alias("hits"), F.count_if("deleted").alias("misses"), F.array_sort(F.collect_list(F.struct("updated_at", "change_id", step.alias("s")))).alias("e"))
    score = F.aggregate("e", F.lit(75), lambda a, x: F.greatest(F.lit(0), F.least(F.lit(100), a + x["s"])))
    return d.select("template_id", "hits", "misses", ((c("misses") >= 3) & (c("hits") == 0)).alias("inactive"), (score / 100).alias("score"))


PLAIN = """plain AS (SELECT b.invoice_id AS doc_id, CASE WHEN b.invoice_id % 3 = 0 THEN '' ELSE 'Market ' || b.supplier_name END AS supplier,
  CASE b.invoice_id % 5 WHEN 0 THEN '' WHEN 1 THEN b.invoice_no WHEN 2 THEN 'B' || b.invoice_id WHEN 3 THEN CAST(b.invoice_id AS VARCHAR) ELSE 'B' || b.invoice_id END AS invoice_no,
  CASE WHEN b.invoice_id % 7 = 0 THEN 0 WHEN b.invoice_id % 4 = 0 THEN 2 * s.amount ELSE s.amount END AS total, CASE WHEN b.invoice_id % 11 = 0 THEN 0 ELSE s.n END AS n, CASE WHEN b.invoice_id % 11 = 0 THEN 0 ELSE s.amount END AS amount
  FROM base b JOIN (SELECT invoice_id, SUM(CAST(CAST(list_price AS DECIMAL(18,0)) AS DOUBLE) * 2) AS amount, COUNT(*) AS n FROM items GROUP BY 1) s ON s.invoice_id = b.invoice_id)"""


@query(
    "SELECT doc_id, supplier, invoice_no, CAST(total AS DOUBLE) AS total, CAST(n AS INTEGER) AS n_items, CAST(amount AS DOUBLE) AS items_total, total > 0 AND amount > 0 AND abs(amount - total) / total > 0.05 AS apart, CASE WHEN n > 0 THEN 0.45 ELSE 0.2 END::DOUBLE AS confidence FROM plain",
    PLAIN,
)
def fallback_parse(m):
    """Texts without a template: supplier, number (hyphens and colons as separators), total, items, and how sure that is."""
    price = c("list_price").cast("decimal(18,0)")
    line = F.concat_ws(" ", F.translate("raw_name", "#0123456789", ""), c("quantity").cast("decimal(18,0)").cast("string"), price.cast("string"), (price * 2).cast("string"))
    i = m.items.groupBy("invoice_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "item_id", line.alias("t")))).alias("l"), F.sum(price * 2).alias("sum"))
    k = c("invoice_id")
    who = F.when(k % 3 == 0, "To whom it concerns").otherwise(F.concat(F.lit("Market "), "supplier_name"))
    number = (
        F.when(k % 5 == 0, "Invoice Date").when(k % 5 == 1, F.concat(F.lit("INVOICE # "), "invoice_no")).when(k % 5 == 2, F.concat(F.lit("单号-B"), k.cast("string")))
        .when(k % 5 == 3, F.concat(F.lit("inv no. "), k.cast("string"), F.lit(" page"))).otherwise(F.concat(F.lit("發 單號：B"), k.cast("string")))
    )
    body = F.when(k % 11 == 0, "no goods").otherwise(F.array_join(F.transform("l", lambda x: x["t"]), "\n"))
    total = F.when(k % 4 == 0, c("sum") * 2).otherwise(c("sum")).cast("string")
    last = F.when(k % 7 == 0, F.concat(F.lit("Subtotal "), total)).when(k % 2 == 0, F.concat(F.lit("Amount due: $"), total, F.lit("\nTotal tax 12.50"))).otherwise(F.concat(F.lit("合计 "), total))
    docs = m.base.join(i, "invoice_id").select(k.alias("doc_id"), F.concat_ws("\r\n", who, number, body, last).alias("text"))
    return X.fallback(docs).select("doc_id", "supplier", "invoice_no", "total", F.size("items").alias("n_items"), "items_total", "apart", "confidence")
