"""Invoice text to header fields and item rows: lines are rows, documents are groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
NUMBER = r"-?\d+(?:\.\d+)?"
#: Words that mark a total, and lines that are no total although they say so.
TOTAL = r"(?i)\b(grand total|total|amount due)\b"
SKIP = r"(?i)\b(subtotal|tax|change)\b"


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, pos, line), one row for each line that isn't blank."""
    return docs.select("doc_id", F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line")).where(F.trim("line") != "")


def numbers(line: Column) -> Column:
    return F.transform(F.regexp_extract_all(line, F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))


def header(rows: DataFrame) -> DataFrame:
    """Supplier (first line), number, date and total of each document, from the first or last line that has them."""
    no = F.regexp_extract("line", r"(?i)invoice\s*(?:no|number|#)?[:.\s]*([A-Z]+-?\d+)", 1)
    date = F.regexp_extract("line", r"(\d{4}-\d{2}-\d{2})", 1)
    is_total = c("line").rlike(TOTAL) & ~c("line").rlike(SKIP)
    d = rows.withColumn("no", F.nullif(no, F.lit(""))).withColumn("date", F.nullif(date, F.lit(""))).withColumn("total", F.when(is_total, F.element_at(numbers(c("line")), -1)))
    return d.groupBy("doc_id").agg(
        F.min_by("line", "pos").alias("supplier"), F.min_by("no", F.when(c("no").isNotNull(), c("pos"))).alias("invoice_no"), F.min_by("date", F.when(c("date").isNotNull(), c("pos"))).alias("invoice_date"), F.max_by("total", F.when(c("total").isNotNull(), c("pos"))).alias("total")
    )


def item_lines(rows: DataFrame) -> DataFrame:
    """Item rows: lines before the first total with a name and two numbers or more.

    The last number is the amount, the one before it the price, the third from the end the quantity, or amount over price where there is none.
    A row of more than 1.1 times the total is dropped.
    """
    stop = rows.where(c("line").rlike(TOTAL) & ~c("line").rlike(SKIP)).groupBy("doc_id").agg(F.min("pos").alias("stop"), F.max_by(F.element_at(numbers(c("line")), -1), "pos").alias("doc_total"))
    d = rows.join(stop, "doc_id", "left").where(c("stop").isNull() | (c("pos") < c("stop"))).withColumn("n", numbers(c("line"))).withColumn("name", F.trim(F.regexp_extract("line", r"^([^0-9]+)", 1)))
    d = d.where((F.size("n") >= 2) & (c("name") != "") & ~c("line").rlike(r"(?i)invoice|\d{4}-\d{2}-\d{2}"))
    d = d.withColumn("amount", F.element_at("n", -1)).withColumn("price", F.element_at("n", -2)).withColumn("quantity", F.coalesce(F.get("n", F.size("n") - 3), F.try_divide("amount", "price")))
    return d.where(c("doc_total").isNull() | (c("amount") <= 1.1 * c("doc_total"))).select("doc_id", "pos", "name", "quantity", "price", "amount")


#: How numbers, totals and items are told in a text without a template, and the confidences with and without items.
NUMBERS = (r"(?i)\b(?:invoice\s*(?:#|no\.?|number)?|inv\s*(?:#|no\.?)?)\s*[:#-]?\s*([A-Z0-9][A-Z0-9._/-]*)", r"(?i)(?:发票号|單號|单号)\s*[:#：-]?\s*([A-Z0-9][A-Z0-9._/-]*)")
NO_NUMBER = r"(?i)^(no|number|date|total)$"
TOTALS = r"(?i)\bgrand\s+total\b|\bamount\s+due\b|\btotal\b|合计|總計|总计|應付金額|应付金额"
NO_TOTAL, SURE_TOTAL = r"(?i)\b(subtotal|tax|balance\s+forward)\b|小计|稅|税", r"(?i)\bgrand\s+total\b|\bamount\s+due\b|應付|应付"
MONEY = r"-?\$?\s*\d{1,3}(?:,\d{3})*(?:\.\d{2})|-?\$?\s*\d+(?:\.\d+)?"
NO_ITEM, SUPPLIER = r"(?i)total|subtotal|tax|invoice|date|合计|总计|小计|发票|日期", r"(?i)company|market|inc|公司|商行|供应"
WITH_ITEMS, WITHOUT_ITEMS, APART = 0.45, 0.2, 0.05


def fallback(docs: DataFrame, text: str = "text") -> DataFrame:
    """The fields of texts without a template: supplier, invoice_no, total, items, items_total, apart, confidence, row by row and without a shuffle.

    Supplier and number come from the first line that gives one, the total from the last; items are the lines with a name and two numbers or more. A null text gives
    empty fields and no items.
    """
    d = docs.withColumn("_l", F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""))

    def number(x: Column) -> Column:
        hits = [F.nullif(F.regexp_extract(x, p, 1), F.lit("")) for p in NUMBERS]
        return F.coalesce(*[F.when(~h.rlike(NO_NUMBER), h) for h in hits])

    def amount(x: Column) -> Column:
        money = F.regexp_replace(F.try_element_at(F.regexp_extract_all(x, F.lit(MONEY), F.lit(0)), F.lit(-1)), r"[$,\s]", "").try_cast("double")
        return F.when(x.rlike(TOTALS) & (~x.rlike(NO_TOTAL) | x.rlike(SURE_TOTAL)) & (money > 0), money)

    def item(x: Column) -> Column:
        n = F.transform(F.regexp_extract_all(x, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda v: v.try_cast("double"))
        last, price = F.try_element_at(n, F.lit(-1)), F.try_element_at(n, F.lit(-2))
        quantity = F.coalesce(F.get(n, F.size(n) - 3), F.when(price > 0, last / price).otherwise(0.0))
        name = F.trim(F.regexp_replace(F.regexp_extract(x, r"^([^0-9]*)[0-9]", 1), "[|,]", " "))
        return F.struct(name.alias("name"), quantity.alias("quantity"), price.alias("price"), last.alias("amount"), F.size(n).alias("n"))

    first = lambda values: F.coalesce(F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0)), F.lit(""))
    items = F.filter(F.transform(F.filter("_l", lambda x: ~x.rlike(NO_ITEM)), item), lambda i: (i["n"] >= 2) & (F.length(i["name"]) >= 2))
    d = d.withColumn("supplier", first(F.filter("_l", lambda x: x.rlike(SUPPLIER)))).withColumn("invoice_no", first(F.transform("_l", number)))
    totals = F.filter(F.transform("_l", amount), lambda v: v.isNotNull())
    d = d.withColumn("total", F.coalesce(F.try_element_at(totals, F.lit(-1)), F.lit(0.0))).withColumn("items", items).drop("_l")
    d = d.withColumn("items_total", F.aggregate("items", F.lit(0.0), lambda a, i: a + i["amount"]))
    apart = (c("total") > 0) & (c("items_total") > 0) & (F.abs(c("items_total") - c("total")) / c("total") > APART)
    return d.withColumn("apart", apart).withColumn("confidence", F.when(F.size("items") > 0, WITH_ITEMS).otherwise(WITHOUT_ITEMS))
