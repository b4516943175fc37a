"""Saving recognised invoices as a whole: what becomes of the invoice and its lines, what goes, and what is learned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
#: The difference of totals that is still accepted, and the deviation from the mean that makes a price an anomaly.
TOLERANCE, ANOMALY = 0.05, 0.30
#: Names that are no goods, and where the confidence of an alias and of a rule begins, by how much it rises, and where it ends.
NO_GOODS, NO_PRICE = ("", "remark", "remarks", "note", "notes", "memo", "subtotal", "total"), ("", "remark", "remarks", "note", "notes", "memo", "comment")
ALIAS, RULE = ("0.82", "0.02", "0.99"), ("0.75", "0.03", "1.00")


def saved(invoices: DataFrame, items: DataFrame, discounts: DataFrame) -> DataFrame:
    """One row an invoice: outcome (saved, forced, blocked), status, total_amount, calculated_total, difference and warnings.

    ``invoices`` has invoice_id, total_amount, status, warnings, duplicate (none, possible, duplicate) and force; ``items`` name, total, candidate_only; ``discounts``
    amount. A duplicate is blocked unless forced. A missing total is that of the lines. No goods, totals more than TOLERANCE apart and a possible duplicate ask
    for review; else the status that was asked for stands, and a plain save approves.
    """
    counts = ~c("candidate_only")
    i = items.groupBy("invoice_id").agg(
        F.sum(F.when(counts, c("total")).otherwise(0)).alias("subtotal"), F.sum("total").alias("all_lines"), F.count_if(counts & ~F.lower(F.trim(F.coalesce("name", F.lit("")))).isin(*NO_GOODS)).alias("goods")
    )
    d = discounts.groupBy("invoice_id").agg(F.sum("amount").alias("discount"))
    x = invoices.join(i, "invoice_id", "left").join(d, "invoice_id", "left")
    zero = F.lit(0).cast("decimal(18,4)")
    x = x.withColumn("subtotal", F.coalesce("subtotal", zero)).withColumn("discount", F.coalesce("discount", zero)).withColumn("goods", F.coalesce("goods", F.lit(0)))
    x = x.withColumn("total_amount", F.when(c("total_amount") > 0, c("total_amount")).otherwise(F.coalesce("all_lines", zero)))
    x = x.withColumn("apart", F.abs(c("total_amount") - c("subtotal") - c("discount"))).withColumn("difference", c("apart").cast("double"))
    found = F.array_compact(F.array(F.when(c("goods") == 0, "EMPTY_ITEMS"), F.when((c("total_amount") > 0) & (c("difference") > TOLERANCE), "AMOUNT_MISMATCH"), F.when(c("duplicate") == "possible", "POSSIBLE_MULTI_PAGE_OR_DUPLICATE")))
    text = F.concat_ws(" | ", F.nullif("warnings", F.lit("")), F.nullif(F.array_join(found, " | "), F.lit("")), F.when(c("difference") > TOLERANCE, F.concat(F.lit("totalDifference="), c("apart").cast("decimal(18,2)").cast("string"))))
    outcome = F.when((c("duplicate") == "duplicate") & ~c("force"), "blocked").when(c("duplicate") == "duplicate", "forced").otherwise("saved")
    asked = F.when(c("status").isin("saved", "PENDING_REVIEW") | (F.coalesce("status", F.lit("")) == ""), "APPROVED").otherwise(c("status"))
    status = F.when(F.size(found) > 0, "PENDING_REVIEW").otherwise(asked)
    ok = outcome != "blocked"
    return x.select(
        *[k for k in invoices.columns if k not in ("status", "warnings", "total_amount", "force")], outcome.alias("outcome"), F.when(ok, status).alias("status"), c("total_amount").cast("double").alias("total_amount"),
        c("subtotal").cast("double").alias("calculated_total"), "difference", F.when(ok, text).alias("warnings"),
    )


def priced(items: DataFrame, invoices: DataFrame) -> DataFrame:
    """The lines that make price rows: goods of approved invoices with a trusted name, a quantity, a price and a total."""
    ok = invoices.where(F.upper("status").isin("APPROVED", "CONFIRMED")).select("invoice_id")
    name = F.lower(F.trim(F.coalesce("name", F.lit(""))))
    good = ~c("is_free") & ~c("candidate_only") & c("trusted") & (c("quantity") > 0) & (c("price") > 0) & (c("total") > 0) & ~name.isin(*NO_PRICE)
    return items.where(good).join(ok, "invoice_id", "left_semi")


def tenths(price: Column) -> Column:
    """Whole ten-thousandths, so that any order of adding gives the same."""
    return F.floor(price * 10000)


def learned(stored: DataFrame, lines: DataFrame, keys: list[str], confidence: tuple[str, str, str]) -> DataFrame:
    """(keys, n, low, top, sum, confidence, is_new) of each key that the lines teach, on top of what is stored (keys, n, low, top, sum, confidence).

    The sum is in ten-thousandths; a key's confidence begins at the first value, rises by the second with each line, and ends at the third.
    """
    start, step, most = (F.lit(v).cast("decimal(6,2)") for v in confidence)
    new = lines.groupBy(*keys).agg(F.count("*").alias("dn"), F.min("price").alias("dlow"), F.max("price").alias("dtop"), F.sum(tenths(c("price"))).alias("dsum"))
    d = new.join(stored, keys, "left")
    sure = F.least(most, F.coalesce(c("confidence").cast("decimal(6,2)"), start) + step * c("dn").cast("decimal(18,0)")).cast("double")
    return d.select(
        *keys, (F.coalesce("n", F.lit(0)) + c("dn")).alias("n"), F.least("low", "dlow").alias("low"), F.greatest("top", "dtop").alias("top"), (F.coalesce("sum", F.lit(0)) + c("dsum")).alias("sum"), sure.alias("confidence"), c("n").isNull().alias("is_new")
    )


def anomalies(history: DataFrame, lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The lines whose price is more than ANOMALY from the mean of the stored prices and of the lines before them; ``history`` has the keys and price."""
    known = history.groupBy(*keys).agg(F.count("*").alias("hn"), F.sum(tenths(c("price"))).alias("hsum"))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = lines.withColumn("bn", F.count("*").over(w)).withColumn("bsum", F.coalesce(F.sum(tenths(c("price"))).over(w), F.lit(0))).join(known, keys, "left")
    n = F.coalesce("hn", F.lit(0)) + c("bn")
    mean = (F.coalesce("hsum", F.lit(0)) + c("bsum")).cast("double") / F.nullif(n, F.lit(0)) / 10000
    d = d.withColumn("mean", mean).withColumn("deviation", F.abs(c("price") - c("mean")) / c("mean"))
    return d.where((c("mean") > 0) & (c("deviation") > ANOMALY)).drop("hn", "hsum", "bn", "bsum")


def retired(stored: DataFrame, invoices: DataFrame) -> DataFrame:
    """The stored rows of invoices that are saved again: they are deleted before the new ones come."""
    return stored.join(invoices.where("outcome <> 'blocked'").select("invoice_id"), "invoice_id", "left_semi")
