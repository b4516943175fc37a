"""Duplicate invoices: candidates by equi-joins, classes of a pair, one verdict per invoice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def signatures(items: DataFrame) -> DataFrame:
    """Sorted ``name:quantity:amount`` of an invoice's paid lines, joined by bars, and their number."""
    s = F.concat_ws(":", F.lower("raw_name"), c("quantity").cast("string"), c("total").cast("string"))
    d = items.where("not is_free").groupBy("invoice_id").agg(F.array_sort(F.collect_list(s)).alias("parts"))
    return d.select("invoice_id", F.array_join("parts", "|").alias("signature"), F.size("parts").alias("n_paid"))


def candidates(entries: DataFrame, sides: list[str]) -> DataFrame:
    """Pairs (x, y) with x after y: the same number in a tenant, or the same supplier and nearly the same amount and date.

    Amounts meet in the same or a neighbouring cent, so both conditions are equi-joins; the second leaves out what the first
    finds, so no pair comes twice and none is compared as a whole.
    """
    left = entries.select(*[c(k).alias(f"x_{k}") for k in sides])
    right = entries.select(*[c(k).alias(f"y_{k}") for k in sides])
    after = c("x_invoice_id") > c("y_invoice_id")
    by_number = left.join(right, (c("x_company_id") == c("y_company_id")) & (c("x_invoice_no") == c("y_invoice_no")) & after)
    near = left.withColumn("cents", F.explode(F.expr("sequence(cast(x_total_amount * 100 as bigint) - 1, cast(x_total_amount * 100 as bigint) + 1)")))
    close = (F.abs(F.datediff("x_invoice_date", "y_invoice_date")) <= 1) & (F.abs(c("x_total_amount") - c("y_total_amount")) < 0.01)
    by_amount = near.join(right.withColumn("y_cents", F.expr("cast(y_total_amount * 100 as bigint)")), (c("x_company_id") == c("y_company_id")) & (c("x_supplier_id") == c("y_supplier_id")) & (c("cents") == c("y_cents")) & after & close & (c("x_total_amount") > 0) & ~F.coalesce(c("x_invoice_no") == c("y_invoice_no"), F.lit(False)))
    return by_number.union(by_amount.drop("cents", "y_cents"))


def classify(same_number: Column, same_amount: Column, same_items: Column, close_date: Column, same_group: Column, same_supplier: Column) -> Column:
    """The class of a pair; the order of the tests matters."""
    return (
        F.when(~same_supplier, "none")
        .when(~same_number, F.when(same_amount & same_items & close_date, "possible_other_number").otherwise("none"))
        .when(~close_date, "possible_date_conflict")
        .when(~same_items, F.when(same_group, "multi_page").otherwise("possible_pages"))
        .when(same_amount, "confirmed")
        .otherwise("possible_amount")
    )


def strict(same_number: Column, same_amount: Column, close_date: Column, same_supplier: Column) -> Column:
    """The older comparison: number, supplier, amount and date all agree."""
    return F.when(same_number & same_supplier & same_amount & close_date, "duplicate").otherwise("none")


def verdict(pairs: DataFrame) -> DataFrame:
    """One class for each invoice: the first confirmed pair in order, then pages, then whatever else groups it."""
    rank = F.when(c("cls") == "confirmed", 0).when(c("cls") == "multi_page", 1).otherwise(2)
    w = Window.partitionBy("x_invoice_id").orderBy(rank, c("y_invoice_date").desc(), c("y_invoice_id").desc())
    return pairs.where("cls <> 'none' and cls <> 'possible_other_number'").withColumn("rn", F.row_number().over(w)).where("rn = 1").select(c("x_invoice_id").alias("invoice_id"), c("y_invoice_id").alias("other"), "cls")
