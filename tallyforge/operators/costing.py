"""Cost allocation: free goods within a promotion group, discounts to matching lines, integrity of totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def gift_allocation(items: DataFrame) -> DataFrame:
    """Group totals and the diluted unit cost on every line of an invoice's promotion group.

    charged_qty, free_qty and total_qty repeat on each line of the group (summing them counts twice; line_qty is the line's own).
    The effective cost is the paid amount over all pieces, the original cost over the paid ones; with none they are 0.
    """
    w = Window.partitionBy("invoice_id", "promo_group")
    d = items.withColumn("charged_qty", F.sum(F.when(~c("is_free"), c("quantity")).otherwise(0)).over(w))
    d = d.withColumn("free_qty", F.sum(F.when(c("is_free"), c("quantity")).otherwise(0)).over(w)).withColumn("paid", F.sum("total").over(w).cast("double"))
    d = d.withColumn("charged_qty", c("charged_qty").cast("double")).withColumn("free_qty", c("free_qty").cast("double")).withColumn("line_qty", c("quantity").cast("double"))
    d = d.withColumn("total_qty", c("charged_qty") + c("free_qty"))
    return d.withColumn("original_cost", F.when(c("charged_qty") > 0, F.try_divide("paid", "charged_qty")).otherwise(0.0)).withColumn("effective_cost", F.when(c("total_qty") > 0, F.try_divide("paid", "total_qty")).otherwise(0.0))


def discount_matches(items: DataFrame, discounts: DataFrame) -> DataFrame:
    """Pairs of an invoice's discount and its lines whose name contains the discount's first brand word."""
    d = discounts.withColumn("token", F.element_at(F.filter(F.split(F.lower("discount_name"), r"\s+"), lambda t: ~t.isin("", "discount", "折扣")), 1))
    return items.join(d.select("invoice_id", "token", "amount"), "invoice_id").where(F.lower("raw_name").contains(c("token")))


def discount_allocation(items: DataFrame, discounts: DataFrame) -> DataFrame:
    """Each line with the sum of its matching discounts and its discounted unit cost; a discount counts in full on every match."""
    hit = discount_matches(items, discounts).groupBy("item_id").agg(F.sum("amount").cast("double").alias("discount"))
    d = items.join(hit, "item_id", "left").withColumn("discount", F.coalesce("discount", F.lit(0.0)))
    return d.withColumn("unit_cost", F.when(c("quantity") > 0, (c("total").cast("double") + c("discount")) / c("quantity").cast("double")).otherwise(0.0))


#: The difference of totals that is still accepted.
TOLERANCE = 0.05


def integrity(invoices: DataFrame, items: DataFrame, discounts: DataFrame) -> DataFrame:
    """Subtotal, discounts, expected total, difference, warnings and the review flag of each invoice."""
    i = items.groupBy("invoice_id").agg(F.sum("total").alias("subtotal"), F.count_if(~c("is_free") & ~c("candidate_only")).alias("n_valid"))
    d = discounts.groupBy("invoice_id").agg(F.sum("amount").alias("discount"))
    x = invoices.join(i, "invoice_id", "left").join(d, "invoice_id", "left").fillna(0, ["n_valid"])
    x = x.withColumn("subtotal", F.coalesce("subtotal", F.lit(0).cast("decimal(18,2)"))).withColumn("discount", F.coalesce("discount", F.lit(0).cast("decimal(18,4)")))
    x = x.withColumn("expected", (c("subtotal") + c("discount")).cast("double")).withColumn("difference", (c("total_amount") - c("subtotal") - c("discount")).cast("double"))
    w = F.array_compact(F.array(
        F.when(c("n_valid") == 0, "EMPTY_ITEMS"), F.when(F.abs("difference") > TOLERANCE, "AMOUNT_MISMATCH"), F.when(c("duplicate_status") == "possible", "POSSIBLE_MULTI_PAGE_OR_DUPLICATE")
    ))
    return x.withColumn("warnings", F.array_join(w, ",")).withColumn("needs_review", F.size(w) > 0)
