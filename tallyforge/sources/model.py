"""The invoice model over the driver tables: suppliers, invoices, items, discounts, price history and feeds.

Every DataFrame is lazy and reads only the columns it needs; money is decimal until the last step.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


class Model:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def suppliers(self) -> DataFrame:
        """Invoice-level suppliers: the customers, each in its nation's company."""
        return self.table("customer").selectExpr(
            "cast(c_nationkey as string) as company_id", "c_custkey as supplier_id", "c_name as name", "c_mktsegment as segment",
            "concat(c_name, ' ', lower(c_mktsegment), ' ', case when c_custkey % 3 = 0 then 'INC' else 'CO LTD' end) as display_name",
            "c_custkey % 29 = 0 as deleted",
        )

    @cached_property
    def base(self) -> DataFrame:
        """Invoices without their totals."""
        o = self.table("orders").join(self.table("customer").select("c_custkey", "c_nationkey", "c_name"), F.expr("o_custkey = c_custkey"))
        return o.selectExpr(
            "o_orderkey as invoice_id", "cast(c_nationkey as string) as company_id", "o_custkey as supplier_id", "c_name as supplier_name",
            "concat('INV-', o_orderkey) as invoice_no", "cast(o_orderdate as date) as invoice_date",
            "case o_orderstatus when 'F' then 'APPROVED' when 'O' then 'PENDING_REVIEW' else 'saved' end as status",
            "case when o_orderkey % 23 = 0 then 'duplicate' when o_orderkey % 13 = 0 then 'possible' else 'none' end as duplicate_status",
            "case when o_orderkey % 17 = 0 then 'POSSIBLE_MULTI_PAGE_OR_DUPLICATE' else '' end as warnings",
            "o_orderkey % 19 = 0 as deleted",
            "case o_orderkey % 7 when 0 then 'pending' when 1 then 'failed' when 2 then 'conflict' else 'synced' end as sync_status",
            "concat('B-', date_format(o_orderdate, 'yyyyMMdd')) as batch_id",
        )

    @cached_property
    def lines(self) -> DataFrame:
        """Invoice lines without what their part says; lines with the highest discount are free goods."""
        return self.table("lineitem").selectExpr(
            "md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(cast(l_quantity as decimal(18,2)) as string), cast(cast(l_extendedprice as decimal(18,2)) as string))) as item_id",
            "l_orderkey as invoice_id", "l_linenumber as line_no", "l_partkey as product_id", "l_suppkey as supplier_id",
            f"cast(l_quantity as {MONEY}) as quantity", f"cast(l_extendedprice as {MONEY}) as list_price", "cast(l_discount as decimal(4,2)) as discount_rate",
            "l_discount = 0.1D as is_free",
            f"cast(case when l_discount = 0.1D then 0 else l_extendedprice end as {MONEY}) as total",
            "case when l_discount = 0.1D then 0D else l_extendedprice / l_quantity end as unit_price",
            "l_returnflag = 'R' as candidate_only", "cast(l_shipdate as date) as ship_date",
        )

    @cached_property
    def items(self) -> DataFrame:
        """The lines with their part's names; a part's type is its promotion group."""
        part = self.table("part").selectExpr("p_partkey as product_id", "concat(p_brand, ' ', p_name) as raw_name", "p_brand as brand", "p_type as promo_group")
        return self.lines.join(part, "product_id")

    @cached_property
    def sums(self) -> DataFrame:
        """Totals of the lines by invoice; every line has a part, so the parts aren't read."""
        return self.lines.groupBy("invoice_id").agg(F.sum("total").alias("item_total"), F.count("*").alias("n_items"))

    @cached_property
    def invoices(self) -> DataFrame:
        """Invoices with their totals; every fifth total is one too high, invoices without lines have the total 0 or 1."""
        b = self.base.join(self.sums, "invoice_id", "left")
        return b.selectExpr(
            "*", f"cast(coalesce(item_total, 0) + case when invoice_id % 5 = 0 then 1 else 0 end as {MONEY}) as total_amount",
            f"cast(coalesce(item_total, 0) as {MONEY}) as calculated_total", "case when invoice_id % 5 = 0 then 1.0D else 0.0D end as total_difference",
        ).drop("item_total")

    @cached_property
    def discounts(self) -> DataFrame:
        """One discount line for each invoice with discounted lines."""
        d = self.items.where("not is_free").groupBy("invoice_id").agg(F.sum(F.expr("list_price * discount_rate")).alias("s"), F.min("brand").alias("brand"))
        return d.where("s > 0").selectExpr("invoice_id", "concat(brand, ' discount') as discount_name", "cast(-s as decimal(18,4)) as amount")

    @cached_property
    def bare_prices(self) -> DataFrame:
        """The price history without the products' names, so the parts aren't read; every line has a part."""
        inv = self.base.where("status = 'APPROVED' and not deleted").select("invoice_id", "company_id", "invoice_date", "invoice_no")
        return self.lines.where("not is_free and not candidate_only and quantity > 0").join(inv, "invoice_id").selectExpr(
            "item_id", "company_id", "supplier_id", "product_id", "unit_price as price", "quantity", "total", "invoice_date", "invoice_id", "invoice_no", "line_no",
        )

    @cached_property
    def prices(self) -> DataFrame:
        """Price history: paid lines of approved live invoices."""
        inv = self.base.where("status = 'APPROVED' and not deleted").select("invoice_id", "company_id", "invoice_date", "invoice_no")
        return self.items.where("not is_free and not candidate_only and quantity > 0").join(inv, "invoice_id").selectExpr(
            "item_id", "company_id", "supplier_id", "product_id", "raw_name as product_name", "unit_price as price", "quantity", "total",
            "invoice_date", "invoice_id", "invoice_no", "line_no",
        )

    @cached_property
    def entries(self) -> DataFrame:
        """Invoices and a copy of every tenth, dated up to two days later."""
        i = self.invoices.where("not deleted").withColumn("copy", F.lit(False))
        c = i.where("invoice_id % 10 = 0").withColumn("invoice_date", F.expr("date_add(invoice_date, cast(invoice_id % 3 as int))")).withColumn("invoice_id", F.expr("invoice_id + 1000000000")).withColumn("copy", F.lit(True))
        return i.union(c)

    @cached_property
    def feed(self) -> DataFrame:
        """The change feed: one change of a user's record for each event."""
        return self.table("events").selectExpr(
            "event_id as change_id", "user_id as id", "cast(ts as timestamp) as updated_at", "value", "event_type = 'error' as deleted", "event_type",
            "concat('dev-', cast(get_json_object(props, '$.k') as int) % 5) as device_id",
        )

    @cached_property
    def tasks(self) -> DataFrame:
        """Recognition tasks: the events of a day are a batch."""
        return self.table("events").selectExpr(
            "event_id as task_id", "cast(ts as timestamp) as created_at", "date_format(ts, 'yyyy-MM-dd') as batch",
            "case when event_type in ('purchase', 'view', 'click') then 'completed' when event_type = 'error' then 'failed' else 'queued' end as status",
            "case event_type when 'view' then 'template' when 'click' then 'ai' when 'purchase' then 'ocr' else 'none' end as source",
            "props as result_json", "value",
        )
