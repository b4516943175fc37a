"""Hand cases of text functions, predicates, costing, duplicates and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import encoding
from tallyforge.functions import text as T
from tallyforge.operators import costing, dedup, textparse
from tallyforge.operators import predicates as P
from tallyforge.operators.state import accept


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("r")).first().r


@pytest.mark.parametrize(
    "name,expected",
    [("box tofu", "boXtofu"), ("12.50 oz", "12.5oz"), ("24 x 12.0 OZ", "24X12oz"), ("  A,B  c ", "a b c")],
)
def test_product_name(spark, name, expected):
    assert one(spark, T.product_name(F.col("a")), a=name) == expected


@pytest.mark.parametrize("name,expected", [("12.50 oz", "12.5OZ"), ("24 x 12.0 OZ", "24X12OZ"), ("3 fl oz", "3FZ"), ("6 / 2 kg", "6/2KG")])
def test_unit_text(spark, name, expected):
    assert one(spark, T.unit_text(F.col("a")), a=name) == expected


@pytest.mark.parametrize("name,expected", [("ABC INC ABC INC", "Abc Inc."), ("FRESH FOOD FOOD", "Food"), ("ab trading co ltd", "AB Trading Co. Ltd."), ("公司", ""), ("A", "A")])
def test_supplier_english(spark, name, expected):
    assert one(spark, T.supplier_english(F.col("a")), a=name) == expected


@pytest.mark.parametrize("text,expected", [("06/01/2026", "2026-06-01"), ("2026/6/1", "2026-06-01"), ("2026-02-30", ""), ("1850-01-01", ""), ("soon", ""), (None, "")])
def test_invoice_date(spark, text, expected):
    assert one(spark, T.invoice_date(F.col("a")), a=text) == expected


@pytest.mark.parametrize("a,b,expected", [("a b", "a b", 1.0), ("tea", "green tea", 0.92), ("a b", "b c", 0.5)])
def test_token_similarity(spark, a, b, expected):
    assert one(spark, T.token_similarity(F.col("a"), F.col("b")), a=a, b=b) == expected


def test_encoding(spark):
    bad = "café".encode().decode("latin-1")
    fixed, damaged = encoding.repaired(F.col("a"))
    assert one(spark, fixed, a=bad) == "café" and one(spark, fixed, a="café") == "café" and one(spark, damaged, a=None) is False
    assert one(spark, encoding.unescaped(F.col("a")), a="\\u516c司") == "公司"


def test_predicates_treat_null_and_empty_alike(spark):
    rows = [(None, "APPROVED", "none"), ("", "confirmed", "none"), ("2024-01-01", "merged", "duplicate"), (None, None, None)]
    df = spark.createDataFrame(rows, "d string, s string, x string")
    got = df.select(P.live(F.col("d")), P.approved(F.col("s")), P.listable(F.col("s")), P.approved_for_stats(F.col("s"), F.col("x"))).collect()
    assert [tuple(r) for r in got] == [(True, True, True, True), (True, True, True, True), (False, False, False, False), (True, False, True, True)]


ITEM = "item_id string, invoice_id long, promo_group string, raw_name string, quantity decimal(18,2), total decimal(18,2), is_free boolean, candidate_only boolean"


def test_gift_and_discount_allocation(spark):
    from decimal import Decimal as D

    rows = [("a", 1, "g", "itoen tea", D(10), D(100), False, False), ("b", 1, "g", "itoen tea", D(2), D(0), True, False), ("c", 2, "h", "gift", D(2), D(0), True, False)]
    got = {r.item_id: r for r in costing.gift_allocation(spark.createDataFrame(rows, ITEM)).collect()}
    assert (got["a"].charged_qty, got["a"].free_qty, got["b"].total_qty, got["a"].original_cost) == (10.0, 2.0, 12.0, 10.0)
    assert round(got["b"].effective_cost, 4) == 8.3333 and got["c"].effective_cost == 0.0
    items = spark.createDataFrame([("a", 1, "g", "itoen tea", D(2), D(20), False, False), ("b", 1, "g", "milk", D(1), D(5), False, False)], ITEM)
    discounts = spark.createDataFrame([(1, "ITOEN discount", D(-4))], "invoice_id long, discount_name string, amount decimal(18,4)")
    got = {r.item_id: (r.discount, r.unit_cost) for r in costing.discount_allocation(items, discounts).collect()}
    assert got == {"a": (-4.0, 8.0), "b": (0.0, 5.0)}


def test_duplicate_classes(spark):
    names = ["same_number", "same_amount", "same_items", "close_date", "same_group", "same_supplier"]
    cases = {
        (True, True, True, True, False, True): "confirmed", (True, False, False, True, True, True): "multi_page", (True, True, False, True, False, True): "possible_pages",
        (True, True, True, False, False, True): "possible_date_conflict", (False, True, True, True, False, True): "possible_other_number", (False, True, False, True, False, True): "none",
        (True, False, True, True, False, True): "possible_amount", (True, True, True, True, True, False): "none",
    }
    df = spark.createDataFrame(list(cases), ", ".join(f"{n} boolean" for n in names))
    assert [r.c for r in df.select(dedup.classify(*[F.col(n) for n in names]).alias("c")).collect()] == list(cases.values())


def test_item_lines(spark):
    text = "Shop\nInvoice No: AB-77\n2026-06-01\nApple 2 10.00 20.00\nPear 3.00 9.00\nSubtotal 29\nTotal 29.00\nThanks 1 2"
    rows = textparse.lines(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"))
    got = [(r.name, r.quantity, r.price, r.amount) for r in textparse.item_lines(rows).orderBy("pos").collect()]
    assert got == [("Apple", 2.0, 10.0, 20.0), ("Pear", 3.0, 3.0, 9.0)]
    h = textparse.header(rows).first()
    assert (h.supplier, h.invoice_no, h.invoice_date, h.total) == ("Shop", "AB-77", "2026-06-01", 29.0)


def test_last_write_wins(spark):
    t = lambda k: datetime.datetime(2026, 1, k)
    schema = "id long, updated_at timestamp, v string"
    stored = spark.createDataFrame([(1, t(5), "old"), (2, t(5), "old"), (3, t(5), "old"), (4, t(5), "old")], schema)
    new = spark.createDataFrame([(1, t(4), "new"), (2, t(5), "new"), (3, t(6), "new"), (5, t(1), "new")], schema)
    got = {r.id: (r.v, r.conflict) for r in accept(stored, new).collect()}
    assert got == {1: ("old", True), 2: ("new", False), 3: ("new", False), 4: ("old", False), 5: ("new", False)}


def test_text_hash_of_empty_and_null_texts_equals_sql(spark, tmp_path):
    import duckdb

    from tallyforge import catalog

    spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "数量 é")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    con.execute("".join(f"CREATE VIEW {t} AS FROM '/root/testdata/sf0.001/{t}.parquet';" for t in ("customer", "orders", "lineitem", "part", "supplier", "events")))
    expected = con.execute("SELECT doc_id, hash FROM (" + catalog.oracle_sql()["fn_text_hash"] + ") ORDER BY 1").fetchall()
    assert [tuple(r) for r in catalog.queries()["fn_text_hash"](spark, str(tmp_path)).orderBy("doc_id").collect()] == expected
