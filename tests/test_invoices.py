"""Templates, search, imports, saving and differences on small tables, against plain Python."""

import datetime
import random
import re
from decimal import Decimal

from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import imports as I
from tallyforge.operators import saving as S
from tallyforge.operators import search as Q
from tallyforge.operators import state
from tallyforge.operators import templates as X
from tallyforge.operators import textparse as P

AT = datetime.datetime(2024, 1, 1)
TEMPLATES = "company_id string, template_id long, supplier_name string, supplier_keywords array<string>, success_count long, updated_at timestamp, is_active boolean"


def test_the_first_template_wins_among_thousands(spark, monkeypatch):
    r = random.Random(1)
    names = ["".join(r.choices("abcd ", k=r.randrange(1, 6))) for _ in range(1500)]
    rows = [(str(k % 3), k, n, [r.choice(names), ""], r.randrange(4), AT + datetime.timedelta(days=r.randrange(3)), k % 7 != 0) for k, n in enumerate(names)]
    docs = [(str(k % 4), k, "".join(r.choices("abcd .", k=r.randrange(0, 9)))) for k in range(300)] + [("0", 999, None)]
    monkeypatch.setattr(X, "AUTOMATON", 2000)  # several automata
    got = {d.doc_id: d.template_id for d in X.matched(spark.createDataFrame(docs, "company_id string, doc_id long, text string"), spark.createDataFrame(rows, TEMPLATES)).collect()}

    def key(x):  # the supplier key of such names
        return re.sub("[^A-Z0-9]+", "", x.upper())

    expected = {}
    for company, doc, text in docs:
        hits = [t for t in rows if text and t[0] == company and t[6] and any(k.strip() and (k.lower() in text.lower() or key(k) and key(k) in key(text)) for k in [t[2], *t[3]])]
        if hits:
            expected[doc] = min(hits, key=lambda t: (-t[4], -t[5].timestamp(), t[1]))[1]
    assert got == expected and len(expected) > 100


def test_template_fields(spark):
    lines = "ACME Inc\r\nInvoice No: A:12#3\nDate 2024/2/3\nItem Qty\nTea | green 2 3.5 7\nMilk 4 20\nx 1 1\nBig 1 900 900\nnothing\nSubtotal 27\nGrand Total 28"
    row = (lines, 1, "", ["", "acme"], ["qty"], ["invoice no"], ["date"], ["grand total"])
    schema = "text string, template_id long, supplier_name string, supplier_keywords array<string>, header_keywords array<string>, number_keywords array<string>, date_keywords array<string>, total_keywords array<string>"
    none = (None, None, None, None, None, None, None, None)
    bare = ("Item Qty\nno goods", *row[1:])
    got = X.parsed(spark.createDataFrame([row, none, bare, ("x", *row[1:])], schema)).collect()
    assert [g.status for g in got] == ["ok", "no template", "no items", "no header"]
    g = got[0]
    assert (g.supplier, g.invoice_no, g.invoice_date, g.total, g.items_total, g.warning, g.confidence) == ("acme", "A:12:3", "2024-02-03", 28.0, 27.0, False, 0.86)
    assert [(i.name, i.quantity, i.price, i.amount) for i in g["items"]] == [("Tea   green", 2.0, 3.5, 7.0), ("Milk", 5.0, 4.0, 20.0)]


def test_fallback(spark):
    docs = [("Fine Market\nInvoice: INV-7\nTea 2 3 6\nTotal tax 1\nTotal 1,006.00",), (None,), ("單號-77\nx 5 5\nab 5 5",)]
    got = P.fallback(spark.createDataFrame(docs, "text string")).collect()
    assert [(g.supplier, g.invoice_no, g.total, len(g["items"]), g.apart, g.confidence) for g in got] == [("Fine Market", "INV-7", 1006.0, 1, True, 0.45), ("", "", 0.0, 0, False, 0.2), ("", "77", 0.0, 1, False, 0.45)]


def test_search_equals_a_full_scan(spark):
    r = random.Random(2)
    text = lambda n: "".join(r.choices("ab1/ 公é", k=r.randrange(0, n)))
    rows = [(k, text(12), text(12)) for k in range(200)] + [(500, "\\u516c x", "")]
    asked = [(k, q) for k, q in enumerate([text(5) for _ in range(60)] + ["", " ", "公", "A 1", "\\u516c"])]
    names = [F.col("a"), F.col("b")]
    records = spark.createDataFrame(rows, "id long, a string, b string").select("id", Q.searchable(names).alias("text"))
    got = {tuple(x) for x in Q.found(spark.createDataFrame(asked, "q long, t string"), "t", records, "id", "text", Q.index(records, "id", "text")).select("q", "id").collect()}
    shown = {x.id: x.text for x in records.collect()}
    norm = {x.q: x.n for x in spark.createDataFrame(asked, "q long, t string").select("q", T.product_name(F.trim("t")).alias("n")).collect()}
    escape = lambda s: "".join(c if c.isascii() else f"\\u{ord(c):04x}" for c in s)
    expected = {(k, i) for k, q in asked for i, t in shown.items() if any(f and f.lower() in t for f in (q.strip(), norm[k], escape(q.strip()), escape(norm[k])))}
    assert got == expected and len(expected) > 200


def test_escaped(spark):
    assert spark.createDataFrame([("a公\U0001f600",)], "x string").select(Q.escaped(F.col("x"))).first()[0] == "a\\u516c\\ud83d\\ude00"


def test_pages_and_groups(spark):
    minute = lambda k: AT + datetime.timedelta(minutes=k)
    rows = [
        (1, 1, 10, minute(0), "Scan_p2of3.jpg", "h1"), (1, 1, 11, minute(5), "Scan_p1of3.jpg", "h2"), (1, 1, 12, minute(36), "Scan_p3of3.jpg", "h1"), (1, 2, 13, minute(6), "plain.png", "h2"),
        (2, 3, 14, minute(0), "3/5.tif", ""), (2, 3, 15, minute(30), None, None), (1, 1, 16, minute(36), "a 页2", ""),
    ]
    d = I.pages(spark.createDataFrame(rows, "company_id long, user_id long, file_id long, at timestamp, name string, hash string"))
    got = {p.file_id: (p.session, p.page_index, p.page_number, p.page_count, p.status, p.group) for p in d.collect()}
    assert got == {
        10: (10, 1, 2, 3, "waiting", "Scan"), 11: (10, 2, 1, 3, "waiting", "Scan"), 12: (12, 1, 3, 3, "skipped_duplicate", "Scan"), 13: (13, 1, 0, 0, "skipped_duplicate", "file:13"),
        14: (14, 1, 3, 5, "waiting", "3/5"), 15: (14, 2, 0, 0, "waiting", "file:15"), 16: (12, 2, 2, 0, "waiting", "a"),
    }
    groups = {(g.session, g.group): (g.n_pages, g.files, g.copies, g.confidence) for g in I.groups(d).collect()}
    assert groups[10, "Scan"] == (2, "10,11", 0, 0.55) and groups[13, "file:13"] == (1, "13", 1, 0.2)


def test_saving_cases(spark):
    """A clean save, no lines, totals apart, mixed rows, a duplicate and a forced one, a possible copy."""
    d = Decimal
    invoices = [(1, d(30), "", "", "none", False), (2, d(12), "saved", "", "none", False), (3, d(99), None, "blur", "none", False), (4, d(8), "CONFIRMED", "", "none", False), (5, d(10), "", "", "duplicate", False), (6, d(10), "", "", "duplicate", True), (7, d(10), "", "", "possible", False), (8, d(0), "", "", "none", False)]
    items = [(1, "Apple", d(20), False), (1, "Banana", d(10), False), (3, "Pear", d(10), False), (4, "Fig", d(10), False), (4, "Free", d(0), False), (4, "Maybe", d(100), True), (5, "A", d(10), False), (6, "A", d(10), False), (7, "A", d(10), False), (8, "A", d(7), False)]
    got = {
        r.invoice_id: (r.outcome, r.status, r.total_amount, r.difference, r.warnings)
        for r in S.saved(
            spark.createDataFrame(invoices, "invoice_id long, total_amount decimal(18,2), status string, warnings string, duplicate string, force boolean"),
            spark.createDataFrame(items, "invoice_id long, name string, total decimal(18,2), candidate_only boolean"), spark.createDataFrame([(4, d(-2))], "invoice_id long, amount decimal(18,4)"),
        ).collect()
    }
    assert got == {
        1: ("saved", "APPROVED", 30.0, 0.0, ""), 2: ("saved", "PENDING_REVIEW", 12.0, 12.0, "EMPTY_ITEMS | AMOUNT_MISMATCH | totalDifference=12.00"),
        3: ("saved", "PENDING_REVIEW", 99.0, 89.0, "blur | AMOUNT_MISMATCH | totalDifference=89.00"), 4: ("saved", "CONFIRMED", 8.0, 0.0, ""), 5: ("blocked", None, 10.0, 0.0, None), 6: ("forced", "APPROVED", 10.0, 0.0, ""),
        7: ("saved", "PENDING_REVIEW", 10.0, 0.0, "POSSIBLE_MULTI_PAGE_OR_DUPLICATE"), 8: ("saved", "APPROVED", 7.0, 0.0, ""),
    }


def test_lessons_go_on_from_what_is_stored(spark):
    stored = spark.createDataFrame([("a", 10, 1.0, 5.0, 300_000, 0.98)], "k string, n long, low double, top double, sum long, confidence double")
    lines = spark.createDataFrame([("a", 0.5), ("a", 6.0), ("b", 2.0)], "k string, price double")
    got = {r.k: tuple(r)[1:] for r in S.learned(stored, lines, ["k"], S.ALIAS).collect()}
    assert got == {"a": (12, 0.5, 6.0, 365_000, 0.99, False), "b": (1, 2.0, 2.0, 20_000, 0.84, True)}


def test_differences(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, None, 3.0), (4, "d", 4.0)], "k long, x string, y double")
    new = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, None, 3.0), (5, "e", 5.0)], "k long, x string, y double")
    got = {tuple(r) for r in state.differences(old, new, "k", ["x", "y"]).select("k", "kind", "old_x", "old_y", "new_x", "new_y").collect()}
    assert got == {(2, "update", "b", None, "b", 2.0), (4, "delete", "d", 4.0, None, None), (5, "insert", None, None, "e", 5.0)}


def test_merge_candidates_come_once_without_being_made_distinct(spark, tmp_path, capsys):
    """Pairs aren't dealt out again; where an id has several rows they still come once, as in the SQL."""
    import duckdb

    from tallyforge import catalog

    run = catalog.queries()["merge_candidates_any"]
    run(spark, "/root/testdata/sf0.001").explain()
    assert "HashAggregate" not in capsys.readouterr().out
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    more = orders.where("o_orderkey % 50 = 0").selectExpr("o_orderkey", "o_custkey + 1 as o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    orders.unionByName(more).unionByName(orders.where("o_orderkey % 70 = 0")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    (tmp_path / "customer.parquet").symlink_to("/root/testdata/sf0.001/customer.parquet")
    con = duckdb.connect()
    con.execute("".join(f"CREATE VIEW {t} AS FROM '/root/testdata/sf0.001/{t}.parquet';" for t in ("customer", "lineitem", "part", "supplier", "events")) + f"CREATE VIEW orders AS FROM '{tmp_path}/orders.parquet/*.parquet'")
    expected = con.execute(catalog.oracle_sql()["merge_candidates_any"]).fetchall()
    assert sorted(map(tuple, run(spark, str(tmp_path)).collect())) == sorted(expected)
