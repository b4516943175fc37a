"""Results of recognition: one shape for all, a header joined with items of another source, and what a person corrected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as T

c = F.col
#: The layouts, the words and the supplier that tell one, how a page line looks, and the notes.
LAYOUTS, NORMAL, CATALOG, PAGES = ("normal_invoice", "printed_catalog_handwritten", "multi_page", "mixed"), "normal_invoice", "printed_catalog_handwritten", "multi_page"
CATALOG_WORDS, CATALOG_SUPPLIER = r"(?i)catalog|pre[\s-]?printed|handwritten|circle|checked|勾选|圈选|手写", "grand yc"
PAGE_LINE = r"(?i)^((invoice\s+)?page\s*(no\.?|number|#|:)?\s*\d+\s*(of|/)\s*\d+|page\s*(no\.?|number|#|:)\s*\d+)$"
SECOND_NOTE = "Product items were extracted by AI Vision; template/OCR used only as header assistance."


def page_of(text: Column) -> tuple[Column, Column]:
    """Page and pages that a line of a text says, 0 where none does."""
    line = F.get(F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike(PAGE_LINE)), F.lit(0))
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(line, r"(?i)(\d+)\s*(?:of|/)\s*(\d+)", k), F.lit("")).try_cast("int"), F.lit(0))
    return part(1), part(2)


def layout_of(given: Column, supplier: Column, text: Column) -> Column:
    """A layout that is given and known, unless it is the normal one; else by supplier, by pages, by words."""
    known = given.isin(*[k for k in LAYOUTS if k != NORMAL])
    by_text = F.when(page_of(text)[1] > 1, PAGES).when(F.coalesce(text, F.lit("")).rlike(CATALOG_WORDS), CATALOG).otherwise(NORMAL)
    return F.when(F.coalesce(known, F.lit(False)), given).when(F.lower(F.coalesce(supplier, F.lit(""))).contains(CATALOG_SUPPLIER), CATALOG).otherwise(by_text)


def group_key(supplier: Column, number: Column, total: Column) -> Column:
    """Supplier, number and total to cents in lower case, letters and digits only, joined; empty parts go."""
    clean = lambda x: F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), r"[^a-z0-9㐀-鿿.]+", "")
    parts = F.array(clean(supplier), clean(number), F.coalesce(total, F.lit(0)).cast("decimal(18,2)").cast("string"))
    return F.array_join(F.filter(parts, lambda p: p != ""), "|")


def normalised(results: DataFrame) -> DataFrame:
    """Results (supplier, invoice_no, invoice_date, total, layout, key, text, warnings, confidence, items) in one shape.

    ``items`` are structs of name, quantity, price, amount, marked. Dates become ISO, missing numbers 0, a missing group key is built, page and layout are found in
    the text. Of a printed catalogue only lines stay that someone marked or that have a quantity and an amount, and a warning says how many went. A line without price or
    amount is free.
    """
    layout = layout_of(c("layout"), c("supplier"), c("text"))
    page, pages = page_of(c("text"))
    number = lambda x: F.coalesce(x, F.lit(0.0))
    shape = lambda i: F.struct(
        F.trim(F.coalesce(i["name"], F.lit(""))).alias("name"), F.lower(F.trim(F.coalesce(i["name"], F.lit("")))).alias("key"), number(i["quantity"]).alias("quantity"), number(i["price"]).alias("price"), number(i["amount"]).alias("amount"),
        ((number(i["price"]) == 0) | (number(i["amount"]) == 0)).alias("is_free"),
    )
    keep = lambda i: F.coalesce(i["marked"], F.lit(False)) | ((number(i["amount"]) > 0) & (number(i["quantity"]) > 0))
    d = results.withColumn("layout", layout).withColumn("page", page).withColumn("pages", pages).withColumn("_all", F.coalesce("items", F.array()))
    d = d.withColumn("_kept", F.when(c("layout") == CATALOG, F.filter("_all", keep)).otherwise(c("_all")))
    gone = F.size("_all") - F.size("_kept")
    note = F.when(gone > 0, F.concat(F.lit("Printed catalog handwritten layout: filtered "), gone.cast("string"), F.lit(" candidate-only rows.")))
    key = F.coalesce(F.nullif("key", F.lit("")), group_key(c("supplier"), c("invoice_no"), c("total")))
    out = {
        "supplier": F.coalesce("supplier", F.lit("")), "invoice_no": F.coalesce("invoice_no", F.lit("")), "invoice_date": F.coalesce(T.invoice_date(c("invoice_date")), F.lit("")), "total": number(c("total")), "layout": c("layout"), "page": c("page"), "pages": c("pages"),
        "key": key, "warnings": F.array_compact(F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.array(note))), "confidence": number(c("confidence")), "items": F.transform("_kept", shape),
    }
    return d.select(*[k for k in results.columns if k not in (*out, "text")], *[v.alias(k) for k, v in out.items()])


def merged(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The header of the first source, filled from the second, with the second's items, the warnings of both and a note, and the higher confidence."""
    a, b = first.select(key, F.struct(*[k for k in first.columns if k != key]).alias("a")), second.select(key, F.struct(*[k for k in second.columns if k != key]).alias("b"))
    text = lambda k: F.coalesce(F.nullif(f"a.{k}", F.lit("")), F.nullif(f"b.{k}", F.lit("")), F.lit(NORMAL if k == "layout" else "")).alias(k)
    none = F.array().cast("array<string>")
    return a.join(b, key).select(
        key, *[text(k) for k in ("supplier", "invoice_no", "invoice_date", "key", "layout")], F.when(c("a.total") > 0, c("a.total")).otherwise(F.coalesce("b.total", F.lit(0.0))).alias("total"), c("b.items").alias("items"),
        F.concat(F.coalesce("a.warnings", none), F.coalesce("b.warnings", none), F.array(F.lit(SECOND_NOTE))).alias("warnings"), F.greatest(F.coalesce("a.confidence", F.lit(0.0)), F.coalesce("b.confidence", F.lit(0.0))).alias("confidence"),
    )


def corrections(before: DataFrame, after: DataFrame, key: str, fields: list[str], item_fields: list[str]) -> DataFrame:
    """(key, path, before, after): every field that differs as text, of the record and of each item by its place; a null or missing value is empty.

    ``items`` are arrays of structs in order; an item that was not there before differs in all fields that aren't empty, one that is gone gives no rows.
    """
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    b, a = before.select(c(key), F.struct(*fields, "items").alias("b")), after.select(c(key), F.struct(*fields, "items").alias("a"))
    d = a.join(b, key, "left")
    own = F.array(*[F.struct(F.lit(f).alias("path"), text(c(f"b.{f}")).alias("before"), text(c(f"a.{f}")).alias("after")) for f in fields])

    def item(x: Column, k: Column) -> Column:
        old = F.get("b.items", k)
        return F.array(*[F.struct(F.concat(F.lit("items."), k.cast("string"), F.lit(f".{f}")).alias("path"), text(old[f]).alias("before"), text(x[f]).alias("after")) for f in item_fields])

    rows = F.concat(own, F.flatten(F.transform(F.coalesce("a.items", F.array()), item)))
    return d.select(key, F.explode(F.filter(rows, lambda r: r["before"] != r["after"])).alias("r")).select(key, "r.*")
