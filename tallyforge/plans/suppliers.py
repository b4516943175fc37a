"""Suppliers found, linked and merged; learned names matched to items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import textjoin as J
from tallyforge.operators.components import components, cut, ends
from tallyforge.operators.keys import first_in_order
from tallyforge.plans.ledger import ranked_learning
from tallyforge.plans.registry import query
from tallyforge.plans.prices import ANOMALIES, price_anomalies

c = F.col
#: Suppliers are alike above this similarity of their keys.
ALIKE = 0.85

KEY = r"regexp_replace(regexp_replace(upper({0}), '\b(CO|LTD|INC)\b', ' ', 'g'), '[^A-Z0-9]+', '', 'g')"
PARTIES = f"""named AS (
  SELECT company_id, supplier_id, CASE supplier_id % 3 WHEN 0 THEN stem WHEN 1 THEN left(stem, 8) || substr(stem, 10) ELSE lower(stem) || ' Co LTD' END AS name,
    CASE WHEN supplier_id % 5 = 0 THEN '555-' || (supplier_id // 200) END AS phone, CASE supplier_id % 8 WHEN 1 THEN 'Buyer' || (supplier_id // 100) || '@x.example' WHEN 5 THEN 'BUYER' || (supplier_id // 100) || '@X.example' END AS email,
    CASE supplier_id % 12 WHEN 2 THEN (supplier_id // 150) || ' Main St.' WHEN 8 THEN (supplier_id // 150) || ' MAIN ST' END AS address
  FROM (SELECT *, upper(left(md5(company_id || '-' || (supplier_id // 75)), 14)) AS stem FROM suppliers_v)
), parties AS (SELECT *, {KEY.format("name")} AS key, {KEY.format("address")} AS place FROM named),
links AS (SELECT a.supplier_id AS a, b.supplier_id AS b FROM parties a JOIN parties b ON a.company_id = b.company_id AND a.supplier_id <> b.supplier_id
  AND (a.key = b.key OR a.phone = b.phone OR lower(a.email) = lower(b.email) OR a.place = b.place OR 1 - levenshtein(a.key, b.key)::DOUBLE / greatest(length(a.key), length(b.key)) > {ALIKE}))"""


def parties(m) -> DataFrame:
    """Suppliers with a name of their own, and for some a telephone number, an e-mail, an address; some 3 of a tenant's 75 are variants of one."""
    stem = F.upper(F.left(F.md5(F.concat("company_id", F.lit("-"), F.floor(c("supplier_id") / 75).cast("string"))), F.lit(14)))
    part = lambda n: F.floor(c("supplier_id") / n).cast("string")
    kind = lambda n, k: c("supplier_id") % n == k
    s = m.suppliers.select("company_id", "supplier_id", stem.alias("stem"))
    s = s.select(
        "company_id",
        "supplier_id",
        F.when(kind(3, 0), c("stem")).when(kind(3, 1), F.concat(F.left("stem", F.lit(8)), F.substr("stem", F.lit(10)))).otherwise(F.concat(F.lower("stem"), F.lit(" Co LTD"))).alias("name"),
        F.when(kind(5, 0), F.concat(F.lit("555-"), part(200))).alias("phone"),
        F.when(kind(8, 1), F.concat(F.lit("Buyer"), part(100), F.lit("@x.example"))).when(kind(8, 5), F.concat(F.lit("BUYER"), part(100), F.lit("@X.example"))).alias("email"),
        F.when(kind(12, 2), F.concat(part(150), F.lit(" Main St."))).when(kind(12, 8), F.concat(part(150), F.lit(" MAIN ST"))).alias("address"),
    )
    return s.withColumn("key", T.supplier_key(c("name"))).withColumn("place", T.supplier_key(c("address")))


def values(s: DataFrame) -> DataFrame:
    """(company_id, supplier_id, kind, value): what makes suppliers one where it is equal."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("key", c("key")), ("phone", c("phone")), ("email", F.lower("email")), ("place", c("place")))])
    return s.select("company_id", "supplier_id", F.explode(found).alias("f")).select("company_id", "supplier_id", "f.*").where(F.length("value") > 0)


def alike_keys(s: DataFrame) -> DataFrame:
    """(company_id, a, b): different keys of a tenant that are alike."""
    return J.similar(s, "key", s, "key", ["company_id"], ALIKE).where("a <> b")


def star_links(s: DataFrame) -> DataFrame:
    """(a, b): links that hold the groups together: each supplier with the first that has an equal value, and the first suppliers of alike keys."""
    v = values(s)
    head = Window.partitionBy("company_id", "kind", "value")
    equal = v.select(F.min("supplier_id").over(head).alias("a"), c("supplier_id").alias("b")).where("a <> b")
    first = v.where("kind = 'key'").groupBy("company_id", "value").agg(F.min("supplier_id").alias("first"))
    x, y = first.select("company_id", c("value").alias("a"), c("first").alias("fa")), first.select("company_id", c("value").alias("b"), c("first").alias("fb"))
    near = alike_keys(s).where("a < b").join(x, ["company_id", "a"]).join(y, ["company_id", "b"])
    return equal.unionByName(near.select(c("fa").alias("a"), c("fb").alias("b"))).distinct()


@query(
    "SELECT s AS supplier_id, min(g) AS group_id, COUNT(*) AS size FROM reach GROUP BY 1",
    PARTIES + ", reach(s, g) AS (SELECT supplier_id, supplier_id FROM parties UNION SELECT r.s, l.b FROM reach r JOIN links l ON l.a = r.g)",
    recursive=True,
)
def supplier_groups(m):
    """Groups of suppliers linked by an equal key, telephone number, e-mail or address or by alike keys, over any number of steps."""
    s = cut(parties(m))
    d = s.select("supplier_id").join(components(star_links(s)), c("supplier_id") == c("id"), "left").select("supplier_id", F.coalesce("component", "supplier_id").alias("group_id"))
    return d.join(d.groupBy("group_id").agg(F.count("*").alias("size")), "group_id").select("supplier_id", "group_id", "size")


def first_partner(s: DataFrame) -> DataFrame:
    """(supplier_id, partner): the first other supplier with an equal value or an alike key; no group is expanded into pairs."""
    v = values(s)
    low = v.groupBy("company_id", "kind", "value").agg(F.min("supplier_id").alias("low"))
    met = v.join(low, ["company_id", "kind", "value"])
    second = met.where("supplier_id > low").groupBy("company_id", "kind", "value").agg(F.min("supplier_id").alias("second"))
    equal = met.join(second, ["company_id", "kind", "value"]).select("supplier_id", F.when(c("supplier_id") == c("low"), c("second")).otherwise(c("low")).alias("partner"))
    first = low.where("kind = 'key'").select("company_id", c("value").alias("b"), c("low").alias("partner"))
    near = alike_keys(s).join(first, ["company_id", "b"]).groupBy("company_id", c("a").alias("key")).agg(F.min("partner").alias("partner"))
    near = s.select("company_id", "key", "supplier_id").join(near, ["company_id", "key"]).select("supplier_id", "partner")
    return equal.unionByName(near).groupBy("supplier_id").agg(F.min("partner").alias("partner"))


@query("SELECT a AS supplier_id, min(b) AS partner FROM links GROUP BY 1", PARTIES)
def supplier_suspects(m):
    """The first other supplier of the tenant that may be the same, for each that has one."""
    return first_partner(cut(parties(m)))


@query(
    """SELECT 'same key' AS reason, company_id || '/' || key AS key, string_agg(CAST(supplier_id AS VARCHAR), ',' ORDER BY supplier_id) AS ids FROM parties GROUP BY company_id, key HAVING COUNT(*) > 1
  UNION ALL SELECT 'repeats itself', CAST(supplier_id AS VARCHAR), CAST(supplier_id AS VARCHAR) FROM suppliers_v WHERE supplier_id % 4 = 0
  UNION ALL SELECT 'same product', trim(regexp_replace(lower(p_name), '\\s*x\\s*', 'X', 'g')), string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) FROM part GROUP BY 2 HAVING COUNT(*) > 1""",
    PARTIES,
)
def audit_suspect_groups(m):
    """Suppliers with one key, suppliers whose name of four words or more says itself twice, and products with one normalised name, each group with its ids."""
    ids = lambda key: F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ",").alias("ids")
    s = parties(m).groupBy(F.concat_ws("/", "company_id", "key").alias("key")).agg(F.count("*").alias("n"), ids("supplier_id")).where("n > 1").select(F.lit("same key").alias("reason"), "key", "ids")
    shown = F.when(c("supplier_id") % 4 == 0, F.concat_ws("  ", "name", "segment", F.lower("name"), "segment")).when(c("supplier_id") % 4 == 1, F.concat_ws(" ", "segment", "segment")).otherwise(c("display_name"))
    w = F.split(F.upper(F.trim(F.regexp_replace(shown, r"\s+", " "))), " ")
    half = F.floor(F.size(w) / 2).cast("int")
    twice = (F.size(w) >= 4) & (F.size(w) % 2 == 0) & (F.slice(w, F.lit(1), half) == F.slice(w, half + 1, half))
    r = m.suppliers.where(twice).select(F.lit("repeats itself").alias("reason"), c("supplier_id").cast("string").alias("key"), c("supplier_id").cast("string").alias("ids"))
    p = m.table("part").groupBy(T.product_name(c("p_name")).alias("key")).agg(F.count("*").alias("n"), ids("p_partkey")).where("n > 1").select(F.lit("same product").alias("reason"), "key", "ids")
    return s.unionByName(r).unionByName(p)


TRADE = ("股份有限公司", "有限责任公司", "有限公司", "公司", "股份", "国际", "贸易", "进出口", "商行", "企业", " Trading Co., Ltd.", "")


@query("SELECT supplier_id, '大昌' || supplier_id AS key FROM suppliers_v")
def fn_supplier_norm_trade(m):
    """Chinese names with every kind of trade ending have one key."""
    ending = F.lit("")
    for k, e in enumerate(TRADE):
        ending = F.when(c("supplier_id") % len(TRADE) == k, F.lit(e)).otherwise(ending)
    return m.suppliers.select("supplier_id", T.supplier_key(F.concat(F.lit("大昌"), c("supplier_id").cast("string"), ending)).alias("key"))


BULK = PARTIES + """, bulk AS (SELECT *, min(supplier_id) OVER (PARTITION BY company_id, key) AS target FROM parties),
live AS (SELECT * FROM bulk WHERE supplier_id = target)"""


def merged_into(s: DataFrame) -> DataFrame:
    """Of the suppliers with one key the oldest (first) survives; ``target`` is the survivor."""
    return s.withColumn("target", F.min("supplier_id").over(Window.partitionBy("company_id", "key")))


@query(
    "SELECT b.supplier_id, b.target AS merged_into, CASE WHEN b.supplier_id <> b.target THEN b.target ELSE x.other END AS suspected_duplicate_of FROM bulk b LEFT JOIN (SELECT l.a, min(l.b) AS other FROM links l JOIN live p ON p.supplier_id = l.a JOIN live q ON q.supplier_id = l.b GROUP BY 1) x ON x.a = b.supplier_id",
    BULK,
)
def supplier_bulk_merge(m):
    """The bulk merge by key; then each survivor is marked with the first other survivor that may be the same."""
    s = cut(merged_into(parties(m)))
    suspects = first_partner(s.where("supplier_id = target")).select(c("supplier_id").alias("of"), "partner")
    d = s.join(suspects, c("supplier_id") == c("of"), "left")
    return d.select("supplier_id", c("target").alias("merged_into"), F.when(c("supplier_id") != c("target"), c("target")).otherwise(c("partner")).alias("suspected_duplicate_of"))


MERGED = BULK + """, before AS (SELECT supplier_id, key, lag(supplier_id) OVER (PARTITION BY company_id ORDER BY supplier_id) AS previous FROM live),
steps AS (SELECT supplier_id AS source, target FROM bulk WHERE supplier_id <> target UNION ALL SELECT supplier_id, previous FROM before WHERE previous IS NOT NULL AND key < '8'),
walk(source, target) AS (SELECT source, target FROM steps UNION SELECT w.source, s.target FROM walk w JOIN steps s ON s.source = w.target),
moved AS (SELECT source, target FROM walk WHERE target NOT IN (SELECT source FROM steps)),
anomalies AS (""" + ANOMALIES + "), owned AS (SELECT p.*, b.supplier_id AS owner FROM prices p JOIN base b ON b.invoice_id = p.invoice_id)"


def merge_steps(m) -> DataFrame:
    """Merges that were made one after the other: by key, and by hand of a survivor into the one before it, so that chains arise."""
    s = merged_into(parties(m))
    by_key = s.where("supplier_id <> target").select(c("supplier_id").alias("source"), "target")
    live = s.where("supplier_id = target")
    previous = F.lag("supplier_id").over(Window.partitionBy("company_id").orderBy("supplier_id"))
    by_hand = live.withColumn("previous", previous).where(c("previous").isNotNull() & (c("key") < "8")).select(c("supplier_id").alias("source"), c("previous").alias("target"))
    return by_key.unionByName(by_hand)


def supplier_tables(m) -> DataFrame:
    """(tbl, id, supplier_id): the rows of all ten tables that name a supplier."""
    owner = m.base.select("invoice_id", c("supplier_id").alias("owner"))
    prices = m.prices.join(owner, "invoice_id")
    row = lambda df, tbl, id_, of="owner": df.select(F.lit(tbl).alias("tbl"), id_.cast("string").alias("id"), c(of).alias("supplier_id"))
    name = lambda kind, what: F.concat(F.lit(kind), c("owner").cast("string"), F.lit("-"), c(what).cast("string"))
    tables = [
        row(m.base, "invoices", c("invoice_id"), "supplier_id"),
        row(m.items.select("item_id", "invoice_id").join(owner, "invoice_id"), "invoice_items", c("item_id")),
        row(m.discounts.select("invoice_id").join(owner, "invoice_id"), "invoice_discounts", c("invoice_id")),
        row(prices, "price_history", c("item_id")),
        row(prices.select("owner", "product_id").distinct(), "product_aliases", name("alias-", "product_id")),
        row(prices.select("owner", "product_name").distinct(), "product_learning_rules", name("rule-", "product_name")),
        row(m.base.where("invoice_id % 3 = 0"), "recognition_corrections", c("invoice_id"), "supplier_id"),
        row(price_anomalies(m).select("item_id").distinct().join(prices, "item_id").select("item_id", "owner"), "price_anomalies", c("item_id")),
        row(m.suppliers.where("not deleted"), "supplier_templates", c("supplier_id"), "supplier_id"),
        row(m.suppliers, "suppliers", c("supplier_id"), "supplier_id"),
    ]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


@query(
    """SELECT tbl, id, coalesce(target, supplier_id) AS supplier_id, tbl = 'suppliers' AND target IS NOT NULL AS retired FROM (
  SELECT 'invoices' AS tbl, CAST(invoice_id AS VARCHAR) AS id, supplier_id FROM base
  UNION ALL SELECT 'invoice_items', item_id, b.supplier_id FROM items i JOIN base b ON b.invoice_id = i.invoice_id
  UNION ALL SELECT 'invoice_discounts', CAST(d.invoice_id AS VARCHAR), b.supplier_id FROM discounts d JOIN base b ON b.invoice_id = d.invoice_id
  UNION ALL SELECT 'price_history', item_id, owner FROM owned
  UNION ALL SELECT DISTINCT 'product_aliases', 'alias-' || owner || '-' || product_id, owner FROM owned
  UNION ALL SELECT DISTINCT 'product_learning_rules', 'rule-' || owner || '-' || product_name, owner FROM owned
  UNION ALL SELECT 'recognition_corrections', CAST(invoice_id AS VARCHAR), supplier_id FROM base WHERE invoice_id % 3 = 0
  UNION ALL SELECT 'price_anomalies', item_id, owner FROM owned WHERE item_id IN (SELECT item_id FROM anomalies)
  UNION ALL SELECT 'supplier_templates', CAST(supplier_id AS VARCHAR), supplier_id FROM suppliers_v WHERE NOT deleted
  UNION ALL SELECT 'suppliers', CAST(supplier_id AS VARCHAR), supplier_id FROM suppliers_v) LEFT JOIN moved ON source = supplier_id""",
    MERGED,
    recursive=True,
)
def merged_supplier_tables(m):
    """Every row of the ten tables that name a supplier, after all merges: a chain of merges ends at its last survivor in every table."""
    moved = ends(merge_steps(m))
    d = supplier_tables(m).join(moved, c("supplier_id") == c("source"), "left")
    return d.select("tbl", "id", F.coalesce("target", "supplier_id").alias("supplier_id"), ((c("tbl") == "suppliers") & c("target").isNotNull()).alias("retired"))


# --- finding a supplier ---------------------------------------------------------------------

ENTRIES = PARTIES + """, known AS (SELECT company_id, supplier_id, name, name || ' ' || lower(coalesce(phone, '')) AS display_name, key, '["' || name || '","depot ' || supplier_id || ' of ' || lower(name) || '"]' AS aliases FROM parties),
entered AS (SELECT DISTINCT b.company_id, CASE b.invoice_id % 6 WHEN 0 THEN k.name WHEN 1 THEN k.display_name WHEN 2 THEN '  ' || upper(k.name) || ' ' WHEN 3 THEN 'depot ' || k.supplier_id WHEN 4 THEN left(k.name, 4) || substr(k.name, 6) ELSE 'Nobody ' || (b.invoice_id % 100) END AS entry
  FROM base b JOIN known k ON k.supplier_id = b.supplier_id),
asked AS (SELECT company_id, entry, trim(entry) AS name, """ + KEY.format("trim(entry)") + """ AS key FROM entered),
exact AS (SELECT a.company_id, a.entry, min(k.supplier_id) AS supplier_id FROM asked a JOIN known k ON k.company_id = a.company_id AND (k.name = a.name OR k.display_name = a.name OR k.key = a.key OR contains(k.aliases, a.name)) GROUP BY 1, 2),
fuzzy AS (SELECT a.company_id, a.entry, min(k.supplier_id) AS supplier_id FROM asked a JOIN known k ON k.company_id = a.company_id AND 1 - levenshtein(a.key, k.key)::DOUBLE / greatest(length(a.key), length(k.key)) > """ + f"{ALIKE} GROUP BY 1, 2)"


#: Length of the runs by which entered names are looked up in aliases: long enough to be rare among the suppliers of a large tenant.
NAME_RUN = 8


def resolved(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(company_id, entry, how, supplier_id): the supplier of each name that was entered.

    ``asked`` has company_id, entry, name, key; ``known`` has company_id, supplier_id, name, display_name, key, aliases. A name finds the
    first supplier with this name, display name or key, or with it within the text of its aliases; else the first with an alike key; else it is new.
    """
    scope = ["company_id"]
    asked, known = cut(asked), cut(known)  # every step reads both
    by = lambda column, value: asked.hint("merge").select(*scope, "entry", c(column).alias("v")).join(known.select(*scope, c(value).alias("v"), "supplier_id"), [*scope, "v"])
    inside = J.containing(asked, "name", known, "aliases", scope, NAME_RUN)
    by_alias = asked.select(*scope, "entry", c("name").alias("needle")).join(inside, [*scope, "needle"]).join(known.select(*scope, c("aliases").alias("text"), "supplier_id"), [*scope, "text"])
    hits = [by("name", "name"), by("name", "display_name"), by("key", "key"), by_alias]
    exact = hits[0].select(*scope, "entry", "supplier_id")
    for h in hits[1:]:
        exact = exact.unionByName(h.select(*scope, "entry", "supplier_id"))
    exact = cut(exact.groupBy(*scope, "entry").agg(F.min("supplier_id").alias("exact")))
    left = asked.join(exact, [*scope, "entry"], "left_anti")
    near = J.similar(left, "key", known, "key", scope, ALIKE)
    first = known.groupBy(*scope, c("key").alias("b")).agg(F.min("supplier_id").alias("supplier_id"))
    near = near.join(first, [*scope, "b"]).groupBy(*scope, c("a").alias("key")).agg(F.min("supplier_id").alias("near"))
    d = asked.join(exact, [*scope, "entry"], "left").join(near, [*scope, "key"], "left")
    how = F.when(c("exact").isNotNull(), "known").when(c("near").isNotNull(), "alike").otherwise("new")
    return d.select(*scope, "entry", how.alias("how"), F.coalesce("exact", "near").alias("supplier_id"))


def known_suppliers(m) -> DataFrame:
    s = parties(m)
    aliases = F.concat(F.lit('["'), "name", F.lit('","depot '), c("supplier_id").cast("string"), F.lit(" of "), F.lower("name"), F.lit('"]'))
    return s.select("company_id", "supplier_id", "name", F.concat("name", F.lit(" "), F.lower(F.coalesce("phone", F.lit("")))).alias("display_name"), "key", aliases.alias("aliases"))


@query(
    "SELECT a.company_id, a.entry, CASE WHEN x.supplier_id IS NOT NULL THEN 'known' WHEN f.supplier_id IS NOT NULL THEN 'alike' ELSE 'new' END AS how, coalesce(x.supplier_id, f.supplier_id) AS supplier_id FROM asked a LEFT JOIN exact x ON x.company_id = a.company_id AND x.entry = a.entry LEFT JOIN fuzzy f ON f.company_id = a.company_id AND f.entry = a.entry",
    ENTRIES,
)
def supplier_resolve(m):
    """Names as entered on invoices find their supplier: exact, by key, within the aliases, by an alike key; what finds none is a new supplier."""
    known = known_suppliers(m)
    b = m.base.select("invoice_id", c("supplier_id")).join(known, "supplier_id")
    k = c("invoice_id") % 6
    entry = (
        F.when(k == 0, c("name")).when(k == 1, c("display_name")).when(k == 2, F.concat(F.lit("  "), F.upper("name"), F.lit(" ")))
        .when(k == 3, F.concat(F.lit("depot "), c("supplier_id").cast("string"))).when(k == 4, F.concat(F.left("name", F.lit(4)), F.substr("name", F.lit(6))))
        .otherwise(F.concat(F.lit("Nobody "), (c("invoice_id") % 100).cast("string")))
    )
    asked = b.select("company_id", entry.alias("entry")).distinct().withColumn("name", F.trim("entry")).withColumn("key", T.supplier_key(c("name")))
    return resolved(asked, known)


# --- learned names --------------------------------------------------------------------------

#: A learned name is taken from this score on; an item without one has this confidence; no match is surer than this.
TAKEN, UNMATCHED, SUREST = 0.78, 0.65, 0.98


def learned_matches(names: DataFrame, learned: DataFrame) -> DataFrame:
    """(company_id, name, best, kind, score): the best learned name of each item name with a score of at least TAKEN.

    ``learned`` has company_id, name, kind and rn. 1 for equal keys, 0.92 where one key contains the other, else the share of common words; of
    equal scores the earlier learned name counts, aliases before rules.
    """
    key = T.product_name(c("name"))
    x = cut(names.select("company_id", "name", key.alias("x")).where("x <> ''"))  # both are read by each of the three joins
    y = cut(learned.select("company_id", c("name").alias("best"), "kind", "rn", key.alias("y")).where("y <> ''"))
    scope = ["company_id"]
    inner = J.containing(y, "y", x, "x", scope).select(*scope, c("text").alias("x"), c("needle").alias("y"))
    outer = J.containing(x, "x", y, "y", scope).select(*scope, c("needle").alias("x"), c("text").alias("y"))
    shared = J.sharing_words(x, "x", y, "y", scope, TAKEN).select(*scope, c("a").alias("x"), c("b").alias("y"))
    met = inner.unionByName(outer).unionByName(shared).distinct().withColumn("score", T.token_similarity(c("x"), c("y")))
    d = x.join(met, [*scope, "x"]).join(y, [*scope, "y"])
    return first_in_order(d, [*scope, "name"], c("score").desc(), "kind", "rn").select(*scope, "name", "best", "kind", "score")


NAMED = r"""learned AS (SELECT company_id, product_name, COUNT(*) AS n, max(invoice_date) AS latest FROM prices GROUP BY 1, 2),
ranked AS (SELECT company_id, 'alias' AS kind, product_name AS name, row_number() OVER (PARTITION BY company_id ORDER BY n DESC, latest DESC, product_name) AS rn FROM learned
  UNION ALL SELECT company_id, 'rule', product_name, row_number() OVER (PARTITION BY company_id ORDER BY least(100, 75 + 3 * n) DESC, n DESC, product_name) FROM learned),
top AS (SELECT *, trim(regexp_replace(regexp_replace(lower(name), '\s*x\s*', 'X', 'g'), '\s+', ' ', 'g')) AS y FROM ranked WHERE rn <= 500),
named AS (SELECT DISTINCT b.company_id, CASE i.product_id % 6 WHEN 0 THEN upper(raw_name) WHEN 1 THEN raw_name || '  large pack' WHEN 2 THEN substr(raw_name, 7) WHEN 3 THEN substr(raw_name, length(brand) + 2) || ' ' || brand
  WHEN 4 THEN 'nothing ' || (i.product_id % 50) ELSE raw_name || ' ' || brand || ' extra' END AS name, CASE WHEN i.product_id % 5 = 0 THEN CAST(0.9 AS DOUBLE) END AS given FROM items i JOIN base b ON b.invoice_id = i.invoice_id),
keyed AS (SELECT *, trim(regexp_replace(regexp_replace(lower(name), '\s*x\s*', 'X', 'g'), '\s+', ' ', 'g')) AS x FROM named),
pairs AS (SELECT DISTINCT k.company_id, k.x, t.y FROM (SELECT DISTINCT company_id, x FROM keyed) k JOIN (SELECT DISTINCT company_id, y FROM top) t ON t.company_id = k.company_id),
scored AS (SELECT *, CASE WHEN x = y THEN 1.0 WHEN contains(x, y) OR contains(y, x) THEN 0.92 ELSE len(list_intersect(list_distinct(string_split(x, ' ')), list_distinct(string_split(y, ' '))))::DOUBLE / greatest(len(list_distinct(string_split(x, ' '))), len(list_distinct(string_split(y, ' ')))) END::DOUBLE AS score FROM pairs),
best AS (SELECT * FROM (SELECT s.company_id, s.x, t.name AS best, t.kind, s.score, row_number() OVER (PARTITION BY s.company_id, s.x ORDER BY s.score DESC, t.kind, t.rn) AS place FROM scored s JOIN top t ON t.company_id = s.company_id AND t.y = s.y WHERE s.score >= 0.78) WHERE place = 1)"""


@query(
    "SELECT k.company_id, k.name, k.given, b.best, b.kind, b.score, CASE WHEN b.score IS NULL THEN coalesce(given, 0.65) ELSE greatest(coalesce(given, 0), least(0.98, b.score)) END::DOUBLE AS confidence FROM keyed k LEFT JOIN best b ON b.company_id = k.company_id AND b.x = k.x",
    NAMED,
)
def alias_match(m):
    """The best learned name of each item name of a tenant, and the item's confidence with it."""
    i = m.items.select("invoice_id", "product_id", "raw_name", "brand").join(m.base.select("invoice_id", "company_id"), "invoice_id")
    k, raw = c("product_id") % 6, c("raw_name")
    name = (
        F.when(k == 0, F.upper(raw)).when(k == 1, F.concat(raw, F.lit("  large pack"))).when(k == 2, F.substr(raw, F.lit(7))).when(k == 3, F.concat_ws(" ", F.substr(raw, F.length("brand") + 2), "brand"))
        .when(k == 4, F.concat(F.lit("nothing "), (c("product_id") % 50).cast("string"))).otherwise(F.concat_ws(" ", raw, "brand", F.lit("extra")))
    )
    named = cut(i.select("company_id", name.alias("name"), F.when(c("product_id") % 5 == 0, F.lit(0.9)).alias("given")).distinct())
    d = named.join(learned_matches(named.select("company_id", "name").distinct(), ranked_learning(m)), ["company_id", "name"], "left")
    sure = F.greatest(F.coalesce("given", F.lit(0.0)), F.least(F.lit(SUREST), c("score")))
    return d.select("company_id", "name", "given", "best", "kind", "score", F.when(c("score").isNull(), F.coalesce("given", F.lit(UNMATCHED))).otherwise(sure).alias("confidence"))
