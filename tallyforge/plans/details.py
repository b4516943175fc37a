"""Details of lists, searches and parsed texts: flags, confidences, stops, keys and matches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions.encoding import learned_likelihood, repaired_ideographs, repaired_text, suspicious
from tallyforge.plans.ledger import SYNC, queue
from tallyforge.functions import text as T
from tallyforge.plans.registry import query

c = F.col


@query(
    """SELECT item_id, CASE WHEN line_no % 2 = 0 AND (invoice_id % 10)::DOUBLE / 10 < 0.7 THEN 'name=' || CAST((invoice_id % 10) AS VARCHAR) || ';' ELSE '' END
  || CASE WHEN line_no % 3 > 0 AND (product_id % 10)::DOUBLE / 10 < 0.7 THEN 'price=' || CAST((product_id % 10) AS VARCHAR) || ';' ELSE '' END
  || CASE WHEN (supplier_id % 10)::DOUBLE / 10 < 0.7 THEN 'quantity=' || CAST((supplier_id % 10) AS VARCHAR) || ';' ELSE '' END AS fields FROM items"""
)
def low_confidence_fields(m):
    """The fields of a line with a confidence below 0.7, with their values (in tenths); a missing one counts as sure."""
    field = lambda name, key, there=None: F.struct(F.lit(name).alias("name"), (F.when(there, c(key) % 10) if there is not None else c(key) % 10).alias("tenths"))
    fields = F.array(field("name", "invoice_id", c("line_no") % 2 == 0), field("price", "product_id", c("line_no") % 3 > 0), field("quantity", "supplier_id"))
    low = F.filter(fields, lambda f: F.coalesce(f["tenths"].cast("double") / 10, F.lit(1.0)) < 0.7)
    text = F.array_join(F.transform(low, lambda f: F.concat(f["name"], F.lit("="), f["tenths"].cast("string"), F.lit(";"))), "")
    return m.items.select("item_id", text.alias("fields"))


@query(
    """SELECT i.invoice_id, coalesce(x.gift, false) AS gift, d.invoice_id IS NOT NULL AS discount, i.warnings <> '' AS warned, contains(i.warnings, 'MULTI_PAGE') AS pages, abs(i.total_amount - 1) < 0.01 AS exact,
  i.invoice_date >= DATE '1993-01-01' AND i.invoice_date < DATE '1997-01-01' AND contains(i.invoice_no, '7') AND i.total_amount BETWEEN 1000 AND 200000 AND coalesce(x.gift, false) AND d.invoice_id IS NOT NULL AND NOT (i.warnings <> '') AS matches
  FROM invoices i LEFT JOIN (SELECT invoice_id, bool_or(is_free) AS gift FROM items GROUP BY 1) x ON x.invoice_id = i.invoice_id LEFT JOIN discounts d ON d.invoice_id = i.invoice_id WHERE NOT i.deleted"""
)
def supplier_history_flags(m):
    """The flags of an invoice in a supplier's history, and whether a set of filters (dates, number, amounts, flags) keeps it."""
    x = m.lines.groupBy("invoice_id").agg(F.bool_or("is_free").alias("gift"))
    d = m.invoices.where("not deleted").join(x, "invoice_id", "left").join(m.discounts.select("invoice_id", F.lit(True).alias("d")), "invoice_id", "left")
    flags = {"gift": F.coalesce("gift", F.lit(False)), "discount": F.coalesce("d", F.lit(False)), "warned": c("warnings") != "", "pages": c("warnings").contains("MULTI_PAGE"), "exact": F.abs(c("total_amount") - 1) < 0.01}
    filters = [c("invoice_date") >= F.lit("1993-01-01").cast("date"), c("invoice_date") < F.lit("1997-01-01").cast("date"), c("invoice_no").contains("7"), c("total_amount").between(1000, 200000), flags["gift"], flags["discount"], ~flags["warned"]]
    keep = filters[0]
    for f in filters[1:]:
        keep = keep & f
    return d.select("invoice_id", *[v.alias(k) for k, v in flags.items()], keep.alias("matches"))


@query(
    """SELECT CASE WHEN line_no % 5 = 0 THEN 'n:' || lower(trim(raw_name)) ELSE 'p:' || CAST(product_id AS VARCHAR) END AS key, min(raw_name) AS name, CAST(SUM(quantity) AS DOUBLE) AS quantity, CAST(SUM(total) AS DOUBLE) AS amount, COUNT(*) AS n
  FROM items WHERE NOT candidate_only GROUP BY 1"""
)
def product_ranking_keys(m):
    """Quantity and amount by product: by its id where a line has one, else by its normalised name."""
    key = F.when(c("line_no") % 5 == 0, F.concat(F.lit("n:"), F.lower(F.trim("raw_name")))).otherwise(F.concat(F.lit("p:"), c("product_id").cast("string")))
    d = m.items.where("not candidate_only").groupBy(key.alias("key"))
    return d.agg(F.min("raw_name").alias("name"), F.sum("quantity").cast("double").alias("quantity"), F.sum("total").cast("double").alias("amount"), F.count("*").alias("n"))


@query(
    """SELECT product_id, l.price, l.quantity, l.supplier_id, l.invoice_date, l.invoice_no, low, top, mean, n, pending FROM (
    SELECT i.product_id, arg_max({'price': i.unit_price, 'quantity': CAST(i.quantity AS DOUBLE), 'supplier_id': i.supplier_id, 'invoice_date': b.invoice_date, 'invoice_no': b.invoice_no}, {'d': b.invoice_date, 'i': i.invoice_id, 'k': i.item_id}) AS l,
      min(i.unit_price) FILTER (i.unit_price > 0) AS low, max(i.unit_price) FILTER (i.unit_price > 0) AS top,
      CAST(SUM(CAST(floor(i.unit_price * 10000) AS BIGINT)) FILTER (i.unit_price > 0) AS DOUBLE) / nullif(COUNT(*) FILTER (i.unit_price > 0), 0) / 10000 AS mean, COUNT(*) AS n, COUNT(*) FILTER (b.status = 'PENDING_REVIEW') AS pending
    FROM items i JOIN base b ON b.invoice_id = i.invoice_id WHERE NOT b.deleted GROUP BY 1)"""
)
def price_summary_latest(m):
    """Each product's latest purchase in full, the range and mean of its positive prices, and how many of its records wait for review."""
    d = m.lines.join(m.base.where("not deleted").select("invoice_id", "invoice_date", "invoice_no", "status"), "invoice_id")
    last = F.max_by(F.struct(c("unit_price").alias("price"), c("quantity").cast("double").alias("quantity"), "supplier_id", "invoice_date", "invoice_no"), F.struct("invoice_date", "invoice_id", "item_id"))
    paid = F.when(c("unit_price") > 0, c("unit_price"))
    mean = F.sum(F.floor(paid * 10000)).cast("double") / F.nullif(F.count(paid), F.lit(0)) / 10000
    d = d.groupBy("product_id").agg(last.alias("l"), F.min(paid).alias("low"), F.max(paid).alias("top"), mean.alias("mean"), F.count("*").alias("n"), F.count_if(c("status") == "PENDING_REVIEW").alias("pending"))
    return d.select("product_id", "l.*", "low", "top", "mean", "n", "pending")


@query("SELECT tbl, COUNT(*) AS n, COUNT(*) FILTER (sync_status = 'pending') AS pending, COUNT(*) FILTER (sync_status = 'conflict') AS conflicts, COUNT(*) FILTER (sync_status = 'failed') AS failed FROM queue GROUP BY 1", SYNC)
def sync_table_counts(m):
    """Rows of each table by their state."""
    state = lambda k: F.count_if(c("sync_status") == k)
    return queue(m).groupBy("tbl").agg(F.count("*").alias("n"), state("pending").alias("pending"), state("conflict").alias("conflicts"), state("failed").alias("failed"))


#: Results of a search with a query, and without one.
FOUND, LATEST = 100, 20


@query(
    f"""SELECT 'query' AS kind, product_id, rn FROM (SELECT product_id, row_number() OVER (ORDER BY latest DESC, product_id) AS rn FROM seen WHERE contains(lower(product_name), 'green')) WHERE rn <= {FOUND}
  UNION ALL SELECT 'all', product_id, rn FROM (SELECT product_id, row_number() OVER (ORDER BY latest DESC, product_id) AS rn FROM (SELECT product_id, max(latest) AS latest FROM seen GROUP BY 1)) WHERE rn <= {LATEST}""",
    "seen AS (SELECT product_id, min(product_name) AS product_name, max(invoice_date) AS latest FROM prices GROUP BY 1)",
)
def search_pages(m):
    """What a search shows, newest first: 100 products with a query, 20 without."""
    seen = m.prices.groupBy("product_id").agg(F.min("product_name").alias("product_name"), F.max("invoice_date").alias("latest"))
    parts = []
    for kind, df, most in (("query", seen.where(F.lower("product_name").contains("green")), FOUND), ("all", seen, LATEST)):
        top = df.orderBy(c("latest").desc(), "product_id").limit(most)  # one bounded list; its order is numbered then
        rn = F.row_number().over(Window.partitionBy("kind").orderBy(c("latest").desc(), "product_id")).cast("bigint")
        parts.append(top.withColumn("kind", F.lit(kind)).select("kind", "product_id", rn.alias("rn")))
    return parts[0].union(parts[1])


@query(
    """SELECT p_partkey AS product_id, contains(lower(p_brand), 'd#1') OR contains(lower(p_name), 'd#1') OR contains(lower(p_type), 'd#1') AS raw_hit,
  contains(concat_ws(' ', lower(p_brand), lower(p_name), lower(p_type), lower(p_brand) || ' ' || lower(p_name)), '1 green') AS joined_hit, contains(lower(replace(p_name, 'e', '\\u0065')), lower('\\u0065\\u0065')) AS escaped_hit FROM part"""
)
def search_forms(m):
    """A literal search without regard to case: in any one field, in the joined text of all name fields, and in its escaped form."""
    fields = [c("p_brand"), c("p_name"), c("p_type")]
    raw = F.lit(False)
    for f in fields:
        raw = raw | F.lower(f).contains("d#1")
    joined = F.concat_ws(" ", *[F.lower(f) for f in fields], F.concat_ws(" ", F.lower("p_brand"), F.lower("p_name")))
    escape = lambda q: "".join(f"\\u{ord(x):04x}" for x in q)
    stored = F.replace(c("p_name"), F.lit("e"), F.lit("\\u0065"))
    return m.table("part").select(c("p_partkey").alias("product_id"), raw.alias("raw_hit"), joined.contains("1 green").alias("joined_hit"), F.lower(stored).contains(escape("ee").lower()).alias("escaped_hit"))


#: What ends the list of items in a text.
ITEM_STOP = r"total|amount due|subtotal|tax|合计|总计|小计|税"
TEXT_LINES = """rows_ AS (
  SELECT invoice_id, CAST(total_amount AS BIGINT) AS total, ['Tea | green 3 4 12', 'Rice, white ' || (invoice_id % 9 + 1) || ' ' || CAST(total_amount AS BIGINT), 'x 1 2', CASE invoice_id % 4 WHEN 0 THEN '小计 9 9' WHEN 1 THEN 'Subtotal 5 5' WHEN 2 THEN 'Taxi ride 7 8' ELSE 'Salt 2.5 2 5' END, 'Late row 1 1 1'] AS l FROM invoices
), cut AS (SELECT invoice_id, total, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM rows_)"""


@query(
    f"""SELECT invoice_id, k - 1 AS k, name, CASE WHEN len(n) >= 3 THEN n[-3] WHEN n[-2] > 0 THEN n[-1] / n[-2] ELSE 0 END AS quantity, n[-2] AS price, n[-1] AS amount FROM (
    SELECT invoice_id, k, total, list_transform(regexp_extract_all(line, '\\d+(?:\\.\\d+)?'), lambda x: CAST(x AS DOUBLE)) AS n, trim(regexp_replace(regexp_extract(line, '^[^0-9]*'), '[|,，]', ' ', 'g')) AS name,
      k < coalesce(min(k) FILTER (regexp_matches(lower(line), '{ITEM_STOP}')) OVER (PARTITION BY invoice_id), 99) AS before FROM cut)
  WHERE before AND len(n) >= 2 AND length(name) >= 2 AND NOT (total > 0 AND n[-1] > 1.1 * total)""",
    TEXT_LINES,
)
def item_lines_until_total(m):
    """Items of a text up to the first line with a total, subtotal or tax in either language; an amount beyond 1.1 times the total is none."""
    whole = F.round("total_amount", 0).cast("bigint")
    third = F.when(c("invoice_id") % 4 == 0, "小计 9 9").when(c("invoice_id") % 4 == 1, "Subtotal 5 5").when(c("invoice_id") % 4 == 2, "Taxi ride 7 8").otherwise("Salt 2.5 2 5")
    second = F.concat(F.lit("Rice, white "), (c("invoice_id") % 9 + 1).cast("string"), F.lit(" "), whole.cast("string"))
    rows = m.invoices.select("invoice_id", whole.alias("total"), F.posexplode(F.array(F.lit("Tea | green 3 4 12"), second, F.lit("x 1 2"), third, F.lit("Late row 1 1 1"))).alias("k", "line"))
    w = Window.partitionBy("invoice_id")
    d = rows.withColumn("stop", F.min(F.when(F.lower("line").rlike(ITEM_STOP), c("k"))).over(w)).where(c("stop").isNull() | (c("k") < c("stop")))
    d = d.withColumn("n", F.transform(F.regexp_extract_all("line", F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double")))
    d = d.withColumn("name", F.trim(F.regexp_replace(F.regexp_extract("line", r"^[^0-9]*", 0), "[|,，]", " ")))
    amount, price = F.try_element_at("n", F.lit(-1)), F.try_element_at("n", F.lit(-2))
    d = d.where((F.size("n") >= 2) & (F.length("name") >= 2) & ~((c("total") > 0) & (amount > 1.1 * c("total"))))
    quantity = F.when(F.size("n") >= 3, F.try_element_at("n", F.lit(-3))).when(price > 0, amount / price).otherwise(0.0)
    return d.select("invoice_id", c("k").cast("bigint").alias("k"), "name", quantity.alias("quantity"), price.alias("price"), amount.alias("amount"))


@query(
    """SELECT invoice_id, CASE WHEN invoice_id % 2 = 0 THEN 'template' ELSE 'fallback' END AS mode, off,
  CASE WHEN invoice_id % 2 = 0 THEN CASE WHEN off THEN CAST(0.72 AS DOUBLE) ELSE CAST(0.86 AS DOUBLE) END ELSE CASE WHEN n > 0 THEN CAST(0.45 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END END AS confidence
  FROM (SELECT invoice_id, coalesce(n_items, 0) AS n, total_amount > 0 AND coalesce(n_items, 0) > 0 AND abs(CAST(calculated_total AS DOUBLE) * CASE WHEN invoice_id % 3 = 0 THEN 0.9 ELSE 1 END - CAST(total_amount AS DOUBLE)) > 0.05 * CAST(total_amount AS DOUBLE) AS off FROM invoices)"""
)
def recognition_confidence(m):
    """Confidence of a parsed text: with a template 0.86, or 0.72 where lines and total are over 5 percent apart; without one 0.45, or 0.2 where no line was found."""
    n = F.coalesce("n_items", F.lit(0))
    lines, total = c("calculated_total").cast("double") * F.when(c("invoice_id") % 3 == 0, 0.9).otherwise(1.0), c("total_amount").cast("double")
    off = (total > 0) & (n > 0) & (F.abs(lines - total) > 0.05 * total)
    template = c("invoice_id") % 2 == 0
    confidence = F.when(template, F.when(off, 0.72).otherwise(0.86)).otherwise(F.when(n > 0, 0.45).otherwise(0.2))
    return m.invoices.select("invoice_id", F.when(template, "template").otherwise("fallback").alias("mode"), off.alias("off"), confidence.alias("confidence"))


#: Words for packages, and how counts and sizes are written.
PACKAGES = r"\b(PET|CAN|BTL|BOTTLE|JAR|BAG|BOX|TIN)\b"
COUNTED = r"\b(\d+/\d+(?:\.\d+)?(?:FZ|OZ|ML|G|KG|LB|L)|\d+X\d+(?:\.\d+)?(?:FZ|OZ|ML|G|KG|LB|L|CT|PC|PCS|PK))\b"
SIZED = r"\b(\d+(?:\.\d+)?(?:FZ|OZ|ML|G|KG|LB|L))\b"


#: Packages that are no brand, the name of a group that a person has to decide, and the two rules.
NO_BRAND = ("PET", "CAN", "BTL", "BOTTLE", "CASE", "CS", "PK", "PACK")
UNDECIDED, UNSURE_RULE, SURE_RULE = "需要人工确认分摊组", "uncertain: missing brand, product name, or package/spec", "same brand + same normalized product + same spec/package"


@query(
    f"""SELECT product_id, CASE WHEN ok THEN brand || '|' || norm || '|' || array_to_string(specs, '|') ELSE '' END AS group_key, CASE WHEN ok THEN brand || ' ' || array_to_string(specs, ' ') ELSE '{UNDECIDED}' END AS group_name, CASE WHEN ok THEN '{SURE_RULE}' ELSE '{UNSURE_RULE}' END AS rule FROM (
  SELECT *, brand <> '' AND norm <> '' AND len(specs) > 0 AS ok FROM (SELECT product_id, coalesce(list_filter(string_split_regex(upper(name || tail), '[^A-Z0-9]+'), lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9]') AND x NOT IN {NO_BRAND})[1], '') AS brand,
    trim(regexp_replace(regexp_replace(lower(name), '\\s*x\\s*', 'X', 'g'), '\\s+', ' ', 'g')) AS norm,
    list_filter([nullif(regexp_extract(upper(name || tail), '{PACKAGES}', 1), ''), coalesce(nullif(regexp_extract(upper(name || tail), '{COUNTED}', 1), ''), nullif(regexp_extract(upper(name || tail), '{SIZED}', 1), ''))], lambda x: x IS NOT NULL) AS specs
    FROM (SELECT p_partkey AS product_id, CASE WHEN p_partkey % 10 = 9 THEN '12' || p_size WHEN p_partkey % 20 = 4 THEN '' ELSE p_brand || ' ' || p_name END AS name,
      CASE p_partkey % 5 WHEN 0 THEN ' can 12x355ml' WHEN 1 THEN ' 24/500ml' WHEN 2 THEN ' jar ' || p_size || 'oz' WHEN 3 THEN ' tinned' ELSE ' 5lb' END AS tail FROM part)))"""
)
def promo_candidates(m):
    """The promotion group of a product: brand, normalised name, package and size, with its name, and the rule; without one of them a person decides."""
    k = c("p_partkey")
    name = F.when(k % 10 == 9, F.concat(F.lit("12"), c("p_size").cast("string"))).when(k % 20 == 4, "").otherwise(F.concat_ws(" ", "p_brand", "p_name"))
    tail = F.when(k % 5 == 0, " can 12x355ml").when(k % 5 == 1, " 24/500ml").when(k % 5 == 2, F.concat(F.lit(" jar "), c("p_size").cast("string"), F.lit("oz"))).when(k % 5 == 3, " tinned").otherwise(" 5lb")
    d = m.table("part").select(k.alias("product_id"), name.alias("name"), F.concat(name, tail).alias("source"))
    tokens = F.split(F.upper(T.product_name(c("source"))), "[^A-Z0-9一-鿿]+")
    brand = F.coalesce(F.get(F.filter(tokens, lambda x: (x != "") & ~x.rlike("^[0-9]") & ~x.isin(*NO_BRAND)), F.lit(0)), F.lit(""))
    t = F.upper(T.unit_text(T.simplify(c("source"))))
    part = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    specs = F.array_compact(F.array(part(PACKAGES), F.coalesce(part(COUNTED), part(SIZED))))
    d = d.select("product_id", brand.alias("brand"), T.product_name(c("name")).alias("norm"), specs.alias("specs"))
    ok = (c("brand") != "") & (c("norm") != "") & (F.size("specs") > 0)
    key, shown = F.concat_ws("|", "brand", "norm", F.array_join("specs", "|")), F.concat_ws(" ", "brand", F.array_join("specs", " "))
    return d.select("product_id", F.when(ok, key).otherwise("").alias("group_key"), F.when(ok, shown).otherwise(UNDECIDED).alias("group_name"), F.when(ok, SURE_RULE).otherwise(UNSURE_RULE).alias("rule"))


@query(
    """SELECT invoice_id, path, before, after FROM (SELECT b.invoice_id, unnest(['status', 'total', 'items[0].quantity']) AS path, unnest([status, CAST(CAST(total_amount AS DECIMAL(18,2)) AS VARCHAR), CAST(q AS VARCHAR)]) AS before,
    unnest([CASE WHEN b.invoice_id % 3 = 0 THEN 'CONFIRMED' ELSE status END, CAST(CAST(calculated_total AS DECIMAL(18,2)) AS VARCHAR), CAST(CASE WHEN b.invoice_id % 4 = 0 THEN q + 1 ELSE q END AS VARCHAR)]) AS after
    FROM invoices b LEFT JOIN (SELECT invoice_id, arg_min(quantity, {'l': line_no, 'i': item_id}) AS q FROM items GROUP BY 1) x ON x.invoice_id = b.invoice_id) WHERE coalesce(before, '') <> coalesce(after, '')"""
)
def correction_paths(m):
    """What a correction changed in an invoice and its first line: the path of each field and its values as text."""
    q = m.lines.groupBy("invoice_id").agg(F.min_by("quantity", F.struct("line_no", "item_id")).alias("q"))
    d = m.invoices.join(q, "invoice_id", "left")
    change = lambda path, before, after: F.struct(F.lit(path).alias("path"), before.cast("string").alias("before"), after.cast("string").alias("after"))
    changes = F.array(
        change("status", c("status"), F.when(c("invoice_id") % 3 == 0, "CONFIRMED").otherwise(c("status"))),
        change("total", c("total_amount"), c("calculated_total")),
        change("items[0].quantity", c("q"), F.when(c("invoice_id") % 4 == 0, (c("q") + 1).cast("decimal(18,2)")).otherwise(c("q"))),
    )
    d = d.select("invoice_id", F.explode(changes).alias("x")).select("invoice_id", "x.*")
    return d.where(F.coalesce("before", F.lit("")) != F.coalesce("after", F.lit("")))


@query("SELECT supplier_id, CASE supplier_id % 4 WHEN 0 THEN '苹果 ' || name WHEN 1 THEN '食品 ' || name WHEN 2 THEN 'é ' || name ELSE name END AS name FROM suppliers_v")
def encoding_repair_ideographs(m):
    """Names whose UTF-8 was read as GB18030 or Latin-1 get back what they were; whole names and plain ones stay."""
    damaged = F.when(c("supplier_id") % 4 == 0, F.concat(F.lit("鑻规灉 "), "name")).when(c("supplier_id") % 4 == 1, F.concat(F.lit("食品 "), "name")).when(c("supplier_id") % 4 == 2, F.concat(F.lit("Ã© "), "name")).otherwise(c("name"))
    return m.suppliers.select("supplier_id", repaired_ideographs(damaged).alias("name"))


#: Phrases of the application that are stored in damaged forms too.
PHRASES = ("处理中...", "继续识别", "暂停识别", "取消剩余识别", "收起", "展开", "测试公司", "登录已失效，请重新登录。", "正在后台验证登录状态，不影响本地数据查看。", "当前离线，已进入离线模式。", "服务器启动中，请稍后重试。", "需要人工确认分摊组")


@query(
    """SELECT supplier_id, name, damaged FROM (SELECT supplier_id, supplier_id % 6 < 5 AS damaged, name || CASE supplier_id % 6 WHEN 0 THEN ' 处理中... ' WHEN 1 THEN ' 苹果' WHEN 2 THEN ' ü' WHEN 3 THEN ' 公司' WHEN 4 THEN ' 登录已失效，请重新登录。' ELSE ' 香蕉 鲈鱼' END AS name FROM suppliers_v)"""
)
def encoding_repair_all(m):
    """Names damaged in five ways (phrases that lost a byte, GB18030, Latin-1, escapes in escapes) come back and are flagged; whole ones stay.

    The likelihood is learned from the names that aren't damaged.
    """
    tails = ["澶勭悊涓?.. ", "鑻规灉", "Ã¼", "\\u005cu516c\\u53f8", "鐧诲綍宸插け鏁堬紝璇烽噸鏂扮櫥褰曘\u20ac?"]
    shown = F.lit("香蕉 鲈鱼")
    for k, tail in enumerate(tails):
        shown = F.when(c("supplier_id") % 6 == k, F.lit(tail)).otherwise(shown)
    s = m.suppliers.select("supplier_id", F.concat_ws(" ", "name", shown).alias("shown"))
    model = learned_likelihood(s.where(~suspicious(c("shown")) & ~c("shown").contains("\\u")), "shown")
    return s.select("supplier_id", repaired_text(c("shown"), model, PHRASES).alias("name"), "shown").select("supplier_id", "name", (c("name") != c("shown")).alias("damaged"))


