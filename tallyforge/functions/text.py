"""Text functions: Column in, Column out, built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A default of traditional characters and their simplified forms; a full table is a parameter.
TRADITIONAL = "國際貿進實業東車門開關電龍馬鳥魚麥黃齊寶島嶺層對導將專寧審寫"
SIMPLIFIED = "国际贸进实业东车门开关电龙马鸟鱼麦黄齐宝岛岭层对导将专宁审写"

#: Units that are glued to their numbers, and how legal forms are written.
UNITS = "FZ|OZ|ML|G|KG|LB|L"
LEGAL = {"INC": "Inc.", "INC.": "Inc.", "INCORPORATED": "Inc.", "CO": "Co.", "CO.": "Co.", "COMPANY": "Company", "LTD": "Ltd.", "LTD.": "Ltd.", "LIMITED": "Ltd.", "LLC": "LLC", "CORP": "Corp.", "CORP.": "Corp.", "CORPORATION": "Corp."}
LEGAL_WORDS = r"(?<![A-Z0-9_])(INC\.?|INCORPORATED|CO\.?|COMPANY|LTD\.?|LIMITED|LLC|CORP\.?|CORPORATION|INTERNATIONAL|TRADING|IMPORT|EXPORT)(?![A-Z0-9_])"
#: Words at the end of a Chinese trade name that its key leaves out, simplified.
TRADE_ENDING = "(股份有限公司|有限责任公司|有限公司|公司|股份|国际|贸易|进出口|商行|企业)$"
PACKAGING = ("PET", "CAN", "BTL", "BOTTLE", "CASE", "CS", "PK", "PACK")


def simplify(x: Column, traditional: str = TRADITIONAL, simplified: str = SIMPLIFIED) -> Column:
    return F.translate(x, traditional, simplified)


def half_width(x: Column) -> Column:
    full = "".join(chr(k) for k in range(0xFF01, 0xFF5F)) + "　"
    return F.translate(x, full, "".join(chr(k - 0xFEE0) for k in range(0xFF01, 0xFF5F)) + " ")


def basic_name(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.translate(x, "　", " "))), r"\s+", " ")


def unit_text(x: Column) -> Column:
    """Trailing zeros go, units are upper-case and follow their number at once; ``n x size`` and ``n / size`` are joined."""
    end = r"(?![A-Za-z0-9_])"
    x = F.regexp_replace(x, rf"(?i)(\d+)\.0+\s*({UNITS}){end}", "$1$2")
    x = F.regexp_replace(x, rf"(?i)(\d+\.\d*?[1-9])0+\s*({UNITS}){end}", "$1$2")
    for unit in ("FL\\s*OZ", *UNITS.split("|")):
        out = "FZ" if unit.startswith("FL") else unit
        x = F.regexp_replace(x, rf"(?i)(\d+(?:\.\d+)?)\s*{unit}{end}", "$1" + out)
    x = F.regexp_replace(x, rf"(?i)(\d+)\s*[x×]\s*(\d+(?:\.\d+)?)\s*({UNITS}|CT|PCS|PC|PK){end}", "$1X$2$3")
    return F.regexp_replace(x, rf"(?i)(\d+)\s*/\s*(\d+(?:\.\d+)?)\s*({UNITS}){end}", "$1/$2$3")


#: Names that are often read wrongly, as patterns, and what they are.
CORRECTIONS = (("干页豆腐|仟页豆腐", "千页豆腐"), ("龍眼", "龙眼"), ("鳳梨", "凤梨"), ("蘋果", "苹果"), (r"(?i)(?<![A-Za-z0-9_])ITO\s+EN(?![A-Za-z0-9_])", "ITOEN"), (r"(?i)(?<![A-Za-z0-9_])I\s*T\s*O\s*E\s*N(?![A-Za-z0-9_])", "ITOEN"))


def corrected(x: Column, corrections=CORRECTIONS) -> Column:
    for pattern, name in corrections:
        x = F.regexp_replace(x, pattern, name)
    return x


def product_name(x: Column) -> Column:
    """The key of a product. Every letter x becomes X and swallows the blanks around it; keys depend on that."""
    x = F.lower(unit_text(corrected(simplify(F.trim(x)))))
    x = F.regexp_replace(x, r"""[，,。；;：:｜|()\[\]{}【】"'“”‘’]""", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"\s*[xX]\s*", "X"), r"\s*/\s*", "/")
    return F.trim(F.regexp_replace(F.translate(x, "　", " "), r"\s+", " "))


def product_name_local(x: Column) -> Column:
    x = F.lower(unit_text(corrected(F.trim(x), CORRECTIONS[:-1])))
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"""[，,。；;：:|()\[\]"']""", " "), r"\s+", " "))


def supplier_key(x: Column) -> Column:
    """Half-width, simplified, upper-case, without legal words; letters, digits and CJK only. An empty key falls back to the unstripped one."""
    whole = F.upper(simplify(half_width(x)))
    keep = "[^㐀-鿿A-Z0-9]+"
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, TRADE_ENDING, ""), LEGAL_WORDS, " "), keep, "")
    short = F.regexp_replace(short, "股份有限公司|有限公司|公司|股份", "")
    return F.coalesce(F.nullif(short, F.lit("")), F.regexp_replace(whole, keep, ""))


def supplier_english(x: Column) -> Column:
    """English name: a repeated sequence of words at the end stands for all, then immediate repeats go; legal forms are spelled their way."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(half_width(x), r"[^A-Za-z0-9&.'\-\s]", " "), r"\s+", " "))
    words = F.filter(F.split(F.upper(plain), " "), lambda w: w != "")
    n = F.size(words)
    # every tail and every length that may repeat through it, in order
    tries = F.flatten(F.transform(F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), lambda o: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor((n - o + 1) / 2).cast("int"))), lambda s: F.struct(o.alias("o"), s.alias("s")))))
    fits = lambda t: ((n - t["o"] + 1) % t["s"] == 0) & ((n - t["o"] + 1) > t["s"]) & (F.slice(words, t["o"], n - t["o"] + 1 - t["s"]) == F.slice(words, t["o"] + t["s"], n - t["o"] + 1 - t["s"]))
    hit = F.get(F.filter(tries, fits), F.lit(0))
    single = F.filter(words, lambda w, i: (i == 0) | (w != F.get(words, F.greatest(i - 1, F.lit(0)))))
    kept = F.when(hit.isNotNull(), F.slice(words, hit["o"], hit["s"])).otherwise(single)
    table = F.create_map(*[F.lit(v) for kv in LEGAL.items() for v in kv])
    spelled = F.transform(kept, lambda w: F.coalesce(F.try_element_at(table, w), F.when(F.length(w) <= 2, w), F.concat(F.substring(w, 1, 1), F.lower(F.substring(w, 2, 1000)))))
    return F.when(plain.rlike("[A-Za-z]"), F.array_join(spelled, " ")).otherwise("")


def supplier_parts(x: Column) -> tuple[Column, Column]:
    """The Chinese and the English part of a name."""
    raw = simplify(half_width(x))
    cn = F.array_join(F.regexp_extract_all(raw, F.lit("[㐀-鿿]+"), F.lit(0)), "")
    en = supplier_english(F.array_join(F.regexp_extract_all(raw, F.lit(r"[A-Za-z][A-Za-z0-9&.,'\-\s]+"), F.lit(0)), " "))
    return cn, en


def supplier_aliases(x: Column) -> Column:
    cn, en = supplier_parts(x)
    return F.array_distinct(F.filter(F.array(F.trim(x), F.trim(simplify(half_width(x))), cn, en), lambda a: a != ""))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; two empty texts are alike."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / n)


def token_similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.92 if one contains the other, else the common words over the larger set."""
    x, y = F.array_distinct(F.split(a, r"\s+")), F.array_distinct(F.split(b, r"\s+"))
    return F.when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.92).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y)))


def names_nearly_equal(a: Column, b: Column) -> Column:
    x, y = supplier_key(a), supplier_key(b)
    inside = (x.contains(y) & (F.length(y) >= 5)) | (y.contains(x) & (F.length(x) >= 5))
    return (x != "") & (y != "") & ((x == y) | inside | (similarity(x, y) >= 0.86))


def list_similarity(a: Column, b: Column) -> Column:
    """The names of a that have an equal or 0.88 similar one in b, over the longer list."""
    hits = F.size(F.filter(a, lambda x: F.exists(b, lambda y: (x == y) | (similarity(x, y) >= 0.88))))
    return F.when(F.greatest(F.size(a), F.size(b)) == 0, 0.0).otherwise(hits / F.greatest(F.size(a), F.size(b)))


def promo_key(name: Column) -> Column:
    """Brand and package of a name, or the empty text where one is missing."""
    up = F.upper(product_name(name))
    tokens = F.filter(F.split(up, "[^A-Z0-9一-鿿]+"), lambda t: (t != "") & ~t.rlike(r"^\d") & ~t.isin(*PACKAGING))
    brand = F.coalesce(F.get(tokens, F.lit(0)), F.lit(""))
    spec = F.regexp_extract(F.upper(unit_text(name)), rf"(?<![A-Z0-9_])(\d+(?:[/X]\d+)?(?:\.\d+)?(?:{UNITS}))(?![A-Z0-9_])", 1)
    return F.when((brand == "") | (spec == ""), "").otherwise(F.concat_ws("|", brand, product_name(name), spec))


def group_key(supplier: Column, number: Column, amount: Column) -> Column:
    """Supplier, number and amount to cents, cleaned and joined."""
    return F.concat_ws("|", supplier_key(supplier), F.upper(F.regexp_replace(number, "[^A-Za-z0-9]", "")), amount.cast("decimal(18,2)").cast("string"))


def invoice_date(x: Column) -> Column:
    """ISO date of ``Y-M-D``, ``Y/M/D`` or ``M/D/Y``; what is no date from 1900 to 2200 is empty."""
    iso = r"^\s*(\d{4})[-/](\d{1,2})[-/](\d{1,2})"
    us = r"^\s*(\d{1,2})[-/](\d{1,2})[-/](\d{4})"
    part = lambda p, k: F.lpad(F.regexp_extract(x, p, k), 4 if (p == iso and k == 1) or (p == us and k == 3) else 2, "0")
    text = F.when(x.rlike(iso), F.concat_ws("-", part(iso, 1), part(iso, 2), part(iso, 3))).when(x.rlike(us), F.concat_ws("-", part(us, 3), part(us, 1), part(us, 2)))
    d = F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")
    return F.coalesce(F.when(F.year(d).between(1900, 2200), F.date_format(d, "yyyy-MM-dd")), F.lit(""))


def page_info(name: Column) -> tuple[Column, Column, Column]:
    """Page, pages (0 if unknown) and the base of a file name such as ``scan_p2of3.jpg``."""
    stem = F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")
    p = r"(?i)[ _-]*(?:page|p)[ _-]*(\d+)(?:[ _-]*(?:of|/)[ _-]*(\d+))?$"
    page = F.coalesce(F.nullif(F.regexp_extract(stem, p, 1), F.lit("")).try_cast("int"), F.lit(1))
    pages = F.coalesce(F.nullif(F.regexp_extract(stem, p, 2), F.lit("")).try_cast("int"), F.lit(0))
    return page, pages, F.lower(F.regexp_replace(stem, p, ""))
