"""PII: base patterns, and information-theoretic sanitisation of terms that reveal protected entities."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import lean, ship, stored

#: The base kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

TERM = re.compile(r"[^\W\d_]{4,}")
#: Words on either side of an entity that are its context.
WINDOW = 6
#: A term is disclosing if, of the texts that hold it, at least this share holds one and the same entity in their context,
MIN_SHARE = 0.5
#: in at least so many different contexts, with at least so many bits of pointwise mutual information.
MIN_CONTEXTS = 4
MIN_BITS = 6.0
#: Tokens that may be secrets: so many letters, digits and marks, both letters and digits, with so many bits a character. No value comes
#: twice, so their kind is the protected entity: a term is a cue of it if, of the texts that hold the term, at least MIN_SHARE hold such a
#: token in its context, in MIN_CONTEXTS contexts, and if it gives at least this share of the information that a text has such a token.
SECRET = re.compile(r"[A-Za-z0-9+/_-]{16,}")
SECRET_BITS = 3.0
MIN_GAIN = 0.8
#: The mark of a cue among the terms.
CUE = "="


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base entities, leftmost and not overlapping within a kind; failing matches are dropped."""
    out = []
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        s = at
        while s > done and text[s - 1] in LOCAL_CHARS:
            s -= 1
        m = DOMAIN.match(text, at) if s < at else None
        if m:
            out.append((s, m.end(), 0))
            done = at = m.end()
        else:
            at += 1
    for m in IP.finditer(text):
        # parts may have any number of digits, so sizes are compared first
        parts = m.group().split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
            out.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out)


class Places:
    """The whole words of a text and where they stand, found once."""

    def __init__(self, text: str):
        self.found = list(TERM.finditer(text))
        self.starts, self.ends = [m.start() for m in self.found], [m.end() for m in self.found]

    def around(self, s: int, e: int) -> list[re.Match]:
        """The nearest WINDOW words that end before a span and that begin after it, however far away."""
        before, after = bisect_right(self.ends, s), bisect_left(self.starts, e)
        return self.found[max(0, before - WINDOW) : before] + self.found[after : after + WINDOW]


def contexts(text: str, spans: list[tuple[int, int, int]], places: Places | None = None) -> list[tuple[str, str, str]]:
    """(entity, term, context) for the terms around each entity. The context is the digest of the words around it."""
    out = []
    places = places or Places(text if spans else "")
    for s, e, kind in spans:
        entity = f"{KINDS[kind] if kind < 4 else 'secret'}:{text[s:e]}"
        words = [m.group().lower() for m in places.around(s, e)]
        mark = hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=8).hexdigest()
        out += [(entity, w, mark) for w in set(words)]
    return out


def tokens(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, 5) of the tokens outside the base spans that may be secrets."""
    out = []
    for m in SECRET.finditer(text):
        t = m.group()
        n = len(t)
        if any(c.isdigit() for c in t) and any(c.isalpha() for c in t) and not any(s < m.end() and m.start() < e for s, e, _ in base):
            if -sum(k / n * math.log2(k / n) for k in Counter(t).values()) >= SECRET_BITS:
                out.append((m.start(), m.end(), 5))
    return out


def kind_contexts(text: str, found: list[tuple[int, int, int]]) -> list[tuple[str, str, str]]:
    """("secret", term, context) for the terms around tokens, each term once a text; an empty term stands for the text itself.

    The context is the digest of the token, so a copied one counts once.
    """
    once = {}
    places = Places(text if found else "")
    for s, e, k in found:
        value = hashlib.blake2b(text[s:e].encode("utf-8", "replace"), digest_size=8).hexdigest()
        once |= {t: value for _, t, _ in contexts(text, [(s, e, k)], places)}
    return [("secret", "", "")] + [("secret", t, c) for t, c in once.items()] if found else []


def cooccurrences(documents: DataFrame) -> DataFrame:
    """(entity, term, context, texts): the terms around every entity of all documents, and how often."""
    ship(documents.sparkSession)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallyforge.llm.pii import base_spans, contexts, kind_contexts, tokens

        for b in batches:
            e, t, c = [], [], []
            for text in b.column("text").to_pylist():
                if text:
                    spans = base_spans(text)
                    for x, y, z in contexts(text, spans) + kind_contexts(text, tokens(text, spans)):
                        e.append(x)
                        t.append(y)
                        c.append(z)
            yield pa.RecordBatch.from_pydict({"entity": pa.array(e, pa.string()), "term": pa.array(t, pa.string()), "context": pa.array(c, pa.string())})

    return documents.select("text").mapInArrow(lean(around), "entity string, term string, context string").groupBy("entity", "term", "context").agg(F.count("*").alias("texts"))


#: So many terms may be broadcast; more are matched by a join.
BROADCAST_TERMS = 200_000


def words(text: str) -> set[str]:
    """The distinct words of a text in lower case. Each is lower-cased by itself, as its length may change."""
    return {w.lower() for w in TERM.findall(text)}


def words_of(documents: DataFrame) -> DataFrame:
    """(key, term): the distinct words of each text; the key tells texts apart."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallyforge.llm.pii import words

        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                if text and (own := list(words(text))):
                    yield pa.RecordBatch.from_pydict({"key": pa.array([key] * len(own), pa.int64()), "term": pa.array(own, pa.string())})

    return documents.select(F.xxhash64("text").alias("key"), "text").mapInArrow(lean(split), "key bigint, term string")


def frequencies(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how many texts hold each of the terms. Few terms are counted where the texts are, more by a join."""
    few = [r.term for r in terms.limit(BROADCAST_TERMS + 1).collect()]
    if len(few) > BROADCAST_TERMS:
        return words_of(documents).join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    shared = documents.sparkSession.sparkContext.broadcast(frozenset(few))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallyforge.llm.pii import words

        seen: Counter = Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                if text:
                    seen.update(shared.value.intersection(words(text)))
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    return documents.select("text").mapInArrow(lean(count), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def revealed(documents: DataFrame) -> DataFrame:
    """(term, entity, bits): terms that reveal an entity, from the co-occurrences and frequencies of the whole corpus.

    With N texts, a term in n of them, an entity in m contexts and both together in k of these, the term reveals the entity
    by log2(k * N / (n * m)) bits, and its disclosure is k / n. Equal contexts count once, so a term isn't disclosing just
    because its document was copied. Terms that stand in many contexts of other entities are out before their texts are counted.
    For the kind of secrets, k and m count texts, as no value comes twice.
    """
    near = stored(cooccurrences(documents), "entity-terms")
    joint = near.where("term <> ''").groupBy("entity", "term").agg(F.count("*").alias("k"), F.sum("texts").alias("kt")).where(F.col("k") >= MIN_CONTEXTS)
    around = near.groupBy("term").agg(F.count("*").alias("any"))
    joint = stored(joint.join(around, "term").where(F.col("k") >= MIN_SHARE * F.col("any")), "joint")
    contexts_ = near.where("term <> ''").select("entity", "context").distinct().groupBy("entity").agg(F.count("*").alias("m"))
    texts = near.where("term = ''").select("entity", F.col("texts").alias("mt"))
    per_entity = contexts_.join(texts, "entity", "left")
    df = frequencies(documents, joint.select("term").distinct())
    total = F.lit(float(max(1, documents.count())))
    kind = F.col("mt").isNotNull()
    n = F.when(kind, F.col("n")).otherwise(F.greatest("n", "any"))
    together = F.when(kind, F.col("kt")).otherwise(F.col("k"))
    bits = F.log2(together * total / (n * F.coalesce("mt", "m")))
    enough = F.when(kind, bits >= MIN_GAIN * F.log2(total / F.col("mt"))).otherwise(bits >= MIN_BITS)
    out = joint.join(per_entity, "entity").join(df, "term").where((together / n >= MIN_SHARE) & enough & (bits > 0))
    return out.select("term", "entity", bits.alias("bits"))


def found(documents: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term and n_secret of every row (with ``texts``, the sanitised text too).

    Base spans come from the patterns. A term whose disclosure of a protected entity exceeds the thresholds is a span of kind
    ``term`` wherever it stands, outside the base spans. A token that may be a secret is a span of kind ``secret`` where a cue
    stands in its context, and so is the cue, as a ``term``. In the sanitised text base entities and secrets are generalised to their
    kind and terms are removed. Positions count code points. A null or empty text has no spans; very long texts are read whole;
    equal rows give equal rows; other columns are ignored; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    ship(spark)
    mark = F.when(F.col("entity") == "secret", F.concat(F.lit(CUE), F.col("term"))).otherwise(F.col("term"))
    terms = stored(revealed(documents).select("term", mark.alias("mark")).distinct(), "disclosing-terms")
    few = [r.mark for r in terms.limit(BROADCAST_TERMS + 1).collect()]
    rows = documents.select("doc_id", "text")
    if len(few) > BROADCAST_TERMS:  # each text gets its own terms by a join
        own = words_of(documents).join(terms, "term").groupBy("key").agg(F.collect_set("mark").alias("own"))
        rows = rows.withColumn("key", F.xxhash64("text")).join(own, "key", "left").drop("key")
        few = []
    else:
        rows = rows.withColumn("own", F.lit(None).cast("array<string>"))
    shared = spark.sparkContext.broadcast(frozenset(few))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallyforge.llm.pii import all_spans, digest, sanitised

        for b in batches:
            counts: list[list[int]] = [[], [], [], []]
            shas, all_, clean, n_term, n_secret = [], [], [], [], []
            for text, own in zip(b.column("text").to_pylist(), b.column("own").to_pylist(), strict=True):
                base, more = all_spans(text or "", frozenset(own) if own else shared.value)
                c = Counter(k for _, _, k in base)
                for k in range(4):
                    counts[k].append(c[k])
                shas.append(hashlib.sha256(digest(base).encode()).hexdigest())
                all_.append(digest(base + more))
                extra = Counter(k for _, _, k in more)
                n_term.append(extra[4])
                n_secret.append(extra[5])
                if texts:
                    clean.append(sanitised(text, base + more))
            cols = {"doc_id": b.column("doc_id")} | {f"n_{k}": pa.array(v, pa.int64()) for k, v in zip(KINDS, counts, strict=True)}
            cols |= {"base_sha256": pa.array(shas, pa.string()), "spans": pa.array(all_, pa.string()), "n_term": pa.array(n_term, pa.int64()), "n_secret": pa.array(n_secret, pa.int64())}
            yield pa.RecordBatch.from_pydict(cols | ({"clean": pa.array(clean, pa.string())} if texts else {}))

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_term bigint, n_secret bigint" + (", clean string" if texts else "")
    return rows.mapInArrow(lean(work), schema)


def all_spans(text: str, terms: frozenset[str]) -> tuple[list, list]:
    """The base spans, and outside them the spans of disclosing terms (kind 4) and of secrets with a cue (kind 5)."""
    base = base_spans(text)
    more = set()
    if terms:
        if not terms.isdisjoint(words(text)):
            for m in TERM.finditer(text):
                if m.group().lower() in terms and not any(s < m.end() and m.start() < e for s, e, _ in base):
                    more.add((m.start(), m.end(), 4))
        secrets = tokens(text, base)
        places = Places(text if secrets else "")
        for s, e, _ in secrets:
            cues = [m for m in places.around(s, e) if CUE + m.group().lower() in terms]
            if cues:
                more.add((s, e, 5))
                more |= {(m.start(), m.end(), 4) for m in cues if not any(a < m.end() and m.start() < z for a, z, _ in base)}
    return base, sorted(more)


def digest(spans: list[tuple[int, int, int]]) -> str:
    names = (*KINDS, "term", "secret")
    return ",".join(f"{names[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def sanitised(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with base entities generalised to their kind and disclosing terms removed."""
    if text is None:
        return None
    out, at = [], 0
    for s, e, k in sorted(spans):
        if s < at:
            continue
        out += [text[at:s], f"<{KINDS[k]}>" if k < 4 else "<secret>" if k == 5 else ""]
        at = e
    return "".join(out) + text[at:]
