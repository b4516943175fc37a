"""Repair of damaged text: a test in built-in functions, and an Arrow-batched step only for rows that fail it."""

from __future__ import annotations

import itertools
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def damaged(x: Column) -> Column:
    """UTF-8 that was read as Latin-1: a lead byte and its continuation bytes as characters."""
    return x.rlike("[\\u00C2-\\u00DF][\\u0080-\\u00BF]|[\\u00E0-\\u00EF][\\u0080-\\u00BF]{2}")


@F.pandas_udf(StringType())
def _repair(texts: pd.Series) -> pd.Series:
    def one(t):
        if t is None:
            return None
        try:
            return t.encode("latin-1").decode("utf-8")
        except (UnicodeDecodeError, UnicodeEncodeError):
            return t

    return texts.map(one)


def repaired(x: Column) -> tuple[Column, Column]:
    """The repaired text and whether it was damaged; clean rows keep their text."""
    bad = F.coalesce(damaged(x), F.lit(False))
    return F.when(bad, _repair(F.when(bad, x))).otherwise(x), bad


_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _ESCAPE.sub(lambda x: chr(int(x.group(1), 16)), t))


def unescaped(x: Column) -> Column:
    """``\\uXXXX`` escapes as characters."""
    return F.when(x.contains("\\u"), _unescape(x)).otherwise(x)


# --- repair by likelihood -------------------------------------------------------------------

#: The common ideographs: level 1 of GB 2312, by its rule (rows 16 to 55).
COMMON = "".join(bytes([row, cell]).decode("gb2312") for row in range(0xB0, 0xD8) for cell in range(0xA1, 0xFF if row < 0xD7 else 0xFA))
#: Share of each class of characters in text, and its size: what a character costs that no clean name has shown.
CLASSES = {"ascii": (0.7, 95), "common": (0.2, len(COMMON)), "latin": (0.04, 192), "symbol": (0.03, 800), "ideograph": (0.02, 25_000), "other": (0.01, 60_000), "private": (1e-6, 6400), "control": (1e-8, 65)}
#: Learned bigrams that are kept, and their weight against the classes.
KEPT, LEARNED = 20_000, 0.7

#: What one common variant of the encoding has for the byte 0x80.
EURO = "\u20ac"

_COMMON = frozenset(COMMON)


def _class(ch: str) -> str:
    p = ord(ch)
    if 0x20 <= p < 0x7F:
        return "ascii"
    if ch in _COMMON:
        return "common"
    if p < 0x20 or 0x7F <= p < 0xA0 or p == 0xFFFD:
        return "control"
    if 0xC0 <= p < 0x180:
        return "latin"
    if 0x3400 <= p <= 0x9FFF:
        return "ideograph"
    if 0xE000 <= p <= 0xF8FF:
        return "private"
    return "symbol" if p < 0xC0 or 0x2000 <= p < 0x3040 or 0xFF00 <= p < 0xFFF0 else "other"


class Likelihood:
    """The length in bits of a text under a character-bigram model: learned counts, and the classes of characters for what was not seen."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.before: dict[str, int] = {}
        for pair, n in counts.items():
            self.before[pair[0]] = self.before.get(pair[0], 0) + n

    def bits(self, text: str) -> float:
        total, last = 0.0, "\n"
        for ch in text:
            share, size = CLASSES[_class(ch)]
            p = share / size
            if n := self.before.get(last):
                p = LEARNED * self.counts.get(last + ch, 0) / n + (1 - LEARNED) * p
            total -= math.log2(p)
            last = ch
        return total

    def likeliest(self, text: str) -> str:
        """The reading of the text's bytes with the fewest bits, itself included; it stays where another reading is no shorter."""
        readings = [text]
        for codec, euro in (("gb18030", False), ("gb18030", True), ("latin-1", False)):
            if euro and EURO not in text:
                continue
            try:
                data = b"\x80".join(part.encode(codec) for part in text.split(EURO)) if euro else text.encode(codec)
                readings.append(data.decode("utf-8"))
            except (UnicodeDecodeError, UnicodeEncodeError):
                continue
        return readings[0] if len(readings) == 1 else min(readings, key=self.bits)


def learned_likelihood(clean: DataFrame, column: str) -> Likelihood:
    """The model of a column of clean texts: counts of neighbouring characters, the most frequent KEPT of them (a line end stands before each text)."""
    text = F.concat(F.lit("\n"), F.col(column))
    pairs = clean.where(F.length(column) > 0).select(F.explode(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda k: F.substring(text, k, F.lit(2)))).alias("pair"))
    rows = pairs.groupBy("pair").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pair").limit(KEPT).collect()
    return Likelihood({r.pair: r.n for r in rows})


def suspicious(x: Column) -> Column:
    """Whether UTF-8 may have been read as GB18030 or Latin-1, by built-in functions.

    Read as GB18030, a character of three bytes begins with an ideograph outside level 1 or one of private use; one of two
    bytes is an ideograph beside a letter. Other texts of common ideographs are whole.
    """
    rest = F.translate(x, COMMON, "")
    return F.coalesce(rest.rlike("[\\u3400-\\u9FFF\\uE000-\\uF8FF]") | x.rlike("[A-Za-z][\\u3400-\\u9FFF]|[\\u3400-\\u9FFF][a-z]") | damaged(x), F.lit(False))


def repaired_ideographs(x: Column, model: Likelihood | None = None) -> Column:
    """UTF-8 that was read as GB18030 or Latin-1, as the likeliest of its readings; only suspicious texts leave the JVM."""
    model = model or Likelihood({})

    @F.pandas_udf(StringType())
    def likeliest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else model.likeliest(t))

    bad = suspicious(x)
    return F.when(bad, likeliest(F.when(bad, x))).otherwise(x)


def damaged_forms(phrase: str) -> list[str]:
    """How a phrase looks whose UTF-8 was read as GB18030 where a byte has no reading: it is left out, or a question mark stands for it or for it and the next."""
    data, forms = phrase.encode(), []
    for lost, euro in itertools.product(("", "?", "??"), (False, True)):
        out, rest = "", data
        while rest:
            try:
                out, rest = out + rest.decode("gb18030"), b""
            except UnicodeDecodeError as e:
                out += rest[: e.start].decode("gb18030")
                if euro and rest[e.start] == 0x80:
                    out, rest = out + EURO, rest[e.start + 1 :]
                else:
                    out, rest = out + lost[:1], rest[e.start + (2 if lost == "??" else 1) :]
        forms.append(out)
    return [f for f in dict.fromkeys(forms) if f and f != phrase]


def with_known_phrases(x: Column, phrases: tuple[str, ...]) -> Column:
    """Damaged forms of known phrases are put right wherever they stand, longer forms first; nothing can be read from bytes that are lost."""
    table = {form: phrase for phrase in phrases for form in damaged_forms(phrase)}
    for form in sorted(table, key=lambda f: (-len(f), f)):
        x = F.replace(x, F.lit(form), F.lit(table[form]))
    return x


#: Rounds of escapes within escapes.
ESCAPED = 3


def repaired_text(x: Column, model: Likelihood | None = None, phrases: tuple[str, ...] = ()) -> Column:
    """Escapes as characters, known phrases, then the likeliest reading of what still looks damaged."""
    for _ in range(ESCAPED):
        x = unescaped(x)
    return repaired_ideographs(with_known_phrases(x, phrases), model)


def has_damage(x: Column, model: Likelihood | None = None, phrases: tuple[str, ...] = ()) -> Column:
    return F.coalesce(repaired_text(x, model, phrases) != x, F.lit(False))
