"""Language ID by cross-parsing entropy against suffix automata of labelled text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import release, ship

#: Bounds of the labelled sample: languages (those with most labelled rows), documents per language, symbols from each (of a window of so many
#: characters anywhere in its text), symbols per language and in all.
LANGUAGES = 256
DOCS_PER_LANGUAGE = 64
SYMBOLS_PER_DOC = 400
WINDOW = 800
SYMBOLS_PER_LANGUAGE = 16_000
SYMBOLS_IN_ALL = 400_000
#: Symbols of a language's own alphabet: 0 is any run of characters that aren't letters, the last is any rarer letter.
ALPHABET = 64
#: Symbols of a segment. The segments of a text are parsed side by side, then joined to what one parse of the whole text gives.
SEGMENT = 1024
#: Characters of the texts that are parsed at a time (one longer text is taken alone).
CHARACTERS = 1_000_000


def train_rows(doc_id: Column) -> Column:
    """The documents that may be learned from."""
    return F.crc32(doc_id.cast("string")) % 5 != 0


class SymbolMap:
    """Code points to the letters of all languages: 0 is no letter, the last is any other letter."""

    def __init__(self, letters: str):
        self.letters = letters
        other = len(letters) + 1
        t = np.zeros(0x110000, np.uint16)
        for lo in range(0, 0x30000, 0x4000):
            t[lo : lo + 0x4000] = [other if chr(c).isalpha() else 0 for c in range(lo, lo + 0x4000)]
        t[0x30000:0x32500] = other
        for k, c in enumerate(letters, 1):
            for x in {c, c.upper()}:
                if len(x) == 1:
                    t[ord(x)] = k
        self.table = t

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of all texts, runs of 0 as one, and the offsets of the texts."""
        cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        s = self.table[cp]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        return s[keep], np.concatenate(([0], np.cumsum(keep)))[bounds]


def suffix_automaton(s: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, size = [-1], [0]
    last = 0
    for c in s:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Model:
    """The automata of all languages in one transition table, each over the letters of its own language."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        own = []
        for lang in self.languages:
            counts = Counter(c for t in samples[lang] for c in t.lower() if c.isalpha())
            own.append([c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: ALPHABET - 2]])
        self.letters = "".join(sorted(set().union(*own))) if own else ""
        m = SymbolMap(self.letters)
        place = {c: k for k, c in enumerate(self.letters, 1)}
        self.own = np.full((len(own), len(self.letters) + 2), ALPHABET - 1, np.uint8)
        self.own[:, 0] = 0
        for k, letters in enumerate(own):
            self.own[k, [place[c] for c in letters]] = np.arange(1, len(letters) + 1)
        each = min(SYMBOLS_PER_LANGUAGE, SYMBOLS_IN_ALL // max(1, len(samples)))
        tables, roots, at = [], [], 0
        for lang, own_symbols in zip(self.languages, self.own, strict=True):
            out: list[int] = []
            for t in samples[lang]:
                s, _ = m.symbols([t])
                out += own_symbols[s[:SYMBOLS_PER_DOC]].tolist() + [0]
                if len(out) >= each:
                    break
            nxt = suffix_automaton(out[:each])
            table = np.full((len(nxt), ALPHABET), -1, np.int32)
            for k, row in enumerate(nxt):
                for c, q in row.items():
                    table[k, c] = (at + q) * ALPHABET
            tables.append(table)
            roots.append(at * ALPHABET)
            at += len(nxt)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.roots = np.array(roots, np.int32)

    def phrases(self, s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases of each text by language: how many longest matches cover it. A symbol that the language doesn't have is a phrase."""
        docs, n = len(bounds) - 1, len(self.languages)
        size = np.diff(bounds)
        pieces = -(-size // SEGMENT)
        doc = np.repeat(np.arange(docs), pieces)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = bounds[doc] + k * SEGMENT
        length = np.minimum(size[doc] - k * SEGMENT, SEGMENT)
        roots, table = self.roots[:, None], self.table
        first = table[roots + np.arange(ALPHABET, dtype=np.int32)]
        first = np.where(first < 0, roots, first)
        # every piece from the start of its automaton; the longest pieces stand first
        order = np.argsort(-length, kind="stable")
        o_start, o_length = start[order], length[order]
        count = np.zeros((n, len(doc)), np.int32)
        state = np.repeat(roots, len(doc), 1)
        row = np.arange(n)[:, None]
        active = len(doc)
        for t in range(int(o_length[0]) if len(doc) else 0):
            while active and o_length[active - 1] <= t:
                active -= 1
            c = self.own[:, s[o_start[:active] + t]]
            old = state[:, :active]
            now = table.take(old + c)
            miss = now < 0
            at = np.nonzero(miss)
            now[at] = first[at[0], c[at]]
            count[:, :active] += miss | (old == roots)
            state[:, :active] = now
        back = np.empty(len(doc), np.int64)
        back[order] = np.arange(len(doc))
        count, ends = count[:, back], state[:, back]
        # a piece that its text enters within a phrase is parsed again from there, until both parses meet
        out, more = ends.copy(), np.zeros_like(count)
        row, piece = np.nonzero(np.broadcast_to(k > 0, (n, len(doc))))
        while len(row):
            x, y = self.roots[row], out[row, piece - 1]
            extra = np.zeros(len(row), np.int32)
            end, changed = ends[row, piece].copy(), np.zeros(len(row), bool)
            live, t = np.flatnonzero(x != y), 0
            while len(live):
                r, p = row[live], piece[live]
                c = self.own[r, s[start[p] + t]]
                for z, sign in ((x, -1), (y, 1)):
                    now = table.take(z[live] + c)
                    miss = now < 0
                    extra[live] += sign * (miss | (z[live] == self.roots[r]))
                    z[live] = np.where(miss, first[r, c], now)
                t += 1
                live = live[x[live] != y[live]]
                over = length[piece[live]] <= t
                end[live[over]], changed[live[over]] = y[live[over]], True
                live = live[~over]
            more[row, piece] = extra
            moved = end != out[row, piece]
            out[row, piece] = end
            row, piece = row[moved], piece[moved] + 1
            inside = piece < len(doc)
            row, piece = row[inside], piece[inside]
            row, piece = row[k[piece] > 0], piece[k[piece] > 0]
        found = np.zeros((docs, n))
        for lang in range(n):
            found[:, lang] = np.bincount(doc, count[lang] + more[lang], docs)
        return found


def fit(documents: DataFrame) -> Model:
    """Learn from a bounded sample of the labelled rows that :func:`train_rows` allows (see the bounds above).

    The rows of a language and the window of each are chosen by hash.
    """
    labelled = documents.where(train_rows(F.col("doc_id")) & F.col("lang").isNotNull())
    most = labelled.groupBy("lang").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "lang").limit(LANGUAGES).select("lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    usable = labelled.where(F.col("text").rlike(r"\p{L}")).join(F.broadcast(most), "lang", "left_semi")
    chosen = usable.select("doc_id", "lang").withColumn("_rank", rank).where(F.col("_rank") <= DOCS_PER_LANGUAGE)
    chosen = chosen.select("doc_id").distinct()
    # at most DOCS_PER_LANGUAGE ids a language
    start = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - WINDOW + 1, F.lit(1))).cast("int") + 1
    window = F.substring(F.col("text"), start, F.lit(WINDOW))
    rows = usable.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", "lang", window.alias("text")).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, str(r.doc_id), r.text)):
        samples.setdefault(r.lang, []).append(r.text)
    return Model(samples)


_maps: dict[str, SymbolMap] = {}


def _symbol_map(letters: str) -> SymbolMap:
    if letters not in _maps:
        _maps.clear()
        _maps[letters] = SymbolMap(letters)
    return _maps[letters]


def judge(shared, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    m = Model.__new__(Model)
    m.languages, m.letters, m.own, m.table, m.roots = shared
    symbols = _symbol_map(m.letters)
    texts = [t or "" for t in texts]
    langs: list[str] = []
    scores: list[float] = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < CHARACTERS):
            size += len(texts[j])
            j += 1
        s, bounds = symbols.symbols(texts[i:j])
        letters = np.concatenate(([0], np.cumsum(s != 0)))
        some = letters[bounds[1:]] > letters[bounds[:-1]]
        if not m.languages:
            some[:] = False
            p = np.ones((j - i, 1))
        else:
            p = m.phrases(s, bounds)
        if p.shape[1] > 1:
            two = np.partition(p, 1, axis=1)
            score = np.clip((two[:, 1] - two[:, 0]) / np.maximum(two[:, 1], 1), 0, 1)
        else:
            score = np.ones(j - i)
        langs += [m.languages[k] if ok else "und" for k, ok in zip(p.argmin(1), some, strict=True)]
        scores += np.where(some, score, 0.0).tolist()
        i = j
    return langs, scores


def judged(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """row (all columns of ``documents``) and language (lang_pred, score); see :func:`predicted`."""
    spark = documents.sparkSession
    ship(spark)
    model = model or fit(documents)
    shared = spark.sparkContext.broadcast((model.languages, model.letters, model.own, model.table, model.roots))

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tallyforge.llm.common import release
        from tallyforge.llm.language_id import judge

        for texts in batches:
            langs, scores = judge(shared.value, texts.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])
        release()

    columns = [F.col(f"`{c}`") for c in documents.columns]
    return documents.select(F.struct(*columns).alias("row"), language(F.col("text")).alias("language"))


def predicted(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every text.

    The language whose automaton needs the fewest phrases for the text, divided by its symbols, wins; ties go to
    the first language by name. The score is the share of phrases by which the runner-up needs more (1 with a
    single language). Texts that are null, empty or without a letter, and all texts when nothing could be learned,
    are ``und`` with score 0. A null doc_id is not held out. Very long texts are parsed whole.
    Other columns are ignored; equal rows give equal rows; an empty table gives an empty result.
    """
    held = F.coalesce(~train_rows(F.col("row.doc_id")), F.lit(False))
    out = judged(documents.select("doc_id", "text", "lang"), model)
    return out.select("row.doc_id", held.alias("held_out"), "language.lang_pred", "language.score")


def accepted(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that have a language; those without text or without a letter (``und``) go.

    Where nothing could be learned, all rows with a letter stay. Repeated rows are kept or go alike; null ids, languages
    and columns of any name are passed on.
    """
    model = fit(documents)
    if not model.languages:
        return documents.where(F.col("text").rlike(r"\p{L}"))
    out = judged(documents, model).where("language.lang_pred <> 'und'").select("row.*")
    del model
    release()  # what the fit has used on the driver goes back before the next stage
    return out
