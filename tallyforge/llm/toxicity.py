"""Toxicity: a learned lexicon in a trie, Levenshtein automata over it, and context-window scores."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import lean, shingle_hashes, ship, stored, text_chunks

#: Bound of the labelled rows that are learned from.
FIT_ROWS = 20_000
#: Documents with label 1 that a term needs, their share of all with label 1, and the share of a term's documents that have it.
MIN_DOCS = 5
SUPPORT = 0.01
MIN_PURITY = 0.9
STEM_PURITY = 0.97
#: Shortest stem, longest stem, and shortest term that may be misspelled (by one edit).
STEM = (4, 8)
FUZZY_FROM = 5
#: Words around a hit that are searched for marks of quotation.
WINDOW = 8
#: Reporting words and quotation marks, and the weight of a hit in a quotation.
REPORTING = frozenset("said says say called calls wrote writes quote quoted quotes term word reported dit disait sagte schrieb zitat dijo cita".split())
OPEN_MARKS, CLOSE_MARKS = "\"“”„«‹'‘", "\"”“»›'’"
QUOTED_WEIGHT = 0.4
#: The weight of a misspelled hit beside others.
FUZZY_WEIGHT = 0.5
#: A document counts as toxic from this score on.
THRESHOLD = 0.3
#: Pseudo-counts for each class of evidence: (toxic, clean).
PRIOR = {"none": (0.02, 1.0), "quoted": (0.5, 2.0), "fuzzy": (0.6, 0.4), "one": (0.9, 0.1), "more": (0.95, 0.05)}

#: The classes from the weakest evidence to the strongest.
CLASSES = ("none", "quoted", "fuzzy", "one", "more")
#: Words without a hit that a task remembers.
CLEAN_WORDS = 600_000

WORD = re.compile(r"\w+")


def train_rows(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 != 2


class Lexicon:
    """Terms (whole words) and stems (word beginnings, written with a star) in one trie."""

    def __init__(self, terms: list[str], exact_only: frozenset[str] = frozenset()):
        self.terms = sorted(terms)
        self.root: dict = {}
        self.heads: dict[int, set[str]] = {}
        self.tails: dict[int, set[str]] = {}
        self.sure: dict[str, str] = {}
        self.stems: dict[int, dict[str, str]] = {}
        for term in self.terms:
            body = term.rstrip("*")
            if term != body:
                self.stems.setdefault(len(body), {})[body] = term
            else:
                self.sure[body] = term
            if len(body) < FUZZY_FROM or term in exact_only:
                continue
            node = self.root
            for c in body:
                node = node.setdefault(c, {})
            node["*" if term != body else "$"] = term
            h = len(body) // 2
            self.heads.setdefault(h, set()).add(body[:h])
            self.tails.setdefault(len(body) - h, set()).add(body[h:])
        self.tail_at = sorted({(len(b) // 2 + d, len(b) - len(b) // 2) for t in self.terms for b in [t.rstrip("*")] if len(b) >= FUZZY_FROM and t not in exact_only for d in (-1, 0, 1)})

    def find(self, word: str) -> tuple[str, int] | None:
        """The term of a lower-case word and its distance, 0 or 1."""
        got = self.sure.get(word)
        if got:
            return got, 0
        for n, stems in self.stems.items():
            got = stems.get(word[:n])
            if got:
                return got, 0
        if len(word) < FUZZY_FROM - 1 or not self.maybe(word):
            return None
        return self.walk(word)

    def maybe(self, word: str) -> bool:
        """One edit leaves the first or the second half of a term as it is; most words have neither."""
        for n, some in self.heads.items():
            if word[:n] in some:
                return True
        tails = self.tails
        return any(word[a : a + n] in tails[n] for a, n in self.tail_at)

    def walk(self, word: str) -> tuple[str, int] | None:
        """The Levenshtein automaton of the word for one edit, intersected with the trie.

        A state is the set of (position in the word, edits); the walk follows the trie's edges while it isn't empty.
        A stem is accepted as soon as it is spelled, a whole term only where the word ends too.
        """
        n = len(word)
        stack = [(self.root, frozenset(((0, 0), (1, 1))))]
        while stack:
            node, state = stack.pop()
            if "*" in node and any(i >= 3 for i, _ in state):
                return node["*"], 1
            if "$" in node and any(n - i + e <= 1 for i, e in state):
                return node["$"], 1
            for c, child in node.items():
                if len(c) != 1 or c in "*$":
                    continue
                after = set()
                for i, e in state:
                    if i < n and word[i] == c:
                        after.add((i + 1, e))
                    if e == 0:
                        after.add((i, 1))
                        if i < n:
                            after.add((i + 1, 1))
                            if i + 1 < n and word[i + 1] == c:
                                after.add((i + 2, 1))
                if after:
                    stack.append((child, frozenset(after)))
        return None

    def hits(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, term, distance) of each hit in a lower-case text."""
        out = []
        seen: dict[str, tuple[str, int] | None] = {}
        for m in WORD.finditer(text):
            w = m.group()
            if w not in seen:
                seen[w] = self.find(w)
            if seen[w]:
                out.append((m.start(), m.end(), *seen[w]))
        return out


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the window around a hit marks it as quotation: marks on both sides in one sentence, or a reporting word before it."""
    before = re.split(r"[.!?\n]", text[max(0, start - 12 * WINDOW) : start])[-1]
    after = re.split(r"[.!?\n]", text[end : end + 12 * WINDOW])[0]
    words = WORD.findall(before)[-WINDOW:]
    if REPORTING.intersection(words[-4:]):
        return True
    opened = sum(before.count(c) for c in set(OPEN_MARKS))
    return opened % 2 == 1 and any(c in CLOSE_MARKS for c in after)


def weigh(lexicon: Lexicon, text: str) -> tuple[str, float]:
    """The class of a document (none, quoted, fuzzy, one or more exact hits outside quotation), and its hits beyond what the class needs."""
    exact, fuzzy, in_quotes = 0.0, 0, 0
    for start, end, _, d in lexicon.hits(text):
        if quoted(text, start, end):
            in_quotes += 1
            exact += QUOTED_WEIGHT if d == 0 else 0
        elif d:
            fuzzy += 1
        else:
            exact += 1
    if exact >= 2:
        return "more", exact - 2 + FUZZY_WEIGHT * fuzzy
    if exact >= 1:
        return "one", exact - 1 + FUZZY_WEIGHT * fuzzy
    if fuzzy:
        return "fuzzy", exact + FUZZY_WEIGHT * (fuzzy - 1)
    return ("quoted", QUOTED_WEIGHT * (in_quotes - 1)) if in_quotes else ("none", 0.0)


def evidence(lexicon: Lexicon, text: str) -> str:
    return weigh(lexicon, text)[0]


class Model:
    def __init__(self, terms: list[str], counts: dict[str, tuple[int, int]], exact_only: frozenset[str] = frozenset()):
        self.terms, self.exact_only = terms, exact_only
        self.score = {}
        for k, (a, b) in PRIOR.items():
            p, n = counts.get(k, (0, 0))
            self.score[k] = (p + a) / (p + n + a + b)

    def lexicon(self) -> Lexicon:
        return Lexicon(self.terms, self.exact_only)


def features(text: str) -> set[str]:
    """The distinct words of a text, and their beginnings with a star."""
    words = {w for w in WORD.findall((text or "").lower()) if len(w) >= 3 and not w.isdigit()}
    lo, hi = STEM
    return words | {w[:k] + "*" for w in words for k in range(lo, min(len(w), hi + 1))}


def chosen_terms(rows: list[tuple[str, int, int]], positives: int) -> list[str]:
    """The fewest terms: the shortest pure stems, then the words that no stem covers.

    A term needs MIN_DOCS documents and SUPPORT of all with label 1, so that the words of one much-copied document are
    no terms. A stem must join the documents of several words.
    """
    least = max(MIN_DOCS, SUPPORT * positives)
    stats = {f: (p, n) for f, p, n in rows if p >= least}
    words = {f: p for f, (p, _) in stats.items() if f[-1] != "*"}
    kept: list[str] = []
    for f in sorted((f for f in stats if f[-1] == "*"), key=lambda f: (len(f), f)):
        p, n = stats[f]
        body = f[:-1]
        if p / (p + n) < STEM_PURITY or any(body.startswith(k[:-1]) for k in kept):
            continue
        if max((c for w, c in words.items() if w.startswith(body)), default=0) < 0.7 * p:
            kept.append(f)
    return kept + [f for f in sorted(words) if stats[f][0] / sum(stats[f]) >= MIN_PURITY and not any(f.startswith(k[:-1]) for k in kept)]


def fit(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learn the terms and the score of each class of evidence from a bounded, hash-chosen sample of labelled rows.

    Spark counts the features' documents by label; the driver gets the terms and a few class counts only.
    Conflicting or null labels of a document are left out; with no labels the lexicon is empty.
    """
    spark = documents.sparkSession
    ship(spark)
    y = labels.where(F.col("toxic").isNotNull() & train_rows(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("y2")).where("y = y2 and y in (0, 1)").select("doc_id", F.col("y").cast("int").alias("y"))
    total = y.count()
    if total > rows:
        y = y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * 0.97 * rows / total))
    # about ``rows`` ids at most
    sample = stored(documents.select("doc_id", "text").where("text is not null").join(F.broadcast(y), "doc_id").select("doc_id", "text", "y"), "labelled")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallyforge.llm.toxicity import signatures

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), signatures(b), b.column("y")], ["doc_id", "sig", "y"])

    # near copies count once: the words of one much-copied document aren't terms
    kind = documents.schema["doc_id"].dataType.simpleString()
    apart = sample.mapInArrow(lean(sign), f"doc_id {kind}, sig bigint, y int").groupBy("sig", "y").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "y")
    unlike = sample.drop("y").join(F.broadcast(apart), "doc_id").select("text", "y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallyforge.llm.toxicity import features

        pos: Counter = Counter()
        neg: Counter = Counter()
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                (pos if label else neg).update(features(text))
            if len(pos) + len(neg) > 400_000:
                yield _counted(pos, neg)
        yield _counted(pos, neg)

    schema = "feature string, pos bigint, neg bigint"
    sums = unlike.mapInArrow(lean(count), schema).groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    first = sums.where(f"pos >= {MIN_DOCS} and pos >= 4 * neg").collect()
    positives = unlike.agg(F.sum("y")).first()[0] or 0
    terms = chosen_terms([(r.feature, r.pos, r.neg) for r in first], positives)

    fuzzy_terms = spark.sparkContext.broadcast(terms)

    def judge_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallyforge.llm.toxicity import Lexicon

        lex = Lexicon(fuzzy_terms.value)
        pos: Counter = Counter()
        neg: Counter = Counter()
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                (pos if label else neg).update({t for _, _, t, d in lex.hits(text.lower()) if d})
        yield _counted(pos, neg)

    by_term = unlike.mapInArrow(lean(judge_terms), schema).groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("feature <> ''").collect()
    exact_only = frozenset(r.feature for r in by_term if r.neg >= 2 and r.pos < 4 * r.neg)

    shared = spark.sparkContext.broadcast((terms, exact_only))

    @F.arrow_udf("string")
    def klass(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tallyforge.llm.toxicity import Lexicon, evidence

        lex = Lexicon(*shared.value)
        for texts in batches:
            yield pa.array([evidence(lex, t.lower()) for t in texts.to_pylist()], pa.string())

    counts = {r.k: (r.p, r.n - r.p) for r in sample.select(klass("text").alias("k"), "y").groupBy("k").agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()}
    return Model(terms, counts, exact_only)


def signatures(batch: pa.RecordBatch) -> pa.Array:
    """The smallest hash of a text's 3-word shingles, which most near copies share."""
    out = []
    for _, _, data, bounds in text_chunks(batch):
        g, at = shingle_hashes(data, bounds, 3)
        out += [int(g[a]) - (1 << 63) if b > a else 0 for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.array(out, pa.int64())


def _counted(pos: Counter, neg: Counter) -> pa.RecordBatch:
    keys = list(pos.keys() | neg.keys())
    out = pa.RecordBatch.from_pydict({"feature": pa.array(keys, pa.string()), "pos": pa.array([pos[k] for k in keys], pa.int64()), "neg": pa.array([neg[k] for k in keys], pa.int64())})
    pos.clear()
    neg.clear()
    return out


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every text.

    Words within one edit of a term or stem of the lexicon are hits; hits in a quotation weigh less. Empty and null
    texts have the score of a text without hits. A null doc_id is not held out. Very long texts are read whole.
    Other columns are ignored; equal rows give equal rows; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model.terms, model.exact_only, model.score))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tallyforge.llm.common import release
        from tallyforge.llm.toxicity import Scorer

        scorer = Scorer(*shared.value)
        for texts in batches:
            yield pa.array(scorer(texts.to_pylist()), pa.float64())
        release()

    held = F.coalesce(~train_rows(F.col("doc_id")), F.lit(False))
    out = documents.select("doc_id", held.alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


class Scorer:
    """Scores of texts. Words known to be no hits are remembered over the batches of a task, so most cost a set operation."""

    def __init__(self, terms: list[str], exact_only: frozenset[str], by_class: dict[str, float]):
        self.lexicon = Lexicon(terms, exact_only)
        self.clean: set[str] = set()
        self.hit: set[str] = set()
        levels = [by_class[k] for k in CLASSES] + [1.0]
        #: A class's score, and what more hits than it needs add at most.
        self.levels = {k: (levels[i], max(0.0, levels[i + 1] - levels[i])) for i, k in enumerate(CLASSES)}

    def __call__(self, texts: list[str | None]) -> list[float]:
        out: list[float] = []
        for i in range(0, len(texts), 256):
            low = [(t or "").lower() for t in texts[i : i + 256]]
            words = [set(WORD.findall(t)) for t in low]
            fresh = set().union(*words)
            fresh -= self.clean
            fresh -= self.hit
            found = {w for w in fresh if self.lexicon.find(w)}
            self.hit |= found
            self.clean |= fresh - found
            out += [self.levels["none"][0] if self.hit.isdisjoint(w) else self.score(t) for t, w in zip(low, words, strict=True)]
            if len(self.clean) > CLEAN_WORDS:
                self.clean.clear()
        return out

    def score(self, text: str) -> float:
        kind, more = weigh(self.lexicon, text)
        base, room = self.levels[kind]
        return base + room * (1 - 2.0**-more)
