"""SentencePiece BPE: encoding by a table of each prefix's last token, and decoding."""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyforge.llm.common import lean, ship

SPACE = "▁"
UNKNOWN_SURFACE = " ⁇ "
#: Words whose ids a task remembers.
CACHE = 250_000
#: Documents that are encoded before their results are passed on.
ROWS = 256


class PieceTable:
    """The merge-type prefix table of a BPE piece model with scores (identity normaliser, byte fallback).

    For every prefix of a word there is just one token that can end its encoding: of the pieces that end
    there (the matches of an Aho-Corasick automaton, longest first), the one that is compatible with the last
    token of the prefix before it. Two neighbouring tokens are compatible if the merges that make them up,
    undone step by step, never allow a merge across their border that would have come earlier. The ids are
    then recovered backwards from the end of the word.
    """

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=model_file)
        n = p.get_piece_size()
        self.unk = p.unk_id()
        self.pieces = [p.id_to_piece(i) for i in range(n)]
        self.is_byte = [p.is_byte(i) for i in range(n)]
        self.control = [p.is_control(i) or p.is_unused(i) for i in range(n)]
        normal = [i for i in range(n) if not (self.is_byte[i] or self.control[i] or i == self.unk)]
        self.id = {self.pieces[i]: i for i in normal}
        score = {i: p.get_score(i) for i in normal}
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if self.is_byte[i]}
        # Each piece of two or more characters is made by the merge with the best last step whose parts exist.
        self.rank = {i: -score[i] for i in normal}
        self.parts: dict[int, tuple[int, int]] = {}
        self.reachable: set[int] = {i for i in normal if len(self.pieces[i]) == 1}
        inner = [self.pieces[i] for i in normal if SPACE in self.pieces[i].lstrip(SPACE)]
        if inner:
            raise ValueError(f"pieces hold a space after other characters: {inner[:3]}")
        self.spaces_only = sorted((len(self.pieces[i]) for i in normal if not self.pieces[i].strip(SPACE)), reverse=True)
        for i in sorted(normal, key=lambda i: (len(self.pieces[i]))):
            if len(self.pieces[i]) > 1:
                tokens = self.merged(self.pieces[i])
                if len(tokens) == 1:
                    self.reachable.add(i)
        self.pair: dict[tuple[int, int], bool] = {}
        self.size = [len(x) for x in self.pieces]
        self.automaton = ahocorasick.Automaton()
        for i in self.reachable:
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), i))
        self.automaton.make_automaton()
        self.known = {self.pieces[i] for i in normal if len(self.pieces[i]) == 1}

    def merged(self, s: str) -> list[int]:
        """The ids of one piece's text by merging pair after pair, best first and leftmost first; records its last merge."""
        toks = [self.id.get(c, -1) for c in s]
        text = list(s)
        while len(text) > 1:
            best = None
            for k in range(len(text) - 1):
                t = self.id.get(text[k] + text[k + 1])
                if t is not None and (best is None or self.rank[t] < best[0]):
                    best = (self.rank[t], k, t)
            if best is None:
                break
            _, k, t = best
            if t not in self.parts:
                self.parts[t] = (toks[k], toks[k + 1])
            text[k : k + 2] = [text[k] + text[k + 1]]
            toks[k : k + 2] = [t]
        return toks

    def _compatible(self, a: int, b: int) -> bool:
        """Whether token a followed by token b stays as it is."""
        limit = float("inf")
        rank, parts, pieces, ids = self.rank, self.parts, self.pieces, self.id
        last = None  # side that was undone last: a tie of ranks goes to the pair further left
        while True:
            t = ids.get(pieces[a] + pieces[b])
            if t is not None:
                r = rank[t]
                if r < limit or (r == limit and last == "right"):
                    return False
            ra = rank[a] if a in parts else -1.0
            rb = rank[b] if b in parts else -1.0
            if ra < 0 and rb < 0:
                return True
            if a in parts and (b not in parts or ra > rb):
                limit, a, last = ra, parts[a][1], "left"
            elif b in parts and (a not in parts or rb > ra):
                limit, b, last = rb, parts[b][0], "right"
            else:  # equal ranks: the left one was made first, so the right one is undone first
                limit, b, last = rb, parts[b][0], "right"

    def run(self, s: str) -> list[int]:
        """The ids of a run of characters that are all pieces, without a space after its first word part."""
        n = len(s)
        last = [-1] * (n + 1)
        decided, compatible = -1, self.pair
        for e, (size, t) in self.automaton.iter(s):  # for each end, longest first
            if e == decided:
                continue
            at = e + 1 - size
            if at:
                before = last[at]
                if before < 0:
                    continue
                ok = compatible.get((before, t))
                if ok is None:
                    ok = self.compatible(before, t)
                if not ok:
                    continue
            last[e + 1] = t
            decided = e
        if last[n] < 0:
            return self.merged(s)  # never met with a proper model; the plain way is right for any
        out = []
        size = self.size
        while n:
            t = last[n]
            out.append(t)
            n -= size[t]
        out.reverse()
        return out

    def compatible(self, a: int, b: int) -> bool:
        if len(self.pair) > 1 << 21:
            self.pair.clear()
        ok = self.pair[a, b] = self._compatible(a, b)
        return ok

    @functools.cached_property
    def word(self):
        def ids(w: str) -> tuple[int, ...]:
            if self.known.issuperset(w):
                return tuple(self.run(w))
            out: list[int] = []
            run = ""
            for c in w:
                if c in self.known:
                    run += c
                    continue
                if run:
                    out += self.run(run)
                    run = ""
                out += [self.byte_id.get(x, self.unk) for x in c.encode("utf-8", "surrogatepass")] if self.byte_id else [self.unk]
            if run:
                out += self.run(run)
            return tuple(out)

        return ids

    def words(self, text: str) -> Iterator[str]:
        """Words with the spaces before them; no piece and so no merge crosses from a word to the space after it."""
        parts = (" " + text.replace(SPACE, " ")).split(" ")
        spaces = 0
        for part in parts[1:]:
            spaces += 1
            if part:
                yield SPACE * spaces + part
                spaces = 0
        if spaces:
            yield SPACE * spaces

    def encode(self, text: str | None) -> list[int]:
        """Ids without begin or end; null and empty texts have none."""
        if not text:
            return []
        word, out = self.word, []
        for w in self.words(text):
            out += word(w)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, runs of byte pieces as UTF-8 (a bad byte becomes U+FFFD), the first space dropped."""
        out: list[str] = []
        raw = bytearray()
        first = True
        for t in ids:
            if self.is_byte[t]:
                raw.append(int(self.pieces[t][3:5], 16))
                first = False
                continue
            if raw:
                out.append(utf8(bytes(raw)))
                raw.clear()
            if self.control[t]:
                continue
            piece = UNKNOWN_SURFACE if t == self.unk else self.pieces[t]
            if first and piece.startswith(SPACE):
                piece = piece[1:]
            first = False
            out.append(piece)
        if raw:
            out.append(utf8(bytes(raw)))
        return "".join(out).replace(SPACE, " ")


def utf8(raw: bytes) -> str:
    """Bytes as text; each byte that starts no whole character becomes one U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        try:
            out.append(raw[i:].decode("utf-8"))
            break
        except UnicodeDecodeError as bad:
            out.append(raw[i : i + bad.start].decode("utf-8") + "�")
            i += bad.start + 1
    return "".join(out)


@functools.lru_cache(2)
def table(model_file: str) -> PieceTable:
    return PieceTable(model_file)


def encoded(documents: DataFrame, model_name: str = "piece_bpe_32k.model", ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, and with ``ids`` the ids and the decoded text.

    ``model_name`` is a file of the installed tokenizers, opened by each task. A null or empty text has no
    tokens; very long texts are encoded word by word; equal rows give equal rows; an empty table gives an empty one.
    """
    ship(documents.sparkSession)
    more = ", ids array<int>, decoded string" if ids else ""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        from tallyforge.llm.sentencepiece_bpe import table

        t = table(public_tokenizers.path(model_name))
        word, words = t.word, t.words
        tail = {}  # a word's ids as text, its decoded text, and its ids as bytes

        def facts(w):
            if len(tail) > CACHE:
                tail.clear()
            x = word(w)
            got = tail[w] = (len(x), ",".join(map(str, x)), t.decode(x) if w[0] != SPACE else " " + t.decode(x), array("i", x).tobytes() if ids else b"")
            return got

        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):  # so little is held at a time
                b = whole.slice(lo, ROWS)
                n_out, id_out, text_out, raw, plain_out = [], [], [], [], []
                for text in b.column("text").to_pylist():
                    parts = [tail.get(w) or facts(w) for w in words(text)] if text else []
                    n_out.append(sum([p[0] for p in parts]))
                    id_out.append(hashlib.sha256(",".join([p[1] for p in parts]).encode()).hexdigest())
                    plain = "".join([p[2] for p in parts])[1:]
                    text_out.append(hashlib.sha256(plain.encode()).hexdigest())
                    if ids:
                        raw.append(b"".join([p[3] for p in parts]))
                        plain_out.append(plain)
                cols = {"doc_id": b.column("doc_id"), "n_tokens": pa.array(n_out, pa.int64()), "ids_sha256": pa.array(id_out, pa.string()), "decoded_sha256": pa.array(text_out, pa.string())}
                if ids:
                    ends = np.concatenate(([0], np.cumsum(n_out))).astype(np.int32)
                    cols |= {"ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), np.int32))), "decoded": pa.array(plain_out, pa.string())}
                yield pa.RecordBatch.from_pydict(cols)

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(lean(work), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
