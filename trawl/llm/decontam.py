"""Benchmark decontamination by a generalised suffix automaton.

The normalised words of all test items make one automaton (a state stands for
the item passages that end at the same places).  A document's words are
streamed through it; the longest passage matched up to each word is tracked,
and where it reaches the window length, or the whole of a shorter item, the
words it covers are hit.

Words: A-Z lower-cased, runs of ASCII letters, digits and non-ASCII characters.
Long texts are streamed in parts; the state goes on from part to part.  Items
go to the tasks in blocks of at most BLOCK words; with several blocks the rows
are written between the passes.  An item longer than a block is cut into pieces
that overlap by a window less one word, which holds the same windows.

Null or empty text: no words, not contaminated.  Items without words have no
windows.  Rows of one item_id are one item with several texts; a null item_id
is the empty string.  Null or repeated doc_ids: each row by itself.  Extra
columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import arrow_map, word_parts
from trawl.session import materialize

WINDOW = 10
BLOCK = 100_000  # words
COVERAGE = 0.5   # a document with a larger share of hit words is dropped by ``clean``
_PLACES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class Automaton:
    """Generalised suffix automaton over words; ``hits`` holds, for each state, the
    windows that end there: (length, items)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._add(last, w)
        own: dict[int, dict[int, set[str]]] = {}
        for name, words in items:
            size = min(window, len(words))
            for i, (s, long) in enumerate(self.walk(words)):
                if i + 1 >= size:
                    while self.length[self.link[s]] >= size:
                        s = self.link[s]
                    own.setdefault(s, {}).setdefault(size, set()).add(name)
        self.hits: list[tuple] = [()] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.hits[s] = self.hits[self.link[s]] + tuple(sorted(own.get(s, {}).items()))

    def _state(self, length: int, link: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """The state of the passage that p and w make, apart from the longer ones of q."""
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = part
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = part
            p = self.link[p]
        return part

    def _add(self, last: int, w: bytes) -> int:
        if w in self.next[last]:
            return self._split(last, w, self.next[last][w])
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.next[p][w])
        return new

    def walk(self, words: list[bytes], s: int = 0, long: int = 0) -> Iterator[tuple[int, int]]:
        """(state, longest matching length) after each word."""
        step, link, length = self.next, self.link, self.length
        for w in words:
            t = step[s].get(w)
            while t is None and s:
                s = link[s]
                long = length[s]
                t = step[s].get(w)
            if t is None:
                long = 0
            else:
                s, long = t, long + 1
            yield s, long

    def scan(self, raw: bytes, spans: list[tuple[int, int]], items: set[str]) -> tuple[int, list[tuple[int, int]]]:
        """Number of words, and ``spans`` merged with the hit spans of words; names of
        the items found go to ``items``."""
        step, link, length, hits = self.next, self.link, self.length, self.hits
        found, s, long, n = [], 0, 0, 0
        for words in word_parts(raw):
            for i, w in enumerate(words, n + 1):
                t = step[s].get(w)
                while t is None and s:
                    s = link[s]
                    long = length[s]
                    t = step[s].get(w)
                if t is None:
                    continue
                s, long = t, long + 1
                for size, names in hits[s]:
                    if size <= long:
                        found.append((i - size, i))
                        items |= names
            n += len(words)
        return n, merged(spans + found) if found else spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(bench: DataFrame, id_col: str, text_col: str, window: int, size: int) -> Iterator[list]:
    """The items' words, in blocks of ``size`` words; the driver holds one at a time."""
    block, room = [], size
    for r in bench.select(F.col(id_col).cast("string"), F.col(text_col).cast("binary")).toLocalIterator():
        words = [w for part in word_parts(bytes(r[1] or b"")) for w in part]
        for at in range(0, max(1, len(words) - window + 1), size - window + 1) if words else ():
            piece = words[at:at + size]
            if len(piece) > room and block:
                yield block
                block, room = [], size
            block.append((r[0] or "", piece))
            room -= len(piece)
    if block:
        yield block


_BUILT: dict[str, Automaton] = {}


def _built(key: str, shared, window: int) -> Automaton:
    """One automaton per Python worker and block."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(shared.value, window)
    return _BUILT[key]


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the spans, each from its first word's start to its last one's end."""
    out, at, k, start = [], 0, 0, 0
    for i, m in enumerate(_PLACES.finditer(raw)):
        if k == len(spans):
            break
        if i == spans[k][0]:
            start = m.start()
        if i + 1 == spans[k][1]:
            out.append(raw[at:start])
            at, k = m.end(), k + 1
    return b"".join(out) + raw[at:]


ROW = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())),
                 ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
_DDL = "doc_id long, text {}, n_words long, starts array<long>, ends array<long>, items array<string>"


def scan(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block: int = BLOCK, id_col: str = "item_id",
         text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, starts, ends, items) of every document: hit spans of words,
    disjoint and in order, and the sorted names of the items whose windows occur.
    ``with_text`` adds ``text`` without the hit spans."""
    if block < 2 * window:
        raise ValueError("a block holds two windows at least")
    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS BINARY) AS text", "0L AS n_words",
                           "CAST(array() AS array<bigint>) AS starts", "CAST(array() AS array<bigint>) AS ends",
                           "CAST(array() AS array<string>) AS items")
    context = docs.sparkSession.sparkContext

    def one_pass(rows: DataFrame, part: list, last: bool) -> DataFrame:
        shared, key = context.broadcast(part), uuid.uuid4().hex

        def fn(b):
            machine, out = _built(key, shared, window), {c: [] for c in b}
            for i, raw in enumerate(b["text"]):
                items = set(b["items"][i])
                n, spans = machine.scan(raw or b"", list(zip(b["starts"][i], b["ends"][i])), items)
                text = None if raw is None or last and not with_text else cut(raw, spans) if last and spans else raw
                for c, v in (("doc_id", b["doc_id"][i]), ("text", text), ("n_words", n), ("starts", [a for a, _ in spans]),
                             ("ends", [z for _, z in spans]), ("items", sorted(items))):
                    out[c].append(v)
            return out

        return arrow_map(rows, fn, _DDL.format("binary"), ROW, 64)

    parts = blocks(bench, id_col, text_col, window, block)
    now = next(parts, [])
    for following in parts:
        rows = materialize(one_pass(rows, now, False), "scanned")
        now = following
    out = one_pass(rows, now, True)
    text = [F.col("text").cast("string").alias("text")] if with_text else []
    return out.select("doc_id", "n_words", "starts", "ends", "items", *text)


HIT = "aggregate(zip_with(ends, starts, (z, a) -> z - a), 0L, (s, x) -> s + x)"


def clean(docs: DataFrame, bench: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, text, n_removed): texts without benchmark passages; documents of
    which more than ``coverage`` is hit go."""
    return scan(docs, bench, window, with_text=True).withColumn("n_removed", F.expr(HIT)) \
        .where(F.col("n_removed") <= coverage * F.col("n_words")).select("doc_id", "text", "n_removed")


def report(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    return scan(docs, bench).selectExpr(
        "doc_id", "n_words", f"{HIT} AS n_hit", "CAST(size(items) AS BIGINT) AS n_items",
        "sha2(array_join(items, ','), 256) AS items_sha256", "size(items) > 0 AS contaminated")
