"""Ranked lexical search by the Best Position Algorithm.

The items are the stated queries; they go to the tasks in blocks.  A first pass
over the whole texts keeps each document's length and its counts of the block's
terms; Spark sums N, L and the document frequencies.  In the second pass every
task holds impact lists of its documents, CHUNK postings at a time: a list has
a term's documents by falling impact.

For an item, the lists are read downwards together.  Each new document is
looked up in all lists of the item (direct access), which gives its score and
the places that it takes in them.  A list's best position ends its unbroken run
of places seen, by reading or by look-up; a document not yet seen stands behind
it in every list, so it scores at most the sum of the impacts there.  Reading
stops when that sum is strictly below the k-th best score (equal scores could
still win by a smaller id) or when no impact is left.  A task carries its best
scores from one chunk to the next and returns k rows an item at most; a window
ranks these.

Terms: A-Z lower-cased, runs of ASCII letters, digits and non-ASCII characters.
Documents without terms (null or empty text) count nowhere; items without terms
get no rows.  Rows of one item_id are one item with the terms of all; a null
item_id is one item too.  Repeated doc_ids are documents of their own; null
doc_ids rank behind others of the same score.  Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import arrow_map, word_parts
from trawl.session import materialize

TOP = 10
CHUNK = 1 << 21      # postings
BLOCK = 4 << 20      # bytes of item texts
FIRST = 32           # places of each list read in the first step; then twice as many


def term_counts(raw: bytes | None) -> Counter:
    out: Counter = Counter()
    for words in word_parts(bytes(raw or b"")):
        out.update(words)
    return out


def blocks(items: DataFrame, size: int) -> Iterator[list[tuple[int | None, Counter]]]:
    """(item_id, term counts) in blocks; the driver holds one at a time."""
    rows = items.selectExpr("CAST(item_id AS BIGINT) AS item_id", "CAST(text AS BINARY) AS text").where("text IS NOT NULL")
    block: dict[int | None, Counter] = {}
    room = size
    for r in rows.orderBy("item_id").toLocalIterator():
        if r[0] not in block and room <= 0:
            yield list(block.items())
            block, room = {}, size
        block.setdefault(r[0], Counter()).update(term_counts(r[1]))
        room -= len(r[1])
    if block:
        yield list(block.items())


def counted(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents with terms, written once: length, and
    the numbered terms with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def fn(b):
        known, out = shared.value, {"doc_id": [], "n": [], "terms": [], "tfs": []}
        for i, raw in zip(b["doc_id"], b["text"]):
            c = term_counts(raw)
            if c:
                hit = [(known[w], k) for w, k in c.items() if w in known]
                out["doc_id"].append(i)
                out["n"].append(c.total())
                out["terms"].append([t for t, _ in hit])
                out["tfs"].append([k for _, k in hit])
        return out

    return materialize(arrow_map(
        docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS BINARY) AS text"), fn,
        "doc_id long, n long, terms array<int>, tfs array<long>",
        pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())),
                   ("tfs", pa.list_(pa.int64()))]), 64), "term_counts")


class Best:
    """The best k (score, document) of an item so far."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        ok = scores >= max(1, self.least)
        s, i, z = (np.concatenate(x) for x in ((self.scores, scores[ok]), (self.ids, ids[ok]), (self.null, null[ok])))
        order = np.lexsort((i, z, -s))[:self.k]
        self.scores, self.ids, self.null = s[order], i[order], z[order]


class Lists:
    """Impact lists of some documents."""

    def __init__(self, ids, null, n, sizes, terms, tfs, weights, total, length):
        m = 25 + 75 * n * total // length
        doc = np.repeat(np.arange(len(n), dtype=np.int64), sizes)
        impact = weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[doc]))
        use = impact > 0
        doc, terms, impact = doc[use], terms[use], impact[use]
        self.ids, self.null = ids, null
        by_doc = np.argsort(terms, kind="stable")     # documents ascend in each term
        self.by_doc = doc[by_doc]
        self.starts = np.searchsorted(terms[by_doc], np.arange(len(weights) + 1))
        by_impact = np.lexsort((doc, -impact, terms))
        self.doc, self.impact = doc[by_impact], impact[by_impact]
        place = np.empty(len(doc), np.int64)
        place[by_impact] = np.arange(len(doc))
        self.place = place[by_doc]                    # where that document stands by impact

    def search(self, terms: list[int], times: list[int], best: Best) -> int:
        """Brings the documents that belong there into ``best``; how many places of the
        lists were read."""
        lists = [(int(self.starts[t]), int(self.starts[t + 1]), c) for t, c in zip(terms, times)]
        lists = [x for x in lists if x[0] < x[1]]
        seen = [np.zeros(b - a + 1, bool) for a, b, _ in lists]  # the last place stays unseen: the list's end
        front = [0] * len(lists)
        known = np.zeros(len(self.ids), bool)
        at, step, read = 0, FIRST, 0
        while lists:
            cand = np.concatenate([self.doc[a + at:min(b, a + at + step)] for a, b, _ in lists])
            read += len(cand)
            cand = np.unique(cand[~known[cand]])
            known[cand] = True
            score, bound = np.zeros(len(cand), np.int64), 0
            for j, (a, b, c) in enumerate(lists):
                if len(cand):  # direct access
                    there = np.minimum(np.searchsorted(self.by_doc[a:b], cand), b - a - 1) + a
                    hit = self.by_doc[there] == cand
                    where = self.place[there[hit]]
                    score[hit] += c * self.impact[where]
                    seen[j][where - a] = True
                front[j] += int(np.argmin(seen[j][front[j]:]))
                if a + front[j] < b:
                    bound += c * int(self.impact[a + front[j]])
            best.add(score, self.ids[cand], self.null[cand])
            if bound == 0 or bound < best.least:
                break
            at, step = at + step, 2 * step
        return read


def block_search(docs: DataFrame, items: list[tuple[int | None, Counter]], k: int) -> DataFrame:
    """(item_id, doc_id, score): k rows at most of each task and item."""
    numbers = {w: i for i, w in enumerate(sorted({w for _, c in items for w in c}))}
    counts = counted(docs, numbers)
    total, length = (x or 0 for x in counts.agg(F.count(F.lit(1)), F.sum("n")).first())
    weights = np.zeros(len(numbers), np.int64)
    for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        weights[r[0]] = math.floor(1000 * math.log((2 * total + 2) / (2 * r[1] + 1)))
    shared = docs.sparkSession.sparkContext.broadcast(
        (weights, [(i, [numbers[w] for w in c], list(c.values())) for i, c in items]))
    arrow = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, queries = shared.value
        best, held, size = [Best(k) for _ in queries], [], 0

        def search(held):
            t = pa.Table.from_batches(held).combine_chunks()
            if not t.num_rows:
                return
            flat = {c: t.column(c).combine_chunks() for c in t.column_names}
            lists = Lists(flat["doc_id"].fill_null(0).to_numpy(zero_copy_only=False), flat["doc_id"].is_null().to_numpy(zero_copy_only=False),
                          flat["n"].to_numpy(), np.diff(flat["terms"].offsets.to_numpy()), flat["terms"].flatten().to_numpy(),
                          flat["tfs"].flatten().to_numpy(), weights, total, length)
            for b, (_, terms, times) in zip(best, queries):
                lists.search(terms, times, b)

        for batch in batches:
            held.append(batch)
            size += len(batch.column("terms").flatten()) + batch.num_rows
            if size >= CHUNK:
                search(held)
                held, size = [], 0
        if held:
            search(held)
        for b, (i, _, _) in zip(best, queries):
            if len(b.scores):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(b.scores), pa.int64()), pa.array(b.ids, pa.int64(), mask=b.null),
                                                  pa.array(b.scores, pa.int64())], schema=arrow)

    return counts.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents."""
    out = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for i, part in enumerate(blocks(items, block)):
        found = block_search(docs, part, k)
        out = out.union(found) if i else found
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
