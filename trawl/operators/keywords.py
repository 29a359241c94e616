"""Keyword extraction per document: TF-IDF and TextRank.

Plan shape: documents are hash-partitioned by ``doc_id`` once
(``by_document``); token offsets (window), per-document counts (aggregate),
co-occurrence edges (window + aggregate), the TextRank groups and the top-N
windows all require a distribution on ``doc_id`` that is then already
satisfied, so none of them adds an exchange.  Stop words are broadcast
(bounded by k); the IDF table is broadcast only when its counted size fits.
"""

from __future__ import annotations

from functools import reduce
from operator import add, itemgetter, mul

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.operators.index import corpus_size, doc_frequency, postings_tf, rank_key
from trawl.operators.lattice import ragged
from trawl.functions import text as TX
from trawl.operators.tokenize import by_document
from trawl.session import bounded_broadcast, materialize, spread

# Fixed values of the TextRank variant that must match the reference.
DAMPING = 0.85
RANK_ROUNDS = 10
SPAN = 5
IDF_ROW_BYTES = 64
STOP_ROW_BYTES = 64


# ------------------------------------------------------------------ inputs

def build_idf(docs: DataFrame, n_docs: int | None = None) -> DataFrame:
    """(word, idf) from a corpus: idf = ln(N div df) over the index words; ``n_docs``
    as in ``index.build_postings``."""
    df = doc_frequency(postings_tf(docs))
    return (df.withColumn("n_docs", corpus_size(docs) if n_docs is None else F.lit(n_docs).cast("long"))
            .select("word", F.ln(F.expr("n_docs div df").cast("double")).alias("idf")))


def idf_average(idf: DataFrame, n_lines=None):
    """Average IDF as a scalar Column: sum / number of lines.

    The sum is accumulated exactly (DECIMAL), so the average does not depend
    on the order in which partial sums arrive.  ``n_lines`` may count
    malformed lines too (the loader's rule; an int or the one-row DataFrame
    ``load_idf`` returns); by default the row count.
    """
    total = idf.select(F.sum(F.col("idf").cast("decimal(38,18)")).cast("double").alias("s")).scalar()
    if n_lines is None:
        denom = idf.select(F.count(F.lit(1)).cast("double")).scalar()
    elif isinstance(n_lines, DataFrame):
        denom = n_lines.select(F.col(n_lines.columns[0]).cast("double")).scalar()
    else:
        denom = F.lit(float(n_lines))
    return total / denom


def stop_words_by_frequency(docs: DataFrame, k: int = 50, text_col: str = "text") -> DataFrame:
    """(word): the k most frequent tokens longer than one character.

    Only letter and number runs can be longer than one character, so the
    cheaper run regex suffices.  A top-k report: partial counts per task, one
    exchange on ``word``, then ``TakeOrderedAndProject`` -- the limit is the
    feature here.
    """
    toks = spread(docs.select(text_col)).select(F.explode(TX.runs(text_col)).alias("word"))
    return (toks.where(F.char_length("word") > 1).groupBy("word").count()
            .orderBy(F.desc("count"), F.col("word")).limit(k).select("word"))


# ------------------------------------------------------------------ candidates

def run_offsets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, pos, word, offset) for letter/number runs with byte offsets.

    Run i is preceded by gap i (``split`` on the run regex); its byte offset
    is the running byte length of all earlier gaps and runs plus its own gap.
    The running sum is a window partitioned by document (no exchange after
    ``by_document``).
    """
    per_doc = docs.select(F.col(id_col).alias("doc_id"),
                          F.arrays_zip(TX.run_gaps(text_col).alias("gap"),
                                       TX.runs(text_col).alias("word")).alias("z"))
    rows = (per_doc.select("doc_id", F.posexplode_outer("z").alias("pos", "g"))
            .where(F.col("g.word").isNotNull())
            .select("doc_id", "pos", F.col("g.word").alias("word"),
                    (F.octet_length("g.gap") + F.octet_length("g.word")).alias("span"),
                    F.octet_length("g.word").alias("blen")))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("doc_id", "pos", "word",
                       (F.sum("span").over(w) - F.col("blen")).cast("long").alias("offset"))


def keyword_tokens(docs: DataFrame, stop: DataFrame, n_stop: int | None = None,
                   text_col: str = "text", id_col: str = "doc_id",
                   partitioned: bool = False) -> DataFrame:
    """Tokens that may be keywords: (doc_id, pos, word, offset).

    A token is dropped when it is a single code point or a stop word (exact,
    case-sensitive).  Offsets are byte offsets in the text.  Only runs can be
    longer than one character, so the candidates come from the run regex.
    """
    src = docs if partitioned else by_document(docs.select(id_col, text_col), id_col, text_col=text_col)
    return without_stop(run_offsets(src, text_col, id_col), stop, n_stop)


def without_stop(toks: DataFrame, stop: DataFrame, n_stop: int | None = None) -> DataFrame:
    """Tokens of two code points or more that are no stop words."""
    if n_stop is None:
        stop = materialize(stop.select("word"), "stop_words")
        n_stop = stop.count()
    stop_b = bounded_broadcast(stop.select("word").distinct(), n_stop, STOP_ROW_BYTES)
    return (toks.where(F.char_length("word") > 1)
            .join(stop_b, "word", "left_anti")
            .select("doc_id", "pos", "word", "offset"))


def term_counts(kept: DataFrame) -> DataFrame:
    """(doc_id, word, tf, offsets) -- count and sorted byte offsets per word."""
    return kept.groupBy("doc_id", "word").agg(
        F.count(F.lit(1)).alias("tf"),
        F.array_sort(F.collect_list("offset")).alias("offsets"))


def top_n(scored: DataFrame, n: int) -> DataFrame:
    """Keep the n best words per document (weight desc, then word); weights are compared
    rounded, as in ``index.rank_key``."""
    w = Window.partitionBy("doc_id").orderBy(rank_key().desc(), F.col("word"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# ------------------------------------------------------------------ TF-IDF

def extract_keywords(docs: DataFrame, idf: DataFrame, stop: DataFrame, n: int = 5,
                     text_col: str = "text", id_col: str = "doc_id",
                     idf_avg=None, tokens: DataFrame | None = None) -> DataFrame:
    """(doc_id, rank, word, offsets, weight): weight = count x idf, with the
    average idf for words missing from the table.  ``tokens`` (doc_id, pos, word,
    offset) from a lexicon cut take the place of the run tokens."""
    # the IDF table is read four times (size check, broadcast, sum and count
    # of the average): written once, the corpus behind it is scanned once
    idf = materialize(idf.select("word", "idf"), "idf")
    kept = keyword_tokens(docs, stop, None, text_col, id_col) if tokens is None else without_stop(tokens, stop)
    counts = term_counts(kept)
    n_idf = idf.count()
    idf_b = bounded_broadcast(idf.select("word", "idf"), n_idf, IDF_ROW_BYTES)
    avg = idf_avg if idf_avg is not None else idf_average(idf)
    scored = (counts.join(idf_b, "word", "left")
              .withColumn("avg_idf", avg)
              .withColumn("weight", F.col("tf") * F.coalesce(F.col("idf"), F.col("avg_idf"))))
    return top_n(scored, n).select("doc_id", "rank", "word", "offsets", "weight")


# ------------------------------------------------------------------ TextRank

def cooccurrence_edges(kept: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, src, dst, weight) undirected co-occurrence weights.

    Each kept token pairs with the next ``span - 1`` kept tokens (skipped
    tokens do not use up the window); every pair adds 1 in both directions,
    so a word paired with itself gets 2 on its self-edge.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    partners = F.array(*[F.lead("word", d).over(w) for d in range(1, span)])
    pairs = (kept.select("doc_id", F.col("word").alias("a"), partners.alias("ps"))
             .select("doc_id", "a", F.explode("ps").alias("b"))
             .where(F.col("b").isNotNull()))
    both = pairs.select("doc_id", F.explode(F.array(
        F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
        F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"))
    return (both.groupBy("doc_id", "e.src", "e.dst")
            .agg(F.count(F.lit(1)).cast("double").alias("weight")))


_RANK_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("word", T.StringType()),
    T.StructField("offsets", T.ArrayType(T.LongType())),
    T.StructField("weight", T.DoubleType()),
])


def _rank_indexed(n_nodes: int, lo, hi, cnt, rounds: int, d: float) -> list:
    """In-place rounds on an integer-indexed graph.

    Node ids are positions in byte order of the words (code-point order of a
    Python ``str`` is UTF-8 byte order).  ``lo``/``hi``/``cnt`` are the
    undirected pair counts: w(lo, hi) = w(hi, lo) = cnt, w(a, a) = 2 cnt.
    Returns the raw scores (None for nodes without edges).
    """
    lo, hi, cnt = np.asarray(lo, np.int64), np.asarray(hi, np.int64), np.asarray(cnt, np.float64)
    if not len(lo):
        return [None] * n_nodes
    other = lo != hi
    src, dst = np.concatenate([lo, hi[other]]), np.concatenate([hi, lo[other]])
    weight = np.concatenate([np.where(other, cnt, 2.0 * cnt), cnt[other]])
    order = np.lexsort((dst, src))
    src, dst, weight = src[order], dst[order], weight[order]
    out_sum = np.bincount(src, weight, n_nodes)  # sums of counts: exact in any order
    coefs, dst = (weight / out_sum[dst]).tolist(), dst.tolist()
    live, first = np.unique(src, return_index=True)
    live, ends = live.tolist(), [*first.tolist(), len(src)]
    ws = [None] * n_nodes
    start = 1.0 / len(live)
    for i in live:
        ws[i] = start
    # a second place, so that ``itemgetter`` of one neighbour gives a tuple; its coefficient is not there
    steps = [(i, coefs[x:y], itemgetter(*dst[x:y], i)) for i, x, y in zip(live, ends, ends[1:])]
    base = 1 - d
    for _ in range(rounds):
        for i, c, scores_of in steps:
            ws[i] = base + d * reduce(add, map(mul, c, scores_of(ws)), 0.0)  # neighbour by neighbour
    return ws


def _normalise(raw: list) -> list:
    scores = [0.0 if v is None else v for v in raw]
    lo = min(scores)
    hi = max(scores)
    return [(v - lo / 10.0) / (hi - lo / 10.0) for v in scores]


def rank_graph(nodes, edges, rounds: int = RANK_ROUNDS, d: float = DAMPING) -> dict:
    """In-place TextRank on one document's graph.

    ``edges`` maps (src, dst) -> weight with both directions present.  Nodes
    update one after another in byte order of the word, each round reusing
    the scores already updated in that round; then scores are scaled by
    (s - min/10) / (max - min/10).  Words without edges score 0.
    """
    words = sorted(set(nodes) | {a for a, _ in edges} | {b for _, b in edges})
    if not edges:
        return {w: 0.0 for w in nodes}
    ix = {w: i for i, w in enumerate(words)}
    lo, hi, cnt = [], [], []
    for (a, b), wgt in edges.items():
        if a == b:
            lo.append(ix[a]); hi.append(ix[a]); cnt.append(wgt / 2.0)
        elif a < b:
            lo.append(ix[a]); hi.append(ix[b]); cnt.append(wgt)
    raw = _rank_indexed(len(words), lo, hi, cnt, rounds, d)
    keep = set(nodes)
    sub = {w: raw[ix[w]] for w in words if w in keep}
    norm = _normalise(list(sub.values()))
    return dict(zip(sub.keys(), norm))


TOKENS = 100_000  # tokens of documents that are ranked together
NARROW = 64       # edges of a level below which nodes are ranked one by one


def _levels(n: int, src: np.ndarray, dst: np.ndarray) -> list[np.ndarray]:
    """Nodes by the longest way up to them from a smaller neighbour to a larger one.  No two of a level
    are neighbours, so a round may update a level at once: of its neighbours the smaller are
    updated already and the larger are not, as when nodes go one after another."""
    up = dst > src
    s, t = src[up], dst[up]
    waits = np.bincount(t, minlength=n)
    count = np.bincount(s, minlength=n)
    first = np.cumsum(count) - count
    level = np.flatnonzero((waits == 0) & (np.bincount(src, minlength=n) > 0))
    out = []
    while len(level):
        out.append(level)
        reached = t[ragged(first[level], count[level])]
        if len(reached) * 8 < n:
            reached, times = np.unique(reached, return_counts=True)
            waits[reached] -= times
            level = reached[waits[reached] == 0]
        else:
            times = np.bincount(reached, minlength=n)
            waits -= times
            level = np.flatnonzero((waits == 0) & (times > 0))
    return out


def _rank_graphs(graph: np.ndarray, lo: np.ndarray, hi: np.ndarray, cnt: np.ndarray, rounds: int, d: float) -> np.ndarray:
    """``_rank_indexed`` of many graphs: ``graph`` is that of every node, nodes of a graph are side by
    side.  The scores are the same to the last bit; 0 for nodes without edges."""
    n = len(graph)
    if not len(lo):
        return np.zeros(n)
    other = lo != hi
    src, dst = np.concatenate([lo, hi[other]]), np.concatenate([hi, lo[other]])
    weight = np.concatenate([np.where(other, cnt, 2.0 * cnt), cnt[other]])
    order = np.argsort(src * n + dst)
    src, dst, weight = src[order], dst[order], weight[order]
    levels = _levels(n, src, dst)
    if len(src) < NARROW * len(levels):  # long chains: no more than a few nodes at a time
        ends = np.flatnonzero(np.diff(graph, append=-1)) + 1
        cuts = np.searchsorted(lo, ends)
        parts, at, x = [], 0, 0
        for to, y in zip(ends.tolist(), cuts.tolist()):
            parts += _rank_indexed(to - at, lo[x:y] - at, hi[x:y] - at, cnt[x:y], rounds, d)
            at, x = to, y
        return np.array([0.0 if v is None else v for v in parts])
    coef = weight / np.bincount(src, weight, n)[dst]
    sizes = np.array([len(x) for x in levels])
    nodes = np.concatenate(levels)
    degree = np.bincount(src, minlength=n)
    edge = ragged((np.cumsum(degree) - degree)[nodes], degree[nodes])
    coef, dst = coef[edge], dst[edge]
    own = np.repeat(ragged(np.zeros(len(sizes), np.int64), sizes), degree[nodes])  # the node's place in its level
    ends = np.cumsum(np.add.reduceat(degree[nodes], np.cumsum(sizes) - sizes))
    live = degree > 0
    scores = np.where(live, 1.0 / np.maximum(np.bincount(graph, live), 1)[graph], 0.0)
    steps = [(level, own[x:y], coef[x:y], dst[x:y]) for level, x, y in zip(levels, np.concatenate([[0], ends[:-1]]), ends)]
    for _ in range(rounds):
        for level, place, c, others in steps:
            # sums go neighbour by neighbour
            scores[level] = (1 - d) + d * np.bincount(place, c * scores[others], len(level))
    return scores


def _pair_counts(seq: np.ndarray, graph: np.ndarray, n_nodes: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, count) of the unordered pairs of a token with each of the next ``span - 1`` of its graph."""
    same = [(d, graph[seq[d:]] == graph[seq[:-d]]) for d in range(1, span) if d < len(seq)]
    a = np.concatenate([seq[:-d][ok] for d, ok in same] or [seq[:0]])
    b = np.concatenate([seq[d:][ok] for d, ok in same] or [seq[:0]])
    keys, counts = np.unique(np.minimum(a, b) * n_nodes + np.maximum(a, b), return_counts=True)
    return keys // n_nodes, keys % n_nodes, counts.astype(np.float64)


def _textrank_batches(n: int, span: int, rounds: int, d: float):
    schema = pa.schema([("doc_id", pa.int64()), ("rank", pa.int32()), ("word", pa.string()),
                        ("offsets", pa.list_(pa.int64())), ("weight", pa.float64())])

    def ranked(part: pa.RecordBatch) -> pa.RecordBatch:
        packed = part.column("tokens")
        ends = packed.offsets.to_numpy().astype(np.int64)
        flat = packed.values.slice(ends[0], ends[-1] - ends[0])
        sizes = np.diff(ends)
        words, offsets = pc.struct_field(flat, "word").dictionary_encode(), pc.struct_field(flat, "offset").to_numpy()
        names = words.dictionary.to_pylist()
        by_bytes = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
        place = np.empty(len(names), np.int64)
        place[by_bytes] = np.arange(len(names))
        docs = np.repeat(np.arange(len(sizes)), sizes)
        # nodes by document, and in it by the bytes of the word
        keys, seq = np.unique(docs * len(names) + place[words.indices.to_numpy()], return_inverse=True)
        doc, word = keys // len(names), by_bytes[keys % len(names)]
        scores = _rank_graphs(doc, *_pair_counts(seq, doc, len(keys), span), rounds, d)
        own, first = np.unique(doc, return_index=True)
        least, most = np.minimum.reduceat(scores, first) / 10.0, np.maximum.reduceat(scores, first)
        which = np.searchsorted(own, doc)
        many = (sizes > 1)[doc]  # a word by itself has no pair and stays at 0
        scores[many] = (scores[many] - least[which[many]]) / (most[which[many]] - least[which[many]])
        # a stable sort breaks ties by word
        order = np.lexsort((-scores, doc))
        rank = np.arange(len(order)) - first[which[order]]
        best, rank = order[rank < n], rank[rank < n]
        by_node = np.lexsort((offsets, seq))
        times = np.bincount(seq, minlength=len(keys))
        found = offsets[by_node][ragged((np.cumsum(times) - times)[best], times[best])]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(times[best])]), pa.int32()), pa.array(found, pa.int64()))
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id").take(pa.array(doc[best])), pa.array(rank + 1, pa.int32()),
             words.dictionary.take(pa.array(word[best])), lists, pa.array(scores[best])], schema=schema)

    def fn(batches):
        for batch in batches:
            ends, at = batch.column("tokens").offsets.to_numpy(), 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + TOKENS, side="right")) - 1)
                if ends[to] > ends[at]:
                    yield ranked(batch.slice(at, to - at))
                at = to
    return fn


def textrank_keywords(docs: DataFrame, stop: DataFrame, n: int = 5, span: int = SPAN,
                      rounds: int = RANK_ROUNDS, text_col: str = "text",
                      id_col: str = "doc_id", tokens: DataFrame | None = None) -> DataFrame:
    """(doc_id, rank, word, offsets, weight) by TextRank; ``tokens`` as in
    ``extract_keywords``.

    The kept tokens are packed into one row per document (``packed_tokens``:
    a document-local aggregate, no exchange after the one that partitions the
    text by ``doc_id``).  The pairs are counted and the in-place rounds run in
    ``mapInArrow``, some documents at a time: nodes that do not depend on each
    other in a round (``_levels``) are updated together.
    """
    kept = keyword_tokens(docs, stop, None, text_col, id_col) if tokens is None else without_stop(tokens, stop)
    return (packed_tokens(kept)
            .mapInArrow(_textrank_batches(n, span, rounds, DAMPING), _RANK_SCHEMA))


def packed_tokens(kept: DataFrame) -> DataFrame:
    """One row per document: (doc_id, tokens), the kept tokens (pos, word, offset) in order.

    A row is as large as its document's text.  The graph, several times that,
    exists only while its document is ranked.
    """
    return kept.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "word", "offset"))).alias("tokens"))
