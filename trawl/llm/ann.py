"""Nearest neighbours by a permutation index.

For the largest inner product, every vector gets one coordinate more, the root
of (largest squared norm - its squared norm), and a query gets 0: the angle
between them then falls as the inner product rises.  Pivots come from a bounded
sample (``PIVOTS`` rows, those with the smallest id hashes).  Each vector is
represented by its ``PREFIX`` nearest pivots in order.  Every row is indexed:
each task packs its vectors into blocks, and a block holds inverted files (pivot
-> positions and ranks).  Query blocks meet index blocks through an equi-join on
an index group, of which there are as many as blocks; inside, posting lists add
up the truncated footrule distance, and the nearest ``KEEP`` share of the block
is ranked again by exact inner product.  KEEP is a share, so it grows with data.

Vectors that are null, zero, or hold null or non-finite components, and rows
with a null id, take no part.  Vectors of different lengths are not compared.
Ties go to the smaller id.  A repeated id is a candidate once per row, and each
of its rows asks; only a query's own row is no candidate.  Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.session import materialize

PIVOTS = 256
PREFIX = 32
KEEP = 0.35
LEAST = 64
BLOCK = 4096
QUERIES = 256
GROUPS = 24       # at least; one more for every BLOCK rows beyond


def usable(df: DataFrame) -> DataFrame:
    """(vec_id, v array<double>, row) of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    ok = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) \
        & F.exists(F.col("v"), lambda x: x != 0)
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.monotonically_increasing_id().alias("row")) \
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(ok)


def augmented(v: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the coordinate that gives all of them the largest norm."""
    rest = np.sqrt(np.maximum(0, most - (v * v).sum(axis=1)))
    return np.concatenate([v, rest[:, None]], axis=1)


def pivots(rows: DataFrame, n: int = PIVOTS) -> dict[int, tuple[np.ndarray, float]]:
    """By vector length: unit pivots and the largest squared norm."""
    most = rows.groupBy(F.size("v").alias("d")).agg(
        F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).orderBy(F.desc("m")).limit(n).collect()
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(n).collect()
    out = {}
    for d, m in most:
        own = [r.v for r in got if len(r.v) == d]
        if own:
            out[d] = (augmented(np.array(own), m) / np.sqrt(m), m)
    return out


PACK = pa.schema([("d", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("vecs", pa.binary())])


def packed(rows: DataFrame, size: int) -> DataFrame:
    """(d, rows, ids, vecs) blocks of at most ``size`` vectors of one length, built
    inside each partition."""
    def run(batches):
        held: dict[int, list] = {}

        def out(d):
            r, i, v = zip(*held.pop(d))
            return pa.RecordBatch.from_pydict({"d": [d], "rows": [np.array(r, "<i8").tobytes()], "ids": [np.array(i, "<i8").tobytes()],
                                               "vecs": [np.array(v, "<f8").tobytes()]}, schema=PACK)

        for batch in batches:
            for r in batch.to_pylist():
                d = len(r["v"])
                held.setdefault(d, []).append((r["row"], r["vec_id"], r["v"]))
                if len(held[d]) == size:
                    yield out(d)
        for d in list(held):
            yield out(d)

    return rows.mapInArrow(run, "d int, rows binary, ids binary, vecs binary")


def prefixes(v: np.ndarray, piv: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of each vector, in order."""
    return np.argsort(-(v @ piv.T), axis=1, kind="stable")[:, :length]


def block_search(qr, qi, q, vr, vi, v, piv, most, k, keep=KEEP):
    """(row, query_id, vec_id, score) of the ``k`` best of one index block per query."""
    length = min(PREFIX, len(piv))
    order = prefixes(augmented(v, most), piv, length)
    rank = np.tile(np.arange(length), len(v))
    where = np.repeat(np.arange(len(v)), length)
    by = np.argsort(order.ravel(), kind="stable")
    start = np.searchsorted(order.ravel()[by], np.arange(len(piv) + 1))
    where, rank = where[by], rank[by]
    take = max(LEAST, k + 1, int(keep * len(v)))
    by_id = np.argsort(vi, kind="stable")
    back = np.empty(len(vi), np.int64)
    back[by_id] = np.arange(len(vi))
    out = []
    for row, one, vec, pre in zip(qr, qi, q, prefixes(q, piv[:, :-1], length)):
        near = np.zeros(len(v), np.int64)
        for i, p in enumerate(pre):  # footrule: a missing pivot has rank ``length``
            s = slice(start[p], start[p + 1])
            near[where[s]] += 2 * length - i - np.abs(rank[s] - i) - rank[s]
        cand = np.arange(len(v))
        if take < len(v):
            cand = np.argpartition(-near * (len(v) + 1) + back, take)[:take]
        cand = cand[vr[cand] != row]
        score = (v[cand] * vec).sum(axis=1)
        best = np.lexsort((vi[cand], -score))[:k]
        out.append((np.full(len(best), row), np.full(len(best), one), vi[cand][best], score[best]))
    return [np.concatenate(x) for x in zip(*out)]


def search(df: DataFrame, every: int = 20, k: int = 20, keep: float = KEEP) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of each query."""
    rows = materialize(usable(df), "vectors")
    piv = df.sparkSession.sparkContext.broadcast(pivots(rows))
    groups = max(GROUPS, rows.count() // BLOCK)
    index = packed(rows, BLOCK).withColumn("g", F.pmod(F.xxhash64("rows"), F.lit(groups)))
    asked = packed(rows.where(F.col("vec_id") % every == 0), QUERIES).select(
        "d", *[F.col(c).alias(f"q{c}") for c in ("rows", "ids", "vecs")],
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))
    arrow = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                qr, qi, vr, vi = (np.frombuffer(r[c], "<i8") for c in ("qrows", "qids", "rows", "ids"))
                q = np.frombuffer(r["qvecs"], "<f8").reshape(len(qi), -1)
                v = np.frombuffer(r["vecs"], "<f8").reshape(len(vi), -1)
                # a length without pivots is rare in the sample: all its rows are candidates
                own, most = piv.value.get(r["d"], (np.zeros((0, r["d"] + 1)), 0.0))
                got = block_search(qr, qi, q, vr, vi, v, own, most, k, keep if len(own) else 1.0)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], schema=arrow)

    found = asked.join(index, ["d", "g"]).select("d", "qrows", "qids", "qvecs", "rows", "ids", "vecs").mapInArrow(
        run, "row long, query_id long, vec_id long, score double")
    w = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
