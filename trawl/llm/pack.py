"""Packing by concatenate and cut.

Pass 1 tokenizes each partition (by the merge rounds of ``bpe``, each distinct
word once as long as a worker knows it) and writes its documents with their
offsets inside the partition.  The partition totals (one row per partition) give global
offsets by a prefix sum.  Pass 2 cuts the documents at the window borders; a
document over a border leaves a piece in each window.  Nothing is shuffled.

Null or empty text: only the end token.  Repeated or null ids: each row is a
document of its own.  Only the last sequence is shorter than the window.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.bpe import loaded
from trawl.session import materialize

WINDOW = 2048


def tokenized(docs: DataFrame, path: str, end_id: int = 1, rows: int = 64) -> DataFrame:
    """(part, at, doc_id, n, ids little-endian uint32), written once."""
    arrow = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()),
                       ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                b = batch.slice(k, rows)
                ids, offsets = loaded(path).encode(b.column("text").to_pylist())
                n = np.diff(offsets) + 1
                ends = np.cumsum(n)
                raw = pa.py_buffer(np.insert(ids, offsets[1:], end_id).astype("<u4").tobytes())
                cells = pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part), pa.int32()), pa.array(at + ends - n), b.column("doc_id"), pa.array(n),
                     pa.Array.from_buffers(pa.binary(), len(n), [None, cells, raw])], schema=arrow)
                at += int(ends[-1])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "part int, at long, doc_id long, n long, ids binary")
    return materialize(out, "tokens")


def pieces(tokens: DataFrame, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (and ids as bytes)."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    base = totals.select("part", F.coalesce(F.sum("total").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(base), "part").selectExpr("doc_id", "n", "ids", "base + at AS at")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    arrow = pa.schema([(c, pa.int64()) for c in names] + ([("ids", pa.binary())] if with_ids else []))

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                out = []
                for r in batch.slice(k, 64).to_pylist():
                    lo = 0
                    while lo < r["n"]:
                        seq, off = divmod(r["at"] + lo, window)
                        hi = min(r["n"], lo + window - off)
                        cut = r["ids"][4 * lo:4 * hi]
                        out.append((r["doc_id"], lo, hi - lo, zlib.crc32(cut), r["n"], seq, off, cut))
                        lo = hi
                cols = list(zip(*out))[:len(arrow)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    ddl = ", ".join(f"{c} long" for c in names) + (", ids binary" if with_ids else "")
    return placed.mapInArrow(run, ddl)


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    return pieces(tokenized(docs, path), window)
