"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = np.uint64(0x9E3779B97F4A7C15)


def arrow_map(df: DataFrame, fn: Callable[[dict], dict | None], schema: str, arrow: pa.Schema,
              rows: int = 256) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows; ``fn`` maps a dict of
    Python lists to a dict of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                got = fn(batch.slice(at, rows).to_pydict())
                if got is not None:
                    yield pa.RecordBatch.from_pydict(got, schema=arrow)

    return df.mapInArrow(run, schema)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


_KEPT = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)}
FOLD = bytes(b if b in _KEPT else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def word_parts(raw: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of a UTF-8 text: runs of ASCII letters, digits and non-ASCII
    characters, A-Z lower-cased; in parts of about ``size`` bytes."""
    at = 0
    while at < len(raw):
        end = at + size
        if end < len(raw):
            stop = _BREAK.search(raw, end)
            end = stop.start() if stop else len(raw)
        yield raw[at:end].translate(FOLD).split()
        at = end


class WordHash:
    """64-bit word hashes with a memory-bounded cache per task."""

    def __init__(self, limit: int = 500_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, new = self.known, xxhash.xxh3_64_intdigest
        if len(known) > self.limit:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = new(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


_PLACE = 1 << 16  # bytes of a text hashed at a time
_LONG = 1 << 12   # bytes of a word from which it is hashed by itself
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]")
_BASE = 0x9E3779B97F4A7C15
with np.errstate(over="ignore"):
    _POWER = np.cumprod(np.full(2 * _PLACE, _BASE, np.uint64))
    _INVERSE = np.cumprod(np.full(2 * _PLACE, pow(_BASE, -1, 1 << 64), np.uint64))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, in order, and
    where they start: a polynomial of the word's bytes (from running sums, so all
    words at once), finalized; words of ``_LONG`` bytes or more by xxhash."""
    hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(raw):
        stop = _BLANK.search(raw, at + _PLACE)
        end = stop.start() if stop else len(raw)
        if end - at > 2 * _PLACE - 2:  # a very long word: what is before it, then the word
            last = max(raw.rfind(c, at, at + _PLACE) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
            if last >= at:
                end = last + 1
            else:
                stop = _BLANK.search(raw, at)
                end = stop.start() if stop else len(raw)
                if end - at >= _LONG:
                    hashes.append(np.array([xxhash.xxh3_64_intdigest(raw[at:end])], np.uint64))
                    starts.append(np.array([at]))
                    at = end
                    continue
        b = np.frombuffer(raw, np.uint8, end - at, at)
        inside = np.concatenate([[False], ~_SPACE[b], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, past = edges[::2], edges[1::2]
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b + np.uint64(1)) * _POWER[:len(b)], out=sums[1:])
        h = mix((sums[past] - sums[first]) * _INVERSE[first])
        for i in np.flatnonzero(past - first >= _LONG):
            h[i] = xxhash.xxh3_64_intdigest(b[first[i]:past[i]].tobytes())
        hashes.append(h)
        starts.append(first + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (splitmix)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of ``k`` words; the whole sequence if it is shorter."""
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out * MASK + h[i:i + n] + np.uint64(i + 1))
    return out


def salt(col, n: int = 32):
    return F.pmod(F.hash(col), F.lit(n))


def hot_join(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner", n: int = 32) -> DataFrame:
    """``left`` joined to ``right`` (one row per ``key``) where a key may hold
    a third of ``left``: rows are salted by ``by``, and ``right`` is repeated
    only for the salts that a key really has."""
    keyed = left.withColumn("_salt", salt(by, n))
    need = keyed.select(key, "_salt").distinct().join(right, key)
    return keyed.join(need, [key, "_salt"], how).drop("_salt")
