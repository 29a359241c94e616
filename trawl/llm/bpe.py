"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The distinct new words of a batch lie in one flat symbol array.  In each round
the adjacent pairs are looked up by binary search over the sorted pair keys,
every word merges all places of its lowest-rank pair, and words without a known
pair drop out.  A worker numbers the stretches between blanks that it has seen
(no word spans a single blank between others) and keeps their ids in one flat
array, so a batch's ids are one gather over its stretches' numbers.
Vocabulary, merges, word pattern, normalization and a mark for word ends come
from a tokenizer file (a parameter).

Null or empty text: no ids, empty decoded text.  A special token's string in a
text is that token, as in the tokenizers library.  Long texts are cut before a
single blank between two words, which no word spans.  Rows are kept as they are
(repeated or null ids included); other columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Fixed value: the published split pattern of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# White space in such patterns, in all texts and in ASCII ones.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ASCII = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r"\t-\r "}
NONE = np.int64(1 << 40)
PART = 1 << 20      # characters of a long text encoded at a time
GROUP = 1 << 21     # characters of a batch's texts encoded at a time
_SEAM = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
_RARE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BESIDE = re.compile(r"\s | \s")


def byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def reordered(pattern: str) -> str:
    """The pattern with its alternatives for letters and numbers first: these begin
    with other characters than the contractions before them, and are tried most."""
    parts = pattern.split("|")
    quoted = [p for p in parts if p.startswith("'")]
    rest = [p for p in parts if not p.startswith("'")]
    at = next((i for i, p in enumerate(rest) if "[^" in p), 0)
    return "|".join(rest[:at] + quoted + rest[at:])


def ascii_pattern(pattern: str) -> re.Pattern:
    """The pattern for ASCII texts, without Unicode classes."""
    for name, chars in ASCII.items():
        # inside brackets the class is spelled out, outside it gets its own
        pattern = re.sub(r"(\[[^\]]*)" + re.escape(name), lambda m: m[1] + chars, pattern)
        pattern = re.sub(r"(\[[^\]]*)" + re.escape(name), lambda m: m[1] + chars, pattern).replace(name, f"[{chars}]")
    return re.compile(pattern.replace(r"\S", r"[^\t-\r ]"))


def unicode_pattern(pattern: str) -> regex.Pattern:
    pattern = re.sub(r"(\[[^\]]*)\\s", lambda m: m[1] + SPACE.replace("\\", "\\"), pattern)
    return regex.compile(pattern.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))


def normalizer(spec: dict | None) -> Callable[[str], str] | None:
    """The text changes that a tokenizer file asks for."""
    steps = [] if spec is None else spec["normalizers"] if spec["type"] == "Sequence" else [spec]
    kinds = [s["type"] for s in steps]
    blanks = [s for s in steps if s["type"] == "Replace"]
    if not set(kinds) <= {"NFC", "Replace", "Lowercase"} or any(s["pattern"] != {"Regex": r"\s+"} or s["content"] != " " for s in blanks):
        raise ValueError(f"unknown text changes: {kinds}")
    if not steps:
        return None

    def change(t: str) -> str:
        if not t.isascii():
            t = unicodedata.normalize("NFC", t) if "NFC" in kinds else t
            t = t.replace("\u03a3", "\u03c3") if "Lowercase" in kinds else t  # by character: no final sigma
        return t.lower() if "Lowercase" in kinds else t
    return change


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches ``which`` of a flat array, one after another."""
    lens = sizes[which]
    ends = np.cumsum(lens)
    return flat[np.repeat(starts[which] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)]


class ByteBpe:
    def __init__(self, path: str, cache: int = 900_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        chars = byte_chars()
        back = {c: b for b, c in enumerate(chars)}
        self.byte_id = np.array([vocab[c] for c in chars], np.int64)
        self.last_id = np.array([vocab[c + end] for c in chars], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        for s, i in vocab.items():
            pieces[i] = bytes(back[c] for c in s)
        for s, i in self.special.items():
            pieces[i] = s.encode()
        self.piece_starts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        own = [p["pattern"]["Regex"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        pattern = reordered(own[0] if own else SPLIT)
        self.blanks = not own  # whether words keep a blank before them
        self.split, self.split_ascii = unicode_pattern(pattern).findall, ascii_pattern(pattern).findall
        self.change = normalizer(spec["normalizer"])
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.limit = cache
        self.forget()

    def forget(self) -> None:
        """Begins a new numbering of stretches and words; special tokens are stretches
        too, by their id."""
        self.number: dict = {i: k for k, i in enumerate(self.special.values())}
        self.flat = np.array([*self.special.values()], np.int32)
        self.starts, self.sizes = np.arange(len(self.flat)), np.ones(len(self.flat), np.int64)
        self.word: dict[str, int] = {}
        self.word_flat, self.word_starts, self.word_sizes = (np.zeros(0, t) for t in (np.int32, np.int64, np.int64))

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return [text] if text.isalpha() else self.split_ascii(text)
        return self.split(text)

    def learn(self, keys: list) -> None:
        """Numbers new stretches and appends their ids; words in them that are new are
        merged."""
        found = [self.words(k[0] if isinstance(k, tuple) else " " + k if self.blanks else k) for k in keys]
        every = [w for ws in found for w in ws]
        new = list(dict.fromkeys(w for w in every if w not in self.word))
        if new:
            ids, lens = self._rounds([w.encode("utf-8", "surrogatepass") for w in new])
            self.word.update(zip(new, range(len(self.word), len(self.word) + len(new))))
            self.word_starts = np.concatenate([self.word_starts, len(self.word_flat) + np.cumsum(lens) - lens])
            self.word_sizes = np.concatenate([self.word_sizes, lens])
            self.word_flat = np.concatenate([self.word_flat, ids.astype(np.int32)])
        which = np.fromiter(map(self.word.__getitem__, every), np.int64, len(every))
        ids = gathered(self.word_flat, self.word_starts, self.word_sizes, which)
        ends = np.concatenate([[0], np.cumsum(self.word_sizes[which])])
        borders = ends[np.cumsum([0, *map(len, found)])]
        self.number.update(zip(keys, range(len(self.starts), len(self.starts) + len(keys))))
        self.starts = np.concatenate([self.starts, len(self.flat) + borders[:-1]])
        self.sizes = np.concatenate([self.sizes, np.diff(borders)])
        self.flat = np.concatenate([self.flat, ids])

    def _rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, one after another; how many each has); none is empty."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        lens = np.array([len(w) for w in words])
        sym, ends = self.byte_id[raw], np.cumsum(lens) - 1
        sym[ends] = self.last_id[raw[ends]]
        names, done = np.arange(len(words)), []
        while len(names):
            word = np.repeat(np.arange(len(names)), lens)
            pair = sym[:-1] << 32 | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pair) & (word[:-1] == word[1:]), self.ranks[at], NONE)
            rank = np.append(rank, NONE)
            starts = np.cumsum(lens) - lens
            low = np.minimum.reduceat(rank, starts)
            idle = low == NONE
            if idle.any():
                live = ~idle[word]
                done.append((names[idle], lens[idle], sym[~live]))
                sym, rank, names, lens, low = sym[live], rank[live], names[~idle], lens[~idle], low[~idle]
                if not len(names):
                    break
                word = np.repeat(np.arange(len(names)), lens)
            hit = rank == low[word]
            where = np.flatnonzero(hit)
            # overlapping hits (a a a) are taken left to right: every second of a run
            first = np.append(True, np.diff(where) != 1)
            run = where[np.maximum.accumulate(np.where(first, np.arange(len(where)), 0))]
            where = where[(where - run) % 2 == 0]
            sym[where] = self.merged[rank[where]]
            keep = np.ones(len(sym), bool)
            keep[where + 1] = False
            lens = lens - np.bincount(word[where], minlength=len(names))
            sym = sym[keep]
        names, lens, ids = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(names)
        return gathered(ids, np.cumsum(lens) - lens, lens, order), lens[order]

    def stretches(self, part: str) -> list:
        """Keys of the part's stretches: without blanks, or (with the blank before them)
        by what follows the blank; a word by itself is a tuple."""
        rare = bool(_RARE.search(part))
        if not self.blanks:
            if rare and any(c in part for c in "\x1c\x1d\x1e\x1f"):  # blanks to Python only
                return [(w,) for w in self.words(part)]
            return part.split()
        if "  " in part or "\n " in part or " \n" in part or part.endswith(" ") or rare and _BESIDE.search(part):
            return [(w,) for w in self.words(part)]
        keys: list = part.split(" ")
        if keys[0]:
            keys[0] = (keys[0],)
        else:
            del keys[0]
        return keys

    def parts(self, text: str) -> Iterator[list]:
        """Stretches of the text (special tokens as their ids), in parts."""
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.special:
                yield [self.special[piece]]
                continue
            at = 0
            while at < len(piece):
                end = at + PART
                seam = _SEAM.search(piece, end) if end < len(piece) else None
                end = seam.start() if seam else len(piece)
                part = piece[at:end] if at or end < len(piece) else piece
                yield self.stretches(self.change(part) if self.change else part)
                at = end

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another; where each text's begin, and the end)."""
        counts = np.zeros(len(texts), np.int64)
        out, keys, owners, room = [np.zeros(0, np.int32)], [], [], GROUP

        def flush():
            if len(self.number) > self.limit:
                self.forget()
            which = np.fromiter(map(self.number.get, keys, repeat(-1)), np.int64, len(keys))
            missing = np.flatnonzero(which < 0).tolist()
            if missing:
                self.learn(list(dict.fromkeys(keys[i] for i in missing)))
                which[missing] = [self.number[keys[i]] for i in missing]
            lens = self.sizes[which]
            out.append(gathered(self.flat, self.starts, self.sizes, which))
            borders = np.concatenate([[0], np.cumsum(lens)])[np.cumsum([0, *[n for _, n in owners]])]
            np.add.at(counts, [i for i, _ in owners], np.diff(borders))
            keys.clear()
            owners.clear()

        for i, t in enumerate(texts):
            for part in self.parts(t) if t else ():
                keys += part
                owners.append((i, len(part)))
                room -= 6 * len(part)  # about as many characters
                if room <= 0:
                    flush()
                    room = GROUP
        if keys:
            flush()
        return np.concatenate(out), np.concatenate([[0], np.cumsum(counts)])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of ids that lie one after another."""
        size = np.diff(self.piece_starts)
        at = np.concatenate([[0], np.cumsum(size[ids])])[offsets]
        raw = bytearray()
        for k in range(0, len(ids), PART):
            part = ids[k:k + PART]
            n = size[part]
            shift = np.repeat(self.piece_starts[part] - (np.cumsum(n) - n), n)
            raw += self.piece_bytes[np.arange(n.sum()) + shift].tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at.tolist(), at[1:].tolist())]


_LOADED: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """One coder per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def id_lists(ids: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                b = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), id_lists(*loaded(path).encode(b.column("text").to_pylist()))],
                                                 names=["doc_id", "ids"])

    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text").mapInArrow(
        run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text) with the text the ids stand for; null ids: no text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                b = batch.slice(k, 256)
                lists = b.column("ids").fill_null([]) if b.column("ids").null_count else b.column("ids")
                offsets = lists.offsets.to_numpy()
                ids = lists.values.to_numpy()[offsets[0]:offsets[-1]]
                texts = loaded(path).decode(ids, offsets - offsets[0])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(texts, pa.string())],
                                                 names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, then decode."""
    out = decode(encode(docs, path), path)
    return out.selectExpr("doc_id", "CAST(size(ids) AS BIGINT) AS n_tokens",
                          "sha2(array_join(ids, ','), 256) AS ids_sha256",
                          "sha2(text, 256) AS decoded_sha256")
