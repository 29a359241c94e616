"""Cuts of many pieces at once, on arrays.

A batch of documents is split into pieces where its bytes lie, the pieces are
dictionary-encoded, and the distinct ones are cut together: the lexicon is a
trie of sorted arrays that all positions walk in step, the best path of all
pieces is found by their distance to the end.  Only what is sequential by
nature (a piece of more than ``LONG`` characters, a run re-cut by the HMM) is
cut one by one, with the functions of ``segment``.  Nothing is kept from one
batch to the next but the cuts of runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LONG = 200          # characters of a piece from which the best path is found by itself
BLOCK = 1 << 17     # characters of distinct pieces that are cut together
CHUNK = 2 << 20     # bytes of text that are split together
ROWS = 100_000      # rows of a batch that leaves the task
EXPAND = 250_000    # tokens of texts that are held at a time
TIMES = 4           # a dictionary of a lexicon takes so many times the memory of its trie, or more
GATHER = 200_000    # pieces that are looked up together
DENSE = 1 << 21     # least keys of a trie that have a direct table
RUNS = 50_000       # re-cut runs that are kept


def ragged(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (sizes[0] of them), first[1], ..."""
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def strings(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The slices [begin, end) of UTF-8 bytes; those that tile the bytes are not copied."""
    if not len(begin):
        return pa.array([], pa.string())
    if not np.array_equal(begin[1:], end[:-1]):
        data = data[ragged(begin, end - begin)]
        end = np.cumsum(end - begin)
        begin = np.concatenate([[0], end[:-1]])
    ends = np.append(begin, end[-1]).astype(np.int32)
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))


class Trie:
    """Words and weights.  ``keys`` are sorted; node ``k + 1`` is the one that ``keys[k]`` (its
    parent times the size of the alphabet, plus the class of its character) leads to."""

    def __init__(self, words: list[str], weights: list[float]):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = code_points(words)
        alphabet = np.unique(points)
        self.classes = np.zeros(int(alphabet[-1]) + 2 if len(alphabet) else 1, np.int32)
        self.classes[alphabet] = np.arange(1, len(alphabet) + 1)
        self.n = len(alphabet) + 1
        cls, starts = self.classes[points], np.cumsum(sizes) - sizes
        at, alive, keys, total, size = np.zeros(len(words), np.int64), np.arange(len(words)), [], 0, 0
        while len(alive := alive[sizes[alive] > size]):
            found, which = np.unique(at[alive] * self.n + cls[starts[alive] + size], return_inverse=True)
            at[alive] = total + 1 + which
            keys.append(found)
            total += len(found)
            size += 1
        self.keys = np.concatenate([*keys, np.zeros(0, np.int64)])
        self.place = np.full(total + 1, -1, np.int32)   # of the node's word in ``words``
        self.place[at] = np.arange(len(words))
        self.place[0] = -1
        self.weights = np.array(weights, np.float64)
        self.direct = None

    def __getstate__(self):
        return self.__dict__ | {"direct": None}

    def child(self, node: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """The node below, 0 if there is none."""
        if self.direct is None:
            first = self.keys[:np.searchsorted(self.keys, DENSE)]
            self.direct = np.zeros(min(DENSE, len(self.place) * self.n), np.int32)
            self.direct[first] = np.arange(1, len(first) + 1)
        key = node * self.n + cls
        if len(self.direct) < DENSE:
            return np.where(cls > 0, self.direct[key], 0)
        out = self.direct[np.minimum(key, DENSE - 1)].astype(np.int64)
        far = np.flatnonzero(key >= DENSE)
        if len(far):
            k = np.minimum(np.searchsorted(self.keys, key[far]), len(self.keys) - 1)
            out[far] = np.where(self.keys[k] == key[far], k + 1, 0)
        out[cls == 0] = 0
        return out


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class Pieces:
    """Pieces side by side: positions are those of characters in all of them."""

    def __init__(self, names: list[str], trie: Trie, cap: int):
        self.names, self.trie, self.cap = names, trie, cap
        self.sizes = np.fromiter(map(len, names), np.int64, len(names))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.piece = np.repeat(np.arange(len(names)), self.sizes)
        self.points = code_points(names)
        self.n = len(self.points)
        p = self.points
        self.bytes = np.concatenate([[0], np.cumsum(1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000))])
        self.data = np.frombuffer("".join(names).encode("utf-8", "surrogatepass"), np.uint8)
        self.cuts: dict = {}
        self._walk()

    def _walk(self) -> None:
        """Words from every position, by position and size; whether two and three characters are a word."""
        trie, left = self.trie, self.ends[self.piece] - np.arange(self.n)
        cls = trie.classes[np.minimum(self.points, len(trie.classes) - 1)].astype(np.int64)
        at = np.arange(self.n)
        node = trie.child(np.zeros(self.n, np.int64), cls)
        self.gram = {2: np.zeros(self.n, bool), 3: np.zeros(self.n, bool)}
        pos, sizes, words, size = [at[:0]], [at[:0]], [at[:0]], 1
        while True:
            live = np.flatnonzero(node)
            at, node = at[live], node[live]
            if not len(at):
                break
            word = trie.place[node]
            hits = np.flatnonzero(word >= 0)
            if size in self.gram:
                self.gram[size][at[hits]] = True
            if size <= self.cap:
                pos.append(at[hits])
                sizes.append(np.full(len(hits), size))
                words.append(word[hits].astype(np.int64))
            elif size >= 3:
                break
            more = np.flatnonzero(left[at] > size)
            at, node = at[more], node[more]
            node = trie.child(node, cls[at + size])
            size += 1
        pos, sizes, words = map(np.concatenate, (pos, sizes, words))
        order = np.argsort(pos, kind="stable")
        self.left, self.pos, self.size, self.word = left, pos[order], sizes[order], words[order]
        self.weight = trie.weights[self.word]

    # ---------------------------------------------------------------- cuts that tile: where tokens begin

    def best_path(self, least: float, min_double: float, eps: float, alone) -> np.ndarray:
        """Where the tokens of ``segment.mp_cut`` begin; ``alone(piece, edges)`` cuts a long piece."""
        begins = np.zeros(self.n, bool)
        short = self.sizes <= LONG
        node = np.arange(self.n) + self.piece            # a piece has a place more than characters
        best, steps = np.zeros(self.n + len(self.names)), np.ones(self.n, np.int64)
        here = np.flatnonzero(short[self.piece])
        here = here[np.argsort(self.left[here].astype(np.uint16), kind="stable")]
        rank = np.zeros(self.n, np.int64)
        rank[here] = np.arange(len(here))
        edge = np.flatnonzero(short[self.piece[self.pos]])
        edge = edge[np.argsort(self.left[self.pos[edge]].astype(np.uint16), kind="stable")]
        e_pos, e_size, e_weight = self.pos[edge], self.size[edge], self.weight[edge]
        e_to = node[e_pos] + e_size
        longest = int(self.left[here[-1]]) if len(here) else 0
        upto = np.cumsum(np.bincount(self.left[here], minlength=longest + 1))
        e_upto = np.cumsum(np.bincount(self.left[e_pos], minlength=longest + 1))
        for t in range(1, longest + 1):
            n0, n1, m0, m1 = upto[t - 1], upto[t], e_upto[t - 1], e_upto[t]
            at = here[n0:n1]
            unknown = best[node[at] + 1] + least
            if m0 == m1:
                best[node[at]] = unknown
                continue
            ep, es = e_pos[m0:m1], e_size[m0:m1]
            v = best[e_to[m0:m1]] + e_weight[m0:m1]
            seg = np.flatnonzero(np.concatenate([[True], ep[1:] != ep[:-1]]))
            slot, own = rank[ep[seg]] - n0, es[seg] == 1
            unk = unknown[slot]
            top = np.maximum(np.maximum.reduceat(v, seg), np.where(own, min_double, unk))
            dead, lim = top <= min_double, top - eps
            near = np.where(v >= np.repeat(lim, np.diff(seg, append=len(ep))), np.arange(len(ep)), len(ep) - 1)
            first = np.minimum.reduceat(near, seg)
            unknown[slot] = np.where(dead, min_double, top)
            best[node[at]] = unknown
            steps[at[slot]] = np.where(dead | (~own & (unk >= lim)), 1, es[first])
        cur, end = self.starts[short], self.ends[short]
        while len(cur):
            live = cur < end
            cur, end = cur[live], end[live]
            begins[cur] = True
            cur = cur + steps[cur]
        for k in np.flatnonzero(~short):
            x, y = np.searchsorted(self.pos, (self.starts[k], self.ends[k]))
            edges: dict = {}
            for s, z, w in zip((self.pos[x:y] - self.starts[k]).tolist(), self.size[x:y].tolist(), self.weight[x:y].tolist()):
                edges.setdefault(s, []).append((s + z - 1, w))
            self._set(begins, self.starts[k], alone(self.names[k], edges))
        return begins

    @staticmethod
    def _set(begins: np.ndarray, start: int, words: list[str]) -> None:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begins[start + np.cumsum(sizes) - sizes] = True

    def by_hmm(self, cut) -> np.ndarray:
        """Where the tokens of ``cut`` of each piece begin."""
        sizes = [len(w) for name in self.names for w in cut(name)]
        begins = np.zeros(self.n, bool)
        begins[np.cumsum([0, *sizes[:-1]])] = True
        return begins

    def mixed(self, begins: np.ndarray, singles: np.ndarray, cut) -> np.ndarray:
        """Runs of one-character tokens that are no one-character user words, re-cut by ``cut``."""
        at = np.flatnonzero(begins)
        lone = (np.diff(at, append=self.n) == 1) & ~np.isin(self.points[at], singles)
        fresh = np.concatenate([[True], ~lone[:-1] | (self.piece[at[1:]] != self.piece[at[:-1]])]) if len(at) else lone
        heads = np.flatnonzero(lone & fresh)
        # a run ends where a token is not open, or a piece begins
        stop = np.append(np.flatnonzero(~lone | fresh), len(at))
        ends = stop[np.searchsorted(stop, heads, side="right")]
        many = ends - heads > 1
        whole = "".join(self.names)
        for x, y in zip(at[heads[many]].tolist(), (at[ends[many] - 1] + 1).tolist()):
            begins[x:y] = False
            for w in cut(whole[x:y]):
                begins[x] = True
                x += len(w)
        return begins

    # ---------------------------------------------------------------- tokens: (first character, characters)

    def tiles(self, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(begins)
        return at, np.diff(at, append=self.n)

    def reached(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every position: whether a longer word begins there, whether an earlier word covers it."""
        longer, reach = np.zeros(self.n, bool), np.zeros(self.n, np.int64)
        longer[self.pos[self.size > 1]] = True
        reach[self.pos] = self.pos + self.size  # of a position's words the longest is the last
        cover = np.concatenate([[0], np.maximum.accumulate(reach)[:-1]]) if self.n else reach
        return longer, cover > np.arange(self.n)

    def full(self) -> tuple[np.ndarray, np.ndarray]:
        longer, covered = self.reached()
        single = np.flatnonzero(~longer & ~covered)
        many = self.size > 1
        at, size = np.concatenate([self.pos[many], single]), np.concatenate([self.size[many], np.ones(len(single), np.int64)])
        order = np.argsort(at, kind="stable")
        return at[order], size[order]

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(position, characters, word, stays): the lexicon words by position, and the character of
        every position (word -1 if it is none); whether the full cut keeps them."""
        longer, covered = self.reached()
        bare = np.ones(self.n, bool)
        bare[self.pos[self.size == 1]] = False
        at = np.flatnonzero(bare)
        pos = np.concatenate([self.pos, at])
        size = np.concatenate([self.size, np.ones(len(at), np.int64)])
        word = np.concatenate([self.word, np.full(len(at), -1)])
        order = np.argsort(pos * 2 + (size > 1), kind="stable")
        pos, size, word = pos[order], size[order], word[order]
        return pos, size, word, (size > 1) | ~(longer | covered)[pos]

    def search(self, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lexicon 2-grams of longer tokens, then 3-grams, then the token."""
        at, size = self.tiles(begins)
        token = np.repeat(np.arange(len(at)), size)
        rest = np.repeat(at + size, size) - np.arange(self.n)
        two = np.flatnonzero(self.gram[2] & (rest >= 2) & (size[token] > 2))
        three = np.flatnonzero(self.gram[3] & (rest >= 3) & (size[token] > 3))
        key = np.concatenate([token[two] * 3, token[three] * 3 + 1, np.arange(len(at)) * 3 + 2])
        order = np.argsort(key, kind="stable")
        every = np.concatenate([two, three, at])
        sizes = np.concatenate([np.full(len(two), 2), np.full(len(three), 3), size])
        return every[order], sizes[order]

    def texts(self, at: np.ndarray, size: np.ndarray) -> pa.Array:
        return strings(self.data, self.bytes[at], self.bytes[at + size])


class Table:
    """Tokens of distinct pieces: ``counts`` by piece; ``texts``, where they begin in their
    piece in characters and in bytes, and their characters."""

    def __init__(self, counts, texts, chars, places, sizes):
        self.counts, self.texts, self.chars, self.places, self.sizes = counts, texts, chars, places, sizes

    @classmethod
    def one(cls, p: Pieces, at: np.ndarray, size: np.ndarray) -> Table:
        own = p.starts[p.piece[at]]
        return cls(np.bincount(p.piece[at], minlength=len(p.names)), p.texts(at, size), at - own, p.bytes[at] - p.bytes[own], size)

    @classmethod
    def of(cls, parts: list[Table]) -> Table:
        if not parts:
            empty = np.zeros(0, np.int64)
            return cls(empty, pa.array([], pa.string()), empty, empty, empty)
        return cls(np.concatenate([t.counts for t in parts]), pa.concat_arrays([t.texts for t in parts]),
                   *(np.concatenate([getattr(t, c) for t in parts]) for c in ("chars", "places", "sizes")))


class Tokens:
    """The tokens of texts ``first`` to ``last`` of a chunk, ``rows`` in number; those of row ``i`` lie
    between ``ends[i]`` and ``ends[i + 1]``."""

    def __init__(self, split: Split, table: Table, first: int, last: int, starts: tuple):
        x, y = split.first[first], split.first[last]
        codes = split.codes[x:y]
        self.first, self.rows, self.table = first, last - first, table
        self.starts = [s[x:y] for s in starts]
        self.counts = table.counts[codes]
        self.at = ragged((np.cumsum(table.counts) - table.counts)[codes], self.counts)
        self.ends = np.concatenate([[0], np.cumsum(self.counts)])[split.first[first:last + 1] - x]
        self.words = table.texts.take(pa.array(self.at))

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where tokens begin in their text, in bytes and in characters, and their characters."""
        byte, char = self.starts
        return (np.repeat(byte, self.counts) + self.table.places[self.at],
                np.repeat(char, self.counts) + self.table.chars[self.at], self.table.sizes[self.at])


class Split:
    """Texts split at separators: ``codes`` of the pieces, ``names`` of the distinct ones."""

    def __init__(self, texts: pa.Array, separators: str):
        n = len(texts)
        wide = pa.types.is_large_string(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        cut = np.zeros(len(data) + 4, bool)
        table = np.zeros(256, bool)
        table[[ord(c) for c in separators if c.isascii()]] = True
        at = np.flatnonzero(table[data])
        cut[at], cut[at + 1] = True, True
        for c in (c.encode() for c in separators if not c.isascii()):
            at = np.flatnonzero(data == c[0])
            at = at[at + len(c) <= len(data)]
            for k, b in enumerate(c[1:], 1):
                at = at[data[at + k] == b]
            cut[at], cut[at + len(c)] = True, True
        cut[offsets] = True
        bounds = np.flatnonzero(cut[:len(data) + 1])
        self.begin = bounds[:-1]                       # byte of every piece
        self.first = np.searchsorted(self.begin, offsets)  # piece of every text
        found = strings(data, bounds[:-1], bounds[1:]).dictionary_encode()
        self.codes, self.names = found.indices.to_numpy(), found.dictionary.to_pylist()
        self.pieces, self.offsets, self.data = np.diff(self.first), offsets, data

    def tokens(self, table: Table, places: bool):
        """``Tokens`` of about ``EXPAND`` tokens, or of one text."""
        starts = self.starts() if places else ()
        ends = np.concatenate([[0], np.cumsum(table.counts[self.codes])])[self.first]
        at = 0
        while at < len(self.pieces):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + EXPAND, side="right")) - 1)
            yield Tokens(self, table, at, to, starts)
            at = to

    def starts(self) -> tuple[np.ndarray, np.ndarray]:
        """Where every piece begins in its text, in bytes and in characters."""
        own = np.repeat(self.offsets[:-1], self.pieces)
        if len(self.data) and self.data.max() >= 0x80:
            chars = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
            return self.begin - own, chars[self.begin] - chars[own]
        return self.begin - own, self.begin - own


def chunks(batch: pa.RecordBatch, column: str = "text"):
    """(first row, rows, texts) of about ``CHUNK`` bytes each."""
    texts = batch.column(column)
    wide = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, side="right")) - 1)
        yield at, to - at, texts.slice(at, to - at)
        at = to


def blocks(names: list[str]):
    """Slices of ``names`` of about ``BLOCK`` characters each."""
    sizes = np.cumsum(np.fromiter(map(len, names), np.int64, len(names)))
    at, done = 0, 0
    while at < len(names):
        to = max(at + 1, int(np.searchsorted(sizes, done + BLOCK, side="right")))
        yield names[at:to]
        at, done = to, sizes[to - 1]


def gathered(batches, column: str, rows: int = GATHER):
    """Batches put together to about ``rows`` rows or ``CHUNK`` bytes of ``column``."""
    some, n, size = [], 0, 0
    for batch in batches:
        some.append(batch)
        n, size = n + batch.num_rows, size + batch.column(column).nbytes
        if n >= rows or size >= CHUNK:
            yield pa.Table.from_batches(some).combine_chunks().to_batches()
            some, n, size = [], 0, 0
    if n:
        yield pa.Table.from_batches(some).combine_chunks().to_batches()


def slices(batch: pa.RecordBatch):
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)
