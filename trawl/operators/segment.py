"""Segmentation: max-probability, HMM, mixed, full and search cuts.

No cut crosses a separator, so a piece between separators is cut the same way
wherever it stands.  A lexicon of a few ``LEXICON_LIMIT`` bytes (summed, not
guessed) travels to the tasks; texts are dealt to partitions of like size (the
only exchange) and the distinct pieces of a few MB of text are cut together
(``lattice``).  A larger lexicon is joined: the distinct pieces get their candidate
words from ``lexicon.dag_edges``, are cut once, and the piece dictionary is
joined back to the documents' pieces.

The HMM model and the set of one-character user words are bounded by the
alphabet and travel with the function.  Documents whose text is null or not
valid UTF-8 give no tokens; null and repeated ids are kept as they are.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.operators import lattice as LT
from trawl.operators import lexicon as LX
from trawl.functions.text import DEFAULT_SEPARATORS, LATIN_TOKEN_RE, split_fields_py
from trawl.operators.tokenize import presplit, separator_pattern, text_partitions
from trawl.session import materialize

# Fixed values that must equal the reference.
MIN_DOUBLE = -3.14e100
# Path scores closer than this are ties (shortest candidate wins).
TIE_EPS = 1e-9
B, E, M, S = 0, 1, 2, 3


@dataclass
class HmmModel:
    """Start (4), transition (4x4) log-probabilities and per-state emission
    maps char -> log-probability.  An empty model (all zeros, no emissions)
    behaves like a model that knows none of the characters: every non-ASCII
    character becomes a word of its own."""
    start: list = field(default_factory=lambda: [0.0] * 4)
    trans: list = field(default_factory=lambda: [[0.0] * 4 for _ in range(4)])
    emit: list = field(default_factory=lambda: [{} for _ in range(4)])


def load_hmm_model(spark: SparkSession, path: str) -> HmmModel:
    """Read a model file: blank and ``#`` lines skipped; one start line, four
    transition lines, four emission lines ``char:prob,char:prob,...``.

    The file is bounded by the alphabet (four maps over the characters), so
    its nine lines come to the driver and ship with the tasks.
    """
    lines = (spark.read.text(path).withColumn("_i", F.monotonically_increasing_id())
             .select(F.trim("value").alias("v"), "_i")
             .where((F.col("v") != "") & ~F.col("v").startswith("#"))
             .orderBy("_i").limit(9).collect())
    vals = [r["v"] for r in lines]
    if len(vals) != 9:
        raise ValueError("HMM model needs 1 start, 4 transition and 4 emission lines")
    start = [float(x) for x in split_fields_py(vals[0], " ")]
    trans = [[float(x) for x in split_fields_py(vals[1 + i], " ")] for i in range(4)]
    if len(start) != 4 or any(len(r) != 4 for r in trans):
        raise ValueError("HMM start/transition lines need 4 values")
    emit = []
    for i in range(4):
        m = {}
        for item in split_fields_py(vals[5 + i], ","):
            kv = split_fields_py(item, ":")
            if len(kv) != 2 or len(kv[0]) != 1:
                raise ValueError("bad emission entry: %r" % item)
            m[kv[0]] = float(kv[1])
        emit.append(m)
    return HmmModel(start, trans, emit)


# --------------------------------------------------------------- per piece

_WORD_OF_STATES = re.compile("[BM]*[ES]")


def viterbi_cut(chars: str, model: HmmModel) -> list[str]:
    """Best state sequence of a run of characters in the max-plus algebra:
    ``score <- max over rows of (score + transition) + emission``.  Sums never
    fall below ``MIN_DOUBLE``; a state reached by no better sum counts as
    coming from ``E``.  Words are the label groups ``[BM]*[ES]``."""
    if not chars:
        return []
    emission = np.array([[e.get(c, MIN_DOUBLE) for e in model.emit] for c in chars])
    step = np.array(model.trans)
    score, came = np.array(model.start) + emission[0], []
    for at in emission[1:]:
        sums = score[:, None] + step + at
        score = np.maximum(sums.max(axis=0), MIN_DOUBLE)
        came.append(np.where(score > MIN_DOUBLE, sums.argmax(axis=0), E))
    path = [max((E, S), key=score.__getitem__)]
    for back in reversed(came):
        path.append(int(back[path[-1]]))
    labels = "".join({E: "E", S: "S"}.get(state, "M") for state in reversed(path))
    return [chars[m.start():m.end()] for m in _WORD_OF_STATES.finditer(labels)]


_LATIN_RUNS = re.compile(LATIN_TOKEN_RE)
_MODEL_RUNS = re.compile(r"[^\x00-\x7F]+|" + LATIN_TOKEN_RE)


def hmm_cut(s: str, model: HmmModel) -> list[str]:
    """ASCII by the letter / number rules, other runs by Viterbi.

    A model without emissions prices every character at ``MIN_DOUBLE`` in
    every state, so no transition ever beats the initial value, the path
    stays at ``E`` and each non-ASCII character is a word of its own: the
    cut is then exactly the letter-run / number-run / single-character regex.
    """
    if not any(model.emit):
        return _LATIN_RUNS.findall(s)
    return [w for run in _MODEL_RUNS.findall(s)
            for w in ([run] if run.isascii() else viterbi_cut(run, model))]


def mp_cut(piece: str, edges: dict, min_weight: float) -> list[str]:
    """Max-probability path over the candidate graph of one piece.

    ``edges`` maps start -> list of (end, weight) for lexicon words, sorted
    by end.  Right to left; the shortest candidate wins ties; a position
    without a one-character word gets a one-character edge weighted
    ``min_weight``.  Scores within ``TIE_EPS`` of the best count as ties:
    equal sums of logarithms (common with small integer frequencies) then
    resolve the same way whatever the last bit of ``ln`` an engine returns.
    The best score is carried on, so that small gaps do not add up.
    """
    n = len(piece)
    best = [0.0] * (n + 1)
    choice = list(range(n))
    get = edges.get
    for i in range(n - 1, -1, -1):
        cands = get(i)
        unknown = best[i + 1] + min_weight
        if cands is None:
            best[i] = unknown
            continue
        own_single = cands[0][0] == i
        top = MIN_DOUBLE if own_single else unknown
        for end, w in cands:
            v = best[end + 1] + w
            if v > top:
                top = v
        if top <= MIN_DOUBLE:
            best[i] = MIN_DOUBLE
            continue
        lim = top - TIE_EPS
        if not own_single and unknown >= lim:
            best[i] = top
            continue
        for end, w in cands:
            v = best[end + 1] + w
            if v >= lim:
                best[i] = top
                choice[i] = end
                break
    out, i = [], 0
    while i < n:
        j = choice[i]
        out.append(piece[i:j + 1])
        i = j + 1
    return out


def mix_cut(piece: str, edges: dict, min_weight: float, user_singles: frozenset,
            model: HmmModel) -> list[str]:
    """Max-probability cut; runs of one-character results that are not
    one-character user words are re-cut by the HMM."""
    def open_single(word):
        return len(word) == 1 and word not in user_singles

    return [w for single, group in itertools.groupby(mp_cut(piece, edges, min_weight), open_single)
            for w in (hmm_cut("".join(group), model) if single else group)]


# --------------------------------------------------------------- lexicon in the task

LEXICON_LIMIT = 16 << 20   # bytes of words and weights that travel to the tasks as a dictionary
CACHED_PIECE = 64          # characters of a piece that is kept
CACHE = 60_000             # pieces of a generation; two are kept
PARTITION_BYTES = 16 << 20  # text of a task

MODES = ("mp", "hmm", "mix", "full", "search")


@dataclass
class Cutter:
    """All that a task needs to cut pieces, and the pieces it has cut."""
    words: dict
    min_weight: float
    singles: frozenset
    model: HmmModel
    cap: int
    short: dict = field(default_factory=dict)
    long: dict = field(default_factory=dict)
    known: dict = field(default_factory=dict)
    older: dict = field(default_factory=dict)

    def __post_init__(self):
        # lengths of the words by their first two characters, of longer words by their
        # first four: few places need a look-up
        for w in self.words:
            if 1 < len(w) <= self.cap:
                known, head = (self.short, w[:2]) if len(w) < 4 else (self.long, w[:4])
                known.setdefault(head, set()).add(len(w))
        for known in (self.short, self.long):
            known.update((head, sorted(sizes)) for head, sizes in known.items())

    def graph(self, piece: str) -> dict:
        """start -> [(end, weight)] of the lexicon words in the piece."""
        words, short, long, out = self.words, self.short, self.long, {}
        for i, c in enumerate(piece):
            found = [(i, words[c])] if c in words else []
            for size in (*short.get(piece[i:i + 2], ()), *long.get(piece[i:i + 4], ())):
                w = piece[i:i + size]
                if len(w) == size and w in words:
                    found.append((i + size - 1, words[w]))
            if found:
                out[i] = found
        return out

    def tiled(self, piece: str, mode: str) -> list[str]:
        """Tokens of a cut that tiles the piece."""
        if mode == "hmm":
            return hmm_cut(piece, self.model)
        g = self.graph(piece)
        if mode == "mp":
            return mp_cut(piece, g, self.min_weight) if g else list(piece)
        return mix_cut(piece, g, self.min_weight, self.singles, self.model) if g else hmm_cut(piece, self.model)

    def cut(self, piece: str, mode: str) -> tuple[list[str], list[int]]:
        """Tokens and their starts in the piece."""
        if mode == "full":
            return self.full(piece)
        words = self.tiled(piece, "mix" if mode == "search" else mode)
        starts = list(itertools.accumulate(map(len, words), initial=0))[:-1]
        if mode != "search":
            return words, starts
        out, at = [], []
        for w, s in zip(words, starts):
            for size in (2, 3):  # lexicon 2-grams of longer tokens, then 3-grams, then the token
                if len(w) > size:
                    hits = [i for i in range(len(w) - size + 1) if w[i:i + size] in self.words]
                    out += [w[i:i + size] for i in hits]
                    at += [s + i for i in hits]
            out.append(w)
            at.append(s)
        return out, at

    def full(self, piece: str) -> tuple[list[str], list[int]]:
        """Every lexicon word of two or more characters; a character by itself where
        none starts and no earlier word reaches."""
        g, out, at, cover = self.graph(piece), [], [], 0
        for i in range(len(piece)):
            here = g.get(i, ())
            longer = [e for e, _ in here if e > i]
            for e in longer or ([i] if cover <= i else []):
                out.append(piece[i:e + 1])
                at.append(i)
            cover = max([cover, *(e + 1 for e, _ in here)])
        return out, at

    def piece(self, piece: str, mode: str) -> tuple:
        """(tokens, starts, byte starts, characters, bytes), kept for short pieces."""
        found = self.known.get(piece)
        if found is not None:
            return found
        found = self.older.get(piece)
        if found is None:
            words, starts = self.cut(piece, mode)
            if piece.isascii():
                places, size = starts, len(piece)
            else:
                width = list(itertools.accumulate((len(c.encode()) for c in piece), initial=0))
                places, size = [width[s] for s in starts], width[-1]
            found = (words, starts, places, len(piece), size)
        if len(piece) <= CACHED_PIECE:
            if len(self.known) >= CACHE:  # pieces not met since are dropped
                self.older, self.known = self.known, {}
            self.known[piece] = found
        return found


def _ready(lex: DataFrame | None, base: DataFrame | None, mode: str, times: int = 1) -> tuple:
    """(active lexicon or None, smallest weight of the static lexicon, one-character
    user words, whether the lexicon may travel, in a form that takes a ``times``-th of a
    dictionary's memory)."""
    if mode == "hmm" or lex is None:
        return None, 0.0, frozenset(), True
    weighted = materialize(lex if "weight" in lex.columns else LX.with_weights(lex), "segment_lexicon")
    if base is not None:
        base_w = base if "weight" in base.columns else LX.with_weights(base)
    elif "is_user" in weighted.columns:
        base_w = weighted.where(~F.col("is_user"))
    else:
        base_w = weighted
    least = base_w.select(F.min("weight")).first()[0]
    singles = frozenset()
    if "is_user" in weighted.columns:
        singles = frozenset(r[0] for r in weighted.where(
            F.col("is_user") & (F.char_length("word") == 1)).select("word").collect())
    act = materialize(LX.active(weighted), "segment_active")
    size = act.agg(F.sum(F.octet_length("word") + 16)).first()[0] or 0
    return act, float(least or 0.0), singles, size <= LEXICON_LIMIT * times


def _words(act: DataFrame | None) -> dict:
    return {} if act is None else {r[0]: r[1] for r in act.select("word", "weight").toLocalIterator() if r[0]}


def _broadcast(spark: SparkSession, act: DataFrame | None, least: float, singles: frozenset, model: HmmModel, cap: int):
    return spark.sparkContext.broadcast(Cutter(_words(act), least, singles, model, max(1, int(cap))))


@dataclass
class Cuts:
    """All that a task needs to cut the distinct pieces of a batch together."""
    trie: LT.Trie
    least: float
    singles: np.ndarray
    model: HmmModel
    cap: int
    runs: dict = field(default_factory=dict)

    def viterbi(self, run: str) -> list[str]:
        found = self.runs.get(run)
        if found is None:
            found = viterbi_cut(run, self.model)
            if len(run) <= CACHED_PIECE:
                if len(self.runs) >= LT.RUNS:
                    self.runs.clear()
                self.runs[run] = found
        return found

    def hmm(self, s: str) -> list[str]:
        """``hmm_cut``; runs that come again are not cut again."""
        if s.isascii() or not any(self.model.emit):
            return _LATIN_RUNS.findall(s)
        return [w for run in _MODEL_RUNS.findall(s) for w in ([run] if run.isascii() else self.viterbi(run))]

    def begins(self, pieces: LT.Pieces, mode: str) -> np.ndarray:
        """Where the tokens of a cut that tiles the pieces begin."""
        if mode not in pieces.cuts:
            if mode == "hmm":
                found = pieces.by_hmm(self.hmm)
            elif mode == "mp":
                found = pieces.best_path(self.least, MIN_DOUBLE, TIE_EPS, lambda p, edges: mp_cut(p, edges, self.least))
            else:
                found = pieces.mixed(self.begins(pieces, "mp").copy(), self.singles, self.hmm)
            pieces.cuts[mode] = found
        return pieces.cuts[mode]

    def tokens(self, pieces: LT.Pieces, mode: str) -> tuple[np.ndarray, np.ndarray]:
        """(first character, characters) of the tokens, by piece and in the order of the cut."""
        if mode == "full":
            return pieces.full()
        if mode == "search":
            return pieces.search(self.begins(pieces, "mix"))
        return pieces.tiles(self.begins(pieces, mode))

    def tables(self, names: list[str], modes) -> list[LT.Table]:
        """The tokens of the distinct pieces, by mode."""
        parts: list = [[] for _ in modes]
        for some in LT.blocks(names):
            pieces = LT.Pieces(some, self.trie, self.cap)
            for own, mode in zip(parts, modes):
                own.append(LT.Table.one(pieces, *self.tokens(pieces, mode)))
        return [LT.Table.of(own) for own in parts]


def _cuts(spark: SparkSession, act: DataFrame | None, least: float, singles: frozenset, model: HmmModel, cap: int):
    words = _words(act)
    alone = np.array(sorted(map(ord, singles)), np.int64)
    return spark.sparkContext.broadcast(Cuts(LT.Trie(list(words), list(words.values())), least, alone, model, max(1, int(cap))))


def _tokens_schema(offsets: bool, packed: bool = False) -> tuple[str, pa.Schema]:
    names = ["offset", "unicode_offset", "unicode_length"] if offsets else []
    if packed:
        ddl = "doc_id long, word array<string>" + "".join(f", {c} array<long>" for c in names)
        return ddl, pa.schema([("doc_id", pa.int64()), ("word", pa.list_(pa.string()))]
                              + [(c, pa.list_(pa.int64())) for c in names])
    ddl = "doc_id long, pos long, word string" + "".join(f", {c} long" for c in names)
    return ddl, pa.schema([("doc_id", pa.int64()), ("pos", pa.int64()), ("word", pa.string())]
                          + [(c, pa.int64()) for c in names])


def _cut_batches(shared, mode: str, separators: str, offsets: bool, packed: bool):
    schema = _tokens_schema(offsets, packed)[1]

    def fn(batches):
        for batch in batches:
            for first, rows, texts in LT.chunks(batch):
                ids, split = batch.column("doc_id").slice(first, rows), LT.Split(texts, separators)
                for at in split.tokens(shared.value.tables(split.names, [mode])[0], offsets):
                    own, cols = ids.slice(at.first, at.rows), [at.words, *(map(pa.array, at.places()) if offsets else ())]
                    if packed:
                        ends = pa.array(at.ends, pa.int32())
                        yield pa.RecordBatch.from_arrays([own, *(pa.ListArray.from_arrays(ends, c) for c in cols)], schema=schema)
                        continue
                    row = np.repeat(np.arange(at.rows), np.diff(at.ends))
                    cols = [own.take(pa.array(row)), pa.array(np.arange(len(row)) - at.ends[row]), *cols]
                    yield from LT.slices(pa.RecordBatch.from_arrays(cols, schema=schema))
    return fn


_DIGEST = "mode string, doc_id long, n_tokens long, places_md5 string"


def _digest_batches(shared, modes, separators: str):
    schema = pa.schema([("mode", pa.string()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("places_md5", pa.string())])

    def fn(batches):
        for batch in batches:
            for first, rows, texts in LT.chunks(batch):
                ids, split = batch.column("doc_id").slice(first, rows), LT.Split(texts, separators)
                for mode, table in zip(modes, shared.value.tables(split.names, modes)):
                    for at in split.tokens(table, True):
                        place = pc.binary_join_element_wise(at.words, *(pa.array(x).cast(pa.string()) for x in at.places()), ":")
                        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at.ends, pa.int32()), place), ",")
                        n = np.diff(at.ends)
                        has = np.flatnonzero(n)
                        md5 = [hashlib.md5(x.as_buffer()).hexdigest() for x in joined.take(pa.array(has))]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([mode] * len(has), pa.string()), ids.take(pa.array(has + at.first)), pa.array(n[has]), pa.array(md5, pa.string())],
                            schema=schema)
    return fn


# --------------------------------------------------------------- lexicon by joins

def _piece_batches(mode: str, min_weight: float, singles: frozenset, model: HmmModel):
    """(piece, words, starts) from pieces with their packed candidate words."""
    schema = pa.schema([("piece", pa.string()), ("words", pa.list_(pa.string())), ("starts", pa.list_(pa.int32()))])

    def fn(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                b = batch.slice(k, 256).to_pydict()
                words, starts = [], []
                for piece, st, en, wt, ws in zip(b["piece"], b["st"], b["en"], b["w"], b["ws"]):
                    own = {x: y for x, y in zip(ws or (), wt or ())}
                    cutter = Cutter(own, min_weight, singles, model, 1)
                    g: dict = {}
                    for s, e, w in sorted(zip(st or (), en or (), wt or ())):
                        g.setdefault(s, []).append((e, w))
                    cutter.graph = lambda _, g=g: g
                    w, s = cutter.cut(piece, mode)
                    words.append(w)
                    starts.append(s)
                yield pa.RecordBatch.from_pydict({"piece": b["piece"], "words": words, "starts": starts}, schema=schema)
    return fn


def piece_words(pieces: DataFrame, lex: DataFrame | None, mode: str = "mix", model: HmmModel | None = None,
                max_word_len: int = LX.MAX_WORD_LENGTH, base: DataFrame | None = None) -> DataFrame:
    """(piece, words, starts): the distinct ``pieces`` (piece), each cut once."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    model = model or HmmModel()
    act, least, singles, travels = _ready(lex, base, mode)
    if travels:
        shared = _broadcast(pieces.sparkSession, act, least, singles, model, max_word_len)

        def fn(batches):
            cutter = shared.value
            for batch in batches:
                cuts = [cutter.cut(p, mode) for p in batch.column("piece").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("piece"), pa.array([c[0] for c in cuts], pa.list_(pa.string())),
                     pa.array([c[1] for c in cuts], pa.list_(pa.int32()))], names=["piece", "words", "starts"])
        return pieces.select("piece").mapInArrow(fn, "piece string, words array<string>, starts array<int>")
    own = materialize(pieces.select("piece", F.monotonically_increasing_id().alias("doc_id"), F.lit(0).alias("piece_pos")), "pieces")
    packed = (LX.dag_edges(own, act, max_word_len).where(F.col("word").isNotNull()).groupBy("doc_id")
              .agg(F.collect_list(F.col("start").cast("int")).alias("st"), F.collect_list(F.col("end").cast("int")).alias("en"),
                   F.collect_list("weight").alias("w"), F.collect_list("word").alias("ws")))
    return own.join(packed, "doc_id", "left").select("piece", "st", "en", "w", "ws").mapInArrow(
        _piece_batches(mode, least, singles, model), "piece string, words array<string>, starts array<int>")


# --------------------------------------------------------------- Spark job

def evenly(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows dealt to partitions of ``PARTITION_BYTES`` of text: a file may be one row group,
    which is one task whatever splits it has."""
    return docs.repartition(text_partitions(docs, text_col, PARTITION_BYTES))


def _sources(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(doc_id, text); text that is not valid UTF-8 yields no tokens."""
    return evenly(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
                  .where(F.call_function("is_valid_utf8", F.col("text"))))


def digests(docs: DataFrame, lex: DataFrame | None, modes=MODES, model: HmmModel | None = None,
            base: DataFrame | None = None, separators: str = DEFAULT_SEPARATORS) -> DataFrame:
    """(mode, doc_id, n_tokens, places_md5): for each of ``modes`` and each row of ``docs`` that has
    tokens their number and the MD5 of their ``word:offset:unicode_offset:unicode_length``, joined
    by commas.  The rows are read and split once for all cuts."""
    model = model or HmmModel()
    act, least, singles, travels = _ready(lex, base, "mix", LT.TIMES)
    if travels:
        shared = _cuts(docs.sparkSession, act, least, singles, model, LX.MAX_WORD_LENGTH)
        return _sources(docs, "text", "doc_id").mapInArrow(_digest_batches(shared, modes, separators), _DIGEST)
    names = ["word", "offset", "unicode_offset", "unicode_length"]
    joined = F.array_join(F.transform(F.arrays_zip(*names), lambda t: F.concat_ws(":", *[t[c] for c in names])), ",")
    return reduce(DataFrame.unionByName, [
        segment(docs, lex, m, model, base=base, separators=separators, offsets=True, packed=True)
        .select(F.lit(m).alias("mode"), "doc_id", F.size("word").cast("long").alias("n_tokens"), F.md5(joined).alias("places_md5"))
        for m in modes])


def segment(docs: DataFrame, lex: DataFrame | None, mode: str = "mix", model: HmmModel | None = None,
            max_word_len: int = LX.MAX_WORD_LENGTH, text_col: str = "text", id_col: str = "doc_id",
            base: DataFrame | None = None, separators: str = DEFAULT_SEPARATORS, offsets: bool = False,
            packed: bool = False) -> DataFrame:
    """(doc_id, pos, word) for ``mode`` in ``MODES``; with ``offsets`` also (offset,
    unicode_offset, unicode_length): where the token starts, in bytes and in
    code points, and its code points.  ``packed``: one row a row of ``docs`` that has
    tokens, with arrays in the order of ``pos`` in place of the token columns.

    ``lex`` is the active lexicon (word, freq | weight, tag[, is_user]);
    ``base`` the static lexicon whose minimum weight prices unknown
    characters (defaults to the non-user rows of ``lex``).  ``max_word_len``
    caps candidate words (0 -> single characters).  Tokens of the full and the
    search cut overlap; ``pos`` numbers them in the order of the cut.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    model = model or HmmModel()
    src = _sources(docs, text_col, id_col)
    act, least, singles, travels = _ready(lex, base, mode, LT.TIMES)
    if travels:
        shared = _cuts(docs.sparkSession, act, least, singles, model, max_word_len)
        cut = src.mapInArrow(_cut_batches(shared, mode, separators, offsets, packed), _tokens_schema(offsets, packed)[0])
        return cut.where(F.size("word") > 0) if packed else cut
    # repeated and null ids are kept apart by a row number
    rows = materialize(src.withColumn("row", F.monotonically_increasing_id()), "segment_rows")
    split = materialize(presplit(rows, "text", "row", separators), "segment_pieces").select(
        F.col("doc_id").alias("row"), F.col("pos").alias("piece_pos"), "piece")
    cuts = materialize(piece_words(split.select("piece").distinct(), lex, mode, model, max_word_len, base), "piece_words")
    w = Window.partitionBy("row").orderBy("piece_pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = split.join(cuts, "piece").withColumns({
        "before": F.coalesce(F.sum(F.size("words")).over(w), F.lit(0)),
        "byte": F.coalesce(F.sum(F.octet_length("piece")).over(w), F.lit(0)),
        "char": F.coalesce(F.sum(F.char_length("piece")).over(w), F.lit(0))})
    out = placed.select("row", "before", "byte", "char", "piece", "starts", F.posexplode("words").alias("k", "word"))
    start = F.get("starts", F.col("k"))
    more = [(F.col("byte") + F.octet_length(F.call_function("substring", F.col("piece"), F.lit(1), start))).alias("offset"),
            (F.col("char") + start).cast("long").alias("unicode_offset"),
            F.char_length("word").cast("long").alias("unicode_length")] if offsets else []
    tokens = out.select("row", (F.col("before") + F.col("k")).alias("pos"), "word", *more)
    if packed:
        names = [c for c in tokens.columns if c not in ("row", "pos")]
        tokens = tokens.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", *names))).alias("t")) \
            .select("row", *[F.col(f"t.{c}").alias(c) for c in names])
    return rows.select("row", "doc_id").join(tokens, "row").drop("row")
