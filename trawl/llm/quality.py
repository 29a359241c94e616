"""Quality rules: base counts and n-gram perplexity bands per language.

The model is an interpolated modified Kneser-Ney model of character 5-grams
over whole code points, one for each language and half of the documents (by a
hash of the text, so equal texts share a half).  A document is scored by the
model of the other half: its own n-grams do not make it look likely.  Spark
counts: n-gram counts, continuation counts, counts of counts, back-off weights
and probabilities are aggregations and joins, and the result is one table with
the two log-probabilities of every n-gram of the corpus.

An n-gram is two longs of 21 bits a character, so contexts and suffixes are
shifts and masks.  To score, log-probabilities lie in arrays sorted by a 64-bit
hash, found by the hash's leading bits.  While the table has at most MODEL_ROWS
rows (counted), the arrays travel to the tasks and documents are scored where
they are read.  Beyond, documents are packed into chunks of CHUNK characters, a
chunk asks for the rows of its distinct n-grams by a join, and is scored with an
array of just these.

Perplexity is per word character, so that scripts with long runs between blanks
are not apart.  Quartiles over the documents that pass the base rules give the band
of a language, ``[Q1 - LOW * IQR, Q3 + HIGH * IQR]``; outside it, a document is
rejected.  Quartiles of ``n`` documents are uncertain, so both widths grow by
``sqrt(1 + FEW / n)``; a language with fewer than FEW such documents has no band.

Null or empty text: no words, all counts 0, no perplexity, base_failed.
Null lang: the language "".  Null or repeated ids: each row by itself.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import hot_join, mix, rolling
from trawl.session import bounded_broadcast, materialize, scratch_path

LOW, HIGH = 6.0, 8.0  # chosen on the labelled documents of sf0.1 with an even doc_id
FEW = 30
MIN_WORDS = 50
BIN = 1000  # histogram bins per nat
LEAST_IQR = 20  # bins

ORDER = 5
LEAST_DISCOUNT = 0.1  # so that an n-gram not seen after a known context has a probability
MODEL_ROWS = 1 << 23  # rows of 16 bytes that travel to the tasks
CHUNK = 1 << 23  # characters
MOST_BUCKETS = 50_000
PART = 1 << 18  # characters handled at a time
COUNTED = 1 << 25  # characters that a task counts at least
HELD = 1 << 22  # distinct n-grams that a task holds before it sends them on
BITS = 12  # of a character's number in a packed n-gram, which has 60 bits
WIDE = 21  # bits of a code point in a pair of longs
PAD = 0x10FFFF  # stands before a text; not a character
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)

SYMBOLS = "#*$%&|<>"


def base_counts(text: str) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.split()]
    repeat = 0
    if n >= 3:
        w = rolling(np.fromiter(map(hash, words), np.int64, n).view(np.uint64), 3)
        s = np.sort(w)
        again = s[1:][s[1:] == s[:-1]]
        if len(again):
            twice = np.flatnonzero(np.isin(w, again))
            cover = np.zeros(n, bool)
            for i in range(3):
                cover[twice + i] = True
            repeat = int(cover.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeat


def padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another, ORDER - 1 PADs before each, and
    the text (or -1) that an n-gram belongs to, by its last place from ORDER - 1 on."""
    pad = np.full(ORDER - 1, PAD, "<u4")
    cps = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    flat = np.concatenate([x for c in cps for x in (pad, c)]).astype(np.int64)
    sizes = np.array([len(c) + ORDER - 1 for c in cps])
    own = np.repeat(np.arange(len(cps)), sizes)
    own[((np.cumsum(sizes) - sizes)[:, None] + np.arange(ORDER - 1)).ravel()] = -1
    return flat, own[ORDER - 1:]


def pairs(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each place from ORDER - 1 on, as two longs."""
    two = flat[:-1] << WIDE | flat[1:]
    return two[:-3], flat[2:-2] << 2 * WIDE | two[3:]


def gram_hash(lang: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a.astype(np.uint64) * _A + b.astype(np.uint64) * _B + lang.astype(np.uint64))


class Alphabet:
    """Numbers for the code points seen by a task, below 2^BITS."""

    def __init__(self):
        self.ids = np.full(PAD + 1, -1, np.int16)
        self.cps = np.zeros(0, np.int64)

    def add(self, cps: np.ndarray) -> bool:
        """Numbers new code points, if all of them find room."""
        new = np.unique(cps[self.ids[cps] < 0])
        if len(self.cps) + len(new) > 1 << BITS:
            return False
        self.ids[new] = np.arange(len(self.cps), len(self.cps) + len(new))
        self.cps = np.concatenate([self.cps, new])
        return True

    def packed(self, flat: np.ndarray) -> np.ndarray:
        """The n-gram that ends at each place from ORDER - 1 on."""
        ids = self.ids[flat].astype(np.int64)
        n = len(ids) - ORDER + 1
        out = ids[:n].copy()
        for i in range(1, ORDER):
            out <<= BITS
            out |= ids[i:n + i]
        return out

    def unpacked(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two longs of packed n-grams."""
        c = [self.cps[keys >> BITS * (ORDER - 1 - i) & (1 << BITS) - 1] for i in range(ORDER)]
        return c[0] << WIDE | c[1], c[2] << 2 * WIDE | c[3] << WIDE | c[4]


class Tally:
    """n-gram counts by a key (language, half); rows go to ``out`` when there are many."""

    def __init__(self):
        self.alphabet, self.found, self.held, self.out = Alphabet(), defaultdict(list), 0, []

    def add(self, key: tuple, flat: np.ndarray, own: np.ndarray) -> None:
        if not self.alphabet.add(flat):
            self.flush()
            self.alphabet = Alphabet()
            if not self.alphabet.add(flat):  # more code points than have numbers
                half = len(own) // 2
                self.add(key, flat[:half + ORDER - 1], own[:half])
                self.add(key, flat[half:], own[half:])
                return
        keys = np.sort(self.alphabet.packed(flat)[own >= 0])
        if not len(keys):
            return
        self.found[key].append(self.counted(keys, np.ones(len(keys), np.int64)))
        self.held += len(self.found[key][-1][0])
        if len(self.found[key]) >= 16:
            self.merge(key)
        if self.held > HELD:
            self.flush()

    @staticmethod
    def counted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(n, first)

    def merge(self, key: tuple) -> None:
        keys, n = map(np.concatenate, zip(*self.found[key]))
        order = np.argsort(keys)
        self.found[key] = [self.counted(keys[order], n[order])]
        self.held += len(self.found[key][0][0]) - len(keys)

    def flush(self) -> None:
        for key in self.found:
            self.merge(key)
            keys, n = self.found[key][0]
            self.out.append((key, *self.alphabet.unpacked(keys), n))
        self.found.clear()
        self.held = 0


def by_half(batch: dict) -> dict[tuple, list[int]]:
    """Rows with text by (language, half)."""
    out = defaultdict(list)
    for i, (lang, half, t) in enumerate(zip(batch["lang"], batch["half"], batch["text"])):
        if t:
            out[lang, half].append(i)
    return out


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about PART characters, one row at least."""
    sizes = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:at + 4096]), PART, "right")))
        yield batch.slice(at, n)
        at += n


GRAMS = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()),
                   ("n0", pa.int64()), ("n1", pa.int64())])


def tally_rows(tally: Tally, chunk: int) -> Iterator[pa.RecordBatch]:
    for (lang, half), a, b, n in tally.out:
        none = np.zeros(len(n), np.int64)
        for k in range(0, len(n), 50_000):
            s = slice(k, k + 50_000)
            m = len(n[s])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, chunk)), pa.array([lang] * m, pa.string()), pa.array(a[s]), pa.array(b[s]),
                 pa.array((none if half else n)[s]), pa.array((n if half else none)[s])], schema=GRAMS)
    tally.out.clear()


def add_texts(tally: Tally, batch: dict) -> None:
    for key, rows in by_half(batch).items():
        tally.add(key, *padded([batch["text"][i] for i in rows]))


_GRAM_DDL = "chunk long, lang string, a long, b long, n0 long, n1 long"


def counted(rows: DataFrame) -> DataFrame:
    """(lang, a, b, n0, n1): n-gram counts of tasks, by half.  Small input partitions
    are read together, as most n-grams of a task are there in the next one too."""
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-chars // COUNTED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for part in slices(batch):
                add_texts(tally, part.to_pydict())
                yield from tally_rows(tally, 0)
        tally.flush()
        yield from tally_rows(tally, 0)

    return rows.select("lang", "half", "text").coalesce(tasks).mapInArrow(run, _GRAM_DDL).drop("chunk")


# suffix (k - 1 characters) and context of an n-gram of k characters
_SUFFIX = {5: (f"a & {(1 << WIDE) - 1}", "b"), 4: ("0L", "b"), 3: ("0L", f"b & {(1 << 2 * WIDE) - 1}"),
           2: ("0L", f"b & {(1 << WIDE) - 1}")}
_BEFORE = ("a", f"shiftright(b, {WIDE})")


def discounts(level: DataFrame) -> DataFrame:
    """(lang, d1_0, d2_0, d3_0, d1_1, ...): modified Kneser-Ney discounts by half."""
    seen = level.groupBy("lang").agg(*[F.count_if(F.col(f"n{h}") == i).cast("double").alias(f"c{i}_{h}")
                                       for h in (0, 1) for i in (1, 2, 3, 4)])
    cells = []
    for h in (0, 1):
        y = f"c1_{h} / nullif(c1_{h} + 2 * c2_{h}, 0)"
        whole = " AND ".join(f"c{i}_{h} > 0" for i in (1, 2, 3, 4))
        cells += [f"CASE WHEN {whole} THEN greatest({LEAST_DISCOUNT}D, least({i}D, {i} - {i + 1} * {y} * c{i + 1}_{h} / nullif(c{i}_{h}, 0))) "
                  f"ELSE {e}D END AS d{i}_{h}" for i, e in ((1, 0.5), (2, 0.75), (3, 0.9))]
    return seen.selectExpr("lang", *cells)


def probabilities(grams: DataFrame) -> DataFrame:
    """(lang, a, b, p0, p1) of every n-gram of the corpus from counts (lang, a, b, n0,
    n1): its probability in the model of either half, seen there or not."""
    levels = {ORDER: materialize(grams.groupBy("lang", "a", "b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")),
                                 f"grams_{ORDER}")}
    for k in range(ORDER, 1, -1):  # how many n-grams of k characters end in one of k - 1
        a, b = _SUFFIX[k]
        levels[k - 1] = materialize(levels[k].groupBy("lang", F.expr(a).alias("a"), F.expr(b).alias("b")).agg(
            F.count_if(F.col("n0") > 0).alias("n0"), F.count_if(F.col("n1") > 0).alias("n1")), f"grams_{k - 1}")
    size = materialize(levels[1].groupBy("lang").agg(
        *[F.sum(f"n{h}").alias(f"all{h}") for h in (0, 1)], *[F.count_if(F.col(f"n{h}") > 0).alias(f"size{h}") for h in (0, 1)]), "alphabets")
    langs, width = size.agg(F.count(F.lit(1)), F.max(F.octet_length("lang"))).first()
    width = 200 + (width or 0)
    # one more character stands for those that a half has not seen
    p = levels[1].join(bounded_broadcast(size, langs, width), "lang").selectExpr(
        "lang", "a", "b", *[f"(n{h} + 0.5D) / (all{h} + 0.5D * (size{h} + 1)) AS p{h}" for h in (0, 1)])
    for k in range(2, ORDER + 1):
        d = bounded_broadcast(materialize(discounts(levels[k]), f"discounts_{k}"), langs, width)
        # sums of few distinct values times counts, so that their order does not matter
        back = levels[k].groupBy("lang", *[F.expr(e).alias(c) for e, c in zip(_BEFORE, ("ca", "cb"))]).agg(
            *[F.sum(f"n{h}").alias(f"t{h}") for h in (0, 1)],
            *[F.count_if(F.expr(c.format(f"n{h}"))).alias(f"k{i}_{h}") for h in (0, 1)
              for i, c in ((1, "{} = 1"), (2, "{} = 2"), (3, "{} > 2"))])
        back = back.join(d, "lang").selectExpr("lang", "ca", "cb", "t0", "t1", *[
            f"(k1_{h} * d1_{h} + k2_{h} * d2_{h} + k3_{h} * d3_{h}) / nullif(t{h}, 0) AS back{h}" for h in (0, 1)])
        sa, sb = _SUFFIX[k]
        rows = levels[k].join(d, "lang").selectExpr(
            "lang", "a", "b", f"{_BEFORE[0]} AS ca", f"{_BEFORE[1]} AS cb", f"{sa} AS sa", f"{sb} AS sb",
            *[f"n{h} - CASE n{h} WHEN 0 THEN 0 WHEN 1 THEN d1_{h} WHEN 2 THEN d2_{h} ELSE d3_{h} END AS rest{h}" for h in (0, 1)])
        lower = p.withColumnsRenamed({"a": "sa", "b": "sb", "p0": "low0", "p1": "low1"})
        p = rows.join(back, ["lang", "ca", "cb"]).join(lower, ["lang", "sa", "sb"]).selectExpr("lang", "a", "b", *[
            f"CASE WHEN t{h} > 0 THEN rest{h} / t{h} + back{h} * low{h} ELSE low{h} END AS p{h}" for h in (0, 1)])
        if k < ORDER:  # one plan of all levels takes the driver hundreds of MB
            p = materialize(p, f"probabilities_{k}")
    return p


class Model:
    """Log-probabilities in arrays sorted by the n-gram's hash; ``starts`` has the first
    place of every leading bit pattern.  It is made where texts are scored: it is as
    large as the hashes, and the driver needs none."""

    def __init__(self, keys: np.ndarray, log_p0: np.ndarray, log_p1: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.log_p = keys[order], (log_p0[order], log_p1[order])
        self.shift = np.uint64(64 - max(1, int(len(keys)).bit_length()))

    @cached_property
    def starts(self) -> np.ndarray:
        lead = np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift
        return np.searchsorted(self.keys, lead).astype(np.int64)

    def __call__(self, lang_key: int, half: int, texts: list[str]) -> np.ndarray:
        """The sum of each text by the model of the other half."""
        flat, own = padded(texts)
        a, b = pairs(flat)
        keep = own >= 0
        key = gram_hash(np.int64(lang_key), a[keep], b[keep])
        at = self.starts[key >> self.shift]
        away = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != key)
        while len(away):
            at[away] += 1
            if at[away].max() >= len(self.keys):
                raise ValueError("the documents changed while they were read")
            away = away[self.keys[at[away]] != key[away]]
        return np.bincount(own[keep], self.log_p[1 - half][at], len(texts))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SCORE_DDL = ", ".join(f"{c} long" for c in COUNTS) + ", log_ppl double"
_SCORE_FIELDS = [(c, pa.int64()) for c in COUNTS] + [("log_ppl", pa.float64())]


def scores(batch: pa.RecordBatch, model: Model) -> list[pa.Array]:
    """Counts and log-perplexity a word character of rows (text, lang, lang_key, half);
    symbols count in the sum, not as characters, or else runs of them look likely."""
    b = {c: batch.column(c).to_pylist() for c in ("text", "lang", "lang_key", "half")}
    counts = list(zip(*[base_counts(t or "") for t in b["text"]])) or [()] * len(COUNTS)
    total = np.zeros(len(b["text"]))
    for (_, half), rows in by_half(b).items():
        total[rows] = model(b["lang_key"][rows[0]], half, [b["text"][i] for i in rows])
    ppl = [-t / max(1, c - s) if n else None for t, n, c, s in zip(total.tolist(), *counts[:3])]
    return [*[pa.array(c, pa.int64()) for c in counts], pa.array(ppl, pa.float64())]


def prepared(docs: DataFrame) -> DataFrame:
    """(lang, lang_key, half, text) of every document."""
    return docs.selectExpr("coalesce(CAST(lang AS STRING), '') AS lang", "text").selectExpr(
        "lang", "xxhash64(lang) AS lang_key", "CAST(pmod(xxhash64(text), 2) AS INT) AS half", "text")


def gram_keys(lang_key: pa.Array, a: pa.Array, b: pa.Array) -> np.ndarray:
    return gram_hash(lang_key.to_numpy(), a.to_numpy(), b.to_numpy())


def model_of(table: DataFrame) -> Model:
    """The sorted arrays of a table of at most MODEL_ROWS rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            key = gram_keys(x.column("lang_key"), x.column("a"), x.column("b")).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), x.column("l0"), x.column("l1")], names=["key", "l0", "l1"])

    t = table.mapInArrow(run, "key long, l0 float, l1 float").toArrow()
    return Model(t.column("key").to_numpy().view(np.uint64), t.column("l0").to_numpy(), t.column("l1").to_numpy())


def scored(docs: DataFrame, carry: list[str] | None = None, most: int = MODEL_ROWS) -> DataFrame:
    """``carry`` columns (doc_id unless given) and lang, counts, log_ppl of every row.
    ``most``: rows of the model up to which it travels to the tasks."""
    carry = ["doc_id"] if carry is None else carry
    log_p = probabilities(counted(prepared(docs))).selectExpr(
        "lang", "xxhash64(lang) AS lang_key", "a", "b", "CAST(ln(p0) AS FLOAT) AS l0", "CAST(ln(p1) AS FLOAT) AS l1")
    table = materialize(log_p, "model")
    own = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]  # clashing names stay apart
    rows = docs.select(*own, F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text").withColumns({
        "lang_key": F.xxhash64("lang"), "half": F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")})
    kept = [f"c{i}" for i in range(len(carry))]
    fields = [f for f in rows.schema.fields if f.name in kept]
    ddl = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in fields] + ["lang string", _SCORE_DDL])
    if table.count() <= most:
        shared = docs.sparkSession.sparkContext.broadcast(model_of(table.drop("lang")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                for x in slices(batch):
                    yield pa.RecordBatch.from_arrays([*[x.column(c) for c in kept], x.column("lang"), *scores(x, model)],
                                                     names=[*kept, "lang", *COUNTS, "log_ppl"])

        out = rows.mapInArrow(run, ddl)
    else:
        out = scored_by_chunks(rows, kept, table, ddl)
    out = materialize(out, "quality")
    return out.withColumnsRenamed(dict(zip(kept, carry)))


def packed(rows: DataFrame) -> tuple[DataFrame, int]:
    """(chunk, body): rows as compressed Arrow batches of PART characters or one
    document, and about how many chunks there are.  A task begins a new chunk
    after CHUNK characters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, room = TaskContext.get().partitionId() << 32, CHUNK
        for batch in batches:
            for x in slices(batch):
                size = pc.sum(pc.utf8_length(x.column("text"))).as_py() or 0
                if size > room and room < CHUNK:
                    chunk, room = chunk + 1, CHUNK
                room -= size
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, x.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(x)
                yield pa.RecordBatch.from_pydict({"chunk": [chunk], "body": [sink.getvalue().to_pybytes()]})

    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    return rows.mapInArrow(run, "chunk long, body binary"), max(1, -(-chars // CHUNK))


def bucketed(df: DataFrame, key: str, n: int) -> tuple[DataFrame, str]:
    """``df`` written in ``n`` buckets of ``key``, so that grouping by it moves no
    rows, and the table's name; the caller drops the table."""
    path = scratch_path(df.sparkSession, "buckets")
    name = "trawl_" + path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name), name


def unpacked(body: bytes) -> Iterator[pa.RecordBatch]:
    yield from pa.ipc.open_stream(body)


def scored_by_chunks(rows: DataFrame, kept: list[str], table: DataFrame, ddl: str) -> DataFrame:
    """Scores with a model that is too large for the tasks."""
    chunks, name = bucketed(*(lambda r, n: (r, "chunk", min(4 * n, MOST_BUCKETS)))(*packed(rows)))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, now = Tally(), None
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body")):
                if chunk != now:
                    tally.flush()
                    yield from tally_rows(tally, now or 0)
                    now = chunk
                for x in unpacked(body.as_py()):
                    add_texts(tally, {c: x.column(c).to_pylist() for c in ("lang", "half", "text")})
        tally.flush()
        yield from tally_rows(tally, now or 0)

    # parts of a chunk can be read by several tasks, or sent on before its end
    want = chunks.mapInArrow(asked, _GRAM_DDL).select("chunk", "lang", "a", "b").distinct()
    model = want.join(table, ["lang", "a", "b"]).select("chunk", "lang_key", "a", "b", "l0", "l1")

    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        t = right.combine_chunks()
        col = lambda c: t.column(c).combine_chunks()
        model = Model(gram_keys(col("lang_key"), col("a"), col("b")), col("l0").to_numpy(), col("l1").to_numpy()) if t.num_rows else None
        out = []
        for body in left.column("body"):
            for x in unpacked(body.as_py()):
                out.append(pa.Table.from_arrays([*[x.column(c) for c in kept], x.column("lang"), *scores(x, model)],
                                                names=[*kept, "lang", *COUNTS, "log_ppl"]))
        return pa.concat_tables(out)

    try:
        return materialize(chunks.groupBy("chunk").cogroup(model.groupBy("chunk")).applyInArrow(fn, ddl), "quality_chunks")
    finally:
        rows.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


BASE_FAILED = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words)"


def bands(scores: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(lang_, least, most) from exact quartiles of the binned log-perplexities of
    the documents that pass the base rules."""
    hist = scores.where(f"log_ppl IS NOT NULL AND NOT {BASE_FAILED}").groupBy(
        "lang", F.floor(F.col("log_ppl") * BIN).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("lang")
    run = hist.withColumn("upto", F.sum("n").over(w.orderBy("b"))).withColumn("all", F.sum("n").over(w))
    q = run.where(f"all >= {FEW}").groupBy("lang").agg(
        F.first("all").alias("n"),
        F.min(F.when(F.col("upto") * 4 >= F.col("all"), F.col("b"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("all") * 3, F.col("b"))).alias("q3"))
    width = F.greatest(F.col("q3") - F.col("q1"), F.lit(LEAST_IQR)) * F.sqrt(1 + FEW / F.col("n"))
    return q.select("lang", ((F.col("q1") - low * width) / BIN).alias("least"),
                    ((F.col("q3") + 1 + high * width) / BIN).alias("most"))


def judged(docs: DataFrame, carry: list[str] | None = None, low: float = LOW, high: float = HIGH) -> DataFrame:
    """``scored`` plus base_failed and kept."""
    s = scored(docs, carry)
    out = hot_join(s, bands(s, low, high), "lang", "log_ppl", "left")
    inside = F.coalesce(F.col("log_ppl").between(F.col("least"), F.col("most")), F.lit(True))
    return out.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & inside)


def verdicts(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Counts, base_failed, kept and log_ppl (nats a word character) of every document."""
    return judged(docs, None, low, high).select(
        F.col("doc_id").cast("long").alias("doc_id"), *COUNTS, "base_failed", "kept", "log_ppl")


def kept_rows(docs: DataFrame) -> DataFrame:
    """The documents that are kept, in the columns of ``docs``; their texts are written
    once beside the scores and filtered there."""
    marked = docs.select(F.struct(*docs.columns).alias("row"), "lang", "text")
    return judged(marked, ["row"]).where("kept").select("row.*")
