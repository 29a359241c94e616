"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct 5-word shingles.  Each of ``REGISTERS``
registers is the exponentially spaced minimum of the set's hashes, on a scale
that no set leaves; registers of two sets merge by maximum.  Equal sets are one
class.  Classes sharing a band of register values are candidates; the number of
equal and ordered registers gives a joint likelihood estimate that drops
hopeless pairs, and the rest are verified on the full sets.

A class also has ``BITS`` parities: each hash of its set flips one of them.  Those
of two sets differ in as many places as the parities of their symmetric
difference are odd, so hardly a pair below the limit looks like one above it.

In pivot rounds each class is compared with one class of another component that
is the pivot of most of its buckets, then components are merged.  The first pivots
are the classes with the fullest buckets (the middle of a group of near copies),
the next ones are drawn.  Where a bucket still holds several components, classes
of different components are compared by parities and a digest of two bits a
register, inside the join: only pairs that agree as much as linked sets do leave
it.  Large buckets are dealt out by a salt.

Null or empty text: empty set, linked with nothing.  Fewer words than a
shingle: the whole sequence is the one shingle.  Rows with a null doc_id are
returned with a null component, kept.  Repeated doc_ids count as one document
whose links are those of any of its texts; each row is returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import arrow_map, hot_join, mix, rolling, word_hashes
from trawl.session import materialize

SHINGLE = 5
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
BASE = 1.02
LOWEST = 160      # added to the levels: the largest minimum of one hash is at -158
NEED = 75         # percent of the union
FLOOR = 0.55      # estimated similarity under which a pair is not verified (0.75 is 5 sigma away)
APART = 48        # of the digests' registers; sets of similarity 0.75 differ in 24 on average, sigma 4.4
PIVOT_ROUNDS = 3  # at most
PIVOTS_PAY = 10   # pairs for a link, beyond which no pivots follow
BLOCK = 1000      # classes of a bucket that a task compares with others
BITS = 1024       # parities of a set
SIGMAS = 5        # above the mean of sets at the limit, beyond which their parities do not differ
_WORK = np.empty((REGISTERS, 1024), np.uint32)
_STEP = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)) | np.uint64(1)
_MULT = (mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)).astype(np.uint32)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    raws = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    words, starts = word_hashes(b"\n".join(raws))
    ends = np.cumsum([len(r) + 1 for r in raws])
    own = np.searchsorted(ends, starts, "right")
    borders = np.searchsorted(own, np.arange(len(raws) + 1))

    def windows(h: np.ndarray, k: int) -> np.ndarray:
        n = len(h) - k + 1
        out = h[:n] * _STEP[0]
        for i in range(1, k):
            out += h[i:n + i] * _STEP[i]
        return mix(out + np.uint64(k))

    every = windows(words, SHINGLE) if len(words) >= SHINGLE else words[:0]
    out = []
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
        if b - a >= SHINGLE:
            s = np.sort(every[a:b - SHINGLE + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(windows(words[a:b], b - a) if b > a else words[:0])
    return out


def registers(h: np.ndarray) -> np.ndarray:
    """Exponentially spaced minima of a non-empty set of hashes."""
    h = mix(h)  # the set is sorted by hash, its halves must not be
    lo, hi = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    low = np.full(REGISTERS, np.iinfo(np.uint32).max, np.uint32)
    step = _WORK.shape[1]
    for at in range(0, len(h), step):
        work = _WORK[:, :len(h[at:at + step])]
        np.multiply(lo[at:at + step], _MULT[:, None], out=work)
        work += hi[at:at + step]
        np.minimum(low, work.min(axis=1), out=low)
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0 ** 32)
    return (np.floor(1 - np.log(x) / np.log(BASE)) + LOWEST).astype(np.int16)


def parities(h: np.ndarray) -> bytes:
    """The parity of the number of hashes in each of ``BITS`` equal ranges."""
    return np.packbits(np.bincount(h >> np.uint64(64 - BITS.bit_length() + 1), minlength=BITS) & 1).tobytes()


def most_apart(n):
    """Parities in which linked sets of ``n`` hashes together differ at most (of a
    number, or as a Spark column): not in more than their symmetric difference
    has, nor in far more than the mean of that many flips."""
    m = F if isinstance(n, Column) else np
    d = n * ((100 - NEED) / (100 + NEED))
    q = m.exp(d * (-2 / BITS))
    mean, var = (1 - q) * (BITS / 2), (1 - q * q) * (BITS / 4) - q * q * d
    return (F.least if m is F else np.minimum)(d + 1e-9, mean + SIGMAS * m.sqrt(var + 1) + 1)


def digests(regs: np.ndarray) -> np.ndarray:
    """Two bits of every register, as four longs a row of registers."""
    two = (mix(regs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(3)).reshape(len(regs), 4, REGISTERS // 4)
    shifts = 2 * np.arange(REGISTERS // 4, dtype=np.uint64)
    return np.bitwise_or.reduce(two << shifts, axis=2).view(np.int64)


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key, regs, odd) of every document, written once."""
    def fn(b):
        out = {"doc_id": b["doc_id"], "n_shingles": [], "set_key": [], "regs": [], "odd": []}
        for s in shingle_sets(b["text"]):
            out["n_shingles"].append(len(s))
            out["set_key"].append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
            out["regs"].append(registers(s).tobytes() if len(s) else None)
            out["odd"].append(parities(s) if len(s) else None)
        return out

    return materialize(arrow_map(
        docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text"), fn,
        "doc_id long, n_shingles long, set_key binary, regs binary, odd binary",
        pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()),
                   ("regs", pa.binary()), ("odd", pa.binary())])), "sketches")


def banded(classes: DataFrame) -> DataFrame:
    """(bucket, id) of every class and band, written once."""
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                b = batch.slice(k, 512).to_pydict()
                keys, ids = [], []
                for i, r in zip(b["id"], b["regs"]):
                    step = 2 * ROWS
                    keys += [xxhash.xxh3_64_intdigest(r[j * step:j * step + step], seed=j) - (1 << 63)
                             for j in range(BANDS)]
                    ids += [i] * BANDS
                yield pa.RecordBatch.from_pydict({"bucket": keys, "id": ids},
                                                 schema=pa.schema([("bucket", pa.int64()), ("id", pa.int64())]))

    return classes.select("id", "regs").mapInArrow(run, "bucket long, id long")


def marks(classes: DataFrame) -> DataFrame:
    """(id, size, d0 ... d3, o0 ...): the classes' digests and parities."""
    names = [f"d{i}" for i in range(4)] + [f"o{i}" for i in range(BITS // 64)]

    def fn(b):
        d = digests(np.frombuffer(b"".join(b["regs"]), np.int16).reshape(-1, REGISTERS))
        both = np.hstack([d, np.frombuffer(b"".join(b["odd"]), np.int64).reshape(len(d), -1)])
        return {"id": b["id"], "size": b["n_shingles"], **{c: both[:, i] for i, c in enumerate(names)}}

    return arrow_map(classes.select("id", "n_shingles", "regs", "odd"), fn,
                     "id long, size long, " + ", ".join(f"{c} long" for c in names),
                     pa.schema([(c, pa.int64()) for c in ["id", "size", *names]]), 4096)


def similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint likelihood estimate of the Jaccard similarity of sets from their
    registers (a row each), given their sizes (maximum over a grid)."""
    a, b, na, nb = np.atleast_2d(a), np.atleast_2d(b), np.atleast_1d(na), np.atleast_1d(nb)
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    grid = np.linspace(0, 1, 41) * np.minimum(u / v, v / u)

    def p(x):  # chance of a register being larger in one set, by its share
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    more = np.clip(p(u - v * grid), 1e-9, 1)
    less = np.clip(p(v - u * grid), 1e-9, 1)
    same = np.clip(1 - more - less, 1e-9, 1)
    n1, n2 = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    score = n1 * np.log(more) + n2 * np.log(less) + (a.shape[1] - n1 - n2) * np.log(same)
    return grid[np.arange(len(grid)), np.argmax(score, axis=1)]


def of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is among ``ids``, and a hundredth of the others,
    without a shuffle of texts: by words of 64 bits, three set for an id, two bytes
    an id and 16 MB at most."""
    words = max(1, min(1 << 20, ids.count() // 4))
    h = F.xxhash64("doc_id")

    mask = F.expr(" | ".join(f"shiftleft(1L, CAST(shiftright(xxhash64(doc_id), {at}) & 63 AS INT))" for at in (40, 46, 52)))
    known = ids.select(F.pmod(h, F.lit(words)).alias("_word"), mask.alias("_bits")) \
        .groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    return docs.withColumn("_word", F.pmod(h, F.lit(words))).join(F.broadcast(known), "_word") \
        .where(mask.bitwiseAND(F.col("_bits")) == mask).select(docs.columns)


def full_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, set) of the classes, from one text of each; written once."""
    def fn(b):
        sets = shingle_sets(b["text"])
        return {"doc_id": b["doc_id"], "set_key": [hashlib.md5(x.tobytes()).digest() for x in sets],
                "set": [x.tobytes() for x in sets]}

    rows = of_ids(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").where("doc_id IS NOT NULL"),
                  classes.select("doc_id"))
    made = arrow_map(rows, fn, "doc_id long, set_key binary, set binary",
                     pa.schema([("doc_id", pa.int64()), ("set_key", pa.binary()), ("set", pa.binary())]), 64)
    # a repeated id can bring the same set several times
    return materialize(made.dropDuplicates(["doc_id", "set_key"])
                       .join(classes.select("id", "doc_id", "set_key"), ["doc_id", "set_key"]).select("id", "set"), "sets")


def verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """(ca, cb) of the pairs (a, b, ca, cb) whose full sets are similar enough."""
    info = classes.select("id", "regs", "odd", "n_shingles")
    keys = ["a", "b", "ca", "cb"]

    def sided(df, side, what):
        """``df`` with side's columns."""
        rows = what.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}")
                                                      for c in what.columns if c != "id"])
        return hot_join(df, rows, side, "b" if side == "a" else "a")

    def guess(b):
        x, y = (np.frombuffer(b"".join(b[c]), np.int16).reshape(-1, REGISTERS) for c in ("regs_a", "regs_b"))
        p, q = (np.frombuffer(b"".join(b[c]), np.uint64).reshape(len(x), -1) for c in ("odd_a", "odd_b"))
        m, n = np.array(b["n_shingles_a"]), np.array(b["n_shingles_b"])
        ok = np.flatnonzero((similarity(x, y, m, n) >= FLOOR) & (np.bitwise_count(p ^ q).sum(axis=1) <= most_apart(m + n)))
        return {k: [b[k][i] for i in ok] for k in keys}

    schema, kinds = pa.schema([(k, pa.int64()) for k in keys]), "a long, b long, ca long, cb long"
    sized = sided(sided(pairs, "b", info), "a", info).where(
        f"100 * least(n_shingles_a, n_shingles_b) >= {NEED} * greatest(n_shingles_a, n_shingles_b)")
    hopeful = materialize(arrow_map(sized, guess, kinds, schema), "hopeful")

    def check(b):
        out = {"ca": [], "cb": []}
        for ca, cb, x, y in zip(b["ca"], b["cb"], b["set_a"], b["set_b"]):
            s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
            if 100 * both >= NEED * (len(s) + len(t) - both):
                out["ca"].append(ca)
                out["cb"].append(cb)
        return out

    return arrow_map(sided(sided(hopeful, "b", sets), "a", sets).select("ca", "cb", "set_a", "set_b"),
                     check, "ca long, cb long", pa.schema([("ca", pa.int64()), ("cb", pa.int64())]), 64).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, comp): smallest reachable label of the labels in ``links`` (a, b); minimum
    labels with pointer jumping, each round written to the shared folder."""
    both = materialize(links.select("a", "b").union(links.select("b", "a")), "links")
    comp = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("comp"))
                       .select("id", F.least("id", "comp").alias("comp")), "comp")
    while True:
        near = hot_join(both, comp.select(F.col("id").alias("b"), F.col("comp").alias("c")), "b", "a") \
            .groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        step = comp.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        # a component's root follows its smallest member's new label
        root = step.where("comp < old").groupBy(F.col("old").alias("comp")).agg(F.min("comp").alias("to"))
        new = materialize(hot_join(step, root, "comp", "id", "left").select(
            "id", "old", F.least("comp", F.coalesce("to", "comp")).alias("comp")), "comp")
        if new.where("comp <> old").isEmpty():
            return new.select("id", "comp")
        comp = new.select("id", "comp")


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` (id, comp, weight) after its labels' links (ca, cb); only labels that
    are linked go round."""
    label = components(links.toDF("a", "b"))
    to = label.where("id <> comp").select(F.col("id").alias("comp"), F.col("comp").alias("to"))
    return materialize(hot_join(comp, to, "comp", "id", "left")
                       .select("id", F.coalesce("to", "comp").alias("comp"), "weight"), "comp")


def mixed(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """(bucket, id, comp, weight, lo, n): the rows (bucket, id) of buckets with several
    components; written."""
    at = rows.select("bucket", "id").join(comp, "id")
    several = at.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                       F.count(F.lit(1)).alias("n")).where("lo < hi").drop("hi")
    return materialize(at.join(several, "bucket"), "mixed")


def pivots(at: DataFrame, turn: int) -> DataFrame:
    """(a, b, ca, cb): each class with one pivot of another component, of those of
    its buckets the most frequent."""
    order = F.col("weight") if turn == 0 else F.xxhash64("id", F.lit(turn))
    low = at.groupBy("bucket").agg(F.max(F.struct(order.alias("o"), "id", "comp")).alias("p"))
    met = at.join(low, "bucket").where("comp <> p.comp").groupBy(
        F.col("id").alias("b"), F.col("comp").alias("cb"), F.col("p.id").alias("a"), F.col("p.comp").alias("ca")).agg(
        F.count(F.lit(1)).alias("times"))
    return met.groupBy("b", "cb").agg(F.max(F.struct("times", "a", "ca")).alias("p")) \
        .select("p.a", "b", "p.ca", "cb")


def bucket_pairs(at: DataFrame, marks: DataFrame, block: int | None = None) -> DataFrame:
    """(a, b, ca, cb): classes of different components in a bucket (bucket, id, comp,
    lo, n) whose sizes, digests and parities agree as those of linked sets do.

    A class stands in the block of its salt and is met by every class of a larger
    component; those go to all blocks of the bucket."""
    names = [c for c in marks.columns if c != "id"]
    at = materialize(at.select("bucket", "id", "comp", "lo", "n").join(marks, "id")
                     .withColumn("blocks", F.ceil(F.col("n") / (block or BLOCK)).cast("int")), "marked")
    other = at.where("comp <> lo").select("bucket", F.col("id").alias("b"), F.col("comp").alias("cb"),
                                          *[F.col(c).alias(f"{c}_b") for c in names],
                                          F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"))
    first = at.select("bucket", F.col("id").alias("a"), F.col("comp").alias("ca"), *names,
                      F.pmod(F.hash("id"), F.col("blocks")).alias("salt"))
    odd = 0x5555555555555555
    apart = " + ".join(f"bit_count(((d{i} ^ d{i}_b) | shiftright(d{i} ^ d{i}_b, 1)) & {odd})" for i in range(4))
    flips = F.expr(" + ".join(f"bit_count({c} ^ {c}_b)" for c in names if c[0] == "o"))
    return (other.join(first, ["bucket", "salt"])
            .where(f"ca < cb AND 100 * least(size, size_b) >= {NEED} * greatest(size, size_b) AND {apart} <= {APART}")
            .where(flips <= most_apart(F.col("size") + F.col("size_b"))).select("a", "b", "ca", "cb").distinct())


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    sk = sketched(docs)
    known = sk.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = materialize(known.groupBy("set_key").agg(
        F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("regs", "odd", "n_shingles")])
        .withColumn("id", F.monotonically_increasing_id()), "classes")
    rows = banded(classes)
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = materialize(rows.join(shared, "bucket"), "buckets")
    weights = materialize(rows.groupBy("id").agg(F.sum("n").alias("weight")), "weights")
    asked = materialize(classes.join(weights, "id", "left_semi"), "asked")
    sets = full_sets(docs, asked)
    comp = materialize(classes.select("id", F.col("doc_id").alias("comp")).join(weights, "id", "left"), "comp")
    # texts of one doc_id are one document
    twice = known.groupBy("doc_id").agg(F.min("set_key").alias("k0"), F.max("set_key").alias("k1")).where("k0 <> k1")
    named = known.join(twice.select("doc_id"), "doc_id").select(F.col("doc_id").alias("cb"), "set_key").distinct()
    labels = classes.select("set_key", F.col("doc_id").alias("ca"))
    same = materialize(hot_join(named, labels, "set_key", "cb").where("ca <> cb").select("ca", "cb").distinct(), "same")
    if not same.isEmpty():
        comp = merged(comp, same)
    at, turn, last = rows.join(comp, "id"), 0, False
    while not last:
        # at last what is left: classes of different components that share a bucket
        last = turn == PIVOT_ROUNDS
        pairs = materialize(bucket_pairs(at, marks(asked)) if last else pivots(at, turn), "pairs")
        if pairs.isEmpty():
            break
        links = materialize(verified(pairs, asked, sets), "label_links")
        linked = links.count()
        if linked:
            comp = merged(comp, links)
        if not last:
            at = mixed(at, comp)
            # pivots that link few classes leave them to the last step
            turn = turn + 1 if PIVOTS_PAY * linked >= pairs.count() else PIVOT_ROUNDS
    final = comp.join(classes.select("set_key", "id"), "id").select("set_key", "comp")
    out = hot_join(sk, final, "set_key", "doc_id", "left")
    cid = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", cid.alias("component_id"),
                      F.coalesce(F.col("doc_id") == cid, F.lit(True)).alias("kept"))
