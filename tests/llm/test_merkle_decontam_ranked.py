"""Merkle manifest, decontamination and ranked search against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.llm import decontam, merkle, ranked

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, tree string, idx long, n long, h long, "
          "items string, rank int, score long, part int")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


RNG = np.random.default_rng(11)
VOCAB = [f"v{i}" for i in range(40)] + ["Über", "naïve", "中文字", "x1"]
ITEMS = [(i, " ".join(RNG.choice(VOCAB, n))) for i, n in enumerate([30, 12, 10, 9, 3, 1, 25])]
ITEMS += [(20, ITEMS[0][1][10:80] + " more of it"), (21, ITEMS[1][1]), (22, ""), (23, None), (24, "... !"),
          (None, "a null item has words of its own too"), (25, "aa aa aa aa aa aa aa aa aa aa aa")]


def texts():
    out = [None, "", "...", "one", ITEMS[0][1], ITEMS[0][1].upper() + "!", "so " + ITEMS[3][1] + ", and " + ITEMS[4][1],
           ITEMS[1][1] + " " + ITEMS[2][1], "aa " * 40, "a null item has words of its own too", "中文字", ITEMS[5][1]]
    for _ in range(60):
        w = list(RNG.choice(VOCAB, int(RNG.integers(1, 60))))
        if RNG.random() < 0.4:
            t = ITEMS[int(RNG.integers(0, 7))][1].split()
            a = int(RNG.integers(0, len(t)))
            w[len(w) // 2:len(w) // 2] = t[a:a + int(RNG.integers(1, 20))]
        out.append(" ".join(w))
    out.append(" ".join(RNG.choice(VOCAB, 20_000)) + " " + ITEMS[0][1])
    return out + out[3:9]  # repeated texts


TEXTS = texts()
IDS = [None, None, *range(len(TEXTS) - 4), 3, 3]
LANGS = ["en", None, "", "de", "én", "en"]
ROWS = [(i, t, LANGS[k % 6], None if k % 5 == 0 else "s", None if k % 4 == 0 else len(t or ""), "t", 1, 2, 3, "x", 1, 2, 3)
        for k, (i, t) in enumerate(zip(IDS, TEXTS))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(*r, "n", 1) for r in ITEMS], "item_id long, text string, doc_id string, n int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, arity):
    def leaf(r, more=0):
        v = [r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]]
        return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in v])

    def fold_tree(hs):
        """(root, siblings left and right of every leaf, level by level)"""
        paths, at = [[] for _ in hs], list(range(len(hs)))
        while len(hs) > 1:
            runs = [hs[k:k + arity] for k in range(0, len(hs), arity)]
            for i, a in enumerate(at):
                run, slot = runs[a // arity], a % arity
                paths[i].append((run[:slot], run[slot + 1:]))
            at, hs = [a // arity for a in at], [H(*run) for run in runs]
        return hs[0], paths

    trees = defaultdict(list)
    for r in rows:
        trees[(r[2] is not None, (r[2] or "").encode())].append(r)
    order = sorted(trees)
    for key in order:
        trees[key].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    folds = {key: fold_tree([leaf(r) for r in trees[key]]) for key in order}
    root, above = fold_tree([folds[key][0] for key in order])
    out = []
    for k, key in enumerate(order):
        for r, path in zip(trees[key], folds[key][1]):
            full = path + above[k]
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            acc = leaf(r, 1 if hit else 0)
            for left, right in full:
                acc = H(*left, acc, *right)
            out.append((r[0], leaf(r), folds[key][0], root, H(*[x for a, b in full for x in a + b]), acc, acc == root))
    return out


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest_equals_brute_force(docs, arity):
    got = merkle.verified(merkle.manifest(docs, arity=arity, probe=merkle.tampered())).collect()
    want = brute_manifest(ROWS, arity)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_few_rows(spark, empty):
    assert merkle.verified(merkle.manifest(empty)).count() == 0
    one = spark.createDataFrame(ROWS[2:3], SCHEMA)
    assert list(map(tuple, merkle.verified(merkle.manifest(one)).collect())) == brute_manifest(ROWS[2:3], 2)
    with pytest.raises(ValueError):
        merkle.manifest(one, arity=1)


def test_leaves_are_numbered_over_many_partitions(spark):
    n = 30_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("doc_id"), F.lit("a").alias("text"),
                               F.when(F.col("id") % 3 == 0, "b").alias("lang"), F.lit("s").alias("source"), F.col("id").alias("n_chars"))
    rows = merkle.numbered(df.select(F.coalesce("lang", F.lit("0")).alias("tree"), "doc_id").repartition(16), "doc_id").collect()
    for tree in ("b", "0"):
        mine = sorted((r.idx, r.doc_id) for r in rows if r.tree == tree)
        assert [i for i, _ in mine] == list(range(len(mine))) and [d for _, d in mine] == sorted(d for _, d in mine)
        assert {r.n for r in rows if r.tree == tree} == {len(mine)}


def brute_hits(t):
    w, hit, items = words(t), set(), set()
    for i, text in ITEMS:
        b = words(text)
        size = min(10, len(b))
        for a in range(len(b) - size + 1 if size else 0):
            for k in range(len(w) - size + 1):
                if w[k:k + size] == b[a:a + size]:
                    hit.update(range(k, k + size))
                    items.add("" if i is None else str(i))
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


def test_decontamination_equals_brute_force(docs, bench):
    short = docs.where("text IS NULL OR length(text) < 5000")
    got = [(r.doc_id, *tuple(r)[1:]) for r in decontam.report(short, bench).collect()]
    want = [(i, *brute_hits(t)) for i, t in zip(IDS, TEXTS) if len(t or "") < 5000]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(r[-1] for r in want) > 10


def test_blocks_of_items_give_the_same(docs, bench):
    whole = sorted(map(str, decontam.scan(docs, bench).collect()))
    assert sorted(map(str, decontam.scan(docs, bench, block=24).collect())) == whole


def test_clean_removes_the_passages(spark, bench):
    rows = [(1, "Keep this. " + ITEMS[0][1] + "! And this, too: " + " ".join(f"k{i}" for i in range(40))), (2, ITEMS[0][1]), (3, "clean"), (4, None)]
    got = {r.doc_id: r for r in decontam.clean(spark.createDataFrame(rows, "doc_id long, text string"),
                                               bench.where("item_id = 0")).collect()}
    assert got[1].text == "Keep this. ! And this, too: " + " ".join(f"k{i}" for i in range(40)) and got[1].n_removed == 30
    assert 2 not in got and got[3].text == "clean" and got[4].text is None


def test_automaton_streams_parts_of_a_text():
    raw = " ".join(f"w{i % 1000}" for i in range(300_000)).encode()
    machine = decontam.Automaton([("a", [f"w{i}".encode() for i in range(995, 1000)] + [f"w{i}".encode() for i in range(5)])])
    items = set()
    n, spans = machine.scan(raw, [], items)
    assert n == 300_000 and spans == [(k + 995, k + 1005) for k in range(0, 299_000, 1000)] and items == {"a"}


def brute_ranked(k=10):
    ds = [(i, Counter(words(t))) for i, t in zip(IDS, TEXTS) if words(t)]
    N, L = len(ds), sum(c.total() for _, c in ds)
    df = Counter(w for _, c in ds for w in c)
    weight = {w: math.floor(1000 * math.log((2 * N + 2) / (2 * f + 1))) for w, f in df.items()}
    out = []
    for i, t in ITEMS:
        scored = []
        for d, c in ds:
            m = 25 + 75 * c.total() * N // L
            s = sum(weight[w] * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in words(t) if w in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        scored.sort()
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(scored[:k], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("chunk", [1 << 21, 300])
def test_ranked_search_equals_brute_force(docs, bench, monkeypatch, chunk):
    monkeypatch.setattr(ranked, "CHUNK", chunk)
    assert sorted(map(str, map(tuple, ranked.search(docs, bench).collect()))) == brute_ranked()


def test_ranked_search_in_blocks_and_for_other_k(docs, bench):
    got = ranked.search(docs, bench, k=3, block=1)
    assert sorted(map(str, map(tuple, got.collect()))) == brute_ranked(3)


def test_best_positions_stop_early():
    n = 5000
    doc, rng = np.arange(n), np.random.default_rng(4)
    tfs = np.where(doc < 20, 50, 1 + rng.integers(0, 3, 2 * n).reshape(2, n)).T.ravel()
    lists = ranked.Lists(doc, np.zeros(n, bool), np.full(n, 100), np.full(n, 2), np.tile([0, 1], n), tfs, np.array([900, 800]), n, 100 * n)
    best = ranked.Best(10)
    assert lists.search([0, 1], [1, 1], best) < 2 * n / 10 and best.ids.tolist() == list(range(10))


def test_empty_tables(spark, docs, bench, empty):
    none = bench.limit(0)
    assert ranked.search(docs, none).count() == 0 and ranked.search(empty, bench).count() == 0
    assert decontam.report(empty, bench).count() == 0
    assert {(r.n_hit, r.contaminated) for r in decontam.report(docs, none).collect()} == {(0, False)}
