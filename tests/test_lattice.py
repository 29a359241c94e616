"""Pieces cut together are cut as one by one."""

import random
import re

import numpy as np
import pyarrow as pa

from trawl.operators import lattice as LT
from trawl.operators import lexicon as LX
from trawl.operators import segment as SG
from trawl.operators.tokenize import presplit, separator_pattern
from trawl.plans import catalog_lexicon as CL
from trawl.plans import catalog_text as CT

NO = SG.MIN_DOUBLE
TOY = SG.HmmModel([-0.5, NO, NO, -1.0], [[NO, -0.5, -1.0, NO], [-0.5, NO, NO, -1.0]] * 2,
                  [{"中": -1.0, "é": -1.0}, {"国": -1.0, "é": -1.0}, {"国": -2.0}, {"人": -1.0, "😀": -0.5}])
SEPARATORS = " \t\n，。"


def rows(df, *cols):
    """As ``conftest.rows``, with nulls."""
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=lambda r: tuple(map(str, r)))


class Shared:
    def __init__(self, value):
        self.value = value


def one_by_one(cutter, batch, mode):
    out = []
    for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
        char = byte = pos = 0
        for piece in re.findall(separator_pattern(SEPARATORS), text):
            for word, s in zip(*cutter.cut(piece, mode)):
                out.append((d, pos, word, byte + len(piece[:s].encode()), char + s, len(word)))
                pos += 1
            char, byte = char + len(piece), byte + len(piece.encode())
    return out


def test_together_as_one_by_one(monkeypatch):
    rng = random.Random(5)
    for rep in range(40):
        for name, values in (("LONG", (3, 200)), ("BLOCK", (10, 1000)), ("CHUNK", (50, 100_000)), ("DENSE", (1, 20, 1 << 21)), ("RUNS", (2, 9)), ("EXPAND", (1, 30, 1000))):
            monkeypatch.setattr(LT, name, rng.choice(values))
        letters = "abc中é😀1." if rep % 2 else "ab国"
        words = {"".join(rng.choices(letters, k=rng.randint(1, rng.choice((3, 7))))): rng.choice((-1.0, -2.0, -3.5, -1e-10, -3.2e100))
                 for _ in range(rng.choice((0, 3, 40)))}
        singles = frozenset(w for w in words if len(w) == 1 and rng.random() < 0.5)
        cap, model, least = rng.choice((1, 2, 3, 5, 512)), rng.choice((TOY, SG.HmmModel())), rng.choice((-1.0, -2.0, -99.0))
        texts = ["".join(rng.choices(letters + SEPARATORS, k=rng.randint(0, 60))) for _ in range(20)]
        batch = pa.RecordBatch.from_pydict({"doc_id": list(range(20)), "text": texts}).slice(rep % 3)
        shared = Shared(SG.Cuts(LT.Trie(list(words), list(words.values())), least, np.array(sorted(map(ord, singles)), np.int64), model, cap))
        for mode in SG.MODES:
            fn = SG._cut_batches(shared, mode, SEPARATORS, True, False)
            got = [r for b in fn(iter([batch])) for r in zip(*b.to_pydict().values())]
            assert got == one_by_one(SG.Cutter(words, least, singles, model, cap), batch, mode)


def test_batches_that_leave_a_task_are_bounded(monkeypatch):
    monkeypatch.setattr(LT, "ROWS", 10)
    shared = Shared(SG.Cuts(LT.Trie([], []), -1.0, np.zeros(0, np.int64), TOY, 512))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, None], "text": ["ab cd " * 9, ""]})
    sizes = [b.num_rows for b in SG._cut_batches(shared, "mp", SEPARATORS, False, False)(iter([batch]))]
    assert sizes == [10, 10, 10, 10, 10, 4]


def test_all_cuts_read_the_documents_once(spark):
    """Once to look for shared ids, once to sum their bytes, once to cut; not for every cut."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    docs = spark.createDataFrame([(1, "abc, 中国"), (2, "the bc\nbc"), (3, "")], "doc_id long, text string")
    lex = LX.with_weights(spark.createDataFrame([("ab", 3.0, "n"), ("bc", 2.0, "v")], "word string, freq double, tag string"))
    got = CL._places(docs.mapInArrow(count, docs.schema), lex, lex, SG.HmmModel()).collect()
    assert len(got) == 2 * len(SG.MODES) and seen.value <= 3 * 3


def test_rows_of_one_partition_are_dealt_to_many(spark):
    """(F5, F6, F8 to F11) one row group is one task, whatever splits its file has."""
    docs = spark.createDataFrame([(i, "ab cd " * 200) for i in range(100)], "doc_id long, text string").coalesce(1)
    docs = docs.unionByName(docs.where("doc_id < 0")).unionByName(docs.where("doc_id < 0")).unionByName(docs.where("doc_id < 0"))
    sizes = SG.segment(docs, None, "hmm").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 100 * 800 and max(sizes) < 50 * 800


def random_pieces(spark, n=60):
    rng = random.Random(8)
    words = {"".join(rng.choices("ab国é", k=rng.randint(1, 5))) for _ in range(25)}
    lex = spark.createDataFrame([(w, float(i + 1), "n" if i % 3 else "") for i, w in enumerate(sorted(words))],
                                "word string, freq double, tag string")
    pieces = spark.createDataFrame([(i // 3, i % 3, "".join(rng.choices("ab国éx", k=rng.randint(1, 12)))) for i in range(n)],
                                   "doc_id long, piece_pos int, piece string")
    return pieces, lex


def test_edges_looked_up_are_the_joined_ones(spark, monkeypatch):
    pieces, lex = random_pieces(spark)
    for cap in (0, 2, 512):
        plan = LX.dag_edges(pieces, lex, cap)
        got = rows(plan)
        assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()  # no candidate is joined
        with monkeypatch.context() as m:
            m.setattr(LX, "BROADCAST_BYTES", -1)
            want = LX.dag_edges(pieces, lex, cap)
            assert rows(want, *plan.columns) == got and len(got) > 100
            assert want.schema.simpleString() == plan.schema.simpleString()


def test_edges_that_stay_are_the_full_cut(spark):
    """No window over all edges where a piece is by itself."""
    pieces, lex = random_pieces(spark)
    for cap in (1, 3, 512):
        own = LX.full_cut(LX.dag_edges(pieces, lex, cap, columns=("text", "stays")))
        assert "Window" not in own._jdf.queryExecution().executedPlan().toString()
        assert rows(own) == rows(LX.full_cut(LX.dag_edges(pieces, lex, cap)))


def test_full_cut_of_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "ab国 a"), (2, "b国é"), (2, "aab"), (None, "é国"), (None, "ab"), (3, None), (4, "国ab")], "doc_id long, text string")
    lex = random_pieces(spark)[1]
    pieces = presplit(docs).withColumnRenamed("pos", "piece_pos")
    key = lambda r: tuple(map(str, r))
    want = LX.full_cut(LX.dag_edges(pieces, lex)).collect()
    assert sorted(map(key, CT._full(docs, LX.with_weights(lex)).collect())) == sorted(map(key, want))
