"""Graphs ranked together are ranked as one by one, to the last bit."""

import random

import numpy as np
import pyarrow as pa

from trawl.operators import keywords as K

TOKEN = pa.list_(pa.struct([("pos", pa.int32()), ("word", pa.string()), ("offset", pa.int64())]))


def one_by_one(doc_id, words, n, span):
    """By ``rank_graph``, which updates node after node."""
    edges: dict = {}
    for i, a in enumerate(words):
        for b in words[i + 1:i + span]:
            for e in ((a, b), (b, a)):
                edges[e] = edges.get(e, 0.0) + 1.0
    scores = K.rank_graph(set(words), edges)
    best = sorted(scores, key=lambda w: (-scores[w], w))[:n]
    return [(doc_id, k + 1, w, [7 * i for i, x in enumerate(words) if x == w], scores[w]) for k, w in enumerate(best)]


def test_together_as_one_by_one(monkeypatch):
    rng = random.Random(4)
    for rep in range(30):
        monkeypatch.setattr(K, "TOKENS", rng.choice((5, 50, 10_000)))
        monkeypatch.setattr(K, "NARROW", (0, 10**9, 4)[rep % 3])
        docs = [[rng.choice("aé中Z") + str(rng.randint(0, rng.choice((1, 40)))) for _ in range(rng.choice((1, 2, 5, 60, 300)))]
                for _ in range(rng.randint(1, 12))]
        ids = [None if i == 3 else i for i in range(len(docs))]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([[{"pos": i, "word": w, "offset": 7 * i} for i, w in enumerate(x)] for x in docs], TOKEN)],
            names=["doc_id", "tokens"])
        span, n = rng.choice((2, 5)), rng.choice((1, 5, 100))
        got = [r for b in K._textrank_batches(n, span, K.RANK_ROUNDS, K.DAMPING)(iter([batch])) for r in zip(*b.to_pydict().values())]
        assert got == [r for i, x in zip(ids, docs) for r in one_by_one(i, x, n, span)]


def test_no_two_neighbours_share_a_level():
    rng = np.random.default_rng(2)
    pairs = np.unique(rng.integers(0, 60, (200, 2)), axis=0)
    both = np.unique(np.concatenate([pairs, pairs[:, ::-1]]), axis=0)
    levels = K._levels(70, both[:, 0], both[:, 1])
    place = np.full(70, -1)
    for k, level in enumerate(levels):
        place[level] = k
    other = both[both[:, 0] < both[:, 1]]
    assert (place[other[:, 0]] < place[other[:, 1]]).all()
    assert sorted(np.concatenate(levels)) == sorted(set(both[:, 0])) and (place[60:] == -1).all()
