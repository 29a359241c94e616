"""Hashes of all words of a text at once."""

import numpy as np

from trawl.llm import neardup
from trawl.llm.common import word_hashes


def test_equal_words_and_no_others_have_equal_hashes():
    rng = np.random.default_rng(2)
    pool = [bytes(rng.integers(33, 256, n, dtype=np.uint8)) for n in [*rng.integers(1, 12, 3000), 4095, 4096, 5000, 70_000, 140_000, 300_000]]
    pool += [b"a", b"aa", b"aaa", b"b", b"ab", b"ba", b"\x00", b"\x00\x00"]
    blanks = [b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"  ", b" \r\n"]
    words = [pool[i] for i in rng.integers(0, len(pool), 30_000)] + pool[3000:]
    raw = b"".join(blanks[i] + w for i, w in zip(rng.integers(0, len(blanks), len(words)), words))
    assert raw.split() == words
    h, starts = word_hashes(raw)
    assert len(h) == len(words) and all(raw[a:a + len(w)] == w for a, w in zip(starts.tolist(), words))
    names = {}
    for w, x in zip(words, h.tolist()):
        assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)
    assert (word_hashes(b"".join(w + b" " for w in words))[0] == h).all()  # wherever a word stands
    assert len(word_hashes(b"")[0]) == len(word_hashes(b" \n ")[0]) == 0 and len(word_hashes(b"x")[0]) == 1
    assert word_hashes(b"y" * 400_000 + b" z")[0][1] == word_hashes(b"z")[0][0]


def test_shingle_sets_of_a_batch():
    texts = [None, "", " \n", "a", "A b c d", "a b c d e", "x " * 9, "a  b\tc d e f g", "z"]
    got = neardup.shingle_sets(texts)
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    assert [len(s) for s in got] == [len(s) for s in sets]
    for i, a in enumerate(got):
        assert (np.diff(a.astype(object)) > 0).all()
        for j, b in enumerate(got):
            assert len(np.intersect1d(a, b)) == len(sets[i] & sets[j])
    assert (neardup.shingle_sets(texts[7:8])[0] == got[7]).all()
