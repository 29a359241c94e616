"""The n-gram model and the band of op6_quality."""

import math
import pickle
from collections import Counter, defaultdict

import numpy as np
import pytest

from trawl.llm import quality

SCHEMA = "doc_id long, text string, lang string"


def model(texts: list[str]):
    """log p(w | context) of an interpolated modified Kneser-Ney model, for any n-gram."""
    n = quality.ORDER
    padded = [chr(quality.PAD) * (n - 1) + t for t in texts]
    levels = {n: Counter(t[i:i + n] for t in padded for i in range(len(t) - n + 1))}
    for k in range(n - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    total = sum(levels[1].values())
    whole, back, disc = {}, {}, {}
    for k in range(2, n + 1):
        n1, n2, n3, n4 = (sum(c == i for c in levels[k].values()) for i in (1, 2, 3, 4))
        d = [0.5, 0.75, 0.9]
        if n1 and n2 and n3 and n4:
            y = n1 / (n1 + 2 * n2)
            d = [min(max(x, quality.LEAST_DISCOUNT), i) for i, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
        disc[k] = [0, *d]
        whole[k], back[k] = Counter(), Counter()
        for g, c in levels[k].items():
            whole[k][g[:-1]] += c
            back[k][g[:-1]] += d[min(c, 3) - 1]

    def p(g):
        k = len(g)
        if k == 1:
            return (levels[1][g] + 0.5) / (total + 0.5 * (len(levels[1]) + 1))
        lower, t = p(g[1:]), whole[k][g[:-1]]
        if not t:
            return lower
        c = levels[k][g]
        return (c - disc[k][min(c, 3)]) / t + back[k][g[:-1]] / t * lower
    return p


def brute_force(texts: list[str], halves: list[int]) -> list[float]:
    """Sums of natural logs, each text by the model of the other half."""
    n = quality.ORDER
    p = [model([t for t, h in zip(texts, halves) if h == i]) for i in (0, 1)]
    padded = [chr(quality.PAD) * (n - 1) + t for t in texts]
    return [sum(math.log(p[1 - h](t[i:i + n])) for i in range(len(t) - n + 1)) for t, h in zip(padded, halves)]


def words(rng, letters, n):
    return " ".join("".join(rng.choice(list(letters), rng.integers(2, 6))) for _ in range(n))


def half_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").selectExpr("i", "pmod(xxhash64(text), 2) AS h").collect()
    return [r.h for r in sorted(rows)]


def texts_by_language(rng):
    # letters beyond ASCII that a folding to 128 classes would take for one another
    return {"en": [words(rng, "abcde", 40) for _ in range(20)], "ja": [words(rng, "日本語東京大学院", 30) for _ in range(20)],
            "": [words(rng, "abxyz\U0001f600", 20), "\x00 \x00", "one", "two", "three"]}


@pytest.mark.parametrize("part, most, chunk", [(quality.PART, quality.MODEL_ROWS, quality.CHUNK), (300, 0, 900)])
def test_model_equals_brute_force_by_language(spark, monkeypatch, part, most, chunk):
    monkeypatch.setattr(quality, "PART", part)
    monkeypatch.setattr(quality, "CHUNK", chunk)
    texts = texts_by_language(np.random.default_rng(5))
    rows = [(i, t, lang or None) for lang in texts for i, t in enumerate(texts[lang])] + [(99, None, "en"), (99, "", "xx")]
    found = {(r.lang, r.doc_id): r.log_ppl for r in quality.scored(spark.createDataFrame(rows, SCHEMA), most=most).collect()}
    assert len(found) == len(rows) and found["en", 99] is None and found["xx", 99] is None
    for lang, ts in texts.items():
        for i, (t, s) in enumerate(zip(ts, brute_force(ts, half_of(spark, ts)))):
            assert math.isclose(found[lang, i], -s / len(t.replace(" ", "")), rel_tol=1e-5), (lang, i)


def test_probabilities_sum_to_one():
    p = model(texts_by_language(np.random.default_rng(5))["en"])
    for context in ("abcd", "zzzz", " abc", chr(quality.PAD) * 4):
        assert math.isclose(sum(p(context + w) for w in "abcde ") + p(context + "\x01"), 1, rel_tol=1e-9)


@pytest.mark.parametrize("bits", [quality.BITS, 3])
def test_counts_with_few_numbers_for_characters(monkeypatch, bits):
    monkeypatch.setattr(quality, "BITS", bits)  # with 3, the alphabets do not fit
    texts = texts_by_language(np.random.default_rng(6))
    tally, got = quality.Tally(), Counter()
    for lang, ts in texts.items():
        tally.add((lang, 0), *quality.padded(ts))
    tally.flush()
    for (lang, _), a, b, n in tally.out:
        for x, y, c in zip(a.tolist(), b.tolist(), n.tolist()):
            mask = (1 << quality.WIDE) - 1
            got[lang, "".join(chr(v & mask) for v in (x >> quality.WIDE, x, y >> 2 * quality.WIDE, y >> quality.WIDE, y))] += c
    pad = chr(quality.PAD) * 4
    assert got == Counter((lang, (pad + t)[i:i + 5]) for lang, ts in texts.items() for t in ts for i in range(len(t)))


def test_no_characters_share_a_class_and_the_model_grows():
    def distinct(texts):
        tally = quality.Tally()
        tally.add(("zh", 0), *quality.padded(texts))
        tally.flush()
        return sum(len(x[3]) for x in tally.out)

    han = [chr(0x4E00 + i) for i in range(3000)]
    assert distinct(["".join(han)]) == 3000 and distinct(["".join(han), "".join(han[::-1])]) == 6000


def test_random_characters_look_as_unlikely_as_they_are(spark):
    rng = np.random.default_rng(2)
    han = [chr(0x4E00 + i) for i in range(2500)]
    rows = [(i, "".join(rng.choice(han, 240)), "zh") for i in range(40)]
    for r in quality.scored(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r.log_ppl > 7  # a model that had seen the text would say 0.1


def test_band_of_very_large_perplexities_is_not_capped(spark):
    rows = [("en", 60, 0, 1100.0 + i) for i in range(200)]
    s = spark.createDataFrame(rows, "lang string, n_words long, n_repeat_words long, log_ppl double")
    band = quality.bands(s).first()
    assert band.least < 1100 and band.most > 1299


def test_symbol_laden_texts_are_rejected_and_plain_ones_stay(spark):
    rng = np.random.default_rng(1)
    vocab = [words(rng, "etaoinshrdlu", 1) for _ in range(3000)]
    plain = [" ".join(rng.choice(vocab, 150)) for _ in range(300)]
    junk = [" ".join(w + rng.choice(["###", "%%%", "***", "&&&"]) for w in rng.choice(vocab, 150)) for _ in range(15)]
    rows = [(i, t, "en") for i, t in enumerate(plain + junk)]
    got = quality.verdicts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert not any(r.base_failed for r in got)
    assert not [r.doc_id for r in got if r.doc_id >= 300 and r.kept]
    assert sum(r.kept for r in got if r.doc_id < 300) >= 297


def test_base_failures_do_not_widen_the_band(spark):
    rows = [("en", 60, 0, 9.0 + i / 100) for i in range(100)] + [("en", 3, 0, 40.0 + i) for i in range(100)]
    s = spark.createDataFrame(rows, "lang string, n_words long, n_repeat_words long, log_ppl double")
    band = quality.bands(s, 2.5, 3.0).first()
    assert 7 < band.least < 9 and 10 < band.most < 13


def test_each_level_has_a_plan_of_its_own(spark):
    docs = spark.createDataFrame([(i, f"the quick brown fox jumps {i} times over the lazy dog", "en") for i in range(40)], SCHEMA)
    plan = quality.probabilities(quality.counted(quality.prepared(docs)))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("Join ") <= 4  # one of all levels took the driver hundreds of MB


def test_the_model_travels_without_what_tasks_can_make(rng=np.random.default_rng(3)):
    keys = rng.integers(0, 2 ** 63, 5000).astype(np.uint64)
    m = quality.Model(keys, *rng.random((2, 5000), np.float32))
    sent = pickle.dumps(m)
    assert len(sent) < 5000 * 16 + 2000
    again = pickle.loads(sent)
    assert (again.starts == np.searchsorted(again.keys, np.arange(len(again.starts), dtype=np.uint64) << again.shift)).all()
