"""Near copies about the limit: groups whose members are mostly not linked."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.llm import neardup


@pytest.fixture(scope="module")
def star():
    """A text, 50 copies with up to 4 words of 150 changed (linked with it) and 150
    copies with 5 to 7 (mostly not, though far more alike than texts are)."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(150)]
    rows = [(7, " ".join(base))]
    for k in range(200):
        w = list(base)
        for p in rng.choice(150, int(rng.integers(1, 5) if k < 50 else rng.integers(5, 8)), replace=False):
            w[p] = f"z{rng.integers(10**6)}"
        rows.append((1000 - k, " ".join(w)))
    # two that are linked with each other and with nothing else
    rows += [(2001, rows[-1][1] + " tail"), (2002, " ".join(rows[-2][1].split()[1:]))]
    return rows


@pytest.fixture(scope="module")
def linked(star):
    """All linked pairs, from the words themselves."""
    sets = {i: {tuple(w[j:j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in star)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2)
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}


def test_group_about_the_limit_equals_brute_force(spark, star, linked):
    comp = {i: i for i, _ in star}
    while any(comp[a] != comp[b] for a, b in linked):
        for a, b in linked:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = neardup.groups(spark.createDataFrame(star, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == comp and len(got) == len(star)
    assert 50 < len(set(comp.values())) < 170


def test_pairs_below_the_limit_stay_in_their_buckets(spark, star, linked):
    classes = neardup.sketched(spark.createDataFrame(star, "doc_id long, text string")) \
        .withColumn("id", F.col("doc_id")).withColumn("comp", F.col("doc_id"))
    at = neardup.banded(classes).join(classes.select("id", "comp"), "id")
    at = at.join(at.groupBy("bucket").agg(F.min("comp").alias("lo"), F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket")
    got = {(r.a, r.b) for r in neardup.bucket_pairs(at, neardup.marks(classes)).collect()}
    assert linked <= got and len(got) < len(linked) + 0.05 * len(star) ** 2 / 2


@pytest.mark.parametrize("size", [1, 40, 150, 1000, 20000])
def test_parities_of_linked_sets(size):
    rng = np.random.default_rng(size)
    for _ in range(50):
        shared = -(-size * 2 * 75 // 175)  # similarity 0.75 or just above
        own = max(0, size - shared)
        h = rng.integers(0, 2 ** 63, shared + 2 * own).astype(np.uint64) * np.uint64(2)
        a, b = h[:shared + own], np.concatenate([h[:shared], h[shared + own:]])
        x, y = (np.frombuffer(neardup.parities(s), np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= neardup.most_apart(np.float64(len(a) + len(b)))


def test_limit_of_parities_is_the_same_in_spark(spark):
    n = [1.0, 2.0, 80.0, 292.0, 2000.0, 10.0 ** 6]
    got = spark.createDataFrame([(x,) for x in n], "n double").select(neardup.most_apart(F.col("n"))).collect()
    assert np.allclose([r[0] for r in got], neardup.most_apart(np.array(n)))


def test_rows_of_ids(spark):
    docs = spark.range(-5000, 15000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    for ids in (docs.where(f"doc_id % {k} = 0").select("doc_id") for k in (10, 4999, 30000)):
        got = neardup.of_ids(docs.union(docs.limit(3)), ids)
        assert ids.join(got, "doc_id", "left_anti").count() == 0
        assert got.count() <= ids.count() + 0.05 * 20000 + 3


def test_pivots_are_the_middle_of_a_group_and_labels_merge(spark):
    at = spark.createDataFrame([(1, 1, 10, 5), (1, 2, 20, 50), (1, 3, 30, 5), (2, 2, 20, 50), (2, 3, 30, 5), (3, 3, 30, 5), (3, 4, 40, 6)],
                               "bucket long, id long, comp long, weight long")
    assert {tuple(r) for r in neardup.pivots(at, 0).select("a", "b").collect()} == {(2, 1), (2, 3)}
    comp = at.select("id", "comp", "weight").distinct()
    links = spark.createDataFrame([(20, 30), (30, 40)], "ca long, cb long")
    assert {(r.id, r.comp) for r in neardup.merged(comp, links).collect()} == {(1, 10), (2, 20), (3, 20), (4, 20)}
