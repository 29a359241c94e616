"""TF-IDF and TextRank keywords."""

import math

from pyspark.sql import functions as F

from conftest import rows

from trawl.operators import keywords as K


def kept_frame(spark, words):
    off, rows = 0, []
    for i, w in enumerate(words):
        rows.append((1, i, w, off))
        off += len(w.encode())
    return spark.createDataFrame(rows, "doc_id long, pos long, word string, offset long")


def ranks(spark, words):
    kept = kept_frame(spark, words)
    edges = {(r["src"], r["dst"]): r["weight"] for r in K.cooccurrence_edges(kept).collect()}
    return K.rank_graph(set(words), edges)


def test_textrank_goldens(spark):
    r = ranks(spark, ["你好", "世界", "世界"])
    assert r["世界"] == 1.0 and round(r["你好"], 6) == 0.519787
    r = ranks(spark, ["一部", "iPhone6"])
    assert r["一部"] == 1.0 and round(r["iPhone6"], 6) == 0.996126
    r = ranks(spark, ["蓝翔", "优秀", "毕业生"])
    assert r["蓝翔"] == 1.0
    assert round(r["毕业生"], 6) == 0.996685 and round(r["优秀"], 6) == 0.992994


def test_edges_window_counts_kept_words_only(spark):
    kept = kept_frame(spark, ["a1", "b1", "a1"])
    e = {(r["src"], r["dst"]): r["weight"] for r in K.cooccurrence_edges(kept).collect()}
    assert e[("a1", "a1")] == 2.0          # self pair adds both directions
    assert e[("a1", "b1")] == 2.0 and e[("b1", "a1")] == 2.0
    far = kept_frame(spark, ["w0", "w1", "w2", "w3", "w4", "w5"])
    e = {(r["src"], r["dst"]) for r in K.cooccurrence_edges(far).collect()}
    assert ("w0", "w4") in e and ("w0", "w5") not in e


def test_textrank_keywords_end_to_end(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog and the cat"), (2, "solo")],
                                 "doc_id long, text string")
    stop = spark.createDataFrame([("the",), ("and",)], "word string")
    out = {(r["doc_id"], r["word"]): r for r in K.textrank_keywords(docs, stop, 5).collect()}
    assert out[(1, "cat")]["offsets"] == [4, 28]
    assert out[(2, "solo")]["weight"] == 0.0        # a single kept word has no graph
    assert max(r["weight"] for k, r in out.items() if k[0] == 1) == 1.0


def test_tfidf_keywords_default_idf(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta gamma x")], "doc_id long, text string")
    idf = spark.createDataFrame([("alpha", 2.0), ("beta", 1.0)], "word string, idf double")
    stop = spark.createDataFrame([("gamma",)], "word string")
    out = {r["word"]: r for r in K.extract_keywords(docs, idf, stop, 5).collect()}
    assert set(out) == {"alpha", "beta"}            # stop word and single char dropped
    assert out["alpha"]["weight"] == 2.0 and out["beta"]["weight"] == 2.0
    assert out["beta"]["offsets"] == [6, 11]
    assert out["alpha"]["rank"] == 1                # tie broken by word


def test_missing_idf_uses_average(spark):
    docs = spark.createDataFrame([(1, "unknown")], "doc_id long, text string")
    idf = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "word string, idf double")
    stop = spark.createDataFrame([("zz",)], "word string")
    out = K.extract_keywords(docs, idf, stop, 5).first()
    assert math.isclose(out["weight"], 1.5)


def test_textrank_packs_tokens_not_graphs(spark):
    """A document's row to the ranking step holds its tokens; a batch of long documents stays small."""
    words = [f"w{i * i % 211}" for i in range(900)]
    docs = spark.createDataFrame([(i, " ".join(words)) for i in range(40)] + [(None, "left right left")],
                                 "doc_id long, text string")
    stop = spark.createDataFrame([("the",)], "word string")
    kept = K.keyword_tokens(docs, stop)
    assert kept.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism  # one file's worth: a task a core
    packed = K.packed_tokens(kept)
    assert packed.columns == ["doc_id", "tokens"] and {len(r["tokens"]) for r in packed.collect()} == {900, 3}
    out = K.textrank_keywords(docs, stop, 5).collect()
    first = {r["word"]: r["weight"] for r in out if r["doc_id"] == 7}
    want = ranks(spark, words)
    assert first == {w: want[w] for w in sorted(want, key=lambda w: (-want[w], w))[:5]}
    assert {r["word"] for r in out if r["doc_id"] is None} == {"left", "right"}


def test_partitions_follow_the_text(spark, monkeypatch):
    from trawl.operators import tokenize

    docs = spark.createDataFrame([(i, "x" * 100) for i in range(100)], "doc_id long, text string")
    monkeypatch.setattr(tokenize, "PARTITION_BYTES", 500)
    spread = tokenize.by_document(docs)
    assert spread.rdd.getNumPartitions() == 20 and rows(spread) == rows(docs)
