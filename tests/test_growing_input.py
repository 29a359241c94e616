"""Work and memory that follow the input's size."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from trawl.operators import index, parse, segment, tokenize
from trawl.plans import catalog


def test_code_points_of_one_file_use_every_core(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame([(1, "aé"), (2, None)], "doc_id long, text string").coalesce(1).write.parquet(path)
    out = tokenize.code_points(spark.read.parquet(path))
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert [tuple(r) for r in out.orderBy("pos").collect()] == [(1, 0, "a", 97, 1), (1, 1, "é", 233, 2)]


def test_pages_are_spread_before_they_are_parsed(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "p")
    spark.createDataFrame([(1, "u", "<title>a</title>b")], "page_id long, url string, html string").coalesce(1).write.parquet(path)
    seen = []
    monkeypatch.setattr(parse, "spread", lambda df, basis=None: seen.append(df.columns) or df)
    docs = parse.parse_corpus(spark.read.parquet(path))[0]
    assert seen == [["page_id", "url", "html"]] and docs.count() == 1


def test_words_are_counted_in_partitions_of_few_bytes(spark, monkeypatch):
    monkeypatch.setattr(tokenize, "PARTITION_BYTES", 64)
    parts = -(-100 * 40 // 64)
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("a").alias("title"),
                                   F.rpad(F.lit("bb a cc "), 40, "bb a cc ").alias("content"))
    counted = index.word_counts(docs)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(doc_id#" in plan and f", {parts})" in plan
    assert {tuple(r)[1:] for r in counted.collect()} == {("a", 1, 5, 31), ("bb", 0, 5, 31), ("cc", 0, 5, 31)}


def test_numbering_by_path_scans_the_input_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def note(x):
        runs.add(1)
        return x

    rows = spark.createDataFrame([(c,) for c in "dbac"], "path string")
    got = parse.assign_doc_id(rows.select(F.udf(note)("path").alias("path")), "path").orderBy("doc_id").collect()
    assert [(r.doc_id, r.path) for r in got] == list(enumerate("abcd")) and runs.value == 4


def test_corpus_pages_are_dealt_by_id(spark, tmp_path):
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame([(i, "u", f"<title>t{i}</title>x") for i in (3, 10, 2)] + [(2, "u", "<title>t2</title>x")],
                          "page_id long, url string, html string").repartition(4).write.parquet(path)
    got = catalog.registry()["corpus_scan"](spark, str(tmp_path)).orderBy("doc_id").collect()
    # one file a page, whatever partitions its rows come from
    assert [(r.doc_id, r.page_id) for r in got] == [(0, 10), (1, 2), (2, 3)]


def test_kept_pieces_are_bounded_and_frequent_ones_stay(monkeypatch):
    monkeypatch.setattr(segment, "CACHE", 10)
    cutter = segment.Cutter({"ab": -1.0}, -2.0, frozenset(), segment.HmmModel(), 512)
    first = cutter.piece("often", "mp")
    for i in range(100):
        cutter.piece(f"seldom{i}", "mp")
        assert cutter.piece("often", "mp") is first
        assert len(cutter.known) + len(cutter.older) <= 20


def test_graph_holds_every_word_within_the_cap():
    rng = random.Random(3)
    words = {"".join(rng.choices("ab中é", k=rng.randint(1, 7))): -float(i) for i in range(60)}
    for cap in (1, 2, 3, 4, 5, 512):
        cutter = segment.Cutter(words, -99.0, frozenset(), segment.HmmModel(), cap)
        for _ in range(50):
            p = "".join(rng.choices("ab中é", k=rng.randint(1, 20)))
            want = {i: [(j - 1, words[p[i:j]]) for j in range(i + 1, min(len(p), i + cap) + 1) if p[i:j] in words]
                    for i in range(len(p))}
            assert cutter.graph(p) == {i: e for i, e in want.items() if e}
