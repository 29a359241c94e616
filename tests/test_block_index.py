"""Numbers inside groups, the block table, the single parsing pass, request URLs."""

import random

from pyspark.sql import functions as F

from trawl.operators import block_index as B
from trawl.operators import index, parse, search
from trawl.operators.numbering import numbered
from trawl.plans import catalog as C
from trawl.sources import corpus
from trawl.sources import tables as S

from conftest import SF_SMALL, rows


def test_numbers_inside_groups(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 6 == 0, "b").alias("g"),
                                    (F.col("id") * 7919 % 20_000).alias("x"))
    got = numbered(df.repartition(9), "g", F.col("x").desc()).collect()
    for g in ("hot", "b", None):
        mine = sorted((r.idx, -r.x) for r in got if r.g == g)
        assert [i for i, _ in mine] == list(range(len(mine))) and [x for _, x in mine] == sorted(x for _, x in mine)
    assert numbered(df.limit(0), "g", F.col("x").asc()).count() == 0


def postings(spark, n=1500):
    rnd = random.Random(3)
    made = [(f"w{j}", i, rnd.choice([0.5, 0.25, rnd.random()])) for i in range(n) for j in range(6) if rnd.random() < (0.9 if j == 0 else 0.2)]
    return spark.createDataFrame(made, "word string, doc_id long, weight double")


def test_block_search_is_exact_and_stops_early(spark):
    post = postings(spark)
    q = spark.createDataFrame([(1, "w0 w1"), (2, "w2 w3 w4 nothing"), (3, "W5"), (4, "none"), (5, "")], "query_id long, query string")
    name = B.write_blocks(B.blocks(post), 4)
    try:
        words = search.query_words(q)
        for k in (10, 300):
            got, read = B.best_hits(words, spark.table(name), k)
            assert rows(got) == rows(search.best_hits(words, post, k), *got.columns), k
            if k == 10:
                assert len(read) <= 3
        total = sum(r["n"] for r in spark.table(name).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect())
        assert sum(B.best_hits(words, spark.table(name), 10)[1]) < total / 2
        # only the words' buckets are read, and the postings are not exchanged
        active = words.where("query_id = 3").select("query_id", "word", F.lit(None).cast("double").alias("least"))
        conf = {"spark.sql.sources.bucketing.autoBucketedScan.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
        before = {c: spark.conf.get(c) for c in conf}
        for c, v in conf.items():
            spark.conf.set(c, v)
        try:
            plan = spark._jvm.PythonSQLUtils.explainString(
                B.reading(spark.table(name), active, 0, ["w5"], 1 << 40)._jdf.queryExecution(), "simple")
        finally:
            for c, v in before.items():
                spark.conf.set(c, v)
        assert "SelectedBucketsCount: 1 out of 4" in plan
        assert "Exchange" not in plan[plan.index("SortMergeJoin"):plan.index("FileScan")]
    finally:
        B.drop(spark, name)


def test_empty_batches_of_queries(spark):
    name = B.write_blocks(B.blocks(postings(spark, 10)), 2)
    try:
        none = spark.createDataFrame([], "query_id long, word string")
        assert B.best_hits(none, spark.table(name), 5)[0].count() == 0
    finally:
        B.drop(spark, name)


def test_one_pass_gives_documents_rejects_and_counts(spark):
    pages = spark.createDataFrame([(1, "u1", "<title>T</title><p>a"), (2, "u2", "<p>no title"), (3, None, None), (4, "u4", ""),
                                   (5, "u5", "<title></title>")], "page_id long, url string, html string")
    docs, rejects, counts = parse.parse_corpus(pages)
    assert counts == {"rows": 5, "accepted": 1, "rejected": 4}
    assert rows(docs) == rows(parse.parse_documents(pages)) and {r.doc_id for r in rejects.collect()} == {2, 3, 4, 5}
    empty = parse.parse_corpus(pages.limit(0))
    assert empty[0].count() == 0 and empty[2] == {"rows": 0, "accepted": 0, "rejected": 0}


def test_postings_read_the_pages_once(spark):
    plan = C._postings(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan
    docs = parse.parse_documents(S.pages(spark, SF_SMALL))
    assert rows(C._postings(spark, SF_SMALL)) == rows(index.build_postings(docs))


def test_escapes_are_decoded_one_by_one(spark):
    cases = {"a%20b%zz": "a b%zz", "a+b%": "a b%", "%E4%B8%AD%u56fd": "中国", "%uD83D": "", "%uzz": "%uzz", "100%25": "100%",
             "%C3": "�", "": "", "%%41": "%A"}
    df = spark.createDataFrame([(k, "http://h/s?query=" + k) for k in cases], "k string, url string")
    got = {r.k: r.q for r in df.select("k", corpus.request_query("url").alias("q")).collect()}
    assert got == cases
