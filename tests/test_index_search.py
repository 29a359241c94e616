"""Index build and batch search on hand-made frames (FIXTURES section 4)."""

import math

from pyspark.sql import functions as F

from trawl.operators import index, parse, search
from trawl.sources import tables as S

from conftest import SF_SMALL


def docs_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, title string, url string, content string")


def test_idf_uses_integer_division(spark):
    # 4 documents: 'all' in 4, 'half' in 2, 'most' in 3, 'one' in 1
    docs = docs_frame(spark, [
        (0, "t", "u0", "all half most one"),
        (1, "t", "u1", "all half most"),
        (2, "t", "u2", "all most"),
        (3, "t", "u3", "all"),
    ])
    idf = {r["word"]: r["idf"] for r in index.build_postings(docs).select("word", "idf").distinct().collect()}
    assert idf["all"] == 0.0
    assert math.isclose(idf["half"], math.log(2))
    assert idf["most"] == 0.0                   # ln(4 div 3) = ln(1)
    assert math.isclose(idf["one"], math.log(4))


def test_title_counts_ten_and_tf_above_one(spark):
    docs = docs_frame(spark, [(0, "Zeta", "u", "Zeta"), (1, "x", "u", "y")])
    tf = {(r["doc_id"], r["word"]): r for r in index.postings_tf(docs).collect()}
    z = tf[(0, "zeta")]
    assert z["cnt"] == 11 and z["n_tokens"] == 2
    assert z["tf"] == 5.5


def test_result_limit_and_ties(spark):
    rows = [(i, "t", f"u{i}", "common word") for i in range(120)] + [(500, "t", "u", "other")]
    docs = docs_frame(spark, rows)
    post = index.build_postings(docs)
    q = spark.createDataFrame([(1, "common")], "query_id long, query string")
    res = search.search(q, post, docs).orderBy("rank").collect()
    assert len(res) == 101
    assert [r["doc_id"] for r in res] == list(range(101))     # equal weights -> doc_id order


def test_or_query_scores_max_and_snippet_follows_best_word(spark):
    docs = docs_frame(spark, [
        (0, "t", "u0", "alpha beta beta"),
        (1, "t", "u1", "alpha"),
        (2, "t", "u2", "gamma"),
        (3, "t", "u3", "delta"),
    ])
    post = index.build_postings(docs)
    w = {(r["doc_id"], r["word"]): r["weight"] for r in post.collect()}
    q = spark.createDataFrame([(7, "Alpha BETA")], "query_id long, query string")
    res = {r["doc_id"]: r for r in search.search(q, post, docs).collect()}
    assert res[0]["word"] == "beta"
    assert math.isclose(res[0]["weight"], max(w[(0, "alpha")], w[(0, "beta")]))
    assert res[0]["desc"] == "alpha beta beta..."
    assert res[0]["rank"] == 1 and res[1]["rank"] == 2


def test_champions_equal_full_search_and_word_order_free(spark):
    pages = S.pages(spark, SF_SMALL)
    post = index.build_postings(parse.parse_documents(pages))
    queries = S.benchmark_queries(spark, SF_SMALL)
    cols = ["query_id", "rank", "doc_id", "word", "title", "url", "desc"]
    full = sorted(tuple(r) for r in search.search(queries, post, pages).select(*cols).collect())
    champ = sorted(tuple(r) for r in search.search(queries, index.champions(post), pages)
                   .select(*cols).collect())
    assert full and full == champ
    # metamorphic: reversing the word order of each query changes nothing
    rev = queries.select("query_id", F.array_join(F.reverse(F.split("query", " ")), " ").alias("query"))
    again = sorted(tuple(r) for r in search.search(rev, post, pages).select(*cols).collect())
    assert again == full


def test_results_json(spark):
    docs = docs_frame(spark, [(0, "T0", "u0", "alpha"), (1, "T1", "u1", "beta")])
    post = index.build_postings(docs)
    q = spark.createDataFrame([(1, "alpha"), (2, "nothing")], "query_id long, query string")
    js = {r["query_id"]: r["json"] for r in search.results_json(q, search.search(q, post, docs)).collect()}
    assert js[2] == "null\n"
    assert js[1] == '[{"desc":"alpha...","title":"T0","url":"u0"}]\n'


def test_equal_weights_rank_by_doc_id_not_word(spark):
    # same tf and idf: doc 0 matches via 'zeta', doc 1 via 'alpha'
    docs = docs_frame(spark, [(0, "t", "u0", "zeta"), (1, "t", "u1", "alpha"),
                              (2, "t", "u2", "other"), (3, "t", "u3", "more")])
    post = index.build_postings(docs)
    q = spark.createDataFrame([(1, "alpha zeta")], "query_id long, query string")
    res = search.search(q, post, docs).orderBy("rank").collect()
    assert [(r["doc_id"], r["word"]) for r in res] == [(0, "zeta"), (1, "alpha")]
