"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver tables (or data Spark derives from them) in
full.  Doubles in the outputs are rounded to 10 digits and counts are BIGINT,
matching the oracle SQL in ``trawl.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.operators import index, parse, search
from trawl.operators.tokenize import by_document
from trawl.sources import tables as S

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        _REGISTRY[name] = fn
        return fn
    return deco


def registry() -> dict[str, Query]:
    # import the modules that register more queries
    from trawl.plans import catalog_lexicon, catalog_text  # noqa: F401
    return dict(_REGISTRY)


def r10(col: str):
    return F.round(F.col(col), 10).alias(col)


# ---------------------------------------------------------------- parse / index

def _docs(spark, sf):
    return parse.parse_documents(S.pages(spark, sf))


def _postings(spark, sf):
    """Postings of the pages, which are read and parsed once."""
    docs, _, counts = parse.parse_corpus(S.pages(spark, sf))
    return index.build_postings(docs, n_docs=counts["accepted"])


@register("parse_documents")
def q_parse_documents(spark, sf):
    return _docs(spark, sf)


def _mixed_pages(spark, sf):
    """The pages, and the texts of ``documents`` as pages that have no title."""
    texts = S.documents(spark, sf).select((-F.col("doc_id") - 1).alias("page_id"), F.lit(None).cast("string").alias("url"),
                                          F.col("text").alias("html"))
    return S.pages(spark, sf).select("page_id", "url", "html").unionByName(texts)


@register("parse_rejects")
def q_parse_rejects(spark, sf):
    return parse.parse_corpus(_mixed_pages(spark, sf))[1]


@register("parse_accepted")
def q_parse_accepted(spark, sf):
    """What the same pass accepts, with the counts it observed."""
    docs, _, counts = parse.parse_corpus(_mixed_pages(spark, sf))
    return docs.select("doc_id", "title", F.lit(counts["rows"]).cast("long").alias("n_rows"),
                       F.lit(counts["rejected"]).cast("long").alias("n_rejected"))


@register("word_counts")
def q_word_counts(spark, sf):
    docs = parse.parse_documents(by_document(S.pages(spark, sf), "page_id", text_col="html"))
    return index.postings_tf(docs, by_id=True).select("doc_id", "word", "cnt", "n_tokens")


@register("postings")
def q_postings(spark, sf):
    return _postings(spark, sf).select("word", "doc_id", r10("tf"), r10("idf"), r10("weight"))


@register("doc_frequency")
def q_doc_frequency(spark, sf):
    docs, _, counts = parse.parse_corpus(S.pages(spark, sf))
    df = index.doc_frequency(index.postings_tf(docs))
    return df.withColumn("n", F.lit(counts["accepted"]).cast("long")).select(
        "word", "df", F.round(F.ln(F.expr("n div df").cast("double")), 10).alias("idf"))


@register("postings_documents")
def q_postings_documents(spark, sf):
    p = index.build_postings(S.document_table(spark, sf))
    return p.select("word", "doc_id", r10("tf"), r10("idf"), r10("weight"))


@register("champions")
def q_champions(spark, sf):
    c = index.champions(_postings(spark, sf))
    return c.select("word", "doc_id", F.col("word_rank").cast("long").alias("word_rank"), r10("weight"))


# ---------------------------------------------------------------------- search

def _search_out(res: DataFrame) -> DataFrame:
    return res.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "word",
                      r10("weight"), "title", "url", "desc")


@register("search_topk")
def q_search_topk(spark, sf):
    pages = S.pages(spark, sf)
    # the best 101 postings of a word are all that a top-101 answer can hold
    post = index.champions(_postings(spark, sf))
    return _search_out(search.search(S.benchmark_queries(spark, sf), post, pages))


@register("search_topk_full")
def q_search_topk_full(spark, sf):
    """The same answer from all postings."""
    pages = S.pages(spark, sf)
    post = _postings(spark, sf)
    return _search_out(search.search(S.benchmark_queries(spark, sf), post, pages))


@register("search_topk_champions")
def q_search_topk_champions(spark, sf):
    pages = S.pages(spark, sf)
    champ = index.champions(_postings(spark, sf))
    return _search_out(search.search(S.benchmark_queries(spark, sf), champ, pages))


@register("search_conversations")
def q_search_conversations(spark, sf):
    pages = S.pages(spark, sf)
    post = index.champions(_postings(spark, sf))
    return _search_out(search.search(S.conversation_queries(spark, sf), post, pages))


@register("search_json")
def q_search_json(spark, sf):
    pages = S.pages(spark, sf)
    post = index.champions(_postings(spark, sf))
    queries = S.benchmark_queries(spark, sf)
    return search.results_json(queries, search.search(queries, post, pages))


@register("search_topk_blocks")
def q_search_topk_blocks(spark, sf):
    """The first 10, 101 and 500 documents of each query from a block table."""
    from trawl.operators import block_index as B

    pages, queries = S.pages(spark, sf), S.benchmark_queries(spark, sf)
    name = B.write_blocks(B.blocks(_postings(spark, sf)))
    try:
        found = [_search_out(B.search(queries, spark.table(name), pages, k)).withColumn("k", F.lit(k).cast("long"))
                 for k in (10, 101, 500)]
    finally:
        B.drop(spark, name)
    return found[0].unionByName(found[1]).unionByName(found[2])


@register("query_words")
def q_query_words(spark, sf):
    return search.query_words(S.benchmark_queries(spark, sf))


@register("query_key")
def q_query_key(spark, sf):
    return search.query_key(S.benchmark_queries(spark, sf))


# ------------------------------------------------------------ sources / sinks

@register("corpus_scan")
def q_corpus_scan(spark, sf):
    """Pages written out as one file per page, scanned back recursively."""
    from trawl.session import scratch_path
    from trawl.sources import corpus as C

    root = scratch_path(spark, "corpus")
    C.write_pages(S.pages(spark, sf), root)
    docs = C.corpus_documents(spark, root, "https://docs.example/", glob="*.txt")
    page_id = F.regexp_extract("path", r"page_id=([0-9]+)", 1).cast("long")
    return docs.select("doc_id", page_id.alias("page_id"), "title", "content")


@register("docs_roundtrip")
def q_docs_roundtrip(spark, sf):
    from trawl.session import scratch_path
    from trawl.sources import corpus as C

    path = scratch_path(spark, "docs_table")
    C.write_docs(_docs(spark, sf), path)
    return C.read_docs(spark, path)


@register("delimited_roundtrip")
def q_delimited_roundtrip(spark, sf):
    from trawl.session import scratch_path
    from trawl.sources import corpus as C

    path = scratch_path(spark, "records")
    C.write_records(_docs(spark, sf), path)
    return C.read_records(spark, path)


def _request_log(spark, sf):
    """Request log derived from the data: a search request per ``benchmark``
    text, and a request without the query parameter per assistant turn."""
    b = S.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("request_id"),
        F.concat(F.lit("http://search.example/find?query="),
                 F.call_function("url_encode", F.col("text"))).alias("url"))
    c = (S.table(spark, sf, "conversations").where(F.col("role") == "assistant")
         .select((-(F.col("conv_id") * 1000 + F.col("turn")) - 1).alias("request_id"),
                 F.concat(F.lit("http://search.example/find?turn="),
                          F.col("turn").cast("string")).alias("url")))
    return b.unionByName(c)


@register("request_queries")
def q_request_queries(spark, sf):
    from trawl.sources import corpus as C

    return C.requests_with_query(_request_log(spark, sf))


@register("search_requests")
def q_search_requests(spark, sf):
    """The search answered for the requests of the log (JSON per request)."""
    from trawl.sources import corpus as C

    pages = S.pages(spark, sf)
    post = index.champions(_postings(spark, sf))
    qs = C.requests_with_query(_request_log(spark, sf)).withColumnRenamed("request_id", "query_id")
    return search.results_json(qs, search.search(qs, post, pages))
