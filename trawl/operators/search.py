"""Batch keyword search: many OR queries at once against the postings.

Per query: words = tokens starting with a letter after ASCII lower-casing;
postings of all words are pooled; each document keeps its best posting
(max weight, then smallest word); documents rank by (weight desc, doc_id asc);
the first ``k`` (101) are returned with title, url and a snippet around the
best word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.operators.index import rank_key
from trawl.operators.parse import parsed_columns
from trawl.session import bounded_broadcast, materialize, spread

# Upper bounds on row widths used for size-checked broadcasts (bytes).
QUERY_WORD_ROW_BYTES = 96
HIT_ROW_BYTES = 64
DOC_ID_ROW_BYTES = 16


def query_words(queries: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """(query_id, word), distinct: lower-cased tokens that start with [a-z]."""
    toks = queries.select(F.col(id_col).alias("query_id"),
                          F.explode(T.letter_runs(text_col)).alias("word"))
    return kept_query_words(toks)


def kept_query_words(tokens: DataFrame) -> DataFrame:
    """(query_id, word), distinct, from the queries' tokens (query_id, word)."""
    return (tokens.select("query_id", T.ascii_lower("word").alias("word"))
            .where(T.starts_with_lower_letter("word"))
            .dropDuplicates(["query_id", "word"]))


WORD_SLOTS = 10**9
_DEC = "decimal(38,0)"


def best_hits(qwords: DataFrame, postings: DataFrame, k: int = T.RESULT_LIMIT,
              n_query_words: int | None = None) -> DataFrame:
    """(query_id, doc_id, word, weight, rank) -- the top ``k`` per query.

    ``postings`` may be the full postings or the ``champions`` table; both
    give the same answer.  The query-word side is broadcast when its counted
    size fits the threshold; the postings side is streamed, never shuffled.

    The best posting of a document is the one with the highest weight
    (compared rounded to 12 digits), ties to the smallest word.  Each query's
    words are ranked once on the small query-word table, and (weight, word
    rank) is packed into one DECIMAL(38,0) key, so the per-(query, document)
    step is a hash aggregate with map-side partial aggregation (a struct
    minimum would force a sort-based aggregate over every hit).
    """
    if n_query_words is None:
        n_query_words = qwords.count()
    ranked_words = qwords.withColumn(
        "wr", F.dense_rank().over(Window.partitionBy("query_id").orderBy("word")))
    if "word_rank" in postings.columns:
        hits = promising_hits(ranked_words, postings, k, n_query_words)
    else:
        qw = bounded_broadcast(ranked_words, n_query_words, QUERY_WORD_ROW_BYTES)
        hits = postings.select("word", "doc_id", "weight").join(qw, "word")
    slots = F.lit(WORD_SLOTS).cast(_DEC)
    key = ((rank_key() * F.lit(1e12)).cast(_DEC) * slots
           + (F.lit(WORD_SLOTS - 1) - F.col("wr")).cast(_DEC)).cast(_DEC)
    best = (hits.groupBy("query_id", "doc_id")
            .agg(F.max(key).alias("bk"), F.max("weight").alias("weight"))
            .withColumn("wr", (F.lit(WORD_SLOTS - 1) - (F.col("bk") % slots)).cast("int"))
            .withColumn("wk", F.expr(f"bk div {WORD_SLOTS}")))
    # documents rank by weight alone (the word part only breaks ties inside a document)
    w = Window.partitionBy("query_id").orderBy(F.desc("wk"), F.col("doc_id"))
    top = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    words = bounded_broadcast(ranked_words.select("query_id", "wr", "word"), n_query_words,
                              QUERY_WORD_ROW_BYTES)
    return top.join(words, ["query_id", "wr"]).select("query_id", "doc_id", "word", "weight", "rank")


def promising_hits(qwords: DataFrame, champions: DataFrame, k: int, n_query_words: int) -> DataFrame:
    """(query_id, word, wr, doc_id, weight): the hits of a query that can be among its first ``k``.

    A word with ``k`` documents promises that the query's k-th best weighs no
    less than the word's k-th.  What weighs less than the best such promise of a
    query's words is left out, whole words before the join: frequent words are
    in most queries and weigh least.
    """
    # one row a word, read twice
    words = materialize(champions.groupBy("word").agg(
        F.max(rank_key()).alias("most"), F.max(F.when(F.col("word_rank") == k, rank_key())).alias("kth")), "word_weights")
    known = qwords.join(words, "word")
    least = known.groupBy("query_id").agg(F.max("kth").alias("least"))
    going = known.join(least, "query_id").where(F.col("least").isNull() | (F.col("most") >= F.col("least")))
    qw = bounded_broadcast(going.select("query_id", "word", "wr", "least"), n_query_words, QUERY_WORD_ROW_BYTES)
    hits = champions.select("word", "doc_id", "weight").join(qw, "word")
    return hits.where(F.col("least").isNull() | (rank_key() >= F.col("least"))).drop("least")


def attach_documents(top: DataFrame, docs: DataFrame, n_rows_bound: int) -> DataFrame:
    """Join ranked hits with their documents and cut the snippet.

    ``docs`` is either a parsed document table (doc_id, title, url, content)
    or raw pages (page_id, url, html).  The hit side holds at most
    ``n_rows_bound`` rows (queries x k), which decides the broadcast.

    Raw pages are parsed only when matched, and once however many queries
    found them: a semi join against the matched ids (broadcast under the
    same bound) cuts the pages down first, then they are parsed, then joined
    with the hits.
    """
    small = bounded_broadcast(top, n_rows_bound, HIT_ROW_BYTES)
    if "content" not in docs.columns:
        title, content = parsed_columns("html")
        ids = bounded_broadcast(top.select("doc_id").distinct(), n_rows_bound, DOC_ID_ROW_BYTES)
        matched = spread(docs.withColumnRenamed("page_id", "doc_id").join(ids, "doc_id", "left_semi"),
                         basis=docs)
        parsed = matched.select("doc_id", "url", title, content)
        joined = parsed.join(small, "doc_id")
    else:
        joined = docs.select("doc_id", "title", "url", "content").join(small, "doc_id")
    return joined.select("query_id", "rank", "doc_id", "word", "weight", "title", "url",
                         T.snippet("content", "word").alias("desc"))


def search(queries: DataFrame, postings: DataFrame, docs: DataFrame,
           k: int = T.RESULT_LIMIT, id_col: str = "query_id", text_col: str = "query",
           qw: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, doc_id, word, weight, title, url, desc) for a query batch.
    ``qw``: the queries' words, of run tokens unless given."""
    qw = query_words(queries, id_col, text_col) if qw is None else qw
    n_queries = queries.count()
    # at most queries x k rows, read twice (matched ids, hits): computed once
    top = materialize(best_hits(qw, postings, k, n_query_words=None), "search_hits")
    return attach_documents(top, docs, n_queries * k)


def results_json(queries: DataFrame, results: DataFrame, id_col: str = "query_id") -> DataFrame:
    """(query_id, json): JSON array of {desc, title, url} in rank order, or
    ``null`` for a query without hits; each followed by a newline.

    The per-query list is bounded by k rows, so ``collect_list`` is safe.
    """
    per_query = (results.groupBy("query_id")
                 .agg(F.array_sort(F.collect_list(F.struct("rank", "desc", "title", "url")))
                      .alias("r")))
    as_json = F.to_json(F.transform("r", lambda x: F.struct(x["desc"].alias("desc"),
                                                            x["title"].alias("title"),
                                                            x["url"].alias("url"))))
    q = queries.select(F.col(id_col).alias("query_id"))
    return (q.join(per_query, "query_id", "left")
            .select("query_id",
                    F.concat(F.coalesce(as_json, F.lit("null")), F.lit("\n")).alias("json")))


def query_key(queries: DataFrame, id_col: str = "query_id", text_col: str = "query",
              delimiter: str = "") -> DataFrame:
    """(query_id, query_key, n_tokens): the canonical cache key of each query.

    The reference joins the ordered words with no delimiter, so different
    word lists may share a key; pass a ``delimiter`` to keep them apart."""
    toks = T.latin_tokens(text_col)
    return queries.select(F.col(id_col).alias("query_id"),
                          T.canonical_key(toks, delimiter).alias("query_key"),
                          F.size(toks).cast("long").alias("n_tokens"))
