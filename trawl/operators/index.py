"""Inverted index: postings (word, doc_id, tf, idf, weight) and the top-k
``champions`` table.

Plan shape (see README "Plans"):

* per-document counts: whole documents are partitioned by id, in partitions
  of a few MB of text; one generator over title+body tokens, then a hash
  aggregate on (doc_id, word), which needs no exchange of its own and holds
  the words of one partition.
* document frequency: ``groupBy(word).count()`` -- partial aggregate per task,
  so even a word present in every document sends one row per task.
* weight: postings joined with the df table on ``word``.  AQE turns this into
  a broadcast join when the measured df table is small; otherwise it is a
  sort-merge join whose hot-word partitions AQE's skew-join rule splits.
* corpus size: a scalar subquery (``DataFrame.scalar()``), not a cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.operators.tokenize import by_document
from trawl.session import materialize


def word_counts(docs: DataFrame, by_id: bool = False) -> DataFrame:
    """(doc_id, word, title_hits, body_hits, n_tokens) per document and word.

    Words are tokens starting with an ASCII letter, lower-cased; ``n_tokens``
    counts every token of title and body (spaces and punctuation included).
    Title and body words go through one ``posexplode`` (title first), so the
    document is read and tokenized once; no lambda functions are involved,
    keeping the stage in whole-stage codegen.

    Documents are partitioned by id, in as many partitions as their bytes ask for
    (``by_id``: they are already), so that the words of few documents are counted
    at a time, in the task that tokenizes them.
    """
    tw = T.letter_runs("title")
    bw = T.letter_runs("content")
    per_doc = (docs if by_id else by_document(docs, text_col="content")).select(
        "doc_id",
        (T.token_count("title") + T.token_count("content")).cast("long").alias("n_tokens"),
        F.size(tw).alias("n_title"),
        F.concat(tw, bw).alias("ws"),
    )
    # posexplode_outer + an explicit null filter: plain explode makes Catalyst
    # infer a ``size(ws) > 0`` filter below the projection, which would run
    # the tokenizer twice per document.
    words = (per_doc.select("doc_id", "n_tokens", "n_title",
                            F.posexplode_outer("ws").alias("p", "w"))
             .where(F.col("w").isNotNull())
             .select("doc_id", "n_tokens", F.lower("w").alias("word"),
                     (F.col("p") < F.col("n_title")).alias("in_title")))
    return (words.groupBy("doc_id", "word")
            .agg(F.sum(F.col("in_title").cast("long")).alias("title_hits"),
                 F.sum((~F.col("in_title")).cast("long")).alias("body_hits"),
                 F.first("n_tokens").alias("n_tokens")))


def postings_tf(docs: DataFrame, by_id: bool = False) -> DataFrame:
    """(doc_id, word, cnt, n_tokens, tf) with cnt = 10 x title hits + body hits."""
    return weighted_tf(word_counts(docs, by_id))


def weighted_tf(wc: DataFrame) -> DataFrame:
    """Word counts with cnt and tf."""
    cnt = F.col("title_hits") * T.TITLE_WEIGHT + F.col("body_hits") * T.BODY_WEIGHT
    return wc.select("doc_id", "word", cnt.alias("cnt"), "n_tokens",
                     (cnt / F.col("n_tokens")).alias("tf"))


def doc_frequency(postings_or_tf: DataFrame) -> DataFrame:
    """(word, df): number of documents holding the word (postings are unique per
    (doc, word), so a plain count)."""
    return postings_or_tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def corpus_size(docs: DataFrame):
    """Number of documents, as a scalar-subquery Column."""
    return docs.select(F.count(F.lit(1))).scalar()


def build_postings(docs: DataFrame, materialize_tf: bool = True, tf: DataFrame | None = None,
                   n_docs: int | None = None) -> DataFrame:
    """(word, doc_id, tf, idf, weight); idf = ln(N div df), weight = tf * idf.
    ``tf``: the documents' counts, of run tokens unless given (``lexicon_index``);
    ``n_docs``: N, where the pass that wrote the documents has counted them.

    The per-document counts feed both the df aggregate and the join, so they
    are written once to the shared checkpoint folder (``materialize_tf``)
    instead of tokenizing the corpus twice.
    """
    tf = postings_tf(docs) if tf is None else tf
    if materialize_tf:
        tf = materialize(tf, "postings_tf")
    df = doc_frequency(tf)
    n_docs = corpus_size(docs) if n_docs is None else F.lit(n_docs).cast("long")
    joined = tf.join(df, "word").withColumn("n_docs", n_docs)
    idf = F.ln(F.expr("n_docs div df").cast("double"))
    return joined.select("word", "doc_id", "tf", idf.alias("idf"),
                         (F.col("tf") * idf).alias("weight"))


def rank_key(col: str = "weight"):
    """Ordering key for weights: rounded to 12 digits so that last-bit
    differences between engines cannot swap ties."""
    return F.round(F.col(col), 12)


def champions(postings: DataFrame, k: int = T.RESULT_LIMIT) -> DataFrame:
    """Top ``k`` postings per word by (weight desc, doc_id asc).

    Exact for max-over-words OR queries: a document in a query's global top k
    is in the top k of its best word's list.  ``row_number() <= k`` plans a
    partial ``WindowGroupLimit`` before the exchange, so a word present in
    every document ships at most k rows per task.
    """
    w = Window.partitionBy("word").orderBy(rank_key().desc(), F.col("doc_id"))
    return (postings.withColumn("word_rank", F.row_number().over(w))
            .where(F.col("word_rank") <= k))
