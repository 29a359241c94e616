"""Index, search and keywords over lexicon tokens.

The search cut needs a lexicon and a model, and the same pieces (text between
separators) come back in document after document.  So a document becomes
counts of its distinct pieces (all pieces of a document are in one row: the map
side already collapses repeats), the distinct pieces of the corpus are cut
once, and a document's word counts are its piece counts times the tokens of the
piece.  What is exchanged are pieces and counts, never whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.operators import index, search
from trawl.operators import segment as SG
from trawl.operators.tokenize import separator_pattern
from trawl.session import materialize, spread


def piece_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, piece, title_n, body_n) of documents (doc_id, title, content)."""
    pattern = F.lit(separator_pattern())
    title, body = (F.regexp_extract_all(c, pattern, F.lit(0)) for c in ("title", "content"))
    rows = spread(docs).select("doc_id", F.size(title).alias("n_title"), F.concat(title, body).alias("ps"))
    # posexplode_outer: see index.word_counts
    pieces = rows.select("doc_id", "n_title", F.posexplode_outer("ps").alias("p", "piece")).where(F.col("piece").isNotNull())
    return pieces.groupBy("doc_id", "piece").agg(
        F.count_if(F.col("p") < F.col("n_title")).alias("title_n"), F.count_if(F.col("p") >= F.col("n_title")).alias("body_n"))


def word_counts(docs: DataFrame, lex: DataFrame, model: SG.HmmModel | None = None, base: DataFrame | None = None) -> DataFrame:
    """(doc_id, word, title_hits, body_hits, n_tokens), as ``index.word_counts`` but
    over the tokens of the search cut with lexicon and model: words are the tokens
    that start with an ASCII letter, lower-cased; ``n_tokens`` counts every token."""
    counts = materialize(piece_counts(docs), "piece_counts")
    cuts = materialize(SG.piece_words(counts.select("piece").distinct(), lex, "search", model, base=base)
                       .select("piece", "words"), "piece_words")
    sizes = counts.join(cuts.select("piece", F.size("words").alias("k")), "piece") \
        .groupBy("doc_id").agg(F.sum(F.col("k") * (F.col("title_n") + F.col("body_n"))).alias("n_tokens"))
    words = cuts.select("piece", F.explode("words").alias("word")).where(T.starts_with_ascii_letter("word")) \
        .groupBy("piece", T.ascii_lower("word").alias("word")).agg(F.count(F.lit(1)).alias("times"))
    hits = counts.join(words, "piece").groupBy("doc_id", "word").agg(
        F.sum(F.col("times") * F.col("title_n")).alias("title_hits"), F.sum(F.col("times") * F.col("body_n")).alias("body_hits"))
    return hits.join(sizes, "doc_id").select("doc_id", "word", "title_hits", "body_hits", "n_tokens")


def build_postings(docs: DataFrame, lex: DataFrame, model: SG.HmmModel | None = None, base: DataFrame | None = None) -> DataFrame:
    """(word, doc_id, tf, idf, weight) over lexicon tokens."""
    return index.build_postings(docs, tf=index.weighted_tf(word_counts(docs, lex, model, base)))


def query_words(queries: DataFrame, lex: DataFrame, model: SG.HmmModel | None = None, base: DataFrame | None = None,
                id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """(query_id, word), distinct: the queries' words by the same cut."""
    toks = SG.segment(queries, lex, "search", model, text_col=text_col, id_col=id_col, base=base)
    return search.kept_query_words(toks.select(F.col("doc_id").alias("query_id"), "word"))


def keyword_tokens(docs: DataFrame, lex: DataFrame, model: SG.HmmModel | None = None, base: DataFrame | None = None) -> DataFrame:
    """(doc_id, pos, word, offset) of the mixed cut, for ``keywords.extract_keywords``
    and ``keywords.textrank_keywords``."""
    return SG.segment(docs, lex, "mix", model, base=base, offsets=True).select("doc_id", "pos", "word", "offset")
