"""Registered queries for tokens, keywords, lexicon jobs, segmentation and
query logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.operators import keywords as K
from trawl.operators import parse, tokenize
from trawl.plans.catalog import r10, register
from trawl.session import materialize
from trawl.sources import tables as S

STOP_K = 50
TOP_N = 5


def _documents(spark, sf):
    return S.documents(spark, sf).select("doc_id", "text")


def _stop(spark, sf):
    return K.stop_words_by_frequency(_documents(spark, sf), STOP_K)


def _idf(spark, sf):
    docs, _, counts = parse.parse_corpus(S.pages(spark, sf))
    return K.build_idf(docs, counts["accepted"])


# ---------------------------------------------------------------- tokens

@register("presplit")
def q_presplit(spark, sf):
    return tokenize.presplit(_documents(spark, sf)).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "piece")


@register("token_offsets")
def q_token_offsets(spark, sf):
    docs = tokenize.by_document(_documents(spark, sf))
    return tokenize.token_offsets(docs).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "word", "offset", "unicode_offset",
        "unicode_length")


@register("code_points")
def q_code_points(spark, sf):
    return tokenize.code_points(_documents(spark, sf)).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "code", "byte_len")


# ---------------------------------------------------------------- keywords

@register("stop_words")
def q_stop_words(spark, sf):
    return _stop(spark, sf)


@register("idf_table")
def q_idf_table(spark, sf):
    return _idf(spark, sf).select("word", r10("idf"))


@register("keywords_tfidf")
def q_keywords_tfidf(spark, sf):
    kw = K.extract_keywords(_documents(spark, sf), _idf(spark, sf), _stop(spark, sf), TOP_N)
    return kw.select("doc_id", F.col("rank").cast("long").alias("rank"), "word",
                     F.array_join("offsets", ",").alias("offsets"), r10("weight"))


@register("textrank_edges")
def q_textrank_edges(spark, sf):
    kept = K.keyword_tokens(_documents(spark, sf), _stop(spark, sf))
    return K.cooccurrence_edges(kept)


@register("keywords_textrank")
def q_keywords_textrank(spark, sf):
    kw = K.textrank_keywords(_documents(spark, sf), _stop(spark, sf), TOP_N)
    return kw.select("doc_id", F.col("rank").cast("long").alias("rank"), "word",
                     F.array_join("offsets", ",").alias("offsets"), r10("weight"))


# ---------------------------------------------------------------- query log

LOG_KEYS = ["user_id", "event_type"]


def _events(spark, sf):
    return S.table(spark, sf, "events")


@register("cache_labels")
def q_cache_labels(spark, sf):
    from trawl.operators import querylog as QL

    lab = QL.with_session_start(QL.cache_labels(_events(spark, sf), LOG_KEYS), LOG_KEYS)
    return lab.select(F.col("lookup_id").alias("event_id"), *LOG_KEYS, "ts_us",
                      F.col("hit").cast("long").alias("hit"), "session_start_us")


@register("cache_sessions")
def q_cache_sessions(spark, sf):
    from trawl.operators import querylog as QL

    return QL.cache_sessions(_events(spark, sf), LOG_KEYS)


@register("cache_sessions_by_type")
def q_cache_sessions_by_type(spark, sf):
    from trawl.operators import querylog as QL

    return QL.cache_sessions(_events(spark, sf), ["event_type"])


@register("cache_sessions_stream")
def q_cache_sessions_stream(spark, sf):
    """All look-ups as a stream of several files, some of them late."""
    from trawl.session import scratch_path
    from trawl.streaming import cache_sessions as CS

    path = scratch_path(spark, "stream_source")
    _events(spark, sf).repartitionByRange(6, "ts").write.parquet(path)
    return CS.run_merged(spark, path, LOG_KEYS, max_files_per_trigger=2)


@register("cache_sessions_stream_closed")
def q_cache_sessions_stream_closed(spark, sf):
    from trawl.streaming import cache_sessions as CS

    return CS.run_available(spark, f"{sf.rstrip('/')}/events.parquet", LOG_KEYS)


# ---------------------------------------------------------------- lexicon jobs

def _base_lexicon(spark, sf):
    """Lexicon derived from the data: letter words of ``benchmark`` with counts."""
    from trawl.operators import lexicon as LX

    return LX.lexicon_from_text(S.table(spark, sf, "benchmark"), "text", "n")


def _user_lines(spark, sf):
    """User-lexicon lines derived from page titles: a title word seen once is
    a bare word, twice ``word nz``, more often ``word count nz``."""
    from trawl.operators import lexicon as LX

    titles = parse.parse_documents(S.pages(spark, sf)).select("title")
    counts = (titles.select(F.explode(F.regexp_extract_all("title", F.lit(LX.LEXICON_WORD_RE), 0))
                            .alias("word")).groupBy("word").count())
    line = (F.when(F.col("count") == 1, F.col("word"))
            .when(F.col("count") == 2, F.concat_ws(" ", "word", F.lit("nz")))
            .otherwise(F.concat_ws(" ", "word", F.col("count").cast("string"), F.lit("nz"))))
    return counts.select(line.alias("value"))


def _overlay(spark, sf):
    from trawl.operators import lexicon as LX

    return LX.overlay(_base_lexicon(spark, sf), LX.parse_user_lines(_user_lines(spark, sf)))


@register("lexicon_load")
def q_lexicon_load(spark, sf):
    from trawl.operators import lexicon as LX
    from trawl.session import scratch_path
    from trawl.sources import dictionaries as D

    path = scratch_path(spark, "lexicon")
    LX.lexicon_lines(_base_lexicon(spark, sf)).write.text(path)
    return D.load_lexicon(spark, path).select("word", "freq", "tag")


@register("lexicon_stats")
def q_lexicon_stats(spark, sf):
    from trawl.operators import lexicon as LX

    st = LX.lexicon_stats(_base_lexicon(spark, sf))
    return st.select("n_words", "freq_sum", r10("min_weight"), r10("max_weight"), r10("median_weight"))


@register("lexicon_overlay")
def q_lexicon_overlay(spark, sf):
    return _overlay(spark, sf).select("word", r10("weight"), "tag", "is_user")


@register("lexicon_lookup")
def q_lexicon_lookup(spark, sf):
    from trawl.operators import lexicon as LX

    words = (_documents(spark, sf).select(F.explode(F.regexp_extract_all(
        "text", F.lit(LX.LEXICON_WORD_RE), 0)).alias("word")).distinct())
    return LX.lookup(words, _overlay(spark, sf)).select("word", "in_lexicon", "tag")


@register("token_tags")
def q_token_tags(spark, sf):
    from trawl.operators import lexicon as LX

    words = _documents(spark, sf).select(F.explode(
        F.call_function("regexp_extract_all", F.col("text"),
                        F.lit(r"[A-Za-z][A-Za-z0-9]*|[0-9][0-9.]*|(?s:.)"), F.lit(0))).alias("word")).distinct()
    from trawl.functions import text as TX

    return LX.tag_tokens(words, _overlay(spark, sf)).select(
        "word", "tag", TX.is_ascii("word").alias("is_ascii"), TX.is_single_char("word").alias("is_single"))


def _pieces(docs):
    return tokenize.presplit(tokenize.by_document(docs)).withColumnRenamed("pos", "piece_pos")


@register("dag_edges")
def q_dag_edges(spark, sf):
    from trawl.operators import lexicon as LX

    # weights are rounded once a word, not once an edge
    lex = _overlay(spark, sf).withColumn("weight", r10("weight"))
    e = LX.dag_edges(_pieces(_documents(spark, sf)), lex, columns=("word", "weight"))
    return e.select("doc_id", F.col("piece_pos").cast("long").alias("piece_pos"),
                    F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
                    "word", "weight")


@register("segment_full")
def q_segment_full(spark, sf):
    return _full(_documents(spark, sf), materialize(_overlay(spark, sf), "overlay"))


def _full(docs, lex):
    """The full cut.  Only the pieces of rows that share their id, or have none, are brought together."""
    from trawl.operators import lexicon as LX

    alone, together = tokenize.by_own_id(docs)
    e = LX.full_cut(LX.dag_edges(_pieces(alone), lex, columns=("text", "stays")))
    if together is not None:
        e = e.unionByName(LX.full_cut(LX.dag_edges(_pieces(together), lex)))
    return e.select("doc_id", F.col("piece_pos").cast("long").alias("piece_pos"),
                    F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "word")


def _segment(spark, sf, mode, max_word_len=512):
    from trawl.operators import segment as SG

    # unknown characters are priced at the smallest weight of the static lexicon
    return SG.segment(_documents(spark, sf), _overlay(spark, sf), mode=mode, max_word_len=max_word_len,
                      base=_base_lexicon(spark, sf))


@register("segment_mp")
def q_segment_mp(spark, sf):
    return _segment(spark, sf, "mp")


@register("segment_mp_capped")
def q_segment_mp_capped(spark, sf):
    return _segment(spark, sf, "mp", max_word_len=3)


@register("segment_hmm_empty_model")
def q_segment_hmm_empty_model(spark, sf):
    return _segment(spark, sf, "hmm")


@register("segment_mix")
def q_segment_mix(spark, sf):
    return _segment(spark, sf, "mix")


@register("segment_search")
def q_segment_search(spark, sf):
    from trawl.operators import lexicon as LX

    return LX.search_cut(_segment(spark, sf, "mix"), _overlay(spark, sf))


@register("pos_tags")
def q_pos_tags(spark, sf):
    from trawl.operators import lexicon as LX

    return LX.tag_tokens(_segment(spark, sf, "mix"), _overlay(spark, sf)).select("doc_id", "pos", "word", "tag")


@register("idf_load")
def q_idf_load(spark, sf):
    """IDF table written as ``word idf`` lines and loaded back; the average
    uses every line in its denominator."""
    from trawl.session import scratch_path
    from trawl.sources import dictionaries as D

    path = scratch_path(spark, "idf")
    _idf(spark, sf).select(F.concat_ws(" ", "word", F.col("idf").cast("string")).alias("value")) \
        .write.text(path)
    idf, n_lines = D.load_idf(spark, path)
    avg = K.idf_average(idf, n_lines=n_lines)
    return idf.select("word", r10("idf")).withColumn("avg_idf", F.round(avg, 10))


@register("stop_words_load")
def q_stop_words_load(spark, sf):
    from trawl.session import scratch_path
    from trawl.sources import dictionaries as D

    path = scratch_path(spark, "stop")
    _stop(spark, sf).write.text(path)
    return D.load_stop_words(spark, path)
