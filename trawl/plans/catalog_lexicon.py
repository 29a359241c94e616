"""Registered queries over lexicon tokens and an HMM with emissions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from trawl.operators import hmm, index, parse, search, tokenize
from trawl.operators import keywords as K
from trawl.operators import lexicon as LX
from trawl.operators import lexicon_index as LI
from trawl.operators import segment as SG
from trawl.plans.catalog import _search_out, r10, register
from trawl.plans.catalog_text import TOP_N, _base_lexicon, _documents, _idf, _overlay, _stop
from trawl.session import materialize, scratch_path
from trawl.sources import tables as S


def _model(spark, sf) -> SG.HmmModel:
    """Estimated from the words of ``documents``, written as a model file and loaded."""
    path = scratch_path(spark, "hmm_model")
    hmm.write_model(LX.lexicon_from_text(S.documents(spark, sf), "text", "n"), path)
    return SG.load_hmm_model(spark, path)


@register("hmm_model_load")
def q_hmm_model_load(spark, sf):
    return hmm.model_rows(spark, _model(spark, sf))


@register("segment_hmm")
def q_segment_hmm(spark, sf):
    return SG.segment(_documents(spark, sf), None, "hmm", _model(spark, sf))


@register("segment_mix_hmm")
def q_segment_mix_hmm(spark, sf):
    return SG.segment(_documents(spark, sf), _overlay(spark, sf), "mix", _model(spark, sf), base=_base_lexicon(spark, sf))


@register("segment_offsets")
def q_segment_offsets(spark, sf):
    """Every cut with its tokens' places: one row a cut and document, with the number
    of tokens and the MD5 of ``word:offset:unicode_offset:unicode_length`` in order."""
    return _places(_documents(spark, sf), materialize(_overlay(spark, sf), "overlay"),
                   materialize(_base_lexicon(spark, sf), "base_lexicon"), _model(spark, sf))


def _places(docs, lex, base, model):
    """(mode, doc_id, n_tokens, places_md5).  A document is digested where it is cut; only
    the tokens of rows that share their id, or have none, are brought together."""
    alone, together = tokenize.by_own_id(docs)
    cuts = [SG.digests(alone, lex, SG.MODES, model, base)]
    place = F.concat_ws(":", "word", "offset", "unicode_offset", "unicode_length")
    for m in SG.MODES if together is not None else ():
        tokens = SG.segment(together, lex, m, model, base=base, offsets=True).withColumn("mode", F.lit(m))
        cuts.append(tokens.groupBy("mode", "doc_id").agg(
            F.count(F.lit(1)).alias("n_tokens"),
            F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", place.alias("p")))), lambda x: x["p"]), ","))
            .alias("places_md5")))
    return reduce(lambda a, b: a.unionByName(b), cuts)


def _lexicon_postings(spark, sf):
    return LI.build_postings(parse.parse_documents(S.pages(spark, sf)), _overlay(spark, sf), _model(spark, sf),
                             _base_lexicon(spark, sf))


@register("postings_lexicon")
def q_postings_lexicon(spark, sf):
    return _lexicon_postings(spark, sf).select("word", "doc_id", r10("tf"), r10("idf"), r10("weight"))


@register("search_lexicon")
def q_search_lexicon(spark, sf):
    queries = S.benchmark_queries(spark, sf)
    words = LI.query_words(queries, _overlay(spark, sf), _model(spark, sf), _base_lexicon(spark, sf))
    return _search_out(search.search(queries, index.champions(_lexicon_postings(spark, sf)), S.pages(spark, sf), qw=words))


@register("keywords_tfidf_lexicon")
def q_keywords_tfidf_lexicon(spark, sf):
    docs = _documents(spark, sf)
    tokens = LI.keyword_tokens(docs, _overlay(spark, sf), _model(spark, sf), _base_lexicon(spark, sf))
    kw = K.extract_keywords(docs, _idf(spark, sf), _stop(spark, sf), TOP_N, tokens=tokens)
    return kw.select("doc_id", F.col("rank").cast("long").alias("rank"), "word",
                     F.array_join("offsets", ",").alias("offsets"), r10("weight"))


@register("index_increment")
def q_index_increment(spark, sf):
    """An index of the pages made in three batches, by page."""
    from trawl.operators import increment as I

    root, pages = scratch_path(spark, "growing_index"), S.pages(spark, sf)
    for i in range(3):
        I.append(root, i, pages.where(F.pmod(F.xxhash64("page_id"), F.lit(3)) == i))
    ids = I.documents(spark, root, 3).select("doc_id", "page_id")
    return I.postings(spark, root, 3).join(ids, "doc_id").select(
        "word", F.col("page_id").alias("doc_id"), r10("tf"), r10("idf"), r10("weight"))


@register("user_lexicon_load")
def q_user_lexicon_load(spark, sf):
    """User lexicon files: a directory of part files that has every word of
    ``benchmark`` twice, then one with the words of the page titles; the last line
    of a word counts (freq 0: none given)."""
    from trawl.plans.catalog_text import _user_lines
    from trawl.sources import dictionaries as D

    first, second = scratch_path(spark, "user_lexicon"), scratch_path(spark, "user_lexicon")
    words = _base_lexicon(spark, sf).select("word", F.explode(F.array(F.lit(0), F.lit(1))).alias("again"), "freq")
    line = F.when(F.col("again") == 0, F.concat_ws(" ", "word", F.lit("early"))).otherwise(
        F.concat_ws(" ", "word", F.col("freq").cast("long").cast("string"), F.lit("late")))
    words.repartitionByRange(7, "again", "word").sortWithinPartitions("again", "word").select(line.alias("value")).write.text(first)
    _user_lines(spark, sf).write.text(second)
    lines = D.load_user_lexicon(spark, f"{first}|{second}")
    return lines.groupBy("word").agg(F.max_by(F.struct("freq", "tag"), "line_no").alias("x")).select(
        "word", F.coalesce(F.col("x.freq"), F.lit(0)).cast("long").alias("freq"), "x.tag")
