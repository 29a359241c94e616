"""HMM estimation, cuts with places, and index, search and keywords over lexicon tokens."""

import math
import re

import pytest
from pyspark.sql import functions as F

from trawl.functions.text import LATIN_TOKEN_RE
from trawl.operators import hmm, index, search
from trawl.operators import keywords as K
from trawl.operators import lexicon as LX
from trawl.operators import lexicon_index as LI
from trawl.operators import segment as SG
from trawl.plans import catalog_lexicon as CL
from trawl.plans import catalog_text as CT

from conftest import SF_SMALL


def lexicon(spark, words):
    return spark.createDataFrame([(w, float(f), "n") for w, f in words.items()], "word string, freq double, tag string")


def test_model_is_estimated_from_runs(spark, tmp_path):
    # runs: 中国 (x3), 中 (x1), 国家队 (x2); ASCII parts of a word do not count
    path = str(tmp_path / "model")
    hmm.write_model(lexicon(spark, {"中国": 3, "a中b": 1, "国家队": 2, "abc": 9}), path)
    m = SG.load_hmm_model(spark, path)
    assert math.isclose(m.start[0], math.log(5 / 6), abs_tol=1e-9) and math.isclose(m.start[3], math.log(1 / 6), abs_tol=1e-9)
    assert m.start[1] == m.start[2] == SG.MIN_DOUBLE
    assert math.isclose(m.trans[0][1], math.log(3 / 5), abs_tol=1e-9) and math.isclose(m.trans[0][2], math.log(2 / 5), abs_tol=1e-9)
    assert m.trans[2][1] == 0.0 and m.trans[1][0] == m.start[0] and m.trans[3][3] == m.start[3]
    assert set(m.emit[0]) == {"中", "国"} and set(m.emit[2]) == {"家"} and set(m.emit[3]) == {"中"}
    assert SG.hmm_cut("中国ab国家队", m) == ["中国", "ab", "国家队"]
    rows = {tuple(r)[:3]: r.log_p for r in hmm.model_rows(spark, m).collect()}
    assert ("move", "B", "M") in rows and ("move", "B", "B") not in rows and ("emit", "S", "中") in rows


def test_a_lexicon_without_runs_gives_a_model_that_knows_nothing(spark, tmp_path):
    path = str(tmp_path / "model")
    hmm.write_model(lexicon(spark, {"abc": 9}), path)
    assert SG.hmm_cut("éü", SG.load_hmm_model(spark, path)) == ["é", "ü"]


def test_registered_hmm_cut_differs_from_the_token_regex(spark):
    docs = CT._documents(spark, SF_SMALL)
    runs = {r[0] for r in docs.select(F.explode(F.regexp_extract_all("text", F.lit(LATIN_TOKEN_RE), 0))).distinct().collect()}
    words = {r[0] for r in CL.q_segment_hmm(spark, SF_SMALL).select("word").distinct().collect()}
    assert any(len(w) > 1 and not w.isascii() for w in words - runs)


TEXTS = [(1, "C++ and C, 中国人 naïve été x1.5\n\n"), (None, "été été"), (2, ""), (3, None), (1, "，。 a\tb"), (4, "zz" * 300 + " 中国中国")]
WORDS = {"C++": 5, "an": 2, "and": 9, "nd": 1, "中国": 4, "国人": 2, "中国人": 3, "été": 2, "té": 1, "zz": 3, "zzz": 1, "naï": 1}


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in TEXTS], "doc_id long, text string, pos int, word string")
    return docs, lexicon(spark, WORDS)


@pytest.mark.parametrize("mode", SG.MODES)
def test_places_and_both_ways_agree(spark, small, mode, monkeypatch):
    docs, lex = small
    model = SG.HmmModel(emit=[{"中": -1.0, "é": -1.0}, {"国": -1.0, "t": -1.0, "é": -1.0}, {}, {"人": -1.0, "ï": -0.5}])
    travel = sorted(map(str, SG.segment(docs, lex, mode, model, offsets=True).collect()))
    monkeypatch.setattr(SG, "LEXICON_LIMIT", -1)  # the lexicon is joined
    assert sorted(map(str, SG.segment(docs, lex, mode, model, offsets=True).collect())) == travel
    rows = SG.segment(docs.where("doc_id = 4"), lex, mode, model, offsets=True).orderBy("pos").collect()
    text = dict(TEXTS)[4]
    for r in rows:
        assert text[r.unicode_offset:r.unicode_offset + r.unicode_length] == r.word
        assert text.encode()[r.offset:].startswith(r.word.encode())
    if mode in ("mp", "hmm", "mix"):
        assert "".join(r.word for r in rows) == text


def test_full_and_search_cuts_equal_the_joined_ones(spark, small):
    docs, lex = small
    docs = docs.where("doc_id > 1")
    pieces = CT.tokenize.presplit(docs).withColumnRenamed("pos", "piece_pos")
    want = LX.full_cut(LX.dag_edges(pieces, lex)).select("doc_id", "word")
    assert sorted(map(tuple, SG.segment(docs, lex, "full").select("doc_id", "word").collect())) == sorted(map(tuple, want.collect()))
    want = LX.search_cut(SG.segment(docs, lex, "mix"), lex).orderBy("doc_id", "pos", "sub").collect()
    got = SG.segment(docs, lex, "search").orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.word) for r in got] == [(r.doc_id, r.word) for r in want]


def test_no_text_is_exchanged(spark, small):
    docs, lex = small
    plan = SG.segment(docs, lex, "mix")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning", plan)


def test_a_piece_of_a_million_characters(spark, small):
    text = "zz中国" * 250_000
    rows = SG.segment(spark.createDataFrame([(1, text)], "doc_id long, text string"), small[1], "mix").groupBy("word").count().collect()
    assert {r["word"]: r["count"] for r in rows} == {"zz": 250_000, "中国": 250_000}


def test_index_over_lexicon_tokens(spark, small):
    docs = spark.createDataFrame([(0, "C++", "u", "the C++ way, 中国人 and C++"), (1, "t", "u", "C plus"), (2, "t", "u", "")],
                                 "doc_id long, title string, url string, content string")
    got = {(r.doc_id, r.word): r for r in LI.word_counts(docs, small[1]).collect()}
    assert (got[0, "c++"].title_hits, got[0, "c++"].body_hits) == (1, 2)
    assert (0, "c") not in got and (1, "c") in got and got[0, "and"].body_hits == 1
    # the search cut also gives "an" and "nd" inside "and", and the two-character words of 中国人
    assert got[0, "an"].body_hits == 1 and got[0, "nd"].body_hits == 1
    tokens = SG.segment(docs.where("doc_id = 0").select("doc_id", F.concat("title", "content").alias("text")), small[1], "search")
    assert got[0, "c++"].n_tokens == tokens.count()
    post = index.champions(LI.build_postings(docs, small[1]))
    q = spark.createDataFrame([(7, "about C++"), (8, "")], "query_id long, query string")
    res = search.search(q, post, docs, qw=LI.query_words(q, small[1])).collect()
    assert [(r.query_id, r.doc_id, r.word) for r in res] == [(7, 0, "c++")]


def test_keywords_of_a_text_without_blanks(spark, small):
    docs = spark.createDataFrame([(1, "中国人中国人中国x")], "doc_id long, text string")
    tokens = LI.keyword_tokens(docs, small[1])
    stop = spark.createDataFrame([("xx",)], "word string")
    idf = spark.createDataFrame([("中国人", 2.0), ("中国", 1.0)], "word string, idf double")
    got = K.extract_keywords(docs, idf, stop, 5, tokens=tokens).orderBy("rank").collect()
    assert [(r.word, r.offsets, r.weight) for r in got] == [("中国人", [0, 9], 4.0), ("中国", [18], 1.0)]
    assert {r.word for r in K.textrank_keywords(docs, stop, 5, tokens=tokens).collect()} == {"中国人", "中国"}
