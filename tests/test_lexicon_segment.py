"""Lexicon jobs and segmentation against the reference's goldens, with
small hand-made lexicons (the reference's main dictionary is not shipped)."""

import itertools
import math

from hypothesis import given, settings
from hypothesis import strategies as st

from trawl.operators import lexicon as LX
from trawl.operators import segment as SG
from trawl.operators.tokenize import presplit


def lex(spark, rows, user=False):
    df = spark.createDataFrame([(w, float(f), t) for w, f, t in rows], "word string, freq double, tag string")
    return df


def cut(spark, text, lexicon, mode="mp", max_word_len=512, model=None, base=None):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    out = SG.segment(docs, lexicon, mode=mode, max_word_len=max_word_len, model=model, base=base)
    return "/".join(r["word"] for r in out.orderBy("pos").collect())


NANJING = [("南京", 10, "ns"), ("南京市", 30, "ns"), ("市长", 20, "n"), ("长江", 30, "ns"),
           ("大桥", 30, "n"), ("长江大桥", 40, "ns"), ("江大桥", 1, "n"), ("京", 1, "n"), ("市", 1, "n")]


def test_max_probability_with_caps(spark):
    lx = lex(spark, NANJING)
    assert cut(spark, "南京市长江大桥", lx) == "南京市/长江大桥"
    assert cut(spark, "南京市长江大桥", lx, max_word_len=3) == "南京市/长江/大桥"
    assert cut(spark, "南京市长江大桥", lx, max_word_len=0) == "南/京/市/长/江/大/桥"


def test_candidate_graph_sizes(spark):
    lx = lex(spark, [("长江", 5, "n"), ("长江大桥", 5, "n"), ("大桥", 5, "n")])
    pieces = presplit(spark.createDataFrame([(1, "长江大桥")], "doc_id long, text string")) \
        .withColumnRenamed("pos", "piece_pos")
    for cap, sizes in ((512, [3, 1, 2, 1]), (3, [2, 1, 2, 1]), (4, [3, 1, 2, 1])):
        e = LX.dag_edges(pieces, lx, cap).groupBy("start").count().orderBy("start").collect()
        assert [r["count"] for r in e] == sizes


def test_full_cut_golden(spark):
    words = ["我", "来到", "北京", "清华", "清华大学", "华大", "大学", "来", "到", "北", "京", "华", "学"]
    lx = lex(spark, [(w, 3, "n") for w in words])
    pieces = presplit(spark.createDataFrame([(1, "我来到北京清华大学")], "doc_id long, text string")) \
        .withColumnRenamed("pos", "piece_pos")
    out = LX.full_cut(LX.dag_edges(pieces, lx)).orderBy("start", "end").collect()
    assert "/".join(r["word"] for r in out) == "我/来到/北京/清华/清华大学/华大/大学"


def test_search_cut_golden(spark):
    lx = lex(spark, [("中国", 5, "ns"), ("科学", 5, "n"), ("学院", 5, "n"), ("科学院", 5, "nt"),
                     ("中国科学院", 50, "nt")])
    docs = spark.createDataFrame([(1, "中国科学院")], "doc_id long, text string")
    toks = SG.segment(docs, lx, mode="mix")
    out = LX.search_cut(toks, lx).orderBy("pos", "sub").collect()
    assert "/".join(r["word"] for r in out) == "中国/科学/学院/科学院/中国科学院"


def test_user_single_chars_break_letter_runs(spark):
    base = lex(spark, [("x", 5, "n"), ("yy", 5, "n")])
    user = spark.createDataFrame([("A", None, ""), ("B", None, "")], "word string, freq int, tag string")
    merged = LX.overlay(base, user)
    assert cut(spark, "IBM,3.14", merged, mode="mix") == "I/B/M/,/3.14"
    assert cut(spark, "IBM,3.14", base, mode="mix") == "IBM/,/3.14"


def test_overlay_weights(spark):
    base = lex(spark, [("a", 1, "n"), ("b", 2, "n"), ("c", 3, "n"), ("d", 9, "n")])
    user = LX.parse_user_lines(spark.createDataFrame(
        [("区块链 10 nz",), ("蓝翔 nz",), ("云计算",), ("",), ("x y z w",)], "value string"))
    got = {r["word"]: r for r in LX.overlay(base, user).collect()}
    assert math.isclose(got["区块链"]["weight"], math.log(10 / 15)) and got["区块链"]["tag"] == "nz"
    median = math.log(3 / 15)                       # element n div 2, not interpolated
    assert math.isclose(got["蓝翔"]["weight"], median) and got["蓝翔"]["tag"] == "nz"
    assert math.isclose(got["云计算"]["weight"], median) and got["云计算"]["tag"] == ""
    assert "x" not in got and "" not in got
    st_ = LX.lexicon_stats(base).first()
    assert math.isclose(st_["median_weight"], median)
    assert math.isclose(st_["min_weight"], math.log(1 / 15))


def test_tags(spark):
    lx = lex(spark, [("云计算", 5, "n"), ("空", 5, "")])
    toks = spark.createDataFrame([(w,) for w in ["iPhone6", "。", "云计算", "空", "123"]], "word string")
    got = {r["word"]: r["tag"] for r in LX.tag_tokens(toks, lx).collect()}
    assert got == {"iPhone6": "eng", "。": "x", "云计算": "n", "空": "x", "123": "m"}


def test_lookup(spark):
    lx = lex(spark, [("a1", 5, "n")])
    words = spark.createDataFrame([("a1",), ("b2",)], "word string")
    got = {r["word"]: r["in_lexicon"] for r in LX.lookup(words, lx).collect()}
    assert got == {"a1": True, "b2": False}


TOY = SG.HmmModel(
    start=[-0.5, SG.MIN_DOUBLE, SG.MIN_DOUBLE, -1.0],
    trans=[[SG.MIN_DOUBLE, -0.5, -1.0, SG.MIN_DOUBLE],
           [-0.5, SG.MIN_DOUBLE, SG.MIN_DOUBLE, -1.0],
           [SG.MIN_DOUBLE, -0.5, -1.0, SG.MIN_DOUBLE],
           [-0.5, SG.MIN_DOUBLE, SG.MIN_DOUBLE, -1.0]],
    emit=[{"甲": -0.1}, {"乙": -0.1}, {}, {"丙": -0.1}])


def test_hmm_viterbi_and_rules():
    assert SG.hmm_cut("甲乙丙", TOY) == ["甲乙", "丙"]
    assert SG.hmm_cut("甲乙ab12.5,丙", TOY) == ["甲乙", "ab12", ".", "5", ",", "丙"]
    # unknown characters: one word each (path stays at E)
    assert SG.hmm_cut("éü", SG.HmmModel()) == ["é", "ü"]
    assert SG.hmm_cut("IBM,1.2,123", SG.HmmModel()) == ["IBM", ",", "1.2", ",", "123"]


def test_hmm_model_file(spark, tmp_path):
    p = tmp_path / "model.txt"
    lines = ["# start", "-0.5 -3.14e+100 -3.14e+100 -1.0", "", "# trans"]
    lines += [" ".join(str(x) for x in row) for row in TOY.trans]
    lines += ["甲:-0.1", "乙:-0.1", "丁:-9.0", "丙:-0.1"]
    p.write_text("\n".join(lines) + "\n", encoding="utf-8")
    m = SG.load_hmm_model(spark, str(p))
    assert m.emit[0] == {"甲": -0.1} and m.start[3] == -1.0
    assert SG.hmm_cut("甲乙丙", m) == ["甲乙", "丙"]


def _brute_best(piece, words, min_w):
    best = SG.MIN_DOUBLE
    n = len(piece)
    for cuts in itertools.product([0, 1], repeat=max(n - 1, 0)):
        parts, last = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(piece[last:i]); last = i
        parts.append(piece[last:])
        if any(len(p) > 1 and p not in words for p in parts):
            continue
        score = 0.0
        for p in reversed(parts):
            score = (words[p] if p in words else min_w) + score
        best = max(best, score)
    return best


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=7),
       st.dictionaries(st.text(alphabet="abc", min_size=1, max_size=3),
                       st.floats(min_value=-9, max_value=-0.5), max_size=8))
def test_mp_cut_is_optimal(piece, words):
    min_w = min(list(words.values()) + [-10.0])
    edges = {}
    for i in range(len(piece)):
        for j in range(i, len(piece)):
            w = piece[i:j + 1]
            if w in words:
                edges.setdefault(i, []).append((j, words[w]))
    got = SG.mp_cut(piece, edges, min_w)
    assert "".join(got) == piece
    score = 0.0
    for p in reversed(got):
        score = (words[p] if p in words else min_w) + score
    assert math.isclose(score, _brute_best(piece, words, min_w), rel_tol=1e-12, abs_tol=1e-12)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aZ09.,- \n中文字é", max_size=20))
def test_hmm_cut_without_emissions_is_the_token_regex(text):
    # a model whose emissions cover no character of the text takes the full
    # Viterbi path; the empty model takes the regex path -- they must agree
    unseen = SG.HmmModel(emit=[{"￿": -1.0}, {}, {}, {}])
    assert SG.hmm_cut(text, SG.HmmModel()) == SG.hmm_cut(text, unseen)


def test_mp_cut_near_ties_pick_the_shortest_candidate():
    # ab|cde and abcd|e score the same up to the last bits of the weights
    # (different engines' ln); the shortest candidate at position 0 must win
    a, b = -6.2422232654551655, -5.954541193003384
    edges = {0: [(1, a), (3, b + 2e-15)], 2: [(4, b)], 4: [(4, a)]}
    assert SG.mp_cut("abcde", edges, -50.0) == ["ab", "cde"]
    # a clear winner is still taken
    edges = {0: [(1, a), (3, b + 1e-3)], 2: [(4, b)], 4: [(4, a)]}
    assert SG.mp_cut("abcde", edges, -50.0) == ["abcd", "e"]
