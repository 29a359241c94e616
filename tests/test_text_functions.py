"""Column expressions: tokenizer, HTML parsing, snippets, tags, keys."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.operators import parse, tokenize


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "s string").select(expr.alias("r")).first()["r"]


def test_latin_tokens_golden(spark):
    # IBM,1.2,123 -> IBM , 1.2 , 123
    assert one(spark, T.latin_tokens("s"), "IBM,1.2,123") == ["IBM", ",", "1.2", ",", "123"]


def test_tokens_non_ascii_letters_split(spark):
    assert one(spark, T.latin_tokens("s"), "réseau 12ab") == ["r", "é", "seau", " ", "12", "ab"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aZ09.,; \n\té€-x1")), max_size=40))
def test_token_rewrites_are_exact(spark, s):
    df = spark.createDataFrame([(s,)], "s string")
    r = df.select(T.latin_tokens("s").alias("t"), T.letter_runs("s").alias("l"),
                  T.token_count("s").alias("n"), T.runs("s").alias("r"),
                  T.run_gaps("s").alias("g")).first()
    toks = r["t"]
    assert "".join(toks) == s                       # tokens tile the text
    assert r["n"] == len(toks)                      # count without the array
    assert r["l"] == [t for t in toks if t[:1].isascii() and t[:1].isalpha()]
    assert r["r"] == [t for t in toks if len(t) > 1 or t.isascii() and t.isalnum()]
    assert len(r["g"]) == len(r["r"]) + 1


def test_html_edge_cases(spark):
    pages = spark.createDataFrame([
        (1, "u1", "<html><body>no title</body></html>"),
        (2, "u2", "<title></title>body"),
        (3, "u3", "<TITLE>Upper</TITLE>x"),
        (4, "u4", "<title>First</title><title>Second</title>"),
        (5, "u5", "<title>T</title>a<b unclosed"),
        (6, "u6", "<title>T</title>a > b\nc<!-- x > y -->z<script>var a=1;</script>&amp;"),
    ], "page_id long, url string, html string")
    docs = {r["doc_id"]: r for r in parse.parse_documents(pages).collect()}
    rej = {r["doc_id"] for r in parse.parse_rejects(pages).collect()}
    assert rej == {1, 2, 3}                           # case-sensitive, empty rejected
    assert docs[4]["title"] == "First"
    assert docs[4]["content"] == "FirstSecond "      # final newline -> space
    assert docs[5]["content"] == "Ta"                 # unclosed < drops to the end
    # stray > kept, newline -> space, comment ends at its first >, script text stays
    assert docs[6]["content"] == "Ta > b c y -->zvar a=1;&amp; "


def test_snippet_positions(spark):
    body = "x" * 200
    cases = {
        "w" + body: 0,            # match at 0 -> start 0
        "x" * 79 + "w" + body: 0,
        "x" * 80 + "w" + body: 0,
        "x" * 81 + "w" + body: 1,
    }
    for content, start in cases.items():
        got = spark.createDataFrame([(content,)], "c string").select(
            T.snippet("c", F.lit("w")).alias("d")).first()["d"]
        assert got == content[start:start + 160] + "..."
    # only in another case, or absent -> from the start
    for content in ("W" + body, body):
        got = spark.createDataFrame([(content,)], "c string").select(
            T.snippet("c", F.lit("w")).alias("d")).first()["d"]
        assert got == content[:160] + "..."


def test_tag_rule(spark):
    df = spark.createDataFrame([(w,) for w in ["a", "123", "AK47", "12ab", "iPhone6", "。", "中文"]], "w string")
    got = {r["w"]: r["t"] for r in df.select("w", T.tag_rule("w").alias("t")).collect()}
    assert got == {"a": "x", "123": "m", "AK47": "eng", "12ab": "m", "iPhone6": "eng",
                   "。": "x", "中文": "x"}


def test_canonical_key_is_order_free(spark):
    df = spark.createDataFrame([(1, "LOVE YOU"), (2, "YOU LOVE")], "id long, q string")
    keys = [r["k"] for r in df.select(T.canonical_key(T.latin_tokens("q")).alias("k")).collect()]
    assert keys[0] == keys[1] == " loveyou"


def test_canonical_key_signed_bytes(spark):
    # non-ASCII first bytes sort before ASCII (signed char comparison)
    df = spark.createDataFrame([("b é a",)], "q string")
    k = df.select(T.canonical_key(T.latin_tokens("q")).alias("k")).first()["k"]
    assert k == "é  ab"


def test_presplit_goldens(spark):
    df = spark.createDataFrame([(1, "你好，美丽的，世界"), (2, "我来自北京邮电大学。。。学号123456，用AK47")],
                               "doc_id long, text string")
    got = {}
    for r in tokenize.presplit(df).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append(r["piece"])
    assert "/".join(got[1]) == "你好/，/美丽的/，/世界"
    assert "/".join(got[2]) == "我来自北京邮电大学/。/。/。/学号123456/，/用AK47"


def test_code_points_golden(spark):
    df = spark.createDataFrame([(1, "你好世界")], "doc_id long, text string")
    cp = tokenize.code_points(df).orderBy("pos").collect()
    assert [r["code"] for r in cp] == [20320, 22909, 19990, 30028]
    assert [r["byte_len"] for r in cp] == [3, 3, 3, 3]


def test_token_offsets(spark):
    df = spark.createDataFrame([(1, "aé b")], "doc_id long, text string")
    got = [(r["word"], r["offset"], r["unicode_offset"]) for r in
           tokenize.token_offsets(df).orderBy("pos").collect()]
    assert got == [("a", 0, 0), ("é", 1, 1), (" ", 3, 2), ("b", 4, 3)]


def test_corpus_directory_scan(spark, tmp_path):
    from trawl.sources import corpus as C

    root = tmp_path / "input"
    (root / "a" / "b").mkdir(parents=True)
    (root / "a" / "b" / "x.html").write_text("<title>X</title>body x", encoding="utf-8")
    (root / "a" / "y.html").write_text("<title>Y</title>line1\nline2\n", encoding="utf-8")
    (root / "a" / "z.hpp").write_text("<title>Z</title>not html", encoding="utf-8")
    (root / "notitle.html").write_text("<p>none</p>", encoding="utf-8")
    docs = C.corpus_documents(spark, str(root), "https://docs.example/").orderBy("doc_id").collect()
    assert [(r["doc_id"], r["url"], r["title"]) for r in docs] == [
        (0, "https://docs.example/a/b/x.html", "X"),
        (1, "https://docs.example/a/y.html", "Y")]
    assert docs[0]["content"] == "Xbody x "        # final newline added by the read rule
    assert docs[1]["content"] == "Yline1 line2 "


def test_is_ascii(spark):
    df = spark.createDataFrame([("abc",), ("é",), ("",)], "w string")
    assert [r["a"] for r in df.select(T.is_ascii("w").alias("a")).collect()] == [True, False, True]


def test_split_fields_rule(spark):
    cases = {"a b c": ["a", "b", "c"], "a b ": ["a", "b"], "a  b": ["a", "", "b"],
             "": [], "a  ": ["a", ""], " a": ["", "a"]}
    for s, want in cases.items():
        assert one(spark, T.split_fields("s", " "), s) == want
        assert T.split_fields_py(s, " ") == want
    assert one(spark, T.split_fields("s", " ", maxsplit=1), "a b c") == ["a", "b c"]


def test_idf_average_counts_every_line(spark, tmp_path):
    from trawl.operators import keywords as K
    from trawl.sources import dictionaries as D

    p = tmp_path / "idf.txt"
    p.write_text("a 1.0\nb 3.0\n\nbad line here\n", encoding="utf-8")
    idf, n_lines = D.load_idf(spark, str(p))
    assert sorted(tuple(r) for r in idf.select("word", "idf").collect()) == [("a", 1.0), ("b", 3.0)]
    avg = spark.range(1).select(K.idf_average(idf, n_lines).alias("a")).first()["a"]
    assert avg == 1.0                                 # (1 + 3) / 4 lines
