"""Queries rewritten for larger tables give what the plain form gives."""

from conftest import rows
from pyspark.sql import functions as F

from trawl.functions import text as T
from trawl.operators import index, search
from trawl.operators import lexicon as LX
from trawl.operators import segment as SG
from trawl.plans import catalog_lexicon as CL


def lexicon(spark):
    return spark.createDataFrame([("ab", 3.0, "n"), ("abc", 2.0, "n"), ("bc", 2.0, "v"), ("中国", 5.0, "ns"), ("国人", 1.0, "n")],
                                 "word string, freq double, tag string")


TEXTS = [(1, "abcab, 中国人 12.5 x"), (2, "the bc\nbc"), (2, "the bc\nbc"), (3, ""), (4, None), (None, "ab 中"), (None, "abc")]


def test_packed_tokens_are_the_tokens(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(TEXTS)], "doc_id long, text string")
    for limit in (SG.LEXICON_LIMIT, 0):
        monkeypatch.setattr(SG, "LEXICON_LIMIT", limit)
        for m in ("mix", "full"):
            plain = SG.segment(docs, lexicon(spark), m, offsets=True)
            packed = SG.segment(docs, lexicon(spark), m, offsets=True, packed=True)
            names = [c for c in packed.columns if c != "doc_id"]
            flat = packed.select("doc_id", F.posexplode(F.arrays_zip(*names)).alias("pos", "t")).select("doc_id", "pos", "t.*")
            assert rows(flat) == rows(plain, "doc_id", "pos", *names) and packed.count() == 5


def test_places_of_documents_that_share_an_id(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    lex = LX.with_weights(lexicon(spark))
    got = {(r["mode"], r["doc_id"]): (r["n_tokens"], r["places_md5"]) for r in CL._places(docs, lex, lex, SG.HmmModel()).collect()}
    place = F.concat_ws(":", "word", "offset", "unicode_offset", "unicode_length")
    for m in SG.MODES:
        want = SG.segment(docs, lex, m, base=lex, offsets=True).groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("pos", place.alias("p")))).alias("t")).select(
            "doc_id", "n", F.md5(F.array_join("t.p", ",")).alias("h")).collect()
        assert {(m, r["doc_id"]): (r["n"], r["h"]) for r in want} == {k: v for k, v in got.items() if k[0] == m}
    assert len(got) == 3 * len(SG.MODES)


def test_search_cut_reads_its_tokens_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    words = ["abc", "中国人民", "ab", "x", "aabcbc"]
    toks = spark.createDataFrame([(1, i, w) for i, w in enumerate(words)], "doc_id long, pos long, word string")
    got = rows(LX.search_cut(toks.mapInArrow(count, toks.schema), lexicon(spark)))
    known, want = {"ab", "abc", "bc", "中国", "国人"}, []
    for p, w in enumerate(words):
        for rank, size in enumerate((2, 3)):
            want += [(1, p, rank * 1_000_000 + i, w[i:i + size]) for i in range(len(w) - size + 1)
                     if len(w) > size and w[i:i + size] in known]
        want.append((1, p, 2_000_000, w))
    assert got == sorted(want) and seen.value == len(words)


def test_tag_rule_counts_ascii_of_the_first_half(spark):
    words = ["", "1", "1\n", "12\n34", "中1a1", "中文1a", "1中a文b国", "a1", "1a", "😀1😀1", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r["t"] for r in df.select("w", T.tag_rule("w").alias("t")).collect()]

    def rule(w):
        if w is None:
            return "eng"
        seen = [c for c in w if ord(c) < 128][:len(w) // 2]
        return "x" if not seen else "m" if all("0" <= c <= "9" for c in seen) else "eng"

    assert got == [rule(w) for w in words]


def test_hits_below_a_words_promise_are_left_out(spark):
    """Same answer from champions as from all postings, from fewer hits."""
    posts = [(w, d, float((d * f) % 23) / 7 if w != "the" else 0.0) for w, f in (("aa", 3), ("bb", 5), ("the", 1)) for d in range(60)]
    posts += [("rare", 7, 9.0)]
    post = spark.createDataFrame(posts, "word string, doc_id long, weight double")
    qw = spark.createDataFrame([(1, "aa"), (1, "bb"), (1, "the"), (2, "the"), (3, "rare"), (3, "the"), (4, "none"), (5, "rare")],
                               "query_id long, word string")
    champ = index.champions(post, 10)
    assert rows(search.best_hits(qw, champ, 10)) == rows(search.best_hits(qw, post, 10))
    ranked = qw.withColumn("wr", F.lit(1))
    hits = search.promising_hits(ranked, champ, 10, 8)
    assert hits.where("query_id = 1 AND word = 'the'").count() == 0 and hits.count() < champ.join(qw, "word").count()
