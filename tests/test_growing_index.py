"""Appended batches, ordered dictionary lines, order statistics."""

import random

from pyspark.sql import functions as F

from trawl.operators import increment as I
from trawl.operators import index, parse
from trawl.operators import lexicon as LX
from trawl.sources import dictionaries as D
from trawl.sources import tables as S

from conftest import SF_SMALL, rows


def test_batches_equal_a_full_build(spark, tmp_path):
    pages = S.pages(spark, SF_SMALL).select("page_id", "url", "html")
    bad = spark.createDataFrame([(10**6 + i, None, "<p>no title") for i in range(4)], "page_id long, url string, html string")
    every = pages.unionByName(bad)
    root = str(tmp_path / "index")
    for i in range(3):
        I.append(root, i, every.where(F.col("page_id") % 3 == i))
        if i == 1:  # run again
            I.append(root, i, every.where(F.col("page_id") % 3 == i))
    docs = I.documents(spark, root, 3)
    ids = sorted(r[0] for r in docs.select("doc_id").collect())
    assert ids == list(range(pages.count()))
    got = I.postings(spark, root, 3).join(docs.select("doc_id", "page_id"), "doc_id")
    want = index.build_postings(parse.parse_documents(every))
    cols = ["word", "tf", "idf", "weight"]
    assert rows(got.select(F.col("page_id").alias("doc_id"), *cols)) == rows(want.select("doc_id", *cols))
    assert sum(r.rejected for r in spark.read.parquet(*[f"{root}/counts/{i}" for i in range(3)]).collect()) == 4
    assert spark.read.parquet(*[f"{root}/rejects/{i}" for i in range(3)]).count() == 4


def test_last_line_wins_for_any_split(spark, tmp_path):
    many, one = tmp_path / "many", tmp_path / "one.txt"
    many.mkdir()
    # the first file by name is the largest one, which a scan would deal out first
    for k, n in enumerate((4000, 10, 700)):
        (many / f"part-{k:05d}").write_text("".join(f"w{i} {k * 10_000 + i + 1} t{k}\n" for i in range(n)) + f"same {k + 1} t{k}\n")
    one.write_text("same 9 last\nw1 last\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "1000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {r.word: (r.freq, r.tag) for r in D.load_user_lexicon(spark, f"{many}|{one}").groupBy("word").agg(
                F.max_by(F.struct("freq", "tag"), "line_no").alias("x")).select("word", "x.*").collect()}
            assert got["same"] == (9, "last") and got["w1"] == (None, "last")
            assert got["w5"] == (20_006, "t2") and got["w699"] == (20_700, "t2") and got["w3999"] == (4000, "t0")
            got = {r.word: r.tag for r in D.load_user_lexicon(spark, [str(one), str(many)]).groupBy("word").agg(
                F.max_by("tag", "line_no").alias("tag")).collect()}
            assert got["same"] == "t2"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_kth_smallest(spark):
    rnd = random.Random(1)
    values = [rnd.choice([rnd.gauss(0, 1), 0.5, -1e300, 1e-300, 1e300, 3.0]) for _ in range(3000)] + [None] * 5
    df = spark.createDataFrame([(v,) for v in values], "x double")
    want = sorted(v for v in values if v is not None)
    one = spark.range(1)
    for k in (0, 1, 1499, 1500, 2999):
        assert one.select(LX.kth_smallest(df, "x", k)).first()[0] == want[k]
    assert one.select(LX.kth_smallest(df, "x", 3000)).first()[0] is None
    assert one.select(LX.kth_smallest(df.limit(0), "x", 0)).first()[0] is None
    plan = LX.lexicon_stats(spark.createDataFrame([("a", 1.0, "n"), ("b", 2.0, "n")], "word string, freq double, tag string")) \
        ._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
