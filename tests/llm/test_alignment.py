"""Lists of children are aligned the same whatever their length; references are parsed only when chosen."""

import numpy as np
from pyspark.sql import functions as F

from trawl.llm import mainpage


def children(rng, n):
    body = "".join(f"<{t}>{x}</{t}>" if t else f"t{x}<br>" for t, x in zip(rng.choice(["p", "ul", "h2"], n), rng.integers(0, 9, n)))
    return mainpage.grown(mainpage.outline(mainpage.tree(f"<div>{body}</div>"))).kids[0].kids


def test_wide_lists_are_aligned_as_short_ones(monkeypatch):
    rng = np.random.default_rng(5)
    lists = [(children(rng, rng.integers(1, 60)), children(rng, rng.integers(1, 60))) for _ in range(60)]
    short = [mainpage.aligned(a, b) for a, b in lists]
    monkeypatch.setattr(mainpage, "CELLS", 0)
    assert [mainpage.aligned(a, b) for a, b in lists] == short


def test_each_host_parses_its_references_only(spark, monkeypatch):
    rows = [(i, f"http://h{i % 2}/x", f"<body><p>menu</p><p>text {i}</p></body>") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen, whole = [], mainpage.arrow_map

    def counted(df, *args):
        seen.append(df.count())
        return whole(df, *args)

    monkeypatch.setattr(mainpage, "arrow_map", counted)
    out = mainpage.extract(pages).select("page_id", F.col("text")).collect()
    assert {r["page_id"]: r["text"] for r in out} == {i: f"text {i}" for i in range(60)}
    assert seen[0] <= 2 * mainpage.REFERENCES and seen[1] == 60
