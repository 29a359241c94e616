"""A page's file is as Spark's text writer leaves it, without a folder a page."""

import os
import re

from trawl.sources import corpus as C

PAGES = [(1, "<title>a</title>x"), (10, "<title>b</title>\n"), (2, None), (2, "<title>c</title>é"), (None, "<title>d</title>"), (-3, "")]


def contents(root):
    found = {}
    for folder, _, files in os.walk(root):
        for f in files:
            if f.endswith(".txt"):
                with open(os.path.join(folder, f), "rb") as x:
                    found[re.search(r"page_id=([^/.]*)", os.path.join(folder, f))[1]] = sorted(x.read().split(b"\n"))
    return found


def test_files_of_tasks_are_those_of_the_writer(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, html string").repartition(3)
    C.write_pages(pages, f"file:{tmp_path}/tasks")
    C.write_pages(pages, f"{tmp_path}/writer")  # no mounted folder: a folder a page
    assert contents(f"{tmp_path}/tasks") == contents(f"{tmp_path}/writer") and len(contents(f"{tmp_path}/tasks")) == 5
    assert sorted(os.listdir(f"{tmp_path}/tasks")) == sorted(
        f"page_id={i}.txt" for i in ("1", "10", "2", "-3", "__HIVE_DEFAULT_PARTITION__"))
    # ids follow the paths in the same order
    order = [[re.search(r"page_id=([^/.]*)", r.path)[1] for r in C.corpus_documents(spark, f"{tmp_path}/{x}", "u", "*.txt").orderBy("doc_id").collect()]
             for x in ("tasks", "writer")]
    assert order[0] == order[1] == ["1", "10", "2", "__HIVE_DEFAULT_PARTITION__"]


def test_no_pages(spark, tmp_path):
    C.write_pages(spark.createDataFrame([], "page_id long, html string"), f"file://{tmp_path}/none")
    assert os.listdir(f"{tmp_path}/none") == []


def test_many_small_files_are_one_task(spark, tmp_path):
    key = "spark.sql.files.openCostInBytes"
    was = spark.conf.get(key)
    for i in range(200):
        (tmp_path / f"{i}.html").write_text(f"<title>{i}</title>")
    with C.small_files(spark):
        parts = C.scan_corpus(spark, str(tmp_path)).rdd.getNumPartitions()
    assert parts <= spark.sparkContext.defaultParallelism + 1 and spark.conf.get(key) == was
