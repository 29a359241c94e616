"""Rows that cannot be read must not end a job; settings of a session stay."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from trawl import session
from trawl.sources import corpus as C
from trawl.sources import dictionaries as D


def test_unreadable_numbers(spark, tmp_path):
    (tmp_path / "user").write_text("w x5 nz\nv 7 n\n")
    (tmp_path / "idf").write_text("b x\nc 2.5\n")
    assert rows(D.load_user_lexicon(spark, str(tmp_path / "user")), "word", F.coalesce("freq", F.lit(-1)), "tag") == \
        [("v", 7, "n"), ("w", -1, "nz")]
    assert rows(D.load_idf(spark, str(tmp_path / "idf"))[0], "word", "idf") == [("b", 0.0), ("c", 2.5)]


def test_two_lexicon_files_in_order(spark, tmp_path):
    (tmp_path / "a").write_text("w 1 n\n")
    (tmp_path / "b").write_text("w 2 v\n")
    got = D.load_user_lexicon(spark, f"{tmp_path}/a|{tmp_path}/b").orderBy("line_no").collect()
    assert [(r.word, r.freq, r.tag) for r in got] == [("w", 1, "n"), ("w", 2, "v")]


def test_request_urls(spark):
    urls = ["/s?query=a%20b", "http://h/s?query=x y", "http://h/s?query=%zz", "http://h/s?q=1", None]
    df = spark.createDataFrame(list(enumerate(urls)), "request_id int, url string")
    assert rows(C.requests_with_query(df)) == [(0, "a b"), (1, "x y"), (2, "%zz")]


def test_page_that_is_not_utf8_and_root_forms(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.html").write_bytes(b"<title>caf\xe9</title><body>t</body>")
    (tmp_path / "x" / "b.html").write_bytes(b"<title>two</title>")
    (tmp_path / "x" / "c.txt").write_bytes(b"<title>no page</title>")
    for root in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}/"):
        got = rows(C.corpus_documents(spark, root, "http://h/"), "doc_id", "title", "url")
        assert got == [(0, "caf�", "http://h/x/a.html"), (1, "two", "http://h/x/b.html")]


def test_records_with_nulls_and_short_lines(spark, tmp_path):
    docs = spark.createDataFrame([("t", None, "c")], "title string, url string, content string")
    C.write_records(docs, str(tmp_path / "r"))
    assert rows(C.read_records(spark, str(tmp_path / "r"))) == [("t", "", "c")]
    (tmp_path / "s").write_text("only a title\n")
    assert rows(C.read_records(spark, str(tmp_path / "s")).select("title", F.col("content").isNull())) == \
        [("only a title", True)]


def test_a_running_session_keeps_its_settings(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert session.get_spark() is spark and spark.conf.get("spark.sql.shuffle.partitions") == before


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "yarn"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(dict)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError):
        session.checkpoint_dir(Session)
