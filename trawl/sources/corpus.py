"""HTML corpus on a file system, the document table, delimited records and
JSON result files.

* ``scan_corpus``: recursive ``binaryFile`` listing filtered to a glob (by
  default exactly ``*.html``), decoded as UTF-8, with the whole-file read
  rule (a missing final newline is added).  A missing root is an error
  (Spark raises on a path that does not exist).
* ``corpus_documents``: scan -> parse -> url from the path -> dense ids in
  path order.
* Document table: Parquet with a fixed 4-column schema (``write_docs`` /
  ``read_docs``); a JDBC table is the same DataFrame through
  ``format("jdbc")`` options supplied by the caller.
* Delimited records: ``title \\x03 url \\x03 content`` per line.
"""

from __future__ import annotations

import contextlib
import itertools
import os
import re
import uuid
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.functions import text as TX
from trawl.operators.parse import assign_doc_id
from trawl.operators.tokenize import by_document

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("title", T.StringType(), True),
    T.StructField("url", T.StringType(), True),
    T.StructField("content", T.StringType(), True),
])
RECORD_SEP = "\u0003"
AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def scan_corpus(spark: SparkSession, root: str, glob: str = "*.html") -> DataFrame:
    """(path, html) for every regular file below ``root`` matching ``glob``."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", glob).load(root))
    # bytes that are no UTF-8 become U+FFFD; one such page must not end the scan
    html = TX.ensure_final_newline(F.make_valid_utf8(F.col("content").cast("string")))
    return files.select("path", html.alias("html"))


def write_pages(pages: DataFrame, root: str, id_col: str = "page_id", html_col: str = "html") -> None:
    """One text file a page below ``root``, whose name has ``page_id=<id>``.  Rows of an id follow each
    other in its file, each with a final newline, as Spark's text writer leaves them.

    Rows are dealt by id, so that a file is written by one task.  Below a mounted folder (``file:``)
    the task writes the files itself, all in one folder, to a hidden name that then becomes theirs: a
    task that is run again leaves the same.  Elsewhere Spark writes a folder a page.
    """
    dealt = by_document(pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")), "page_id", text_col="html")
    mounted = re.match(r"file:(?://)?(/.*)", root)
    if not mounted:
        # a page's file is moved to its place by its task
        dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("page_id").text(root)
        return
    os.makedirs(mounted[1], exist_ok=True)
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    rows = dealt.select(name.alias("name"), F.col("html").cast("binary").alias("html")).sortWithinPartitions("name")
    rows.mapInArrow(_page_files(mounted[1]), "files long").agg(F.sum("files")).collect()


def _page_files(folder: str):
    def rows(batches):
        for batch in batches:
            yield from zip(batch.column("name").to_pylist(), batch.column("html"))

    def fn(batches):
        n = 0
        for name, group in itertools.groupby(rows(batches), itemgetter(0)):
            path = os.path.join(folder, f"page_id={name}.txt")
            hidden = os.path.join(folder, f".{name}-{uuid.uuid4().hex}")
            with open(hidden, "wb") as f:
                for _, html in group:
                    f.write((html.as_py() or b"") + b"\n")
            os.replace(hidden, path)
            n += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})
    return fn


OPEN_COST = 64 << 10  # bytes read in the time that opening a page's file takes


@contextlib.contextmanager
def small_files(spark: SparkSession):
    """Files that are opened in here count ``OPEN_COST`` and their size: by Spark's default of 4 MB
    a task has 32 pages, and a corpus of millions as many tasks as makes its driver fall behind."""
    key = "spark.sql.files.openCostInBytes"
    was = spark.conf.get(key)
    spark.conf.set(key, str(OPEN_COST))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def corpus_documents(spark: SparkSession, root: str, url_head: str, glob: str = "*.html") -> DataFrame:
    """(doc_id, path, title, url, content) for the accepted pages of a corpus
    directory; ids are dense and 0-based in path order."""
    files = scan_corpus(spark, root, glob)
    # paths come back with scheme and authority, however the root was given
    root_norm = re.sub(AUTHORITY, "", root).rstrip("/") + "/"
    place = F.regexp_replace("path", AUTHORITY, "")
    rel = F.call_function("substring", place, F.call_function("instr", place, F.lit(root_norm)) + len(root_norm))
    title = TX.html_title("html")
    docs = (files.select("path", title.alias("title"), F.concat(F.lit(url_head), rel).alias("url"),
                         TX.html_body("html").alias("content"))
            .where(F.col("title") != ""))
    with small_files(spark):  # the files are read in here
        return assign_doc_id(docs, "path").select("doc_id", "path", "title", "url", "content")


def write_docs(docs: DataFrame, path: str, mode: str = "append") -> None:
    """Append documents to the document table (Parquet, fixed schema)."""
    docs.select(*[F.col(f.name).cast(f.dataType) for f in DOC_SCHEMA.fields]) \
        .write.mode(mode).parquet(path)


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    """Read the document table; it must have exactly the 4 document columns."""
    df = spark.read.parquet(path)
    if [f.name for f in df.schema.fields] != DOC_SCHEMA.names:
        raise ValueError(f"document table needs columns {DOC_SCHEMA.names}, got {df.columns}")
    return df


def write_records(docs: DataFrame, path: str) -> None:
    """One ``title \\x03 url \\x03 content`` line per document."""
    docs.select(F.concat_ws(RECORD_SEP, *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "url", "content")])
                .alias("value")) \
        .write.mode("overwrite").option("lineSep", "\n").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(title, url, content) from delimited lines; empty fields are kept."""
    parts = F.split(F.col("value"), RECORD_SEP, -1)
    return (spark.read.option("lineSep", "\n").text(path)
            .select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(("title", "url", "content"))]))


def write_json_results(results_json: DataFrame, path: str) -> None:
    """One JSON answer per query (each already ends with a newline)."""
    results_json.select(F.concat_ws("\t", F.col("query_id").cast("string"),
                                    F.regexp_replace("json", "\n$", "")).alias("value")) \
        .write.mode("overwrite").text(path)


def url_decoded(col: Column) -> Column:
    """A query value with its escapes replaced one by one: ``%XX`` (UTF-8 bytes),
    ``%uXXXX`` (a code point; surrogates vanish) and ``+`` (a blank).  What is no
    escape stays as it is; bytes that are no UTF-8 become U+FFFD."""
    parts = F.regexp_extract_all(col, F.lit("%u[0-9A-Fa-f]{4}|(?:%[0-9A-Fa-f]{2})+|[^%]+|%"), F.lit(0))

    def one(p: Column) -> Column:
        point = F.decode(F.unhex(F.substring(p, 3, 4)), "UTF-16BE")
        return (F.when(p.rlike("^%u[dD][89A-Fa-f]"), "").when(p.rlike("^%u[0-9A-Fa-f]{4}$"), point)
                .when(p.rlike("^%[0-9A-Fa-f]{2}"), F.unhex(F.regexp_replace(p, "%", "")).cast("string"))
                .otherwise(F.translate(p, "+", " ")))

    return F.make_valid_utf8(F.array_join(F.transform(parts, one), ""))


def request_query(url_col) -> Column:
    """The decoded ``query`` parameter of a request URL (null when absent); it
    is also found in a URL with forbidden characters."""
    u = F.col(url_col) if isinstance(url_col, str) else url_col
    loose = F.when(u.rlike(r"[?&]query="), F.regexp_extract(u, r"[?&]query=([^&#]*)", 1))
    raw = F.coalesce(F.try_parse_url(u, F.lit("QUERY"), F.lit("query")), loose)
    return url_decoded(raw)


def requests_with_query(requests: DataFrame, url_col: str = "url", id_col: str = "request_id") -> DataFrame:
    """(request_id, query) for requests that carry a ``query`` parameter;
    the others get no search."""
    return (requests.select(F.col(id_col).alias("request_id"), request_query(url_col).alias("query"))
            .where(F.col("query").isNotNull()))
