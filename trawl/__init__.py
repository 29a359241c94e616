"""trawl — document search and text analytics as Spark DataFrame jobs.

Layout
------
sources/    readers and writers (HTML corpus, document table, delimited
            records, JSON results, lexicons, IDF and stop-word lists, HMM
            model, request logs, driver tables)
functions/  Column expressions (tokenizer regex, ASCII case folding,
            snippets, tag rule, query key ...), all JVM-side built-ins
operators/  DataFrame -> DataFrame operators (parse, tokenize, index,
            search, keywords, lexicon jobs, segmentation, query log)
plans/      the registered queries and their DuckDB oracle SQL
streaming/  Structured Streaming versions of the query-log analysis
"""

from trawl.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
