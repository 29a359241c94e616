"""Driver contract: entry(), queries(), oracle_sql()."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"query_id", "rank", "doc_id", "title", "url", "desc"} <= set(df.columns)


def test_every_oracle_has_a_query():
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 40


def test_all_queries_plan(spark):
    # every registered query builds a plan on the smallest data set
    for name, fn in E.queries().items():
        df = fn(spark, "/root/testdata/sf0.001")
        assert df.columns, name
