"""Short boilerplate lines in the pipeline's line dedup."""

import corpus_pipeline
from trawl.llm import lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_short_lines_on_many_sites_go(spark):
    share, han, brace = "Share this page now.", "本网站所有内容未经许可不得转载" * 6, "}"
    rows = [(i, f"own text number {i} stays\n{share}\n{brace}\n\nthe end of text number {i}", "en", f"s{i}", 0) for i in range(12)]
    rows += [(100, "first one\n" + han, "zh", "a", 0), (101, "second one\n" + han, "zh", "b", 0)]
    rows += [(200 + i, f"other text {i} here\nFew sites.", "en", f"s{i}", 0) for i in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.text.split("\n") for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert [i for i in got if share in got[i]] == [0]  # 20 code points: 8 sites
    assert [i for i in got if han in got[i]] == [100]  # 90 code points without a blank: 2 sites
    assert sum(brace in t for t in got.values()) == 12 and sum("" in t for t in got.values()) == 12
    assert sum("Few sites." in t for t in got.values()) == 3
    # op3_line_dedup goes by its SQL: lines of fewer than 5 words stay
    assert all(r.n_removed == 0 for r in lines.dedup(docs).collect())
