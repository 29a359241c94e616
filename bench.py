"""Benchmark of the headline jobs.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line: {"metric", "value", "unit", "queries": {...}, "sf"}.
Each job runs to completion through the ``noop`` sink (no collect); the
index is materialised once, as a search service would, and the query
batches run against that table.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trawl.session import get_spark, materialize  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app="trawl-bench")

    from trawl.operators import index, keywords, parse, search
    from trawl.plans import catalog, catalog_text
    from trawl.sources import tables as S

    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t0, 3)
        return out

    pages = S.pages(spark, sf_dir)
    queries = S.benchmark_queries(spark, sf_dir)

    # JVM / codegen warm-up on a different, tiny input (not timed)
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        run(index.build_postings(parse.parse_documents(S.pages(spark, warm_dir)), materialize_tf=False))

    # index build over pages, kept as a table for the query batches
    postings = timed("index_pages", lambda: materialize(
        index.build_postings(parse.parse_documents(pages)), "bench_postings"))
    timed("index_documents", lambda: run(index.build_postings(S.document_table(spark, sf_dir))))
    champ = timed("champions", lambda: materialize(index.champions(postings), "bench_champions"))
    timed("search_batch", lambda: run(search.search(queries, postings, pages)))
    timed("search_batch_champions", lambda: run(search.search(queries, champ, pages)))
    timed("search_conversations", lambda: run(
        search.search(S.conversation_queries(spark, sf_dir), champ, pages)))
    timed("keywords_tfidf", lambda: run(catalog.registry()["keywords_tfidf"](spark, sf_dir)))
    timed("keywords_textrank", lambda: run(catalog.registry()["keywords_textrank"](spark, sf_dir)))
    reg = catalog.registry()
    for name in ("cache_sessions", "segment_full", "segment_mix"):
        if name in reg:
            timed(name, lambda n=name: run(reg[n](spark, sf_dir)))
    del catalog_text, keywords

    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
