"""Spark segmentation vs a plain-Python run on the smallest driver tables.

The lexicon is collected here (test only), candidate words are found by
direct substring look-up, and the same per-piece cut is applied."""

import re

from pyspark.sql import functions as F

from trawl.operators import lexicon as LX
from trawl.operators import segment as SG
from trawl.plans import catalog_text as CT

from conftest import SF_SMALL

SPLIT = re.compile("[^ \t\n，。]+|[ \t\n，。]")


def python_cut(text, words, min_w, singles, mode, cap=512):
    longest = max(len(w) for w in words)
    out = []
    for piece in SPLIT.findall(text):
        g = {}
        for i in range(len(piece)):
            for j in range(i, min(len(piece), i + min(cap, longest))):
                w = piece[i:j + 1]
                if w in words:
                    g.setdefault(i, []).append((j, words[w]))
        if mode == "mp":
            out.extend(SG.mp_cut(piece, g, min_w))
        else:
            out.extend(SG.mix_cut(piece, g, min_w, singles, SG.HmmModel()))
    return out


def test_mix_and_mp_match_python(spark):
    lex = CT._overlay(spark, SF_SMALL)
    rows = lex.select("word", "weight", "is_user").collect()
    words = {r["word"]: r["weight"] for r in rows}
    min_w = min(r["weight"] for r in rows if not r["is_user"])
    singles = frozenset(r["word"] for r in rows if r["is_user"] and len(r["word"]) == 1)
    docs = CT._documents(spark, SF_SMALL)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for mode, cap in (("mix", 512), ("mp", 512), ("mp", 3)):
        got = {}
        for r in SG.segment(docs, lex, mode=mode, max_word_len=cap).orderBy("doc_id", "pos").collect():
            got.setdefault(r["doc_id"], []).append(r["word"])
        for doc_id, text in texts.items():
            assert got.get(doc_id, []) == python_cut(text, words, min_w, singles, mode, cap), (mode, doc_id)
