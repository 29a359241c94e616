"""License scan by diagonal voting.

All rolling word k-gram hashes of the documents are joined by Spark to the
template positions (a fixed, small table, so broadcast).  Votes are summed per
(row, template, diagonal = word position - template position); neighbouring
diagonals are merged to spans.  A span reaches over the whole template, begun
and ended where its diagonals put it, and is verified by its words.

Null or empty text: no words, no labels, score 0.  Rows are told apart by a hash
of id and text, so null and repeated ids are scanned like others; rows that
share it share candidate spans, and each is verified by its own text.
"""

from __future__ import annotations

import difflib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import WordHash, arrow_map, rolling

K = 3
SLACK = 3        # diagonals at most this far apart are one span (inserted or lost words)
COVER = 0.8      # share of a template's words that a verified span has

# Phrases and labels of the base, then wording of public licenses.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation the "
            "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
            "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice "
            "and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software "
            "and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
            "provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
                   "the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required "
                   "by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
                   "basis without warranties or conditions of any kind either express or implied"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met redistributions of source code must retain the above copyright notice this list of "
            "conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice "
            "this list of conditions and the following disclaimer in the documentation and or other materials provided with the "
            "distribution"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc", "licensed under a creative commons attribution"),
    ("cc", "licensed under the creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
            "license as published by the free software foundation either version 3 of the license or at your option any later "
            "version"),
    ("gpl", "either version 3 of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
             "public license as published by the free software foundation"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

_KEEP = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def license_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_KEEP).split()


def grams(docs: DataFrame) -> DataFrame:
    """(key, pos, h) of every k-gram of every row."""
    arrow = pa.schema([("key", pa.int64()), ("pos", pa.int32()), ("h", pa.int64())])
    hashes = WordHash()

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                ids, pos, hs = [], [], []
                b = batch.slice(k, 64).to_pydict()
                for i, t in zip(b["key"], b["text"]):
                    h = hashes(license_words(t))
                    if len(h) >= K:
                        h = rolling(h, K)
                        ids.append(np.full(len(h), i, np.int64))
                        pos.append(np.arange(len(h), dtype=np.int32))
                        hs.append(h.view(np.int64))
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, pos, hs)], schema=arrow)

    return docs.select("key", "text").mapInArrow(run, "key long, pos int, h long")


def keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text): rows with a hash of id and text."""
    i = F.col("doc_id").cast("long")
    return docs.select(F.xxhash64(F.coalesce(i, F.lit(-1).cast("long")), i.isNull(), "text").alias("key"), i.alias("doc_id"), "text")


def spans(rows: DataFrame) -> DataFrame:
    """(key, tpl, first, last) word ranges with merged diagonals."""
    hashes, made = WordHash(), []
    for t, (_, wording) in enumerate(TEMPLATES):
        for p, h in enumerate(rolling(hashes(license_words(wording)), K).view(np.int64).tolist()):
            made.append((h, t, p))
    table = rows.sparkSession.createDataFrame(made, "h long, tpl int, at int")
    votes = (grams(rows).join(F.broadcast(table), "h").groupBy("key", "tpl", (F.col("pos") - F.col("at")).alias("diag"))
             .agg(F.count(F.lit(1)).alias("votes")))
    w = Window.partitionBy("key", "tpl").orderBy("diag")
    new = F.when(F.col("diag") - F.lag("diag").over(w) <= SLACK, 0).otherwise(1)
    run = votes.withColumn("new", new).withColumn("span", F.sum("new").over(w))
    long = F.element_at(F.lit([len(license_words(x)) for _, x in TEMPLATES]), F.col("tpl") + 1)
    return run.groupBy("key", "tpl", "span").agg(F.min("diag").alias("lo"), F.max("diag").alias("hi"), F.sum("votes").alias("votes")) \
        .select("key", "tpl", F.greatest(F.lit(0), F.col("lo")).alias("first"), (F.col("hi") + long).alias("last"), "votes")


def scan(docs: DataFrame) -> DataFrame:
    """Base result, labels and score of every document."""
    own = keyed(docs)
    found = spans(own).groupBy("key").agg(F.collect_list(F.struct("tpl", "first", "last")).alias("spans"))
    rows = own.join(found, "key", "left").select("doc_id", "text", "spans")
    phrases = [(p.encode().split(), label) for p, label in PHRASES]
    wordings = [(label, license_words(x)) for label, x in TEMPLATES]
    hashes = WordHash()

    def base(words):
        starts, labels = [], set()
        h = hashes(words)
        for phrase, label in phrases:
            n = len(h) - len(phrase) + 1
            if n < 1:
                continue
            hit = np.ones(n, bool)
            for i, x in enumerate(hashes(phrase)):
                hit &= h[i:i + n] == x
            at = np.flatnonzero(hit)
            if len(at):
                starts.append(at)
                labels.add(label)
        return (np.concatenate(starts) if starts else np.zeros(0, int)), labels

    def fn(b):
        out = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        for t, found in zip(b["text"], b["spans"]):
            words = license_words(t)
            at, labels = base(words)
            score, more = float(len(at) > 0), set(labels)
            for s in found or []:
                label, wording = wordings[s["tpl"]]
                part = words[s["first"]:s["last"]]
                same = sum(m.size for m in difflib.SequenceMatcher(None, wording, part, False).get_matching_blocks())
                cover = same / len(wording)
                if cover >= COVER:
                    more.add(label)
                score = max(score, cover)
            out["n_words"].append(len(words))
            out["n_base"].append(len(at))
            out["first_word"].append(int(at.min()) if len(at) else None)
            out["last_word"].append(int(at.max()) if len(at) else None)
            out["base_labels"].append(",".join(sorted(labels)))
            out["labels"].append(",".join(sorted(more)))
            out["score"].append(score)
        return {"doc_id": b["doc_id"], **out}

    ints = ["doc_id", "n_words", "n_base", "first_word", "last_word"]
    return arrow_map(rows, fn, ", ".join(f"{c} long" for c in ints) + ", base_labels string, labels string, score double",
                     pa.schema([(c, pa.int64()) for c in ints] + [("base_labels", pa.string()), ("labels", pa.string()),
                                                                  ("score", pa.float64())]))
