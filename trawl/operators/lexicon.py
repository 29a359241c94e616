"""Lexicon jobs: statistics, user-word overlay, look-ups, the candidate-word
graph, full cut, search cut and part-of-speech tags -- joins and windows; the
graph is looked up in the tasks while its lexicon is of a few ``BROADCAST_BYTES``.

A lexicon is a DataFrame (word, freq, tag[, weight, is_user, prio, line_no]).
Joins against it broadcast it only when its counted size fits the
threshold; otherwise they are shuffle joins (AQE splits hot substrings).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from trawl.functions import text as T
from trawl.operators import lattice as LT
from trawl.session import materialize

# Fixed values that must equal the reference.
MAX_WORD_LENGTH = 512
BROADCAST_BYTES = 16 << 20  # of a lexicon, summed, as ``segment.LEXICON_LIMIT``
# Words for lexicons derived from text: runs of Unicode letters.
LEXICON_WORD_RE = r"\p{L}+"


def lexicon_from_text(df: DataFrame, text_col: str, tag: str) -> DataFrame:
    """(word, freq, tag): letter words of a text column with their counts."""
    words = df.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(LEXICON_WORD_RE), 0))
                      .alias("word"))
    return (words.groupBy("word").agg(F.count(F.lit(1)).cast("double").alias("freq"))
            .select("word", "freq", F.lit(tag).alias("tag")))


def lexicon_lines(lex: DataFrame) -> DataFrame:
    """(line) in the lexicon file format ``word freq tag``."""
    return lex.select(
        F.concat_ws(" ", F.col("word"), F.col("freq").cast("long").cast("string"), F.col("tag"))
        .alias("value"))


def with_weights(lex: DataFrame) -> DataFrame:
    """Add ``weight = ln(freq / sum(freq))`` (sum over every line)."""
    total = lex.select(F.sum("freq").alias("s")).scalar()
    return lex.withColumn("weight", F.ln(F.col("freq") / total))


KTH_RANGES = 1024


def kth_smallest(df: DataFrame, col: str, k: int):
    """The ``k``-th smallest value (0-based) of a numeric column, exactly, as a
    literal; null if there are no so many.

    Histogram refinement: count the values in equal ranges, go on with the range
    that holds element ``k``, until its values are all the same.  Every round is
    an aggregate of at most KTH_RANGES rows; nothing is sorted or numbered.
    """
    rows = materialize(df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull()), "order_statistic")
    n, lo, hi = rows.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    if not 0 <= k < n:
        return F.lit(None).cast("double")
    while lo < hi:
        # monotone in v, with the least value in the first range and the largest in the last
        place = F.least(F.floor((F.col("v") - lo) / (hi - lo) * KTH_RANGES), F.lit(KTH_RANGES - 1))
        ranges = rows.where(F.col("v").between(lo, hi)).groupBy(place.alias("r")).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("r").collect()
        for r in ranges:
            if k < r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
    return F.lit(lo)


def lexicon_stats(lex: DataFrame) -> DataFrame:
    """One row: (n_words, freq_sum, min_weight, max_weight, median_weight);
    the median is element ``n div 2`` of the sorted weights (no
    interpolation)."""
    w = materialize(with_weights(lex), "lexicon_weights")
    median = kth_smallest(w, "weight", w.count() // 2)
    return w.agg(F.count(F.lit(1)).alias("n_words"), F.sum("freq").alias("freq_sum"),
                 F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight")) \
        .withColumn("median_weight", median)


def parse_user_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """User-lexicon lines -> (word, freq, tag, line_no): ``word`` |
    ``word tag`` | ``word freq tag``; empty lines and other shapes skipped.
    ``freq`` is an integer (a missing, unreadable or zero freq means the default weight).
    """
    parts = T.split_fields(value_col, " ")
    n = F.size(parts)
    return (lines.where(F.col(value_col) != "")
            .withColumn("_p", parts).withColumn("_n", n)
            .where(F.col("_n").between(1, 3))
            .select(F.col("_p")[0].alias("word"),
                    F.when(F.col("_n") == 3, F.col("_p")[1].try_cast("int")).alias("freq"),
                    F.when(F.col("_n") == 2, F.col("_p")[1])
                     .when(F.col("_n") == 3, F.col("_p")[2]).otherwise(F.lit("")).alias("tag"),
                    *[c for c in lines.columns if c == "line_no"]))


def overlay(base: DataFrame, user: DataFrame, default: str = "median") -> DataFrame:
    """Lexicon with user words: (word, weight, tag, is_user).

    Base weights are ln(freq/sum); a user word with a frequency gets
    ln(freq/sum) with the base sum, otherwise the base median (or min/max)
    weight.  The last inserted line of a word wins: user lines after base
    lines, later lines after earlier ones.
    """
    bw = with_weights(base)
    total = base.select(F.sum("freq")).scalar()
    if default == "median":
        dflt = kth_smallest(bw, "weight", base.count() // 2)
    elif default == "min":
        dflt = bw.select(F.min("weight")).scalar()
    else:
        dflt = bw.select(F.max("weight")).scalar()
    b_line = F.col("line_no").cast("string") if "line_no" in base.columns else F.lit("")
    u_line = F.col("line_no").cast("string") if "line_no" in user.columns else F.lit("")
    b = bw.select("word", "weight", "tag", F.lit(False).alias("is_user"), F.lit(0).alias("prio"),
                  b_line.alias("line_no"))
    u = user.select("word", F.when(F.col("freq").isNotNull() & (F.col("freq") != 0),
                                   F.ln(F.col("freq") / total)).otherwise(dflt).alias("weight"),
                    F.coalesce(F.col("tag"), F.lit("")).alias("tag"), F.lit(True).alias("is_user"),
                    F.lit(1).alias("prio"), u_line.alias("line_no"))
    w = Window.partitionBy("word").orderBy(F.desc("prio"), F.desc("line_no"))
    return (b.unionByName(u).withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .drop("_r", "prio", "line_no"))


def active(lex: DataFrame) -> DataFrame:
    """One row per word (last line wins) with a weight: the trie's view."""
    if "weight" not in lex.columns:
        lex = with_weights(lex)
    order = F.desc("line_no") if "line_no" in lex.columns else F.lit(1)
    w = Window.partitionBy("word").orderBy(order)
    return (lex.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .select("word", "weight", "tag"))


def _bounded(lex: DataFrame) -> DataFrame:
    """The lexicon written once to the checkpoint folder (it is derived from
    whole tables; the sum and the broadcast then read the small table
    instead of re-deriving it), broadcast when its summed size fits: tokens
    joined by shuffle gather in the tasks of their most frequent words."""
    return _broadcast_small(materialize(lex, "lexicon"))


def _fits(lex: DataFrame, times: int = 1) -> bool:
    return (lex.agg(F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in lex.columns),
                              F.lit(16)))).first()[0] or 0) <= BROADCAST_BYTES * times


def _broadcast_small(lex: DataFrame) -> DataFrame:
    """A written lexicon, broadcast when its summed size fits."""
    return F.broadcast(lex) if _fits(lex) else lex


def lookup(words: DataFrame, lex: DataFrame, word_col: str = "word") -> DataFrame:
    """``words`` plus (in_lexicon, weight, tag) from the lexicon."""
    act = _bounded(active(lex)).withColumnRenamed("word", "_lw")
    return (words.join(act, F.col(word_col) == F.col("_lw"), "left")
            .withColumn("in_lexicon", F.col("_lw").isNotNull()).drop("_lw"))


def tag_tokens(tokens: DataFrame, lex: DataFrame, word_col: str = "word") -> DataFrame:
    """``tokens`` plus ``tag``: the lexicon tag when present and not empty,
    else the rule for unknown words (x / m / eng)."""
    act = _bounded(active(lex).select(F.col("word").alias("_lw"), F.col("tag").alias("_lt")))
    return (tokens.join(act, F.col(word_col) == F.col("_lw"), "left")
            .withColumn("tag", F.coalesce(F.when(F.col("_lt") != "", F.col("_lt")),
                                          T.tag_rule(word_col)))
            .drop("_lw", "_lt"))


EDGE_TYPES = {"word": ST.StringType(), "weight": ST.DoubleType(), "tag": ST.StringType(), "text": ST.StringType(), "stays": ST.BooleanType()}
EDGE_COLUMNS = ("word", "weight", "tag", "text")


def dag_edges(pieces: DataFrame, lex: DataFrame, max_word_len: int = MAX_WORD_LENGTH, columns=EDGE_COLUMNS) -> DataFrame:
    """Candidate-word graph: (doc_id, piece_pos, start, end, word, weight, tag, text).

    For every position of every piece, every lexicon word starting there of
    at most ``max_word_len`` characters; the one-character edge at every
    position is always present (``word`` null when that character is not a
    lexicon word).

    ``columns`` names those wanted after ``end``.  ``stays`` says whether the full cut
    keeps the edge, by its piece alone; a lexicon that is joined does not give it.
    """
    act = materialize(active(lex), "lexicon_active")
    cap = max(1, int(max_word_len))
    if not _fits(act, LT.TIMES):
        return _joined_edges(pieces, act, cap).select("doc_id", "piece_pos", "start", "end", *[c for c in columns if c != "stays"])
    rows = [r for r in act.select("word", "weight", "tag").toLocalIterator() if r[0] and r[1] is not None]
    words, weights, tags = map(list, zip(*rows)) if rows else ([], [], [])
    shared = pieces.sparkSession.sparkContext.broadcast((LT.Trie(words, weights), pa.array(words, pa.string()), pa.array(tags, pa.string())))
    schema = ST.StructType(pieces.select("doc_id", "piece_pos").schema.fields).add("start", ST.IntegerType()).add("end", ST.IntegerType())
    for c in columns:
        schema = schema.add(c, EDGE_TYPES[c])
    return pieces.where(F.col("piece") != "").select("doc_id", "piece_pos", "piece").mapInArrow(
        _edge_batches(shared, cap, tuple(columns)), schema)


def _edge_batches(shared, cap: int, columns: tuple):
    def fn(batches):
        trie, words, tags = shared.value
        for some in LT.gathered(batches, "piece"):
            for batch in some:
                found = batch.column("piece").dictionary_encode()
                parts = [LT.Pieces(p, trie, cap) for p in LT.blocks(found.dictionary.to_pylist())]
                edges = [p.edges() for p in parts]
                pos, size, word, stays = (np.concatenate(x) for x in zip(*edges))
                counts = np.concatenate([np.bincount(p.piece[e[0]], minlength=len(p.names)) for p, e in zip(parts, edges)])
                start = np.concatenate([e[0] - p.starts[p.piece[e[0]]] for p, e in zip(parts, edges)])
                # of the distinct pieces' edges; those of the rows are taken from them
                place = pa.array(word, mask=word < 0)
                cols = {"start": pa.array(start, pa.int32()), "end": pa.array(start + size - 1, pa.int32())}
                for c in columns:
                    cols[c] = (pa.array(stays) if c == "stays" else words.take(place) if c == "word" else tags.take(place) if c == "tag"
                               else pa.array(trie.weights).take(place) if c == "weight"
                               else pa.concat_arrays([p.texts(*e[:2]) for p, e in zip(parts, edges)]))
                codes = found.indices.to_numpy()
                first, n = (np.cumsum(counts) - counts)[codes], counts[codes]
                ends = np.cumsum(n)
                at = 0
                while at < len(n):  # rows of some pieces at a time
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LT.ROWS, side="right")))
                    rows, own = pa.array(np.repeat(np.arange(at, to), n[at:to])), pa.array(LT.ragged(first[at:to], n[at:to]))
                    out = [batch.column("doc_id").take(rows), batch.column("piece_pos").take(rows), *(c.take(own) for c in cols.values())]
                    yield from LT.slices(pa.RecordBatch.from_arrays(out, ["doc_id", "piece_pos", *cols]))
                    at = to
    return fn


def _joined_edges(pieces: DataFrame, act: DataFrame, cap: int) -> DataFrame:
    """``dag_edges`` of a lexicon of any size, by joins.

    Candidate substrings are bounded exactly, like a trie walk that stops at a
    dead prefix: a start whose two-character prefix begins no lexicon word
    keeps only its one-character edge, otherwise lengths go up to the longest
    lexicon word with that prefix (a table with one row per prefix, joined on
    the prefix).  The explode therefore stays proportional to the text.
    """
    n = F.char_length("piece")
    starts = pieces.select("doc_id", "piece_pos", "piece",
                           F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    if cap > 1:
        prefixes = (act.where(F.char_length("word") >= 2)
                    .groupBy(F.substring("word", 1, 2).alias("p2"))
                    .agg(F.max(F.char_length("word")).alias("maxlen")))
        prefixes = _broadcast_small(materialize(prefixes, "lexicon_prefixes"))
        starts = (starts.withColumn("p2", F.call_function("substring", F.col("piece"),
                                                          F.col("start") + 1, F.lit(2)))
                  .join(prefixes, "p2", "left"))
        top = F.least(F.lit(cap), F.coalesce(F.col("maxlen"), F.lit(1)), n - F.col("start"))
    else:
        top = F.lit(1)
    cands = (starts.select("doc_id", "piece_pos", "piece", "start",
                           F.explode(F.sequence(F.lit(1), top)).alias("len"))
             .select("doc_id", "piece_pos", "start", "len",
                     F.call_function("substring", F.col("piece"), F.col("start") + 1, F.col("len"))
                     .alias("sub")))
    lw = _broadcast_small(act.select(F.col("word").alias("sub"), "weight", "tag"))
    edges = cands.join(lw, "sub", "left").where(F.col("weight").isNotNull() | (F.col("len") == 1))
    return edges.select("doc_id", "piece_pos", "start", (F.col("start") + F.col("len") - 1).alias("end"),
                        F.when(F.col("weight").isNotNull(), F.col("sub")).alias("word"),
                        "weight", "tag", F.col("sub").alias("text"))


def full_cut(edges: DataFrame) -> DataFrame:
    """Every lexicon word of two or more characters at every position; a
    position's own character only when no such word starts there and no
    earlier word covers it: (doc_id, piece_pos, start, end, word).  Edges that know
    whether they stay (of pieces that no other row shares its document and place with)
    are not brought together again."""
    if "stays" in edges.columns:
        return edges.where("stays").select("doc_id", "piece_pos", "start", "end", F.col("text").alias("word"))
    is_word = F.col("word").isNotNull()
    span = F.when(is_word, F.col("end") + 1)
    w_prev = (Window.partitionBy("doc_id", "piece_pos").orderBy("start")
              .rangeBetween(Window.unboundedPreceding, -1))
    w_here = Window.partitionBy("doc_id", "piece_pos", "start")
    e = (edges.withColumn("cover", F.max(span).over(w_prev))
         .withColumn("longer_here", F.max(F.when(is_word & (F.col("end") > F.col("start")), 1)).over(w_here)))
    single = ((F.col("end") == F.col("start")) & F.col("longer_here").isNull()
              & (F.col("cover").isNull() | (F.col("cover") <= F.col("start"))))
    keep = (is_word & (F.col("end") > F.col("start"))) | single
    return e.where(keep).select("doc_id", "piece_pos", "start", "end", F.col("text").alias("word"))


def search_cut(tokens: DataFrame, lex: DataFrame) -> DataFrame:
    """Before each token longer than 2 (3) characters, its lexicon 2-grams
    (3-grams), left to right: (doc_id, pos, sub, word), ordered by (pos, sub).
    """
    n = F.char_length("word")
    # the tokens are read once: a row for each 2-gram, each 3-gram and the token itself
    twos, threes = F.when(n > 2, n - 1).otherwise(0), F.when(n > 3, n - 2).otherwise(0)
    rows = tokens.select("doc_id", "pos", "word", twos.alias("twos"), threes.alias("threes"),
                         F.explode(F.sequence(F.lit(0), twos + threes)).alias("i"))
    two, three = F.col("i") < F.col("twos"), F.col("i") < F.col("twos") + F.col("threes")
    at = F.when(two, F.col("i")).otherwise(F.col("i") - F.col("twos"))
    gram = F.call_function("substring", F.col("word"), at + 1, F.when(two, 2).otherwise(3))
    rows = rows.select("doc_id", "pos", F.when(two, at).when(three, at + 1_000_000).otherwise(2_000_000).alias("sub"),
                       F.when(three, gram).otherwise(F.col("word")).alias("word"), three.alias("gram"))
    words = _bounded(active(lex).select(F.col("word").alias("_lw")).distinct())
    # a token itself is looked up by null: it matches nothing and stays
    return (rows.join(words, F.when(F.col("gram"), F.col("word")) == F.col("_lw"), "left")
            .where(~F.col("gram") | F.col("_lw").isNotNull()).select("doc_id", "pos", "sub", "word"))
