"""A four-state HMM (begin, end, middle, single) estimated from a lexicon.

The HMM cut only ever labels runs of non-ASCII characters, so the model is
estimated on such runs of the lexicon's words, each weighted by the word's
frequency: Spark counts the states of first characters, state pairs inside a
run and characters per state.  Between two words the next state depends on
nothing but the start probabilities.  The result is written in the model file
format that ``segment.load_hmm_model`` reads.  Log-probabilities have nine
decimals, so that a written and read model cuts the same on every engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.operators.segment import MIN_DOUBLE, HmmModel

RUN = r"[^\x00-\x7F]+"
# Order of the states in the model file, and its spelling of "never".
STATES = ("B", "E", "M", "S")
NEVER = "-3.14e+100"


def labelled(lex: DataFrame) -> DataFrame:
    """(freq, first, state, following, ch): one row a character of the runs in the
    lexicon's words (word, freq)."""
    runs = lex.select("freq", F.explode(F.regexp_extract_all("word", F.lit(RUN), 0)).alias("run"))
    runs = runs.select("freq", F.char_length("run").alias("n"), F.col("run"))
    chars = runs.select("freq", "n", F.posexplode(F.slice(F.split("run", ""), 1, F.col("n"))).alias("i", "ch"))
    last = F.col("i") == F.col("n") - 1
    state = F.when(F.col("n") == 1, "S").when(F.col("i") == 0, "B").when(last, "E").otherwise("M")
    following = F.when(last, None).when(F.col("i") == F.col("n") - 2, "E").otherwise("M")
    return chars.select("freq", (F.col("i") == 0).alias("first"), state.alias("state"), following.alias("following"), "ch")


def _share(n, total):
    """ln(n / total) with nine decimals, as text."""
    return F.ln(n / total).cast("decimal(18,9)").cast("string")


def model_lines(lex: DataFrame) -> DataFrame:
    """(line_no, value): the nine lines of the model file."""
    counts = labelled(lex).groupBy("first", "state", "following", "ch").agg(F.sum("freq").alias("n"))
    counts = counts.where("n > 0")
    spark = lex.sparkSession

    def of(rows: DataFrame, key: str) -> DataFrame:
        """(state, key, p) by state."""
        n = rows.groupBy("state", key).agg(F.sum("n").alias("n"))
        total = n.groupBy("state").agg(F.sum("n").alias("total"))
        return n.join(F.broadcast(total), "state").select("state", key, _share(F.col("n"), F.col("total")).alias("p"))

    begin = counts.where("first").withColumn("following", F.col("state")).withColumn("state", F.lit("start"))
    moves = of(begin.unionByName(counts.where("following IS NOT NULL")), "following")
    # after the end of a word comes the start of the next one
    again = moves.where("state = 'start'")
    moves = moves.unionByName(again.withColumn("state", F.lit("E"))).unionByName(again.withColumn("state", F.lit("S")))
    lines = spark.createDataFrame([(i, s) for i, s in enumerate(("start", *STATES))], "line_no int, state string")
    cells = lines.join(moves, "state", "left").groupBy("line_no").agg(
        *[F.coalesce(F.max(F.when(F.col("following") == s, F.col("p"))), F.lit(NEVER)).alias(s) for s in STATES])
    head = cells.select("line_no", F.concat_ws(" ", *STATES).alias("value"))
    order = spark.createDataFrame([(5 + i, s) for i, s in enumerate(("B", "E", "M", "S"))], "line_no int, state string")
    emitted = of(counts, "ch").groupBy("state").agg(  # a state's line is bounded by the alphabet
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "ch", "p"))), ",").alias("value"))
    return head.unionByName(order.join(emitted, "state", "left").select("line_no", "value"))


def write_model(lex: DataFrame, path: str) -> None:
    """The model of ``lex`` as one file of nine lines.  The format allows no empty
    line: a state without characters gets a noncharacter that is never emitted."""
    lines = model_lines(lex).collect()  # nine lines, bounded by the alphabet
    rows = [(r["value"] or f"\uffff:{NEVER}",) for r in sorted(lines, key=lambda r: r["line_no"])]
    lex.sparkSession.createDataFrame(rows, "value string").coalesce(1).write.text(path)


def model_rows(spark: SparkSession, model: HmmModel) -> DataFrame:
    """(part, state, key, log_p): a loaded model as a table; probabilities that are
    never are left out."""
    rows = [("start", s, "", p) for s, p in zip(STATES, model.start)]
    rows += [("move", s, t, p) for s, line in zip(STATES, model.trans) for t, p in zip(STATES, line)]
    rows += [("emit", s, c, p) for s, m in zip(STATES, model.emit) for c, p in m.items()]
    return spark.createDataFrame([r for r in rows if r[3] > MIN_DOUBLE], "part string, state string, key string, log_p double")
