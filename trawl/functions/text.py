"""Column expressions for text handling -- all built-in, JVM-side Spark SQL.

Every function takes and returns ``pyspark.sql.Column`` so it composes inside
``select``/``withColumn`` and stays in whole-stage codegen.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# ---------------------------------------------------------------------------
# Tokenizer for text without lexicon words: a letter followed by letters or
# digits, a digit followed by digits or dots, any other single character.
LATIN_TOKEN_RE = r"[A-Za-z][A-Za-z0-9]*|[0-9][0-9.]*|(?s:.)"
# The multi-character alternatives alone.  Letters never fall inside a number
# or single-character token, so the letter runs found by LETTER_RUN_RE are
# exactly the letter tokens of LATIN_TOKEN_RE; likewise for RUN_RE.
RUN_RE = r"[A-Za-z][A-Za-z0-9]*|[0-9][0-9.]*"
LETTER_RUN_RE = r"[A-Za-z][A-Za-z0-9]*"
# Default pre-split separators: space, tab, newline, full-width comma and
# full-width full stop.
DEFAULT_SEPARATORS = " \t\n，。"
# A title occurrence weighs 10, a body occurrence 1.
TITLE_WEIGHT = 10
BODY_WEIGHT = 1
# Result cap per query (the reference stops after 101 documents).
RESULT_LIMIT = 101
# Snippet: start 80 characters before the match, 160 characters, then "...".
SNIPPET_BEFORE = 80
SNIPPET_LENGTH = 160
SNIPPET_TAIL = "..."
# Query-log cache expiry in seconds (sliding).
CACHE_TTL_SECONDS = 1800

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ascii_lower(col) -> Column:
    """Lower-case A-Z only (C-locale ``tolower``); other characters untouched."""
    return F.translate(_c(col), _UPPER, _LOWER)


def latin_tokens(col) -> Column:
    """ARRAY<STRING> of tokens; the tokens tile the text exactly."""
    return F.regexp_extract_all(_c(col), F.lit(LATIN_TOKEN_RE), 0)


def letter_runs(col) -> Column:
    """ARRAY<STRING> of the tokens that start with an ASCII letter."""
    return F.regexp_extract_all(_c(col), F.lit(LETTER_RUN_RE), 0)


def runs(col) -> Column:
    """ARRAY<STRING> of the letter and number tokens (every token longer than
    one character is one of them)."""
    return F.regexp_extract_all(_c(col), F.lit(RUN_RE), 0)


def run_gaps(col) -> Column:
    """Text between consecutive runs: element i precedes run i (size = runs + 1)."""
    return F.split(_c(col), RUN_RE, -1)


def token_count(col) -> Column:
    """Number of tokens: every run collapses to one character, every other
    character is a token of its own."""
    return F.char_length(F.regexp_replace(_c(col), RUN_RE, "x"))


def starts_with_ascii_letter(col) -> Column:
    """True when the first character is in [A-Za-z] (index-word predicate)."""
    code = F.ascii(_c(col))
    return ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122))


def starts_with_lower_letter(col) -> Column:
    """True when the first character is in [a-z] (query-word predicate)."""
    code = F.ascii(_c(col))
    return (code >= 97) & (code <= 122)


def ensure_final_newline(col) -> Column:
    """Whole-file read that appends a newline to the last line if missing."""
    c = _c(col)
    return F.when((c == "") | c.endswith("\n"), c).otherwise(F.concat(c, F.lit("\n")))


def html_title(col) -> Column:
    """Text between the first ``<title>`` and the next ``</title>`` ('' if none)."""
    return F.regexp_extract(_c(col), r"(?s)<title>(.*?)</title>", 1)


def html_body(col) -> Column:
    """Drop ``<...>`` spans (an unclosed ``<`` drops to the end); newline -> space."""
    return F.translate(F.regexp_replace(_c(col), r"<[^>]*>?", ""), "\n", " ")


def snippet(content, word) -> Column:
    """160 characters around the first case-sensitive occurrence of ``word``."""
    body = _c(content)
    pos = F.call_function("instr", body, _c(word))  # 1-based, 0 = absent
    start = F.when(pos > 0, F.greatest(F.lit(0), pos - 1 - SNIPPET_BEFORE)).otherwise(F.lit(0))
    return F.concat(_substr(body, start + 1, SNIPPET_LENGTH), F.lit(SNIPPET_TAIL))


def _substr(col: Column, start: Column, length: int) -> Column:
    # F.substring needs literal ints before 3.5; the SQL function takes columns.
    return F.call_function("substring", col, start, F.lit(length))


def is_ascii(col) -> Column:
    return _c(col).rlike(r"^[\x00-\x7F]*$")


def is_single_char(col) -> Column:
    return F.char_length(_c(col)) == 1


def tag_rule(col) -> Column:
    """Part-of-speech tag for a word the lexicon does not tag.

    Scan the characters, counting ASCII ones, until that count reaches
    ``length div 2``.  No ASCII character seen -> ``x`` (so every one-character
    word is ``x``); every seen ASCII character a digit -> ``m``; else ``eng``.
    """
    w = _c(col)
    seen = F.call_function("substring", F.regexp_replace(w, r"[^\x00-\x7F]", ""), F.lit(1),
                           F.floor(F.char_length(w) / 2).cast("int"))
    return (F.when(F.char_length(w) == 1, F.lit("x"))
            .when(seen == "", F.lit("x"))
            .when(seen.rlike(r"\A[0-9]+\z"), F.lit("m"))
            .otherwise(F.lit("eng")))


def signed_byte_key(col) -> Column:
    """Hex spelling of the UTF-8 bytes in which plain string order equals the
    order of the bytes compared as *signed* chars (high bit flipped per byte).

    Lambda functions are fine here: it is applied to query words only.
    """
    pairs = F.regexp_extract_all(F.hex(F.encode(_c(col), "UTF-8")), F.lit(".."), 0)
    flipped = F.transform(pairs, lambda p: F.concat(
        F.translate(F.substring(p, 1, 1), "0123456789ABCDEF", "89ABCDEF01234567"),
        F.substring(p, 2, 1)))
    return F.array_join(flipped, "")


def canonical_key(tokens, delimiter: str = "") -> Column:
    """Cache key of a query: every token lower-cased (C locale), ordered by
    first byte, then byte length, then bytes (signed comparison), joined with
    no delimiter -- so "LOVE YOU" and "YOU LOVE" share a key."""
    keyed = F.transform(_c(tokens), lambda t: F.struct(
        F.substring(signed_byte_key(ascii_lower(t)), 1, 2).alias("b0"),
        F.octet_length(ascii_lower(t)).alias("n"),
        signed_byte_key(ascii_lower(t)).alias("k"),
        ascii_lower(t).alias("w")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["w"]), delimiter)


def split_fields(col, chars: str = " ", maxsplit: int | None = None) -> Column:
    """Split on any character of ``chars``; empty inner fields are kept but a
    trailing delimiter yields no empty last field (and "" yields no field).
    With ``maxsplit`` the rest after that many fields stays one field."""
    cls = "[" + "".join("\\" + c if c in "\\^]-[" else c for c in chars) + "]"
    arr = F.split(_c(col), cls, -1 if maxsplit is None else maxsplit + 1)
    return F.when(F.element_at(arr, -1) == "", F.slice(arr, 1, F.size(arr) - 1)).otherwise(arr)


def split_fields_py(s: str, chars: str = " ") -> list[str]:
    """The same rule for driver-side parsing of small files."""
    fields = re.split("[" + re.escape(chars) + "]", s)
    return fields if fields[-1] else fields[:-1]
