"""DuckDB SQL of the queries over lexicon tokens and the estimated HMM.

The cuts are made on the distinct pieces, as recursive CTEs, and joined to the
documents' pieces."""

from __future__ import annotations

from trawl.functions.text import LATIN_TOKEN_RE
from trawl.plans.oracle import (BENCH_Q, CHAMPIONS, DOCS, EDGES_LEX, IDF, LEX, MIX_WORDS, POSTINGS, SEP_RE, _lower,
                                _mp_words, _search)

_NEVER = "CAST(-3.14e100 AS DOUBLE)"
_LN = "CAST(CAST(ln(c / sum(c) OVER (PARTITION BY st)) AS DECIMAL(18, 9)) AS DOUBLE)"

# states of the characters in non-ASCII runs of the words of ``documents``
MODEL = rf"""
hw AS (SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(text, '\p{{L}}+', 0)) AS word FROM documents) GROUP BY word),
hr AS (SELECT unnest(regexp_extract_all(word, '[^\x00-\x7F]+', 0)) AS run, freq FROM hw),
hx AS (SELECT run, freq, length(run) AS n, unnest(generate_series(1, length(run))) AS i FROM hr),
hl AS (
  SELECT freq, i, substring(run, i, 1) AS ch,
         CASE WHEN n = 1 THEN 'S' WHEN i = 1 THEN 'B' WHEN i = n THEN 'E' ELSE 'M' END AS st,
         CASE WHEN i = n THEN NULL WHEN i = n - 1 THEN 'E' ELSE 'M' END AS nx
  FROM hx
),
moves0 AS (
  SELECT 'start' AS st, st AS nx, sum(freq) AS c FROM hl WHERE i = 1 GROUP BY ALL
  UNION ALL SELECT st, nx, sum(freq) AS c FROM hl WHERE nx IS NOT NULL GROUP BY ALL
),
moves1 AS (SELECT st, nx, {_LN} AS p FROM moves0),
moves AS (
  SELECT st, nx, p FROM moves1
  UNION ALL SELECT 'E', nx, p FROM moves1 WHERE st = 'start'
  UNION ALL SELECT 'S', nx, p FROM moves1 WHERE st = 'start'
),
emits AS (SELECT st, ch, {_LN} AS p FROM (SELECT st, ch, sum(freq) AS c FROM hl GROUP BY st, ch))"""


def _viterbi(units: str) -> str:
    """``vtok(run, j, word)``: the cut of the distinct non-ASCII runs of ``units`` (run);
    states in the order B, E, M, S."""
    def cell(a, b):
        return f"coalesce((SELECT p FROM moves WHERE st = '{a}' AND nx = '{b}'), {_NEVER})"

    steps = ", ".join(cell(a, b) for a in "BEMS" for b in "BEMS")
    joins = " ".join(f"LEFT JOIN emits {s} ON {s}.st = '{s}' AND {s}.ch = substring(v.run, v.i, 1)" for s in "BEMS")
    return f"""
mv AS (SELECT [{steps}] AS t, [{', '.join(cell('start', b) for b in 'BEMS')}] AS s0),
vch AS (SELECT run, unnest(generate_series(1, length(run))) AS i FROM (SELECT DISTINCT run FROM {units})),
vem AS (
  SELECT run, list(e ORDER BY i) AS ems
  FROM (SELECT v.run, v.i, [{', '.join(f'coalesce({s}.p, {_NEVER})' for s in 'BEMS')}] AS e FROM vch v {joins})
  GROUP BY run
),
vit AS (
  WITH RECURSIVE r(run, ems, i, w, bp) AS (
    SELECT run, ems, 1, list_transform([1, 2, 3, 4], lambda y: s0[y] + ems[1][y]), CAST([] AS INTEGER[][]) FROM vem, mv
    UNION ALL
    SELECT run, ems, i + 1, list_transform(sums, lambda x: greatest(list_max(x), {_NEVER})),
           list_append(bp, list_transform(sums, lambda x: CAST(CASE WHEN list_max(x) > {_NEVER} THEN list_position(x, list_max(x)) ELSE 2 END AS INTEGER)))
    FROM (SELECT run, ems, i, bp, list_transform([1, 2, 3, 4], lambda y:
                   [w[1] + t[y] + ems[i + 1][y], w[2] + t[4 + y] + ems[i + 1][y],
                    w[3] + t[8 + y] + ems[i + 1][y], w[4] + t[12 + y] + ems[i + 1][y]]) AS sums
          FROM r, mv WHERE i < len(ems))
  )
  SELECT run, list_reverse(list_reduce(list_concat([[CAST(CASE WHEN w[2] >= w[4] THEN 2 ELSE 4 END AS INTEGER)]], list_reverse(bp)),
                                       lambda a, b: list_append(a, b[a[len(a)]]))) AS states
  FROM r WHERE i = len(ems)
),
vtok AS (
  SELECT run, j, string_agg(ch, '' ORDER BY i) AS word
  FROM (SELECT run, i, substring(run, i, 1) AS ch, len(list_filter(states[1:i - 1], lambda s: s IN (2, 4))) AS j
        FROM (SELECT run, states, unnest(generate_series(1, length(run))) AS i FROM vit))
  GROUP BY run, j
)"""


_UNITS = rf"'[^\x00-\x7F]+|{LATIN_TOKEN_RE}'"

# dist(doc_id, text): the distinct pieces of dpieces (doc_id, field, piece_pos, piece)
DIST = "dist AS (SELECT row_number() OVER (ORDER BY piece) AS doc_id, piece AS text FROM (SELECT DISTINCT piece FROM dpieces))"
_EDGES = EDGES_LEX.replace("FROM documents", "FROM dist")

# htok / mtok (doc_id, s, k, j, word): HMM cut and mixed cut of the distinct pieces
CUTS = f"""
hunit AS (
  SELECT doc_id, unnest(generate_series(1, len(t))) AS k, unnest(t) AS unit
  FROM (SELECT doc_id, regexp_extract_all(text, {_UNITS}, 0) AS t FROM dist)
),
munit AS (
  SELECT doc_id, s, unnest(generate_series(1, len(t))) AS k, unnest(t) AS unit
  FROM (SELECT doc_id, s, regexp_extract_all(run, {_UNITS}, 0) AS t FROM runs)
),
vsrc AS (SELECT unit AS run FROM hunit WHERE unicode(unit) > 127 UNION ALL SELECT unit FROM munit WHERE unicode(unit) > 127),
{_viterbi('vsrc')},
htok AS (
  SELECT doc_id, 0 AS s, k, coalesce(j, 0) AS j, coalesce(word, unit) AS word FROM hunit LEFT JOIN vtok ON run = unit
),
mtok AS (
  SELECT doc_id, s, 0 AS k, 0 AS j, word FROM isl WHERE NOT single
  UNION ALL
  SELECT doc_id, s, k, coalesce(j, 0), coalesce(word, unit) FROM munit LEFT JOIN vtok ON run = unit
),
mord AS (
  SELECT doc_id, word, row_number() OVER w AS o, coalesce(sum(length(word)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM mtok WINDOW w AS (PARTITION BY doc_id ORDER BY s, k, j)
),
hord AS (
  SELECT doc_id, word, row_number() OVER w AS o, coalesce(sum(length(word)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM htok WINDOW w AS (PARTITION BY doc_id ORDER BY s, k, j)
),
lw AS (SELECT DISTINCT word FROM lex),
sgram AS (
  SELECT doc_id, o, place, i, size, substring(word, i + 1, size) AS word
  FROM (SELECT m.*, size, unnest(generate_series(0, length(word) - size)) AS i FROM mord m, (VALUES (2), (3)) z(size) WHERE length(word) > size)
),
sord AS (
  SELECT doc_id, o, size, i, place + i AS place, word FROM sgram SEMI JOIN lw USING (word)
  UNION ALL SELECT doc_id, o, 9, 0, place, word FROM mord
)"""

_DOC_PIECES = f"""
dpieces AS (
  SELECT doc_id, unnest(generate_series(0, len(p) - 1)) AS piece_pos, unnest(p) AS piece
  FROM (SELECT doc_id, regexp_extract_all(text, '{SEP_RE}', 0) AS p FROM documents)
)"""

_PLACED = """
placed AS (
  SELECT p.*, coalesce(sum(length(piece)) OVER w, 0) AS char0, coalesce(sum(strlen(piece)) OVER w, 0) AS byte0, d.doc_id AS pid
  FROM dpieces p JOIN dist d ON d.text = p.piece
  WINDOW w AS (PARTITION BY p.doc_id ORDER BY p.piece_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""

_FULL = """
e2 AS (
  SELECT *, max(CASE WHEN word IS NOT NULL THEN "end" + 1 END) OVER (
              PARTITION BY doc_id ORDER BY start RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cover,
         max(CASE WHEN word IS NOT NULL AND "end" > start THEN 1 END) OVER (PARTITION BY doc_id, start) AS longer_here
  FROM dag
),
ford AS (
  SELECT doc_id, start, "end", text AS word FROM e2
  WHERE (word IS NOT NULL AND "end" > start)
     OR ("end" = start AND longer_here IS NULL AND (cover IS NULL OR cover <= start))
)"""


def _page_pieces() -> str:
    def part(field, at):
        return f"""SELECT doc_id, {at} AS field, unnest(generate_series(0, len(p) - 1)) AS piece_pos, unnest(p) AS piece
  FROM (SELECT doc_id, regexp_extract_all({field}, '{SEP_RE}', 0) AS p FROM docs)"""
    return f"dpieces AS ({part('title', 10)} UNION ALL {part('content', 1)})"


# postings over the search cut, in the shape of the run-token postings
_LEX_POSTINGS = f"""
{_page_pieces()}, {DIST}, {_EDGES}, {_mp_words(512)}, {MIX_WORDS}, {MODEL}, {CUTS},
ptok AS (SELECT d.text AS piece, s.word FROM sord s JOIN dist d USING (doc_id)),
psize AS (SELECT piece, count(*) AS n FROM ptok GROUP BY piece),
ntok AS (SELECT p.doc_id, sum(n) AS n_tokens FROM dpieces p JOIN psize USING (piece) GROUP BY p.doc_id),
tf AS (
  SELECT p.doc_id, {_lower('t.word')} AS word, sum(field) AS cnt, any_value(n_tokens) AS n_tokens
  FROM dpieces p JOIN ptok t USING (piece) JOIN ntok ON ntok.doc_id = p.doc_id
  WHERE regexp_matches(t.word, '^[A-Za-z]') GROUP BY 1, 2
),
{POSTINGS[POSTINGS.index('dfreq AS'):]}"""

_QUERY_PIECES = """
qpieces AS (
  SELECT query_id, unnest(p) AS piece FROM (SELECT query_id, regexp_extract_all(query, '{sep}', 0) AS p FROM bq)
)"""


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["index_increment"] = f"""
WITH {DOCS}, {POSTINGS}
SELECT word, doc_id, round(tf, 10) AS tf, round(idf, 10) AS idf, round(weight, 10) AS weight FROM postings"""

    q["user_lexicon_load"] = f"""
WITH {DOCS}, {LEX}
SELECT word, CAST(coalesce(freq, 0) AS BIGINT) AS freq, tag FROM usr
UNION ALL
SELECT word, CAST(freq AS BIGINT), 'late' FROM base WHERE word NOT IN (SELECT word FROM usr)"""

    q["hmm_model_load"] = f"""
WITH {MODEL}
SELECT 'start' AS part, nx AS state, '' AS key, p AS log_p FROM moves WHERE st = 'start'
UNION ALL SELECT 'move', st, nx, p FROM moves WHERE st <> 'start'
UNION ALL SELECT 'emit', st, ch, p FROM emits"""

    lexicon = f"{DOCS}, {LEX}, {_DOC_PIECES}, {DIST}, {_EDGES}, {_mp_words(512)}, {MIX_WORDS}, {MODEL}, {CUTS}, {_PLACED}"
    for name, source in (("segment_hmm", "hord"), ("segment_mix_hmm", "mord")):
        q[name] = f"""
WITH {lexicon}
SELECT p.doc_id, CAST(row_number() OVER (PARTITION BY p.doc_id ORDER BY p.piece_pos, t.o) - 1 AS BIGINT) AS pos, t.word
FROM placed p JOIN {source} t ON t.doc_id = p.pid"""

    def mode(name, source, order):
        return f"""
SELECT '{name}' AS mode, p.doc_id, CAST(row_number() OVER (PARTITION BY p.doc_id ORDER BY p.piece_pos, {order}) - 1 AS BIGINT) AS pos,
       t.word, CAST(byte0 + strlen(substring(piece, 1, CAST(t.place AS BIGINT))) AS BIGINT) AS "offset",
       CAST(char0 + t.place AS BIGINT) AS unicode_offset, CAST(length(t.word) AS BIGINT) AS unicode_length
FROM placed p JOIN {source} t ON t.doc_id = p.pid"""

    q["segment_offsets"] = f"""
WITH {lexicon}, {_FULL},
every AS ({mode('mp', '(SELECT doc_id, s AS place, word FROM mpw)', 't.place')}
UNION ALL {mode('hmm', 'hord', 't.o')}
UNION ALL {mode('mix', 'mord', 't.o')}
UNION ALL {mode('full', '(SELECT doc_id, start AS place, "end" AS e, word FROM ford)', 't.place, t.e')}
UNION ALL {mode('search', 'sord', 't.o, t.size, t.i')})
SELECT mode, doc_id, count(*) AS n_tokens,
       md5(string_agg(word || ':' || "offset" || ':' || unicode_offset || ':' || unicode_length, ',' ORDER BY pos)) AS places_md5
FROM every GROUP BY mode, doc_id"""

    q["postings_lexicon"] = f"""
WITH {DOCS}, {LEX}, {_LEX_POSTINGS}
SELECT word, doc_id, round(tf, 10) AS tf, round(idf, 10) AS idf, round(weight, 10) AS weight FROM postings"""

    # the queries' pieces are cut together with the documents'
    both = _LEX_POSTINGS.replace("SELECT DISTINCT piece FROM dpieces", "SELECT piece FROM dpieces UNION SELECT piece FROM qpieces")
    q["search_lexicon"] = f"""
WITH {DOCS}, {LEX}, {BENCH_Q}, {_QUERY_PIECES.format(sep=SEP_RE)}, {both}, {CHAMPIONS},
qw AS (
  SELECT DISTINCT query_id, {_lower('t.word')} AS word FROM qpieces JOIN ptok t USING (piece)
  WHERE regexp_matches({_lower('t.word')}, '^[a-z]')
), {_search('champions')}
SELECT query_id, rank, doc_id, word, round(weight, 10) AS weight, title, url, "desc" FROM results"""

    q["keywords_tfidf_lexicon"] = f"""
WITH {lexicon}, {POSTINGS}, {IDF},
dtok0 AS (SELECT doc_id, unnest(regexp_extract_all(text, '{LATIN_TOKEN_RE}', 0)) AS word FROM documents),
stop AS (SELECT word FROM (SELECT word, count(*) AS c FROM dtok0 WHERE length(word) > 1 GROUP BY word ORDER BY c DESC, word LIMIT 50)),
ktok AS (
  SELECT p.doc_id, t.word, CAST(byte0 + strlen(substring(piece, 1, CAST(t.place AS BIGINT))) AS BIGINT) AS "offset"
  FROM placed p JOIN mord t ON t.doc_id = p.pid
  WHERE length(t.word) > 1 AND t.word NOT IN (SELECT word FROM stop)
),
counts AS (
  SELECT doc_id, word, count(*) AS tf, array_to_string(list("offset" ORDER BY "offset"), ',') AS offsets FROM ktok GROUP BY doc_id, word
),
scored AS (
  SELECT c.doc_id, c.word, c.offsets, c.tf * coalesce(i.idf, (SELECT a FROM idfavg)) AS weight FROM counts c LEFT JOIN idf i USING (word)
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 12) DESC, word) AS rank FROM scored)
SELECT doc_id, CAST(rank AS BIGINT) AS rank, word, offsets, round(weight, 10) AS weight FROM ranked WHERE rank <= 5"""
    return q
