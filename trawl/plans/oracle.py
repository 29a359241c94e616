"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Written independently from the Spark code: plain SQL over the driver's
views.  Doubles are rounded to 10 digits on both sides and counts are BIGINT.
"""

from __future__ import annotations

from trawl.functions.text import LATIN_TOKEN_RE

_TOK = "'" + LATIN_TOKEN_RE + "'"
_UP = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_LO = "'abcdefghijklmnopqrstuvwxyz'"


def _lower(x: str) -> str:
    return f"translate({x}, {_UP}, {_LO})"


# pages -> accepted documents (doc_id, title, url, content)
DOCS = f"""
raw AS (
  SELECT page_id, url,
         CASE WHEN html = '' OR suffix(html, chr(10)) THEN html ELSE html || chr(10) END AS h
  FROM pages
),
docs AS (
  SELECT page_id AS doc_id,
         regexp_extract(h, '(?s)<title>(.*?)</title>', 1) AS title,
         url,
         translate(regexp_replace(h, '<[^>]*>?', '', 'g'), chr(10), ' ') AS content
  FROM raw
  WHERE regexp_extract(h, '(?s)<title>(.*?)</title>', 1) <> ''
)"""

# documents table in the document-table shape
DOCUMENT_TABLE = """
docs AS (
  SELECT doc_id,
         split_part(text, chr(10), 1) AS title,
         source || '/' || CAST(doc_id AS VARCHAR) AS url,
         text AS content
  FROM documents
)"""

# docs -> postings (word, doc_id, cnt, n_tokens, tf, df, n, idf, weight)
POSTINGS = f"""
per_doc AS (
  SELECT doc_id,
         regexp_extract_all(title, {_TOK}, 0) AS tt,
         regexp_extract_all(content, {_TOK}, 0) AS bt
  FROM docs
),
tok AS (
  SELECT doc_id, len(tt) + len(bt) AS n_tokens, unnest(tt) AS w, 10 AS c FROM per_doc
  UNION ALL
  SELECT doc_id, len(tt) + len(bt) AS n_tokens, unnest(bt) AS w, 1 AS c FROM per_doc
),
tf AS (
  SELECT doc_id, {_lower('w')} AS word, sum(c) AS cnt, any_value(n_tokens) AS n_tokens
  FROM tok
  WHERE regexp_matches(w, '^[A-Za-z]')
  GROUP BY 1, 2
),
dfreq AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
ndocs AS (SELECT count(*) AS n FROM docs),
postings AS (
  SELECT tf.word, tf.doc_id, tf.cnt, tf.n_tokens, tf.cnt / tf.n_tokens AS tf, dfreq.df, ndocs.n,
         ln(ndocs.n // dfreq.df) AS idf,
         tf.cnt / tf.n_tokens * ln(ndocs.n // dfreq.df) AS weight
  FROM tf JOIN dfreq USING (word), ndocs
)"""


def _query_words(src: str) -> str:
    return f"""
qtok AS (SELECT query_id, unnest(regexp_extract_all(query, {_TOK}, 0)) AS t FROM {src}),
qw AS (
  SELECT DISTINCT query_id, {_lower('t')} AS word FROM qtok
  WHERE regexp_matches({_lower('t')}, '^[a-z]')
)"""


def _search(postings: str = "postings", k: int = 101) -> str:
    return f"""
hits AS (SELECT qw.query_id, p.doc_id, p.word, p.weight FROM {postings} p JOIN qw USING (word)),
best AS (
  SELECT query_id, doc_id, word, weight,
         row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(weight, 12) DESC, word) AS rn
  FROM hits
),
ranked AS (
  SELECT query_id, doc_id, word, weight,
         row_number() OVER (PARTITION BY query_id ORDER BY round(weight, 12) DESC, doc_id) AS rank
  FROM best WHERE rn = 1
),
results AS (
  SELECT r.query_id, CAST(r.rank AS BIGINT) AS rank, r.doc_id, r.word, r.weight, d.title, d.url,
         substring(d.content,
                   CASE WHEN instr(d.content, r.word) > 0
                        THEN greatest(0, instr(d.content, r.word) - 1 - 80) ELSE 0 END + 1,
                   160) || '...' AS "desc"
  FROM ranked r JOIN docs d USING (doc_id)
  WHERE r.rank <= {k}
)"""


BENCH_Q = "bq AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
CONV_Q = ("cq AS (SELECT conv_id * 1000 + turn AS query_id, text AS query "
          "FROM conversations WHERE role = 'user')")

CHAMPIONS = """
champions AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY word ORDER BY round(weight, 12) DESC, doc_id) AS word_rank
    FROM postings) WHERE word_rank <= 101
)"""


def sql() -> dict[str, str]:
    q: dict[str, str] = {}

    q["parse_documents"] = f"""
WITH {DOCS}
SELECT doc_id, title, url, content FROM docs"""

    mixed = """
mixed AS (
  SELECT page_id, url, CASE WHEN html = '' OR suffix(html, chr(10)) THEN html ELSE html || chr(10) END AS h FROM pages
  UNION ALL
  SELECT -doc_id - 1, NULL, CASE WHEN text = '' OR suffix(text, chr(10)) THEN text ELSE text || chr(10) END FROM documents
),
titled AS (SELECT page_id AS doc_id, url, regexp_extract(h, '(?s)<title>(.*?)</title>', 1) AS title FROM mixed)"""
    q["parse_rejects"] = f"""
WITH {mixed}
SELECT doc_id, url, 'title' AS reason FROM titled WHERE title = ''"""

    q["parse_accepted"] = f"""
WITH {mixed}
SELECT doc_id, title, (SELECT count(*) FROM mixed) AS n_rows, (SELECT count(*) FROM titled WHERE title = '') AS n_rejected
FROM titled WHERE title <> ''"""

    q["word_counts"] = f"""
WITH {DOCS}, {POSTINGS}
SELECT doc_id, word, CAST(cnt AS BIGINT) AS cnt, CAST(n_tokens AS BIGINT) AS n_tokens FROM tf"""

    q["postings"] = f"""
WITH {DOCS}, {POSTINGS}
SELECT word, doc_id, round(tf, 10) AS tf, round(idf, 10) AS idf, round(weight, 10) AS weight
FROM postings"""

    q["doc_frequency"] = f"""
WITH {DOCS}, {POSTINGS}
SELECT word, CAST(df AS BIGINT) AS df, round(ln(n // df), 10) AS idf
FROM dfreq, ndocs"""

    q["postings_documents"] = f"""
WITH {DOCUMENT_TABLE}, {POSTINGS}
SELECT word, doc_id, round(tf, 10) AS tf, round(idf, 10) AS idf, round(weight, 10) AS weight
FROM postings"""

    q["champions"] = f"""
WITH {DOCS}, {POSTINGS}, {CHAMPIONS}
SELECT word, doc_id, CAST(word_rank AS BIGINT) AS word_rank, round(weight, 10) AS weight
FROM champions"""

    search_cols = ('query_id, rank, doc_id, word, round(weight, 10) AS weight, title, url, "desc"')
    q["search_topk"] = f"""
WITH {DOCS}, {POSTINGS}, {BENCH_Q}, {_query_words('bq')}, {_search()}
SELECT {search_cols} FROM results"""

    q["search_topk_champions"] = q["search_topk_full"] = q["search_topk"]

    q["search_topk_blocks"] = f"""
WITH {DOCS}, {POSTINGS}, {BENCH_Q}, {_query_words('bq')}, {_search(k=500)}
""" + " UNION ALL ".join(f"SELECT {search_cols}, CAST({k} AS BIGINT) AS k FROM results WHERE rank <= {k}" for k in (10, 101, 500))

    q["search_conversations"] = f"""
WITH {DOCS}, {POSTINGS}, {CONV_Q}, {_query_words('cq')}, {_search()}
SELECT {search_cols} FROM results"""

    q["search_json"] = f"""
WITH {DOCS}, {POSTINGS}, {BENCH_Q}, {_query_words('bq')}, {_search()},
agg AS (
  SELECT query_id,
         to_json(list(struct_pack("desc" := "desc", title := title, url := url) ORDER BY rank)) AS j
  FROM results GROUP BY query_id
)
SELECT bq.query_id, coalesce(CAST(agg.j AS VARCHAR), 'null') || chr(10) AS json
FROM bq LEFT JOIN agg USING (query_id)"""

    q["corpus_scan"] = f"""
WITH {DOCS}
SELECT CAST(row_number() OVER (ORDER BY 'page_id=' || CAST(doc_id AS VARCHAR)) - 1 AS BIGINT) AS doc_id,
       doc_id AS page_id, title, content
FROM docs"""

    q["docs_roundtrip"] = q["parse_documents"]

    q["delimited_roundtrip"] = f"""
WITH {DOCS}
SELECT title, url, content FROM docs"""

    q["request_queries"] = """
SELECT item_id AS request_id, text AS query FROM benchmark"""

    q["search_requests"] = q["search_json"]

    q["query_words"] = f"""
WITH {BENCH_Q}, {_query_words('bq')}
SELECT query_id, word FROM qw"""

    sk = ("array_to_string(list_transform(regexp_extract_all(hex(encode({w})), '..'), "
          "lambda p: translate(p[1], '0123456789ABCDEF', '89ABCDEF01234567') || p[2]), '')")
    lw = _lower("w")
    q["query_key"] = f"""
WITH t AS (SELECT item_id AS query_id, regexp_extract_all(text, {_TOK}, 0) AS toks FROM benchmark)
SELECT query_id,
       array_to_string(list_transform(list_sort(list_transform(toks, lambda w: {{
           'b0': substring({sk.format(w=lw)}, 1, 2), 'n': strlen({lw}),
           'k': {sk.format(w=lw)}, 'w': {lw}}})), lambda x: x.w), '') AS query_key,
       CAST(len(toks) AS BIGINT) AS n_tokens
FROM t"""

    q.update(_text_sql())
    from trawl.plans import oracle_lexicon

    q.update(oracle_lexicon.sql())
    return q


# documents -> tokens with positions and offsets
DTOK = f"""
dsplit AS (SELECT doc_id, regexp_extract_all(text, {_TOK}, 0) AS t FROM documents),
dtok0 AS (
  SELECT doc_id, unnest(generate_series(0, len(t) - 1)) AS pos, unnest(t) AS word FROM dsplit
),
dtok AS (
  SELECT doc_id, pos, word,
         coalesce(sum(strlen(word)) OVER (PARTITION BY doc_id ORDER BY pos
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset",
         coalesce(sum(length(word)) OVER (PARTITION BY doc_id ORDER BY pos
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unicode_offset,
         length(word) AS unicode_length
  FROM dtok0
),
stop AS (
  SELECT word FROM (
    SELECT word, count(*) AS c FROM dtok0 WHERE length(word) > 1 GROUP BY word
    ORDER BY c DESC, word LIMIT 50)
),
kept AS (
  SELECT doc_id, pos, word, "offset" FROM dtok
  WHERE length(word) > 1 AND word NOT IN (SELECT word FROM stop)
)"""

IDF = """
idf AS (SELECT word, ln(n // df) AS idf FROM dfreq, ndocs),
idfavg AS (SELECT CAST(sum(CAST(idf AS DECIMAL(38, 18))) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS a FROM idf)"""

EDGES = """
leads AS (
  SELECT doc_id, word AS a,
         [lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w, lead(word, 4) OVER w] AS ps
  FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
),
pairs AS (SELECT doc_id, a, b FROM (SELECT doc_id, a, unnest(ps) AS b FROM leads) WHERE b IS NOT NULL),
edges AS (
  SELECT doc_id, src, dst, CAST(count(*) AS DOUBLE) AS weight FROM (
    SELECT doc_id, a AS src, b AS dst FROM pairs UNION ALL SELECT doc_id, b AS src, a AS dst FROM pairs)
  GROUP BY doc_id, src, dst
)"""


def _text_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    seps = "[^ \t\n，。]+|[ \t\n，。]"
    q["presplit"] = f"""
WITH s AS (SELECT doc_id, regexp_extract_all(text, '{seps}', 0) AS p FROM documents)
SELECT doc_id, unnest(generate_series(0, len(p) - 1)) AS pos, unnest(p) AS piece FROM s"""

    q["token_offsets"] = f"""
WITH {DTOK}
SELECT doc_id, pos, word, CAST("offset" AS BIGINT) AS "offset",
       CAST(unicode_offset AS BIGINT) AS unicode_offset,
       CAST(unicode_length AS BIGINT) AS unicode_length
FROM dtok"""

    q["code_points"] = """
WITH c AS (SELECT doc_id, string_split(text, '') AS ch FROM documents)
SELECT doc_id, pos, CAST(unicode(chr) AS BIGINT) AS code, CAST(strlen(chr) AS BIGINT) AS byte_len
FROM (SELECT doc_id, unnest(generate_series(0, len(ch) - 1)) AS pos, unnest(ch) AS chr FROM c)"""

    # with a model that knows no Latin-script character the HMM cut is the
    # letter / number / single-character tokenization, piece by piece
    q["segment_hmm_empty_model"] = f"""
WITH {DTOK}
SELECT doc_id, CAST(pos AS BIGINT) AS pos, word FROM dtok0"""

    q["stop_words"] = f"""
WITH {DTOK}
SELECT word FROM stop"""

    q["idf_table"] = f"""
WITH {DOCS}, {POSTINGS}, {IDF}
SELECT word, round(idf, 10) AS idf FROM idf"""

    q["idf_load"] = f"""
WITH {DOCS}, {POSTINGS}, {IDF}
SELECT word, round(idf, 10) AS idf, round((SELECT a FROM idfavg), 10) AS avg_idf FROM idf"""

    q["stop_words_load"] = q["stop_words"]

    q["keywords_tfidf"] = f"""
WITH {DOCS}, {POSTINGS}, {IDF}, {DTOK},
counts AS (
  SELECT doc_id, word, count(*) AS tf,
         array_to_string(list("offset" ORDER BY "offset"), ',') AS offsets
  FROM kept GROUP BY doc_id, word
),
scored AS (
  SELECT c.doc_id, c.word, c.offsets,
         c.tf * coalesce(i.idf, (SELECT a FROM idfavg)) AS weight
  FROM counts c LEFT JOIN idf i USING (word)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 12) DESC, word) AS rank FROM scored
)
SELECT doc_id, CAST(rank AS BIGINT) AS rank, word, offsets, round(weight, 10) AS weight
FROM ranked WHERE rank <= 5"""

    def log_sql(keys: str) -> str:
        return f"""
l0 AS (
  SELECT event_id, {keys}, ts, epoch_us(ts) AS ts_us,
         epoch_us(lag(ts) OVER (PARTITION BY {keys} ORDER BY ts, event_id)) AS prev_us
  FROM events WHERE ts IS NOT NULL
),
l1 AS (
  SELECT *, CASE WHEN prev_us IS NOT NULL AND ts_us - prev_us <= 1800000000 THEN 1 ELSE 0 END AS hit
  FROM l0
),
l2 AS (
  SELECT *, max(CASE WHEN hit = 0 THEN ts_us END)
              OVER (PARTITION BY {keys} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_start_us
  FROM l1
),
sess AS (
  SELECT {keys}, session_start_us, max(ts_us) + 1800000000 AS session_end_us,
         count(*) AS lookups, count(*) - 1 AS hits, CAST(1 AS BIGINT) AS misses
  FROM l2 GROUP BY {keys}, session_start_us
)"""

    q["cache_labels"] = f"""
WITH {log_sql("user_id, event_type")}
SELECT event_id, user_id, event_type, ts_us, CAST(hit AS BIGINT) AS hit, session_start_us FROM l2"""

    q["cache_sessions"] = f"""
WITH {log_sql("user_id, event_type")}
SELECT * FROM sess"""

    q["cache_sessions_by_type"] = f"""
WITH {log_sql("event_type")}
SELECT * FROM sess"""

    q["cache_sessions_stream"] = q["cache_sessions"]

    q["cache_sessions_stream_closed"] = f"""
WITH {log_sql("user_id, event_type")}
SELECT * FROM sess
WHERE session_end_us <= (SELECT max(epoch_us(ts)) FROM events) - 1800000000"""

    q.update(_lexicon_sql())

    q["textrank_edges"] = f"""
WITH {DTOK}, {EDGES}
SELECT doc_id, src, dst, weight FROM edges"""
    return q


SEP_RE = "[^ \\t\\n，。]+|[ \\t\\n，。]"

LEX = r"""
base AS (
  SELECT word, CAST(count(*) AS DOUBLE) AS freq, 'n' AS tag
  FROM (SELECT unnest(regexp_extract_all(text, '\p{L}+', 0)) AS word FROM benchmark) GROUP BY word
),
bsum AS (SELECT sum(freq) AS s FROM base),
bw AS (SELECT word, freq, tag, ln(freq / (SELECT s FROM bsum)) AS weight FROM base),
bmed AS (
  SELECT weight AS m FROM (SELECT weight, row_number() OVER (ORDER BY weight) - 1 AS i FROM bw)
  WHERE i = (SELECT count(*) // 2 FROM bw)
),
tw AS (
  SELECT word, count(*) AS c
  FROM (SELECT unnest(regexp_extract_all(title, '\p{L}+', 0)) AS word FROM docs) GROUP BY word
),
usr AS (
  SELECT word, CASE WHEN c >= 3 THEN CAST(c AS INTEGER) END AS freq,
         CASE WHEN c = 1 THEN '' ELSE 'nz' END AS tag
  FROM tw
),
uw AS (
  SELECT word,
         CASE WHEN freq IS NOT NULL AND freq <> 0 THEN ln(freq / (SELECT s FROM bsum))
              ELSE (SELECT m FROM bmed) END AS weight,
         tag, true AS is_user
  FROM usr
),
lex AS (
  SELECT word, weight, tag, is_user FROM uw
  UNION ALL
  SELECT word, weight, tag, false AS is_user FROM bw WHERE word NOT IN (SELECT word FROM uw)
)"""

EDGES_LEX = f"""
pieces AS (
  SELECT doc_id, unnest(generate_series(0, len(p) - 1)) AS piece_pos, unnest(p) AS piece
  FROM (SELECT doc_id, regexp_extract_all(text, '{SEP_RE}', 0) AS p FROM documents)
),
cap AS (SELECT max(length(word)) AS l FROM lex),
st AS (SELECT doc_id, piece_pos, piece, unnest(generate_series(0, length(piece) - 1)) AS start FROM pieces),
cand AS (
  SELECT doc_id, piece_pos, start, piece,
         unnest(generate_series(1, least((SELECT l FROM cap), length(piece) - start))) AS len
  FROM st
),
c2 AS (SELECT doc_id, piece_pos, start, len, substring(piece, start + 1, len) AS sub FROM cand),
dag AS (
  SELECT c2.doc_id, c2.piece_pos, c2.start, c2.start + c2.len - 1 AS "end",
         CASE WHEN l.word IS NOT NULL THEN c2.sub END AS word, l.weight, c2.sub AS text
  FROM c2 LEFT JOIN lex l ON c2.sub = l.word
  WHERE l.word IS NOT NULL OR c2.len = 1
)"""


def _mp_words(cap: int) -> str:
    """Max-probability cut as a recursive CTE: ``mpw(doc_id, piece_pos, s, word)``.

    Every piece is walked right to left, one position per step, carrying the
    best scores of the positions to its right (``b[1]`` is the position just
    right of the current one).  A candidate's score is its weight plus the
    best score after it; the first candidate (smallest end) within 1e-9 of
    the highest score wins and its score is carried.  An unknown character (no one-character word) is priced at
    the smallest weight of the static lexicon.  A second recursive CTE then
    follows the picks from position 0.
    """
    return f"""
mw AS (SELECT min(weight) AS m FROM bw),
we AS (
  SELECT doc_id, piece_pos, start, "end", weight FROM dag
  WHERE word IS NOT NULL AND "end" - start + 1 <= {cap}
),
cw AS (
  SELECT doc_id, piece_pos, start, "end" AS e, weight AS w FROM we
  UNION ALL
  SELECT st.doc_id, st.piece_pos, st.start, st.start AS e, (SELECT m FROM mw) AS w
  FROM st ANTI JOIN (SELECT * FROM we WHERE "end" = start) one
       ON one.doc_id = st.doc_id AND one.piece_pos = st.piece_pos AND one.start = st.start
),
pos_c AS (
  SELECT doc_id, piece_pos, start, list({{'e': e, 'w': w}} ORDER BY e) AS c
  FROM cw GROUP BY doc_id, piece_pos, start
),
piece_c AS (
  SELECT doc_id, piece_pos, CAST(count(*) AS INTEGER) AS n, list(c ORDER BY start) AS cs
  FROM pos_c GROUP BY doc_id, piece_pos
),
dp AS (
  WITH RECURSIVE r(doc_id, piece_pos, i, b, cs, pick) AS (
    SELECT doc_id, piece_pos, n, [CAST(0.0 AS DOUBLE)], cs, CAST(NULL AS INTEGER) FROM piece_c
    UNION ALL
    SELECT doc_id, piece_pos, i - 1, list_prepend(v[k], b), cs, cs[i][k].e
    FROM (SELECT *, list_position(list_transform(v, lambda x: x >= list_max(v) - 1e-9), true) AS k
          FROM (SELECT doc_id, piece_pos, i, b, cs,
                       list_transform(cs[i], lambda x: b[x.e - i + 2] + x.w) AS v
                FROM r WHERE i > 0))
  )
  SELECT doc_id, piece_pos, i, pick FROM r WHERE pick IS NOT NULL
),
picks AS (
  SELECT doc_id, piece_pos, list(pick ORDER BY i) AS pk FROM dp GROUP BY doc_id, piece_pos
),
walk AS (
  WITH RECURSIVE w(doc_id, piece_pos, s, pk) AS (
    SELECT doc_id, piece_pos, 0, pk FROM picks
    UNION ALL
    SELECT doc_id, piece_pos, pk[s + 1] + 1, pk FROM w WHERE pk[s + 1] + 1 < len(pk)
  )
  SELECT doc_id, piece_pos, s, pk[s + 1] AS e FROM w
),
mpw AS (
  SELECT w.doc_id, w.piece_pos, w.s, substring(p.piece, w.s + 1, w.e - w.s + 1) AS word
  FROM walk w JOIN pieces p ON p.doc_id = w.doc_id AND p.piece_pos = w.piece_pos
)"""


MIX_WORDS = f"""
usingle AS (SELECT word FROM lex WHERE is_user AND length(word) = 1),
fl AS (
  SELECT m.*, length(m.word) = 1 AND u.word IS NULL AS single
  FROM mpw m LEFT JOIN usingle u ON m.word = u.word
),
isl AS (
  SELECT *, sum(CASE WHEN single THEN 0 ELSE 1 END) OVER (
              PARTITION BY doc_id, piece_pos ORDER BY s ROWS UNBOUNDED PRECEDING) AS g
  FROM fl
),
runs AS (
  SELECT doc_id, piece_pos, min(s) AS s, string_agg(word, '' ORDER BY s) AS run
  FROM isl WHERE single GROUP BY doc_id, piece_pos, g
),
recut AS (
  SELECT doc_id, piece_pos, s, unnest(generate_series(1, len(t))) AS k, unnest(t) AS word
  FROM (SELECT *, regexp_extract_all(run, {_TOK}, 0) AS t FROM runs)
),
mixw AS (
  SELECT doc_id, piece_pos, s, 0 AS k, word FROM isl WHERE NOT single
  UNION ALL
  SELECT doc_id, piece_pos, s, k, word FROM recut
),
mix AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY piece_pos, s, k) - 1 AS BIGINT) AS pos,
         word
  FROM mixw
)"""


def _tag_rule(w: str) -> str:
    seen = (f"list_slice(list_filter(string_split({w}, ''), lambda c: unicode(c) < 128), "
            f"1, length({w}) // 2)")
    return (f"CASE WHEN len({seen}) = 0 THEN 'x' "
            f"WHEN list_bool_and(list_transform({seen}, lambda c: c >= '0' AND c <= '9')) THEN 'm' "
            f"ELSE 'eng' END")


def _lexicon_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["lexicon_load"] = f"""
WITH {DOCS}, {LEX}
SELECT word, freq, tag FROM base"""

    q["lexicon_stats"] = f"""
WITH {DOCS}, {LEX}
SELECT CAST(count(*) AS BIGINT) AS n_words, sum(freq) AS freq_sum,
       round(min(weight), 10) AS min_weight, round(max(weight), 10) AS max_weight,
       round((SELECT m FROM bmed), 10) AS median_weight
FROM bw"""

    q["lexicon_overlay"] = f"""
WITH {DOCS}, {LEX}
SELECT word, round(weight, 10) AS weight, tag, is_user FROM lex"""

    q["lexicon_lookup"] = f"""
WITH {DOCS}, {LEX},
dw AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\p{{L}}+', 0)) AS word FROM documents)
SELECT dw.word, l.word IS NOT NULL AS in_lexicon, l.tag
FROM dw LEFT JOIN lex l ON dw.word = l.word"""

    q["token_tags"] = f"""
WITH {DOCS}, {LEX},
tt AS (SELECT DISTINCT unnest(regexp_extract_all(text, {_TOK}, 0)) AS word FROM documents)
SELECT tt.word, coalesce(CASE WHEN l.tag <> '' THEN l.tag END, {_tag_rule('tt.word')}) AS tag,
       regexp_matches(tt.word, '^[\x00-\x7F]*$') AS is_ascii, length(tt.word) = 1 AS is_single
FROM tt LEFT JOIN lex l ON tt.word = l.word"""

    q["dag_edges"] = f"""
WITH {DOCS}, {LEX}, {EDGES_LEX}
SELECT doc_id, CAST(piece_pos AS BIGINT) AS piece_pos, CAST(start AS BIGINT) AS start,
       CAST("end" AS BIGINT) AS "end", word, round(weight, 10) AS weight
FROM dag"""

    for name, cap in (("segment_mp", 512), ("segment_mp_capped", 3)):
        q[name] = f"""
WITH {DOCS}, {LEX}, {EDGES_LEX}, {_mp_words(cap)}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY piece_pos, s) - 1 AS BIGINT) AS pos, word
FROM mpw"""

    q["segment_mix"] = f"""
WITH {DOCS}, {LEX}, {EDGES_LEX}, {_mp_words(512)}, {MIX_WORDS}
SELECT doc_id, pos, word FROM mix"""

    q["segment_search"] = f"""
WITH {DOCS}, {LEX}, {EDGES_LEX}, {_mp_words(512)}, {MIX_WORDS},
lw AS (SELECT DISTINCT word FROM lex),
g2 AS (
  SELECT doc_id, pos, i, substring(word, i + 1, 2) AS sw
  FROM (SELECT *, unnest(generate_series(0, length(word) - 2)) AS i FROM mix WHERE length(word) > 2)
),
g3 AS (
  SELECT doc_id, pos, i, substring(word, i + 1, 3) AS sw
  FROM (SELECT *, unnest(generate_series(0, length(word) - 3)) AS i FROM mix WHERE length(word) > 3)
)
SELECT doc_id, pos, CAST(i AS BIGINT) AS sub, sw AS word FROM g2 SEMI JOIN lw ON g2.sw = lw.word
UNION ALL
SELECT doc_id, pos, CAST(1000000 + i AS BIGINT), sw FROM g3 SEMI JOIN lw ON g3.sw = lw.word
UNION ALL
SELECT doc_id, pos, CAST(2000000 AS BIGINT), word FROM mix"""

    q["pos_tags"] = f"""
WITH {DOCS}, {LEX}, {EDGES_LEX}, {_mp_words(512)}, {MIX_WORDS}
SELECT m.doc_id, m.pos, m.word, coalesce(CASE WHEN l.tag <> '' THEN l.tag END, {_tag_rule('m.word')}) AS tag
FROM mix m LEFT JOIN lex l ON m.word = l.word"""

    q["segment_full"] = f"""
WITH {DOCS}, {LEX}, {EDGES_LEX},
e2 AS (
  SELECT *,
         max(CASE WHEN word IS NOT NULL THEN "end" + 1 END) OVER (
             PARTITION BY doc_id, piece_pos ORDER BY start
             RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cover,
         max(CASE WHEN word IS NOT NULL AND "end" > start THEN 1 END) OVER (
             PARTITION BY doc_id, piece_pos, start) AS longer_here
  FROM dag
)
SELECT doc_id, CAST(piece_pos AS BIGINT) AS piece_pos, CAST(start AS BIGINT) AS start,
       CAST("end" AS BIGINT) AS "end", text AS word
FROM e2
WHERE (word IS NOT NULL AND "end" > start)
   OR ("end" = start AND longer_here IS NULL AND (cover IS NULL OR cover <= start))"""
    return q
