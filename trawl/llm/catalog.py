"""Queries of the training-data operators."""

from __future__ import annotations

from trawl.llm import ann, bpe, decontam, licenses, lines, mainpage, merkle, neardup, pack, quality, ranked, shards, warc
from trawl.sources.tables import documents, pages, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def registry():
    return {
        "op1_bpe": lambda s, d: bpe.digests(documents(s, d), tokenizer_file("byte_bpe_50k.json")),
        "op2_warc": lambda s, d: warc.round_trip(pages(s, d)),
        "op3_line_dedup": lambda s, d: lines.dedup(documents(s, d)).select("doc_id", "text", "n_removed"),
        "op4_neardup": lambda s, d: neardup.groups(documents(s, d)),
        "op5_packing": lambda s, d: pack.pack(documents(s, d), tokenizer_file("word_bpe_49k.json")),
        "op6_quality": lambda s, d: quality.verdicts(documents(s, d)),
        "op7_sharding": lambda s, d: shards.placements(documents(s, d)),
        "op8_ann": lambda s, d: ann.search(table(s, d, "embeddings")),
        "op9_main_text": lambda s, d: mainpage.extract(pages(s, d)),
        "op10_licenses": lambda s, d: licenses.scan(documents(s, d)),
        "op11_merkle": lambda s, d: merkle.verified(merkle.manifest(documents(s, d), probe=merkle.tampered())),
        "op12_decontaminate": lambda s, d: decontam.report(documents(s, d), table(s, d, "benchmark")),
        "op13_ranked": lambda s, d: ranked.search(documents(s, d), table(s, d, "benchmark")),
        "pipeline": _pipeline,
    }


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n_chars}", "text")) + ")"
# CRC-32 bit by bit; each byte is followed by seven zeros
_CRC = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
          lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
          lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"""

MERKLE = f"""
    WITH RECURSIVE d AS (
      SELECT *, {_LEAF.format(n_chars='n_chars')} AS leaf,
             CASE WHEN n_chars IS NOT NULL AND {_CRC} % 7 = 0 THEN {_LEAF.format(n_chars='(n_chars + 1)')}
                  ELSE {_LEAF.format(n_chars='n_chars')} END AS probe,
             CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS tree FROM documents),
    l AS (SELECT doc_id, leaf, probe, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
                 count(*) OVER (PARTITION BY tree) AS n FROM d),
    up AS (SELECT tree, 0 AS level, idx, n, leaf AS h FROM l
           UNION ALL
           SELECT tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx))
           FROM up WHERE n > 1 GROUP BY tree, level, idx // 2, n),
    roots AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
    top AS (SELECT 0 AS level, idx, n, h FROM roots
            UNION ALL
            SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx))
            FROM top WHERE n > 1 GROUP BY level, idx // 2, n),
    walk AS (SELECT doc_id, leaf, tree, idx AS row, 0 AS level, idx, n, probe AS acc, '' AS proof FROM l
             UNION ALL
             SELECT w.doc_id, w.leaf, w.tree, w.row, w.level + 1, w.idx // 2, (w.n + 1) // 2,
                    sha256(CASE WHEN w.idx % 2 = 1 THEN coalesce(s.h, '') || acc ELSE acc || coalesce(s.h, '') END),
                    proof || coalesce(s.h, '')
             FROM walk w LEFT JOIN up s ON s.tree = w.tree AND s.level = w.level AND s.idx = xor(w.idx, 1) WHERE w.n > 1),
    last AS (SELECT w.doc_id, w.leaf, r.h AS subroot, w.tree, w.row, 0 AS level, r.idx, r.n, w.acc, w.proof
             FROM walk w JOIN roots r ON w.tree = r.tree WHERE w.n = 1
             UNION ALL
             SELECT w.doc_id, w.leaf, w.subroot, w.tree, w.row, w.level + 1, w.idx // 2, (w.n + 1) // 2,
                    sha256(CASE WHEN w.idx % 2 = 1 THEN coalesce(s.h, '') || acc ELSE acc || coalesce(s.h, '') END),
                    proof || coalesce(s.h, '')
             FROM last w LEFT JOIN top s ON s.level = w.level AND s.idx = xor(w.idx, 1) WHERE w.n > 1)
    SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = t.h AS verified
    FROM last JOIN (SELECT h FROM top WHERE n = 1) t ON last.n = 1"""

_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATE = f"""
    WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
    bw AS (SELECT DISTINCT coalesce(item, '') AS item, least(len(w), 10) AS size,
                  unnest(list_transform(generate_series(1, len(w) - least(len(w), 10) + 1),
                                        lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS win
           FROM b WHERE len(w) > 0),
    d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
    p AS (SELECT r, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i
          FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size),
    h AS (SELECT p.r, p.i, p.size, bw.item FROM p JOIN bw ON bw.size = p.size AND bw.win = array_to_string(w[i:i + p.size - 1], ' ')),
    n AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + size - 1)) AS x FROM h) GROUP BY r),
    k AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)"""

RANKED = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
    n AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
    c AS (SELECT CAST(count(*) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) AS length FROM n),
    tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
    df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
    q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_WORDS.format('text')}) AS t FROM benchmark) GROUP BY item_id, t),
    w AS (SELECT t, CAST(floor(1000 * ln((2 * total + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, c),
    s AS (SELECT q.item_id, n.r, n.doc_id,
                 CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n.n * total) // length)))) AS BIGINT) AS score
          FROM q JOIN tf USING (t) JOIN w USING (t) JOIN n ON n.r = tf.r, c GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": """
            WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
            q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
            t AS (SELECT h, max(page_id) AS top FROM q WHERE n >= 1000 GROUP BY h)
            SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, q.h AS payload_digest,
                   CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
            FROM q LEFT JOIN t USING (h)""",
        "op3_line_dedup": """
            WITH l AS (SELECT doc_id, coalesce(source, '') AS source, generate_subscripts(string_split(text, chr(10)), 1) AS pos,
                              unnest(string_split(text, chr(10))) AS s FROM documents),
            k AS (SELECT *, trim(s, ' ') AS t, len(regexp_split_to_array(trim(s, ' '), '[ \\t\\n\\x0B\\f\\r]+')) >= 5 AS counts FROM l),
            b AS (SELECT t, min((doc_id, pos)) AS first FROM k WHERE counts AND doc_id IS NOT NULL GROUP BY t HAVING count(DISTINCT source) >= 2),
            m AS (SELECT k.*, coalesce(counts AND (doc_id, pos) <> first, false) AS gone FROM k LEFT JOIN b USING (t)),
            r AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY pos) FILTER (NOT gone) AS text, count(*) FILTER (gone) AS n FROM m GROUP BY doc_id)
            SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text,
                   coalesce(n, 0) AS n_removed
            FROM documents d LEFT JOIN r USING (doc_id)""",
        "op11_merkle": MERKLE,
        "op12_decontaminate": DECONTAMINATE,
        "op13_ranked": RANKED,
    }
