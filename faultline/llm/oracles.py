"""DuckDB SQL for the queries that SQL can state.

Scores, tokenizers and the page parser are no SQL; ``tests/llm`` compares those queries with
brute-force versions. The SQL of op6 has the rules only: the given pages hold no redirect
and no canonical link, and the tests cover those.
"""

_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        usable AS (
            SELECT vec_id, e FROM v
            WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(e, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM usable a, usable b
            WHERE a.vec_id <> b.vec_id
              AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.9 ELSE FALSE END),
        reach AS (
            SELECT vec_id AS a, vec_id AS b FROM v
            UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        least_reached AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT v.vec_id, coalesce(c.n, 0) AS n_links, r.component_id, v.vec_id = r.component_id AS kept
        FROM v JOIN least_reached r ON r.a = v.vec_id LEFT JOIN counts c ON c.a = v.vec_id
    """,
    "op4_chat_formatting": r"""
        WITH m AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (
            SELECT *, replace(replace(replace(role, '\', '\-'), '###', '\h'), ':', '\c') AS r2,
                replace(replace(replace(t, '\', '\-'), '</turn>', '\t'), '###', '\h') AS t2 FROM m)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
            CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length(r2) + length(t2) + 14) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op5_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(w[k:k + least(5, len(w)) - 1], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        both_ AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY ALL),
        links AS (
            SELECT a, b, c = x.n AND c = y.n AS same FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
            WHERE c * 5 >= 4 * (x.n + y.n - c)),
        reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        least_reached AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        counts AS (SELECT a, count(*) AS n_links, min(b) FILTER (same) AS twin FROM links GROUP BY a)
        SELECT d.doc_id, least(d.doc_id, coalesce(c.twin, d.doc_id)) AS class_id, coalesce(c.n_links, 0) AS n_links,
            r.component_id, d.doc_id = r.component_id AS kept
        FROM documents d JOIN least_reached r ON r.a = d.doc_id LEFT JOIN counts c ON c.a = d.doc_id
    """,
    "op6_url_filters": f"""
        WITH p AS (
            SELECT page_id,
                translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_ASCII}) AS host,
                coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        rules(h, q, verdict) AS (
            VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        fits AS (
            SELECT p.page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS verdict
            FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
            GROUP BY p.page_id)
        SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM p LEFT JOIN fits ON fits.page_id = p.page_id
    """,
    "op8_decontamination": rf"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), {_ASCII}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (
            SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, regexp_extract_all(
                translate(coalesce(text, ''), {_ASCII}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
            WHERE len(w) > 0),
        windows AS (
            SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g
            FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
        found AS (
            SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
        met AS (SELECT f.doc_id, f.k, f.n, x.item_id FROM found f JOIN windows x ON x.n = f.n AND x.g = f.g),
        hit AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM met) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
    """,
    "op10_warc": """
        WITH p AS (
            SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
                sha256(coalesce(html, '')) AS payload_digest FROM pages),
        firsts AS (SELECT payload_digest AS d, min(page_id) AS f FROM p WHERE payload_bytes >= 100 GROUP BY d)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN f < page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN f < page_id THEN f END AS refers_to
        FROM p LEFT JOIN firsts ON d = payload_digest
    """,
    "op11_suffix_dedup": """
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        starts AS (
            SELECT r, s, md5(substr(h, 2 * s + 1, 800)) AS k
            FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 399)) AS s FROM d WHERE len(h) >= 800)),
        hit AS (SELECT r, s FROM starts WHERE k IN (SELECT k FROM starts GROUP BY k HAVING count(*) > 1)),
        numbered AS (
            SELECT r, s, sum(fresh) OVER (PARTITION BY r ORDER BY s) AS g FROM (
                SELECT r, s, CASE WHEN s - lag(s) OVER (PARTITION BY r ORDER BY s) <= 400 THEN 0 ELSE 1 END AS fresh FROM hit)),
        spans AS (SELECT r, min(s) AS a, max(s) + 400 AS b FROM numbered GROUP BY r, g),
        between_ AS (
            SELECT r, b AS a, lead(a) OVER (PARTITION BY r ORDER BY a) AS b FROM spans
            UNION ALL SELECT r, 0, min(a) FROM spans GROUP BY r),
        kept AS (
            SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, len(h) // 2) - a)), '' ORDER BY a) AS h
            FROM between_ JOIN d USING (r) GROUP BY r),
        totals AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
        SELECT doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
            coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
        FROM d LEFT JOIN totals USING (r) LEFT JOIN kept USING (r)
    """,
    "op12_ranked_search": rf"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                translate(text, {_ASCII}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
        live AS (SELECT * FROM d WHERE len(w) > 0),
        corpus AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM live),
        q AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(
                translate(text, {_ASCII}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
        tf AS (
            SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM live)
            WHERE t IN (SELECT t FROM q) GROUP BY ALL),
        df AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM tf, corpus GROUP BY t),
        scored AS (
            SELECT item_id, r, doc_id, CAST(sum(
                w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words)))) AS BIGINT) AS score
            FROM q JOIN tf USING (t) JOIN df USING (t), corpus GROUP BY ALL),
        ranked AS (
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
                doc_id, score FROM scored WHERE score > 0)
        SELECT * FROM ranked WHERE rank <= 10
    """,
}
