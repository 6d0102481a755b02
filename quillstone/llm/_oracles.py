"""DuckDB statements for the operators that SQL can express on whole tables."""

from __future__ import annotations

from quillstone.llm import licenses

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


def _license_scan() -> str:
    rows = [(p, x, 1.0, "true", licenses.K) for p, x in licenses.BASE] + [(p, x, s, "false", licenses.LONG_K) for p, x, s in licenses.PASSAGES]
    values = ", ".join(
        f"({t}, string_split('{text}', ' '), '{label}', {share}::DOUBLE, {base}, {k})" for t,
        (text, label, share, base, k) in enumerate(rows)
    )
    gram = "array_to_string(w[i:i + k - 1], ' ')"
    pattern = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    return f"""
        WITH t(t, w, label, share, base, k) AS (VALUES {values}),
        g AS (SELECT t, label, share, base, k, len(w) AS n, i - 1 AS j, {gram} AS gram FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM t)),
        d AS (SELECT doc_id, {_words(pattern)} AS w FROM documents),
        p AS (SELECT doc_id, k, i - 1 AS i, {gram} AS gram FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM d, (VALUES ({licenses.K}), ({licenses.LONG_K})) v(k))),
        h AS (SELECT DISTINCT doc_id, t, label, share, base, g.k, n, j, i - j AS diagonal FROM p JOIN g USING (k, gram)),
        v AS (SELECT doc_id, t, label, share, base, k, n, diagonal, list(j) AS js FROM h GROUP BY ALL),
        m AS (SELECT *, coalesce((diagonal - lag(diagonal) OVER o > CASE WHEN base THEN 0 ELSE {licenses.SHIFT} END)::INT, 0) AS apart FROM v WINDOW o AS (PARTITION BY doc_id, t ORDER BY diagonal)),
        s AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS span FROM m),
        c AS (SELECT doc_id, t, label, share, base, n, span, min(diagonal) AS start, len(list_distinct(flatten(list_transform(flatten(list(js)), lambda j: range(j, j + any_value_k))))) / n AS cover
              FROM (SELECT *, k AS any_value_k FROM s) GROUP BY doc_id, t, label, share, base, n, span, any_value_k)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, count(*) FILTER (base AND cover >= share) AS n_base,
               min(start) FILTER (base AND cover >= share)::BIGINT AS first_word, max(start) FILTER (base AND cover >= share)::BIGINT AS last_word,
               coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base AND cover >= share)), ','), '') AS base_labels,
               coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (cover >= share)), ','), '') AS labels, coalesce(max(cover), 0)::DOUBLE AS score
        FROM d LEFT JOIN c ON d.doc_id = c.doc_id GROUP BY d.doc_id, d.w"""


ORACLES: dict[str, str] = {
    "op3_license_scan": _license_scan(),
    "op6_embedding_near_dedup": """
        WITH RECURSIVE l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
                 WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.93),
        r(node, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, l.y FROM r JOIN l ON r.reach = l.x),
        n AS (SELECT x, count(*) AS n FROM l GROUP BY 1)
        SELECT node AS vec_id, coalesce(max(n), 0)::BIGINT AS n_links, min(reach) AS component_id, min(reach) = node AS kept FROM r LEFT JOIN n ON node = x GROUP BY node""",
    "op8_warc_archives": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM w""",
    "op10_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_words("[^\\x20\\x09-\\x0D]+")} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
        e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
        r(node, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON r.reach = e.x)
        SELECT node AS doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(reach) AS component_id FROM r LEFT JOIN n ON node = doc_id GROUP BY node""",
    "op13_ranked_search": f"""
        WITH d AS (SELECT doc_id, unnest({_words("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")}) AS term FROM documents),
        p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
        l AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY ALL),
        a AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM l),
        w AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, a GROUP BY term),
        i AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_words("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")}) AS term FROM benchmark)),
        s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::BIGINT AS score
              FROM i JOIN w USING (term) JOIN p USING (term) JOIN l USING (doc_id), a GROUP BY ALL),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT * FROM r WHERE rank <= 50""",
}
