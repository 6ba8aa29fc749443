"""The named queries of the training-text operators."""

from __future__ import annotations

from . import code_prose, doc_language, function_docs, leakage, mixing, near_duplicates, splitting, truncation

QUERIES = {
    "p1_found": near_duplicates.p1_found,
    "p1_groups": near_duplicates.p1_groups,
    "p3_found": splitting.p3_found,
    "p3_pieces": splitting.p3_pieces,
    "p3_checked": splitting.p3_checked,
    "p4_found": function_docs.p4_found,
    "p4_pairs": function_docs.p4_pairs,
    "p5_found": code_prose.p5_found,
    "p5_shares": code_prose.p5_shares,
    "p5_totals": code_prose.p5_totals,
    "p6_found": truncation.p6_found,
    "p6_scores": truncation.p6_scores,
    "p6_shares": truncation.p6_shares,
    "p8_found": leakage.p8_found,
    "p8_matches": leakage.p8_matches,
    "p8_items": leakage.p8_items,
    "p9_mixture": mixing.p9_mixture,
    "p9_shares": mixing.p9_shares,
    "p9_caps": mixing.p9_caps,
    "p10_found": doc_language.p10_found,
    "p10_segments": doc_language.p10_segments,
    "p10_languages": doc_language.p10_languages,
}

# full-width forms of ASCII and what they stand for
_WIDE, _PLAIN = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
#: What SQL can state: groups by all common sequences, cases by lengths.
ORACLE = {
    "p1_found": """
        WITH RECURSIVE
        w AS (SELECT header_id, regexp_extract_all(lower(source_code), '[\\p{L}\\p{N}_]+') AS w FROM headers WHERE source_code IS NOT NULL),
        g AS (SELECT DISTINCT header_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT header_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3) x),
        n AS (SELECT header_id, count(*) AS n FROM g GROUP BY header_id),
        shared AS (SELECT a.header_id AS a, b.header_id AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.header_id < b.header_id GROUP BY ALL),
        l AS (SELECT a, b FROM shared JOIN n x ON x.header_id = a JOIN n y ON y.header_id = b WHERE k >= 0.7 * (x.n + y.n - k)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT DISTINCT a AS header_id_a, b AS header_id_b FROM r WHERE a < b
    """,
    # classes by equal sets of sequences (of words where there are fewer than three), groups by the smallest row they reach
    "p1_groups": """
        WITH RECURSIVE
        w AS (SELECT header_id, regexp_extract_all(lower(source_code), '[\\p{L}\\p{N}_]+') AS w FROM headers WHERE regexp_matches(source_code, '\\S')),
        g AS (SELECT DISTINCT header_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT header_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3) x),
        k AS (SELECT header_id, md5(string_agg(gram, chr(10) ORDER BY gram)) AS k FROM g GROUP BY header_id UNION ALL SELECT header_id, array_to_string(w, ' ') FROM w WHERE len(w) < 3),
        c AS (SELECT header_id, min(header_id) OVER (PARTITION BY k) AS class_id FROM k),
        n AS (SELECT header_id, count(*) AS n FROM g GROUP BY header_id),
        shared AS (SELECT a.header_id AS a, b.header_id AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.header_id <> b.header_id GROUP BY ALL),
        e AS (SELECT a, b FROM shared JOIN n x ON x.header_id = a JOIN n y ON y.header_id = b WHERE shared.k >= 0.7 * (x.n + y.n - shared.k) UNION SELECT header_id, class_id FROM c UNION SELECT class_id, header_id FROM c),
        r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT h.header_id, min(c.class_id) AS class_id, min(r.b) AS group_id FROM headers h LEFT JOIN c USING (header_id) LEFT JOIN r ON r.a = h.header_id GROUP BY h.header_id
    """,
    "p8_found": f"""
        WITH
        d AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(translate(translate(text, '{_WIDE}', '{_PLAIN}'), chr(173) || chr(8203) || chr(8204) || chr(8205) || chr(8288) || chr(65279), ''))), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text <> ''),
        i AS (SELECT item_id, regexp_extract_all(lower(nfc_normalize(passage)), '[\\p{{L}}\\p{{N}}]+') AS w FROM eval_items WHERE passage IS NOT NULL),
        dg AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 12), ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13) x),
        ig AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, k, k + 12), ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i WHERE len(w) >= 13) x)
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (gram)
    """,
    "p3_checked": """
        WITH items AS (
          SELECT DISTINCT 'headers' AS record_kind, header_id AS record_id, source_code AS body FROM headers
          UNION SELECT 'methods', method_id, code FROM methods)
        SELECT i.record_kind, record_id, length(body) AS n_chars, true AS sound
        FROM items i JOIN (SELECT record_kind, min(max_chars) AS max_chars FROM piece_limits GROUP BY 1) l USING (record_kind) WHERE length(body) > max_chars
    """,
    "p9_caps": """
        WITH t AS (SELECT DISTINCT regexp_replace(lower(trim(source)), '[\\s_\\-]+', '_', 'g') AS source FROM mixture_targets WHERE source IS NOT NULL),
        d AS (SELECT regexp_replace(lower(trim(source)), '[\\s_\\-]+', '_', 'g') AS source FROM documents WHERE source IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL)
        SELECT t.source, count(d.source) AS n_docs, true AS sound FROM t LEFT JOIN d USING (source) GROUP BY t.source
    """,
    "p3_found": """
        WITH items AS (
          SELECT 'headers' AS record_kind, header_id AS record_id, source_code AS body FROM headers
          UNION ALL SELECT 'methods', method_id, code FROM methods),
        big AS (
          SELECT i.*, l.max_chars FROM items i JOIN (SELECT record_kind, min(max_chars) AS max_chars FROM piece_limits GROUP BY 1) l
          USING (record_kind) WHERE length(body) > max_chars)
        SELECT DISTINCT record_kind, record_id, 'oversized' AS case_kind FROM big
        UNION ALL
        SELECT DISTINCT record_kind, record_id, 'no_boundary' FROM big
        WHERE list_max(list_transform(string_split(body, chr(10)), lambda x: length(x))) > max_chars
    """,
}
