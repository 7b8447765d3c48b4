"""Comparison SQL (DuckDB) of the operators that SQL can express."""

OP5 = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
    SELECT row_number() OVER () AS k, doc_id, t,
           regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM d
), p AS (
    SELECT k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
    FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), again AS (
    SELECT DISTINCT k, unnest([i, i + 1, i + 2]) AS i
    FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM p) WHERE n > 1
), r AS (
    SELECT k, count(*) AS n FROM again GROUP BY k
), m AS (
    SELECT doc_id, len(words) AS n_words,
           length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
           length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           len(lines) AS n_lines,
           len(lines) - len(list_distinct(lines)) AS n_dup_lines,
           coalesce(r.n, 0) AS n_repeat_words,
           len(list_filter(words, lambda x: x IN (
               'the', 'of', 'and', 'to', 'in', 'is', 'that', 'for', 'it', 'with', 'as', 'was', 'on', 'by', 'this', 'are',
               'de', 'la', 'le', 'et', 'les', 'des', 'en', 'un', 'une', 'du', 'que', 'qui', 'dans', 'pour', 'par', 'est',
               'der', 'die', 'das', 'und', 'den', 'von', 'mit', 'sich', 'ein', 'eine', 'auf', 'nicht', 'ist', 'zu',
               'el', 'los', 'las', 'y', 'del', 'se', 'con', 'por', 'una', 'su', 'al'))) AS n_stops
    FROM w LEFT JOIN r USING (k)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
           AND word_chars / n_words BETWEEN 2 AND 12
           AND n_symbols / greatest(word_chars, 1) <= 0.05
           AND n_stops / n_words >= 0.02
           AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AS kept
FROM m
"""

#: Every pair is compared here, which only the small scales allow.
OP6 = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE len(embedding) > 0 AND list_count(embedding) = len(embedding)
        AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
    WHERE list_dot_product(a.e, b.e) >= 0.9::DOUBLE * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))
), reach(node, other) AS (
    SELECT a, b FROM links
    UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
), least AS (
    SELECT node, least(node, min(other)) AS component_id FROM reach GROUP BY node
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links,
       coalesce(component_id, e.vec_id) AS component_id, coalesce(component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN least ON node = e.vec_id
"""

OP12 = r"""
WITH d AS (
    SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
), w AS (
    SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
    SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 10
), g AS (
    SELECT DISTINCT lang, source FROM d
), c AS (
    SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term
), dense AS (
    SELECT lang, source, term, total, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)
), p AS (
    SELECT lang, source, term, n,
           1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source)
                                                 + 2 * count(*) OVER (PARTITION BY lang, source)) AS p
    FROM dense
), q AS (
    SELECT lang, term, 1 + 1000000000::HUGEINT * (total + 2) // (sum(total) OVER (PARTITION BY lang)
                                                                 + 2 * count(*) OVER (PARTITION BY lang)) AS q
    FROM kept
), sums AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
    SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
    FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 10
"""

#: crc32 of the id's decimal text, bit by bit.
CRC32 = """
xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda a, c: list_reduce(
        list_prepend(xor(a, c), range(8)), lambda v, k: xor(v // 2, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END))
), 4294967295::BIGINT)
"""


def written(*columns: str) -> str:
    """SQL of the digest of columns."""
    one = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
    return "sha256(" + " || ".join(one.format(c) for c in columns) + ")"


OP13 = f"""
WITH RECURSIVE d AS (
    SELECT *, CASE WHEN doc_id IS NOT NULL AND {CRC32} % 3 = 0
                   THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other
    FROM documents
), l AS (
    SELECT doc_id, lang, {written("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
           {written("doc_id", "source", "lang", "n_chars", "other")} AS seen
    FROM d
), b AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
           count(*) OVER (PARTITION BY lang) AS n
    FROM l
), up(lang, level, idx, n, h) AS (
    SELECT lang, 0, idx, n, leaf FROM b
    UNION ALL
    SELECT lang, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx))
    FROM up WHERE n > 1 GROUP BY lang, level, idx // 8, n
), s AS (
    SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1
), top(level, idx, n, h) AS (
    SELECT 0, idx, n, h FROM s
    UNION ALL
    SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx))
    FROM top WHERE n > 1 GROUP BY level, idx // 8, n
), nodes AS (
    SELECT 0 AS part, u.lang, s.idx AS tree, level, u.idx, u.h FROM up u JOIN s ON s.lang IS NOT DISTINCT FROM u.lang WHERE u.n > 1
    UNION ALL
    SELECT 1, NULL, NULL, level, idx, h FROM top WHERE n > 1
), leaves AS (
    SELECT row_number() OVER () AS k, b.*, s.h AS subroot, s.idx AS tree, (SELECT h FROM top WHERE n = 1) AS root
    FROM b JOIN s ON s.lang IS NOT DISTINCT FROM b.lang
), steps AS (
    SELECT l.k, n.part, n.level,
           coalesce(string_agg(n.h, '' ORDER BY n.idx) FILTER (WHERE n.idx < l.idx // (1::BIGINT << (3 * n.level))), '') AS l,
           coalesce(string_agg(n.h, '' ORDER BY n.idx) FILTER (WHERE n.idx > l.idx // (1::BIGINT << (3 * n.level))), '') AS r
    FROM leaves l JOIN nodes n
        ON n.part = 0 AND n.tree = l.tree AND n.idx // 8 = l.idx // (1::BIGINT << (3 * n.level + 3))
    GROUP BY ALL
    UNION ALL
    SELECT l.k, n.part, n.level,
           coalesce(string_agg(n.h, '' ORDER BY n.idx) FILTER (WHERE n.idx < l.tree // (1::BIGINT << (3 * n.level))), ''),
           coalesce(string_agg(n.h, '' ORDER BY n.idx) FILTER (WHERE n.idx > l.tree // (1::BIGINT << (3 * n.level))), '')
    FROM leaves l JOIN nodes n ON n.part = 1 AND n.idx // 8 = l.tree // (1::BIGINT << (3 * n.level + 3))
    GROUP BY ALL
), ways AS (
    SELECT k, string_agg(l || r, '' ORDER BY part, level) AS proof, list({{l: l, r: r, h: ''}} ORDER BY part, level) AS steps
    FROM steps GROUP BY k
), done AS (
    SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256,
           list_reduce(list_prepend({{l: '', r: '', h: seen}}, coalesce(steps, [])),
                       lambda a, s: {{l: '', r: '', h: sha256(s.l || a.h || s.r)}}).h AS folded_root
    FROM leaves LEFT JOIN ways USING (k)
)
SELECT *, folded_root = root AS verified FROM done
"""

SQL = {
    "op5_quality_rules": OP5,
    "op6_embedding_near_dedup": OP6,
    "op12_divergence_audit": OP12,
    "op13_merkle_manifest": OP13,
}
