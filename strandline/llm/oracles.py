"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a text of ASCII characters, which DuckDB lacks: bit by bit, polynomial 0xEDB88320."""
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END"
    of_byte = f"list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: {bit})"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: {of_byte}), 4294967295::BIGINT)"


EXACT_DEDUP = """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""

#: A node's members are the conversations that have its digest at its depth; its subtree, the nodes whose owner has it there.
CONVERSATION_TRIE = rf"""
    WITH hashed AS (
        SELECT conv_id, turn, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS t,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
        FROM conversations WHERE conv_id IS NOT NULL),
    turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t) AS at FROM hashed),
    convs AS (
        SELECT conv_id, n, {crc32("conv_id::VARCHAR")} % 4 AS h, conv_id - conv_id % 20 AS base
        FROM (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id)),
    shift AS (SELECT c.conv_id, c.h, c.base, least(c.h, coalesce(b.n, 0)) AS taken FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
    rebuilt AS (
        SELECT s.conv_id, u.at AS depth, u.t, u.words FROM shift s JOIN turns u ON u.conv_id = s.base AND u.at <= s.h
        UNION ALL
        SELECT s.conv_id, u.at - s.h + s.taken, u.t, u.words FROM shift s JOIN turns u ON u.conv_id = s.conv_id AND u.at > s.h),
    p AS (
        SELECT conv_id, depth, sha256(string_agg(t, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth)) AS digest, words FROM rebuilt
        UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
    sizes AS (SELECT conv_id, max(depth) AS size FROM p GROUP BY conv_id),
    nodes AS (SELECT digest, depth, min(conv_id) AS owner, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved FROM p GROUP BY digest, depth),
    tied AS (
        SELECT n.*, u.owner AS parent_conv_id, u.digest AS parent
        FROM nodes n LEFT JOIN p q ON q.conv_id = n.owner AND q.depth = n.depth - 1 LEFT JOIN nodes u ON u.digest = q.digest AND u.depth = q.depth),
    children AS (SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM tied WHERE depth > 0 GROUP BY parent, depth),
    full_nodes AS (SELECT t.*, coalesce(c.n_children, 0) AS n_children FROM tied t LEFT JOIN children c ON c.parent = t.digest AND c.depth = t.depth),
    subtrees AS (
        SELECT q.digest, q.depth, sum(m.saved)::BIGINT AS saved_tokens, count(*) FILTER (m.n_children = 0) AS n_leaves
        FROM full_nodes m JOIN p q ON q.conv_id = m.owner AND q.depth <= m.depth GROUP BY q.digest, q.depth),
    ends AS (
        SELECT digest, depth, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
        FROM p JOIN sizes USING (conv_id) WHERE depth = size GROUP BY digest, depth)
    SELECT f.owner AS conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
    FROM full_nodes f JOIN subtrees s ON s.digest = f.digest AND s.depth = f.depth LEFT JOIN ends e ON e.digest = f.digest AND e.depth = f.depth"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE concat(strlen({value}::VARCHAR), ':', {value}) END"


def _leaf(n_chars: str) -> str:
    return f"sha256(concat({', '.join(_field(v) for v in ('doc_id', 'source', 'lang', n_chars, 'text'))}))"


def _tree(name: str, leaves: str) -> str:
    """Nodes of all levels: g, k (level), i, n (nodes of the group there), h."""
    return f"""{name} AS (
        SELECT g, 0 AS k, i, n, h FROM {leaves}
        UNION ALL
        SELECT g, k + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY g, k, i // 2)"""


def _climb(name: str, start: str, tree: str) -> str:
    """Folds each row (id, g, i, n, h) of ``start`` up its tree; proof joins the siblings met."""
    return f"""{name} AS (
        SELECT id, g, 0 AS k, i, n, h, '' AS proof FROM {start}
        UNION ALL
        SELECT r.id, r.g, r.k + 1, r.i // 2, (r.n + 1) // 2,
               sha256(CASE WHEN s.h IS NULL THEN r.h WHEN r.i % 2 = 1 THEN s.h || r.h ELSE r.h || s.h END), r.proof || coalesce(s.h, '')
        FROM {name} r LEFT JOIN {tree} s ON s.g = r.g AND s.k = r.k AND s.i = xor(r.i, 1) WHERE r.n > 1)"""


MERKLE_MANIFEST = f"""
    WITH RECURSIVE hashed AS (
        SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf("n_chars")} AS h, {_leaf("(n_chars + 1)")} AS other,
               coalesce({crc32("doc_id::VARCHAR")} % 7 = 0 AND n_chars IS NOT NULL, false) AS changed FROM documents),
    leaves AS (
        SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, row_number() OVER () AS id FROM hashed),
    {_tree("tree", "leaves")},
    subroots AS (SELECT '' AS g, g AS name, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
    {_tree("top", "subroots")},
    starts AS (SELECT id, g, i, n, CASE WHEN changed THEN other ELSE h END AS h FROM leaves),
    {_climb("folded", "starts", "tree")},
    arrived AS (SELECT f.id, '' AS g, s.i, s.n, f.h, f.proof AS below, s.h AS subroot FROM folded f JOIN subroots s ON s.name = f.g WHERE f.n = 1),
    {_climb("higher", "arrived", "top")}
    SELECT l.doc_id, l.h AS leaf, a.subroot, t.h AS root, sha256(a.below || h.proof) AS proof_sha256, h.h AS folded_root, h.h = t.h AS verified
    FROM leaves l JOIN arrived a ON a.id = l.id JOIN higher h ON h.id = l.id AND h.n = 1 JOIN top t ON t.n = 1"""
