"""SQL for DuckDB of the operators that SQL can express."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    step = "list_reduce(list_prepend(xor(x, y), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda x, y: {step}), 4294967295)"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Trees level by level (a: of sources, b: of their roots), siblings of each node (s), and a fold up each leaf's path (f).
OP13_MERKLE_MANIFEST = f"""WITH RECURSIVE l AS (SELECT doc_id, source, {_leaf('text')} AS leaf, CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS tampered FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM l),
a AS (SELECT tree, 0 AS level, pos AS idx, n, leaf AS h FROM p UNION ALL SELECT tree, level + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM a WHERE n > 1 GROUP BY tree, level, idx // 3),
b AS (SELECT 0 AS level, tree AS idx, (SELECT count(DISTINCT tree) FROM p) AS n, h FROM a WHERE n = 1 UNION ALL SELECT level + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM b WHERE n > 1 GROUP BY level, idx // 3),
s AS (SELECT x.tree, x.level, x.idx, coalesce(string_agg(y.h, '' ORDER BY y.idx) FILTER (y.idx < x.idx), '') AS lo, coalesce(string_agg(y.h, '' ORDER BY y.idx) FILTER (y.idx > x.idx), '') AS hi FROM a x JOIN a y ON y.tree = x.tree AND y.level = x.level AND y.idx // 3 = x.idx // 3 WHERE x.n > 1 GROUP BY 1, 2, 3
UNION ALL SELECT -1, x.level, x.idx, coalesce(string_agg(y.h, '' ORDER BY y.idx) FILTER (y.idx < x.idx), ''), coalesce(string_agg(y.h, '' ORDER BY y.idx) FILTER (y.idx > x.idx), '') FROM b x JOIN b y ON y.level = x.level AND y.idx // 3 = x.idx // 3 WHERE x.n > 1 GROUP BY x.level, x.idx),
f AS (SELECT doc_id, tree, pos, 0 AS level, pos AS idx, false AS up, '' AS proof, coalesce(tampered, leaf) AS h FROM p
UNION ALL SELECT f.doc_id, f.tree, f.pos, CASE WHEN s.tree IS NULL THEN 0 ELSE f.level + 1 END, CASE WHEN s.tree IS NULL THEN f.tree ELSE f.idx // 3 END, f.up OR s.tree IS NULL, f.proof || coalesce(lo || hi, ''), CASE WHEN s.tree IS NULL THEN f.h ELSE sha256(lo || f.h || hi) END FROM f LEFT JOIN s ON s.tree = CASE WHEN f.up THEN -1 ELSE f.tree END AND s.level = f.level AND s.idx = f.idx WHERE NOT f.up OR s.tree IS NOT NULL),
e AS (SELECT tree, pos, arg_max(h, length(proof) * 1000 + level + CASE WHEN up THEN 500 ELSE 0 END) AS folded_root, max(length(proof)) AS len FROM f WHERE up GROUP BY 1, 2)
SELECT p.doc_id, p.leaf, t.h AS subroot, r.h AS root, sha256(any_value(f.proof)) AS proof_sha256, any_value(e.folded_root) AS folded_root, any_value(e.folded_root) = r.h AS verified FROM p JOIN a t ON t.tree = p.tree AND t.n = 1 JOIN b r ON r.n = 1 JOIN e ON e.tree = p.tree AND e.pos = p.pos JOIN f ON f.tree = p.tree AND f.pos = p.pos AND f.up AND length(f.proof) = e.len GROUP BY p.doc_id, p.tree, p.pos, p.leaf, t.h, r.h"""

#: Words by piece (w), n-grams as windows over them (g), their counts (f), cuts (c), the lowest cut (s), and what a longer one covers (d).
OP12_COLLOCATIONS = r"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM t)),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM p, range(1, 5) r(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT x.lang, x.k, x.phrase, x.f AS a, i, y.f AS l, z.f AS r, 2000000::HUGEINT * x.f // (y.f + z.f) AS score FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS i FROM f WHERE k > 1) x JOIN f y ON y.lang = x.lang AND y.phrase = array_to_string(x.w[1 : i], ' ') JOIN f z ON z.lang = x.lang AND z.phrase = array_to_string(x.w[i + 1 :], ' ')),
s AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
d AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, f, array_to_string(w[j : j + m - 1], ' ') AS phrase FROM (SELECT lang, f, k, string_split(phrase, ' ') AS w, m, unnest(range(1, k - m + 2)) AS j FROM f, range(2, 4) q(m) WHERE k > m)) GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM s LEFT JOIN d ON d.lang = s.lang AND d.phrase = s.phrase JOIN (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY 1) m ON m.lang = s.lang WHERE longer IS NULL OR 100 * longer < 80 * a QUALIFY rank <= 2000"""
