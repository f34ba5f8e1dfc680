"""DuckDB SQL of the queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op4_setsketch"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 3), ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(1, len(words) - 3))) AS i
        FROM split WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least.component_id, d.doc_id = least.component_id AS kept
FROM documents d JOIN least ON least.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

ORACLES["op5_perspectives"] = r"""
WITH told AS (
  SELECT DISTINCT conv_id, CAST(floor(coalesce(turn, -1) / 256.0) AS BIGINT) AS part, turn, trim(role) AS role,
    replace(coalesce(text, ''), '<|im_', '<| im_') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND role IS NOT NULL),
plain AS (
  SELECT DISTINCT conv_id, role, regexp_replace(role, '[^A-Za-z0-9_.-]', '_', 'g') AS name FROM told WHERE role <> 'system'),
speakers AS (
  SELECT conv_id, role AS speaker,
    name || CASE WHEN same > 1 THEN '~' || CAST(same AS VARCHAR) ELSE '' END AS shown
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, name ORDER BY role) AS same FROM plain) AS counted),
turned AS (
  SELECT t.conv_id, t.part, t.turn, t.role, t.text, s.speaker, t.role = s.speaker AS own,
    '<|im_start|>' || CASE WHEN t.role = s.speaker THEN 'assistant' WHEN t.role = 'system' THEN 'system'
      ELSE 'user name=' || n.shown END || chr(10) AS header
  FROM told t JOIN speakers s ON s.conv_id = t.conv_id
  LEFT JOIN speakers n ON n.conv_id = t.conv_id AND n.speaker = t.role),
pieces AS (SELECT *, header || text || '<|im_end|>' || chr(10) AS piece FROM turned),
placed AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, speaker ORDER BY part, turn NULLS FIRST, role, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(piece) AS place
  FROM pieces)
SELECT conv_id, speaker, part, count(*) AS n_turns,
  CAST(sum(CASE WHEN own THEN 1 ELSE 0 END) AS BIGINT) AS n_own,
  CAST(min(place) AS BIGINT) AS char_start,
  string_agg(piece, '' ORDER BY place) AS text,
  coalesce(string_agg(CASE WHEN own THEN CAST(CAST(place + length(header) AS BIGINT) AS VARCHAR) || ':'
    || CAST(CAST(place + length(piece) AS BIGINT) AS VARCHAR) END, ',' ORDER BY place), '') AS mask
FROM placed GROUP BY conv_id, speaker, part
"""


def _crc32(value: str) -> str:
    """Unsigned CRC-32 of a number's decimal digits, bit by bit."""
    bits = f"""flatten(list_transform(string_split(CAST({value} AS VARCHAR), ''),
      lambda x: list_transform(range(8), lambda i: (ascii(x) >> i) & 1)))"""
    step = "xor(c >> 1, CASE WHEN (xor(c, b) & 1) = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce(list_concat([4294967295], {bits}), lambda c, b: {step}), 4294967295)"


def _field(value: str) -> str:
    shown = f"CAST({value} AS VARCHAR)"
    return f"coalesce(CAST(strlen({shown}) AS VARCHAR) || ':' || {shown}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


ORACLES["op11_merkle"] = rf"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('.' || source, '-') AS tree, {_leaf("text")} AS leaf,
    CASE WHEN {_crc32("doc_id")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")}
      ELSE {_leaf("text")} END AS tampered
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
own AS (
  SELECT tree, 0 AS level, place, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3
  FROM own WHERE n > 1 GROUP BY tree, level, place // 3, n),
subroots AS (SELECT tree, digest FROM own WHERE n = 1),
top AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY tree) - 1 AS place, digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3
  FROM top WHERE n > 1 GROUP BY level, place // 3, n),
runs AS (
  SELECT tree, level, place // 3 AS run, list(digest ORDER BY place) AS digests FROM own WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT '', level, place // 3, list(digest ORDER BY place) FROM top WHERE n > 1 GROUP BY ALL),
heights AS (
  SELECT tree, level AS height FROM own WHERE n = 1
  UNION ALL SELECT '', level FROM top WHERE n = 1),
ranks AS (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS rank FROM subroots),
walk AS (
  SELECT p.doc_id, p.leaf, p.tree AS name, p.tree, 0 AS level, p.place, p.tampered AS cur, '' AS proof, h.height
  FROM placed p JOIN heights h ON h.tree = p.tree
  UNION ALL
  SELECT * FROM (
    SELECT w.doc_id, w.leaf, w.name, w.tree, w.level + 1, w.place // 3,
      sha256(array_to_string(r.digests[1:w.place % 3] || [w.cur] || r.digests[w.place % 3 + 2:], '')),
      w.proof || array_to_string(r.digests[1:w.place % 3] || r.digests[w.place % 3 + 2:], ''), w.height
    FROM walk w JOIN runs r ON r.tree = w.tree AND r.level = w.level AND r.run = w.place // 3
    WHERE w.level < w.height
    UNION ALL
    SELECT w.doc_id, w.leaf, w.name, '', 0, k.rank, w.cur, w.proof, h.height
    FROM walk w JOIN ranks k ON k.tree = w.tree JOIN heights h ON h.tree = ''
    WHERE w.level = w.height AND w.tree <> ''))
SELECT w.doc_id, w.leaf, s.digest AS subroot, t.digest AS root, sha256(w.proof) AS proof_sha256,
  w.cur AS folded_root, w.cur = t.digest AS verified
FROM walk w JOIN subroots s ON s.tree = w.name JOIN top t ON t.n = 1
WHERE w.tree = '' AND w.level = w.height
"""

ORACLES["op12_prefix_trie"] = rf"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
original AS (
  SELECT conv_id, list(CAST(strlen(role) AS VARCHAR) || ':' || role || text ORDER BY turn NULLS FIRST,
    md5(CAST(strlen(role) AS VARCHAR) || ':' || role || text)) AS said, {_crc32("conv_id")} % 4 AS h
  FROM told GROUP BY conv_id),
rebuilt AS (
  SELECT c.conv_id, coalesce(b.said[1:c.h], []) || c.said[c.h + 1:] AS said
  FROM original c LEFT JOIN original b ON b.conv_id = c.conv_id - c.conv_id % 20),
members AS (
  SELECT conv_id, len(said) AS length, unnest(range(len(said) + 1)) AS depth, said FROM rebuilt),
prefixes AS (SELECT conv_id, length, depth, said[1:depth] AS prefix FROM members),
nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY prefix, depth),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id,
    (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.prefix[1:n.depth] = n.prefix) AS n_children,
    CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * len(regexp_extract_all(
      regexp_replace(n.prefix[n.depth], '^[0-9]+:', '')[1 + CAST(regexp_extract(n.prefix[n.depth], '^[0-9]+') AS BIGINT):],
      '[^ 	-
]+')) END AS saved
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1])
SELECT n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children,
  CAST(sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
  CAST(sum(u.saved) AS BIGINT) AS saved_tokens, n.ends_sha256
FROM linked n JOIN linked u ON u.depth >= n.depth AND u.prefix[1:n.depth] = n.prefix
GROUP BY ALL
"""

ORACLES["op13_va_file"] = r"""
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
vectors AS (SELECT vec_id, min(v) AS v FROM sound GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
  WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
