"""DuckDB SQL that computes what the registered queries compute, from the same tables."""

from __future__ import annotations

from tessera import config
from tessera.functions.text import LINE_END
from tessera.operators.evaluation import METRICS

BASE_TIME = 1_704_067_200
NOW_TIME = 1_717_243_200
NOW_DATE = "2024-06-01"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


WS = lit(config.WHITESPACE)


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def replace_all(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(by)}, 'g')"


def tokens(x: str) -> str:
    return (
        f"list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
    )


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {lit(config.WHITESPACE_CLASS + '+')}), lambda w: w <> '')"


def sanitized(x: str) -> str:
    chars = config.QUERY_OPERATOR_CHARS
    return strip(f"translate({x}, {lit(chars)}, {lit(' ' * len(chars))})")


def in_order(values: str) -> str:
    """Distinct values of a list, first occurrences in order."""
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


def string_list(values: list[str]) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


CANONICAL = "lower(rtrim(url, '/'))"
HOST = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)"
STOPS = string_list(config.STOP_WORDS)

# --- chunks ---------------------------------------------------------------------

CHUNKS = f"""chunks AS MATERIALIZED (
  SELECT doc_id || '::' || chunk_index AS chunk_id, doc_id, source, lang AS title, chunk_index, text
  FROM (
    SELECT doc_id, source, lang, piece AS text,
           row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index
    FROM (
      SELECT doc_id, source, lang, i, {strip("substr(text, i + 1, 800)")} AS piece
      FROM (SELECT *, unnest(range(0, greatest(length(text) - 100, 1), 700)) AS i FROM documents)
    ) WHERE length(piece) > 50
  )
)"""


def ranked_text(items: str, item: str, asked: str, n: int) -> str:
    """CTEs ending in text_hits: BM25 top n of ``items``(item, text) for ``asked``(query_id, q)."""
    return f"""
tok AS MATERIALIZED (SELECT {item} AS id, {tokens('text')} AS ts FROM {items}),
size AS (SELECT count(*) AS n_docs, sum(len(ts)) / count(*) AS avgdl FROM tok),
post AS MATERIALIZED (
  SELECT id, term, count(*) AS tf, any_value(dl) AS dl
  FROM (SELECT id, unnest(ts) AS term, len(ts) AS dl FROM tok) GROUP BY id, term),
dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM post GROUP BY term),
qterm AS MATERIALIZED (
  SELECT DISTINCT query_id, term
  FROM (SELECT query_id, unnest({tokens(sanitized('q'))}) AS term FROM {asked})),
scored AS (
  SELECT query_id, id,
         sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * ({config.BM25_K1} + 1)
             / (tf + {config.BM25_K1} * (1 - {config.BM25_B} + {config.BM25_B} * dl / avgdl))) AS score
  FROM qterm JOIN dfs USING (term) JOIN post USING (term), size
  GROUP BY query_id, id),
text_hits AS MATERIALIZED (
  SELECT * FROM (
    SELECT query_id, id, score,
           row_number() OVER (PARTITION BY query_id ORDER BY round(-score, 9), id) AS rk
    FROM scored) WHERE rk <= {n})"""


def sparse_vectors(name: str, key: str, frame: str, text: str) -> str:
    """CTEs ``name``(key, b, v) and ``name_norm``(key, norm) of feature-hash vectors."""
    return f"""
{name} AS MATERIALIZED (
  SELECT {key}, h % {config.EMBED_DIM} AS b, sum(CASE WHEN h < 2147483648 THEN 1.0 ELSE -1.0 END) AS v
  FROM (SELECT {key}, ('0x' || substr(md5(unnest({tokens(text)})), 1, 8))::BIGINT AS h FROM {frame})
  GROUP BY {key}, b),
{name}_norm AS MATERIALIZED (SELECT {key}, sqrt(sum(v * v)) AS norm FROM {name} GROUP BY {key})"""


def cosine(dot: str, a: str, b: str) -> str:
    return (
        f"CASE WHEN coalesce({a}, 0) = 0 OR coalesce({b}, 0) = 0 THEN 0.0 "
        f"ELSE coalesce({dot}, 0) / ({a} * {b}) END"
    )


def hybrid(asked: str) -> str:
    """CTEs ending in fused: hybrid top 5 over the chunks for ``asked``(query_id, q)."""
    return f"""{CHUNKS}, {ranked_text('chunks', 'chunk_id', asked, config.FETCH)},
{sparse_vectors('cvec', 'chunk_id', 'chunks', 'text')},
{sparse_vectors('qvec', 'query_id', asked, 'q')},
dots AS MATERIALIZED (
  SELECT query_id, chunk_id, sum(cvec.v * qvec.v) AS dot FROM cvec JOIN qvec USING (b)
  GROUP BY query_id, chunk_id),
distances AS (
  SELECT a.query_id, c.chunk_id, 1 - ({cosine('dot', 'cn.norm', 'qn.norm')}) AS distance
  FROM {asked} a CROSS JOIN (SELECT chunk_id FROM chunks) c
  LEFT JOIN dots d ON d.query_id = a.query_id AND d.chunk_id = c.chunk_id
  LEFT JOIN cvec_norm cn ON cn.chunk_id = c.chunk_id
  LEFT JOIN qvec_norm qn ON qn.query_id = a.query_id),
dense_hits AS MATERIALIZED (
  SELECT * FROM (
    SELECT query_id, chunk_id, distance,
           row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), chunk_id) AS rk
    FROM distances) WHERE rk <= {config.FETCH}),
fused AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, row_number() OVER (
             PARTITION BY query_id
             ORDER BY score DESC, dense_rank NULLS LAST, text_rank NULLS LAST) AS rrf_rank
    FROM (
      SELECT coalesce(d.query_id, t.query_id) AS query_id, coalesce(d.chunk_id, t.id) AS chunk_id,
             d.rk AS dense_rank, t.rk AS text_rank,
             coalesce(1.0::DOUBLE / ({config.RRF_K} + d.rk), 0.0::DOUBLE)
             + coalesce(1.0::DOUBLE / ({config.RRF_K} + t.rk), 0.0::DOUBLE) AS score
      FROM dense_hits d FULL OUTER JOIN text_hits t ON d.query_id = t.query_id AND d.chunk_id = t.id)
  ) WHERE rrf_rank <= {config.TOP_K})"""


ASKED = "asked AS MATERIALIZED (SELECT item_id AS query_id, text AS q FROM benchmark)"
FUSED_COLUMNS = """query_id, chunk_id, CAST(dense_rank AS BIGINT) AS dense_rank,
  CAST(text_rank AS BIGINT) AS text_rank, round(score, 6) AS rrf_score, CAST(rrf_rank AS BIGINT) AS rrf_rank"""


def hybrid_of(version: str, condition: str) -> str:
    """Hybrid search over the chunks of the documents of one version."""
    own = hybrid("asked").replace("FROM documents", f"FROM (SELECT * FROM documents WHERE {condition})")
    return f"SELECT '{version}' AS model_ver, * FROM (WITH {ASKED}, {own} SELECT {FUSED_COLUMNS} FROM fused)"


HYBRID_ROWS = f"""WITH {ASKED}, {hybrid('asked')},
hits AS MATERIALIZED (
  SELECT f.query_id, f.rrf_rank, round(f.score, 6) AS rrf_score, c.chunk_id,
         CAST(c.doc_id AS VARCHAR) AS doc_id, c.source, c.title, c.chunk_index,
         substr(c.text, 1, 4000) AS head
  FROM fused f JOIN chunks c USING (chunk_id))"""
PACKED = f"""{HYBRID_ROWS},
blocks AS (
  SELECT *, rrf_rank AS number,
         '[' || rrf_rank || '] ' || title || ' (' || source || ')' || chr(10) || head AS block FROM hits),
used AS (
  SELECT * FROM (
    SELECT *, sum(length(block)) OVER (
             PARTITION BY query_id ORDER BY rrf_rank ROWS UNBOUNDED PRECEDING) AS used_chars
    FROM blocks) WHERE used_chars <= 2000)"""

# --- upserts and history ----------------------------------------------------------

RECRAWLED = """
recrawled AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, d.source,
         CASE WHEN l.toxic = 1 THEN d.text || ' [revised]' ELSE d.text END AS text
  FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.text IS NOT NULL
  UNION ALL SELECT 'bench-' || item_id, 'benchmark', text FROM benchmark)"""
UPSERT = """
target AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, sha256(text) AS content_hash,
         CAST(length(text) AS BIGINT) AS char_count, 'base' AS batch FROM documents),
src AS (
  SELECT doc_id, source, sha256(text) AS content_hash, CAST(length(text) AS BIGINT) AS char_count,
         'recrawl' AS batch
  FROM (
    SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, d.source,
           CASE WHEN l.toxic = 1 THEN d.text || ' [revised]' ELSE d.text END AS text
    FROM documents d JOIN labels l USING (doc_id)
    UNION ALL
    SELECT 'bench-' || item_id, 'benchmark', text FROM benchmark)),
merged AS (
  SELECT t.doc_id,
         CASE WHEN s.content_hash <> t.content_hash THEN s.source ELSE t.source END AS source,
         CASE WHEN s.content_hash <> t.content_hash THEN s.content_hash ELSE t.content_hash END
           AS content_hash,
         CASE WHEN s.content_hash <> t.content_hash THEN s.char_count ELSE t.char_count END AS char_count,
         CASE WHEN s.content_hash <> t.content_hash THEN s.batch ELSE t.batch END AS batch
  FROM target t LEFT JOIN src s ON s.doc_id = t.doc_id
  UNION ALL
  SELECT * FROM src s WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.doc_id = s.doc_id))"""

# --- pages -------------------------------------------------------------------------


NAMED = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "copy": "©", "middot": "·",
    "ndash": "–", "mdash": "—", "hellip": "…", "amp": "&",
}


def _decoded(x: str) -> str:
    for name, value in NAMED.items():
        x = f"replace({x}, '&{name};', {lit(value)})"
    return x


def _element(tag: str) -> str:
    """A whole element, as short as possible."""
    return rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>"


def _page_steps() -> str:
    """CTEs ending in page(page_id, url, html, text, title)."""
    col = replace_all("html", "(?s)<!--.*?-->", "")
    for tag in "script style noscript template nav footer header aside form".split():
        col = replace_all(col, _element(tag), "")
    body = replace_all("whole", _element("head"), "")
    for tag in ("body", "main", "article"):
        opens = f"regexp_matches(whole, {lit(f'(?i)<{tag}' + chr(91) + '\\s>]')})"
        inside = f"regexp_extract(whole, {lit(rf'(?is)<{tag}(?:\s[^>]*)?>(.*)</{tag}\s*>')}, 1)"
        body = f"CASE WHEN {opens} THEN {inside} ELSE {body} END"
    blanks = r"[ \t\r\n\x{0C}\x{A0}]+"
    lines = (
        "p|br|hr|div|section|article|main|address|blockquote|pre|h[1-6]|ul|ol|li|dl|dt|dd|figure|figcaption|"
        "table|thead|tbody|tfoot|tr"
    )
    text = replace_all("body", blanks, " ")
    text = replace_all(text, rf"(?i)</?(?:{lines})(?:\s[^>]*)?/?>", "\n")
    text = replace_all(text, r"(?i)</(?:td|th)\s*>", " | ")
    text = _decoded(replace_all(text, r"<[^>]+>", ""))
    text = strip(replace_all(replace_all(text, r" *\n[ \n]*", "\n"), r" {2,}", " "))

    def heading(tag: str) -> str:
        found = f"regexp_extract(html, {lit(rf'(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>')}, 1)"
        found = _decoded(replace_all(found, r"<[^>]+>", ""))
        return f"nullif({strip(replace_all(found, blanks, ' '))}, '')"

    return f"""
whole AS (SELECT page_id, url, html, {col} AS whole FROM pages),
bodies AS (SELECT page_id, url, html, {body} AS body FROM whole),
page AS MATERIALIZED (
  SELECT page_id, url, html, {text} AS text, coalesce({heading('title')}, {heading('h1')}) AS title
  FROM bodies)"""


PAGE = _page_steps()
NEEDS_RENDER = f"(contains(html, '<noscript>') OR strlen(html) < {config.RENDER_MIN_BYTES})"
LANDED = f"""WITH {PAGE},
gated AS (
  SELECT {HOST} AS source, url, html, text, title,
         substr(sha256({CANONICAL} || '|' || text), 1, 32) AS doc_id
  FROM page WHERE length(text) >= {config.MIN_INGEST_CHARS}),
landed AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY source, doc_id ORDER BY url, html) AS rn FROM gated)
  WHERE rn = 1)"""

# Main text has no blank lines, so a page is one paragraph: whole, or cut into windows of its own.
GOLD = f"""{LANDED},
gold AS MATERIALIZED (
  SELECT doc_id || '::' || CAST(i / 1300 AS BIGINT) AS chunk_id, doc_id, source, CAST(i / 1300 AS BIGINT) AS chunk_index,
         CAST(i AS BIGINT) AS start_char, substr(text, i + 1, 1500) AS piece
  FROM (SELECT *, unnest(range(0, CASE WHEN length(text) <= 1500 THEN 1 ELSE length(text) END, 1300)) AS i
        FROM landed WHERE length(text) >= 500))"""
QUOTED = r"""'(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)'"""
LINKS = rf"""
links AS MATERIALIZED (
  SELECT DISTINCT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1)
                       || regexp_replace(href, '#.*$', '') AS link
  FROM (
    SELECT page_id, url, {_decoded("trim(quoted, '\"''')")} AS href
    FROM (SELECT page_id, url, unnest(regexp_extract_all(html, {QUOTED}, 1)) AS quoted FROM pages))
  WHERE href <> '' AND NOT starts_with(href, 'mailto:') AND NOT starts_with(href, 'javascript:'))"""

# --- questions ----------------------------------------------------------------------


def intent(q: str) -> str:
    ws = words(f"lower({q})")
    return f"""CASE
      WHEN list_has_any({ws}, {string_list(config.MULTI_HOP_WORDS)}) THEN 'multi_hop'
      WHEN len({ws}) <= {config.AMBIGUOUS_MAX_WORDS}
           AND list_has_any({ws}, {string_list(config.AMBIGUOUS_WORDS)}) THEN 'ambiguous'
      ELSE 'factual' END"""


def augmented(q: str, kind: str) -> str:
    return (
        f"CASE WHEN {kind} = 'ambiguous' THEN {lit(config.REWRITE_PREFIX)} || {strip(q)} "
        f"ELSE {strip(q)} END"
    )


POOR = f"(length({strip("coalesce(answer, '')")}) < {config.MIN_ANSWER_CHARS}" + "".join(
    f" OR contains(lower(coalesce(answer, '')), {lit(p)})" for p in config.REFUSAL_PHRASES
) + ")"

# --- evaluation ----------------------------------------------------------------------


def sentences(x: str) -> str:
    pieces = f"string_split(replace({x}, chr(10), ' '), '.')"
    return f"list_filter(list_transform({pieces}, lambda s: {strip('s')}), lambda s: length(s) > 10)"


EVAL = f"""
items AS MATERIALIZED (
  SELECT item_id AS query_id, text AS answer, coalesce(({sentences('text')})[1], text) AS q FROM benchmark),
{hybrid('items')},
got AS MATERIALIZED (
  SELECT f.query_id, f.chunk_id, substr(c.text, 1, 500) AS head FROM fused f JOIN chunks c USING (chunk_id)),
heads AS (SELECT DISTINCT chunk_id, head FROM got),
{sparse_vectors('hvec', 'chunk_id', 'heads', 'head')},
{sparse_vectors('avec', 'query_id', 'items', 'answer')},
per_pair AS (
  SELECT g.query_id, g.chunk_id, g.head,
         {cosine('(SELECT sum(h.v * x.v) FROM hvec h JOIN qvec x USING (b) '
                 'WHERE h.chunk_id = g.chunk_id AND x.query_id = g.query_id)', 'hn.norm', 'qn.norm')}
           AS to_question,
         {cosine('(SELECT sum(h.v * x.v) FROM hvec h JOIN avec x USING (b) '
                 'WHERE h.chunk_id = g.chunk_id AND x.query_id = g.query_id)', 'hn.norm', 'an.norm')}
           AS to_answer
  FROM got g LEFT JOIN hvec_norm hn USING (chunk_id) LEFT JOIN qvec_norm qn USING (query_id)
  LEFT JOIN avec_norm an USING (query_id)),
per_query AS (
  SELECT query_id, count(*) AS chunks_retrieved,
         avg(CASE WHEN round(to_question, 9) >= {config.PRECISION_THRESHOLD} THEN 1.0 ELSE 0.0 END)
           AS context_precision,
         max(to_answer) AS best,
         list_distinct(flatten(list({words('lower(head)')}))) AS ctx
  FROM per_pair GROUP BY query_id),
sentence AS (
  SELECT query_id, list_distinct(list_transform(
           list_filter({words('s')}, lambda w: length(w) > 4), lambda w: lower(w))) AS kw
  FROM (SELECT query_id, unnest({sentences('answer')}) AS s FROM items)),
grounding AS (
  SELECT query_id, count(*) AS n,
         sum(CASE WHEN len(kw) > 0 AND len(list_intersect(kw, ctx)) / len(kw) >= {config.GROUNDED_SHARE}
             THEN 1 ELSE 0 END) AS grounded
  FROM sentence JOIN per_query USING (query_id) GROUP BY query_id),
scores AS MATERIALIZED (
  SELECT i.query_id, CAST(coalesce(p.chunks_retrieved, 0) AS BIGINT) AS chunks_retrieved,
         round(CASE WHEN {strip('i.answer')} = '' THEN 0.0 ELSE greatest(0.0, {cosine(
             '(SELECT sum(a.v * x.v) FROM avec a JOIN qvec x USING (b) '
             'WHERE a.query_id = i.query_id AND x.query_id = i.query_id)', 'an.norm', 'qn.norm')}) END, 4)
           AS answer_relevance,
         round(coalesce(p.context_precision, 0.0), 4) AS context_precision,
         round(coalesce(CASE WHEN best < {config.RECALL_THRESHOLD}
                        THEN least(1.0, best / {config.RECALL_THRESHOLD}) ELSE 1.0 END, 0.0), 4)
           AS context_recall,
         round(coalesce(g.grounded / g.n, 0.0), 4) AS faithfulness
  FROM items i LEFT JOIN per_query p USING (query_id) LEFT JOIN grounding g USING (query_id)
  LEFT JOIN qvec_norm qn USING (query_id) LEFT JOIN avec_norm an USING (query_id))"""

RANKINGS = f"""
longest AS (SELECT * FROM (
  SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rk
  FROM documents) WHERE rk <= {config.FETCH}),
hashed AS (SELECT * FROM (
  SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(text), doc_id) AS rk
  FROM documents) WHERE rk <= {config.FETCH}),
merged AS (
  SELECT *, row_number() OVER (
           PARTITION BY lang ORDER BY score DESC, first_rank NULLS LAST, second_rank NULLS LAST) AS rrf_rank
  FROM (
    SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.doc_id, b.doc_id) AS doc_id,
           a.rk AS first_rank, b.rk AS second_rank,
           coalesce(1.0::DOUBLE / ({config.RRF_K} + a.rk), 0.0::DOUBLE)
           + coalesce(1.0::DOUBLE / ({config.RRF_K} + b.rk), 0.0::DOUBLE) AS score
    FROM longest a FULL OUTER JOIN hashed b ON a.lang = b.lang AND a.doc_id = b.doc_id))"""

# --- vectors ---------------------------------------------------------------------------

CENTROIDS = """
parts AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos
  FROM embeddings),
centroid AS MATERIALIZED (
  SELECT CAST(label AS BIGINT) AS label, list(x ORDER BY pos) AS v
  FROM (SELECT label, pos, round(avg(x), 6) AS x FROM parts GROUP BY label, pos) GROUP BY label),
corpus AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"""


def list_cosine(a: str, b: str) -> str:
    return (
        f"list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
    )


CELLS = f"""
mid AS MATERIALIZED (
  SELECT a.label AS query_id, list_transform(list_zip(a.v, b.v), lambda z: (z[1] + z[2]) / 2) AS v
  FROM centroid a JOIN centroid b ON b.label = a.label + 1),
cell AS MATERIALIZED (SELECT vec_id, v, label AS cell FROM (
  SELECT c.vec_id, c.v, q.label,
         row_number() OVER (PARTITION BY vec_id ORDER BY round({list_cosine('c.v', 'q.v')}, 9) DESC, q.label) AS rn
  FROM corpus c, centroid q) WHERE rn = 1),
probes AS MATERIALIZED (
  SELECT m.query_id, m.v, q.label AS cell,
         row_number() OVER (PARTITION BY m.query_id
           ORDER BY round({list_cosine('m.v', 'q.v')}, 9) DESC, q.label) AS rn
  FROM mid m, centroid q)"""


def buckets(bounds: list[float]) -> str:
    return ", ".join(
        f"CAST(sum(CASE WHEN value <= {b} THEN 1 ELSE 0 END) AS BIGINT) AS le_{i}"
        for i, b in enumerate(bounds)
    )


DAILY = f"""SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400 AS window_epoch, event_type,
       {buckets(config.GENERATION_BUCKETS)}, count(value) AS le_inf, round(sum(value), 4) AS value_sum
FROM events GROUP BY ALL"""

_OVERSIZE = """list_transform(range(0, p.n, 1300),
              lambda i: {'t': substr(p.p, i + 1, 1500), 's': pos + i,
                    'e': pos + i + length(substr(p.p, i + 1, 1500))})"""

ASSEMBLED = f"""assembled AS MATERIALIZED (
  SELECT conv_id, count(*) AS page_count,
         coalesce(string_agg(t, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE t <> ''), '') AS text
  FROM (SELECT conv_id, turn, {strip("coalesce(text, '')")} AS t FROM conversations) GROUP BY conv_id)"""

ORACLES: dict[str, str] = {
    "doc_identity": f"""SELECT page_id, {CANONICAL} AS canonical_url,
        substr(sha256({CANONICAL} || '|' || html), 1, 32) AS doc_id, sha256(html) AS content_hash,
        CAST(strlen(html) AS BIGINT) AS byte_size, CAST(length(html) AS BIGINT) AS char_count FROM pages""",
    "newest_per_key": """SELECT user_id, event_id, event_type, value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn
        FROM events) WHERE rn = 1""",
    "filter_documents": """SELECT doc_id, source, lang, n_chars FROM documents
        WHERE doc_id IS NOT NULL AND text IS NOT NULL AND length(text) >= 500""",
    "conditional_upsert": f"WITH {UPSERT} SELECT * FROM merged",
    "incremental_upsert": """SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, sha256(text) AS content_hash,
        CAST(length(text) AS BIGINT) AS char_count FROM documents""",
    "full_upsert": """WITH src AS (
        SELECT l_orderkey AS o_orderkey, 'R' AS o_orderstatus,
               round(sum(l_extendedprice * (1 - l_discount)), 4) AS o_totalprice
        FROM lineitem GROUP BY l_orderkey)
        SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders o
        WHERE NOT EXISTS (SELECT 1 FROM src WHERE src.o_orderkey = o.o_orderkey)
        UNION ALL SELECT * FROM src""",
    "upsert_versions": f"""WITH again AS (
        SELECT doc_id || '::0' AS chunk_id, CAST(length(text) + 1 AS BIGINT) AS char_count
        FROM documents JOIN labels USING (doc_id)),
        src AS (SELECT chunk_id, 'v1' AS ver, char_count FROM again
                UNION ALL SELECT chunk_id, 'v2', char_count FROM again),
        target AS (SELECT doc_id || '::0' AS chunk_id, 'v1' AS ver, CAST(length(text) AS BIGINT) AS char_count
                   FROM documents)
        SELECT chunk_id, ver AS embedding_model_ver, coalesce(s.char_count, t.char_count) AS char_count,
               CAST(CASE WHEN t.chunk_id IS NULL THEN {NOW_TIME} ELSE {BASE_TIME} END AS BIGINT)
                 AS created_epoch,
               CAST(CASE WHEN s.chunk_id IS NULL THEN {BASE_TIME} ELSE {NOW_TIME} END AS BIGINT)
                 AS updated_epoch
        FROM target t FULL OUTER JOIN src s USING (chunk_id, ver)""",
    "skip_landed": """SELECT source, doc_id, n_chars FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
    "current_versions": f"""SELECT canonical_url, max(page_id) AS doc_id
        FROM (SELECT {CANONICAL} AS canonical_url, page_id FROM pages) GROUP BY canonical_url""",
    "prune_orphans": f"""WITH {CHUNKS},
        again AS (SELECT doc_id, unnest(range(0, length(text), 1300)) // 1300 AS chunk_index
                  FROM documents JOIN labels USING (doc_id))
        SELECT doc_id, chunk_index FROM chunks c
        WHERE NOT EXISTS (SELECT 1 FROM again a WHERE a.doc_id = c.doc_id)
           OR EXISTS (SELECT 1 FROM again a WHERE a.doc_id = c.doc_id AND a.chunk_index = c.chunk_index)""",
    "window_chunks": """SELECT doc_id, i // 1300 AS chunk_index, i AS start_char,
        CAST(length(piece) AS BIGINT) AS char_count, md5(piece) AS text_md5
        FROM (SELECT doc_id, i, substr(text, i + 1, 1500) AS piece
              FROM (SELECT *, unnest(range(0, length(text), 1300)) AS i FROM documents))""",
    "sliding_chunks": f"""WITH {CHUNKS} SELECT chunk_id, doc_id, source, chunk_index,
        CAST(length(text) AS BIGINT) AS char_count, md5(text) AS text_md5 FROM chunks""",
    "assemble_documents": f"""WITH {ASSEMBLED} SELECT conv_id, page_count,
        CAST(length(text) AS BIGINT) AS char_count, md5(text) AS text_md5 FROM assembled""",
    "paragraph_chunks": f"""WITH RECURSIVE {ASSEMBLED},
        para AS MATERIALIZED (
          SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS k, p, length(p) AS n
          FROM (SELECT conv_id, generate_subscripts(ps, 1) AS i, {strip('unnest(ps)')} AS p
                FROM (SELECT conv_id, string_split(text, chr(10) || chr(10)) AS ps FROM assembled
                      WHERE length(text) >= 500)) WHERE p <> ''),
        fold AS (
          SELECT DISTINCT conv_id, 0::BIGINT AS k, '' AS buf, 0::BIGINT AS st, 0::BIGINT AS pos,
                 []::STRUCT(t VARCHAR, s BIGINT, e BIGINT)[] AS o FROM para
          UNION ALL
          SELECT f.conv_id, p.k,
                 CASE WHEN fits AND buf = '' THEN p.p WHEN fits THEN buf || chr(10) || chr(10) || p.p
                      WHEN p.n > 1500 THEN '' ELSE p.p END,
                 CASE WHEN fits OR buf = '' THEN st ELSE greatest(0, st + length(buf) - 200) END,
                 CASE WHEN fits THEN pos ELSE pos + p.n + 2 END,
                 CASE WHEN fits THEN o
                      ELSE list_concat(
                        CASE WHEN buf = '' THEN o
                             ELSE list_append(o, {{'t': buf, 's': st, 'e': st + length(buf)}}) END,
                        CASE WHEN p.n > 1500 THEN {_OVERSIZE}
                             ELSE []::STRUCT(t VARCHAR, s BIGINT, e BIGINT)[] END) END
          FROM fold f JOIN (SELECT * FROM para) p ON p.conv_id = f.conv_id AND p.k = f.k + 1,
               LATERAL (SELECT CASE WHEN buf = '' THEN p.n <= 1500
                                    ELSE length(buf) + 2 + p.n <= 1500 END AS fits) c),
        done AS (
          SELECT conv_id, CASE WHEN buf = '' THEN o
                 ELSE list_append(o, {{'t': buf, 's': st, 'e': st + length(buf)}}) END AS o
          FROM fold f WHERE k = (SELECT max(k) FROM para p WHERE p.conv_id = f.conv_id))
        SELECT conv_id || '::' || (i - 1) AS chunk_id, substr(CAST(conv_id AS VARCHAR), 1, 2) AS doc_id_prefix,
               i - 1 AS chunk_index, CAST(length(c.t) AS BIGINT) AS char_count, c.s AS start_char,
               c.e AS end_char, md5(c.t) AS text_md5
        FROM (SELECT conv_id, unnest(o) AS c, generate_subscripts(o, 1) AS i FROM done)""",
    "corpus_load": f"""WITH {CHUNKS} SELECT md5(c.source || '::' || c.doc_id || '.md') || '::' || chunk_index
          AS chunk_id, c.source,
          {strip(f"ltrim(string_split_regex(d.text, {lit(LINE_END)})[1], '# ')")} AS title,
          CAST(length(c.text) AS BIGINT) AS char_count, md5(c.text) AS text_md5
        FROM chunks c JOIN documents d USING (doc_id)""",
    "chunk_stats": f"""WITH {CHUNKS} SELECT count(*) AS n_docs, CAST(sum(c) AS BIGINT) AS n_chunks,
        round(avg(c), 6) AS avg_chunks_per_doc
        FROM (SELECT count(*) AS c FROM chunks GROUP BY doc_id)""",
    "chunk_positions": f"""WITH {CHUNKS} SELECT chunk_id, doc_id, chunk_index,
        row_number() OVER (ORDER BY doc_id, chunk_index) - 1 AS position FROM chunks""",
    "source_stats": f"""WITH {CHUNKS} SELECT source, count(DISTINCT doc_id) AS n_docs, count(*) AS n_chunks
        FROM chunks GROUP BY source""",
    "version_counts": """SELECT 'v1' AS embedding_model_ver, count(*) AS n FROM documents
        UNION ALL SELECT 'v2', count(*) FROM labels
        UNION ALL SELECT '_total', (SELECT count(*) FROM documents) + (SELECT count(*) FROM labels)""",
    "term_upkeep": f"""WITH {RECRAWLED}
        SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf
        FROM (SELECT doc_id, term, count(*) AS tf
              FROM (SELECT doc_id, unnest({tokens('text')}) AS term FROM recrawled) GROUP BY doc_id, term)
        GROUP BY term""",
    "source_upkeep": f"""WITH {RECRAWLED}
        SELECT source, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM recrawled GROUP BY source""",
    "empty_rollup": """SELECT '_total' AS embedding_model_ver, count(*) AS n FROM embeddings WHERE len(embedding) = 0""",
    "term_stats": f"""SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf
        FROM (SELECT doc_id, term, count(*) AS tf
              FROM (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents) GROUP BY doc_id, term)
        GROUP BY term""",
    "text_corpus_stats": f"""SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total_terms,
        round(sum(n) / count(*), 6) AS avg_terms
        FROM (SELECT len({tokens('text')}) AS n FROM documents)""",
    "query_forms": f"""SELECT item_id, s AS sanitized, array_to_string({in_order('ts')}, ' AND ') AS and_query
        FROM (SELECT item_id, s, list_filter({tokens('s')}, lambda t: NOT list_contains({STOPS}, t)) AS ts
              FROM (SELECT item_id, {sanitized('text')} AS s FROM benchmark))""",
    "bm25_topk": f"""WITH {ASKED}, {ranked_text('documents', 'doc_id', 'asked', config.FETCH)}
        SELECT query_id, id AS doc_id, round(score, 6) AS fts_score, rk AS rank FROM text_hits""",
    "phrase_topk": f"""WITH {ASKED}, {ranked_text('documents', 'doc_id', 'asked', 1_000_000_000)},
        phrase AS (SELECT query_id, ' ' || array_to_string({tokens(sanitized('q'))}, ' ') || ' ' AS p FROM asked),
        joined AS (SELECT id, ' ' || array_to_string(ts, ' ') || ' ' AS t FROM tok)
        SELECT query_id, id AS doc_id, round(score, 6) AS fts_score, rank FROM (
          SELECT h.query_id, h.id, score,
                 row_number() OVER (PARTITION BY h.query_id ORDER BY round(-score, 9), h.id) AS rank
          FROM text_hits h JOIN phrase USING (query_id) JOIN joined USING (id) WHERE contains(t, p))
        WHERE rank <= {config.TOP_K}""",
    "text_match_modes": f"""WITH tok AS MATERIALIZED (SELECT doc_id, {tokens('text')} AS ts FROM documents),
        docs AS MATERIALIZED (SELECT list_distinct(ts) AS ts, ' ' || array_to_string(ts, ' ') || ' ' AS t FROM tok),
        q AS MATERIALIZED (
          SELECT query_id, ' ' || array_to_string(all_ts, ' ') || ' ' AS p,
                 list_distinct(list_filter(all_ts, lambda t: NOT list_contains({STOPS}, t))) AS qs
          FROM (SELECT item_id AS query_id, {tokens(sanitized('text'))} AS all_ts FROM benchmark)),
        hit AS MATERIALIZED (
          SELECT query_id, list_has_any(ts, qs) AS a, list_has_all(ts, qs) AS e, contains(t, p) AS f
          FROM q, docs WHERE len(qs) > 0)
        SELECT query_id, 'any' AS mode, CAST(sum(CASE WHEN a THEN 1 ELSE 0 END) AS BIGINT) AS n_matches
        FROM hit GROUP BY 1
        UNION ALL SELECT query_id, 'all', CAST(sum(CASE WHEN e THEN 1 ELSE 0 END) AS BIGINT) FROM hit GROUP BY 1
        UNION ALL SELECT query_id, 'phrase', CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) AS BIGINT)
        FROM hit GROUP BY 1""",
    "hash_embedding": f"""WITH {sparse_vectors('vec', 'doc_id', 'documents', 'text')},
        dense AS (
          SELECT doc_id, b, CAST(coalesce(v, 0) AS BIGINT) AS v
          FROM (SELECT doc_id, unnest(range(0, {config.EMBED_DIM})) AS b FROM documents)
          LEFT JOIN vec USING (doc_id, b))
        SELECT doc_id, CAST(sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_nonzero,
               CAST(sum(v * v) AS BIGINT) AS norm_squared,
               md5(string_agg(CAST(v AS VARCHAR), ',' ORDER BY b)) AS vector_md5
        FROM dense GROUP BY doc_id""",
    "vector_validation": """SELECT CAST(label AS BIGINT) AS label, count(*) AS n,
        CAST(sum(CASE WHEN len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0
                 THEN 1 ELSE 0 END) AS BIGINT) AS n_valid
        FROM embeddings GROUP BY label""",
    "dense_topk": f"""WITH {CENTROIDS}
        SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_id) AS rank
          FROM (SELECT q.label AS query_id, c.vec_id, 1 - {list_cosine('c.v', 'q.v')} AS distance
                FROM corpus c, centroid q)) WHERE rank <= {config.FETCH}""",
    "cell_topk": f"""WITH {CENTROIDS}, {CELLS},
        probe AS (SELECT * FROM probes WHERE rn <= 3)
        SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_id) AS rank
          FROM (SELECT p.query_id, c.vec_id, 1 - {list_cosine('c.v', 'p.v')} AS distance
                FROM probe p JOIN cell c USING (cell))) WHERE rank <= 10""",
    "ann_topk_recall": f"""WITH {CENTROIDS}, {CELLS},
        near_mid AS (SELECT query_id, vec_id FROM (
          SELECT m.query_id, c.vec_id,
                 row_number() OVER (PARTITION BY query_id ORDER BY round(1 - {list_cosine('c.v', 'm.v')}, 9), vec_id) AS rank
          FROM mid m, corpus c) WHERE rank <= 10),
        places AS (
          SELECT p.rn, count(*) AS n FROM near_mid x JOIN cell c USING (vec_id)
          JOIN probes p ON p.query_id = x.query_id AND p.cell = c.cell GROUP BY p.rn),
        reached AS (SELECT rn, sum(n) OVER (ORDER BY rn) / sum(n) OVER () AS share FROM places),
        tuned AS (SELECT min(rn) AS n_probe FROM reached WHERE share >= {config.TARGET_RECALL}),
        held AS (SELECT vec_id AS query_id, v FROM corpus WHERE vec_id % 100 = 0),
        exact AS (SELECT query_id, vec_id FROM (
          SELECT h.query_id, c.vec_id,
                 row_number() OVER (PARTITION BY query_id ORDER BY round(1 - {list_cosine('c.v', 'h.v')}, 9), vec_id) AS rank
          FROM held h, corpus c) WHERE rank <= 10),
        looked AS (SELECT query_id, cell FROM (
          SELECT h.query_id, q.label AS cell,
                 row_number() OVER (PARTITION BY h.query_id
                   ORDER BY round({list_cosine('h.v', 'q.v')}, 9) DESC, q.label) AS rn
          FROM held h, centroid q) WHERE rn <= (SELECT n_probe FROM tuned))
        SELECT (SELECT count(*) FROM held) AS n_queries, count(*) AS n_expected, count(l.cell) AS n_found,
               round(count(l.cell) / count(*), 4) AS recall, (SELECT n_probe FROM tuned) AS n_probe
        FROM exact e JOIN cell c USING (vec_id) LEFT JOIN looked l ON l.query_id = e.query_id AND l.cell = c.cell""",
    "rrf_fuse": f"""WITH {RANKINGS} SELECT lang, doc_id, first_rank, second_rank,
        round(score, 6) AS rrf_score, rrf_rank FROM merged WHERE rrf_rank <= 10""",
    "hybrid_search_topk": f"""WITH {ASKED}, {hybrid('asked')}
        SELECT query_id, chunk_id, dense_rank, text_rank, round(score, 6) AS rrf_score, rrf_rank FROM fused""",
    "hybrid_search_versions": hybrid_of("v1", "lang = 'en'")
    + " UNION ALL "
    + hybrid_of("v2", "lang IS NULL OR lang <> 'en'"),
    "search_response": f"""{HYBRID_ROWS}
        SELECT query_id, rrf_rank AS position, chunk_id, doc_id, source, chunk_index,
               round(rrf_score, 4) AS score, substr(head, 1, {config.RESPONSE_HEAD_CHARS}) AS text_head
        FROM hits""",
    "search_response_dense": f"""WITH {ASKED}, {hybrid('asked')}
        SELECT h.query_id, h.rk AS position, c.chunk_id, CAST(c.doc_id AS VARCHAR) AS doc_id, c.source, c.chunk_index,
               round(1 - h.distance, 4) AS score, substr(c.text, 1, {config.RESPONSE_HEAD_CHARS}) AS text_head
        FROM dense_hits h JOIN chunks c USING (chunk_id) WHERE h.rk <= {config.TOP_K}""",
    "search_response_json": f"""{HYBRID_ROWS}
        SELECT query_id, 'hybrid' AS mode, count(*) AS n_results,
               CAST(to_json(list({{'chunk_id': chunk_id, 'source': source, 'chunk_index': chunk_index,
                 'score_e4': CAST(round(round(rrf_score, 4) * 10000) AS BIGINT),
                 'text_head': substr(head, 1, {config.RESPONSE_HEAD_CHARS})}} ORDER BY rrf_rank)) AS VARCHAR)
                 AS results
        FROM hits GROUP BY query_id""",
    "context_pack": f"""{PACKED},
        packed AS (
          SELECT query_id, count(*) AS n_used, CAST(max(used_chars) AS BIGINT) AS used_chars,
                 string_agg(block, chr(10) || chr(10) ORDER BY rrf_rank) AS context
          FROM used GROUP BY query_id)
        SELECT query_id, n_used, used_chars, md5(context) AS context_md5,
               md5('Below are numbered passages from a document collection, the closest match on top. '
                   || 'Base every statement on them and name the numbers you used. Should they leave the matter open, '
                   || 'write that it is not in the context.' || chr(10) || chr(10) || context
                   || chr(10) || chr(10) || '== Asked ==' || chr(10) || q
                   || chr(10) || chr(10) || '== Reply ==') AS prompt_md5
        FROM packed JOIN asked USING (query_id)""",
    "citations": f"""{PACKED} SELECT query_id, number, title, source, '' AS source_url, doc_id, chunk_index
        FROM used""",
    "route_questions": f"""SELECT conv_id, turn, sentence, intent,
               {augmented('question', 'intent')} AS augmented_question
        FROM (SELECT *, {intent('question')} AS intent FROM (
          SELECT conv_id, turn, generate_subscripts(ps, 1) - 1 AS sentence, unnest(ps) AS question
          FROM (SELECT conv_id, turn, string_split(replace(text, chr(10), ' '), '.') AS ps
                FROM conversations WHERE role = 'user'))
        WHERE trim(question) <> '')""",
    "retry_pass": f"""SELECT conv_id, turn, intent, is_poor, CAST(is_poor AS BIGINT) AS retry_count,
               CASE WHEN is_poor THEN coalesce(list_filter({words('aug')}, lambda w: length(w) > 3)[1], aug) END
                 AS retry_question
        FROM (SELECT *, {augmented('question', 'intent')} AS aug FROM (
          SELECT u.conv_id, u.turn, u.text AS question, {intent('u.text')} AS intent, {POOR} AS is_poor
          FROM (SELECT * FROM conversations WHERE role = 'user') u
          LEFT JOIN (SELECT conv_id, turn - 1 AS turn, text AS answer FROM conversations
                     WHERE role = 'assistant') a USING (conv_id, turn)))""",
    "retrieval_eval": f"WITH {EVAL} SELECT * FROM scores",
    "eval_means": f"""WITH {EVAL} SELECT count(*) AS n_questions,
        {", ".join(f"round(sum(CAST({m} AS DECIMAL(12, 4))) / count(*), 4) AS {m}" for m in METRICS)}
        FROM scores""",
    "ranker_comparison": f"""WITH {RANKINGS},
        ranked AS (
          SELECT 'longest' AS ranker, lang, doc_id, rk FROM longest
          UNION ALL SELECT 'hashed', lang, doc_id, rk FROM hashed
          UNION ALL SELECT 'fused', lang, doc_id, rrf_rank FROM merged WHERE rrf_rank <= {config.FETCH}),
        relevant AS (SELECT lang, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
        wanted AS (SELECT lang, count(*) AS n FROM relevant GROUP BY lang),
        per_query AS (
          SELECT ranker, r.lang, sum(CASE WHEN rk <= 5 AND v.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS p,
                 sum(CASE WHEN rk <= 10 AND v.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS h
          FROM ranked r LEFT JOIN relevant v ON v.lang = r.lang AND v.doc_id = r.doc_id
          GROUP BY ranker, r.lang)
        SELECT ranker, count(*) AS n_queries, round(avg(p / 5), 4) AS precision_at_k,
               round(avg(h / n), 4) AS recall_at_k
        FROM per_query JOIN wanted USING (lang) GROUP BY ranker""",
    "page_clean": f"""WITH {PAGE} SELECT page_id, title, {NEEDS_RENDER} AS needs_render,
        CAST(length(text) AS BIGINT) AS char_count, md5(text) AS text_md5 FROM page""",
    # The pages' own text, with what was put in at the end of its first line.
    "page_markup": f"""WITH {PAGE},
        added AS (
          SELECT page_id, CASE WHEN contains(text, chr(10))
                   THEN substr(text, 1, instr(text, chr(10)) - 1) || ' é♥&lt;' || substr(text, instr(text, chr(10)))
                   ELSE text || ' é♥&lt;' END AS text,
                 string_split(replace(replace(html, '</h1>', '<a href="/w' || page_id || 'é">'), '&amp;', '&'), '<a href="') AS after
          FROM page),
        linked AS (SELECT page_id, text, list_transform(after[2:], lambda x: string_split(x, '"')[1]) AS links FROM added)
        SELECT page_id, CAST(length(text) AS BIGINT) AS char_count, md5(text) AS text_md5,
               CAST(len(links) AS BIGINT) AS n_links, md5(array_to_string(links, chr(10))) AS links_md5 FROM linked""",
    "raw_bodies": f"""SELECT 'page-' || page_id AS raw_object_key, {HOST} AS source, '2024-06-01' AS date,
               CAST(strlen(html) + CASE WHEN page_id % 3 = 0 THEN 5 ELSE 0 END AS BIGINT) AS byte_size,
               CAST(length(body) AS BIGINT) AS char_count, md5(body) AS text_md5
        FROM (SELECT *, CASE WHEN page_id % 3 = 0 THEN '\ufffd' || html || '\ufffdx\ufffd' ELSE html END AS body FROM pages)""",
    "broken_records": """WITH landed AS (
          SELECT 'line' AS form, doc_id % 10 = 0 AS cut, doc_id, text FROM documents
          UNION ALL SELECT 'object', item_id % 7 = 0, item_id, text FROM benchmark),
        states AS (
          SELECT form, text, CASE WHEN cut THEN 'broken' WHEN doc_id IS NULL OR text IS NULL THEN 'incomplete'
                   ELSE 'good' END AS state FROM landed)
        SELECT form, state, count(*) AS n_records,
               CAST(sum(CASE WHEN state = 'good' THEN length(text) END) AS BIGINT) AS text_chars
        FROM states GROUP BY form, state""",
    "page_links": f"WITH {LINKS} SELECT url, link FROM links",
    "link_frontier": f"""WITH {LINKS},
        edge AS MATERIALIZED (
          SELECT {HOST.replace('(url', '(link')} AS source, url, link FROM links
          WHERE NOT contains(link, '?') AND {HOST.replace('(url', '(link')} IN (SELECT {HOST} FROM pages)),
        d0 AS MATERIALIZED (
          SELECT source, url, 0 AS depth FROM (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY url) AS rn
            FROM (SELECT DISTINCT {HOST} AS source, url FROM pages)) WHERE rn <= 50),
        d1 AS MATERIALIZED (
          SELECT source, url, 1 AS depth FROM (
            SELECT source, link AS url, row_number() OVER (PARTITION BY source ORDER BY link) AS rn
            FROM (SELECT DISTINCT e.source, e.link FROM edge e JOIN d0 USING (source, url)
                  ANTI JOIN d0 s ON s.source = e.source AND s.url = e.link)) n
          WHERE rn <= 50 - (SELECT count(*) FROM d0 s WHERE s.source = n.source)),
        d01 AS MATERIALIZED (SELECT * FROM d0 UNION ALL SELECT * FROM d1),
        d2 AS (
          SELECT source, url, 2 AS depth FROM (
            SELECT source, link AS url, row_number() OVER (PARTITION BY source ORDER BY link) AS rn
            FROM (SELECT DISTINCT e.source, e.link FROM edge e JOIN d1 USING (source, url)
                  ANTI JOIN d01 s ON s.source = e.source AND s.url = e.link)) n
          WHERE rn <= 50 - (SELECT count(*) FROM d01 s WHERE s.source = n.source))
        SELECT source, url, CAST(depth AS BIGINT) AS depth
        FROM (SELECT * FROM d01 UNION ALL SELECT * FROM d2)""",
    "bronze_landing": f"""{LANDED}
        SELECT doc_id, source, url AS source_url, title, sha256(text) AS content_hash,
               'source=' || source || '/date={NOW_DATE}/raw/' || doc_id || '.html' AS raw_object_key,
               'source=' || source || '/date={NOW_DATE}/text/' || doc_id || '.json' AS text_object_key,
               CAST(strlen(html) AS BIGINT) AS byte_size, CAST(length(text) AS BIGINT) AS char_count,
               CASE WHEN {NEEDS_RENDER} THEN 'browser' ELSE 'http' END AS fetch_method,
               'blocks' AS extractor
        FROM landed""",
    "bronze_inventory": f"""{LANDED}
        SELECT source, '{NOW_DATE}' AS date, count(*) AS n_objects,
               CAST(sum(strlen(html)) AS BIGINT) AS total_bytes FROM landed GROUP BY source""",
    "request_counts": "SELECT event_type, count(*) AS n_requests FROM events GROUP BY event_type",
    "request_histogram": f"""WITH wide AS (
        SELECT event_type, {buckets(config.RESULT_COUNT_BUCKETS)}, count(value) AS le_inf,
               round(sum(value), 4) AS value_sum FROM events GROUP BY event_type)
        """ + " UNION ALL ".join(
        [
            f"SELECT event_type, value_sum, '{b}' AS le, le_{i} AS n FROM wide"
            for i, b in enumerate(config.RESULT_COUNT_BUCKETS)
        ]
        + ["SELECT event_type, value_sum, '+Inf', le_inf FROM wide"]
    ),
    "windowed_metrics": DAILY,
    "streaming_metrics": DAILY,
    "version_as_of": f"""WITH {UPSERT}
        SELECT CAST(1 AS BIGINT) AS version, doc_id, content_hash, batch FROM target
        UNION ALL SELECT CAST(2 AS BIGINT), doc_id, content_hash, batch FROM merged""",
    "committed_table": f"""WITH {UPSERT}
        SELECT doc_id, source, content_hash, char_count,
               CASE WHEN doc_id IN (SELECT doc_id FROM target) THEN '2024-01-01' ELSE '{NOW_DATE}' END AS ingest_date
        FROM merged""",
    "silver_job": f"""{LANDED}
        SELECT doc_id, source, url AS source_url, title, sha256(text) AS content_hash,
               CAST(strlen(html) AS BIGINT) AS byte_size, CAST(length(text) AS BIGINT) AS char_count FROM landed""",
    "change_propagation": """WITH first AS (
          SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents WHERE text IS NOT NULL),
        last AS (
          SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id % 7 = 0 OR doc_id % 5 = 0 AS fresh,
                 CASE WHEN doc_id % 7 = 0 THEN substr(text, 1, 5) WHEN doc_id % 5 = 0 THEN text || ' [revised]'
                   ELSE text END AS text
          FROM documents WHERE text IS NOT NULL AND doc_id % 11 <> 0
          UNION ALL SELECT 'again-' || doc_id, TRUE, text FROM documents WHERE text IS NOT NULL AND doc_id % 13 = 0),
        cut AS (
          SELECT doc_id || '::' || CAST(i / 1300 AS BIGINT) AS chunk_id, fresh, substr(text, i + 1, 1500) AS piece
          FROM (SELECT *, unnest(range(0, CASE WHEN length(text) <= 1500 THEN 1 ELSE length(text) END, 1300)) AS i
                FROM last WHERE length(text) >= 500)),
        had AS (
          SELECT doc_id || '::' || CAST(i / 1300 AS BIGINT) AS chunk_id
          FROM (SELECT *, unnest(range(0, CASE WHEN length(text) <= 1500 THEN 1 ELSE length(text) END, 1300)) AS i
                FROM first WHERE length(text) >= 500))
        SELECT c.chunk_id, CAST(length(piece) AS BIGINT) AS char_count, md5(piece) AS text_md5,
               CASE WHEN h.chunk_id IS NULL THEN 1717243200 ELSE 1704067200 END AS v1_created,
               CASE WHEN c.fresh THEN 1717243200 ELSE 1704067200 END AS v1_updated,
               CASE WHEN h.chunk_id IS NOT NULL THEN 1704067200 END AS v2_created,
               CASE WHEN h.chunk_id IS NOT NULL THEN 1704067200 END AS v2_updated
        FROM cut c LEFT JOIN had h USING (chunk_id)""",
    "gold_job": f"""{GOLD}
        SELECT chunk_id, doc_id, substr(doc_id, 1, 2) AS doc_id_prefix, source, chunk_index,
               CAST(length(piece) AS BIGINT) AS char_count, start_char,
               start_char + length(piece) AS end_char, md5(piece) AS text_md5 FROM gold""",
    "embedding_job": f"""{GOLD}
        SELECT chunk_id, ver AS embedding_model_ver, CAST(length(piece) AS BIGINT) AS char_count,
               CAST(CASE WHEN ver = 'v1' THEN {BASE_TIME} ELSE {NOW_TIME} END AS BIGINT) AS created_epoch,
               CAST({NOW_TIME} AS BIGINT) AS updated_epoch
        FROM gold, (SELECT unnest(['v1', 'v2']) AS ver) v""",
    "version_list": f"""WITH {UPSERT}
        SELECT CAST(1 AS BIGINT) AS version, CAST({BASE_TIME} AS BIGINT) AS committed_epoch,
               'append' AS operation, count(*) AS n_rows, 'before-recrawl' AS tag FROM target
        UNION ALL SELECT CAST(2 AS BIGINT), CAST({NOW_TIME} AS BIGINT), 'overwrite', count(*), NULL
        FROM merged""",
    "rows_then_and_now": f"""WITH {UPSERT}
        SELECT CAST(1 AS BIGINT) AS oldest, CAST(2 AS BIGINT) AS newest,
               (SELECT count(*) FROM target) AS rows_then, (SELECT count(*) FROM merged) AS rows_now""",
    "schema_union": """SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, CAST(NULL AS VARCHAR) AS language
        FROM documents UNION ALL SELECT 'bench-' || item_id, 'benchmark', 'xx' FROM benchmark""",
}
