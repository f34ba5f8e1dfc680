"""Default parameters and fixed values shared by the operators.

Everything below is data: sizes, thresholds and word lists that decide the
results.  All of them can be overridden through function arguments.
"""

# --- fixed values: chunk geometry (characters) --------------------------------
GOLD_CHUNK_SIZE = 1500
GOLD_CHUNK_OVERLAP = 200
CORPUS_CHUNK_SIZE = 800
CORPUS_CHUNK_OVERLAP = 100
CORPUS_MIN_CHUNK = 50

# --- fixed values: length gates (characters) ----------------------------------
MIN_INGEST_CHARS = 200
MIN_CHUNK_DOC_CHARS = 500
RENDER_MIN_BYTES = 2048

# --- fixed values: retrieval --------------------------------------------------
RRF_K = 60
FETCH = 20
TOP_K = 5
BM25_K1 = 1.2
BM25_B = 0.75
MAX_CONTEXT_CHARS = 6000
STORE_HEAD_CHARS = 4000
EVAL_HEAD_CHARS = 500
RESPONSE_HEAD_CHARS = 300
CONSOLE_HEAD_CHARS = 220
PRECISION_THRESHOLD = 0.3
RECALL_THRESHOLD = 0.25
GROUNDED_SHARE = 0.3
TARGET_RECALL = 0.95

# --- fixed values: embedding --------------------------------------------------
EMBED_DIM = 256
EMBED_MODEL = "feature-hash"
EMBED_MODEL_VER = "feature-hash-v1"

# --- fixed values: crawl ------------------------------------------------------
MAX_PAGES_PER_SOURCE = 50

# --- fixed values: histogram buckets ------------------------------------------
RETRIEVAL_BUCKETS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0]
GENERATION_BUCKETS = [1.0, 5.0, 10.0, 30.0, 60.0, 120.0]
RESULT_COUNT_BUCKETS = [1.0, 2.0, 3.0, 5.0, 10.0, 20.0]

# --- fixed values: question routing -------------------------------------------
MULTI_HOP_WORDS = ["compare", "difference", "versus", "vs", "both", "relationship"]
AMBIGUOUS_WORDS = ["it", "this", "that", "they", "them"]
AMBIGUOUS_MAX_WORDS = 3
REWRITE_PREFIX = "explain in detail: "
REFUSAL_PHRASES = [
    "i don't have enough information",
    "not in the context",
    "cannot find",
    "no relevant",
]
MIN_ANSWER_CHARS = 30
NO_CONTEXT_ANSWER = "The search gave no passage to answer from. A wider question may find one."

# --- fixed values: English stop words for the AND-joined text query -----------
STOP_WORDS = [
    "a", "about", "an", "and", "are", "as", "at", "be", "by", "can", "do", "does",
    "for", "from", "has", "have", "how", "in", "is", "it", "its", "of", "on", "or",
    "that", "the", "their", "this", "to", "was", "were", "what", "when", "where",
    "which", "who", "why", "will", "with", "you", "your",
]

# --- fixed values: characters a text query may not carry ----------------------
QUERY_OPERATOR_CHARS = "&|!(){}[]*?,;:\"'\\"

# --- fixed values: Unicode white space (what a Unicode-aware strip removes) ---
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}"
    r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

# --- scores are compared to so many digits, then by id ---------------------------
RANK_DIGITS = 9

# --- queries and postings of a key, cells of a vector index and vectors of a part --
QUERY_BLOCK_ROWS = 2_000
POSTINGS_PER_KEY = 1 << 20
MATCHES_AT_ONCE = 1 << 27
BROADCAST_ROWS = 1 << 17
MAX_CELLS = 4_096
CELL_ROWS = 1 << 16

# --- stored tables: marks (of 64 rows each) that go to all tasks, partitions that a task may
# --- write without bringing rows together, bytes of files that are rewritten at once ------------
BROADCAST_MARKS = 1 << 20
FEW_PARTITIONS = 8
REWRITE_BYTES = 1 << 26
