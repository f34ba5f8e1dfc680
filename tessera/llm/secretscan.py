"""Secrets in whole texts, told apart by who owns them.

Base patterns and wider generators propose candidates.  The hashes of their values are
counted over the corpus by distinct owners and repositories: a value that many owners
have is a widely copied example, one that few have and that looks random is taken for a
live credential.  Base spans are always reported; the generators' only if owner-specific.

The secret of a PEM block is its key, however its lines are broken; the whole block is the span.

Defined results: a null text is an empty one without spans; a null source is an owner of
its own; rows with a null or repeated id are scanned row by row; an empty table gives no
rows; other columns are not read (``redacted`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.spans import count_of, find, of_kind, ordered, written
from tessera.llm.textops import stored

#: The base patterns (with possessive repetition) and least lengths.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
#: Further generators: keys in PEM armour, web tokens, passwords in addresses, vendor prefixes.
#: A key is the block up to its END line, or, without one, the header fields and lines of base64 that follow
#: (line breaks may be written as ``\\n``; a last short line must stand alone).
PEM = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
    r"(?:(?:[^-]|-(?!----))*+-----END [A-Z ]{0,30}PRIVATE KEY-----"
    r"|(?:(?:\s|\\[nr])*+(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{16,}+={0,2}+)*+"
    r"(?:(?:\s|\\[nr])++[A-Za-z0-9+/]{1,15}+={0,2}+(?=[\r\n\\\"']|\z))?+)"
)
#: What a PEM block has besides its key: armour lines, header fields, blanks and written line breaks.
ARMOUR = r"-----[A-Z ]++-----|(?:Proc-Type|DEK-Info):[^\r\n\\]*+|\\[nr]|[^A-Za-z0-9+/=]"
JWT = r"eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"
URL = r"://[A-Za-z0-9._-]{1,64}+:[A-Za-z0-9._~!$&*+=-]{8,64}+@"
VENDOR = r"(?:ghp_|gho_|sk_live_|xox[bp]-|glpat-)[A-Za-z0-9_-]{16,}+"

BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("pem", "jwt", "url", "vendor")
#: A value held by more owners than this is a copied example.
OWNERS = 3


def base_spans(text: Column) -> Column:
    assign = find(text, ASSIGN, text.rlike("(?i)passw|secret|token|api_?key"), group=1)
    return ordered(
        of_kind(F.filter(assign, lambda s: F.length(s["part"]) >= 8), "assign", 0),
        of_kind(find(text, ACCESS, text.contains("AKIA")), "access", 1),
        of_kind(find(text, HEX, text.rlike("[0-9a-f]{32}")), "hex", 2),
    )


def added_spans(text: Column) -> Column:
    quick = {"pem": "PRIVATE KEY-----", "jwt": "eyJ", "url": "://", "vendor": None}
    patterns = {"pem": PEM, "jwt": JWT, "url": URL, "vendor": VENDOR}
    found = []
    for rank, kind in enumerate(ADDED_KINDS, len(BASE_KINDS)):
        likely = text.contains(quick[kind]) if quick[kind] else text.rlike("ghp_|gho_|sk_live_|xox[bp]-|glpat-")
        spans = of_kind(find(text, patterns[kind], likely), kind, rank)
        # armour without a key, as in a sentence about it, is no secret
        found.append(F.filter(spans, lambda s: F.length(identity_of(s)) > 0) if kind == "pem" else spans)
    return ordered(*found)


def secret_of(span: Column) -> Column:
    """The value itself: without the name it was assigned to, quotes and blanks."""
    return F.when(span["kind"] == "assign", F.regexp_extract(span["value"], r"([A-Za-z0-9+/_.=-]+)$", 1)).otherwise(span["value"])


def identity_of(span: Column) -> Column:
    """What makes two values one secret: of a PEM block its key, else the value."""
    return F.when(span["kind"] == "pem", F.regexp_replace(span["value"], ARMOUR, "")).otherwise(secret_of(span))


def looks_random(value: Column) -> Column:
    """Many different characters for its length, digits among them, no run of one character."""
    distinct = F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.least(F.length(value), F.lit(64))), lambda i: F.substring(value, i, F.lit(1)))))
    return (distinct >= F.least(F.lit(10), F.length(value) * 0.4)) & value.rlike("[0-9]") & ~value.rlike(r"(.)\1{5}")


def _rows(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """Spans of every row, stored with a number for the row."""
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col(owner).alias("owner"), F.col(repository).alias("repository"))
    found = rows.select("doc_id", "owner", "repository", base_spans(text).alias("base"), added_spans(text).alias("added"))
    return stored(found.withColumn("row", F.monotonically_increasing_id()), "secrets")


def judged(rows: DataFrame, owners: int = OWNERS) -> DataFrame:
    """Every candidate with its value's hash, distinct owners and repositories, and verdict.

    Values are reduced to distinct (hash, owner, repository) on the map side first, so a
    value in a third of all documents is a few rows per task.
    """
    span = F.explode(F.concat(F.transform("base", lambda s: _marked(s, True)), F.transform("added", lambda s: _marked(s, False))))
    each = rows.select("row", "owner", "repository", span.alias("span")).select(
        "row", "owner", "repository", "span.*", F.sha2(identity_of(F.col("span")), 256).alias("hash"), looks_random(secret_of(F.col("span"))).alias("random")
    )
    held = each.select("hash", "owner", "repository").distinct()
    spread = held.groupBy("hash").agg(
        F.count_distinct(F.coalesce("owner", F.lit(""))).alias("owners"),
        F.count_distinct(F.struct(F.coalesce("owner", F.lit("")), F.coalesce("repository", F.lit("")))).alias("repositories"),
    )
    verdict = F.when(F.col("owners") > owners, "example").when(F.col("random") | F.col("kind").isin("pem", "url"), "live").otherwise("weak")
    return each.join(spread, "hash").withColumn("verdict", verdict)


def _marked(span: Column, base: bool) -> Column:
    return F.struct(*[span[n].alias(n) for n in ("start", "rank", "end", "kind", "value")], F.lit(base).alias("is_base"))


def scan(docs: DataFrame, owner: str = "source", repository: str = "source") -> DataFrame:
    """doc_id, base and all spans with verdicts, one row per row of ``docs``.

    Texts are read once and not shuffled; only rows with candidates meet the counts.
    """
    rows = _rows(docs, owner, repository)
    some = (F.size("base") > 0) | (F.size("added") > 0)
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string,verdict:string,owners:bigint,repositories:bigint>>")
    none = rows.where(~some).select("doc_id", "base", empty.alias("spans"))
    span = F.struct("start", "rank", "end", "kind", "value", "verdict", "owners", "repositories")
    kept = judged(rows).where("is_base or verdict = 'live'")
    grouped = kept.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    full = rows.where(some).join(grouped, "row", "left").select("doc_id", "base", F.coalesce("spans", empty).alias("spans"))
    return none.unionByName(full)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans written out."""
    live = F.size(F.filter("spans", lambda s: s["verdict"] == "live")).cast("long")
    example = F.size(F.filter("spans", lambda s: s["verdict"] == "example")).cast("long")
    return scanned.select(
        "doc_id",
        *[count_of(F.col("base"), k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        live.alias("n_live"),
        example.alias("n_example"),
    )


def redacted(docs: DataFrame, owner: str = "source", repository: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with owner-specific credentials replaced in ``text``; all other columns and rows as they were.

    Values are replaced wherever they stand in the text, longest first; copied examples stay.
    """
    rows = _rows(docs, owner, repository)
    live = judged(rows).where("verdict = 'live'").select("row", secret_of(F.struct("kind", "value")).alias("secret"), "hash")
    named = rows.select("row", "doc_id", "owner", "repository").join(live, "row")
    values = (
        named.groupBy(F.col("doc_id").alias("of_doc"))
        .agg(F.collect_set("secret").alias("secrets"))
        .withColumn("secrets", F.array_sort("secrets", lambda a, b: F.length(b) - F.length(a)))
    )
    whole = docs.select(F.struct(*docs.columns).alias("doc"))
    joined = whole.join(values, F.col("doc.doc_id").eqNullSafe(F.col("of_doc")), "left")
    clean = F.aggregate(
        F.coalesce("secrets", F.array().cast("array<string>")), F.col("doc.text"), lambda text, s: F.replace(text, s, F.lit(mark))
    )
    new = F.col("doc").withField("text", clean)
    if "n_chars" in docs.columns:
        new = new.withField("n_chars", F.length(clean).cast(docs.schema["n_chars"].dataType))
    return joined.select(F.when(F.col("secrets").isNull(), F.col("doc")).otherwise(new).alias("doc")).select("doc.*")
