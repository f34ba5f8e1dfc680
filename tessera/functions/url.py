"""Link resolution and admission rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
ORIGIN = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"


def host(url: Column) -> Column:
    return F.regexp_extract(url, HOST, 1)


def origin(url: Column) -> Column:
    return F.regexp_extract(url, ORIGIN, 1)


def drop_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*$", "")


def is_followable(href: Column) -> Column:
    """Neither empty nor a mail or script pseudo-link."""
    return (href != "") & ~href.startswith("mailto:") & ~href.startswith("javascript:")


def _collapse_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(F.substring(path, F.lit(2), F.length(path)), "/")
    kept = F.aggregate(
        segments,
        F.expr("cast(array() as array<string>)"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(F.regexp_like(path, F.lit(r"/\.{1,2}$")), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    resolved = F.when(joined.endswith("/"), joined).otherwise(F.concat(joined, tail))
    return F.when(F.regexp_like(path, F.lit(r"/\.{1,2}(/|$)")), resolved).otherwise(path)


def resolve_link(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` seen on page ``base``, without its fragment."""
    page = F.regexp_replace(base, r"(?s)[?#].*$", "")
    root = origin(base)
    page_path = F.substring(page, F.length(root) + 1, F.length(page))
    folder = F.when(page_path == "", F.lit("/")).otherwise(F.regexp_replace(page_path, r"[^/]*$", ""))
    ref = drop_fragment(href)
    ref_path = F.regexp_replace(ref, r"(?s)\?.*$", "")
    ref_query = F.regexp_extract(ref, r"(?s)(\?.*)$", 1)
    return (
        F.when(ref == "", drop_fragment(base))
        .when(F.regexp_like(ref, F.lit(SCHEME)), ref)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, SCHEME, 0), ref))
        .when(ref.startswith("/"), F.concat(root, _collapse_dots(ref_path), ref_query))
        .when(ref.startswith("?"), F.concat(page, ref))
        .otherwise(F.concat(root, _collapse_dots(F.concat(folder, ref_path)), ref_query))
    )


def is_admitted(url: Column, allow_prefixes: Column, deny_substrings: Column) -> Column:
    """Starts with any allowed prefix and contains no denied substring."""
    return F.exists(allow_prefixes, lambda p: F.startswith(url, p)) & ~F.exists(
        deny_substrings, lambda d: F.contains(url, d)
    )
