"""Content-addressed identities, derived keys and object keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_url(url: Column) -> Column:
    """Lower-cased URL without trailing slashes; query and fragment stay."""
    return F.lower(F.rtrim(url, F.lit("/")))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def document_id(url: Column, text: Column) -> Column:
    """First 32 hex digits of the hash over canonical URL and text."""
    return F.substring(F.sha2(F.concat(canonical_url(url), F.lit("|"), text), 256), 1, 32)


def file_document_id(source: Column, file_name: Column) -> Column:
    return F.md5(F.concat(source, F.lit("::"), file_name))


def chunk_id(doc_id: Column, chunk_index: Column) -> Column:
    return F.concat(doc_id.cast("string"), F.lit("::"), chunk_index.cast("string"))


def id_prefix(doc_id: Column, n: int = 2) -> Column:
    return F.substring(doc_id.cast("string"), 1, n)


def object_key(source: Column, date: Column, kind: str, doc_id: Column, ext: str) -> Column:
    """``source=S/date=D/kind/ID.ext``."""
    return F.concat(
        F.lit("source="), source, F.lit("/date="), date, F.lit(f"/{kind}/"), doc_id, F.lit(f".{ext}")
    )


def date_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def byte_size(col: Column) -> Column:
    return F.octet_length(col).cast("bigint")


def char_count(col: Column) -> Column:
    return F.char_length(col).cast("bigint")
