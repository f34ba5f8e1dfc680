"""Vector arithmetic on ``array`` columns and the offline feature-hash embedding."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import config


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors of one row; 0 where a norm is 0."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def to_float32(vector: Column) -> Column:
    return vector.cast("array<float>")


def is_valid_vector(vector: Column, dim: int) -> Column:
    """Present, of the right dimension, without NULL or NaN entries."""
    good = (F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def require_dimension(vector: Column, dim: int) -> Column:
    """The vector itself; a wrong dimension fails the job."""
    message = F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(vector).cast("string"))
    return F.when(F.size(vector) == dim, vector).otherwise(
        F.raise_error(message).cast("array<float>")
    )


def _signed_codes(terms: list[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of each term: first 32 bits of its md5; the top bit is the sign."""
    h = np.array([int(md5(t.encode()).hexdigest()[:8], 16) for t in terms], dtype=np.int64)
    return h % dim, np.where(h < 2**31, 1.0, -1.0)


#: Terms of so many rows are counted at once.
TERMS_AT_ONCE = 1 << 20


def _term_counts(lists: pa.Array, dim: int) -> pa.Array:
    """The signed counts of each list's terms, as lists of ``dim`` floats."""
    n, flat = len(lists), lists.flatten().dictionary_encode()
    bucket, sign = _signed_codes(flat.dictionary.to_pylist(), dim)
    term = flat.indices.to_numpy(zero_copy_only=False)
    ends = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)]
    dense, a = np.zeros((n, dim), np.float32), 0
    while a < n:
        b = int(np.searchsorted(ends, ends[a] + TERMS_AT_ONCE, side="right")) - 1
        b = max(a + 1, min(a + TERMS_AT_ONCE // dim, b, n))
        counts = np.zeros((b - a) * dim)
        for at in range(int(ends[a]), int(ends[b]), TERMS_AT_ONCE):  # a long list in parts
            some = term[at : min(at + TERMS_AT_ONCE, int(ends[b]))]
            rows = np.searchsorted(ends[a + 1 : b + 1], np.arange(at, at + len(some)), side="right")
            counts += np.bincount(rows * dim + bucket[some], weights=sign[some], minlength=(b - a) * dim)
        dense[a:b] = counts.reshape(b - a, dim)
        a = b
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(dense.ravel()))


def hash_vector(terms: Column, dim: int = config.EMBED_DIM) -> Column:
    """Feature-hash embedding of a term list as ``array<float>``.

    Each distinct term of an Arrow batch is hashed once; NumPy counts the rest.
    """

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def count_terms(lists: pa.Array) -> pa.Array:
        return _term_counts(lists, dim)

    empty = F.expr("cast(array() as array<string>)")
    return count_terms(F.coalesce(terms, empty))
