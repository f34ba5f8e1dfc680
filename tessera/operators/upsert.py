"""Upserts on immutable tables, skip-if-landed and pruning.

One join of the batch with the narrow key columns of the target decides the fate of
every batch row; the kept part of the target is an anti join against the keys that are
written.  Nothing is counted while a plan is built: adaptive execution sees how small
the sides are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` unchanged; fails the job if two rows share a key without NULLs.

    Rows are counted within their key, in the partitioning that a join on the keys
    uses anyway.
    """
    named = F.lit(True)
    for k in keys:
        named = named & F.col(k).isNotNull()
    shown = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    message = F.concat(F.lit("duplicate source key: "), shown)
    marked = df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    unique = F.when(named & (F.col("_n") > 1), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return marked.where(unique).select(*df.columns)


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    hash_col: str | None = None,
    check_duplicates: bool = True,
) -> DataFrame:
    """Target after the batch ``source``; columns as in ``target``.

    Without ``hash_col`` a matched row is always replaced.  With it, only where
    the hashes differ; a NULL hash on either side changes nothing.  Unmatched
    source rows are inserted.  Rows with a NULL key never match.
    """
    keys = list(keys)
    source = source.select(*target.columns)
    if check_duplicates:
        source = assert_unique(source, keys)
    changed = rows_to_write(target, source, keys, hash_col)
    return target.join(changed.select(*keys), keys, "left_anti").unionByName(changed)


def rows_to_write(
    target: DataFrame, source: DataFrame, keys: Sequence[str], hash_col: str | None = None
) -> DataFrame:
    """The rows an upsert writes: new ones and, with a hash, changed ones."""
    if hash_col is None:
        return source
    keys = list(keys)
    known = target.select(*keys, F.col(hash_col).alias("_known"), F.lit(True).alias("_matched"))
    is_new = F.col("_matched").isNull()
    differs = F.coalesce(F.col(hash_col) != F.col("_known"), F.lit(False))
    return source.join(known, keys, "left").where(is_new | differs).select(*source.columns)


def upsert_with_audit(
    target: DataFrame, source: DataFrame, keys: Sequence[str], now: Column
) -> DataFrame:
    """Unconditional upsert that keeps ``created_at`` and sets ``updated_at``.

    ``source`` has the target's columns without the two audit columns.
    """
    keys = list(keys)
    payload = [c for c in target.columns if c not in ("created_at", "updated_at")]
    source = assert_unique(source.select(*payload), keys)
    first_seen = target.select(*keys, F.col("created_at").alias("_created"))
    stamped = (
        source.join(first_seen, keys, "left")
        .withColumn("created_at", F.coalesce("_created", now))
        .withColumn("updated_at", now)
        .select(*target.columns)
    )
    return target.join(source.select(*keys), keys, "left_anti").unionByName(stamped)


def skip_landed(
    incoming: DataFrame, landed: DataFrame, keys: Sequence[str] = ("source", "doc_id")
) -> DataFrame:
    """Incoming rows whose key was never landed, under whatever date."""
    keys = list(keys)
    return incoming.join(landed.select(*keys), keys, "left_anti")


def prune_orphans(
    table: DataFrame, current: DataFrame, keys: Sequence[str], scope: str, remade: DataFrame | None = None
) -> DataFrame:
    """Drop rows of re-made groups (``scope`` column) whose key no longer exists.

    ``remade`` names the groups, by default those that ``current`` has rows of; a group
    that is left without rows has to be named.  Groups that were not re-made stay.
    """

    def flagged(rows: DataFrame, columns: Sequence[str], flag: str) -> DataFrame:
        return rows.select(*columns).distinct().withColumn(flag, F.lit(True))

    groups = current if remade is None else remade
    return (
        table.join(flagged(groups, [scope], "_remade"), scope, "left")
        .join(flagged(current, keys, "_alive"), list(keys), "left")
        .where(F.col("_remade").isNull() | F.col("_alive").isNotNull())
        .select(*table.columns)
    )


def change_set(before: DataFrame, after: DataFrame, key: str, hash_col: str) -> DataFrame:
    """``(key, change)`` of every key whose content differs: ``new``, ``changed`` or ``gone``.

    One full join of two narrow frames with unique keys.  A hash that is absent before
    counts as changed; rows without a key have no changes.
    """
    old = before.where(F.col(key).isNotNull()).select(key, F.col(hash_col).alias("_old"), F.lit(True).alias("_before"))
    new = after.where(F.col(key).isNotNull()).select(key, F.col(hash_col).alias("_new"), F.lit(True).alias("_after"))
    change = (
        F.when(F.col("_before").isNull(), "new")
        .when(F.col("_after").isNull(), "gone")
        .when(F.col("_old").isNull() | ~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    )
    return old.join(new, key, "full").select(key, change.alias("change")).where("change is not null")
