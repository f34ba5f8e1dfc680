"""Table history as a change table: versions, reading as of a version, schema change.

``history`` holds every state of a row with ``valid_from`` and ``valid_to`` version
numbers; ``versions`` one row per recorded version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


HISTORY_COLUMNS = ("valid_from", "valid_to")


def start_history(table: DataFrame, version: int) -> DataFrame:
    return table.withColumn("valid_from", F.lit(version)).withColumn(
        "valid_to", F.lit(None).cast("int")
    )


def record_changes(
    history: DataFrame,
    changed: DataFrame,
    keys: Sequence[str],
    version: int,
) -> DataFrame:
    """Add a version from the rows an upsert wrote.

    Open rows of those keys are closed, the new states opened; every other row
    passes through.
    """
    keys = list(keys)
    columns = [c for c in history.columns if c not in HISTORY_COLUMNS]
    touched = changed.select(*keys).distinct()
    marked = history.join(touched.withColumn("_touched", F.lit(True)), keys, "left")
    closing = F.col("valid_to").isNull() & F.col("_touched").isNotNull()
    closed = marked.withColumn(
        "valid_to", F.when(closing, F.lit(version)).otherwise(F.col("valid_to"))
    ).select(*columns, *HISTORY_COLUMNS)
    return closed.unionByName(start_history(changed.select(*columns), version))


def record_version(
    history: DataFrame, table: DataFrame, keys: Sequence[str], version: int
) -> DataFrame:
    """Add the whole state ``table`` as ``version``: close changed or gone rows, open new ones.

    Use :func:`record_changes` where the changed rows are known; this one compares
    both states in full.

    A column the history does not know yet is added; its old rows read NULL.
    """
    keys = list(keys)
    known = [c for c in history.columns if c not in HISTORY_COLUMNS]
    added = [c for c in table.columns if c not in known]
    for c in added:
        history = history.withColumn(c, F.lit(None).cast(table.schema[c].dataType))
    columns = known + added
    order = columns + list(HISTORY_COLUMNS)
    closed = history.where(F.col("valid_to").isNotNull()).select(*order)
    open_rows = history.where(F.col("valid_to").isNull()).select(*order)
    now_rows = table.select(*columns)
    # One join on the key decides the fate of both sides.
    old_side = open_rows.select(*keys, F.struct(*columns, "valid_from").alias("old"))
    new_side = now_rows.select(*keys, F.struct(*columns).alias("new"))
    matched = old_side.join(new_side, keys, "full_outer").select("old", "new")
    both = F.col("old").isNotNull() & F.col("new").isNotNull()
    for c in columns:
        both = both & F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    matched = matched.withColumn("same", both)

    def state(side: str, valid_from: Column, valid_to: Column) -> Column:
        fields = [F.col(f"{side}.{c}").alias(c) for c in columns]
        return F.struct(
            *fields, valid_from.cast("int").alias("valid_from"), valid_to.cast("int").alias("valid_to")
        )

    old_state = F.when(
        F.col("old").isNotNull(),
        state(
            "old",
            F.col("old.valid_from"),
            F.when(F.col("same"), F.lit(None).cast("int")).otherwise(F.lit(version)),
        ),
    )
    new_state = F.when(
        F.col("new").isNotNull() & ~F.col("same"), state("new", F.lit(version), F.lit(None))
    )
    states = matched.select(F.explode(F.array_compact(F.array(old_state, new_state))).alias("s"))
    return closed.unionByName(states.select("s.*").select(*order))


def as_of(history: DataFrame, version: int | Column) -> DataFrame:
    """The rows valid at ``version``."""
    version = F.lit(version) if isinstance(version, int) else version
    rows = history.where(
        (F.col("valid_from") <= version)
        & (F.col("valid_to").isNull() | (F.col("valid_to") > version))
    )
    return rows.drop(*HISTORY_COLUMNS)


def version_entry(
    table: DataFrame, version: int, committed_at: Column, operation: str, tag: str | None = None
) -> DataFrame:
    """The ``versions`` row of a state, with its row count and an optional tag."""
    return table.agg(F.count("*").alias("n_rows")).select(
        F.lit(version).alias("version"),
        committed_at.alias("committed_at"),
        F.lit(operation).alias("operation"),
        "n_rows",
        F.lit(tag).cast("string").alias("tag"),
    )


def recent_versions(versions: DataFrame, n: int = 5) -> DataFrame:
    return versions.orderBy(F.col("committed_at").desc(), F.col("version").desc()).limit(n)


def oldest_and_newest(versions: DataFrame) -> DataFrame:
    """``(oldest, newest, rows_then, rows_now)`` in one row."""
    key = F.struct("committed_at", "version")
    return versions.agg(
        F.min_by("version", key).alias("oldest"),
        F.max_by("version", key).alias("newest"),
        F.min_by("n_rows", key).alias("rows_then"),
        F.max_by("n_rows", key).alias("rows_now"),
    )


def version_by_tag(versions: DataFrame, tag: str) -> DataFrame:
    """The version a tag names, for reading as of it or rolling back to it."""
    return versions.where(F.col("tag") == tag).select("version")


def union_versions(*tables: DataFrame) -> DataFrame:
    """Union across schema versions; a missing column reads NULL."""
    union = tables[0]
    for table in tables[1:]:
        union = union.unionByName(table, allowMissingColumns=True)
    return union


def add_columns(df: DataFrame, **types: str) -> DataFrame:
    """Add columns without touching stored rows; they read NULL."""
    for name, kind in types.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df
