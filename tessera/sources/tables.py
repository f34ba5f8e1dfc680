"""Parquet tables of a folder, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def table_glob(folder: str, name: str) -> str:
    """A pattern for a table's path that streams take, be it one file or a folder of files."""
    return f"{folder.rstrip('/')}/{name}.parque[t]"


#: Session setting of machines whose tables are single files with one row group.
SPREAD = "spark.tessera.spreadScans"


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan out to all cores, if the session is set to do so.

    All rows of a row group go to one task, so a table in one small file keeps a single
    core busy.  That is a matter of how tables are laid out where a session runs, not of
    this table's size: the setting holds for all of them, and is off by default.
    """
    spark = df.sparkSession
    if spark.conf.get(SPREAD, "false") != "true":
        return df
    return df.repartition(2 * spark.sparkContext.defaultParallelism)


def wide_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of long texts, spread over the cores."""
    return spread(table(spark, folder, name))
