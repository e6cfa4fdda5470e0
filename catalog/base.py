"""Registry of queries and oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vantage.session import bound_reads, configure, use_local_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under `name` with optional reference SQL."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(use_local_folder(bound_reads(configure(spark))), sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS_PER_TASK = 65_536


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Deal the rows of a table over tasks of a bounded number of rows, one per core at least, by the hash of `by` or of whole rows.

    How a file can be split depends on how it was written: a small one, or one of few row groups, is read by few tasks
    however many rows follow from it.  What is dealt are the table's own, narrow rows; a scan's count reads footers only.
    """
    if df.isStreaming:
        return df
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK))
    return df.repartition(tasks, *(by or df.columns))
