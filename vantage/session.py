"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CHECKPOINT_CONF = "spark.checkpoint.dir"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a table written over another leaves no partition of the old one behind
    "spark.sql.sources.partitionOverwriteMode": "static",
}

# Where the session has no own: what a task reads of a shuffle.  Addresses and names compress well, so sorts and hash tables of the
# usual 64 MB of them take a gigabyte.
DEFAULTS = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}

# Start-up settings worth giving to the session builder.
STARTUP = {
    # call-site capture costs one JVM round trip per expression node
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the library relies on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def bound_reads(spark: SparkSession) -> SparkSession:
    """Apply `DEFAULTS` where the session has no value of its own; the catalog's queries call it."""
    for key, value in DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def use_local_folder(spark: SparkSession) -> SparkSession:
    """Give a session on this machine alone a folder for written tables if it has none; registered queries call it."""
    master = spark.sparkContext.master
    if not spark.conf.get(CHECKPOINT_CONF, None) and (master == "local" or master.startswith("local[")):
        spark.conf.set(CHECKPOINT_CONF, tempfile.mkdtemp(prefix="vantage-"))
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared folder, ``spark.checkpoint.dir``."""
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Used where a result feeds several jobs: the lineage ends at a durable table
    that survives lost executors.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Small driver-side rows as a local relation.

    Going through Arrow keeps the rows in the plan: their size is known to the
    optimizer and no Python worker is started to read them.
    """
    fields = StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)
    columns = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), fields)
