"""Helpers the operators share: row keys, words, exact numbering."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word after lower-casing A-Z: digits, a-z and everything beyond ASCII (fixed value).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other letter as it is; `lower` is the cheap way where the text is ASCII only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.regexp_extract_all(F.coalesce(ascii_lower(text), F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def text_key(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, as 32 bytes; null for null."""
    return F.unhex(F.sha2(text, 256))


def fold(id_value: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_value.cast("string"), F.lit(""))) % modulus


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, salts: int = 1024) -> DataFrame:
    """Exact gapless numbers from 0 within `keys`, without a task per key.

    Rows are dealt to `salts` parts by the hash of `order`; parts are counted (combined before the shuffle), their
    offsets summed over at most `salts` rows a key, and rows numbered inside a part.  Rows equal in `order` may swap.
    """
    part = f"{name}_part"
    rows = df.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    by = [*keys, part]
    offsets = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).select(
        *[F.col(k).alias(f"{name}_{i}") for i, k in enumerate(by)],
        (F.sum("n").over(Window.partitionBy(*keys).orderBy(part)) - F.col("n")).alias(f"{name}_offset"),
    )
    inside = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    match = [F.col(k).eqNullSafe(F.col(f"{name}_{i}")) for i, k in enumerate(by)]
    joined = rows.withColumn(f"{name}_row", inside).join(offsets, match)
    return joined.withColumn(name, F.col(f"{name}_offset") + F.col(f"{name}_row")).select(*df.columns, name)


def small_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches of a few megabytes, so that a Python worker's memory does not depend on the lengths of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return spark
