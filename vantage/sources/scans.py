"""Scan results and their seen companions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.functions.times import epoch, seen_range


def read_values(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON values below sharded folders as VARIANT, null where unreadable.

    One value per file, or one per line (``lines=True``, the form to use for
    many results, since it splits).
    """
    reader = spark.read.option("recursiveFileLookup", True).option("singleVariantColumn", "value")
    if not lines:
        reader = reader.option("multiLine", True)
    return reader.json(path).select("value", F.col("_metadata.file_path").alias("file"))


def items(values: DataFrame) -> DataFrame:
    """One row per item: a value is one object or a list of objects."""
    value = F.col("value")
    as_list = F.try_variant_get(value, "$", "array<variant>")
    rest = [c for c in values.columns if c != "value"]
    return values.select(*rest, F.explode(F.coalesce(as_list, F.array(value))).alias("item"), value.isNull().alias("_bad"))


def split_bad(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects, and the rejected items with their `reason`."""
    is_object = F.coalesce(F.size(F.try_variant_get("item", "$", "map<string,variant>")) >= 0, F.lit(False))
    good = rows.filter(is_object).drop("_bad")
    reason = F.when(F.col("_bad"), "unreadable").otherwise("not_object")
    return good, rows.filter(~is_object).withColumn("reason", reason).drop("_bad")


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _hostname(h: Column) -> Column:
    plain = F.when(F.try_variant_get(h, "$", "map<string,variant>").isNull(), F.try_variant_get(h, "$", "string"))
    return F.named_struct(
        F.lit("name"), F.coalesce(_text(h, "$.name"), plain),
        F.lit("hostname"), _text(h, "$.hostname"),
        F.lit("type"), _text(h, "$.type"),
    )


def _port(p: Column) -> Column:
    return F.named_struct(
        F.lit("portid"), _text(p, "$.portid"), F.lit("protocol"), _text(p, "$.protocol"), F.lit("hsh256"), _text(p, "$.hsh256"),
        F.lit("service"), F.named_struct(
            F.lit("name"), _text(p, "$.service.name"), F.lit("product"), _text(p, "$.service.product"),
            F.lit("version"), _text(p, "$.service.version"),
        ),
        F.lit("scripts"), F.try_variant_get(p, "$.scripts", "array<variant>"),
    )


def scans(good: DataFrame) -> DataFrame:
    """Objects to typed scans.  Every field is read on its own, so one odd value
    never loses a scan; ports that are no objects are dropped."""
    item = F.col("item")
    ports = F.filter(
        F.try_variant_get(item, "$.ports", "array<variant>"),
        lambda p: F.try_variant_get(p, "$", "map<string,variant>").isNotNull(),
    )
    return good.select(
        _text(item, "$.addr").alias("addr"),
        F.transform(F.try_variant_get(item, "$.hostnames", "array<variant>"), _hostname).alias("hostnames"),
        _text(item, "$.starttime").alias("starttime"), _text(item, "$.endtime").alias("endtime"),
        F.transform(ports, _port).alias("ports"),
    )


def read_scans(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Typed scans of a folder; bad items are dropped (see `split_bad`)."""
    return scans(split_bad(items(read_values(spark, path, lines)))[0])


def read_seen_companions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Seen intervals stored next to documents: (id, first_seen, last_seen, usable).

    The id is the stem of a ``.time`` file, or the `id` field of a line.
    """
    reader = spark.read.option("recursiveFileLookup", True).schema("id string, first_seen string, last_seen string")
    if not lines:
        reader = reader.option("multiLine", True).option("pathGlobFilter", "*.time")
    rows = reader.json(path).select("*", F.col("_metadata.file_name").alias("_file"))
    first, last = seen_range(epoch("first_seen"), epoch("last_seen"))
    stem = F.nullif(F.regexp_extract("_file", r"^(.*)\.time$", 1), F.lit(""))
    return rows.select(
        F.coalesce("id", stem).alias("id"), first.alias("first_seen"), last.alias("last_seen"), first.isNotNull().alias("usable")
    )


def companion_counts(docs: DataFrame, companions: DataFrame) -> DataFrame:
    """Documents by companion status: usable, invalid, missing."""
    known = companions.groupBy("id").agg(F.bool_or("usable").alias("_u"))
    status = F.when(F.col("_u").isNull(), "missing").when(F.col("_u"), "usable").otherwise("invalid")
    return docs.select("id").join(known, "id", "left").groupBy(status.alias("status")).agg(F.count("id").alias("count"))
