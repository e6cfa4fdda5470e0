"""Exports and imports of stored documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.functions.text import clean
from vantage.functions.times import epoch


def write_docs(docs: DataFrame, path: str) -> None:
    """One JSON object per document, foldered by the first character of the id."""
    text = F.to_json(F.struct(*[c for c in docs.columns]))
    docs.select(text.alias("value"), F.substring("id", 1, 1).alias("shard")).write.mode("overwrite").partitionBy(
        "shard"
    ).text(path)


def write_seen_companions(docs: DataFrame, path: str) -> None:
    """Seen intervals next to the documents, keyed by id."""
    docs.select("id", "first_seen", "last_seen", F.substring("id", 1, 1).alias("shard")).write.mode(
        "overwrite"
    ).partitionBy("shard").json(path)


def export_first_seen(docs: DataFrame, path: str) -> None:
    """csv ``uid,ip,first_seen,last_seen`` of documents with a first_seen."""
    docs.filter(F.col("first_seen").isNotNull()).select("uid", "ip", "first_seen", "last_seen").write.mode(
        "overwrite"
    ).csv(path, header=True)


def import_first_seen(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set first_seen of existing documents; last_seen is untouched.

    Returns the documents and the row counts per status (updated, missing,
    invalid).  Evaluating only the counts is the dry run.  If a uid is listed
    more than once its last valid row by `ord` wins (see `lists.read_first_seen`;
    rows without that column are taken in the order in which they are read), of
    rows in one place the latest time.
    """
    place = F.col("ord") if "ord" in rows.columns else F.monotonically_increasing_id()
    parsed = rows.select(
        clean(F.coalesce("uid", F.lit(""))).alias("uid"),
        epoch("first_seen").alias("_f"),
        place.alias("_n"),
    )
    valid = (F.col("uid") != "") & F.col("_f").isNotNull()
    known = docs.select("uid").distinct().withColumn("_known", F.lit(True))
    status = (
        F.when(~valid, "invalid").when(F.col("_known").isNull(), "missing").otherwise("updated")
    )
    # invalid rows share the blank uid, so they are counted without the join
    checked = parsed.filter(valid).join(known, "uid", "left").select(status.alias("status"))
    counts = (
        checked.unionByName(parsed.filter(~valid).select(F.lit("invalid").alias("status")))
        .groupBy("status").agg(F.count("status").alias("count"))
    )
    fresh = parsed.filter(valid).groupBy("uid").agg(F.max(F.struct("_n", "_f"))["_f"].alias("_f"))
    updated = docs.join(fresh, "uid", "left").select(
        *[F.coalesce("_f", "first_seen").alias(c) if c == "first_seen" else F.col(c) for c in docs.columns]
    )
    return updated, counts


def full_export(hits: DataFrame, bodies: DataFrame) -> DataFrame:
    """Hit documents with interval and body; a missing body leaves a warning.

    One row per document, ordered by address: the documents of an address are
    consecutive lines, so an address of any size is never held in one task.
    """
    stored = bodies.select(F.col("id").alias("uid"), F.col("body").alias("document"), F.lit(True).alias("_found"))
    return (
        hits.select("ip", "uid", "first_seen", "last_seen").join(stored, "uid", "left")
        .select(
            "ip", "uid", "first_seen", "last_seen", "document",
            F.when(F.col("_found").isNull(), "document_not_found").alias("warning"),
        )
    )


def export_full(hits: DataFrame, bodies: DataFrame, path: str) -> None:
    full_export(hits, bodies).orderBy("ip", "uid").write.mode("overwrite").json(path)


def export_ips(hits: DataFrame, path: str) -> None:
    """Distinct matching addresses, text-sorted, one per line."""
    hits.select("ip").distinct().orderBy("ip").write.mode("overwrite").text(path)


def export_rules(rules: DataFrame, path: str, version: str) -> None:
    """Every rule as text below a folder named after its file, one version stamp.

    Files are put in place by the tasks that wrote them, not one after the other by the driver; the success mark says
    that all are there.
    """
    def quoted(column) -> Column:  # a JSON string is a YAML double-quoted scalar
        whole = F.to_json(F.struct(column.alias("v")))
        return F.regexp_replace(whole, r'^\{"v":|\}$', "")

    tags = F.array_join(F.transform("tags", lambda t: F.concat(F.lit("- "), quoted(t))), "\n")
    text = F.concat(
        F.lit("description: "), quoted(F.col("description")), F.lit("\nquery: "), quoted(F.col("query")),
        F.lit("\ntags:\n"), tags, F.lit(f"\nversion: {version}"),
    )
    file = F.concat(F.lower(F.replace("name", F.lit(" "), F.lit("_"))), F.lit(".yaml"))
    rows = rules.select(file.alias("file"), text.alias("value"))
    rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").mode("overwrite").partitionBy("file").text(path)
