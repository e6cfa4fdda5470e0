"""Document store maintenance: postings, upserts, replacements, counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.functions.text import HEADER_NAME_MAX, HEADER_NAME_RE, clean, clean_list, normalize_tags
from vantage.functions.times import seen_range
from vantage.schema import FIELDS

def _empty() -> Column:
    return F.expr("CAST(array() AS ARRAY<STRING>)")


# --------------------------------------------------------------------------
# postings


def build_postings(docs: DataFrame, fields: tuple[str, ...] = FIELDS, unique_uid: bool = True) -> DataFrame:
    """Long table ``(field, value, uid)``, one row per field value of a document.

    One pass over the documents.  Repeated values are removed inside the row, so
    a table with unique uids needs no shuffle.
    """
    entries = F.concat(*[_entries(name) for name in fields])
    rows = docs.select("uid", F.explode(entries).alias("e")).select("e.field", "e.value", "uid")
    return rows if unique_uid else rows.distinct()


def _entries(name: str) -> Column:
    return F.transform(clean_list(name), lambda v: F.named_struct(F.lit("field"), F.lit(name), F.lit("value"), v))


def write_postings(postings: DataFrame, path: str) -> None:
    postings.write.mode("overwrite").partitionBy("field").parquet(path)


def field_values(postings: DataFrame, field: str, prefix: str = "", limit: int = 100) -> DataFrame:
    """Distinct values of one field with a prefix, in order, at most `limit`."""
    prefix = prefix.strip().lower()
    return (
        postings.filter((F.col("field") == field.strip().lower()) & F.col("value").startswith(prefix))
        .select("value").distinct().orderBy("value").limit(limit)
    )


def dump_field(postings: DataFrame, target: str) -> DataFrame:
    """``count, value`` of one field, most frequent first.

    ``http_headval:<name>`` restricts to one header and drops the name from the
    value.
    """
    target = target.strip().lower()
    field, colon, header = target.partition(":")
    if field not in FIELDS or (colon and field != "http_headval"):
        raise ValueError(f"unknown field {target}")
    rows = postings.filter(F.col("field") == field)
    if colon:
        header = header.strip()
        if not header or len(header) > HEADER_NAME_MAX or not re.fullmatch(HEADER_NAME_RE, header):
            raise ValueError("not a header name")
        prefix = header + ":"
        rows = rows.filter(F.col("value").startswith(prefix)).withColumn(
            "value", F.substring("value", len(prefix) + 1, 1 << 30)
        )
    return (
        rows.filter(F.col("value") != "").groupBy("value").agg(F.countDistinct("uid").alias("count"))
        .select("count", "value").orderBy(F.desc("count"), "value")
    )


# --------------------------------------------------------------------------
# seen intervals


def merge_seen(old: DataFrame, new: DataFrame) -> DataFrame:
    """Earliest first_seen and latest last_seen per uid of both sides.

    Each side is ordered first; nulls are ignored.  Partial aggregation runs
    before the shuffle, so a uid repeated many times costs one row per task.
    """

    def tidy(df: DataFrame) -> DataFrame:
        first, last = seen_range(F.col("first_seen"), F.col("last_seen"))
        return df.select("uid", first.alias("first_seen"), last.alias("last_seen"))

    return (
        tidy(old).unionByName(tidy(new)).groupBy("uid")
        .agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    )


def latest_per_uid(docs: DataFrame, first_by: list[str] | None = None) -> DataFrame:
    """Collapse repeated uids: values of the newest row, merged interval.

    `first_by` columns decide which row is newest before the times do; rows alike in all of these by their values, so the
    result does not depend on the order of rows.  Whole documents are sorted by uid only after they are dealt by it: a
    stored file holds many times more of them than a task should sort.
    """
    rest = [c for c in docs.columns if c not in ("uid", "first_seen", "last_seen")]
    newest = F.max_by(F.struct(*rest), F.struct(*(first_by or []), "last_seen", "first_seen", F.xxhash64(*rest)))
    first, last = seen_range(F.col("first_seen"), F.col("last_seen"))
    return (
        docs.repartition("uid").groupBy("uid")
        .agg(
            newest.alias("_d"),
            F.min(first).alias("first_seen"),
            F.max(last).alias("last_seen"),
        )
        .select("uid", "first_seen", "last_seen", *[F.col(f"_d.{c}").alias(c) for c in rest])
        .select(*docs.columns)
    )


def upsert_docs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace documents by uid.

    A known uid takes all field values of the new side and keeps the merged seen interval, whatever the times say; a uid
    repeated on a side counts with its newest row.
    """
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)).select(*old.columns, "_side"))
    return latest_per_uid(both, ["_side"]).select(*old.columns)


def rebuild(docs: DataFrame, snapshot: DataFrame, retag: bool = True) -> DataFrame:
    """Freshly computed documents with the history of a snapshot.

    The earliest first_seen and latest last_seen of both are kept; with
    ``retag=False`` so are the stored tags.
    """
    stored = snapshot.select("uid", "first_seen", "last_seen", (F.col("tag") if "tag" in snapshot.columns else _empty()).alias("_t"))
    stored = stored.groupBy("uid").agg(
        F.min("first_seen").alias("_f"), F.max("last_seen").alias("_l"),
        F.max(F.struct("last_seen", "_t"))["_t"].alias("_t"), F.lit(True).alias("_known"),
    )
    joined = docs.join(stored, "uid", "left")
    return joined.select(
        *[c for c in docs.columns if c not in ("first_seen", "last_seen", "tag")],
        F.least("first_seen", "last_seen", "_f").alias("first_seen"),
        F.greatest("first_seen", "last_seen", "_l").alias("last_seen"),
        (F.col("tag") if retag else F.when(F.col("_known"), F.col("_t")).otherwise(F.col("tag"))).alias("tag"),
    ).select(*docs.columns)


# --------------------------------------------------------------------------
# field replacement and tags


def _last_updates(updates: DataFrame, field: str, order_col: str | None) -> DataFrame:
    """One row (uid, _v) for each uid that is not blank: the update of the highest `order_col`.

    Equal or missing orders are decided by the values, so a repeated uid never doubles a document.
    """
    order = F.col(order_col) if order_col else F.lit(0)
    rows = updates.select(clean("uid").alias("uid"), clean_list(field).alias("_v"), order.alias("_o")).filter("uid <> ''")
    return rows.groupBy("uid").agg(F.max(F.struct("_o", "_v")).alias("_m")).select("uid", F.col("_m._v").alias("_v"))


def replace_field(docs: DataFrame, field: str, updates: DataFrame, order_col: str | None = None) -> DataFrame:
    """Replace the values of one field for the uids in `updates`.

    Values are trimmed, lower-cased and made distinct; blank uids are skipped;
    of several updates of a uid the one of the highest `order_col` counts;
    other fields stay untouched.
    """
    fresh = _last_updates(updates, field, order_col)
    return docs.join(fresh, "uid", "left").select(
        *[F.coalesce("_v", field).alias(c) if c == field else F.col(c) for c in docs.columns]
    )


def replace_postings(postings: DataFrame, field: str, updates: DataFrame, order_col: str | None = None) -> DataFrame:
    """Postings after `replace_field`: old rows of the field out, new rows in."""
    fresh = _last_updates(updates, field, order_col)
    mine = postings.filter(F.col("field") == field).join(fresh.select("uid"), "uid", "left_anti")
    added = fresh.select(F.lit(field).alias("field"), F.explode("_v").alias("value"), "uid")
    return (
        postings.filter(F.col("field") != field)
        .unionByName(mine.select(*postings.columns))
        .unionByName(added.select(*postings.columns))
    )


def _tag_argument(tag: str) -> str:
    tag = re.sub(r"^tag:\s*", "", tag.strip().lower())
    if not tag:
        raise ValueError("tag name is required")
    return tag


def drop_tag(docs: DataFrame, tag: str) -> DataFrame:
    """Remove one tag from every document."""
    return docs.withColumn("tag", F.array_remove("tag", _tag_argument(tag)))


def drop_tag_counts(docs: DataFrame, tag: str) -> DataFrame:
    """One row: documents carrying the tag, and those left without any tag."""
    tag = _tag_argument(tag)
    has = F.array_contains("tag", tag)
    return docs.agg(
        F.count_if(has).alias("affected"),
        F.count_if(has & (F.size(F.array_remove("tag", tag)) == 0)).alias("emptied"),
    )


def clear_tags(docs: DataFrame) -> DataFrame:
    return docs.withColumn("tag", _empty())


def list_tags(docs: DataFrame) -> DataFrame:
    """Distinct stored tags in order; the total is the row count."""
    return docs.select(F.explode(normalize_tags("tag")).alias("tag")).distinct().orderBy("tag")


# --------------------------------------------------------------------------
# latest record


def upsert_latest(old: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """Insert or update by key, the record with the newest stamp wins; equal stamps are decided by the values."""
    rest = [c for c in old.columns if c != key]
    return (
        old.unionByName(new).groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.struct(F.col(stamp).alias("at"), F.xxhash64(*rest))).alias("_r"))
        .select(key, "_r.*").select(*old.columns)
    )
