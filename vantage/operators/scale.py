"""Helpers that keep ordered and small-table work distributed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vantage.session import materialize

BROADCAST_ROWS = 200_000  # known row count up to which a configuration table is broadcast
CELL_ENTRIES = 1 << 22  # list entries that the rows of a key get in one part of it
TASK_ENTRIES = 1 << 24  # list entries that the rows of one task get, at about most


def _literal(value, data_type) -> Column:
    if isinstance(data_type, StructType):
        parts = [_literal(v, f.dataType).alias(f.name) for v, f in zip(value, data_type.fields)]
        return F.struct(*parts)
    return F.lit(value).cast(data_type)


def order_bucket(df: DataFrame, order: list[Column], buckets: int | None = None) -> DataFrame:
    """Add `_bucket`, an order-preserving partition number.

    Split points come from a bounded, hash-ordered sample of the keys, so they
    are the same whenever the plan is evaluated again.  They only balance the
    work; every row keeps its exact place in the order.
    """
    spark = df.sparkSession
    buckets = buckets or max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    key = F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)])
    sample = (
        df.select(key.alias("k"))
        .select("k", F.xxhash64("k").alias("h"))
        .orderBy("h")
        .limit(20 * buckets)
        .select("k.*")
    )
    types = [f.dataType for f in sample.schema.fields]
    rows = sample.distinct().orderBy(*[F.col(c).asc_nulls_first() for c in sample.columns]).collect()
    step = max(1, len(rows) // buckets)
    splits = rows[step::step]
    literals = [
        F.struct(*[_literal(v, t).alias(f"k{i}") for i, (v, t) in enumerate(zip(row, types))])
        for row in splits
    ]
    if not literals:
        return df.withColumn("_bucket", F.lit(0))
    # two-step search, so a row costs about twice the root of the bucket count
    width = math.isqrt(len(literals) - 1) + 1

    def below(splits: Column) -> Column:
        return F.aggregate(splits, F.lit(0), lambda acc, s: acc + F.when(s <= key, 1).otherwise(0))

    coarse = below(F.array(*literals[::width]))
    base = F.greatest(coarse - 1, F.lit(0)) * width
    fine = below(F.slice(F.array(*literals), base + 1, F.lit(width)))
    return df.withColumn("_bucket", base + fine)


def sized_lists(lists: DataFrame, key: str, name: str) -> DataFrame:
    """Lists (`key`, `listed`) wanted by `n` rows each, as a written table with the `entries` that all these rows get."""
    sized = lists.select(key, "listed", (F.col("n") * (F.size("listed") + 1)).alias("entries"))
    # read again by all cores, however few bytes the lists take when compressed
    return materialize(sized.repartition(lists.sparkSession.sparkContext.defaultParallelism, key), name)


def with_lists(rows: DataFrame, lists: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """`rows` with the list (`listed`) of their `key`; `lists` come from `sized_lists`.

    Rows are narrow and lists long, so neither the sizes of shuffles nor the counts of rows say what a task has to do.
    Here it is the entries: a key whose rows get many is cut into parts by the hash of `by`, each with a copy of the list,
    and tasks are as many as the entries ask for.  Rows leave in the order of their key, and are not shuffled again.
    """
    total = lists.agg(F.sum("entries")).first()[0] or 0
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_ENTRIES))
    parts = F.ceil(F.col("entries") / CELL_ENTRIES).cast("bigint")
    # fewer rows than total / CELL_ENTRIES
    heavy = lists.filter(F.col("entries") > CELL_ENTRIES).select(key, parts.alias("_parts"))
    spread = F.when(F.col(key).isNull(), F.lit(tasks)).otherwise(F.coalesce("_parts", F.lit(1))).cast("bigint")
    dealt = rows.join(F.broadcast(heavy), key, "left").withColumn("_part", F.pmod(F.xxhash64(by), spread)).drop("_parts")
    cells = lists.select(key, "listed", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("_part"))
    cells = cells.repartition(tasks, key, "_part").hint("merge")
    return dealt.repartition(tasks, key, "_part").join(cells, [key, "_part"], how).drop("_part")


def running(
    df: DataFrame,
    order: list[Column],
    measures: dict[str, tuple[str, Column]],
    partition: list[str] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Exclusive running aggregates over one global order, without one big task.

    `measures` maps an output name to ``("sum" | "max", value)``: the aggregate
    of all rows strictly before the row.  Two levels: a window inside every
    order bucket plus the carried aggregate of the buckets before it (one row
    per bucket, so the second window is tiny).  `order` must be unique.
    """
    partition = partition or []
    names = [f"_m{i}" for i in range(len(measures))]
    df = df.select("*", *[v.alias(n) for n, (_, v) in zip(names, measures.values())])
    keyed = order_bucket(df, [F.col(c) for c in partition] + order, buckets)
    keys = [*partition, "_bucket"]
    funcs = {"sum": F.sum, "max": F.max}
    kinds = [k for k, _ in measures.values()]

    before = Window.partitionBy(*partition).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = keyed.groupBy(*keys).agg(*[funcs[k](n).alias(n) for k, n in zip(kinds, names)])
    carried = totals.select(
        *keys, *[funcs[k](n).over(before).alias(f"{n}c") for k, n in zip(kinds, names)]
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.select(
        "*", *[funcs[k](n).over(inside).alias(f"{n}l") for k, n in zip(kinds, names)]
    )
    condition = F.lit(True)
    right = carried.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[f"{n}c" for n in names])
    for k in keys:
        condition = condition & local[k].eqNullSafe(F.col(f"_r_{k}"))
    joined = local.join(right, condition)
    outputs = []
    for (out, (kind, _)), n in zip(measures.items(), names):
        if kind == "sum":
            value = F.coalesce(F.col(f"{n}l"), F.lit(0)) + F.coalesce(F.col(f"{n}c"), F.lit(0))
        else:
            value = F.greatest(F.col(f"{n}l"), F.col(f"{n}c"))
        outputs.append(value.alias(out))
    keep = [c for c in df.columns if c not in names]
    return joined.select(*[local[c] for c in keep], *outputs)
