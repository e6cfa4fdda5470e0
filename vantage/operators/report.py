"""Monthly difference reports: intervals and collectors (`report_runs` makes whole reports).

Per-address collections that can grow without bound (names) stay long tables;
lists are built only where the entries are bounded (ports, tags of a rule set,
the names shown).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.functions.text import port_order, report_hostname, sort_ports
from vantage.functions.times import add_months, ts
from vantage.schema import REPORT_NAME_LIMIT, REPORT_PTR_MONTHS

MONTHLY = "monthly"


# --------------------------------------------------------------------------
# intervals


def report_intervals(reports: DataFrame, now) -> DataFrame:
    """Add the interval of a run now and the comparable one before it.

    Only monthly reports have one before; a table without `schedule_type` holds monthly reports.
    """
    run = ts(now)
    last = ts(F.col("last_run_at"))
    start = F.when(last.isNull() | (last >= run), add_months(run, -1)).otherwise(last)
    monthly = F.lower("schedule_type") == MONTHLY if "schedule_type" in reports.columns else F.lit(True)
    return reports.withColumn("from_at", start).select(
        "*", run.alias("to_at"), F.when(monthly, add_months(F.col("from_at"), -1)).alias("previous_from_at"),
        F.when(monthly, F.col("from_at")).alias("previous_to_at"),
    )


def next_run(reports: DataFrame, now) -> DataFrame:
    """Add the next run: the given day and hour of this month, or of the next."""
    now = ts(now)
    day = F.least(F.greatest(F.coalesce("schedule_day", F.lit(1)), F.lit(1)), F.lit(28))
    hour = F.least(F.greatest(F.coalesce("schedule_hour", F.lit(0)), F.lit(0)), F.lit(23))
    candidate = F.date_trunc("MONTH", now) + F.make_interval(days=day - 1, hours=hour)
    return reports.withColumn("next_at", F.when(candidate <= now, add_months(candidate, 1)).otherwise(candidate))


def due_reports(reports: DataFrame, now) -> DataFrame:
    """Active reports whose next run has come, oldest first."""
    return reports.filter(F.col("active") & (ts(F.col("next_run_at")) <= ts(now))).orderBy("next_run_at", "id")


# --------------------------------------------------------------------------
# collectors


def report_ports(found: DataFrame) -> DataFrame:
    """Distinct ports per address in port order (at most 65,535 each)."""
    return (
        found.select("ip", F.explode("port").alias("port")).filter(F.trim("port") != "").groupBy("ip")
        .agg(sort_ports(F.collect_set(F.trim("port"))).alias("ports"))
    )


def port_counter(found: DataFrame) -> DataFrame:
    """Number of addresses per port, most frequent first."""
    pairs = found.select("ip", F.explode("port").alias("port")).select("ip", F.trim("port").alias("port")).filter("port <> ''").distinct()
    return pairs.groupBy("port").agg(F.count("ip").alias("hosts")).orderBy(F.desc("hosts"), port_order("port"))


def report_tags(found: DataFrame) -> DataFrame:
    """Distinct tags per address, case-blind order (bounded by the rule set)."""
    tags = found.select("ip", F.explode("tag").alias("tag")).select("ip", F.trim("tag").alias("tag")).filter("tag <> ''")
    return tags.groupBy("ip").agg(
        F.transform(
            F.array_sort(F.collect_set(F.struct(F.lower("tag").alias("k"), F.col("tag").alias("t")))), lambda s: s["t"]
        ).alias("tags")
    )


def report_names(found: DataFrame) -> DataFrame:
    """Distinct requested names per address, trailing dots cut: rows (ip, name)."""
    name = F.regexp_replace(F.lower(F.trim("name")), r"\.+$", "")
    return found.select("ip", F.explode("fqdn_requested").alias("name")).select("ip", name.alias("name")).filter("name <> ''").distinct()


def ptr_cutoff(end: dt.datetime | Column, months: int = REPORT_PTR_MONTHS) -> Column:
    return F.unix_seconds(add_months(ts(end), -max(1, months)))


def ptr_names(bodies: DataFrame) -> DataFrame:
    """Usable PTR names of stored bodies: rows (uid, name)."""
    hosts = F.filter("body.hostnames", lambda h: F.upper(F.coalesce(h["type"], F.lit(""))) == "PTR")
    names = F.transform(hosts, lambda h: report_hostname(F.coalesce(F.nullif(h["name"], F.lit("")), h["hostname"])))
    return bodies.select(F.col("id").alias("uid"), F.explode(F.array_compact(names)).alias("name"))


def report_ptr(found: DataFrame, bodies: DataFrame, cutoff: Column) -> DataFrame:
    """Distinct PTR names per address of hit documents seen since the cutoff."""
    recent = found.filter(F.col("last_seen") >= cutoff).select("ip", "uid")
    return recent.join(ptr_names(bodies), "uid").select("ip", "name").distinct()


def fill_pdns(known: DataFrame, pdns: DataFrame, ips: DataFrame, limit: int = REPORT_NAME_LIMIT, by: tuple[str, ...] = ("ip",)) -> DataFrame:
    """Passive-DNS names that fill an address up to `limit` known names.

    `known` has one row (ip, name) per listed name, `pdns` (ip, seq, fqdn) in
    answer order.  A name already known is not repeated.  `by` are the columns
    that stand for an address in `known` and `ips`, such as (report, ip).
    """
    wanted = ips.select(*by).distinct()
    first = pdns.join(wanted.select("ip").distinct(), "ip", "left_semi").groupBy("ip", "fqdn").agg(F.min("seq").alias("seq"))
    first = first if by == ("ip",) else first.join(wanted, "ip")
    fresh = first.join(known.select(*by, F.lower("name").alias("fqdn")), [*by, "fqdn"], "left_anti")
    order = Window.partitionBy(*by).orderBy("seq", "fqdn")
    # no address can take more than `limit`, so ranking stops there early
    ranked = fresh.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    counts = known.groupBy(*by).agg(F.count("name").alias("n"))
    return ranked.join(counts, list(by), "left").filter(
        F.col("place") <= F.lit(limit) - F.coalesce("n", F.lit(0).cast("bigint"))
    ).select(*by, "place", F.col("fqdn").alias("name"))


def new_ports(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Ports per address (ip, ports) present now and absent before, if any."""
    before = previous.select("ip", F.col("ports").alias("_p"))
    gained = F.array_except("ports", F.coalesce("_p", F.array().cast("array<string>")))
    return current.join(before, "ip", "left").select("ip", sort_ports(gained).alias("ports")).filter(F.size("ports") > 0)


def associated_names(
    ptr: DataFrame, requested: DataFrame, pdns: DataFrame, limit: int = REPORT_NAME_LIMIT, by: tuple[str, ...] = ("ip",),
    kept: Callable[[DataFrame], DataFrame] = lambda names: names,
) -> tuple[DataFrame, DataFrame]:
    """Names of an address: PTR, then requested, then passive DNS; first one wins.

    Returns the shown names (ip, place, name, source) and the totals
    (ip, total, remaining); `by` as in :func:`fill_pdns`.  A caller that wants
    both passes `kept`, which writes the merged names that both read.
    """
    zero = F.lit(0).cast("bigint")
    rows = [
        ptr.select(*by, "name", F.lit(0).alias("rank"), zero.alias("seq"), F.lit("ptr").alias("source")),
        requested.select(*by, "name", F.lit(1).alias("rank"), zero.alias("seq"), F.lit("").alias("source")),
        pdns.select(*by, "name", F.lit(2).alias("rank"), F.col("place").cast("bigint").alias("seq"), F.lit("pdns").alias("source")),
    ]
    merged = reduce(DataFrame.unionByName, rows)
    unique = kept(merged.groupBy(*by, F.lower("name").alias("k")).agg(F.min(F.struct("rank", "seq", F.lower("name").alias("k"), "name", "source")).alias("f")))
    order = Window.partitionBy(*by).orderBy("f.rank", "f.seq", "f.k")
    shown = unique.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    totals = unique.groupBy(*by).agg(F.count("k").alias("total"))
    return (
        shown.select(*by, "place", F.col("f.name").alias("name"), F.col("f.source").alias("source")),
        totals.select(*by, "total", F.greatest(F.col("total") - limit, zero).alias("remaining")),
    )


def report_summary(found: DataFrame) -> DataFrame:
    return found.agg(F.countDistinct("ip").alias("ips"), F.count("uid").alias("scans"))
