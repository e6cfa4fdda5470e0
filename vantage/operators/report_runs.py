"""Whole reports: many definitions in one pass over the documents.

The queries of all due reports are one percolation index, so a document is read once for all of them and the hits are
rows (report, document).  Every section is one aggregation keyed by the report; nothing is planned per report, and only
two numbers (the earliest and the latest second any report asks for) come to the driver.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.functions.netaddr import address_order
from vantage.functions.text import port_order, sort_ports
from vantage.functions.times import ts
from vantage.operators import percolate
from vantage.operators.report import associated_names, due_reports, fill_pdns, next_run, ptr_cutoff, ptr_names, report_intervals
from vantage.operators.search import any_of, overlaps, search_terms
from vantage.schema import REPORT_NAME_LIMIT
from vantage.session import local_table, materialize

# Report texts.
DISCLAIMER = (
    "This report is provided as-is. Results may be incomplete due to unscanned ports, transient scan errors, "
    "unavailable services, or other collection limitations."
)

KEY = ("report", "ip")
STAMP = "yyyy-MM-dd HH:mm:ss 'UTC'"
RUN_SCHEMA = (
    "report string, name string, description string, query string, shown_from string, shown_to string, start bigint, "
    "end bigint, previous_start bigint, previous_end bigint, cutoff bigint"
)


@dataclass
class ReportRun:
    """`lines` (report_id, section, key, sub, line) in order; `reports` with advanced run times; `outcome` (id, status,
    reason) of every due report."""

    lines: DataFrame
    reports: DataFrame
    outcome: DataFrame


# --------------------------------------------------------------------------
# hits


def report_terms(runs: DataFrame) -> DataFrame:
    """Rows (report, terms, reason): the queries' terms, parsed in tasks; `reason` says why a query cannot be read."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for report, text in zip(batch["report"], batch["query"], strict=True):
                try:
                    groups, reason = search_terms(text or ""), None
                except ValueError as error:
                    groups, reason = [], str(error)
                terms = [dict(grp=g, field=f, op=op, value=v) for g, group in enumerate(groups) for f, op, v in group]
                rows.append((report, terms, reason))
            yield pd.DataFrame(rows, columns=["report", "terms", "reason"])

    return runs.select("report", "query").mapInPandas(
        parse, "report string, terms array<struct<grp:int,field:string,op:string,value:string>>, reason string"
    )


def _marked(docs: DataFrame) -> DataFrame:
    """Hit rows with `now` and `before`: seen in the period, in the one before it."""
    touches = lambda start, end: F.coalesce((F.col("last_seen") >= F.col(start)) & (F.col("first_seen") <= F.col(end)), F.lit(False))
    marked = docs.withColumns({
        "now": touches("start", "end"), "before": touches("previous_start", "previous_end"), "recent": F.col("last_seen") >= F.col("cutoff"),
    })
    rows = marked.filter("now OR before")
    return rows.select("report", "uid", "ip", "port", "tag", "fqdn_requested", "now", "before", (F.col("now") & F.col("recent")).alias("recent"))


def report_hits(docs: DataFrame, runs: DataFrame, terms: DataFrame) -> DataFrame:
    """Hits of all reports; document ids are those of a store, one row each.

    The documents are read for the seconds that any report asks for.  `runs` has a row a report and joins on the report,
    whose hits may be many: the optimizer broadcasts `runs` by its written size or splits the large report.
    """
    span = runs.agg(F.min(F.least("start", "previous_start")).alias("a"), F.max(F.greatest("end", "previous_end")).alias("b")).first()
    seen = docs.filter(overlaps(span.a or 0, span.b or 0))
    rows = terms.select(F.col("report").alias("rule"), F.explode("terms").alias("t")).select("rule", "t.*")
    pairs = percolate.percolate(seen, percolate.compile_rules(rows, searches=True))
    fields = seen.select("uid", "ip", "first_seen", "last_seen", "port", "tag", "fqdn_requested")
    bounds = runs.select("report", "start", "end", "previous_start", "previous_end", "cutoff")
    return _marked(pairs.withColumnRenamed("rule", "report").join(fields, "uid").join(bounds, "report"))


# --------------------------------------------------------------------------
# sections


def report_hosts(hits: DataFrame) -> DataFrame:
    """One row per (report, ip) with hits in the period: scans, ports, gained ports, tags.

    All come from one aggregation with a row a hit.  It keeps distinct lists: a document has the port it was found at and
    the tags of a rule set, so an address has as many of them as ports and sets of tags.
    """
    def lists(name: str, when: str) -> Column:
        return F.collect_set(F.when(F.col(when) & (F.size(name) > 0), F.col(name)))

    def values(name: str) -> Column:
        return F.array_distinct(F.filter(F.transform(F.flatten(name), lambda v: F.trim(v)), lambda v: v != ""))

    met = hits.groupBy(*KEY).agg(
        F.count_if("now").alias("scans"), lists("port", "now").alias("ports"), lists("port", "before").alias("old"), lists("tag", "now").alias("tags")
    ).filter("scans > 0")
    found = met.select(*KEY, "scans", *[values(name).alias(name) for name in ("ports", "old", "tags")])
    # case-blind order of tags
    keyed = F.transform("tags", lambda t: F.struct(F.lower(t).alias("k"), t.alias("t")))
    return found.select(
        *KEY, "scans", sort_ports("ports").alias("ports"), sort_ports(F.array_except("ports", "old")).alias("gained"),
        F.transform(F.array_sort(keyed), lambda s: s["t"]).alias("tags"),
    )


def report_known_names(hits: DataFrame, bodies: DataFrame | None) -> DataFrame:
    """Distinct rows (report, ip, name, ptr): requested names, and PTR names of documents seen since the cutoff."""
    name = F.regexp_replace(F.lower(F.trim("name")), r"\.+$", "")
    asked = hits.filter("now").select(*KEY, F.explode("fqdn_requested").alias("name"))
    known = asked.select(*KEY, name.alias("name"), F.lit(False).alias("ptr")).filter("name <> ''")
    if bodies is not None:
        recent = hits.filter("recent").select(*KEY, "uid")
        known = known.unionByName(recent.join(ptr_names(bodies), "uid").select(*KEY, "name", F.lit(True).alias("ptr")))
    return known.distinct()


def _rank_text(order: Column) -> Column:
    """Address order as one sortable text."""
    return F.concat(F.lpad(order["version"].cast("string"), 2, "0"), order["key"], order["text"])


def _port_text(count: Column, port: Column) -> Column:
    order = port_order(port)
    return F.concat(
        F.lpad((F.lit(10**15) - count).cast("string"), 16, "0"), order["kind"].cast("string"),
        F.lpad(order["number"].cast("string"), 10, "0"), order["text"],
    )


def _line(section: int, text: Column | str, when: Column | None = None) -> Column:
    line = F.lit(text) if isinstance(text, str) else text
    return F.struct(F.lit(section).alias("section"), (line if when is None else F.when(when, line)).alias("line"))


def _fixed_lines() -> Column:
    """The lines that a report has once; a line that is not wanted is null."""
    count = lambda name: F.coalesce(F.col(name), F.lit(0).cast("bigint"))
    described = F.col("description") != ""
    compared = F.col("previous_start").isNotNull()
    return F.array(
        _line(0, F.concat(F.lit("# "), F.coalesce("name", F.lit("")))), _line(0, ""),
        _line(0, F.col("description"), described), _line(0, "", described), _line(0, "## Summary"), _line(0, ""),
        _line(0, F.concat(F.lit("- Query: `"), F.coalesce("query", F.lit("")), F.lit("`"))),
        _line(0, F.concat(F.lit("- Period: "), "shown_from", F.lit(" to "), "shown_to")),
        _line(1, F.concat(F.lit("- Matching IPs: "), count("ips").cast("string"))),
        _line(1, F.concat(F.lit("- Matching scans: "), count("scans").cast("string"))),
        _line(2, ""), _line(2, "## Open Ports"), _line(2, ""),
        _line(3, "- No indexed open ports found.", count("with_ports") == 0),
        _line(4, "", compared), _line(4, "## New opened port", compared), _line(4, "", compared),
        _line(5, "- No newly opened ports detected.", compared & (count("with_gained") == 0)),
        _line(6, ""), _line(6, "## Hosts"), _line(6, ""),
        _line(7, "No matching hosts.", count("ips") == 0),
        _line(8, ""), _line(8, "## Disclaimer"), _line(8, ""), _line(8, DISCLAIMER), _line(8, ""),
    )


def _host_lines() -> Column:
    ports = F.coalesce(F.nullif(F.array_join("ports", ", "), F.lit("")), F.lit("none"))
    gains = F.col("compared") & (F.size("gained") > 0)
    return F.array(
        _line(7, F.concat(F.lit("- "), "ip")),
        _line(7, F.concat(F.lit("  - Tag: "), F.array_join("tags", ", ")), F.size("tags") > 0),
        _line(7, F.concat(F.lit("  - Open ports: "), ports)),
        _line(7, F.concat(F.lit("  - Scan results: "), F.col("scans").cast("string"))),
        _line(7, F.concat(F.lit("  - Associated FQDNs ("), F.col("total").cast("string"), F.lit(")")), F.col("total") > 0),
        _line(5, F.concat(F.lit("- "), "ip"), gains),
        _line(5, F.concat(F.lit("  - New ports: "), F.array_join("gained", ", ")), gains),
    )


def lines_of(runs: DataFrame, hits: DataFrame, bodies: DataFrame | None = None, pdns: DataFrame | None = None) -> DataFrame:
    """Rows (report, section, key, sub, line) of all reports, ordered by these.

    `runs` has the columns of `RUN_SCHEMA`.  Hits, hosts, known and associated names are written once; what follows reads them.
    """
    hits = materialize(hits, "report-hits")
    hosts = materialize(report_hosts(hits), "report-hosts")
    known = materialize(report_known_names(hits, bodies), "report-names")
    ptr, requested = known.filter("ptr").drop("ptr"), known.filter("NOT ptr").drop("ptr")
    if pdns is None:
        filled = known.filter(F.lit(False)).select(*KEY, F.lit(0).alias("place"), "name")
    else:
        filled = fill_pdns(known, pdns, hosts, by=KEY)
    shown, totals = associated_names(ptr, requested, filled, by=KEY, kept=lambda names: materialize(names, "report-associated"))

    sums = hosts.groupBy("report").agg(
        F.count("ip").alias("ips"), F.sum("scans").alias("scans"), F.count_if(F.size("ports") > 0).alias("with_ports"),
        F.count_if(F.size("gained") > 0).alias("with_gained"),
    )
    counter = hosts.select("report", F.explode("ports").alias("port")).groupBy("report", "port").agg(F.count(F.lit(1)).alias("hosts"))
    compared = runs.select("report", F.col("previous_start").isNotNull().alias("compared"))
    detailed = hosts.join(totals, list(KEY), "left").join(compared, "report")
    place = _rank_text(address_order("ip")).alias("key")
    named = F.when(F.col("source") == "", "").otherwise(F.concat(F.lit(" ("), "source", F.lit(")")))
    parts = [
        runs.join(sums, "report", "left").select("report", F.lit("").alias("key"), F.posexplode(_fixed_lines()).alias("sub", "l")),
        detailed.select("report", place, F.posexplode(_host_lines()).alias("sub", "l")),
        counter.select(
            "report", _port_text(F.col("hosts"), F.col("port")).alias("key"), F.lit(0).alias("sub"),
            _line(3, F.concat(F.lit("- "), "port", F.lit(": "), F.col("hosts").cast("string"), F.when(F.col("hosts") == 1, " host").otherwise(" hosts"))).alias("l"),
        ),
        shown.select("report", place, (F.col("place") + 9).alias("sub"), _line(7, F.concat(F.lit("    - "), "name", named)).alias("l")),
        totals.filter("remaining > 0").select(
            "report", place, F.lit(10 + REPORT_NAME_LIMIT).alias("sub"),
            _line(7, F.concat(F.lit("    - "), F.col("remaining").cast("string"), F.lit(" additional fqdn not listed here"))).alias("l"),
        ),
    ]
    rows = reduce(DataFrame.unionByName, [p.select("report", "key", "sub", "l.section", "l.line") for p in parts])
    return rows.filter("line IS NOT NULL").select("report", "section", "key", "sub", "line").orderBy("report", "section", "key", "sub")


# --------------------------------------------------------------------------
# runs


def report_lines(
    docs: DataFrame,
    report: dict,
    period: tuple[int, int],
    previous: tuple[int, int] | None,
    shown: tuple[str, str],
    bodies: DataFrame | None = None,
    pdns: DataFrame | None = None,
    cutoff: int = 0,
) -> DataFrame:
    """One report on its own as rows (section, key, sub, line), in order: its query is a filter, so one scan finds the hits.

    `report` has name, description and query; `shown` are the texts of the period.  `cutoff` is the least second of
    documents whose PTR names count.
    """
    before = previous or (None, None)
    run = ("", report["name"], report.get("description"), report["query"], *shown, *period, *before, cutoff)
    runs = local_table(docs.sparkSession, [run], RUN_SCHEMA)
    bounds = dict(zip(("start", "end", "previous_start", "previous_end", "cutoff"), (*period, *before, cutoff), strict=True))
    wanted = overlaps(*period) if previous is None else overlaps(*period) | overlaps(*previous)
    found = docs.filter(wanted & any_of(search_terms(report["query"])))
    hits = _marked(found.withColumns({"report": F.lit("")} | {name: F.lit(value).cast("bigint") for name, value in bounds.items()}))
    return lines_of(runs, hits, bodies, pdns).drop("report")


def write_report(lines: DataFrame, path: str) -> None:
    """The ordered lines as text files (read them in name order)."""
    lines.select("line").write.mode("overwrite").text(path)


def run_reports(
    docs: DataFrame,
    reports: DataFrame,
    now: dt.datetime,
    bodies: DataFrame | None = None,
    pdns: DataFrame | None = None,
    include_ptr: bool = True,
) -> ReportRun:
    """Lines of every due report, the report table with advanced run times, and what became of each due report.

    A report whose query cannot be read has no lines, keeps its run times and is listed as failed; the others run.
    `reports` has one row an id (id, name, description, query, active, schedule_day, schedule_hour, last_run_at,
    next_run_at and, where not all are monthly, schedule_type).  No due report gives no lines.
    """
    second = lambda name: F.unix_seconds(F.col(name))
    shown = lambda name: F.date_format(name, STAMP)
    due = report_intervals(due_reports(reports, now), now)
    runs = materialize(due.select(
        F.col("id").cast("string").alias("report"), F.col("name").cast("string").alias("name"),
        F.col("description").cast("string").alias("description"), F.col("query").cast("string").alias("query"),
        shown("from_at").alias("shown_from"), shown("to_at").alias("shown_to"),
        second("from_at").alias("start"), second("to_at").alias("end"),
        second("previous_from_at").alias("previous_start"), second("previous_to_at").alias("previous_end"),
        ptr_cutoff(F.col("to_at")).alias("cutoff"),
    ), "report-runs")
    terms = materialize(report_terms(runs), "report-terms")
    read = terms.filter("reason IS NULL")
    able = runs.join(read.select("report"), "report", "left_semi")
    lines = lines_of(able, report_hits(docs, able, read), bodies if include_ptr else None, pdns)

    kind = reports.schema["id"].dataType
    outcome = terms.select(
        F.col("report").cast(kind).alias("id"), F.when(F.col("reason").isNull(), "done").otherwise("failed").alias("status"), "reason"
    )
    ran = F.col("_ran").isNotNull()
    dated = next_run(reports, now).join(read.select(F.col("report").cast(kind).alias("id"), F.lit(True).alias("_ran")), "id", "left")
    times = {
        "last_run_at": F.when(ran, ts(now)).otherwise(ts(F.col("last_run_at"))),
        "next_run_at": F.when(ran, F.col("next_at")).otherwise(ts(F.col("next_run_at"))),
    }
    advanced = dated.select(*[c for c in reports.columns if c not in times], *[value.alias(name) for name, value in times.items()])
    return ReportRun(lines.select(F.col("report").cast(kind).alias("report_id"), "section", "key", "sub", "line"), advanced, outcome)
