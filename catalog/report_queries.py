"""Report queries (R1-R15): customers as report definitions, documents from events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog.base import query, table
from catalog.bindings import documents, observations, with_docs
from vantage.operators import report as R
from vantage.operators import report_runs as RR
from vantage.operators import search as S

NOW = dt.datetime(2001, 7, 15, 10, 30)

_REPORTS_SQL = """WITH o AS (SELECT o_custkey, max(o_orderdate) AS m FROM orders GROUP BY 1),
reports AS (SELECT c_custkey AS id, c_acctbal > 0 AS active, 1 + c_custkey % 28 AS schedule_day, c_custkey % 24 AS schedule_hour,
   m + to_hours(CAST(c_custkey % 24 AS INT)) AS last_run_at, m + INTERVAL 1 MONTH AS next_run_at FROM customer LEFT JOIN o ON o_custkey = c_custkey)"""


def _reports(spark, sf_dir):
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("m"))
    return table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("active"),
        (1 + F.col("c_custkey") % 28).cast("int").alias("schedule_day"), (F.col("c_custkey") % 24).cast("int").alias("schedule_hour"),
        (F.col("m") + F.make_interval(hours=(F.col("c_custkey") % 24).cast("int"))).alias("last_run_at"),
        (F.col("m") + F.expr("INTERVAL '1' MONTH")).alias("next_run_at"),
    )


def _ntz(df, *names):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in names else F.col(c) for c in df.columns])


@query(
    "R1_report_interval",
    f"{_REPORTS_SQL} SELECT id, CASE WHEN last_run_at IS NULL OR last_run_at >= TIMESTAMP '2001-07-15 10:30:00' THEN TIMESTAMP '2001-06-15 10:30:00' ELSE last_run_at END AS from_at, TIMESTAMP '2001-07-15 10:30:00' AS to_at FROM reports",
)
def r1(spark, sf_dir):
    return _ntz(R.report_intervals(_reports(spark, sf_dir), NOW).select("id", "from_at", "to_at"), "from_at", "to_at")


@query(
    "R2_previous_interval",
    f"{_REPORTS_SQL}, i AS (SELECT id, CASE WHEN last_run_at IS NULL OR last_run_at >= TIMESTAMP '2001-07-15 10:30:00' THEN TIMESTAMP '2001-06-15 10:30:00' ELSE last_run_at END AS f FROM reports) "
    "SELECT id, f - INTERVAL 1 MONTH AS previous_from_at, f AS previous_to_at FROM i",
)
def r2(spark, sf_dir):
    out = R.report_intervals(_reports(spark, sf_dir), NOW).select("id", "previous_from_at", "previous_to_at")
    return _ntz(out, "previous_from_at", "previous_to_at")


@query(
    "R3_next_run",
    f"{_REPORTS_SQL}, c AS (SELECT id, TIMESTAMP '2001-07-01' + to_days(CAST(schedule_day - 1 AS INT)) + to_hours(CAST(schedule_hour AS INT)) AS c FROM reports) "
    "SELECT id, CASE WHEN c <= TIMESTAMP '2001-07-15 10:30:00' THEN c + INTERVAL 1 MONTH ELSE c END AS next_at FROM c",
)
def r3(spark, sf_dir):
    return _ntz(R.next_run(_reports(spark, sf_dir), NOW).select("id", "next_at"), "next_at")


@query("R4_due_reports", f"{_REPORTS_SQL} SELECT id, next_run_at FROM reports WHERE active AND next_run_at <= TIMESTAMP '2001-07-15 10:30:00'")
def r4(spark, sf_dir):
    return R.due_reports(_reports(spark, sf_dir), NOW).select("id", "next_run_at")


_FROM, _TO, _BEFORE = 1705363200, 1706659200, 1704067200
_HITS = (
    f", hits AS (SELECT * FROM docs WHERE last_seen >= {_FROM} AND first_seen <= {_TO} AND list_contains(tag, 'soft:view')),"
    f" prev AS (SELECT * FROM docs WHERE last_seen >= {_BEFORE} AND first_seen <= {_FROM} AND list_contains(tag, 'soft:view'))"
)


def _found(spark, sf_dir):
    return S.hits(documents(spark, sf_dir), S.search_terms("tag:soft:view"), _FROM, _TO)


def _previous(spark, sf_dir):
    return S.hits(documents(spark, sf_dir), S.search_terms("tag:soft:view"), _BEFORE, _FROM)


_PORT_ORDER = "ORDER BY CAST(p AS INT)"


@query("R5_ports_per_address", with_docs(f"{_HITS} SELECT ip, string_agg(p, ',' {_PORT_ORDER}) AS ports FROM (SELECT DISTINCT ip, unnest(port) AS p FROM hits) GROUP BY ip"))
def r5(spark, sf_dir):
    return R.report_ports(_found(spark, sf_dir)).select("ip", F.array_join("ports", ",").alias("ports"))


@query("R6_hosts_per_port", with_docs(f"{_HITS} SELECT p AS port, count(DISTINCT ip) AS hosts FROM (SELECT ip, unnest(port) AS p FROM hits) GROUP BY p"))
def r6(spark, sf_dir):
    return R.port_counter(_found(spark, sf_dir))


@query("R7_tags_per_address", with_docs(f"{_HITS} SELECT ip, string_agg(t, ',' ORDER BY t) AS tags FROM (SELECT DISTINCT ip, unnest(tag) AS t FROM hits) GROUP BY ip"))
def r7(spark, sf_dir):
    return R.report_tags(_found(spark, sf_dir)).select("ip", F.array_join("tags", ",").alias("tags"))


@query("R8_requested_names", with_docs(f"{_HITS} SELECT DISTINCT ip, unnest(fqdn_requested) AS name FROM hits"))
def r8(spark, sf_dir):
    return R.report_names(_found(spark, sf_dir))


_PTR_SQL = ", ptr AS (SELECT DISTINCT h.ip, 'ptr' || o.user_id || '.' || (o.event_id % 3) || '.example.net' AS name FROM hits h JOIN obs o ON o.uid = h.uid WHERE h.last_seen >= 1705795200 AND o.kn % 4 = 1)"


def _bodies(spark, sf_dir):
    obs = observations(spark, sf_dir)
    name = F.expr("'PTR' || user_id || '.' || (event_id % 3) || '.Example.net.'")
    kind = F.expr("CASE WHEN kn % 4 = 1 THEN 'PTR' ELSE 'user' END")
    host = F.struct(F.when(F.col("event_id") % 2 == 0, name).alias("name"), name.alias("hostname"), kind.alias("type"))
    literal = F.struct(F.lit("8.8.8.8").alias("name"), F.lit(None).cast("string").alias("hostname"), F.lit("PTR").alias("type"))
    return obs.select(F.col("uid").alias("id"), F.struct(F.array(host, literal).alias("hostnames")).alias("body"))


def _ptr(spark, sf_dir):
    # six months before 2024-07-21
    return R.report_ptr(_found(spark, sf_dir), _bodies(spark, sf_dir), R.ptr_cutoff(dt.datetime(2024, 7, 21)))


@query("R9_ptr_names", with_docs(f"{_HITS}{_PTR_SQL} SELECT ip, name FROM ptr"))
def r9(spark, sf_dir):
    return _ptr(spark, sf_dir)


# passive DNS: up to 40 names per address of a block of sixteen, repeated answers
_PDNS_SQL = """, req AS (SELECT DISTINCT ip, unnest(fqdn_requested) AS name FROM hits), known AS (SELECT * FROM ptr UNION ALL SELECT * FROM req),
 pdns AS (SELECT d.ip, o.event_id * 10 + i AS seq, CASE WHEN i = 3 THEN 'h' || o.user_id || '.view.example.com' ELSE 'p' || i || '.k' || (o.kn % 5) || '.example.org' END AS fqdn
   FROM docs d JOIN obs o ON o.uid = d.uid, (SELECT unnest(range(0, 8)) AS i)),
 pf AS (SELECT ip, fqdn, min(seq) AS seq FROM pdns WHERE ip IN (SELECT ip FROM hits) GROUP BY ip, fqdn),
 pr AS (SELECT ip, fqdn, row_number() OVER (PARTITION BY ip ORDER BY seq, fqdn) AS place FROM pf WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.ip = pf.ip AND k.name = pf.fqdn)),
 filled AS (SELECT ip, CAST(place AS INT) AS place, fqdn AS name FROM pr WHERE place <= 25 - (SELECT count(*) FROM known k WHERE k.ip = pr.ip))"""


def _pdns(spark, sf_dir):
    from vantage.functions.netaddr import ipv4_text

    obs = observations(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7))))
    name = F.expr("CASE WHEN i = 3 THEN 'h' || user_id || '.view.example.com' ELSE 'p' || i || '.k' || (kn % 5) || '.example.org' END")
    return obs.select(ipv4_text("ip_num").alias("ip"), (F.col("event_id") * 10 + F.col("i")).alias("seq"), name.alias("fqdn"))


def _filled(spark, sf_dir):
    found = _found(spark, sf_dir)
    known = _ptr(spark, sf_dir).unionByName(R.report_names(found))
    return R.fill_pdns(known, _pdns(spark, sf_dir), found.select("ip"))


@query("R10_passive_dns_fill", with_docs(f"{_HITS}{_PTR_SQL}{_PDNS_SQL} SELECT ip, place, name FROM filled"))
def r10(spark, sf_dir):
    return _filled(spark, sf_dir)


_NEW_SQL = ", np AS (SELECT ip, p FROM (SELECT DISTINCT ip, unnest(port) AS p FROM hits) EXCEPT SELECT ip, p FROM (SELECT DISTINCT ip, unnest(port) AS p FROM prev))"


@query("R11_new_ports", with_docs(f"{_HITS}{_NEW_SQL} SELECT ip, string_agg(p, ',' {_PORT_ORDER}) AS ports FROM np GROUP BY ip"))
def r11(spark, sf_dir):
    now, before = R.report_ports(_found(spark, sf_dir)), R.report_ports(_previous(spark, sf_dir))
    return R.new_ports(now, before).select("ip", F.array_join("ports", ",").alias("ports"))


_ASSOC_SQL = """, al AS (SELECT ip, name, 0 AS rank, 0 AS seq, 'ptr' AS source FROM ptr UNION ALL SELECT ip, name, 1, 0, '' FROM req UNION ALL SELECT ip, name, 2, place, 'pdns' FROM filled),
 au AS (SELECT ip, name, min(rank) AS rank, arg_min(seq, rank) AS seq, arg_min(source, rank) AS source FROM al GROUP BY ip, name),
 ar AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY rank, seq, name) AS place, count(*) OVER (PARTITION BY ip) AS total FROM au)"""


@query("R12_associated_names", with_docs(f"{_HITS}{_PTR_SQL}{_PDNS_SQL}{_ASSOC_SQL} SELECT ip, CAST(place AS INT) AS place, name, source FROM ar WHERE place <= 6"))
def r12(spark, sf_dir):
    return R.associated_names(_ptr(spark, sf_dir), R.report_names(_found(spark, sf_dir)), _filled(spark, sf_dir), 6)[0]


@query("R12_associated_totals", with_docs(f"{_HITS}{_PTR_SQL}{_PDNS_SQL}{_ASSOC_SQL} SELECT DISTINCT ip, total, greatest(total - 6, 0) AS remaining FROM ar"))
def r12_totals(spark, sf_dir):
    return R.associated_names(_ptr(spark, sf_dir), R.report_names(_found(spark, sf_dir)), _filled(spark, sf_dir), 6)[1]


@query("R13_summary", with_docs(f"{_HITS} SELECT count(DISTINCT ip) AS ips, count(uid) AS scans FROM hits"))
def r13(spark, sf_dir):
    return R.report_summary(_found(spark, sf_dir))


_LINES_SQL = f"""{_HITS}{_PTR_SQL}{_PDNS_SQL}{_ASSOC_SQL}{_NEW_SQL},
 pc AS (SELECT p, count(*) AS n FROM (SELECT DISTINCT ip, unnest(port) AS p FROM hits) GROUP BY p),
 hp AS (SELECT ip, string_agg(p, ', ' {_PORT_ORDER}) AS ports FROM (SELECT DISTINCT ip, unnest(port) AS p FROM hits) GROUP BY ip),
 ht AS (SELECT ip, string_agg(t, ', ' ORDER BY t) AS tags FROM (SELECT DISTINCT ip, unnest(tag) AS t FROM hits) GROUP BY ip),
 hc AS (SELECT ip, count(*) AS n FROM hits GROUP BY ip),
 hn AS (SELECT ip, string_agg(p, ', ' {_PORT_ORDER}) AS ports FROM np GROUP BY ip)
 SELECT section, line, count(*) AS n FROM (
   SELECT 0 AS section, unnest(['# Views', '', 'Seen views', '', '## Summary', '', '- Query: `tag:soft:view`', '- Period: A to B']) AS line
   UNION ALL SELECT 1, unnest(['- Matching IPs: ' || count(DISTINCT ip), '- Matching scans: ' || count(*)]) FROM hits
   UNION ALL SELECT 2, unnest(['', '## Open Ports', ''])
   UNION ALL SELECT 3, '- ' || p || ': ' || n || CASE WHEN n = 1 THEN ' host' ELSE ' hosts' END FROM pc
   UNION ALL SELECT 4, unnest(['', '## New opened port', ''])
   UNION ALL SELECT 5, unnest(['- ' || ip, '  - New ports: ' || ports]) FROM hn
   UNION ALL SELECT 6, unnest(['', '## Hosts', ''])
   UNION ALL SELECT 7, unnest(['- ' || ip, '  - Open ports: ' || ports]) FROM hp
   UNION ALL SELECT 7, '  - Tag: ' || tags FROM ht
   UNION ALL SELECT 7, '  - Scan results: ' || n FROM hc
   UNION ALL SELECT 7, l FROM (SELECT DISTINCT ip, '  - Associated FQDNs (' || total || ')' AS l FROM ar)
   UNION ALL SELECT 7, '    - ' || name || CASE WHEN source = '' THEN '' ELSE ' (' || source || ')' END FROM ar WHERE place <= 25
   UNION ALL SELECT 7, l FROM (SELECT DISTINCT ip, '    - ' || (total - 25) || ' additional fqdn not listed here' AS l FROM ar WHERE total > 25)
   UNION ALL SELECT 8, unnest(['', '## Disclaimer', '', '{RR.DISCLAIMER}', ''])) GROUP BY ALL"""


@query("R14_report_lines", with_docs(_LINES_SQL))
def r14(spark, sf_dir):
    """Lines are compared per section; their order is checked in the tests."""
    report = {"name": "Views", "description": "Seen views", "query": "tag:soft:view"}
    cutoff = 1705795200  # six months before 2024-07-21
    lines = RR.report_lines(
        documents(spark, sf_dir), report, (_FROM, _TO), (_BEFORE, _FROM), ("A", "B"), _bodies(spark, sf_dir), _pdns(spark, sf_dir), cutoff
    )
    return lines.groupBy("section", "line").agg(F.count("*").alias("n"))


# one report for each event type and remainder of the user: a title, two groups, an inner text, a header's value, an
# unknown field; "once" reports have no period before, those of errors are not active
_R15_SQL = """, r AS (SELECT DISTINCT event_type AS e, user_id % 20 AS n FROM events), k AS (SELECT *, e || '-' || n AS id FROM r WHERE e <> 'error'),
 q AS (SELECT *, CASE WHEN n % 4 = 0 THEN 'http_title:"' || e || ' portal ' || n || '"'
     WHEN n % 4 = 1 THEN 'tag:soft:' || e || ' tag:lang:l' || (n % 3) || ' OR http_server.bg:' || e || '/' || (n % 10) || ' port.nt:' || n
     WHEN n % 4 = 2 THEN 'banner.lk:"' || e || ' ready ' || n || '"' WHEN n % 8 = 3 THEN 'http_headval:x-powered-by.lk:' || (n % 9)
     ELSE 'colour:' || n END AS query,
   CASE WHEN e = 'click' THEN TIMESTAMP '2024-01-20 00:00:00' ELSE TIMESTAMP '2023-12-31 00:00:00' END AS f, n % 5 <> 0 AS monthly FROM k),
 b AS (SELECT *, CAST(epoch(f) AS BIGINT) AS s, CAST(epoch(f - INTERVAL 1 MONTH) AS BIGINT) AS ps FROM q)"""
_R15_HITS_SQL = """, m AS (SELECT b.id, b.s, b.ps, b.monthly, d.* FROM b JOIN docs d ON (n % 4 = 0 AND list_contains(http_title, e || ' portal ' || n))
     OR (n % 4 = 1 AND ((list_contains(tag, 'soft:' || e) AND list_contains(tag, 'lang:l' || (n % 3)))
        OR (len(list_filter(http_server, lambda x: starts_with(x, e || '/' || (n % 10)))) > 0 AND NOT list_contains(port, CAST(n AS VARCHAR)))))
     OR (n % 4 = 2 AND len(list_filter(banner, lambda x: contains(x, e || ' ready ' || n))) > 0)
     OR (n % 8 = 3 AND len(list_filter(http_headval, lambda x: starts_with(x, 'x-powered-by:') AND contains(substr(x, 14), CAST(n % 9 AS VARCHAR)))) > 0)),
 hits AS (SELECT * FROM m WHERE last_seen >= s AND first_seen <= 1706659200),
 prev AS (SELECT * FROM m WHERE monthly AND last_seen >= ps AND first_seen <= s),
 hp AS (SELECT DISTINCT id, ip, unnest(port) AS p FROM hits), np AS (SELECT id, ip, p FROM hp EXCEPT SELECT DISTINCT id, ip, unnest(port) FROM prev),
 ptr AS (SELECT DISTINCT h.id, h.ip, 'ptr' || o.user_id || '.' || (o.event_id % 3) || '.example.net' AS name FROM hits h JOIN obs o ON o.uid = h.uid WHERE h.last_seen >= 1690761600 AND o.kn % 4 = 1),
 al AS (SELECT id, ip, name, 0 AS rank FROM ptr UNION ALL SELECT DISTINCT id, ip, unnest(fqdn_requested), 1 FROM hits),
 au AS (SELECT id, ip, name, min(rank) AS rank FROM al GROUP BY ALL),
 ar AS (SELECT *, row_number() OVER (PARTITION BY id, ip ORDER BY rank, name) AS place, count(*) OVER (PARTITION BY id, ip) AS total FROM au),
 fine AS (SELECT * FROM b WHERE n % 8 <> 7)"""
_R15_LINES_SQL = """ SELECT report_id, section, line, count(*) AS n FROM (
   SELECT id AS report_id, 0 AS section, unnest(['# Report ' || id, '', '## Summary', '', '- Query: `' || query || '`', '- Period: ' || strftime(f, '%Y-%m-%d %H:%M:%S UTC') || ' to 2024-01-31 00:00:00 UTC']) AS line FROM fine
   UNION ALL SELECT id, 1, unnest(['- Matching IPs: ' || (SELECT count(DISTINCT ip) FROM hits h WHERE h.id = fine.id), '- Matching scans: ' || (SELECT count(*) FROM hits h WHERE h.id = fine.id)]) FROM fine
   UNION ALL SELECT id, 2, unnest(['', '## Open Ports', '']) FROM fine
   UNION ALL SELECT id, 3, '- ' || p || ': ' || count(*) || CASE WHEN count(*) = 1 THEN ' host' ELSE ' hosts' END FROM hp GROUP BY id, p
   UNION ALL SELECT id, 3, '- No indexed open ports found.' FROM fine WHERE id NOT IN (SELECT id FROM hp)
   UNION ALL SELECT id, 4, unnest(['', '## New opened port', '']) FROM fine WHERE monthly
   UNION ALL SELECT id, 5, unnest(['- ' || ip, '  - New ports: ' || string_agg(p, ', ' ORDER BY CAST(p AS INT))]) FROM np WHERE id IN (SELECT id FROM fine WHERE monthly) GROUP BY id, ip
   UNION ALL SELECT id, 5, '- No newly opened ports detected.' FROM fine WHERE monthly AND id NOT IN (SELECT id FROM np)
   UNION ALL SELECT id, 6, unnest(['', '## Hosts', '']) FROM fine
   UNION ALL SELECT id, 7, 'No matching hosts.' FROM fine WHERE id NOT IN (SELECT id FROM hits)
   UNION ALL SELECT id, 7, unnest(['- ' || ip, '  - Scan results: ' || count(*)]) FROM hits GROUP BY id, ip
   UNION ALL SELECT id, 7, '  - Open ports: ' || string_agg(p, ', ' ORDER BY CAST(p AS INT)) FROM hp GROUP BY id, ip
   UNION ALL SELECT id, 7, '  - Open ports: none' FROM (SELECT DISTINCT id, ip FROM hits EXCEPT SELECT id, ip FROM hp)
   UNION ALL SELECT id, 7, '  - Tag: ' || string_agg(t, ', ' ORDER BY t) FROM (SELECT DISTINCT id, ip, unnest(tag) AS t FROM hits) GROUP BY id, ip
   UNION ALL SELECT id, 7, '  - Associated FQDNs (' || count(*) || ')' FROM ar GROUP BY id, ip
   UNION ALL SELECT id, 7, '    - ' || name || CASE WHEN rank = 0 THEN ' (ptr)' ELSE '' END FROM ar WHERE place <= 25
   UNION ALL SELECT id, 7, '    - ' || (count(*) - 25) || ' additional fqdn not listed here' FROM ar GROUP BY id, ip HAVING count(*) > 25
   UNION ALL SELECT id, 8, unnest(['', '## Disclaimer', '', '""" + RR.DISCLAIMER + """', '']) FROM fine) GROUP BY ALL"""


def _due_run(spark, sf_dir):
    kinds = table(spark, sf_dir, "events").select(F.col("event_type").alias("e"), (F.col("user_id") % 20).alias("n")).distinct()
    query_text = F.expr(
        """CASE WHEN n % 4 = 0 THEN 'http_title:"' || e || ' portal ' || n || '"'
           WHEN n % 4 = 1 THEN 'tag:soft:' || e || ' tag:lang:l' || (n % 3) || ' OR http_server.bg:' || e || '/' || (n % 10) || ' port.nt:' || n
           WHEN n % 4 = 2 THEN 'banner.lk:"' || e || ' ready ' || n || '"' WHEN n % 8 = 3 THEN 'http_headval:x-powered-by.lk:' || (n % 9)
           ELSE 'colour:' || n END"""
    )
    reports = kinds.select(
        F.expr("e || '-' || n").alias("id"), F.expr("'Report ' || e || '-' || n").alias("name"), F.lit("").alias("description"),
        query_text.alias("query"), (F.col("e") != "error").alias("active"), F.lit(1).alias("schedule_day"), F.lit(6).alias("schedule_hour"),
        F.when(F.col("n") % 5 == 0, "once").otherwise("Monthly").alias("schedule_type"),
        F.when(F.col("e") == "click", F.lit("2024-01-20 00:00:00")).cast("timestamp").alias("last_run_at"),
        F.lit("2024-01-30 06:00:00").cast("timestamp").alias("next_run_at"),
    )
    return RR.run_reports(documents(spark, sf_dir), reports, dt.datetime(2024, 1, 31), _bodies(spark, sf_dir))


@query("R15_report_batch", with_docs(_R15_SQL + _R15_HITS_SQL + _R15_LINES_SQL))
def r15(spark, sf_dir):
    """Lines of all due reports, from one pass over the documents; their order is checked in the tests."""
    return _due_run(spark, sf_dir).lines.groupBy("report_id", "section", "line").agg(F.count("*").alias("n"))


@query(
    "R15_report_outcome",
    with_docs(
        f"""{_R15_SQL}, a AS (SELECT e || '-' || n AS id, e, n FROM r) SELECT a.id, CASE WHEN e = 'error' THEN 'not due' WHEN n % 8 = 7 THEN 'failed' ELSE 'done' END AS status,
 CASE WHEN e = 'error' OR n % 8 = 7 THEN CASE WHEN e = 'click' THEN TIMESTAMP '2024-01-20 00:00:00' END ELSE TIMESTAMP '2024-01-31 00:00:00' END AS last_run_at,
 CASE WHEN e = 'error' OR n % 8 = 7 THEN TIMESTAMP '2024-01-30 06:00:00' ELSE TIMESTAMP '2024-02-01 06:00:00' END AS next_run_at FROM a"""
    ),
)
def r15_outcome(spark, sf_dir):
    """A report that cannot be read fails alone and keeps its times; the others advance."""
    run = _due_run(spark, sf_dir)
    out = run.reports.join(run.outcome, "id", "left").select("id", F.coalesce("status", F.lit("not due")).alias("status"), "last_run_at", "next_run_at")
    return _ntz(out, "last_run_at", "next_run_at")
