"""Reports in one pass: hits against single searches, order, isolation, kinds of schedule, plans that do not grow."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.test_fixtures import documents
from vantage.operators import percolate as P
from vantage.operators import report_runs as RR
from vantage.operators import search as S
from vantage.session import local_table

TERMS = [
    "ip:8.8.0.3", "ip.nt:8.8.0.3", "net:8.8.0.0/30", "net:bad", "net.nt:bad", "net.lk:9.0.0.0/8", "net.nt:2a00::/32", "net:2a00::/126",
    "ip:2a00::1", "tag:soft:x", "tag:", "port:80", "port.nt:80", "port.lk:8", "port.bg:", "port.lk:", "port.nt:", "banner.lk:'ready 4'",
    "banner.bg:220", "banner:'220 ready 4'", "http_headval:server.lk:gin", "http_headval:server.bg:ng", "http_headval:server:nginx/1",
    "http_headval:x.lk:server", f"http_headval:{'h' * 200}.lk:nginx", "http_server.lk:ngi", "http_server.lk:漢", "fqdn_requested.bg:a.",
]
REPORT_SCHEMA = (
    "id bigint, name string, description string, query string, active boolean, schedule_day int, schedule_hour int, "
    "schedule_type string, last_run_at timestamp, next_run_at timestamp"
)
NOW = dt.datetime(2024, 1, 31)
SECONDS = 1_706_000_000  # 2024-01-23


def _rows():
    rng = random.Random(3)
    rows = []
    for i in range(80):
        rows.append({
            "uid": f"u{i}", "ip": f"8.8.{i % 3}.{i % 7}" if i % 4 else f"2a00::{i % 9:x}", "port": rng.sample(["80", "8080", "443", "x"], rng.randint(0, 2)),
            "banner": rng.sample(["220 ready 4", "ready 44", "220"], rng.randint(0, 2)), "tag": rng.sample(["soft:x", "lang:y"], rng.randint(0, 2)),
            "http_headval": rng.sample(["server:nginx/1", "server:gin", "x:server", "x-server:nginx"], rng.randint(0, 2)),
            "http_server": rng.sample(["nginx", "漢字"], rng.randint(0, 1)), "fqdn_requested": rng.sample(["a.b.c", "B.c."], rng.randint(0, 2)),
            "first_seen": SECONDS - 3_000_000 * (i % 3), "last_seen": SECONDS - 2_000_000 * (i % 3),
        })
    many = {"uid": "many", "ip": "8.8.0.5", "port": ["80"], "fqdn_requested": [f"m{n}.org" for n in range(30)]}
    return [*rows, {**many, "first_seen": SECONDS, "last_seen": SECONDS}]


def _reports(spark, rows):
    start = dt.datetime(2024, 1, 30)
    full = [(i, f"R{i}", "", q, True, 1, 6, kind, None, start) for i, (q, kind) in enumerate(rows)]
    return spark.createDataFrame(full, REPORT_SCHEMA)


def test_hits_equal_single_searches(spark):
    docs = documents(spark, _rows()).cache()
    rng = random.Random(5)
    queries = [*TERMS, *(" ".join(rng.sample(TERMS, rng.randint(2, 3))) for _ in range(30))]
    queries += [f"{a} OR {b}" for a, b in (rng.sample(queries, 2) for _ in range(10))]
    parsed = [S.search_terms(q) for q in queries]
    terms = [(str(i), g, f, op, v) for i, groups in enumerate(parsed) for g, group in enumerate(groups) for f, op, v in group]
    index = P.compile_rules(local_table(spark, terms, "rule string, grp int, field string, op string, value string"), searches=True)
    found = {(r.uid, r.rule) for r in P.percolate(docs, index).collect()}
    flags = docs.select("uid", *[F.coalesce(S.any_of(groups), F.lit(False)).alias(f"q{i}") for i, groups in enumerate(parsed)]).collect()
    for i, query in enumerate(queries):
        assert {u for u, r in found if r == str(i)} == {r.uid for r in flags if r[f"q{i}"]}, query
    assert len(found) > 500


def test_batch_equals_single_reports(spark):
    docs = documents(spark, _rows())
    bodies = spark.range(80).select(
        F.concat(F.lit("u"), "id").alias("id"),
        F.struct(F.array(F.struct(F.concat(F.lit("P"), "id", F.lit(".net.")).alias("name"), F.lit("").alias("hostname"), F.lit("ptr").alias("type"))).alias("hostnames")).alias("body"),
    )
    pdns = local_table(spark, [("8.8.0.3", s, f"n{s % 40}.org") for s in range(80)] + [("8.8.1.1", 1, "a.b.c")], "ip string, seq bigint, fqdn string")
    given = [("port.lk:8", "Monthly"), ("net:8.8.0.0/16", "once"), ("port:9999", "monthly"), ("colour:x", "monthly"), ("'", "monthly"), ("", "monthly"), (None, "monthly")]
    run = RR.run_reports(docs, _reports(spark, given), NOW, bodies, pdns)
    lines = run.lines.collect()
    end, start, before = (int(dt.datetime(*d, tzinfo=dt.timezone.utc).timestamp()) for d in ((2024, 1, 31), (2023, 12, 31), (2023, 11, 30)))
    shown = ("2023-12-31 00:00:00 UTC", "2024-01-31 00:00:00 UTC")
    cutoff = int(dt.datetime(2023, 7, 31, tzinfo=dt.timezone.utc).timestamp())
    for i, (query, kind) in enumerate(given[:3]):
        previous = None if kind == "once" else (before, start)
        alone = RR.report_lines(docs, {"name": f"R{i}", "description": "", "query": query}, (start, end), previous, shown, bodies, pdns, cutoff)
        mine = [r.line for r in lines if r.report_id == i]
        assert mine == [r.line for r in alone.collect()]
        assert ("## New opened port" in mine) == (kind != "once")
        assert mine[0] == f"# R{i}" and mine.index("## Open Ports") < mine.index("## Hosts") < mine.index("## Disclaimer")
    assert any("additional fqdn not listed here" in r.line for r in lines) and any(r.line.endswith("(pdns)") for r in lines)
    outcome = {r.id: (r.status, r.reason) for r in run.outcome.collect()}
    assert [outcome[i][0] for i in range(7)] == ["done"] * 3 + ["failed"] * 4 and all(outcome[i][1] for i in (3, 4, 5, 6))
    assert {r.report_id for r in lines} == {0, 1, 2}
    times = {r.id: (r.last_run_at, r.next_run_at) for r in run.reports.collect()}
    assert times[0] == (NOW, dt.datetime(2024, 2, 1, 6)) and times[3] == (None, dt.datetime(2024, 1, 30))


def test_no_due_report(spark):
    docs = documents(spark, _rows())
    run = RR.run_reports(docs, _reports(spark, []), NOW)
    assert run.lines.collect() == [] and run.outcome.collect() == [] and run.reports.collect() == []
    none = RR.run_reports(docs.limit(0), _reports(spark, [("port:80", "monthly")]), NOW)
    assert "No matching hosts." in [r.line for r in none.lines.collect()]


@pytest.mark.parametrize("count", [2, 60])
def test_plan_does_not_grow(spark, count):
    run = RR.run_reports(documents(spark, _rows()), _reports(spark, [(TERMS[i % 8], "monthly") for i in range(count)]), NOW)
    plan = run.lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 16 and plan.count("LocalRelation") == 0
