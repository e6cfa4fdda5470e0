"""Work that is done once a document, and tasks and files whose size does not follow the table."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

import catalog
from catalog import base, stream_queries
from tests.test_fixtures import documents
from vantage import session
from vantage.functions import text as T
from vantage.operators import percolate as P
from vantage.operators import report as R
from vantage.operators import report_runs as RR
from vantage.session import local_table

HITS = (
    "report string, ip string, uid string, port array<string>, tag array<string>, fqdn_requested array<string>, now boolean, before boolean, recent boolean"
)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_values_are_cleaned_once_and_looked_up_as_written(spark):
    docs = documents(spark, [{"uid": "a", "ip": "8.8.0.1", "port": [" 80 "], "tag": ["soft:X"]}, {"uid": "b", "ip": "8.8.0.2", "port": ["81"]}])
    terms = [("r", 0, "port", "exact", "80"), ("r", 0, "tag", "begin", "soft:"), ("s", 0, "port", "begin", "8")]
    index = P.compile_rules(local_table(spark, terms, "rule string, grp int, field string, op string, value string"), searches=True)
    hits = P.term_hits(docs, index)
    assert "btrim" not in _plan(hits).lower() and "regexp_replace" not in _plan(hits) and "BroadcastHashJoin" in hits._jdf.queryExecution().sparkPlan().toString()
    assert {(r.uid, r.rule) for r in P.percolate(docs, index).collect()} == {("a", "r"), ("a", "s"), ("b", "s")}


def test_hosts_take_one_row_a_hit(spark):
    rows = [
        ("r", "1.1.1.1", "a", [" 80", "443", None, " "], ["B:x", "a:y"], None, True, True, False),
        ("r", "1.1.1.1", "b", ["443", "22", "x"], ["a:y"], None, True, False, False),
        ("r", "1.1.1.1", "c", ["22"], None, None, False, True, False),
        ("r", "1.1.1.2", "d", None, None, None, True, None, False),
        ("r", "1.1.1.3", "e", ["1"], None, None, False, True, False),
    ]
    hosts = RR.report_hosts(local_table(spark, rows, HITS))
    assert "Generate" not in _plan(hosts)
    found = {r.ip: (r.scans, r.ports, r.gained, r.tags) for r in hosts.collect()}
    assert found == {"1.1.1.1": (2, ["22", "80", "443", "x"], ["x"], ["a:y", "B:x"]), "1.1.1.2": (1, [], [], [])}


def test_associated_names_are_merged_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(RR, "materialize", lambda df, name: written.append(name) or session.materialize(df, name))
    run = ("r", "n", "", "q", "a", "b", 0, 9, None, None, 0)
    hits = local_table(spark, [("r", "1.1.1.1", "a", ["80"], [], ["b.x", "a.x"], True, False, False)], HITS)
    lines = [r.line for r in RR.lines_of(local_table(spark, [run], RR.RUN_SCHEMA), hits).collect()]
    assert written.count("report-associated") == 1
    assert [x for x in lines if x.startswith("    - ")] == ["    - a.x", "    - b.x"]


def test_names_of_a_body_are_made_once(spark):
    body = "struct<hostnames:array<struct<name:string,hostname:string,type:string>>>"
    rows = [("a", {"hostnames": [("", "A.b.", "PTR"), ("1.2.3.4", None, "ptr"), ("2a00::1.2.3.4", None, "PTR"), ("x.y", None, "user"), None]}), ("b", {"hostnames": None})]
    names = R.ptr_names(spark.createDataFrame(rows, f"id string, body {body}"))
    assert _plan(names).count("^[0-9.]+$|:") == 1 and [tuple(r) for r in names.collect()] == [("a", "a.b")]


def test_list_values_are_trimmed_as_single_ones(spark):
    values = ["a  ", " a\u0085", "a \u2028", " a\u00a0", "a \u2029\n", "\t\x0b a\f\r\n", " ", "", None, "\u00c9 \u0085"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    for r in df.select(F.lower(T.clean("v")).alias("one"), T.clean_list(F.array("v")).alias("many")).collect():
        assert r.many == ([r.one] if r.one else [])


def test_a_task_reads_little_unless_the_session_says_otherwise(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    own = spark.newSession()
    catalog.load()[0]["R13_summary"](own, "/root/testdata/sf0.001")
    assert own.conf.get(key) == "16m"
    other = spark.newSession()
    other.conf.set(key, "8m")
    assert session.bound_reads(other).conf.get(key) == "8m"


def test_result_files_follow_the_rows_and_batches_do_not(spark, monkeypatch):
    seen, start = [], stream_queries.J.start_ingest

    def started(spark, incoming, store, checkpoint, config, max_files):
        seen.append((len([n for n in os.listdir(incoming) if n.startswith("part-")]), max_files))
        return start(spark, incoming, store, checkpoint, config, max_files=max_files)

    monkeypatch.setattr(stream_queries, "RESULT_FILE_EVENTS", 300)
    monkeypatch.setattr(stream_queries.J, "start_ingest", started)
    events = base.table(spark, "/root/testdata/sf0.001", "events").count()
    base.QUERIES["M1_incremental_ingest"](spark, "/root/testdata/sf0.001").count()
    half = -(-events // 300)
    assert half > 2 and seen == [(2 * half, half)]
