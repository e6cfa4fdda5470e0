"""The store: order of batches, runs that start over, compaction, pruned files."""

from __future__ import annotations

import uuid

import pytest

from vantage.operators import store as ST
from vantage.plans import ingest as I
from vantage.plans.manifest import Manifest, change_manifest, read_manifest

SCHEMA = "uid string, ip_key string, first_seen long, last_seen long, port array<string>, tag array<string>"


@pytest.fixture
def store(spark):
    return f"{spark.conf.get('spark.checkpoint.dir')}/store-{uuid.uuid4().hex}"


def docs(spark, *rows):
    return spark.createDataFrame([(u, f"0808{int(u):04x}", f, last, [p], ["t"] if p == "old" else []) for u, f, last, p in rows], SCHEMA)


def state(spark, store, **options):
    return {r["uid"]: (r["first_seen"], r["last_seen"], r["port"][0], r["tag"]) for r in I.current_documents(spark, store, **options).collect()}


def test_newer_batch_wins_over_newer_time(spark, store):
    I.append_documents(docs(spark, ("1", 100, 100, "old"), ("2", 5, 6, "old")), store, 0)
    I.append_documents(docs(spark, ("1", 90, 90, "new"), ("1", 80, 85, "older")), store, 1)
    want = {"1": (80, 100, "new", []), "2": (5, 6, "old", ["t"])}
    assert state(spark, store) == want
    I.append_documents(docs(spark, ("1", 90, 90, "new"), ("1", 80, 85, "older")), store, 1)  # a repeated batch
    assert state(spark, store) == want
    I.compact(spark, store)
    assert state(spark, store) == want and read_manifest(spark, store).generations == []
    I.append_documents(docs(spark, ("2", 1, 2, "third"), ("3", 7, 7, "x")), store, 0)  # batch 0 again, after the base
    assert state(spark, store) == {**want, "2": (1, 6, "third", []), "3": (7, 7, "x", [])}
    I.compact(spark, store, files=2)
    assert state(spark, store)["2"] == (1, 6, "third", [])


def test_fresh_run_overwrites_nothing(spark, store):
    I.append_documents(docs(spark, ("1", 1, 1, "a")), store, 0, "one")
    I.append_documents(docs(spark, ("2", 1, 1, "b")), store, 0, "two")
    I.append_documents(docs(spark, ("1", 2, 2, "c")), store, 1, "one")
    assert {u: v[2] for u, v in state(spark, store).items()} == {"1": "c", "2": "b"}


def test_batch_closed_by_a_compaction_is_written_again(spark, store):
    I.append_documents(docs(spark, ("1", 1, 1, "a")), store, 0)
    folders = []

    def write(folder):
        folders.append(folder)
        docs(spark, ("1", 1, 1, f"try{len(folders)}")).write.mode("overwrite").parquet(f"{folder}/index/batch=1")
        if len(folders) == 1:
            I.compact(spark, store)

    I._append(spark, store, "ingest", write)
    assert len(set(folders)) == 2 and state(spark, store)["1"][2] == "try2"


def test_manifest_versions_never_collide(spark, store):
    def racing(m: Manifest) -> Manifest:
        if m.version == 0:  # another writer comes first
            change_manifest(spark, store, lambda x: Manifest(runs={"other": 0}, generations=[0], next=1))
        return Manifest(base=m.base, generations=[*m.generations, m.next], runs={**m.runs, "mine": m.next}, next=m.next + 1)

    new = change_manifest(spark, store, racing)
    assert new.version == 2 and new.runs == {"other": 0, "mine": 1} == read_manifest(spark, store).runs


def test_address_search_opens_few_files(spark, store):
    rows = spark.range(4000).selectExpr(
        "CAST(id AS STRING) AS uid", "lower(lpad(hex(134742016 + id), 8, '0')) AS ip_key", "1700000000 + (id * 7919) % 5000000 AS first_seen",
        "1700000000 + (id * 7919) % 5000000 AS last_seen", "array('80') AS port", "CAST(array() AS ARRAY<STRING>) AS tag",
    )
    I.append_documents(rows, store, 0)
    I.compact(spark, store, files=24)
    every, some = I.current_documents(spark, store), I.current_documents(spark, store, ("08080010", "0808001f"))
    assert len(every.inputFiles()) == 24 and 0 < len(some.inputFiles()) <= 4
    assert sorted(r["ip_key"] for r in some.collect()) == [f"080800{i:02x}" for i in range(16, 32)]
    assert I.current_documents(spark, store, ("09000000", "09ffffff")).count() == 0


def test_repeated_uids_on_both_sides(spark):
    old = docs(spark, ("1", 1, 5, "old"), ("1", 2, 9, "old"), ("3", 1, 1, "old"))
    new = docs(spark, ("1", 3, 4, "new"), ("1", 2, 3, "older"), ("2", 1, 1, "new"))
    got = {r["uid"]: (r["first_seen"], r["last_seen"], r["port"][0]) for r in ST.upsert_docs(old, new).collect()}
    assert got == {"1": (1, 9, "new"), "2": (1, 1, "new"), "3": (1, 1, "old")} and ST.upsert_docs(old, new).count() == 3


def test_postings_leave_no_old_field(spark, store):
    one = spark.createDataFrame([("tag", "x", "1"), ("port", "80", "1")], "field string, value string, uid string")
    ST.write_postings(one, store)
    ST.write_postings(one.filter("field = 'port'"), store)
    assert [r["field"] for r in spark.read.parquet(store).collect()] == ["port"]


def test_documents_are_sorted_after_they_are_dealt(spark, store):
    plan = ST.latest_per_uid(docs(spark, ("1", 1, 2, "x")))._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = next(n for n, line in enumerate(plan) if "Exchange hashpartitioning(uid" in line)
    assert any("Sort" in line for line in plan[:dealt]) and not any("Sort" in line for line in plan[dealt:])


def test_compaction_cuts_ranges_of_many_documents(spark, store, monkeypatch):
    I.append_documents(docs(spark, *[(str(n), n, n, "x") for n in range(400)]), store, 0)
    monkeypatch.setattr(I, "FILE_ROWS", 40)
    I.compact(spark, store, files=2)
    written = spark.read.parquet(f"{store}/{read_manifest(spark, store).base}/files").collect()
    assert len(written) > 5 and max(r["rows"] for r in written) < 200 and sum(r["rows"] for r in written) == 400
