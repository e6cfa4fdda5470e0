"""Repeated and blank uids in updates and rules."""

from __future__ import annotations

from vantage.operators import store


def test_repeated_update_keeps_one_document(spark):
    docs = spark.createDataFrame([("a", ["x"]), ("b", ["y"])], "uid string, tag array<string>")
    updates = spark.createDataFrame([("a", ["one"], 1), ("a", ["two"], 2), ("a", ["old"], 0), ("", ["z"], 1)], "uid string, tag array<string>, at int")
    got = sorted(map(tuple, store.replace_field(docs, "tag", updates, "at").collect()))
    assert got == [("a", ["two"]), ("b", ["y"])]
    postings = spark.createDataFrame([("tag", "x", "a"), ("tag", "y", "b"), ("port", "80", "a")], "field string, value string, uid string")
    got = sorted(map(tuple, store.replace_postings(postings, "tag", updates, "at").collect()))
    assert got == [("port", "80", "a"), ("tag", "two", "a"), ("tag", "y", "b")]


def test_repeated_snapshot_row_keeps_one_document(spark):
    docs = spark.createDataFrame([("a", 5, 6, ["n"])], "uid string, first_seen long, last_seen long, tag array<string>")
    snapshot = spark.createDataFrame([("a", 1, 7, ["p"]), ("a", 3, 9, ["q"])], "uid string, first_seen long, last_seen long, tag array<string>")
    assert [tuple(r) for r in store.rebuild(docs, snapshot, retag=False).collect()] == [("a", 1, 9, ["q"])]
