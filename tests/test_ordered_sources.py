"""Sources that keep the order of files and lines, and pairs without a state against a loop."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vantage.operators import coverage as L
from vantage.session import local_table
from vantage.sources import lists as LI
from vantage.sources import sinks


@pytest.fixture
def small_splits(spark):
    """Splits of a few lines, so a file is read by many tasks; larger files first, as the scan packs them."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_targets_in_file_order(spark, small_splits, tmp_path):
    sizes = {"a": 40, "b": 300, "c": 7, "d": 120}
    for name, n in sizes.items():
        (tmp_path / f"{name}.txt").write_text("".join(f" {name}{i}.example.com \n" for i in range(n)))
    rows = LI.read_target_list(spark, str(tmp_path)).collect()
    assert [r.value for r in sorted(rows, key=lambda r: r.ord)] == [f"{name}{i}.example.com" for name, n in sizes.items() for i in range(n)]
    assert len({r.ord for r in rows}) == len(rows)


def test_bulk_entries_in_line_order(spark, small_splits, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"\"x{3 * i}\",\rx{3 * i + 1};\r\r 'x{3 * i + 2}'\n" for i in range(90)), newline="")
    rows = LI.read_target_list(spark, str(tmp_path), bulk=True).orderBy("ord").collect()
    assert [r.value for r in rows] == [f"x{i}" for i in range(270)]


def test_last_row_of_many_files_wins(spark, small_splits, tmp_path):
    rng, last = random.Random(1), {}
    for name, n in (("a", 10), ("b", 200), ("c", 3), ("d", 90)):
        lines = ["uid,ip,first_seen,last_seen"]
        for _ in range(n):
            uid, first = f"u{rng.randrange(40)}", rng.choice([str(rng.randrange(1, 10**9)), "bad", ""])
            lines.append(f"{uid},8.8.8.8,{first},5")
            if first.isdecimal():
                last[uid] = int(first)
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    docs = spark.range(40).select(F.concat(F.lit("u"), "id").alias("uid"), F.lit(7).cast("bigint").alias("first_seen"), F.lit(8).cast("bigint").alias("last_seen"))
    out, _ = sinks.import_first_seen(docs, LI.read_first_seen(spark, str(tmp_path)))
    assert {r.uid: r.first_seen for r in out.collect()} == {f"u{i}": last.get(f"u{i}", 7) for i in range(40)}


def test_passive_dns_in_answer_order(spark, small_splits, tmp_path):
    for name in ("8.8.8.8", "9.9.9.9"):
        (tmp_path / f"{name}.ndjson").write_text("".join(f'{{"rrtype":"A","rrname":"n{i}.{name[0]}.org"}}\n' for i in range(120)))
    rows = LI.read_pdns(spark, str(tmp_path)).orderBy("ip", "seq").collect()
    assert [(r.ip, r.fqdn) for r in rows] == [(ip, f"n{i}.{ip[0]}.org") for ip in ("8.8.8.8", "9.9.9.9") for i in range(120)]


@pytest.mark.parametrize("everywhere", [[], [1, 5]])
def test_missing_states_equal_a_loop(spark, everywhere):
    rng = random.Random(4)
    targets = [(i, i % 3 > 0) for i in range(60)] + [(1, True)]
    profiles = [(p, p in everywhere) for p in range(8)]
    links = [(rng.randrange(8), rng.randrange(70)) for _ in range(200)]
    states = [(rng.randrange(70), rng.randrange(9)) for _ in range(200)]
    tables = (
        local_table(spark, targets, "id bigint, active boolean"), local_table(spark, profiles, "id bigint, apply_to_all boolean"),
        local_table(spark, links, "profile_id bigint, target_id bigint"), local_table(spark, states, "target_id bigint, profile_id bigint"),
    )
    found = [(r.profile_id, r.target_id) for r in L.missing_states(*tables).collect()]
    active = {i for i, on in targets if on}
    wanted = {(p, t) for p, t in links if t in active} | {(p, t) for p in everywhere for t in active}
    assert sorted(found) == sorted(wanted - {(p, t) for t, p in states})
    empty = tuple(t.limit(0) for t in tables)
    assert L.missing_states(*empty).collect() == []
