"""The percolation index against a loop over rules and documents, and the reader of rule files."""

from __future__ import annotations

import ipaddress
import random

import pytest

from vantage.operators import percolate as P
from vantage.operators import rules as G
from vantage.schema import OBSERVED_FIELDS
from vantage.sources.rules import read_record

FIELDS = ("http_title", "http_server", "banner")
WORDS = ["nginx", "ng", "n", "漢字 x", "Portal 7", "portal 71", "  padded ", "a\nb", "🎉!", "x" * 50, "portal", "ortal 7", ""]


def documents(spark, rows):
    columns = ", ".join(f"{f} array<string>" for f in OBSERVED_FIELDS)
    full = [(uid, ip, None, *[values.get(f, []) for f in OBSERVED_FIELDS], []) for uid, ip, values in rows]
    return spark.createDataFrame(full, f"uid string, ip string, ip_key string, {columns}, tag array<string>")


def holds(values, ip, field, op, needle):
    if field == "net":
        return ipaddress.ip_address(ip) in ipaddress.ip_network(needle, strict=False)
    own = {v.strip().lower() for v in values.get(field, []) if v.strip()} if field != "ip" else {ip}
    return any(v == needle if op in ("exact", "not") else v.startswith(needle) if op == "begin" else needle in v for v in own)


def slow(rows, terms):
    groups, found = {}, set()
    for rule, grp, _, field, op, value in terms:
        groups.setdefault((rule, grp), []).append((field, op, value.strip().lower()))
    for (rule, _), members in groups.items():
        if any(not v or f == "tag" or (f == "net" and not _net(v)) for f, _, v in members):
            continue
        for uid, ip, values in rows:
            if all(holds(values, ip, f, op, v) != (op == "not") for f, op, v in members):
                found.add((uid, rule))
    return found


def _net(text):
    try:
        return ipaddress.ip_network(text, strict=False)
    except ValueError:
        return None


def test_equals_loops(spark):
    rng = random.Random(8)
    rows = []
    for i in range(120):
        ip = f"8.8.{i % 5}.{i}" if i % 3 else f"2a00::{i:x}"
        rows.append((f"u{i}", ip, {f: rng.sample(WORDS, rng.randint(0, 3)) for f in FIELDS}))
    terms = []
    for r in range(150):
        for g in range(rng.randint(1, 2)):
            for t in range(rng.randint(1, 3)):
                kind = rng.random()
                if kind < 0.15:
                    field, op, value = "net", rng.choice(["exact", "not"]), rng.choice(["8.8.1.0/24", "8.8.0.7/22", "2a00::/120", "::/0", "0.0.0.0/0", "no net", "8.8.2.2"])
                elif kind < 0.2:
                    field, op, value = "ip", rng.choice(["exact", "begin", "like", "not"]), rng.choice(["8.8.1.1", "8.8", "::", "2a00::3"])
                else:
                    word = rng.choice(WORDS)
                    a = rng.randint(0, len(word))
                    field, op = rng.choice(FIELDS), rng.choice(["exact", "begin", "like", "like", "not"])
                    value = word if op in ("exact", "not") else word[:a + 1] if op == "begin" else word[a // 2:a + 1]
                terms.append((f"r{r}", g, t, field, op, value))
    terms += [("tagged", 0, 0, "tag", "exact", "a:b"), ("half", 0, 0, "tag", "exact", "a:b"), ("half", 1, 0, "banner", "like", "r")]
    table = spark.createDataFrame(terms, G.TERM_SCHEMA)
    got = {tuple(r) for r in G.matched_rules(documents(spark, rows), table).collect()}
    assert got == slow(rows, terms)


def test_index_without_rules_or_documents(spark):
    docs = documents(spark, [("u", "8.8.8.8", {"banner": ["x"]})])
    none = spark.createDataFrame([], G.TERM_SCHEMA)
    one = spark.createDataFrame([("r", 0, 0, "banner", "like", "x")], G.TERM_SCHEMA)
    assert G.matched_rules(docs, none).count() == 0
    assert G.matched_rules(docs.limit(0), one).count() == 0
    assert [tuple(r) for r in G.matched_rules(docs, one).collect()] == [("u", "r")]


def test_like_terms_are_filed_under_their_rarest_gram(spark):
    terms = [(f"r{i}", 0, 0, "banner", "like", f"portal {i}") for i in range(100, 140)] + [("s", 0, 0, "banner", "like", "ab")]
    index = P.compile_rules(spark.createDataFrame(terms, G.TERM_SCHEMA))
    filed = {r["needle"]: r["key"] for r in index.filed.collect()}
    assert filed["portal 137"] == "g137" and filed["ab"] == "gab" and len(filed) == 41
    shapes = index.shapes.collect()
    assert [(r["field"], r["grams"]) for r in shapes] == [("banner", [2, 3])]


def test_plan_has_no_join_on_a_field_alone(spark):
    terms = spark.createDataFrame([("r", 0, 0, "banner", "like", "x"), ("r", 0, 1, "net", "not", "8.0.0.0/8")], G.TERM_SCHEMA)
    docs = documents(spark, [("u", "8.8.8.8", {"banner": ["x"]})])
    path = spark.conf.get("spark.checkpoint.dir") + "/percolate-docs"
    docs.write.mode("overwrite").parquet(path)
    plan = P.percolate(spark.read.parquet(path), P.compile_rules(terms))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("percolate-docs") <= 2 and "NestedLoop" not in plan and "Cartesian" not in plan


def test_rules_alike_leave_the_last_join_unshuffled(spark):
    terms = [(f"a{i}", 0, 0, "banner", "like", "x") for i in range(200)]
    terms += [(f"b{i}", g, 0, "banner", "like", v) for i in range(200) for g, v in enumerate(("x", "y"))]
    rules = [(r, i, True, r, "q", [f"rule:{r}", "soft:all"], "") for i, r in enumerate(sorted({t[0] for t in terms}))]
    docs = documents(spark, [(f"u{i}", "8.8.8.8", {"banner": [v]}) for i, v in enumerate(["x", "xy", "y", "z"] * 5)])
    index = P.compile_rules(spark.createDataFrame(terms, G.TERM_SCHEMA))
    assert P.bundle_hits(docs, index).distinct().count() == 25  # x and xy match both kinds of rules, y one
    pairs = [tuple(r) for r in P.percolate(docs, index).collect()]
    assert len(pairs) == len(set(pairs)) == 10 * 400 + 5 * 200
    tags = {r["uid"]: r["tag"] for r in G.apply_rules(docs, spark.createDataFrame(rules, G.RULE_SCHEMA), spark.createDataFrame(terms, G.TERM_SCHEMA)).collect()}
    every = ["rule:a0", "soft:all", *(f"rule:{r[0]}" for r in rules[1:])]
    assert tags["u0"] == tags["u1"] == every and "u3" not in tags
    assert tags["u2"] == ["rule:b0", "soft:all", *(t for t in every if t.startswith("rule:b") and t != "rule:b0")]


FILES = [
    "description: Plain words\nquery: port:80 OR http_title.lk:login\ntags:\n- a:b\n- 'c:d e'\nversion: 20260520T133458Z\n",
    'description: "Quoted: \\"x\\" \\u00e9\\xe9"\nquery: "http_title:\\"a\n  b\\" \\\n  port:1"\ntags:\n  - "x:\\ty"\n  - plain # comment\n',
    "description: 'it''s'\nquery: http_server:\"a b\"\n  OR port:1\n  OR port:2\ntags: [a:b, 'c:d', \"e,f\"]\nactive: false\n",
    "description: |\n  two\n  lines\nquery: >-\n  port:1\n  OR port:2\ntags:\n- one:two\n  three\n",
    "# head\n---\ndescription: x\n\nquery: port:1\ntags: []\n",
    "description: x\nquery: 'a\n\n  b'\ntags: single:tag\n",
]


@pytest.mark.parametrize("text", FILES)
def test_rule_files_read_as_yaml(text):
    yaml = pytest.importorskip("yaml")
    want = yaml.load(text, Loader=yaml.BaseLoader)
    got = read_record(text)
    assert {k: v for k, v in got.items() if v is not None} == {k: v for k, v in want.items() if v != ""}


@pytest.mark.parametrize("text", ["", "just words", "- a\n- b", 'query: "open', "query: 'open", "query: {a: b}", "query: a: b"])
def test_unreadable_rule_files(text):
    assert read_record(text) is None
