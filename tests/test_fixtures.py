"""Literal inputs with known results."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from vantage.functions import netaddr as N
from vantage.functions import text as T
from vantage.functions import times as M
from vantage.operators import extract as E
from vantage.operators import ranges as K
from vantage.operators import report_runs as RR
from vantage.operators import rules as G
from vantage.operators import search as S
from vantage.operators import shape as H
from vantage.plans import ingest
from vantage.schema import FIELDS
from vantage.session import local_table
from vantage.sources import scans as SC


def documents(spark, rows):
    """Searchable documents with only some fields given."""
    schema = "uid string, ip string, first_seen bigint, last_seen bigint, " + ", ".join(f"{f} array<string>" for f in FIELDS)
    data = [
        (r["uid"], r["ip"], r.get("first_seen", 0), r.get("last_seen", 0), *[r.get(f, []) for f in FIELDS]) for r in rows
    ]
    df = local_table(spark, data, schema)
    return df.select("*", N.ipv4_num("ip").alias("ip_num"), N.address_key("ip").alias("ip_key"))


MAIL_AND_WEB = [
    {"uid": "mail", "ip": "203.0.113.25", "banner": ["220 relay ready"], "port": ["25", "587"], "tag": ["soft:smtp"]},
    {"uid": "shop", "ip": "198.51.100.9", "http_server": ["caddy v2"], "http_title": ["spring sale"], "port": ["443"], "fqdn": ["shop.example.org"]},
    {"uid": "shop-old", "ip": "198.51.100.9", "http_server": ["caddy v1", "proxy:caddy"], "http_title": ["autumn sale"], "port": ["8443"]},
    {"uid": "camera", "ip": "198.51.100.70", "http_title": ["login"], "http_cookiename": ["sid", "lang"], "port": ["443", "554"]},
]


@pytest.mark.parametrize(
    "query, expected",
    [
        ("http_server.bg:caddy", {"shop", "shop-old"}),
        ("http_server.bg:caddy port:443", {"shop"}),
        ("http_server:caddy", set()),
        ("http_server.lk:proxy", {"shop-old"}),
        ("http_title.lk:sale net:198.51.100.0/26", {"shop", "shop-old"}),
        ("net:198.51.100.64/26", {"camera"}),
        ("ip:203.0.113.25 net:198.51.100.64/26", {"mail", "camera"}),
        ("port:443 http_cookiename:sid OR banner.begin:'220 relay'", {"camera", "mail"}),
        ("port:443 fqdn.not:shop.example.org", {"camera"}),
        ("tag:soft:smtp", {"mail"}),
    ],
)
def test_search(spark, query, expected):
    found = documents(spark, MAIL_AND_WEB).filter(S.any_of(S.search_terms(query)))
    assert {r.uid for r in found.select("uid").collect()} == expected


def test_search_terms_keep_backslashes():
    groups = S.search_terms(r'banner.bg:"\FF\FF" http_title.lk:"index of"')
    assert groups == [[("banner", "begin", r"\ff\ff"), ("http_title", "like", "index of")]]
    for bad in ("nofield:1", "tag.lk:x", "port:1 OR", "http_headval:x"):
        with pytest.raises(ValueError):
            S.search_terms(bad)


def test_unit_counts(spark):
    rows = [("8.8.8.8", 1), ("example.com", 1), ("example.com.", 1), ("8.8.8.0/24", 256), ("8.8.8.8/24", 256), ("2000::/1", 2**63 - 1), ("", 1)]
    out = local_table(spark, rows, "v string, n bigint").select(N.unit_count("v").alias("u"), "n").collect()
    assert all(r.u == r.n for r in out)
    one = local_table(spark, [("8.8.8.0/25,example.com,1.1.1.1",)], "v string").select(N.unit_count_list("v")).first()[0]
    assert one == 130


def test_percent(spark):
    df = local_table(spark, [(150, 100, 100.0), (-1, 100, 0.0), (25, 100, 25.0), (3, 0, 0.0)], "d int, t int, p double")
    assert all(r.x == r.p for r in df.select(M.percent(F.col("d"), F.col("t")).alias("x"), "p").collect())


def test_ports(spark):
    df = local_table(spark, [(1, True), (65535, True), (0, False), (65536, False)], "v int, ok boolean")
    assert all(r.x == r.ok for r in df.select(T.is_port_number("v").alias("x"), "ok").collect())
    row = spark.range(1).select(T.protocol_label(F.lit(" tcp ")), T.port_protocol_key(F.lit(22), F.lit(1))).first()
    assert tuple(row) == ("TCP", "22:1")


@pytest.mark.parametrize(
    "value, covered", [("99.254.10.0/24", True), ("99.254.0.0/16", True), ("99.255.10.0/24", False)]
)
def test_coverage(spark, value, covered):
    targets = local_table(spark, [(1, "99.254.0.0/16")], "id int, value string")
    row = K.covering(local_table(spark, [(None, value)], "id int, value string"), targets).first()
    assert (row.covered_by is not None) == covered
    own = K.covering(local_table(spark, [(1, "99.254.0.0/16")], "id int, value string"), targets).first()
    assert own.covered_by is None


def _documents_of(spark, scan, config):
    values = local_table(spark, [(json.dumps(scan),)], "value string")
    raw = H.observed(H.split_ports(SC.scans(SC.split_bad(SC.items(ingest.text_values(values)))[0])))
    return raw, E.extract_with(raw, config)


@pytest.mark.parametrize(
    "host, suffix, header, value",
    [("alpha.example.com", "com", "X-Alpha", "A"), ("beta.example.net", "net", "X-Beta", "B")],
)
def test_configuration_stays_with_the_call(spark, host, suffix, header, value):
    scan = {
        "addr": "192.0.2.1", "endtime": "2026-05-19T00:00:00", "hostnames": [{"name": host, "type": "user"}],
        "ports": [{"portid": "80", "scripts": [{"id": "http-headers", "output": f"{header}: {value}\nX-Other: ignored\n"}]}],
    }
    _, docs = _documents_of(spark, scan, E.Config((suffix,), {header.lower(): True}))
    row = docs.first()
    assert row.fqdn_requested == [host]
    assert row.domain_requested == [host.split(".", 1)[1]]
    assert row.http_header == [header.lower()]
    assert row.http_headval == [f"{header.lower()}:{value.lower()}"]
    assert row.last_seen == 1779148800


def test_scan_with_every_script(spark):
    scan = {
        "addr": "192.0.2.10", "endtime": 1779148800000,
        "hostnames": [{"name": "Alpha.example.com", "type": "user"}, {"name": "ptr.example.com", "type": "PTR"}],
        "ports": [
            {"portid": 21, "scripts": [{"id": "banner", "output": "220 Welcome\n to FTP"}]},
            {
                "portid": 443, "hsh256": "old",
                "scripts": [
                    {"id": "http-favicon", "output": "Unknown favicon MD5: ABCDEF0123456789ABCDEF0123456789"},
                    {"id": "ssl-cert", "issuer": {"commonName": "ca.example.com"}, "md5": "AA", "extensions": {"X509v3 Subject Alternative Name": "DNS:san.example.com"}},
                    {"id": "http-mm-sha-favicon", "favicon-mmhash": -12, "output": "\n favicon_file: /f.ico\n|_ sha256: ab"},
                ],
            },
        ],
    }
    raw, docs = _documents_of(spark, scan, E.Config(("com",), {}))
    by_port = {r.port[0]: r for r in docs.collect()}
    assert by_port["21"].banner == ["220 welcome to ftp"]
    tls = by_port["443"]
    assert tls.http_favicon_md5 == ["abcdef0123456789abcdef0123456789"]
    assert tls.http_favicon_mmhash == ["-12"] and tls.http_favicon_path == ["/f.ico"] and tls.http_favicon_sha256 == ["ab"]
    assert set(tls.fqdn) == {"alpha.example.com", "ptr.example.com", "ca.example.com", "san.example.com"}
    assert tls.x509_issuer == ["ca.example.com"] and tls.x509_subject == []
    # the inner hash and line feeds in banners do not change the identity
    scan["ports"][1]["hsh256"] = "other"
    scan["ports"][0]["scripts"][0]["output"] = "220 Welcome to FTP"
    again, _ = _documents_of(spark, scan, E.Config(("com",), {}))
    assert {r.id for r in raw.collect()} == {r.id for r in again.collect()}


def test_banners_of_two_ports_accumulate(spark):
    port = lambda n, text: {"portid": n, "scripts": [{"id": "banner", "output": text}]}
    values = local_table(spark, [(json.dumps({"addr": "192.0.2.10", "ports": [port("21", "220 FTP"), port("143", "+OK ready.")]}),)], "value string")
    scan = SC.scans(SC.split_bad(SC.items(ingest.text_values(values)))[0])
    shaped = scan.select(
        F.lit("multi").alias("id"), F.col("addr").alias("ip"),
        F.struct("hostnames", "endtime", F.transform("ports", H.shape_port).alias("ports")).alias("body"),
    )
    row = E.extract_with(shaped, E.Config()).first()
    assert row.banner == ["220 ftp", "+ok ready."] and row.port == ["21", "143"]


def test_scan_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.json").write_text(json.dumps({"addr": "1.2.3.4", "ports": [{"portid": 80}, 5]}, indent=2))
    (tmp_path / "a" / "2.json").write_text(json.dumps([{"addr": "1.2.3.5"}, 7, {"addr": "1.2.3.6", "ports": "x"}]))
    (tmp_path / "a" / "3.json").write_text("{broken")
    good, bad = SC.split_bad(SC.items(SC.read_values(spark, str(tmp_path))))
    assert {r.addr for r in SC.scans(good).collect()} == {"1.2.3.4", "1.2.3.5", "1.2.3.6"}
    assert sorted(r.reason for r in bad.collect()) == ["not_object", "unreadable"]
    (tmp_path / "a" / "x1.time").write_text('{"first_seen": "200", "last_seen": 100}')
    (tmp_path / "a" / "x2.time").write_text("{}")
    seen = {r.id: r for r in SC.read_seen_companions(spark, str(tmp_path)).collect()}
    assert (seen["x1"].first_seen, seen["x1"].last_seen, seen["x2"].usable) == (100, 200, False)


def test_rules(spark):
    docs = documents(
        spark,
        [
            {"uid": "a", "ip": "8.8.8.8", "http_title": ["my gitlab"], "port": ["80"]},
            {"uid": "b", "ip": "9.9.9.9", "http_title": ["other"], "port": ["80", "81"], "tag": ["soft:x"]},
        ],
    )
    records = [
        {"name": "r1", "description": "d", "query": "http_title.lk:GitLab OR host.bg:gitlab", "tags": ["product:gitlab", "tag:vendor:gitlab"]},
        {"name": "r2", "description": "d", "query": "port:80 port:81 net:9.0.0.0/8", "tags": ["x:two"]},
        {"name": "r3", "description": "d", "query": "tag:soft:x", "tags": ["x:never"]},
        {"name": "r4", "description": "d", "query": "port:80 port.not:81", "tags": ["x:only80"]},
        {"name": "r5", "description": "d", "query": "ip:8.8.8.8 net:9.0.0.0/8", "tags": ["x:and"]},
        {"name": "r6", "description": "d", "query": "bad", "tags": ["x:bad"]},
    ]
    rules, terms = G.rule_tables(spark, records)
    tags = {r.uid: r.tag for r in G.apply_rules(docs, rules, terms).collect()}
    assert tags == {"a": ["product:gitlab", "vendor:gitlab", "x:only80"], "b": ["x:two"]}
    _, bad = G.validate_rules(rules, terms)
    assert [(r.name, r.reason) for r in bad.collect()] == [("r6", "syntax")]


def test_report_text(spark):
    docs = documents(
        spark,
        [{"uid": "u", "ip": "158.64.1.27", "port": ["443"], "tag": ["vuln:filelisting"], "fqdn_requested": ["scan-request.example.org"], "first_seen": 10, "last_seen": 10}],
    )
    host = F.struct(F.lit("reverse.example.org").alias("name"), F.lit("").alias("hostname"), F.lit("PTR").alias("type"))
    bodies = spark.range(1).select(F.lit("u").alias("id"), F.struct(F.array(host).alias("hostnames")).alias("body"))
    pdns = local_table(spark, [("158.64.1.27", 1, "historical.example.org")], "ip string, seq bigint, fqdn string")
    report = {"name": "R", "description": "", "query": "tag:vuln:filelisting"}
    lines = [r.line for r in RR.report_lines(docs, report, (5, 20), (1, 4), ("A", "B"), bodies, pdns).collect()]
    start = lines.index("## Hosts")
    assert lines[start + 2 : start + 10] == [
        "- 158.64.1.27", "  - Tag: vuln:filelisting", "  - Open ports: 443", "  - Scan results: 1", "  - Associated FQDNs (3)",
        "    - reverse.example.org (ptr)", "    - scan-request.example.org", "    - historical.example.org (pdns)",
    ]
    assert lines[:6] == ["# R", "", "## Summary", "", "- Query: `tag:vuln:filelisting`", "- Period: A to B"]
    new = lines.index("## New opened port")
    assert lines[new + 2 : new + 4] == ["- 158.64.1.27", "  - New ports: 443"]
    assert "- 443: 1 host" in lines
    empty = [r.line for r in RR.report_lines(docs.limit(0), report, (5, 20), (1, 4), ("A", "B")).collect()]
    assert {"No matching hosts.", "- No indexed open ports found.", "- No newly opened ports detected."} <= set(empty)


def test_network_texts(spark):
    routes = local_table(spark, [("8.0.0.0/8", "1"), ("8.8.8.0/24", "2")], "prefix string, asn string")
    names = local_table(spark, [("1", "one"), ("2", "two")], "asn string, description string")
    targets = local_table(spark, [("8.8.8.8",), ("8.1.0.0/16",), ("yper-i.example.org",), ("9.9.9.9",)], "value string")
    out = {r.value: r.text for r in K.asn_lookup(targets, routes, names).collect()}
    assert out == {"8.8.8.8": "2, two", "8.1.0.0/16": "1, one", "yper-i.example.org": K.NOT_AN_ADDRESS, "9.9.9.9": K.NO_ANSWER}
    nets = spark.range(1).select(N.enclosing_networks(N.address_key(F.lit("146.0.178.196")))).first()[0]
    assert nets[0] == "146.0.0.0/16" and nets[-1] == "146.0.178.0/24" and len(nets) == 9


def test_since_word():
    assert S.since_days("port:80 since:3") == 3 and S.since_days("port:80") is None
    for bad in ("since:3 since:4", "since:0", "since:-1", "since:x", "since:"):
        with pytest.raises(ValueError):
            S.since_days(bad)
