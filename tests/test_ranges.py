"""Random and brute-force checks of the address algebra, and skewed keys."""

from __future__ import annotations

import ipaddress
import random

from pyspark.sql import functions as F

from vantage.functions import netaddr as N
from vantage.operators import ranges as K
from vantage.operators import search as S
from vantage.operators.scale import running
from vantage.session import local_table


def key(number: int, version: int) -> str:
    return format(number, "08x" if version == 4 else "032x")


def random_texts(n: int, rng: random.Random) -> list[str]:
    out = ["::", "::1", "::ffff:1.2.3.4", "::ffff:10.0.0.1", "1:2:3:4:5:6:7::", "1::2::3", "01.2.3.4", "8.8.8.0/255.255.255.0", "8.8.8.0/0.0.0.255", "192.0.0.8/31", "192.0.0.8/30", "", "x"]
    for _ in range(n):
        if rng.random() < 0.5:
            out.append(str(ipaddress.IPv4Address(rng.getrandbits(32))) + rng.choice(["", f"/{rng.randint(0, 33)}"]))
        else:
            value = rng.getrandbits(128)
            for i in range(8):
                if rng.random() < 0.6:
                    value &= ~(0xFFFF << (16 * i))
            out.append(str(ipaddress.IPv6Address(value)) + rng.choice(["", f"/{rng.randint(0, 129)}"]))
    return out


def _parse(function, text):
    try:
        return function(text)
    except ValueError:
        return None


def test_parsing_matches_the_standard_library(spark):
    texts = random_texts(800, random.Random(3))
    df = local_table(spark, [(t,) for t in texts], "t string").select(
        "t", N.key_text(N.address_key("t")).alias("a"), N.network("t").alias("n"),
        N.is_public_address("t").alias("pa"), N.is_public_network("t").alias("pn"), N.canonical_target("t").alias("c"),
    )
    for r in df.collect():
        address = _parse(ipaddress.ip_address, r.t)
        net = _parse(lambda t: ipaddress.ip_network(t, strict=False), r.t)
        assert r.a == (str(address) if address is not None else None), r.t
        assert r.pa == (address is not None and not address.is_private), r.t
        assert r.pn == (net is not None and not net.is_private), r.t
        if net is None:
            assert r.n is None
        else:
            assert (r.n.lo, r.n.hi) == (key(int(net[0]), net.version), key(int(net[-1]), net.version)), r.t
        wanted = str(address) if r.pa else (str(net) if address is None and r.pn else None)
        assert r.c == wanted, r.t


def test_ranges_to_cidrs_both_versions(spark):
    rng = random.Random(5)
    rows = []
    for i in range(200):
        version, bits = rng.choice([(4, 32), (6, 128)])
        lo = rng.getrandbits(bits)
        hi = min(2**bits - 1, lo + rng.getrandbits(rng.randint(1, bits)))
        rows.append((i, key(lo, version), key(hi, version)))
    got: dict[int, set] = {}
    for r in K.range_to_cidrs(local_table(spark, rows, "id int, lo string, hi string")).collect():
        got.setdefault(r.id, set()).add(r.cidr)
    for i, lo, hi in rows:
        kind = ipaddress.IPv4Address if len(lo) == 8 else ipaddress.IPv6Address
        assert got[i] == {str(n) for n in ipaddress.summarize_address_range(kind(int(lo, 16)), kind(int(hi, 16)))}


def test_merge_and_reduce_match_collapse(spark):
    rng = random.Random(7)
    nets = []
    for _ in range(300):
        if rng.random() < 0.7:
            nets.append(ipaddress.ip_network((int(ipaddress.ip_address("8.8.0.0")) + rng.getrandbits(12), rng.randint(22, 32)), strict=False))
        else:
            nets.append(ipaddress.ip_network((int(ipaddress.ip_address("2a00::")) + rng.getrandbits(10), rng.randint(118, 128)), strict=False))
    rows = [(key(int(n[0]), n.version), key(int(n[-1]), n.version), n.prefixlen, "d") for n in nets]
    df = local_table(spark, rows, "lo string, hi string, prefix int, description string")
    merged = {r.cidr for r in K.merge_cidrs(df.select("lo", "hi")).collect()}
    wanted = set()
    for version in (4, 6):
        wanted |= {str(n) for n in ipaddress.collapse_addresses(n for n in nets if n.version == version)}
    assert merged == wanted
    kept = {(r.lo, r.prefix) for r in K.reduce_ranges(df).collect()}
    brute = {
        (key(int(n[0]), n.version), n.prefixlen)
        for n in nets
        if not any(o != n and o.version == n.version and n.subnet_of(o) for o in nets)
    }
    assert kept == brute


def test_split_and_pack(spark):
    nets = [ipaddress.ip_network(t) for t in ("8.0.0.0/15", "9.9.9.0/25", "2a00::/115", "7.7.7.7/32")]
    rows = [(i, key(int(n[0]), n.version), key(int(n[-1]), n.version), n.prefixlen) for i, n in enumerate(nets)]
    out = K.split_networks(local_table(spark, rows, "id int, lo string, hi string, prefix int")).collect()
    counts: dict[int, int] = {}
    for r in out:
        counts[r.id] = counts.get(r.id, 0) + 1
    assert counts == {0: 512, 1: 1, 2: 32, 3: 1}

    wide = [ipaddress.ip_network(t) for t in ("2a00:1::/40", "2001:db8::/64", "8::/17", "::/0", "0.0.0.0/0", "9.9.9.0/24")]
    rows = [(i, key(int(n[0]), n.version), key(int(n[-1]), n.version), n.prefixlen) for i, n in enumerate(wide)]
    frame = local_table(spark, rows, "id int, lo string, hi string, prefix int")
    assert [int(r.blocks) for r in K.network_blocks(frame).orderBy("id").collect()] == [max(n.num_addresses // 256, 1) for n in wide]
    for start in (0, 5, 2**56 - 3, 2**60 - 2, 2**79 + 12345, 2**120 - 4):
        got = {(r.id, r.lo, r.hi) for r in K.split_networks(frame, start, 4).collect()}
        assert got == {
            (i, key(int(n[0]) + b * 256, n.version), key(int(n[0]) + b * 256 + 255, n.version))
            for i, n in enumerate(wide) for b in range(start, min(start + 4, n.num_addresses // 256))
        }

    rng = random.Random(11)
    small = [ipaddress.ip_network((int(ipaddress.ip_address("8.8.0.0")) + rng.getrandbits(13), rng.randint(24, 32)), strict=False) for _ in range(150)]
    small += [ipaddress.ip_network((int(ipaddress.ip_address("2a00::")) + rng.getrandbits(12), rng.randint(120, 128)), strict=False) for _ in range(50)]
    rows = [(i, key(int(n[0]), n.version), key(int(n[-1]), n.version), n.prefixlen) for i, n in enumerate(small)]
    items = K.pack_ranges(local_table(spark, rows, "id int, lo string, hi string, prefix int")).collect()
    queue = [(a, i) for i, n in sorted(enumerate(small), key=lambda p: (p[1].version, int(p[1][0]), p[0])) for a in n]
    for r in items:
        block = queue[r.item * 256 : (r.item + 1) * 256]
        assert set(r.ids) == {i for _, i in block}
        wanted = set()
        for version in (4, 6):
            wanted |= {str(n) for n in ipaddress.collapse_addresses({a for a, _ in block if a.version == version})}
        assert set(r.cidrs) == wanted
    assert len(items) == -(-len(queue) // 256)


def test_running_is_exact_with_few_and_many_buckets(spark):
    rng = random.Random(13)
    rows = [(i, rng.randint(0, 5), rng.randint(1, 9)) for i in range(3000)]
    df = local_table(spark, rows, "id int, k int, v int")
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    total, top, wanted = 0, None, {}
    for i, _, v in order:
        wanted[i] = (total, top)
        total += v
        top = v if top is None else max(top, v)
    for buckets in (2, 7, 64):
        out = running(
            df, [F.col("k"), F.col("id")], {"before": ("sum", F.col("v")), "top": ("max", F.col("v"))}, buckets=buckets
        ).collect()
        assert {r.id: (r.before, r.top) for r in out} == wanted


def test_hot_address_keeps_every_document(spark):
    rows = [(f"u{i}", "8.8.8.8" if i % 3 else f"9.9.{i % 200}.1") for i in range(9000)]
    df = local_table(spark, rows, "uid string, ip string")
    lists = S.uid_lists(df, chunk=500)
    assert {(r.ip, r.uid) for r in lists.select("ip", F.explode("uids").alias("uid")).collect()} == {(ip, u) for u, ip in rows}
    assert lists.agg(F.max(F.size("uids"))).first()[0] < 1000


def test_totals_of_wide_networks_are_exact(spark):
    texts = ["2a00::/32", "8000::/1", "::/0", "8.0.0.0/8", "1.2.3.4", "2a00::1", "a.example.com", "not a target"]
    nets = [ipaddress.ip_network(t) for t in texts[:6]]
    frame = local_table(spark, [(t,) for t in texts], "value string")
    stats = K.target_stats(frame).first()
    total = sum(n.num_addresses for n in nets if n.prefixlen < n.max_prefixlen)
    assert (stats.cidr_host_count_text, stats.total_hosts_to_scan_text) == (str(total), str(total + 3))
    assert stats.cidr_host_count is None and (stats.cidr_count, stats.fqdn_count) == (4, 1)
    counted = K.count_ips(K.with_network(frame).filter("lo is not null")).first()
    assert counted.ips_text == str(sum(n.num_addresses for n in nets)) and counted.ips is None
    one = K.count_ips(K.with_network(frame.limit(1))).first()
    assert int(one.ips) == 2**96 and one.ips_text == str(2**96)
    none = K.count_ips(K.with_network(frame).filter("false")).first()
    assert none.ips is None and none.ips_text is None
