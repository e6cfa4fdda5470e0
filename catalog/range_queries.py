"""Range and target queries (K1-K15) over networks derived from supplier and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, spread, table
from catalog.bindings import with_docs
from vantage.functions import netaddr as N
from vantage.operators import ranges as K

BASE = 134742016

NETS_SQL = f"""
nets0 AS (SELECT s_suppkey AS id, s_name, s_nationkey, CAST(20 + s_suppkey % 11 AS INT) AS prefix,
           ({BASE} + s_suppkey * 64) % 4294967296 AS x FROM supplier),
nets AS (SELECT id, s_name, s_nationkey, prefix, CAST(1 AS BIGINT) << (32 - prefix) AS size,
          x - x % (CAST(1 AS BIGINT) << (32 - prefix)) AS lo FROM nets0)"""


def ip_sql(n: str) -> str:
    return f"((({n}) >> 24) || '.' || ((({n}) >> 16) & 255) || '.' || ((({n}) >> 8) & 255) || '.' || (({n}) & 255))"


def cidr_sql(source: str, keys: str) -> str:
    """CIDR decomposition of integer ranges (lo, hi) of `source`."""
    return f"""(SELECT DISTINCT {keys}, b AS start, CAST(32 - e AS INT) AS prefix FROM (
        SELECT *, unnest([lo + (sz - lo % sz) % sz, (hi + 1) - (hi + 1) % sz - sz]) AS b FROM (
          SELECT s.*, e, CAST(1 AS BIGINT) << e AS sz FROM {source} s, (SELECT unnest(range(0, 33)) AS e)))
      WHERE b >= lo AND b + sz - 1 <= hi AND NOT (b - b % (2 * sz) >= lo AND b - b % (2 * sz) + 2 * sz - 1 <= hi))"""


def networks(spark, sf_dir):
    """supplier -> networks (id, value, lo, hi, prefix)."""
    x = (F.lit(BASE) + F.col("s_suppkey") * 64) % 4294967296
    prefix = (F.lit(20) + F.col("s_suppkey") % 11).cast("int")
    key = N.v4_key(x)
    rows = spread(table(spark, sf_dir, "supplier")).select(
        F.col("s_suppkey").alias("id"), "s_name", "s_nationkey", prefix.alias("prefix"), key.alias("_k")
    )
    return rows.select(
        "id", "s_name", "s_nationkey", "prefix",
        N.mask_key("_k", F.col("prefix"), 0).alias("lo"), N.mask_key("_k", F.col("prefix"), 1).alias("hi"),
    ).withColumn("value", N.network_text("lo", "prefix"))


RANGES_SQL = "ranges AS (SELECT p_partkey AS id, 150994944 + p_partkey * 37 AS lo, 150994944 + p_partkey * 37 + p_size * 5 - 1 AS hi FROM part)"


def part_ranges(spark, sf_dir):
    start = F.lit(150994944) + F.col("p_partkey") * 37
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), N.v4_key(start).alias("lo"), N.v4_key(start + F.col("p_size") * 5 - 1).alias("hi")
    )


# part -> import entries: names, addresses, networks with host bits, private, junk
_ADDR = f"{BASE} + (p_partkey * 131) % 40000"
_NETX = f"{BASE} + (p_partkey * 977) % 60000"
ENTRIES_SQL = f"""
entries AS (SELECT p_partkey AS ord, p_size % 5 AS k, CAST(24 + p_size % 6 AS INT) AS npfx,
     'n' || (p_partkey % 300) || '.example.com' AS fqdn, {_ADDR} AS a, {_NETX} AS x FROM part),
typed AS (SELECT ord, k,
   CASE k WHEN 0 THEN fqdn WHEN 1 THEN {ip_sql('a')} WHEN 2 THEN {ip_sql('x')} || '/' || npfx
          WHEN 3 THEN '10.0.' || (ord % 200) || '.1' ELSE 'bad_' || ord END AS entry,
   CASE k WHEN 0 THEN 'fqdn' WHEN 1 THEN 'address' WHEN 2 THEN 'network' ELSE 'invalid' END AS kind,
   CASE k WHEN 1 THEN a WHEN 2 THEN x - x % (CAST(1 AS BIGINT) << (32 - npfx)) END AS lo,
   CASE k WHEN 1 THEN 32 WHEN 2 THEN npfx END AS prefix FROM entries),
canon AS (SELECT *, CASE k WHEN 0 THEN entry WHEN 1 THEN entry WHEN 2 THEN {ip_sql('lo')} || '/' || prefix END AS value,
   lo + (CAST(1 AS BIGINT) << (32 - prefix)) - 1 AS hi FROM typed)"""


def _entries(spark, sf_dir):
    k = F.col("p_size") % 5
    raw = (
        F.when(k == 0, F.expr("' \"n' || (p_partkey % 300) || '.example.com\",'"))
        .when(k == 1, N.ipv4_text(F.expr(_ADDR)))
        .when(k == 2, F.concat(N.ipv4_text(F.expr(_NETX)), F.lit("/"), (24 + F.col("p_size") % 6).cast("string"), F.lit("; ")))
        .when(k == 3, F.expr("'10.0.' || (p_partkey % 200) || '.1'"))
        .otherwise(F.expr("'bad_' || p_partkey"))
    )
    return spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("ord"), raw.alias("value"))


def _valid_entries(spark, sf_dir):
    """Canonical values of the valid entries (id, value)."""
    plain = _entries(spark, sf_dir).select(
        F.col("ord").alias("id"), N.target(F.regexp_replace("value", "[\" ,;]", "")).alias("t")
    )
    return plain.select("id", "t.value").filter("value IS NOT NULL")


@query(
    "K1_target_import",
    f"""WITH {NETS_SQL}, {ENTRIES_SQL},
    known AS (SELECT CAST(-1 AS BIGINT) AS ord, {ip_sql('lo')} || '/' || prefix AS value, lo, lo + size - 1 AS hi, prefix FROM nets WHERE s_nationkey < 10
              UNION ALL SELECT ord, value, lo, hi, prefix FROM canon WHERE kind IN ('address', 'network')),
    cov AS (SELECT c.ord, arg_min(w.value, (w.prefix, w.ord)) AS covered_by FROM canon c JOIN known w
              ON w.lo <= c.lo AND w.hi >= c.hi AND w.ord < c.ord WHERE c.kind IN ('address', 'network') GROUP BY c.ord),
    nm AS (SELECT value, min(ord) AS first FROM canon WHERE kind = 'fqdn' GROUP BY value)
    SELECT c.ord, c.entry, c.kind, c.value, v.covered_by,
      CASE WHEN kind = 'invalid' THEN 'invalid' WHEN v.covered_by IS NOT NULL THEN 'covered'
           WHEN kind = 'fqdn' AND nm.first < c.ord THEN 'duplicate' ELSE 'processed' END AS status,
      CASE WHEN kind = 'invalid' THEN c.entry || ' Invalid IP/CIDR/FQDN or private IP'
           WHEN v.covered_by IS NOT NULL THEN c.entry || ' Not Processed, Target already covered by ' || v.covered_by
           WHEN kind = 'fqdn' AND nm.first < c.ord THEN c.entry || ' Not Processed, Target already in the database'
           WHEN kind = 'fqdn' THEN c.entry || ' FQDN Processed' ELSE c.entry || ' Processed' END AS log
    FROM canon c LEFT JOIN cov v USING (ord) LEFT JOIN nm ON nm.value = c.value""",
)
def k1(spark, sf_dir):
    existing = networks(spark, sf_dir).filter("s_nationkey < 10").select("value").distinct()
    return K.import_targets(existing, _entries(spark, sf_dir))


@query(
    "K2_covering_target",
    f"""WITH {NETS_SQL}, {ENTRIES_SQL}, w AS (SELECT id, lo, lo + size - 1 AS hi, prefix, {ip_sql('lo')} || '/' || prefix AS value FROM nets)
    SELECT c.ord AS id, c.value, (SELECT arg_min(w.value, (w.prefix, w.id)) FROM w WHERE w.lo <= c.lo AND w.hi >= c.hi AND w.id <> c.ord) AS covered_by
    FROM canon c WHERE c.kind IN ('address', 'network', 'fqdn')""",
)
def k2(spark, sf_dir):
    return K.covering(_valid_entries(spark, sf_dir), networks(spark, sf_dir).select("id", "value"))


@query(
    "K2_covering_excludes_itself",
    f"""WITH {NETS_SQL}, w AS (SELECT id, lo, lo + size - 1 AS hi, prefix, {ip_sql('lo')} || '/' || prefix AS value FROM nets)
    SELECT c.id, c.value, (SELECT arg_min(w.value, (w.prefix, w.id)) FROM w WHERE w.lo <= c.lo AND w.hi >= c.hi AND w.id <> c.id) AS covered_by
    FROM w c""",
)
def k2_self(spark, sf_dir):
    targets = networks(spark, sf_dir).select("id", "value")
    return K.covering(targets, targets)


@query(
    "K3_drop_covered",
    f"""WITH {NETS_SQL}, u AS (SELECT lo, lo + size - 1 AS hi, prefix, min(s_name) AS description FROM nets GROUP BY ALL)
    SELECT {ip_sql('lo')} || '/' || prefix AS cidr, description FROM u c
    WHERE NOT EXISTS (SELECT 1 FROM u w WHERE w.lo <= c.lo AND w.hi >= c.hi AND w.prefix < c.prefix)""",
)
def k3(spark, sf_dir):
    nets = networks(spark, sf_dir).withColumnRenamed("s_name", "description")
    return K.reduce_ranges(nets.select("lo", "hi", "prefix", "description")).select(
        N.network_text("lo", "prefix").alias("cidr"), "description"
    )


@query(
    "K4_range_to_cidrs",
    f"WITH {RANGES_SQL} SELECT id, {ip_sql('start')} || '/' || prefix AS cidr FROM {cidr_sql('ranges', 'id')}",
)
def k4(spark, sf_dir):
    return K.range_to_cidrs(part_ranges(spark, sf_dir)).select("id", "cidr")


@query(
    "K5_count_to_cidrs",
    f"""WITH r AS (SELECT s_suppkey AS id, {BASE} + s_suppkey * 1000 AS lo, {BASE} + s_suppkey * 1000 + CAST(abs(floor(s_acctbal)) AS BIGINT) AS hi FROM supplier)
    SELECT id, {ip_sql('start')} || '/' || prefix AS cidr FROM {cidr_sql('r', 'id')}""",
)
def k5(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), N.ipv4_text(F.lit(BASE) + F.col("s_suppkey") * 1000).alias("start"),
        (F.abs(F.floor("s_acctbal")) + 1).cast("string").alias("count"),
    )
    return K.count_to_cidrs(rows).select("id", "cidr")


def registry_records(spark, sf_dir):
    """supplier -> registry records as line arrays."""
    start = F.lit(BASE) + F.col("s_suppkey") * 300
    country = F.when(F.col("s_nationkey") < 5, F.lit("lu")).otherwise(F.concat(F.lit("C"), F.col("s_nationkey").cast("string")))
    lines = F.array_compact(
        F.array(
            F.concat(F.lit("inetnum:        "), N.ipv4_text(start), F.lit(" - "), N.ipv4_text(start + F.col("s_suppkey") % 90)),
            F.when(F.col("s_suppkey") % 7 != 0, F.concat(F.lit("netname: NET-"), F.col("s_suppkey").cast("string"))),
            F.lit("netname:        SECOND"),
            F.concat(F.lit("Country:        "), country),
            F.concat(F.lit("descr: Region "), F.col("s_nationkey").cast("string"), F.lit(" Holding")),
        )
    )
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), lines.alias("lines"))


REGISTRY_SQL = f"""reg AS (SELECT {ip_sql(f'{BASE} + s_suppkey * 300')} AS first, {ip_sql(f'{BASE} + s_suppkey * 300 + s_suppkey % 90')} AS last,
    CASE WHEN s_suppkey % 7 <> 0 THEN 'NET-' || s_suppkey ELSE 'SECOND' END AS description
    FROM supplier WHERE s_nationkey < 5 OR s_nationkey = 11)"""


@query("K6_registry_match", f"WITH {REGISTRY_SQL} SELECT * FROM reg")
def k6(spark, sf_dir):
    found = K.match_registry(registry_records(spark, sf_dir).select("lines"), ["LU "], ["region 11 "])
    return found.select(N.key_text("lo").alias("first"), N.key_text("hi").alias("last"), "description")


def networks_v6(spark, sf_dir):
    """supplier -> IPv6 networks of every prefix from 32 on."""
    key = F.concat(F.lit("20010db8"), F.lpad(F.lower(F.hex("s_suppkey")), 8, "0"), F.lit("0" * 16))
    prefix = (F.lit(32) + F.col("s_suppkey") % 97).cast("int")
    rows = spread(table(spark, sf_dir, "supplier")).select(F.col("s_suppkey").alias("id"), prefix.alias("prefix"), key.alias("_k"))
    return rows.select("id", "prefix", N.mask_key("_k", F.col("prefix"), 0).alias("lo"), N.mask_key("_k", F.col("prefix"), 1).alias("hi"))


NETS6_SQL = """six0 AS (SELECT s_suppkey AS id, CAST(pow(2, 96 - s_suppkey % 97) AS HUGEINT) AS size,
           CAST(536939960 AS HUGEINT) * CAST(pow(2, 96) AS HUGEINT) + CAST(s_suppkey AS HUGEINT) * CAST(pow(2, 64) AS HUGEINT) AS x FROM supplier),
six AS (SELECT id, size, x - x % size AS lo FROM six0)"""


@query(
    "K7_address_total_v6",
    f"WITH {NETS6_SQL} SELECT CAST(sum(size) AS VARCHAR) AS ips FROM six",
)
def k7_v6(spark, sf_dir):
    return K.count_ips(networks_v6(spark, sf_dir)).select(F.col("ips_text").alias("ips"))


@query(
    "K9_block_slices_v6",
    f"""WITH {NETS6_SQL} SELECT id, lpad(lower(to_hex(lo + (300 + i) * 256)), 32, '0') AS lo, CAST(size // 256 AS VARCHAR) AS blocks
        FROM six, range(4) r(i) WHERE (300 + i) < size // 256""",
)
def k9_v6(spark, sf_dir):
    """Blocks 300 to 303 of every network, however wide, and how many blocks it has."""
    sized = K.network_blocks(networks_v6(spark, sf_dir))
    return K.split_networks(sized, 300, 4).select("id", "lo", F.col("blocks").cast("string").alias("blocks"))


@query(
    "K9_split_networks_v6",
    f"""WITH {NETS6_SQL}, n AS (SELECT id, lo, size, unnest(range(0, CAST(greatest(size // 256, 1) AS BIGINT))) AS i FROM six WHERE size <= 16777216)
        SELECT id, lpad(lower(to_hex(lo + i * 256)), 32, '0') AS lo, CAST(CASE WHEN size > 256 THEN 120 ELSE 128 - log2(size) END AS INT) AS prefix FROM n""",
)
def k9_whole_v6(spark, sf_dir):
    """All blocks of the networks of /104 and narrower; a wider one is listed by slices (K9_block_slices_v6)."""
    return K.split_networks(networks_v6(spark, sf_dir).filter("prefix >= 104")).select("id", "lo", "prefix")


@query(
    "K7_address_total",
    f"WITH {NETS_SQL} SELECT CAST(sum(size) AS BIGINT) AS ips, CAST(sum(size) AS DOUBLE) AS ips_double FROM nets",
)
def k7(spark, sf_dir):
    return K.count_ips(networks(spark, sf_dir)).select(F.col("ips").cast("bigint").alias("ips"), "ips_double")


@query(
    "K8_cidr_merge",
    f"""WITH {RANGES_SQL},
    b AS (SELECT lo, hi, max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ranges),
    g AS (SELECT lo, hi, sum(CASE WHEN prev IS NULL OR prev + 1 < lo THEN 1 ELSE 0 END) OVER (ORDER BY lo, hi) AS island FROM b),
    m AS (SELECT island, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY island)
    SELECT {ip_sql('start')} || '/' || prefix AS cidr FROM {cidr_sql('m', 'island')}""",
)
def k8(spark, sf_dir):
    return K.merge_cidrs(part_ranges(spark, sf_dir)).select("cidr")


@query(
    "K9_split_networks",
    f"""WITH {NETS_SQL} SELECT id, {ip_sql('b')} || '/' || greatest(prefix, 24) AS cidr FROM (
        SELECT id, prefix, unnest(range(lo, lo + size, 256)) AS b FROM nets)""",
)
def k9(spark, sf_dir):
    out = K.split_networks(networks(spark, sf_dir).select("id", "lo", "hi", "prefix"))
    return out.select("id", N.network_text("lo", "prefix").alias("cidr"))


@query(
    "K10_pack_ranges",
    f"""WITH {NETS_SQL}, s AS (SELECT id, lo, prefix, size, coalesce(sum(size) OVER (ORDER BY lo, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
             FROM nets WHERE prefix >= 24),
    a AS (SELECT id, (off + i) // 256 AS item, lo + i AS addr FROM (SELECT *, unnest(range(0, size)) AS i FROM s))
    SELECT CAST(item AS BIGINT) AS item, string_agg(DISTINCT CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)) AS ids,
           count(DISTINCT addr) AS addresses FROM a GROUP BY item""",
)
def k10(spark, sf_dir):
    items = K.pack_ranges(networks(spark, sf_dir).filter("prefix >= 24"))
    size = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), 32 - F.substring_index(c, "/", -1).cast("int"))
    return items.select(
        "item",
        F.array_join(F.array_sort(F.transform("ids", lambda i: i.cast("string"))), ",").alias("ids"),
        F.aggregate("cidrs", F.lit(0).cast("bigint"), lambda acc, c: acc + size(c)).alias("addresses"),
    )


@query(
    "K11_pack_names",
    """WITH n AS (SELECT c_custkey AS id, lower(replace(c_name, '#', '-')) || '.example.com' AS value,
               row_number() OVER (ORDER BY CASE WHEN c_acctbal < 0 THEN 0 ELSE 1 END, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END, c_custkey) - 1 AS rn FROM customer)
       SELECT rn // 256 AS item, string_agg(value, ',' ORDER BY rn) AS names, count(*) AS size FROM n GROUP BY 1""",
)
def k11(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))), F.lit(".example.com")).alias("value"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("due"),
    )
    out = K.pack_names(names, [F.col("due"), F.col("id")])
    return out.select("item", F.array_join("names", ",").alias("names"), F.size("names").cast("bigint").alias("size"))


@query(
    "K12_classify_due",
    f"""WITH {NETS_SQL}, {ENTRIES_SQL}, t AS (SELECT {ip_sql('lo')} || '/' || prefix AS value, prefix < 24 AS big FROM nets
        UNION ALL SELECT value, false FROM canon WHERE kind <> 'invalid')
    SELECT value, CASE WHEN value LIKE '%.com' THEN 'name' WHEN big THEN 'large' ELSE 'small' END AS class FROM t""",
)
def k12(spark, sf_dir):
    nets = networks(spark, sf_dir).select("value")
    return K.classify_due(nets.unionByName(_valid_entries(spark, sf_dir).select("value"))).select("value", "class")


@query(
    "K13_target_statistics",
    f"""WITH {NETS_SQL}, {ENTRIES_SQL}, t AS (SELECT 'network' AS kind, size FROM nets
        UNION ALL SELECT kind, CASE WHEN kind = 'network' THEN CAST(1 AS BIGINT) << (32 - prefix) ELSE 1 END FROM canon)
    SELECT count(*) FILTER (kind = 'network') AS cidr_count, count(*) FILTER (kind = 'fqdn') AS fqdn_count,
           CAST(sum(size) FILTER (kind = 'network') AS BIGINT) AS cidr_host_count,
           CAST(sum(size) FILTER (kind <> 'invalid') AS BIGINT) AS total_hosts_to_scan FROM t""",
)
def k13(spark, sf_dir):
    entries = _entries(spark, sf_dir).select(F.regexp_replace("value", "[\" ,;]", "").alias("value"))
    stats = K.target_stats(networks(spark, sf_dir).select("value").unionByName(entries))
    return stats.select(
        "cidr_count", "fqdn_count", F.col("cidr_host_count").cast("bigint").alias("cidr_host_count"),
        F.col("total_hosts_to_scan").cast("bigint").alias("total_hosts_to_scan"),
    )


@query(
    "K14_most_specific_prefix",
    with_docs(
        f""", {NETS_SQL}, r AS (SELECT lo, size, prefix, min('AS' || s_nationkey) AS asn FROM nets GROUP BY lo, size, prefix),
        t AS (SELECT DISTINCT ip AS value, ip_num FROM docs UNION SELECT DISTINCT unnest(fqdn), NULL FROM docs WHERE list_contains(tag, 'hard:big')),
        b AS (SELECT t.value, t.ip_num, arg_max(r.asn, r.prefix) AS asn FROM t LEFT JOIN r ON t.ip_num BETWEEN r.lo AND r.lo + r.size - 1 GROUP BY ALL)
        SELECT b.value, b.asn, CASE WHEN b.ip_num IS NULL AND b.value <> '10.1.2.3' THEN 'Network info unavailable for non-IP targets'
            WHEN n.n_name IS NULL THEN 'resolutions backend unreachable' ELSE b.asn || ', ' || n.n_name END AS text
        FROM b LEFT JOIN nation n ON 'AS' || n.n_nationkey = b.asn AND n.n_regionkey <> 3"""
    ),
)
def k14(spark, sf_dir):
    from catalog.bindings import documents

    docs = documents(spark, sf_dir)
    targets = docs.select(F.col("ip").alias("value")).union(
        docs.filter(F.array_contains("tag", "hard:big")).select(F.explode("fqdn"))
    )
    routes = networks(spark, sf_dir).select(F.col("value").alias("prefix"), F.concat(F.lit("AS"), F.col("s_nationkey").cast("string")).alias("asn"))
    names = table(spark, sf_dir, "nation").filter("n_regionkey <> 3").select(
        F.concat(F.lit("AS"), F.col("n_nationkey").cast("string")).alias("asn"), F.col("n_name").alias("description")
    )
    return K.asn_lookup(targets, routes, names)


@query(
    "K15_unit_backfill",
    f"""WITH {NETS_SQL}, {ENTRIES_SQL}
    SELECT 'target' AS kind, id, size AS scan_unit_count FROM nets
    UNION ALL SELECT 'job', c.ord, CAST(least(CASE WHEN c.kind = 'network' THEN CAST(1 AS BIGINT) << (32 - c.prefix) ELSE 1 END + 1
                     + 256, 9223372036854775807) AS BIGINT) FROM canon c""",
)
def k15(spark, sf_dir):
    jobs = _entries(spark, sf_dir).select(
        F.col("ord").alias("id"),
        F.concat(F.regexp_replace("value", "[\" ,;]", ""), F.lit(", ,example.org.,9.9.9.0/24")).alias("job"),
    )
    targets, jobs = K.backfill_units(networks(spark, sf_dir).select("id", "value"), jobs)
    return targets.select(F.lit("target").alias("kind"), "id", "scan_unit_count").unionByName(
        jobs.select(F.lit("job").alias("kind"), "id", "scan_unit_count")
    )
