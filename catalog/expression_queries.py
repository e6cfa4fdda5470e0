"""Column expressions (N1-N23) over texts derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, spread, table
from catalog.bindings import OBS_SQL, documents, observations, with_docs
from catalog.range_queries import ip_sql
from vantage.functions import netaddr as N
from vantage.functions import text as T
from vantage.functions import times as M
from vantage.operators.scale import running

_STAMP = """CASE event_id % 7 WHEN 0 THEN CAST(seen AS STRING) WHEN 1 THEN CAST(seen * 1000 + 123 AS STRING)
  WHEN 2 THEN ' ' || CAST(seen AS STRING) || '.9 ' WHEN 3 THEN {iso} WHEN 4 THEN '-' || seen WHEN 5 THEN 'n/a' ELSE '' END"""


@query("N1_timestamp", f"WITH {OBS_SQL} SELECT uid, CASE WHEN event_id % 7 <= 3 THEN seen END AS epoch FROM obs")
def n1(spark, sf_dir):
    text = F.expr(_STAMP.format(iso="date_format(timestamp_seconds(seen), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"))
    return observations(spark, sf_dir).select("uid", M.epoch(text).alias("epoch"))


@query(
    "N2_seen_range",
    f"""WITH {OBS_SQL}, r AS (SELECT uid, CASE WHEN kn < 20 THEN NULL ELSE seen END AS a, CASE WHEN kn % 10 = 3 THEN NULL WHEN kn % 2 = 0 THEN seen - 500 ELSE seen + 500 END AS b FROM obs)
    SELECT uid, least(coalesce(a, b), coalesce(b, a)) AS first_seen, greatest(coalesce(a, b), coalesce(b, a)) AS last_seen FROM r""",
)
def n2(spark, sf_dir):
    a = F.when(F.col("kn") >= 20, F.col("seen"))
    b = F.when(F.col("kn") % 10 == 3, F.lit(None)).when(F.col("kn") % 2 == 0, F.col("seen") - 500).otherwise(F.col("seen") + 500)
    first, last = M.seen_range(a, b)
    return observations(spark, sf_dir).select("uid", first.alias("first_seen"), last.alias("last_seen"))


@query(
    "N3_tag_normalize",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'lang:' || lang WHEN 1 THEN 'tag:' || lang WHEN 2 THEN 'a:b:' || source ELSE lang END AS tag FROM documents""",
)
def n3(spark, sf_dir):
    raw = F.expr(
        "CASE doc_id % 4 WHEN 0 THEN ' Tag:TAG: Lang:' || upper(lang) || ' ' WHEN 1 THEN 'tag:tag:' || lang WHEN 2 THEN 'tag:A:b:' || source ELSE upper(lang) END"
    )
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_tag(raw).alias("tag"))


@query("N4_tag_text", "SELECT doc_id, 'lang:' || lang || chr(10) || 'src:' || source || chr(10) || 'x' AS tags FROM documents")
def n4(spark, sf_dir):
    raw = F.expr("' Lang:' || upper(lang) || ' \\n,,tag:src:' || source || ',lang:' || lang || '\\nX\\n'")
    return table(spark, sf_dir, "documents").select("doc_id", T.join_tags(T.split_tags(raw)).alias("tags"))


_HOST_RAW = """CASE page_id % 6 WHEN 0 THEN fqdn || '.' WHEN 1 THEN '-' || fqdn WHEN 2 THEN fqdn || '.x9' WHEN 3 THEN replace(fqdn, '.', '_')
   WHEN 4 THEN repeat('a', 64) || '.' || fqdn ELSE fqdn END"""
PAGES_SQL = r"pg AS (SELECT page_id, url, html, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS fqdn FROM pages)"


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").withColumn("fqdn", F.regexp_extract("url", "^https?://([^/:?#]+)", 1))


@query("N5_hostname_shape", f"WITH {PAGES_SQL} SELECT page_id, page_id % 6 IN (0, 5) AS valid FROM pg")
def n5(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", N.is_fqdn(F.expr(_HOST_RAW)).alias("valid"))


_SPREAD = "(p_partkey * 2654435761) % 4294967296"
# Bounds of the private blocks and public exceptions.
_PRIVATE = [
    (0, 16777215), (167772160, 184549375), (2130706432, 2147483647), (2851995648, 2852061183), (2886729728, 2887778303),
    (3221225472, 3221225727), (3221225984, 3221226239), (3232235520, 3232301055), (3323068416, 3323199487),
    (3325256704, 3325256959), (3405803776, 3405804031), (4026531840, 4294967295),
]


def _private_sql(lo: str, hi: str) -> str:
    inside = " OR ".join(f"({lo} >= {a} AND {hi} <= {b})" for a, b in _PRIVATE)
    exc = " OR ".join(f"{x} BETWEEN 3221225481 AND 3221225482" for x in (lo, hi))
    return f"(({inside}) AND NOT ({exc}))"


@query(
    "N6_public_address",
    f"""WITH a AS (SELECT p_partkey, {_SPREAD} AS n FROM part)
    SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN false ELSE NOT {_private_sql('n', 'n')} END AS public FROM a""",
)
def n6(spark, sf_dir):
    text = F.when(F.col("p_partkey") % 5 == 4, F.concat(N.ipv4_text(F.expr(_SPREAD)), F.lit(".1"))).otherwise(N.ipv4_text(F.expr(_SPREAD)))
    return table(spark, sf_dir, "part").select("p_partkey", N.is_public_address(text).alias("public"))


@query(
    "N7_public_network",
    f"""WITH a AS (SELECT p_partkey, {_SPREAD} AS n, CAST(6 + p_partkey % 27 AS INT) AS p FROM part),
    b AS (SELECT p_partkey, p, n - n % (CAST(1 AS BIGINT) << (32 - p)) AS lo, n - n % (CAST(1 AS BIGINT) << (32 - p)) + (CAST(1 AS BIGINT) << (32 - p)) - 1 AS hi FROM a)
    SELECT p_partkey, NOT {_private_sql('lo', 'hi')} AS public, CASE WHEN NOT {_private_sql('lo', 'hi')} THEN {ip_sql('lo')} || '/' || p END AS canonical FROM b""",
)
def n7(spark, sf_dir):
    text = F.concat(N.ipv4_text(F.expr(_SPREAD)), F.lit("/"), (6 + F.col("p_partkey") % 27).cast("string"))
    return spread(table(spark, sf_dir, "part")).select("p_partkey", N.is_public_network(text).alias("public"), N.canonical_target(text).alias("canonical"))


@query(
    "N7_public_network_v6",
    """SELECT p_partkey, p_size % 3 = 0 AS public, CASE WHEN p_size % 3 = 0 THEN '2a00:' || lower(printf('%x', p_partkey % 65535 + 1)) || '::/48' END AS canonical FROM part""",
)
def n7_v6(spark, sf_dir):
    group = F.lower(F.hex(F.col("p_partkey") % 65535 + 1))
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("2A00:"), group, F.lit(":0:0:0:9:8:7/48"))).when(
        F.col("p_size") % 3 == 1, F.concat(F.lit("fd00:"), group, F.lit("::1/64"))
    ).otherwise(F.concat(F.lit("2a00::"), group, F.lit("::1/64")))
    return spread(table(spark, sf_dir, "part")).select("p_partkey", N.is_public_network(text).alias("public"), N.canonical_target(text).alias("canonical"))


_UNITS = "CASE WHEN p_size % 4 = 0 THEN '8.0.0.1/' || (p_partkey % 33) WHEN p_size % 4 = 1 THEN 'n' || p_partkey || '.example.com.' WHEN p_size % 4 = 2 THEN '2000::/' || (p_partkey % 129) ELSE ' ' END"
_UNITS_SQL = """CASE WHEN p_size % 4 = 0 THEN CAST(pow(2, 32 - p_partkey % 33) AS HUGEINT)
   WHEN p_size % 4 = 2 THEN CASE WHEN p_partkey % 129 <= 65 THEN CAST(9223372036854775807 AS HUGEINT) ELSE CAST(pow(2, 128 - p_partkey % 129) AS HUGEINT) END ELSE 1 END"""


@query("N8_unit_count", f"SELECT p_partkey, CAST({_UNITS_SQL} AS BIGINT) AS units FROM part")
def n8(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", N.unit_count(F.expr(_UNITS)).alias("units"))


@query(
    "N9_unit_count_list",
    f"SELECT p_partkey, CAST(least({_UNITS_SQL} * (CASE WHEN p_size % 4 = 3 THEN 0 ELSE 1 END) + 128 + 1, CAST(9223372036854775807 AS HUGEINT)) AS BIGINT) AS units FROM part",
)
def n9(spark, sf_dir):
    joined = F.concat(F.lit("8.8.8.0/25, "), F.expr(_UNITS), F.lit(" ,1.1.1.1,"))
    return table(spark, sf_dir, "part").select("p_partkey", N.unit_count_list(joined).alias("units"))


@query("N10_header_name", "SELECT p_partkey, p_size % 4 IN (0, 3) AS valid FROM part")
def n10(spark, sf_dir):
    raw = F.expr(
        "CASE p_size % 4 WHEN 0 THEN ' x-' || replace(p_name, ' ', '-') || ' ' WHEN 1 THEN p_name WHEN 2 THEN repeat('a', 129) ELSE repeat('b', 128) END"
    )
    return table(spark, sf_dir, "part").select("p_partkey", T.is_header_name(raw).alias("valid"))


@query(
    "N11_address_order",
    with_docs(
        """, v AS (SELECT DISTINCT ip AS value, 4 AS ver, ip_num AS n FROM docs
           UNION SELECT '2a00:' || printf('%x', s_suppkey + 16) || '::1', 6, s_suppkey FROM supplier UNION SELECT s_name, 99, 0 FROM supplier)
           SELECT value, row_number() OVER (ORDER BY ver, n, value) AS place FROM v"""
    ),
)
def n11(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    values = (
        documents(spark, sf_dir).select(F.col("ip").alias("value")).distinct()
        .union(supplier.select(F.concat(F.lit("2a00:"), F.lower(F.hex(F.col("s_suppkey") + 16)), F.lit("::1"))))
        .union(supplier.select("s_name"))
    )
    placed = running(values, [N.address_order("value")], {"before": ("sum", F.lit(1).cast("bigint"))})
    return placed.select("value", (F.col("before") + 1).alias("place"))


@query(
    "N12_port_order",
    """WITH v AS (SELECT DISTINCT CASE WHEN o_orderkey % 11 = 0 THEN 'p' || (o_orderkey % 700) ELSE CAST(o_orderkey % 5000 AS VARCHAR) END AS port FROM orders)
    SELECT port, row_number() OVER (ORDER BY CASE WHEN port LIKE 'p%' THEN 1 ELSE 0 END, TRY_CAST(port AS INT), port) AS place FROM v""",
)
def n12(spark, sf_dir):
    port = F.expr("CASE WHEN o_orderkey % 11 = 0 THEN 'p' || (o_orderkey % 700) ELSE CAST(o_orderkey % 5000 AS STRING) END")
    values = table(spark, sf_dir, "orders").select(port.alias("port")).distinct()
    placed = running(values, [T.port_order("port")], {"before": ("sum", F.lit(1).cast("bigint"))})
    return placed.select("port", (F.col("before") + 1).alias("place"))


_CLOCK = "CASE WHEN h > 0 THEN printf('%02d:%02d:%02d', h, m, s) WHEN m > 0 THEN printf('%02d:%02d', m, s) ELSE s || 's' END"


@query(
    "N13_durations",
    f"""WITH d AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) % 9000 END AS t FROM orders),
    p AS (SELECT o_orderkey, t, t // 3600 AS h, (t % 3600) // 60 AS m, t % 60 AS s, t // 60 AS jm FROM d)
    SELECT o_orderkey, CASE WHEN t IS NULL THEN '∞' ELSE {_CLOCK} END AS state,
      CASE WHEN t IS NULL THEN 'oo' WHEN jm > 0 THEN printf('%02d:%02d', jm, s) ELSE s || 's' END AS job,
      CASE WHEN t IS NULL THEN '01:00:05' ELSE {_CLOCK} END AS cycle FROM p""",
)
def n13(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    start = F.col("o_orderdate").cast("timestamp")
    seconds = F.when(F.col("o_orderstatus") != "O", F.floor("o_totalprice") % 9000)
    end = F.timestamp_seconds(F.unix_seconds(start) + seconds)
    now = F.timestamp_seconds(F.unix_seconds(start) + 3605)
    return orders.select(
        "o_orderkey", M.duration_text(start, end).alias("state"), M.job_duration_text(start, end).alias("job"),
        M.cycle_duration_text(start, end, now).alias("cycle"),
    )


@query(
    "N14_progress_percent",
    """WITH t AS (SELECT o_custkey, count(*) - 9 AS total, count(*) FILTER (o_orderstatus = 'F') - 1 AS done FROM orders GROUP BY 1)
    SELECT o_custkey, round(CASE WHEN total <= 0 THEN 0.0 ELSE least(100.0, greatest(0.0, CAST(done AS DOUBLE) / total * 100)) END, 1) AS pct FROM t""",
)
def n14(spark, sf_dir):
    t = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        (F.count("*") - 9).alias("total"), (F.count_if(F.col("o_orderstatus") == "F") - 1).alias("done")
    )
    return t.select("o_custkey", F.round(M.percent(F.col("done"), F.col("total")), 1).alias("pct"))


@query(
    "N15_iso_and_short_date",
    f"WITH {OBS_SQL} SELECT uid, strftime(make_timestamp(seen * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(make_timestamp(seen * 1000000), '%d/%m/%y') AS short FROM obs",
)
def n15(spark, sf_dir):
    return observations(spark, sf_dir).select("uid", M.iso("seen").alias("iso"), M.short_date("seen").alias("short"))


@query(
    "N16_month_arithmetic",
    """SELECT o_orderkey, strftime(o_orderdate + INTERVAL 7 HOUR + INTERVAL 1 MONTH, '%Y-%m-%d %H:%M:%S') AS later,
              strftime(o_orderdate + INTERVAL 7 HOUR - INTERVAL 3 MONTH, '%Y-%m-%d %H:%M:%S') AS earlier FROM orders""",
)
def n16(spark, sf_dir):
    stamp = F.col("o_orderdate").cast("timestamp") + F.make_interval(hours=F.lit(7))
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", show(M.add_months(stamp, 1)).alias("later"), show(M.add_months(stamp, -3)).alias("earlier")
    )


@query("N17_report_hostname", f"WITH {PAGES_SQL} SELECT page_id, CASE page_id % 4 WHEN 0 THEN fqdn WHEN 3 THEN fqdn END AS name FROM pg")
def n17(spark, sf_dir):
    raw = F.expr("CASE page_id % 4 WHEN 0 THEN ' ' || upper(fqdn) || '.. ' WHEN 1 THEN '8.8.4.' || (page_id % 200) || '.' WHEN 2 THEN split(fqdn, '[.]')[0] ELSE fqdn END")
    return pages(spark, sf_dir).select("page_id", T.report_hostname(raw).alias("name"))


@query(
    "N18_recipients",
    """SELECT c_custkey, 'c' || c_custkey || '@x.lu|' || lower(c_mktsegment) || CASE WHEN c_nationkey < 5 THEN '' ELSE '@y.org' END AS recipients, c_nationkey >= 5 AS valid FROM customer""",
)
def n18(spark, sf_dir):
    raw = F.expr("' C' || c_custkey || '@x.LU ;c' || c_custkey || '@x.lu,\\n' || c_mktsegment || CASE WHEN c_nationkey < 5 THEN '' ELSE '@y.org' END || ';;'")
    rows = table(spark, sf_dir, "customer").select("c_custkey", T.split_recipients(raw).alias("r"))
    return rows.select("c_custkey", F.array_join("r", "|").alias("recipients"), T.recipients_valid(F.col("r")).alias("valid"))


@query(
    "N19_enclosing_networks",
    with_docs(
        f""", p AS (SELECT DISTINCT ip, ip_num, unnest(range(16, 25)) AS p FROM docs), q AS (SELECT ip, p, ip_num - ip_num % (CAST(1 AS BIGINT) << CAST(32 - p AS INT)) AS lo FROM p)
        SELECT ip, {ip_sql('lo')} || '/' || p AS net FROM q"""
    ),
)
def n19(spark, sf_dir):
    places = documents(spark, sf_dir).select("ip", "ip_key").distinct()
    return places.select("ip", F.explode(N.enclosing_networks("ip_key")).alias("net"))


@query(
    "N20_target_kind",
    f"""WITH a AS (SELECT p_partkey, p_size, {_SPREAD} AS n, 12 + p_partkey % 20 AS p FROM part),
    b AS (SELECT *, n - n % (CAST(1 AS BIGINT) << CAST(32 - p AS INT)) AS lo, n - n % (CAST(1 AS BIGINT) << CAST(32 - p AS INT)) + (CAST(1 AS BIGINT) << CAST(32 - p AS INT)) - 1 AS hi FROM a)
    SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'fqdn' WHEN 1 THEN CASE WHEN {_private_sql('n', 'n')} THEN 'invalid' ELSE 'address' END
       WHEN 2 THEN CASE WHEN {_private_sql('lo', 'hi')} THEN 'invalid' ELSE 'network' END ELSE 'invalid' END AS kind FROM b""",
)
def n20(spark, sf_dir):
    address = N.ipv4_text(F.expr(_SPREAD))
    k = F.col("p_size") % 4
    text = (
        F.when(k == 0, F.expr("'a-' || p_partkey || '.example.org.'")).when(k == 1, address)
        .when(k == 2, F.concat(address, F.lit("/"), (12 + F.col("p_partkey") % 20).cast("string")))
        .otherwise(F.concat(F.lit("x"), address))
    )
    return table(spark, sf_dir, "part").select("p_partkey", N.target_kind(text).alias("kind"))


@query(
    "N21_rule_version",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN TIMESTAMP '1970-01-01' WHEN 5 THEN NULL WHEN 3 THEN o_orderdate - INTERVAL 2 HOUR ELSE o_orderdate END AS version FROM orders""",
)
def n21(spark, sf_dir):
    raw = F.expr(
        """CASE o_orderkey % 6 WHEN 0 THEN date_format(o_orderdate, "yyyyMMdd'T'HHmmss'Z'") WHEN 1 THEN date_format(o_orderdate, 'yyyyMMddHHmmss')
        WHEN 2 THEN date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss'Z'") WHEN 3 THEN date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss") || '+02:00'
        WHEN 4 THEN '' ELSE 'soon' END"""
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", M.rule_version(raw).cast("timestamp_ntz").alias("version"))


@query(
    "N22_port_rows",
    """WITH r AS (SELECT p_partkey, p_size * 1400 - 1400 AS value, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE upper(p_brand) END AS proto FROM part),
    ok AS (SELECT *, value BETWEEN 1 AND 65535 AND proto <> '' AS valid FROM r),
    d AS (SELECT value || ':' || proto AS key, count(*) AS n FROM ok WHERE valid GROUP BY 1)
    SELECT ok.p_partkey, ok.valid, CASE WHEN ok.valid THEN value || ':' || proto END AS key, coalesce(d.n > 1, false) AS duplicate
    FROM ok LEFT JOIN d ON ok.valid AND d.key = value || ':' || proto""",
)
def n22(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_size") * 1400 - 1400).alias("value"),
        T.protocol_label(F.when(F.col("p_partkey") % 9 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.lower("p_brand")))).alias("proto"),
    )
    valid = T.is_port_number("value") & F.col("proto").isNotNull()
    rows = rows.select("p_partkey", valid.alias("valid"), F.when(valid, T.port_protocol_key("value", "proto")).alias("key"))
    seen = rows.filter("valid").groupBy("key").agg(F.count("key").alias("n"))
    return rows.join(seen, "key", "left").select("p_partkey", "valid", "key", F.coalesce(F.col("n") > 1, F.lit(False)).alias("duplicate"))


@query("N23_id_shape", f"WITH {OBS_SQL} SELECT uid, event_type NOT IN ('error', 'view', 'click') AS valid FROM obs")
def n23(spark, sf_dir):
    from vantage.operators.shape import doc_id

    uid = doc_id("ip_num", "k", "event_type")
    raw = (
        F.when(F.col("event_type") == "error", F.replace(uid, F.lit("-"), F.lit("")))
        .when(F.col("event_type") == "view", F.concat(F.substring(uid, 1, 35), F.lit("g")))
        .when(F.col("event_type") == "click", F.lit(None)).otherwise(F.upper(uid))
    )
    return observations(spark, sf_dir).select("uid", T.is_uuid(raw).alias("valid"))


