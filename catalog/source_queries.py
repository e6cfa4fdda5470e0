"""Sources and sinks (S1-S3, S6-S11, S14-S16): derived text is written, then read."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, table
from catalog.bindings import BASE_IP, OBS_SQL, documents, observations
from catalog.range_queries import REGISTRY_SQL, ip_sql, registry_records
from catalog.rule_queries import rule_tables
from catalog.scan_binding import port_documents, scan_json, with_scans
from vantage.functions import netaddr as N
from vantage.operators import ranges as K
from vantage.session import shared_dir
from vantage.sources import lists as LI
from vantage.sources import rules as RS
from vantage.sources import scans as SC
from vantage.sources import sinks


def _written(df, name):
    """Write text rows and return the folder."""
    path = shared_dir(df.sparkSession, name)
    df.write.text(path)
    return path


@query("S1_scan_source", with_scans("SELECT DISTINCT ip AS addr, blk, count(*) OVER (PARTITION BY blk) AS ports, CAST(s0 AS VARCHAR) AS starttime FROM sd").replace("SELECT DISTINCT ip AS addr, blk,", "SELECT DISTINCT ip AS addr, CAST(blk % 50 AS VARCHAR) AS name,"))
def s1(spark, sf_dir):
    path = _written(scan_json(spark, sf_dir).select("value"), "scans")
    return SC.read_scans(spark, path, lines=True).select(
        "addr", F.regexp_extract(F.col("hostnames")[0]["name"], "U([0-9]+)", 1).alias("name"), F.size("ports").cast("bigint").alias("ports"), "starttime"
    ).distinct()


_MIXED = """CASE event_id % 5 WHEN 0 THEN '{"addr":"' || event_id || '"}' WHEN 1 THEN '[{"addr":"' || event_id || '"},' || event_id || ',{"addr":"b' || event_id || '"}]'
   WHEN 2 THEN '{broken' || event_id WHEN 3 THEN '"' || event_id || '"' ELSE '[]' END"""


def _mixed(spark, sf_dir):
    path = _written(observations(spark, sf_dir).select(F.expr(_MIXED).alias("value")), "mixed")
    return SC.split_bad(SC.items(SC.read_values(spark, path, lines=True)))


@query(
    "S2_bad_records",
    f"""WITH {OBS_SQL} SELECT reason, count(*) AS count FROM (SELECT CASE event_id % 5 WHEN 1 THEN 'not_object' WHEN 2 THEN 'unreadable' WHEN 3 THEN 'not_object' END AS reason FROM obs)
    WHERE reason IS NOT NULL GROUP BY reason""",
)
def s2(spark, sf_dir):
    return _mixed(spark, sf_dir)[1].groupBy("reason").agg(F.count("*").alias("count"))


@query("S2_good_records", f"WITH {OBS_SQL} SELECT CAST(event_id AS VARCHAR) AS addr FROM obs WHERE event_id % 5 <= 1 UNION ALL SELECT 'b' || event_id FROM obs WHERE event_id % 5 = 1")
def s2_good(spark, sf_dir):
    return SC.scans(_mixed(spark, sf_dir)[0]).select("addr")


@query("S3_document_sink", with_scans("SELECT ip, k AS portid, true AS foldered FROM sd"))
def s3(spark, sf_dir):
    """Documents written foldered by id and read back."""
    path = shared_dir(spark, "documents")
    sinks.write_docs(port_documents(spark, sf_dir).select("id", "ip", "body"), path)
    back = spark.read.schema("id string, ip string, body struct<ports:array<struct<portid:string>>>, shard string").option("basePath", path).json(path)
    return back.select("ip", F.col("body.ports")[0]["portid"].alias("portid"), (F.substring("id", 1, 1) == F.col("shard")).alias("foldered"))


_COMPANION = """CASE WHEN event_type = 'view' THEN '{"id":"' || uid || '","first_seen":null,"last_seen":"' || seen || '000"}'
   WHEN event_type = 'click' THEN '{"id":"' || uid || '","first_seen":"bad","last_seen":""}' WHEN event_type = 'error' THEN NULL
   ELSE '{"id":"' || uid || '","first_seen":' || (seen + 50) || ',"last_seen":"' || seen || '"}' END"""


def _companions(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumn("value", F.expr(_COMPANION))
    path = _written(rows.filter("value IS NOT NULL").select("value"), "times")
    return SC.read_seen_companions(spark, path, lines=True)


@query(
    "S6_seen_companions",
    f"""WITH {OBS_SQL} SELECT uid AS id, CASE WHEN event_type = 'click' THEN NULL ELSE seen END AS first_seen, CASE WHEN event_type = 'click' THEN NULL
       WHEN event_type = 'view' THEN seen ELSE seen + 50 END AS last_seen, event_type <> 'click' AS usable FROM obs WHERE event_type <> 'error'""",
)
def s6(spark, sf_dir):
    return _companions(spark, sf_dir)


@query(
    "S6_companion_counts",
    f"WITH {OBS_SQL} SELECT CASE event_type WHEN 'error' THEN 'missing' WHEN 'click' THEN 'invalid' ELSE 'usable' END AS status, count(*) AS count FROM obs GROUP BY 1",
)
def s6_counts(spark, sf_dir):
    return SC.companion_counts(documents(spark, sf_dir).select(F.col("uid").alias("id")), _companions(spark, sf_dir))


@query("S7_registry_source", f"WITH {REGISTRY_SQL} SELECT * FROM reg")
def s7(spark, sf_dir):
    records = registry_records(spark, sf_dir).select(F.concat(F.array_join("lines", "\n"), F.lit("\n")).alias("value"))
    path = _written(records, "rpsl")
    found = K.match_registry(LI.read_rpsl(spark, path), ["lu"], ["REGION 11 "])
    return found.select(N.key_text("lo").alias("first"), N.key_text("hi").alias("last"), "description")


@query(
    "S8_delegated_source",
    f"""WITH d AS (SELECT s_suppkey, s_nationkey, {BASE_IP} + s_suppkey * 4096 AS lo, CASE WHEN s_nationkey % 2 = 0 THEN 256 ELSE 1024 END AS n FROM supplier WHERE s_nationkey <> 1 AND s_nationkey <> 2)
    SELECT {ip_sql('lo')} || CASE WHEN n = 256 THEN '/24' ELSE '/22' END AS cidr FROM d WHERE s_nationkey BETWEEN 3 AND 9 OR s_nationkey = 21""",
)
def s8(spark, sf_dir):
    start = N.ipv4_text(F.lit(BASE_IP) + F.col("s_suppkey") * 4096)
    count = F.when(F.col("s_nationkey") % 2 == 0, F.lit("256")).otherwise(F.lit("1024"))
    line = (
        F.when(F.col("s_nationkey") == 1, F.concat(F.lit("# comment|"), start))
        .when(F.col("s_nationkey") == 2, F.concat(F.lit("lacnic|BR|ipv4|"), start, F.lit("|256|2020")))
        .otherwise(
            F.concat_ws(
                "|", F.lit("lacnic"), F.when(F.col("s_nationkey").between(3, 9), F.lit("br")).otherwise(F.lit("CL")), F.lit("ipv4"),
                start, count, F.lit("20200101"), F.when(F.col("s_nationkey") == 21, F.lit("Reserved-X")).otherwise(F.lit("allocated")),
            )
        )
    )
    path = _written(table(spark, sf_dir, "supplier").select(line.alias("value")), "delegated")
    return K.match_delegated(LI.read_delegated(spark, path), "lacnic", ["BR"], ["reserved-x"]).select("cidr")


@query("S9_target_list", "SELECT 'a' || c_custkey || '.example.com' AS value FROM customer UNION ALL SELECT '8.8.0.' || (c_custkey % 200) FROM customer WHERE c_nationkey < 12")
def s9(spark, sf_dir):
    value = F.expr("' \"a' || c_custkey || '.example.com\",\\r' || CASE WHEN c_nationkey < 12 THEN '8.8.0.' || (c_custkey % 200) || ';' ELSE ' ' END || '\\r'")
    path = _written(table(spark, sf_dir, "customer").select(value.alias("value")), "targets")
    return LI.read_target_list(spark, path, bulk=True).select("value")


_RULE_FILES_SQL = """WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, 'r' || s_suppkey AS name FROM supplier)"""


def _rule_files(spark, sf_dir):
    rules, _ = rule_tables(spark, sf_dir)
    query_text = F.expr("""'http_server.bg:"a \\'' || ord || '" port:' || (ord % 100) || ' OR ' || CASE WHEN ord % 5 = 0 THEN 'nofield:1' ELSE 'http_title.lk:X' END""")
    named = rules.select(
        F.concat(F.lit("R"), "ord").alias("name"), F.concat(F.lit("rule: "), "ord").alias("description"), query_text.alias("query"), "tags"
    )
    path = shared_dir(spark, "rules")
    sinks.export_rules(named, path, "20260520T133458Z")
    return RS.load_rules(spark, path)


@query(
    "S10_rule_files",
    f"""{_RULE_FILES_SQL} SELECT name AS rule, CAST(g AS INT) AS grp, CAST(t AS INT) AS term, field, op, value FROM (
      SELECT name, 0 AS g, 0 AS t, 'http_server' AS field, 'begin' AS op, 'a ''' || k AS value FROM s WHERE k % 5 <> 0
      UNION ALL SELECT name, 0, 1, 'port', 'exact', CAST(k % 100 AS VARCHAR) FROM s WHERE k % 5 <> 0
      UNION ALL SELECT name, 1, 0, 'http_title', 'like', 'x' FROM s WHERE k % 5 <> 0)""",
)
def s10(spark, sf_dir):
    return _rule_files(spark, sf_dir)[1]


@query(
    "S11_rule_export",
    f"""{_RULE_FILES_SQL} SELECT name, 'rule: ' || k AS description, 'soft:s' || n || '|rule:r' || k AS tags, '20260520T133458Z' AS version FROM s""",
)
def s11(spark, sf_dir):
    rules, _ = _rule_files(spark, sf_dir)
    return rules.select("name", "description", F.array_join("tags", "|").alias("tags"), "version")


_PDNS = """CASE user_id % 6 WHEN 0 THEN '{"rrtype":"A","rrname":"N' || user_id || '.Example.com.","rdata":"8.8.4.4"}' WHEN 1 THEN '{"rrtype":"CNAME","rrname":"c.example.com"}'
   WHEN 2 THEN '{"type":"a","rdata":["8.8.8.8","list' || user_id || '.example.net"]}' WHEN 3 THEN '{broken' WHEN 4 THEN '[1]' ELSE '{"name":"nodot","fqdn":"F' || user_id || '.example.org"}' END"""
_PDNS_SQL = "CASE user_id % 6 WHEN 0 THEN 'n' || user_id || '.example.com' WHEN 2 THEN 'list' || user_id || '.example.net' WHEN 5 THEN 'f' || user_id || '.example.org' END"


@query("S14_passive_dns", f"WITH {OBS_SQL} SELECT uid AS ip, {_PDNS_SQL} AS fqdn FROM obs WHERE user_id % 6 IN (0, 2, 5)")
def s14(spark, sf_dir):
    rows = observations(spark, sf_dir).select(F.expr(f"replace({_PDNS}, '{{\"', '{{\"ip\":\"' || uid || '\",\"')").alias("value"))
    return LI.read_pdns(spark, _written(rows, "pdns")).select("ip", "fqdn")


@query("S15_suffixes", "SELECT DISTINCT lower(p_brand) AS suffix FROM part WHERE p_size <> 7 UNION SELECT 'extra' UNION SELECT 'brand#1'")
def s15(spark, sf_dir):
    line = F.when(F.col("p_size") == 7, F.lit("# comment")).when(F.col("p_size") == 8, F.concat(F.lit("  "), "p_brand", F.lit(" "))).otherwise(F.upper("p_brand"))
    rows = table(spark, sf_dir, "part").select(F.when(F.col("p_size") == 9, F.concat(line, F.lit("\n\n"))).otherwise(line).alias("value"))
    return LI.read_suffixes(spark, _written(rows, "suffixes"), [" Extra", "brand#1", " "])


_DEFAULTS_SQL = "(SELECT unnest([" + ", ".join(f"'{h}'" for h in LI.COLLECTED_HEADERS) + "]) AS header_name)"
_VALUED_SQL = ", ".join(f"'{h}'" for h in LI.VALUE_HEADERS)


@query(
    "S16_header_collection",
    f"""SELECT header_name, bool_or(v) AS collect_value FROM (SELECT header_name, header_name IN ({_VALUED_SQL}) AS v FROM {_DEFAULTS_SQL}
      UNION ALL SELECT 'x-' || replace(p_name, ' ', '-'), p_size > 45 FROM part UNION ALL SELECT 'x-cms', false FROM part UNION ALL SELECT 'x-framework', p_size > 99 FROM part) GROUP BY 1""",
)
def s16(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select(F.concat(F.lit(" X-"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("header_name"), (F.col("p_size") > 45).alias("collect_value"))
    rows = rows.union(part.select(F.lit("x-cms"), F.lit(None).cast("boolean"))).union(part.select(F.lit("X-Framework"), F.col("p_size") > 99))
    rows = rows.union(part.select(F.col("p_name"), F.lit(True)).filter(F.col("p_name").contains(" ")))
    return LI.header_collection(spark, rows)


