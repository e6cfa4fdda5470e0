"""events -> raw scan results: four consecutive events are the ports of one scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import spread, table
from catalog.bindings import BASE_IP, OBS_SQL
from catalog.bindings import observed as observed_events
from vantage.functions.netaddr import ipv4_text
from vantage.operators.extract import Config
from vantage.operators.shape import observed, split_ports
from vantage.sources.scans import scans, split_bad, items

CONFIG = Config(("com", "net", "org", "example.org"), {"server": False, "x-powered-by": True, "content-type": True})

# Script texts, in the subset both dialects share; null when the script is absent.
# Line feeds are written ~ and replaced at the end.
HEADERS = (
    "'HTTP/1.1 200 OK~  Server: ' || event_type || '/' || (kn % 10) || '~|_X-Powered-By: PHP/' || (event_id % 9) || '~Content-Type:~Set-Cookie: C' || (user_id % 7) "
    "|| '=1; path=/~ set-cookie: sid~ETag: W/e' || (event_id % 100) || '~Location: https://www.' || event_type || (kn % 5) || '.Example.org/x?y'"
)
TITLE = "CASE WHEN event_id % 2 = 0 THEN event_type || ' portal ' || (user_id % 20) ELSE '' END"
BANNER = "CASE WHEN kn < 70 THEN '220 ' || event_type || '~ ready ' || k || ' mx' || (kn % 9) || '.mail.example.net' END"
ICON = (
    "CASE WHEN event_id % 5 = 0 THEN 'x Unknown favicon  MD5: ' || upper(md5(CAST(user_id AS VARCHAR(20)))) "
    "WHEN event_id % 5 = 1 THEN '~ favicon_file: /f' || kn || '.ico ~|_ sha256: S' || user_id END"
)


def _sp(text: str) -> str:
    return f"replace({text.replace('VARCHAR(20)', 'STRING')}, '~', '\\n')"


def scan_json(spark, sf_dir):
    """Raw scan results as JSON text, one per block of four events."""
    # a block holds at most four events; they are brought together while they are narrow
    block = F.floor(F.col("event_id") / 4)
    obs = observed_events(spread(table(spark, sf_dir, "events").withColumn("blk", block), "blk"))
    script = lambda name, out: F.when(F.expr(out).isNotNull(), F.to_json(F.struct(F.lit(name).alias("id"), F.expr(_sp(out)).alias("output"))))
    icon_name = F.when(F.col("event_id") % 5 == 0, F.lit("http-favicon")).otherwise(F.lit("http-mm-sha-favicon"))
    icon = F.when(
        F.expr(ICON.replace("VARCHAR(20)", "STRING")).isNotNull(),
        F.to_json(
            F.struct(
                icon_name.alias("id"), F.expr(_sp(ICON)).alias("output"),
                F.when(F.col("event_id") % 5 == 1, -F.col("user_id")).alias("favicon-mmhash"),
            )
        ),
    )
    cert = F.when(
        F.col("event_id") % 3 == 0,
        F.to_json(
            F.struct(
                F.lit("ssl-cert").alias("id"), F.lit("cert").alias("output"),
                F.struct(F.expr("'CA' || (user_id % 4) || '.example.com'").alias("commonName")).alias("issuer"),
                F.when(F.col("kn") < 50, F.struct(F.expr("'subject ' || k").alias("commonName"))).alias("subject"),
                F.expr("md5(k)").alias("md5"), F.expr("sha1(k)").alias("sha1"), F.expr("sha2(k, 256)").alias("sha256"),
                F.struct(F.expr("'DNS:san' || kn || '.example.net, DNS:*.x'").alias("X509v3 Subject-Alternative Name")).alias("extensions"),
            )
        ),
    )
    scripts = F.concat(
        F.lit("["),
        F.concat_ws(",", script("http-headers", HEADERS), script("http-title", TITLE), script("banner", BANNER), cert, icon),
        F.lit("]"),
    )
    port = F.concat(
        F.lit('{"portid":'), "k", F.lit(',"protocol":"tcp","hsh256":"old","service":{"name":"'), "event_type",
        F.lit('"},"scripts":'), scripts, F.lit("}"),
    )
    grouped = obs.select("blk", "event_id", "user_id", "seen", port.alias("port")).groupBy("blk").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "port"))).alias("ports"),
        F.min("user_id").alias("u"), F.min("seen").alias("s0"), F.max("seen").alias("s1"),
    )
    ip = ipv4_text((F.lit(BASE_IP) + F.col("u") * 256 + F.col("blk") % 16) % 4294967296)
    text = F.concat(
        F.lit('{"addr":"'), ip, F.lit('","hostnames":[{"name":" U'), (F.col("blk") % 50).cast("string"),
        F.lit('.Example.COM.","type":"user"},{"name":"ptr'), F.col("u").cast("string"), F.lit('.example.net","type":"PTR"},{"name":"u'),
        (F.col("blk") % 50).cast("string"), F.lit('.example.nowhere","type":"user"}],"starttime":"'), F.col("s0").cast("string"),
        F.lit('","endtime":'), F.col("s1").cast("string"), F.lit(',"ports":['),
        F.array_join(F.transform("ports", lambda p: p["port"]), ","), F.lit("]}"),
    )
    return grouped.select("blk", text.alias("value"))


def typed_scans(spark, sf_dir):
    values = scan_json(spark, sf_dir).select(F.parse_json("value").alias("value"))
    return scans(split_bad(items(values))[0])


def port_documents(spark, sf_dir):
    return observed(split_ports(typed_scans(spark, sf_dir)))


SCAN_SQL = (
    OBS_SQL
    + f""",
blk AS (SELECT event_id // 4 AS blk, min(user_id) AS u, min(seen) AS s0, max(seen) AS s1 FROM obs GROUP BY 1),
sd0 AS (SELECT o.*, b.blk, b.u, b.s0, b.s1, ({BASE_IP} + b.u * 256 + b.blk % 16) % 4294967296 AS n,
   replace({HEADERS}, '~', chr(10)) AS headers, {TITLE} AS title, replace({BANNER}, '~', '') AS banner FROM obs o JOIN blk b ON b.blk = o.event_id // 4),
sd AS (SELECT *, (n >> 24) || '.' || ((n >> 16) & 255) || '.' || ((n >> 8) & 255) || '.' || (n & 255) AS ip FROM sd0)"""
)


def with_scans(sql: str) -> str:
    return f"WITH {SCAN_SQL}{'' if sql.lstrip().startswith(',') else chr(10)}{sql}"
