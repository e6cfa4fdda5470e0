"""Engine tables derived from the given tables, in Spark and in reference SQL.

Column expressions are written once, in the subset both dialects share.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import spread, table
from vantage.schema import FIELDS

NOW = dt.datetime(2024, 1, 31)
NOW_S = 1706659200
BASE_IP = 134742016  # 8.8.0.0

IP_NUM = f"({BASE_IP} + user_id * 256 + event_id % 16) % 4294967296"

# Multi-valued document fields: list of value expressions, null values dropped.
DOC_FIELDS = {
    "fqdn": [
        "'h' || user_id || '.' || event_type || '.example.com'",
        "CASE WHEN event_id % 3 = 0 THEN 'www.shop' || (user_id % 10) || '.example.net' END",
        "CASE WHEN event_id % 11 = 0 THEN '10.1.2.3' END",
    ],
    "fqdn_requested": [
        "CASE WHEN event_id % 4 = 0 THEN 'h' || user_id || '.' || event_type || '.example.com' END",
        "CASE WHEN event_id % 8 = 0 THEN 'a.req' || (event_id % 30) || '.example.org' END",
    ],
    "host": [
        "'h' || user_id || '.' || event_type",
        "CASE WHEN event_id % 3 = 0 THEN 'www.shop' || (user_id % 10) END",
    ],
    "domain": ["'example.com'", "CASE WHEN event_id % 3 = 0 THEN 'example.net' END"],
    "domain_requested": ["CASE WHEN event_id % 4 = 0 THEN 'example.com' END"],
    "tld": ["'com'", "CASE WHEN event_id % 3 = 0 THEN 'net' END"],
    "tag": [
        "'soft:' || event_type",
        "'lang:l' || (user_id % 3)",
        "CASE WHEN kn >= 90 THEN 'hard:big' END",
    ],
    "port": ["k"],
    "http_title": ["event_type || ' portal ' || (user_id % 20)"],
    "http_favicon_mmhash": ["CASE WHEN event_id % 5 = 0 THEN CAST(user_id * 7919 - 5000 AS VARCHAR(20)) END"],
    "http_cookiename": [
        "CASE WHEN event_id % 3 = 0 THEN 'c' || (user_id % 7) END",
        "CASE WHEN event_id % 3 = 0 THEN 'session' END",
    ],
    "http_header": ["'server'", "CASE WHEN event_id % 2 = 0 THEN 'x-powered-by' END"],
    "http_headval": [
        "CASE WHEN event_id % 2 = 0 THEN 'x-powered-by:php/' || (event_id % 9) || '.' || (user_id % 5) END",
        "CASE WHEN event_id % 6 = 0 THEN 'content-type:text/' || event_type END",
    ],
    "http_server": ["event_type || '/' || (kn % 10)", "CASE WHEN event_id % 7 = 0 THEN 'proxy' END"],
    "x509_issuer": ["CASE WHEN user_id % 2 = 0 THEN 'ca ' || (user_id % 4) END"],
    "banner": ["'220 ' || event_type || ' ready ' || k"],
}


def observations(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """events -> one observation per row (`events` may be a stream)."""
    return observed(spread(table(spark, sf_dir, "events") if events is None else events))


def observed(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id", "user_id", "event_type", "value",
        "get_json_object(props, '$.k') AS k",
        "CAST(get_json_object(props, '$.k') AS INT) AS kn",
        "CAST(event_id AS STRING) AS uid",
        f"{IP_NUM} AS ip_num",
        "unix_seconds(CAST(ts AS TIMESTAMP)) AS seen",
        *[c for c in events.columns if c == "blk"],
    )


def documents(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """events -> parsed documents with every searchable field."""
    from vantage.functions.netaddr import ipv4_text, v4_key

    obs = observations(spark, sf_dir, events)
    fields = []
    for name in FIELDS:
        values = DOC_FIELDS.get(name)
        if values:
            text = ", ".join(f"CAST({v} AS STRING)" for v in values)
            fields.append(F.expr(f"array_compact(array({text}))".replace("VARCHAR(20)", "STRING")).alias(name))
        else:
            fields.append(F.expr("CAST(array() AS ARRAY<STRING>)").alias(name))
    return obs.select(
        "uid", ipv4_text("ip_num").alias("ip"), F.lit(4).alias("ip_version"), "ip_num",
        v4_key("ip_num").alias("ip_key"),
        F.col("seen").alias("first_seen"),
        (F.col("seen") + (F.col("event_id") % 5) * 43200).alias("last_seen"),
        *fields,
    )


OBS_SQL = f"""
obs AS (
  SELECT event_id, user_id, event_type, value,
         json_extract_string(props, '$.k') AS k,
         CAST(json_extract_string(props, '$.k') AS INT) AS kn,
         CAST(event_id AS VARCHAR) AS uid,
         {IP_NUM} AS ip_num,
         CAST(floor(epoch(ts)) AS BIGINT) AS seen
  FROM events)"""

IP_TEXT_SQL = "((ip_num >> 24) || '.' || ((ip_num >> 16) & 255) || '.' || ((ip_num >> 8) & 255) || '.' || (ip_num & 255))"


def _list(values: list[str] | None) -> str:
    if not values:
        return "CAST([] AS VARCHAR[])"
    return "list_filter([" + ", ".join(values) + "], lambda x: x IS NOT NULL)"


DOCS_SQL = (
    OBS_SQL
    + f""",
docs AS (
  SELECT uid, {IP_TEXT_SQL} AS ip, ip_num, seen AS first_seen,
         seen + (event_id % 5) * 43200 AS last_seen,
         """
    + ",\n         ".join(f"{_list(DOC_FIELDS.get(f))} AS {f}" for f in FIELDS)
    + "\n  FROM obs)"
)

POSTINGS_SQL = (
    DOCS_SQL
    + ",\npostings AS (SELECT DISTINCT * FROM ("
    + " UNION ALL ".join(f"SELECT '{f}' AS field, unnest({f}) AS value, uid FROM docs" for f in FIELDS)
    + "))"
)


def _after(ctes: str, sql: str) -> str:
    """Append a query, or further CTEs when it starts with a comma."""
    return f"WITH {ctes}{'' if sql.lstrip().startswith(',') else chr(10)}{sql}"


def with_docs(sql: str) -> str:
    return _after(DOCS_SQL, sql)


def with_postings(sql: str) -> str:
    return _after(POSTINGS_SQL, sql)
