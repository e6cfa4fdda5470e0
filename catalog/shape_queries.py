"""Shaping and extraction (T1-T7, P1-P17) over scans derived from events, and names from pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, table
from catalog.expression_queries import PAGES_SQL, pages
from catalog.scan_binding import CONFIG, port_documents, typed_scans, with_scans
from vantage.operators import extract as E
from vantage.operators import shape as H
from vantage.operators.store import build_postings
from vantage.session import local_table
from vantage.operators.search import ip_ports, ip_timeline, ptr_names, resolved_names

_PORT0 = "body.ports"


def _port():
    return F.get(F.col(_PORT0), 0)


def _out(name):
    return F.get(F.filter(_port()["scripts"], lambda s: s["id"] == name), 0)["output"]


@query("T1_port_split", with_scans("SELECT ip, k AS portid, 'tcp' AS protocol, event_type AS service, CAST(1 AS INT) AS ports, CAST(s1 AS VARCHAR) AS endtime FROM sd"))
def t1(spark, sf_dir):
    docs = H.split_ports(typed_scans(spark, sf_dir))
    return docs.select(
        "ip", _port()["portid"].alias("portid"), _port()["protocol"].alias("protocol"), _port()["service"]["name"].alias("service"),
        F.size(_PORT0).alias("ports"), F.col("body.endtime").alias("endtime"),
    )


@query("T2_banner_cleaning", with_scans("SELECT ip, k AS portid, banner FROM sd"))
def t2(spark, sf_dir):
    return port_documents(spark, sf_dir).select("ip", _port()["portid"].alias("portid"), _out("banner").alias("banner"))


@query(
    "T3_legacy_icon",
    with_scans(
        """SELECT ip, k AS portid, CASE event_id % 5 WHEN 0 THEN chr(10) || ' favicon_md5: ' || md5(CAST(user_id AS VARCHAR))
           WHEN 1 THEN chr(10) || ' favicon_file: /f' || kn || '.ico ' || chr(10) || '|_ sha256: S' || user_id END AS icon FROM sd"""
    ),
)
def t3(spark, sf_dir):
    return port_documents(spark, sf_dir).select("ip", _port()["portid"].alias("portid"), _out("http-mm-sha-favicon").alias("icon"))


# Equal content has equal hashes: distinct hashes per port and service = distinct contents.
_CONTENT = """headers || '#' || title || '#' || coalesce(banner, '') || '#' || (CASE WHEN event_id % 3 = 0 THEN 'c' || (user_id % 4) || kn ELSE '' END)
   || '#' || (CASE event_id % 5 WHEN 0 THEN 'm' || user_id WHEN 1 THEN 'f' || user_id || ',' || kn ELSE '' END)"""


@query("T4_content_hash", with_scans(f"SELECT k AS portid, event_type AS service, count(DISTINCT {_CONTENT}) AS hashes, count(*) AS docs FROM sd GROUP BY ALL"))
def t4(spark, sf_dir):
    docs = port_documents(spark, sf_dir)
    return docs.groupBy(_port()["portid"].alias("portid"), _port()["service"]["name"].alias("service")).agg(
        F.countDistinct("body.hsh256").alias("hashes"), F.count("id").alias("docs")
    )


@query("T6_helper_strip", with_scans("SELECT ip, false AS has_hash, count(*) AS ports FROM sd GROUP BY ip"))
def t6(spark, sf_dir):
    stripped = typed_scans(spark, sf_dir).select(F.col("addr").alias("ip"), H.strip_port_hash(F.col("ports")).alias("ports"))
    has = "hsh256" in stripped.schema["ports"].dataType.elementType.fieldNames()
    return stripped.groupBy("ip").agg(F.lit(has).alias("has_hash"), F.sum(F.size("ports")).alias("ports"))


@query(
    "T7_same_content",
    with_scans(
        f""", g AS (SELECT ip, k, event_type, {_CONTENT} AS c, min(s1) - 500 AS first_seen, max(s1) AS last_seen FROM sd GROUP BY ALL)
        SELECT ip, k AS portid, first_seen, last_seen FROM g"""
    ),
)
def t7(spark, sf_dir):
    # every document twice, the second time seen earlier; made in the row, so scans are parsed once
    twice = port_documents(spark, sf_dir).withColumn("_e", F.explode(F.array(F.lit(0), F.lit(500))))
    docs = twice.select("id", "ip", "body", (F.col("first_seen") - F.col("_e")).alias("first_seen"), (F.col("last_seen") - F.col("_e")).alias("last_seen"))
    return H.dedup_docs(docs).select("ip", _port()["portid"].alias("portid"), "first_seen", "last_seen")


def _field_query(name, fields, exprs):
    """One extraction query: fields as joined text per port document."""
    sql = ", ".join(f"{e} AS {f}" for f, e in zip(fields, exprs))

    def run(spark, sf_dir):
        docs = E.extract_with(port_documents(spark, sf_dir), CONFIG, (*fields, "port"))
        return docs.select("ip", F.get("port", 0).alias("portid"), *[F.array_join(F.array_sort(f), "|").alias(f) for f in fields])

    query(name, with_scans(f"SELECT ip, k AS portid, {sql} FROM sd"))(run)


_field_query("P2_cookie_names", ("http_cookiename",), ("'c' || (user_id % 7) || '|sid'",))
_field_query("P3_etag", ("http_etag",), ("'w/e' || (event_id % 100)",))
_field_query("P4_server", ("http_server",), ("event_type || '/' || (kn % 10)",))
_field_query("P6_banner", ("banner",), ("coalesce(lower(banner), '')",))
_field_query("P7_headers", ("http_header", "http_headval"), ("'content-type|server|x-powered-by'", "'x-powered-by:php/' || (event_id % 9)"))
_field_query(
    "P8_certificate",
    ("x509_issuer", "x509_subject", "x509_md5", "x509_sha1", "x509_sha256", "x509_san"),
    (
        "CASE WHEN event_id % 3 = 0 THEN 'ca' || (user_id % 4) || '.example.com' ELSE '' END",
        "CASE WHEN event_id % 3 = 0 AND kn < 50 THEN 'subject ' || k ELSE '' END",
        "CASE WHEN event_id % 3 = 0 THEN md5(k) ELSE '' END", "CASE WHEN event_id % 3 = 0 THEN sha1(k) ELSE '' END",
        "CASE WHEN event_id % 3 = 0 THEN sha256(k) ELSE '' END",
        "CASE WHEN event_id % 3 = 0 THEN 'dns:san' || kn || '.example.net, dns:*.x' ELSE '' END",
    ),
)
_field_query(
    "P9_icons",
    ("http_favicon_path", "http_favicon_mmhash", "http_favicon_md5", "http_favicon_sha256"),
    (
        "CASE WHEN event_id % 5 = 1 THEN '/f' || kn || '.ico' ELSE '' END", "CASE WHEN event_id % 5 = 1 THEN CAST(-user_id AS VARCHAR) ELSE '' END",
        "CASE WHEN event_id % 5 = 0 THEN md5(CAST(user_id AS VARCHAR)) ELSE '' END", "CASE WHEN event_id % 5 = 1 THEN 's' || user_id ELSE '' END",
    ),
)

# names of one document: PTR, redirect, issuer, SAN, banner (the requested name
# ends in a dot, which the delimiter pattern does not accept)
_NAMES = """list_distinct(list_filter(['ptr' || u || '.example.net', 'www.' || event_type || (kn % 5) || '.example.org',
   CASE WHEN event_id % 3 = 0 THEN 'ca' || (user_id % 4) || '.example.com' END, CASE WHEN event_id % 3 = 0 THEN 'san' || kn || '.example.net' END,
   CASE WHEN kn < 70 THEN 'mx' || (kn % 9) || '.mail.example.net' END], lambda x: x IS NOT NULL))"""
_TLD = "CASE WHEN ends_with({x}, '.example.org') THEN 'example.org' ELSE split_part({x}, '.', -1) END"
_ROOT = "substr({x}, 1, length({x}) - length(" + _TLD + ") - 1)"


def _per_name(expr: str) -> str:
    e = expr.format(x="x", tld=_TLD.format(x="x"), root=_ROOT.format(x="x"))
    return f"array_to_string(list_sort(list_distinct(list_filter(list_transform({_NAMES}, lambda x: {e}), lambda y: y <> ''))), '|')"


_field_query(
    "P10_names",
    ("fqdn", "host", "domain", "tld"),
    (
        f"array_to_string(list_sort({_NAMES}), '|')",
        _per_name("regexp_replace({root}, '(^|\\.)[^.]*$', '')"),
        _per_name("split_part({root}, '.', -1) || '.' || {tld}"),
        _per_name("{tld}"),
    ),
)
_field_query(
    "P12_requested_names", ("fqdn_requested", "domain_requested"),
    ("'u' || (blk % 50) || '.example.com.|u' || (blk % 50) || '.example.nowhere'", "'example.com'"),
)
_field_query("P5_title_of_scans", ("http_title",), ("title",))


@query("P5_titles", "SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages")
def p5(spark, sf_dir):
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    docs = table(spark, sf_dir, "pages").select(
        "page_id", F.array(F.struct(F.array(F.struct(F.lit("http-title").alias("id"), title.alias("output"))).alias("scripts"))).alias("ports")
    )
    return docs.select("page_id", F.coalesce(F.get(E.outputs_of(F.col("ports"), "http-title"), 0), F.lit("")).alias("title"))


@query("P1_path_lookup", with_scans("SELECT ip, k AS portid, CASE WHEN event_id % 3 = 0 THEN 'DNS:san' || kn || '.example.net, DNS:*.x' END AS san, CAST(NULL AS VARCHAR) AS missing FROM sd"))
def p1(spark, sf_dir):
    cert = F.get(F.filter(_port()["scripts"], lambda s: s["id"] == "ssl-cert"), 0)["payload"]
    return port_documents(spark, sf_dir).select(
        "ip", _port()["portid"].alias("portid"), E.lookup_text(cert, "extensions.X509v3_Subject Alternative_Name").alias("san"),
        E.lookup_text(cert, "extensions.nothing.deeper").alias("missing"),
    )


@query(
    "P11_hostname_parts",
    f"""WITH {PAGES_SQL}, r AS (SELECT page_id, fqdn, CASE WHEN ends_with(fqdn, '.example.org') THEN 'example.org' WHEN ends_with(fqdn, '.net') THEN 'net' WHEN ends_with(fqdn, '.com') THEN 'com' END AS tld FROM pg),
    s AS (SELECT *, substr(fqdn, 1, length(fqdn) - length(tld) - 1) AS root FROM r)
    SELECT page_id, fqdn, tld, split_part(root, '.', -1) || '.' || tld AS domain, CASE WHEN contains(root, '.') THEN substr(root, 1, length(root) - length(split_part(root, '.', -1)) - 1) ELSE '' END AS host
    FROM s WHERE tld IS NOT NULL""",
)
def p11(spark, sf_dir):
    parts = pages(spark, sf_dir).select("page_id", E.hostname_parts(F.concat(F.upper("fqdn"), F.lit("..")), CONFIG).alias("p"))
    return parts.filter("p IS NOT NULL").select("page_id", "p.fqdn", "p.tld", "p.domain", "p.host")


@query(
    "P10_names_in_pages",
    r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '(?m)(?:^|[\s(/<>|@''"=:])([a-zA-Z0-9-]+(?:\.[a-zA-Z0-9_-]{2,})+)[?\s#&/<>''",)]', 1)) AS n FROM pages)
       SELECT DISTINCT page_id, lower(n) AS fqdn FROM t WHERE regexp_matches(lower(n), '\.(com|net|org)$')""",
)
def p10_pages(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(E.hostname_candidates(F.array("html"))).alias("n"))
    return found.select("page_id", E.hostname_parts(F.col("n"), CONFIG).alias("p")).filter("p IS NOT NULL").select("page_id", "p.fqdn").distinct()


@query("P13_value_fuse", f"WITH {PAGES_SQL} SELECT page_id, CASE WHEN page_id % 2 = 0 THEN fqdn || '|x' ELSE 'x' END AS vals FROM pg")
def p13(spark, sf_dir):
    first = F.when(F.col("page_id") % 2 == 0, F.array("fqdn", F.lit(None), "fqdn"))
    out = E.fuse(first, F.array(F.lit("x")), F.array(F.lit("x"), F.when(F.col("page_id") % 2 == 0, F.col("fqdn"))))
    return pages(spark, sf_dir).select("page_id", F.array_join(out, "|").alias("vals"))


@query("P14_scalars", with_scans("SELECT ip, k AS port, s1 AS first_seen, s1 AS last_seen, n AS ip_num, CAST(4 AS INT) AS ip_version FROM sd"))
def p14(spark, sf_dir):
    docs = E.extract_with(port_documents(spark, sf_dir), CONFIG, ("port",))
    return docs.select("ip", F.array_join("port", "|").alias("port"), "first_seen", "last_seen", "ip_num", "ip_version")


@query(
    "P15_extract",
    with_scans(
        f""", v AS (SELECT ip, k AS portid, 'fqdn' AS field, unnest({_NAMES}) AS value FROM sd
        UNION ALL SELECT ip, k, 'http_server', event_type || '/' || (kn % 10) FROM sd UNION ALL SELECT ip, k, 'tag', 'soft:' || event_type FROM sd WHERE event_type <> 'view')
        SELECT field, value, count(*) AS docs FROM v GROUP BY ALL"""
    ),
)
def p15(spark, sf_dir):
    """Whole extraction with rules; values of three fields are counted."""
    suffixes = local_table(spark, [(s,) for s in CONFIG.suffixes], "suffix string")
    headers = local_table(spark, list(CONFIG.headers.items()), "header_name string, collect_value boolean")
    kinds = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct().filter("name <> 'view'")
    rules = (
        kinds.selectExpr("name", "0 AS ord", "true AS active", "name AS description", "'http_server.bg:' || name || '/' AS query", "array('tag:soft:' || name) AS tags", "'' AS version"),
        kinds.selectExpr("name AS rule", "0 AS grp", "0 AS term", "'http_server' AS field", "'begin' AS op", "name || '/' AS value"),
    )
    # observations of one document are kept apart: ids are made unique per scan end
    raw = port_documents(spark, sf_dir).withColumn("id", F.concat("id", F.lit("-"), F.monotonically_increasing_id().cast("string")))
    docs = E.extract(raw, suffixes, headers, rules)
    return build_postings(docs, ("fqdn", "http_server", "tag")).groupBy("field", "value").agg(F.count("value").alias("docs"))


@query(
    "P16_ptr_and_resolved",
    with_scans("SELECT ip, k AS portid, 'ptr' || u || '.example.net' AS ptr, 'U' || (blk % 50) || '.Example.COM.|u' || (blk % 50) || '.example.nowhere' AS resolved FROM sd"),
)
def p16(spark, sf_dir):
    names = F.col("body.hostnames")
    return port_documents(spark, sf_dir).select(
        "ip", _port()["portid"].alias("portid"), F.array_join(ptr_names(names), "|").alias("ptr"), F.array_join(resolved_names(names), "|").alias("resolved")
    )


@query("P17_field_backfill", with_scans("SELECT ip, k AS port, 'u' || (blk % 50) || '.example.com.|u' || (blk % 50) || '.example.nowhere' AS fqdn_requested FROM sd"))
def p17(spark, sf_dir):
    raw = port_documents(spark, sf_dir)
    raw = raw.withColumn("id", F.concat_ws("-", "id", "body.starttime", "body.endtime"))
    stored = E.extract_with(raw, CONFIG, ("fqdn_requested", "port"))
    stale = stored.withColumn("fqdn_requested", F.array(F.lit("stale"))).dropDuplicates(["uid"])
    out = E.backfill_field(stale, raw.dropDuplicates(["id"]), "fqdn_requested", CONFIG)
    return out.select("ip", F.array_join("port", "|").alias("port"), F.array_join("fqdn_requested", "|").alias("fqdn_requested"))


_BUSY = ", m AS (SELECT ip FROM sd GROUP BY ip ORDER BY count(*) DESC, ip LIMIT 1), mine AS (SELECT * FROM sd WHERE ip = (SELECT ip FROM m))"


def _timeline(spark, sf_dir):
    raw = port_documents(spark, sf_dir)
    raw = raw.withColumn("id", F.concat_ws("-", "id", "body.starttime", "body.endtime"))
    busy = raw.groupBy("ip").count().orderBy(F.desc("count"), "ip").first()["ip"]
    docs = raw.select(F.col("id").alias("uid"), "ip", "first_seen", "last_seen", F.array(F.lit("b:x"), F.lit("a:y")).alias("tag"))
    bodies = raw.filter(_port()["service"]["name"] != "error")
    return ip_timeline(docs, bodies, busy)


@query(
    "Q27_address_timeline",
    with_scans(
        f"""{_BUSY} SELECT CASE WHEN event_type <> 'error' THEN 'tcp' END AS protocol, CASE WHEN event_type <> 'error' THEN k END AS portid, CASE WHEN event_type <> 'error' THEN event_type END AS service,
        s1 AS timestamp_sort, strftime(make_timestamp(s1 * 1000000), '%d/%m/%y') AS last_seen, 'a:y|b:x' AS tags, CASE WHEN event_type <> 'error' THEN 'ptr' || u || '.example.net' ELSE '' END AS ptr,
        CASE WHEN event_type = 'error' THEN 'document_not_found' END AS warning FROM mine"""
    ),
)
def q27(spark, sf_dir):
    return _timeline(spark, sf_dir).select(
        "protocol", "portid", "service", "timestamp_sort", "last_seen", F.array_join("tags", "|").alias("tags"),
        F.coalesce(F.array_join("ptr_records", "|"), F.lit("")).alias("ptr"), "warning",
    )


@query(
    "Q27_ports_of_address",
    with_scans(
        f"{_BUSY} SELECT 'tcp' AS protocol, k AS portid, count(*) AS observation_count, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS services FROM mine WHERE event_type <> 'error' GROUP BY k"
    ),
)
def q27_ports(spark, sf_dir):
    return ip_ports(_timeline(spark, sf_dir)).select("protocol", "portid", "observation_count", F.array_join("service_names", "|").alias("services"))

