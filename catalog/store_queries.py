"""Store queries (I1-I11, I14) and exports over documents derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, table
from catalog.bindings import documents, observations, with_docs, with_postings
from vantage.operators import store as ST
from vantage.operators.search import object_counts
from vantage.operators.shape import doc_id
from vantage.plans.ingest import append_documents, compact, current_documents
from vantage.session import shared_dir
from vantage.sources import sinks

HALF = 1705276800  # 2024-01-15


def _postings(spark, sf_dir):
    return ST.build_postings(documents(spark, sf_dir))


@query("I1_postings", with_postings("SELECT field, value, uid FROM postings WHERE value <> ''"))
def i1(spark, sf_dir):
    return _postings(spark, sf_dir)


# Store and batch: documents keyed by (address, port, type), before and after a date.
_KEYED_SQL = """, keyed AS (SELECT ip || ':' || k || ':' || event_type AS uid, d.ip, o.k, o.event_type, d.first_seen, d.last_seen,
      d.http_title, d.tag FROM docs d JOIN obs o ON o.uid = d.uid),
  latest AS (SELECT uid, arg_max(array_to_string(http_title, '|') || '#' || array_to_string(tag, '|'), (last_seen, first_seen, http_title, tag)) AS v,
      min(first_seen) AS f, max(last_seen) AS l, side FROM
      (SELECT *, first_seen >= 1705276800 AS side FROM keyed) GROUP BY uid, side)"""


def _keyed(spark, sf_dir):
    docs = documents(spark, sf_dir)
    kind = F.regexp_replace(F.element_at("tag", 1), "^soft:", "")
    return docs.withColumn("uid", F.concat_ws(":", "ip", F.element_at("port", 1), kind)).select(
        "uid", "ip", "first_seen", "last_seen", "http_title", "tag"
    )


def _sides(spark, sf_dir):
    keyed = _keyed(spark, sf_dir)
    old = ST.latest_per_uid(keyed.filter(F.col("first_seen") < HALF))
    new = ST.latest_per_uid(keyed.filter(F.col("first_seen") >= HALF))
    return old, new


@query(
    "I2_document_upsert",
    with_docs(
        f"""{_KEYED_SQL}
        SELECT coalesce(n.uid, o.uid) AS uid, least(o.f, n.f) AS first_seen, greatest(o.l, n.l) AS last_seen,
               CASE WHEN n.uid IS NOT NULL THEN n.v ELSE o.v END AS vals
        FROM (SELECT * FROM latest WHERE NOT side) o FULL JOIN (SELECT * FROM latest WHERE side) n ON n.uid = o.uid"""
    ),
)
def i2(spark, sf_dir):
    merged = ST.upsert_docs(*_sides(spark, sf_dir))
    values = F.concat(F.array_join("http_title", "|"), F.lit("#"), F.array_join("tag", "|"))
    return merged.select("uid", "first_seen", "last_seen", values.alias("vals"))


@query(
    "I2_repeated_uids",
    with_docs(
        f"""{_KEYED_SQL}
        SELECT coalesce(n.uid, o.uid) AS uid, least(o.f, n.f) AS first_seen, greatest(o.l, n.l) AS last_seen,
               CASE WHEN n.uid IS NOT NULL THEN n.v ELSE o.v END AS vals
        FROM (SELECT * FROM latest WHERE NOT side) o FULL JOIN (SELECT * FROM latest WHERE side) n ON n.uid = o.uid"""
    ),
)
def i2_repeated(spark, sf_dir):
    """Both sides as they come, with every observation of a uid."""
    keyed = _keyed(spark, sf_dir)
    merged = ST.upsert_docs(keyed.filter(F.col("first_seen") < HALF), keyed.filter(F.col("first_seen") >= HALF))
    values = F.concat(F.array_join("http_title", "|"), F.lit("#"), F.array_join("tag", "|"))
    return merged.select("uid", "first_seen", "last_seen", values.alias("vals"))


@query("I1_cleared_field", with_postings("SELECT field, value, uid FROM postings WHERE value <> '' AND field <> 'tag'"))
def i1_cleared(spark, sf_dir):
    """Postings written over older ones that still had tags."""
    path = shared_dir(spark, "postings")
    ST.write_postings(_postings(spark, sf_dir), path)
    ST.write_postings(ST.build_postings(ST.clear_tags(documents(spark, sf_dir))), path)
    return spark.read.parquet(path).select(F.col("field").cast("string").alias("field"), F.col("value").cast("string").alias("value"), "uid")


_REINDEXED_SQL = """, again AS (SELECT uid, ip_num, event_id % 3 = 0 AS late, first_seen, last_seen, http_title[1] AS title, array_to_string(tag, '|') AS tag
      FROM docs JOIN (SELECT uid AS u, event_id FROM obs) ON u = uid)
    SELECT uid, first_seen - CASE WHEN late THEN 90000 ELSE 0 END AS first_seen, last_seen,
      CASE WHEN late THEN 're ' ELSE '' END || title AS title, CASE WHEN late THEN '' ELSE tag END AS tag FROM again"""


def _reindexed(spark, sf_dir, compacted):
    """All documents, then a third of them again: older times, another title, no tags; the newer batch counts."""
    docs = documents(spark, sf_dir)
    late = docs.filter(F.col("uid").cast("long") % 3 == 0)
    back = late.withColumns({
        "first_seen": F.col("first_seen") - 90000, "last_seen": F.col("last_seen") - 90000,
        "http_title": F.transform("http_title", lambda t: F.concat(F.lit("re "), t)), "tag": F.expr("CAST(array() AS ARRAY<STRING>)"),
    })
    store = shared_dir(spark, "store")
    append_documents(docs, store, 0)
    if compacted:
        compact(spark, store, files=16)
    append_documents(back, store, 0 if compacted else 1)
    return store


def _shown(docs):
    return docs.select("uid", "first_seen", "last_seen", F.element_at("http_title", 1).alias("title"), F.array_join("tag", "|").alias("tag"))


@query("M1_reindex_older_time", with_docs(_REINDEXED_SQL))
def m1_reindex(spark, sf_dir):
    return _shown(current_documents(spark, _reindexed(spark, sf_dir, False)))


@query("M1_base_and_batches", with_docs(_REINDEXED_SQL))
def m1_base(spark, sf_dir):
    """The same through a compacted base with a later batch over it."""
    return _shown(current_documents(spark, _reindexed(spark, sf_dir, True)))


@query("M1_address_search", with_docs(f"{_REINDEXED_SQL} WHERE ip_num BETWEEN 134742016 + 2560 AND 134742016 + 4095"))
def m1_addresses(spark, sf_dir):
    """Documents of 8.8.10.0 to 8.8.15.255, from the base files that reach into that range and the later batch."""
    return _shown(current_documents(spark, _reindexed(spark, sf_dir, True), ("08080a00", "08080fff")))


@query(
    "I3_seen_merge",
    with_docs(f"{_KEYED_SQL} SELECT uid, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM keyed GROUP BY uid"),
)
def i3(spark, sf_dir):
    keyed = _keyed(spark, sf_dir)
    # the second half arrives with its bounds swapped
    late = keyed.filter(F.col("first_seen") >= HALF).select(
        "uid", F.col("last_seen").alias("first_seen"), F.col("first_seen").alias("last_seen")
    )
    return ST.merge_seen(keyed.filter(F.col("first_seen") < HALF), late)


def _updates(docs):
    return docs.filter(F.array_contains("tag", "hard:big")).select(
        "uid", F.array(F.concat(F.lit(" Soft:"), "uid"), F.lit("soft:x"), F.lit("SOFT:X "), F.lit("")).alias("tag")
    )


@query(
    "I4_replace_field",
    with_docs(
        """SELECT uid, CASE WHEN list_contains(tag, 'hard:big') THEN 'soft:' || uid || '|soft:x' ELSE array_to_string(tag, '|') END AS tag,
                  array_to_string(http_server, '|') AS http_server FROM docs"""
    ),
)
def i4(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = ST.replace_field(docs, "tag", _updates(docs))
    return out.select("uid", F.array_join("tag", "|").alias("tag"), F.array_join("http_server", "|").alias("http_server"))


@query(
    "I4_replace_postings",
    with_postings(
        """, big AS (SELECT uid FROM docs WHERE list_contains(tag, 'hard:big'))
        SELECT field, value, uid FROM postings WHERE field <> 'tag' OR uid NOT IN (SELECT uid FROM big)
        UNION ALL SELECT 'tag', 'soft:' || uid, uid FROM big UNION ALL SELECT 'tag', 'soft:x', uid FROM big"""
    ),
)
def i4_postings(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return ST.replace_postings(ST.build_postings(docs), "tag", _updates(docs))


@query("I5_object_counts", with_docs("SELECT count(DISTINCT ip) AS ip_count, count(DISTINCT uid) AS uid_count FROM docs"))
def i5(spark, sf_dir):
    return object_counts(documents(spark, sf_dir))


@query(
    "I6_values_by_prefix",
    with_postings("SELECT DISTINCT value FROM postings WHERE field = 'fqdn' AND starts_with(value, 'h1') ORDER BY value LIMIT 40"),
)
def i6(spark, sf_dir):
    return ST.field_values(_postings(spark, sf_dir), "fqdn", "H1", 40)


@query("I7_value_counts", with_postings("SELECT count(DISTINCT uid) AS count, value FROM postings WHERE field = 'http_server' GROUP BY value"))
def i7(spark, sf_dir):
    return ST.dump_field(_postings(spark, sf_dir), "http_server")


@query(
    "I7_header_value_counts",
    with_postings(
        "SELECT count(DISTINCT uid) AS count, substr(value, 14) AS value FROM postings WHERE field = 'http_headval' "
        "AND starts_with(value, 'x-powered-by:') GROUP BY ALL"
    ),
)
def i7_header(spark, sf_dir):
    return ST.dump_field(_postings(spark, sf_dir), "http_headval:X-Powered-By")


@query(
    "I8_rebuild_with_history",
    with_docs(
        """, snap AS (SELECT uid, first_seen - 5000 AS f, last_seen - 7000 AS l, 'old:' || uid AS t FROM docs WHERE list_contains(tag, 'soft:view'))
        SELECT d.uid, least(d.first_seen, d.last_seen, s.f) AS first_seen, greatest(d.first_seen, d.last_seen, s.l) AS last_seen,
               CASE WHEN s.uid IS NOT NULL THEN s.t ELSE array_to_string(d.tag, '|') END AS tag
        FROM docs d LEFT JOIN snap s ON s.uid = d.uid"""
    ),
)
def i8(spark, sf_dir):
    docs = documents(spark, sf_dir)
    snapshot = docs.filter(F.array_contains("tag", "soft:view")).select(
        "uid", (F.col("first_seen") - 5000).alias("first_seen"), (F.col("last_seen") - 7000).alias("last_seen"),
        F.array(F.concat(F.lit("old:"), "uid")).alias("tag"),
    )
    out = ST.rebuild(docs, snapshot, retag=False)
    return out.select("uid", "first_seen", "last_seen", F.array_join("tag", "|").alias("tag"))


@query(
    "I9_drop_tag",
    with_docs("SELECT uid, array_to_string(list_filter(tag, lambda x: x <> 'soft:view'), '|') AS tag FROM docs"),
)
def i9(spark, sf_dir):
    return ST.drop_tag(documents(spark, sf_dir), "tag:Soft:view").select("uid", F.array_join("tag", "|").alias("tag"))


@query(
    "I9_drop_tag_counts",
    """SELECT count(*) FILTER (lang = 'fr') AS affected, count(*) FILTER (lang = 'fr' AND source IN ('src0', 'src1')) AS emptied FROM documents""",
)
def i9_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.array_compact(
            F.array(
                F.concat(F.lit("lang:"), "lang"),
                F.when(~F.col("source").isin("src0", "src1"), F.concat(F.lit("src:"), "source")),
            )
        ).alias("tag")
    )
    return ST.drop_tag_counts(docs, "lang:fr")


@query("I10_clear_tags", with_docs("SELECT uid, CAST(0 AS INT) AS tags, array_to_string(port, '|') AS port FROM docs"))
def i10(spark, sf_dir):
    out = ST.clear_tags(documents(spark, sf_dir))
    return out.select("uid", F.size("tag").alias("tags"), F.array_join("port", "|").alias("port"))


@query("I11_list_tags", with_docs("SELECT DISTINCT unnest(tag) AS tag FROM docs"))
def i11(spark, sf_dir):
    return ST.list_tags(documents(spark, sf_dir))


@query(
    "I14_latest_record",
    """SELECT c_custkey AS uid, coalesce(max(o_orderdate), TIMESTAMP '1990-01-01') AS last_seen,
              coalesce(arg_max('10.' || (o_orderkey % 250), (o_orderdate, o_orderkey)), 'none') AS ip
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
)
def i14(spark, sf_dir):
    """Agents = customers, beacons = orders; ties are broken by order key."""
    base = F.lit("1990-01-01 00:00:00").cast("timestamp_ntz")
    agents = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("uid"), F.struct(base.alias("at"), F.lit(-1).cast("bigint").alias("n")).alias("stamp"), F.lit("none").alias("ip")
    )
    beacons = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("uid"), F.struct(F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("n")).alias("stamp"),
        F.concat(F.lit("10."), (F.col("o_orderkey") % 250).cast("string")).alias("ip"),
    )
    out = ST.upsert_latest(agents, beacons, "uid", "stamp")
    return out.select("uid", F.col("stamp.at").alias("last_seen"), "ip")


_UUID_SQL = """substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' ||
   substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h,17,1)), 1) || substr(h,18,3) || '-' || substr(h,21,12)"""


@query(
    "T5_document_id",
    with_docs(
        f""", h AS (SELECT d.uid, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(d.ip || ':' || o.k || ':' || o.event_type)) AS h,
             o.event_type = 'view' AS blank FROM docs d JOIN obs o ON o.uid = d.uid)
        SELECT uid, CASE WHEN NOT blank THEN {_UUID_SQL} END AS id FROM h"""
    ),
)
def t5(spark, sf_dir):
    from vantage.functions.netaddr import ipv4_text

    obs = observations(spark, sf_dir)
    content = F.when(F.col("event_type") == "view", F.lit(" ")).otherwise(F.col("event_type"))
    return obs.select("uid", doc_id(ipv4_text("ip_num"), "k", content).alias("id"))


@query(
    "S4_first_seen_export",
    with_docs("SELECT uid, ip, CAST(first_seen AS VARCHAR) AS first_seen, CAST(last_seen AS VARCHAR) AS last_seen FROM docs WHERE NOT list_contains(tag, 'hard:big')"),
)
def s4(spark, sf_dir):
    """Written as csv and read back."""
    from vantage.session import shared_dir

    docs = documents(spark, sf_dir)
    docs = docs.withColumn("first_seen", F.when(~F.array_contains("tag", "hard:big"), F.col("first_seen")))
    path = shared_dir(spark, "first-seen")
    sinks.export_first_seen(docs, path)
    return spark.read.csv(path, header=True, schema="uid string, ip string, first_seen string, last_seen string")


_IMPORT_SQL = with_docs(
    """, csv AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'zz' || uid WHEN event_type = 'click' THEN ' ' ELSE uid END AS uid,
              CASE WHEN kn = 7 THEN 'bad' ELSE CAST(seen - 86400 AS VARCHAR) END AS first_seen FROM obs WHERE event_type <> 'signup'),
       st AS (SELECT c.uid, c.first_seen, CASE WHEN trim(c.uid) = '' OR c.first_seen = 'bad' THEN 'invalid'
              WHEN d.uid IS NULL THEN 'missing' ELSE 'updated' END AS status FROM csv c LEFT JOIN docs d ON d.uid = c.uid)"""
)


def _first_seen_rows(spark, sf_dir):
    uid = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("zz"), "uid")).when(
        F.col("event_type") == "click", F.lit(" ")
    ).otherwise(F.col("uid"))
    first = F.when(F.col("kn") == 7, F.lit("bad")).otherwise((F.col("seen") - 86400).cast("string"))
    return observations(spark, sf_dir).select(
        uid.alias("uid"), first.alias("first_seen"), (F.col("event_type") != "signup").alias("has")
    ).filter("has").drop("has")


@query(
    "S5_first_seen_import",
    f"{_IMPORT_SQL} SELECT d.uid, coalesce(CAST(s.first_seen AS BIGINT), d.first_seen) AS first_seen, d.last_seen "
    "FROM docs d LEFT JOIN (SELECT * FROM st WHERE status = 'updated') s ON s.uid = d.uid",
)
def s5(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out, _ = sinks.import_first_seen(docs, _first_seen_rows(spark, sf_dir))
    return out.select("uid", "first_seen", "last_seen")


@query("S5_first_seen_import_counts", f"{_IMPORT_SQL} SELECT status, count(*) AS count FROM st GROUP BY status")
def s5_counts(spark, sf_dir):
    return sinks.import_first_seen(documents(spark, sf_dir), _first_seen_rows(spark, sf_dir))[1]


@query(
    "S12_full_export",
    with_docs(
        """, hits AS (SELECT * FROM docs WHERE list_contains(tag, 'soft:purchase')),
             bodies AS (SELECT uid, '{"title":"' || http_title[1] || '"}' AS body FROM docs WHERE NOT list_contains(tag, 'hard:big'))
        SELECT h.ip, h.uid, h.first_seen, h.last_seen, b.body, CASE WHEN b.uid IS NULL THEN 'document_not_found' END AS warning
        FROM hits h LEFT JOIN bodies b ON b.uid = h.uid"""
    ),
)
def s12(spark, sf_dir):
    """Written as JSON lines and read back."""
    from vantage.session import shared_dir

    docs = documents(spark, sf_dir)
    bodies = docs.filter(~F.array_contains("tag", "hard:big")).select(
        F.col("uid").alias("id"), F.struct(F.element_at("http_title", 1).alias("title")).alias("body")
    )
    path = shared_dir(spark, "export")
    sinks.export_full(docs.filter(F.array_contains("tag", "soft:purchase")), bodies, path)
    back = spark.read.schema(
        "ip string, uid string, first_seen bigint, last_seen bigint, document struct<title:string>, warning string"
    ).json(path)
    return back.select("ip", "uid", "first_seen", "last_seen", F.to_json("document").alias("body"), "warning")


@query("S13_address_list", with_docs("SELECT DISTINCT ip FROM docs WHERE list_contains(tag, 'hard:big')"))
def s13(spark, sf_dir):
    from vantage.session import shared_dir

    path = shared_dir(spark, "ips")
    sinks.export_ips(documents(spark, sf_dir).filter(F.array_contains("tag", "hard:big")), path)
    return spark.read.text(path).select(F.col("value").alias("ip"))


