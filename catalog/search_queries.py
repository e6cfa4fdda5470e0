"""Search queries (Q1-Q29) over documents derived from events and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, spread, table
from catalog.bindings import NOW, NOW_S, documents, observations, with_docs
from vantage.operators import search as S

T0, T1 = 1704844800, 1705536000  # 2024-01-10 .. 2024-01-18
ALL = (0, 4_102_444_800)


def _hits(cond_spark, cond_sql):
    """One filter query: matching uid and ip."""

    def run(spark, sf_dir):
        return documents(spark, sf_dir).filter(cond_spark()).select("uid", "ip")

    return run, with_docs(f"SELECT uid, ip FROM docs WHERE {cond_sql}")


def _register(name, cond_spark, cond_sql):
    run, sql = _hits(cond_spark, cond_sql)
    query(name, sql)(run)


_register("Q1_exact_term", lambda: S.term("http_server", "Click/3"), "list_contains(http_server, 'click/3')")
_register(
    "Q2_prefix_term", lambda: S.term("http_server", "pur", "begin"),
    "len(list_filter(http_server, lambda x: starts_with(x, 'pur'))) > 0",
)
_register(
    "Q3_substring_term", lambda: S.term("fqdn", "shop7", "like"),
    "len(list_filter(fqdn, lambda x: contains(x, 'shop7'))) > 0",
)
_register("Q4_negated_term", lambda: S.term("http_cookiename", "session", "not"), "NOT list_contains(http_cookiename, 'session')")
_register("Q5_address_term", lambda: S.term("ip", "8.8.5.3"), "ip = '8.8.5.3'")
_register(
    "Q6_network_term", lambda: S.term("net", "8.8.4.77/22"),
    "ip_num BETWEEN 134742016 + 1024 AND 134742016 + 2047",
)
_register(
    "Q7_header_value", lambda: S.header_value("X-Powered-By", "php/3", "begin") | S.header_value("content-type", "ick", "like"),
    "len(list_filter(http_headval, lambda x: starts_with(x, 'x-powered-by:php/3') OR (starts_with(x, 'content-type:') "
    "AND contains(substr(x, 14), 'ick')))) > 0",
)
_register(
    "Q8_all_of", lambda: S.all_of([("http_server", "begin", "view"), ("http_cookiename", "exact", "session"), ("http_cookiename", "exact", "c3")]),
    "len(list_filter(http_server, lambda x: starts_with(x, 'view'))) > 0 AND list_contains(http_cookiename, 'session') "
    "AND list_contains(http_cookiename, 'c3')",
)
_register(
    "Q9_any_of", lambda: S.any_of(S.search_terms("http_server.bg:error port:69 OR tag:hard:big AND http_title.lk:'portal 7'")),
    "(len(list_filter(http_server, lambda x: starts_with(x, 'error'))) > 0 AND list_contains(port, '69')) OR "
    "(list_contains(tag, 'hard:big') AND len(list_filter(http_title, lambda x: contains(x, 'portal 7'))) > 0)",
)
_register(
    "Q10_places_then_and",
    lambda: S.all_of([("ip", "exact", "8.8.5.3"), ("net", "exact", "8.8.8.0/23"), ("net", "exact", "nonsense"), ("tag", "exact", "soft:view")]),
    "(ip = '8.8.5.3' OR ip_num BETWEEN 134742016 + 2048 AND 134742016 + 2559) AND list_contains(tag, 'soft:view')",
)
_register("Q11_overlap", lambda: S.overlaps(T1, T0), f"last_seen >= {T0} AND first_seen <= {T1}")
_register("Q12_last_seen_window", lambda: S.seen_in(T0, T1), f"last_seen BETWEEN {T0} AND {T1}")


def _ranges():
    since = S.resolve_range(None, None, NOW, 20)
    default = S.resolve_range(None, None, NOW)
    return since, default


@query(
    "Q13_relative_range",
    with_docs(
        """SELECT uid, CAST(last_seen >= 1704931200 AND first_seen <= 1706745599 AS BOOLEAN) AS in_since
           FROM docs WHERE last_seen >= 1698710400 AND first_seen <= 1706659200"""
    ),
)
def q13(spark, sf_dir):
    since, default = _ranges()
    return documents(spark, sf_dir).filter(S.overlaps(*default)).select("uid", S.overlaps(*since).alias("in_since"))


@query(
    "Q13_since_word",
    with_docs("""SELECT ip, count(*) AS uid_count, min(first_seen) AS min_seen, max(last_seen) AS max_seen FROM docs
        WHERE last_seen >= 1704931200 AND first_seen <= 1706745599 AND list_contains(tag, 'soft:view') GROUP BY ip"""),
)
def q13_since(spark, sf_dir):
    return S.search_text(documents(spark, sf_dir), "since:20 tag:soft:view", NOW)


GROUPS = "http_server.bg:click net:8.8.0.0/20 OR tag:soft:view port:69"
GROUPS_SQL = (
    "((ip_num BETWEEN 134742016 AND 134742016 + 4095 AND len(list_filter(http_server, lambda x: starts_with(x, 'click'))) > 0) "
    "OR (list_contains(tag, 'soft:view') AND list_contains(port, '69')))"
)
HITS_SQL = f"hits AS (SELECT * FROM docs WHERE last_seen >= {T0} AND first_seen <= {T1} AND {GROUPS_SQL})"


def _found(spark, sf_dir):
    return S.hits(documents(spark, sf_dir), S.search_terms(GROUPS), T0, T1)


@query("Q14_by_address", with_docs(f", {HITS_SQL} SELECT ip, uid FROM hits"))
def q14(spark, sf_dir):
    return S.uid_lists(_found(spark, sf_dir)).select("ip", F.explode("uids").alias("uid"))


@query(
    "Q15_address_seen_range",
    with_docs(
        f", {HITS_SQL} SELECT ip, count(*) AS uid_count, min(first_seen) AS min_seen, max(last_seen) AS max_seen FROM hits GROUP BY ip"
    ),
)
def q15(spark, sf_dir):
    return S.by_ip(_found(spark, sf_dir))


@query(
    "Q16_requested_names",
    with_docs(
        f", {HITS_SQL} SELECT uid, array_to_string(list_sort(list_distinct(fqdn_requested)), '|') AS requested FROM hits"
    ),
)
def q16(spark, sf_dir):
    return S.requested_names(_found(spark, sf_dir)).select("uid", F.array_join("requested", "|").alias("requested"))


@query(
    "Q17_result_order",
    with_docs(
        """, g AS (SELECT ip, max(CASE WHEN kn0 THEN 0 ELSE last_seen END) AS max_seen FROM
             (SELECT ip, last_seen, list_contains(tag, 'soft:error') AS kn0 FROM docs) GROUP BY ip),
           s AS (SELECT ip, max_seen, coalesce(nullif(max_seen, 0), -1) AS k FROM g)
           SELECT ip, max_seen, row_number() OVER (ORDER BY k DESC, ip) AS place FROM s"""
    ),
)
def q17(spark, sf_dir):
    """The sort is checked through the place of every row."""
    from vantage.operators.scale import running

    docs = documents(spark, sf_dir)
    last = F.when(F.array_contains("tag", "soft:error"), 0).otherwise(F.col("last_seen"))
    grouped = S.by_ip(docs.withColumn("last_seen", last.cast("bigint"))).select("ip", "max_seen")
    newest = F.coalesce(F.nullif("max_seen", F.lit(0).cast("bigint")), F.lit(-1).cast("bigint"))
    placed = running(grouped, [-newest, F.col("ip")], {"before": ("sum", F.lit(1).cast("bigint"))})
    return placed.select("ip", "max_seen", (F.col("before") + 1).alias("place"))


@query(
    "Q18_full_search",
    with_docs(
        f""", {HITS_SQL}, g AS (SELECT ip, count(*) AS uid_count, min(first_seen) AS min_seen, max(last_seen) AS max_seen
              FROM hits GROUP BY ip),
            t AS (SELECT count(DISTINCT ip) AS total_ips, count(DISTINCT uid) AS total_uids FROM docs)
            SELECT g.*, t.total_ips, t.total_uids, (SELECT count(*) FROM g) AS returned FROM g, t"""
    ),
)
def q18(spark, sf_dir):
    docs = documents(spark, sf_dir)
    grouped = S.by_ip(S.hits(docs, S.search_terms(GROUPS), T0, T1))
    totals = S.object_counts(docs)
    return S.ordered(
        grouped.select(
            "*",
            totals.select("ip_count").scalar().alias("total_ips"),
            totals.select("uid_count").scalar().alias("total_uids"),
            grouped.agg(F.count("ip")).scalar().alias("returned"),
        )
    )


_PAGE_SQL = f""", w AS (SELECT ip, count(*) AS uid_count, min(first_seen) AS min_seen, max(last_seen) AS max_seen FROM docs
  WHERE last_seen BETWEEN {T1} - 2*86400 + 1 AND {T1} AND list_contains(tag, 'soft:view')
    AND ip NOT IN (SELECT ip FROM docs WHERE list_contains(tag, 'hard:big')) GROUP BY ip),
  p AS (SELECT * FROM w ORDER BY max_seen DESC, ip LIMIT 21)"""


def _page(spark, sf_dir):
    docs = documents(spark, sf_dir)
    seen = docs.filter(S.term("tag", "hard:big")).select("ip").distinct()
    return S.search_page(docs, S.search_terms("tag:soft:view"), (T0, T1), None, seen, 20, 2)


@query("Q19_page_rows", with_docs(f"{_PAGE_SQL} SELECT * FROM p ORDER BY max_seen DESC, ip LIMIT 20"))
def q19(spark, sf_dir):
    return _page(spark, sf_dir).rows


@query(
    "Q19_page_cursor",
    with_docs(
        f"""{_PAGE_SQL} SELECT least(count(*), 20) AS returned, count(*) > 20 AS stopped_in_window,
            CAST(CASE WHEN count(*) > 20 THEN {T1} ELSE {T1} - 2*86400 END AS BIGINT) AS next_cursor, true AS has_more,
            CAST(2 AS BIGINT) AS scanned_days, CAST(2 AS BIGINT) AS window_days FROM p"""
    ),
)
def q19_cursor(spark, sf_dir):
    return _page(spark, sf_dir).info


_END = NOW_S + 40 * 86400
# windows of 1, 2, 4 ... days hold the days 2^w - 1 to 2^(w+1) - 2 back from the end
_GROWN_SQL = f""", h AS (SELECT ip, first_seen, last_seen, CAST(floor(log2(({_END} - last_seen) // 86400 + 1)) AS INT) AS w FROM docs
  WHERE list_contains(tag, 'hard:big') AND last_seen BETWEEN 0 AND {_END}),
 f AS (SELECT ip, count(*) AS uid_count, min(first_seen) AS min_seen, max(last_seen) AS max_seen FROM h WHERE w = (SELECT min(w) FROM h) GROUP BY ip)"""


@query("Q20_window_growth", with_docs(f"{_GROWN_SQL} SELECT * FROM f ORDER BY max_seen DESC, ip LIMIT 50"))
def q20(spark, sf_dir):
    """First page with hits, found by doubling the window back from the end."""
    docs = documents(spark, sf_dir)
    pages = S.search_pages(docs, S.search_terms("tag:hard:big"), (0, _END), 50)
    return next(pages).rows


@query(
    "Q20_second_page",
    with_docs(f"""{_GROWN_SQL}, p AS (SELECT * FROM f ORDER BY max_seen DESC, ip LIMIT 10)
     SELECT * FROM f WHERE ip NOT IN (SELECT ip FROM p) AND (SELECT count(*) FROM f) > 10 ORDER BY max_seen DESC, ip LIMIT 10"""),
)
def q20_second(spark, sf_dir):
    """Page after a full one: a range of the summary from the last place shown, in the same window."""
    summary = S.summarize(documents(spark, sf_dir), S.search_terms("tag:hard:big"), (0, _END))
    cursor, days = S.Cursor(_END), 1
    while cursor is not None and not cursor.shown:
        at, width = cursor, days
        _, cursor = S.next_page(summary, cursor, 10, width)
        days *= 2
    same = S.Cursor(at.at, cursor.after, cursor.shown) if cursor else at
    return S.next_page(summary, same, 10, width)[0].rows


@query(
    "Q21_scoped_search",
    with_docs(
        """SELECT uid, ip FROM docs WHERE list_contains(tag, 'soft:view') AND uid IN
           (SELECT uid FROM docs WHERE last_seen BETWEEN 1704844800 AND 1705536000)"""
    ),
)
def q21(spark, sf_dir):
    docs = documents(spark, sf_dir)
    scope = docs.filter(S.seen_in(T0, T1)).select("uid")
    return S.scoped(docs, scope).filter(S.any_of(S.search_terms("tag:soft:view"))).select("uid", "ip")


@query(
    "Q22_address_info",
    with_docs(
        """, m AS (SELECT ip FROM docs GROUP BY ip ORDER BY count(*) DESC, ip LIMIT 1)
           SELECT ip, uid, first_seen, last_seen, min(first_seen) OVER () AS min_seen, max(last_seen) OVER () AS max_seen
           FROM docs WHERE ip = (SELECT ip FROM m)"""
    ),
)
def q22(spark, sf_dir):
    docs = documents(spark, sf_dir)
    busiest = docs.groupBy("ip").count().orderBy(F.desc("count"), "ip").first()["ip"]
    return S.ip_info(docs, busiest)


@query(
    "Q23_documents_by_uid",
    with_docs(
        """, wanted AS (SELECT uid FROM docs WHERE list_contains(tag, 'soft:error')
                        UNION ALL SELECT 'x' || uid FROM docs WHERE list_contains(tag, 'hard:big'))
           SELECT w.uid, d.ip, d.first_seen, d.last_seen, CASE WHEN d.uid IS NULL THEN 'document_not_found' END AS warning
           FROM wanted w LEFT JOIN docs d ON d.uid = w.uid"""
    ),
)
def q23(spark, sf_dir):
    docs = documents(spark, sf_dir)
    wanted = docs.filter(S.term("tag", "soft:error")).select("uid").union(
        docs.filter(S.term("tag", "hard:big")).select(F.concat(F.lit("x"), "uid"))
    )
    return S.get_docs(wanted, docs.select("uid", "ip", "first_seen", "last_seen"))


@query(
    "Q24_token_search",
    """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS uid,
              list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x IN ('the', 'of')) AS t FROM documents)
       SELECT uid, CAST(len(t) AS BIGINT) AS hits FROM d WHERE list_contains(t, 'the') AND list_contains(t, 'of')""",
)
def q24(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("uid"), F.col("text").alias("body"))
    return S.token_search(docs, ["The", "of"])


def _tag_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("src:"), "source")).alias("tag")
    )
    rules = table(spark, sf_dir, "part").select(
        F.lit(True).alias("active"),
        F.array(F.concat(F.lit("soft:"), F.lower("p_brand")), F.concat(F.lit("kind:"), F.lower("p_type"))).alias("tags"),
    )
    return S.tag_values(docs, rules)


_TAGS_SQL = """tags AS (SELECT DISTINCT unnest(['lang:' || lang, 'src:' || source]) AS tag FROM documents
    UNION SELECT DISTINCT unnest(['soft:' || lower(p_brand), 'kind:' || lower(p_type)]) FROM part)"""


@query(
    "Q25_tag_suggestions",
    f"""WITH {_TAGS_SQL}, n AS (SELECT DISTINCT split_part(tag, ':', 1) AS tag FROM tags),
        a AS (SELECT 0 AS part, 'namespace' AS kind, tag AS label, 'tag:' || tag || ':' AS value,
                row_number() OVER (ORDER BY CASE tag WHEN 'lang' THEN 1 WHEN 'soft' THEN 2 WHEN 'hard' THEN 3 ELSE 4 END, tag) AS n
              FROM n WHERE starts_with(tag, 's')),
        m AS (SELECT tag, split_part(tag, ':', 2) AS suf FROM tags WHERE contains(tag, 's')),
        b AS (SELECT 1 AS part, 'tag' AS kind, tag AS label, 'tag:' || tag AS value,
                row_number() OVER (ORDER BY CASE WHEN starts_with(suf, 's') THEN 0 ELSE 1 END,
                  CASE WHEN position('s' IN suf) > 0 THEN position('s' IN suf) - 1 ELSE 9999 END,
                  position('s' IN tag) - 1, length(tag), tag) AS n FROM m),
        u AS (SELECT * FROM a UNION ALL SELECT * FROM b),
        o AS (SELECT row_number() OVER (ORDER BY part, n) AS ord, kind, label, value FROM u)
        SELECT ord, kind, label, value FROM o WHERE ord <= 12""",
)
def q25(spark, sf_dir):
    return S.suggest_tags(_tag_tables(spark, sf_dir), "s")


@query(
    "Q25_tag_suggestions_in_namespace",
    f"""WITH {_TAGS_SQL}, m AS (SELECT tag, split_part(tag, ':', 2) AS suf FROM tags
              WHERE starts_with(tag, 'src:') AND contains(split_part(tag, ':', 2), '1')),
        b AS (SELECT tag, row_number() OVER (ORDER BY CASE WHEN starts_with(suf, '1') THEN 0 ELSE 1 END,
                  position('1' IN suf) - 1, position('1' IN tag) - 1, length(tag), tag) AS ord FROM m)
        SELECT ord, 'tag' AS kind, tag AS label, 'tag:' || tag AS value FROM b WHERE ord <= 12""",
)
def q25b(spark, sf_dir):
    return S.suggest_tags(_tag_tables(spark, sf_dir), "src:1")


@query(
    "Q26_header_suggestions",
    """SELECT header_name, 'http_headval:' || header_name || ':' AS value FROM (
         SELECT 'x-' || lower(replace(p_name, ' ', '-')) AS header_name, bool_or(p_size > 40) AS collect_value
         FROM part GROUP BY 1) WHERE collect_value AND contains(header_name, 're') ORDER BY 1 LIMIT 12""",
)
def q26(spark, sf_dir):
    collection = (
        table(spark, sf_dir, "part")
        .groupBy(F.concat(F.lit("x-"), F.lower(F.replace("p_name", F.lit(" "), F.lit("-")))).alias("header_name"))
        .agg(F.bool_or(F.col("p_size") > 40).alias("collect_value"))
    )
    return S.suggest_headers(collection, "re.lk")


@query(
    "Q28_recent_names",
    with_docs(
        f"""SELECT DISTINCT f AS fqdn FROM (SELECT unnest(fqdn) AS f FROM docs WHERE last_seen >= {NOW_S} - 72*3600)
            WHERE f <> '10.1.2.3'"""
    ),
)
def q28(spark, sf_dir):
    return S.recent_fqdns(documents(spark, sf_dir), 72, NOW_S)


_LEARN_SQL = with_docs(
    f""", names AS (SELECT DISTINCT f AS fqdn FROM (SELECT unnest(fqdn) AS f FROM docs WHERE last_seen >= {NOW_S} - 240*3600)
              WHERE f <> '10.1.2.3'),
         res AS (SELECT DISTINCT 'h' || user_id || '.view.example.com' AS fqdn FROM obs WHERE user_id % 2 = 0),
         m AS (SELECT fqdn, fqdn IN (SELECT fqdn FROM res) AS resolved FROM names
               WHERE regexp_matches(fqdn, '(?i)VIEW\\.') OR regexp_matches(fqdn, '^www'))"""
)


def _learn(spark, sf_dir):
    names = S.recent_fqdns(documents(spark, sf_dir), 240, NOW_S)
    resolutions = (
        observations(spark, sf_dir)
        .groupBy("user_id").agg(F.min("ip_num").alias("a"))
        .select(
            F.expr("'h' || user_id || '.view.example.com'").alias("fqdn"),
            F.when(F.col("user_id") % 2 == 0, F.array(F.col("a").cast("string"))).otherwise(F.array()).alias("addresses"),
        )
    )
    return names, S.learn_fqdns(names, ["VIEW\\.", " ", "^www"], resolutions)


@query("Q29_learn_candidates", f"{_LEARN_SQL} SELECT fqdn, resolved FROM m")
def q29(spark, sf_dir):
    return _learn(spark, sf_dir)[1]


@query(
    "Q29_learn_counts",
    f"{_LEARN_SQL} SELECT (SELECT count(*) FROM names) AS found, count(*) AS matched, "
    "CAST(count(*) FILTER (resolved) AS BIGINT) AS resolved FROM m",
)
def q29_counts(spark, sf_dir):
    return S.learn_counts(*_learn(spark, sf_dir))
