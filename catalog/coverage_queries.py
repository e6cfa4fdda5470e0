"""Coverage queries (L1-L23): customers are targets, nations profiles, orders jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.base import query, table
from vantage.operators import coverage as L

NOW = dt.datetime(2001, 12, 1)

# Expressions both dialects share.
_JOB = """o_orderkey AS id, c_nationkey AS profile_id, CAST(c_nationkey * 100 + (year(o_orderdate) - 1990) AS BIGINT) AS cycle_id, o_orderstatus = 'P' AS active,
  o_orderstatus = 'F' AS finished, o_orderstatus = 'F' AND o_totalprice > 250000 AS exported, o_orderdate AS job_creation, job_start, job_end,
  5 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, 1 + o_orderkey % 512 AS scan_unit_count, o_custkey % 4 AS agent_id"""
_TARGET = """c_custkey AS id, lower(replace(c_name, '#', '-')) || '.example.com' AS value, c_acctbal > 0 AS active, c_mktsegment <> 'BUILDING' AS working,
  1 + c_custkey % 256 AS scan_unit_count"""
_PROFILE = """n_nationkey AS id, n_name AS name, n_regionkey = 0 AS apply_to_all, n_nationkey % 5 AS priority,
  CASE WHEN n_nationkey = 6 THEN 0 ELSE n_nationkey * 1440 + 1440 END AS scan_cycle_minutes"""
_STATUS = "CASE WHEN y >= 2001 OR (y = 2000 AND profile_id % 4 = 0) THEN 'running' WHEN profile_id % 5 = 0 AND y = 1999 THEN 'paused' ELSE 'finished' END"

SQL = f"""
jd AS (SELECT l_orderkey, min(l_shipdate) AS job_start, max(l_shipdate) AS job_end FROM lineitem GROUP BY l_orderkey),
jobs AS (SELECT {_JOB} FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN jd ON l_orderkey = o_orderkey),
job_targets AS (SELECT o_orderkey AS job_id, o_custkey AS target_id FROM orders),
od AS (SELECT o_custkey, o_orderdate, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders),
cs AS (SELECT o_custkey, max(CASE WHEN rn = 1 THEN o_orderdate END) AS last_scan, max(CASE WHEN rn = 2 THEN o_orderdate END) AS last_previous_scan,
       max(CASE WHEN rn = 1 THEN o_orderstatus END) = 'O' AS working FROM od GROUP BY o_custkey),
targets AS (SELECT {_TARGET}, last_scan, last_previous_scan FROM customer LEFT JOIN cs ON o_custkey = c_custkey),
profiles AS (SELECT {_PROFILE} FROM nation),
links AS (SELECT c_nationkey AS profile_id, c_custkey AS target_id FROM customer WHERE c_mktsegment <> 'MACHINERY'),
states AS (SELECT c_custkey AS target_id, c_nationkey AS profile_id, coalesce(cs.working, false) AS working,
     CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE last_scan END AS last_scan,
     CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE last_previous_scan END AS last_previous_scan FROM customer JOIN cs ON o_custkey = c_custkey),
cy0 AS (SELECT profile_id, year(job_creation) AS y, min(job_creation) AS started_at, max(job_creation) AS ended, count(*) AS n FROM jobs GROUP BY ALL),
cycles AS (SELECT profile_id * 100 + (y - 1990) AS id, profile_id, started_at, {_STATUS} AS status,
     CASE WHEN {_STATUS} = 'finished' THEN ended + INTERVAL 1 DAY END AS finished_at, n * 3 AS completed_scan_unit_count, n * 4 AS scan_unit_count FROM cy0)"""


class Tables:
    """The coverage tables of one data folder."""

    def __init__(self, spark, sf_dir):
        t = lambda name: table(spark, sf_dir, name)
        dates = t("lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("job_start"), F.max("l_shipdate").alias("job_end"))
        owned = t("orders").join(t("customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
        self.jobs = owned.join(dates, F.col("l_orderkey") == F.col("o_orderkey"), "left").selectExpr(*_split(_JOB))
        self.job_targets = t("orders").selectExpr("o_orderkey AS job_id", "o_custkey AS target_id")
        newest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
        two = t("orders").withColumn("rn", F.row_number().over(newest)).filter("rn <= 2")
        scans = two.groupBy("o_custkey").agg(
            F.max(F.when(F.col("rn") == 1, F.col("o_orderdate"))).alias("last_scan"),
            F.max(F.when(F.col("rn") == 2, F.col("o_orderdate"))).alias("last_previous_scan"),
            (F.max(F.when(F.col("rn") == 1, F.col("o_orderstatus"))) == "O").alias("working"),
        )
        customer = t("customer")
        self.targets = customer.join(scans.drop("working"), F.col("c_custkey") == F.col("o_custkey"), "left").selectExpr(
            *_split(_TARGET), "last_scan", "last_previous_scan"
        )
        self.profiles = t("nation").selectExpr(*_split(_PROFILE))
        self.links = customer.filter("c_mktsegment <> 'MACHINERY'").selectExpr("c_nationkey AS profile_id", "c_custkey AS target_id")
        known = F.col("c_mktsegment") != "HOUSEHOLD"
        self.states = customer.join(scans, F.col("c_custkey") == F.col("o_custkey")).select(
            F.col("c_custkey").alias("target_id"), F.col("c_nationkey").alias("profile_id"), "working",
            F.when(known, F.col("last_scan")).alias("last_scan"), F.when(known, F.col("last_previous_scan")).alias("last_previous_scan"),
        )
        years = self.jobs.groupBy("profile_id", F.year("job_creation").alias("y")).agg(
            F.min("job_creation").alias("started_at"), F.max("job_creation").alias("ended"), F.count("*").alias("n")
        )
        self.cycles = years.selectExpr(
            "CAST(profile_id * 100 + (y - 1990) AS BIGINT) AS id", "profile_id", "started_at", f"{_STATUS} AS status",
            f"CASE WHEN {_STATUS} = 'finished' THEN ended + INTERVAL 1 DAY END AS finished_at",
            "n * 3 AS completed_scan_unit_count", "n * 4 AS scan_unit_count",
        )
        self.ports = t("part").selectExpr("CAST(p_partkey % 25 AS INT) AS profile_id", "p_size * 100 AS port", "p_name AS script").filter("profile_id <> 4")
        lineitem = t("lineitem")
        self.documents = lineitem.select(F.col("l_orderkey").alias("job_id"))
        self.written = lineitem.filter("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("job_id"))
        self.submissions = lineitem.selectExpr(*_split(_SUB))
        self.agents = t("region").selectExpr("CAST(r_regionkey AS BIGINT) AS id").filter("id <> 3")


PORTS_SQL = "ports AS (SELECT CAST(p_partkey % 25 AS INT) AS profile_id, p_size * 100 AS port, p_name AS script FROM part WHERE p_partkey % 25 <> 4)"


def _split(text: str) -> list[str]:
    """Top-level comma split of an expression list."""
    out, depth, part = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(part)
            part = ""
        else:
            part += ch
    return [p.strip() for p in (*out, part)]


def cov(name: str, sql: str | None):
    """Register a query over the coverage tables."""

    def register(fn):
        return query(name, None if sql is None else f"WITH {SQL}{'' if sql.lstrip().startswith(',') else chr(10)}{sql}")(
            lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        )

    return register


_EFF = """, eff AS (SELECT l.profile_id, l.target_id FROM links l UNION SELECT p.id, t.id FROM profiles p, targets t WHERE p.apply_to_all)"""
_APP = """, app AS (SELECT s.*, t.scan_unit_count AS units FROM states s JOIN targets t ON t.id = s.target_id JOIN profiles p ON p.id = s.profile_id
   WHERE t.active AND (p.apply_to_all OR EXISTS (SELECT 1 FROM links l WHERE l.profile_id = s.profile_id AND l.target_id = s.target_id)))"""
_OPEN = ", op AS (SELECT j.profile_id, jt.target_id FROM jobs j JOIN job_targets jt ON jt.job_id = j.id WHERE NOT j.finished)"


@cov("L1_missing_states", f"""{_EFF} SELECT profile_id, target_id FROM eff e JOIN targets t ON t.id = e.target_id WHERE t.active
     AND NOT EXISTS (SELECT 1 FROM states s WHERE s.profile_id = e.profile_id AND s.target_id = e.target_id)""")
def l1(t):
    return L.missing_states(t.targets, t.profiles, t.links, t.states)


@cov("L2_due_states", f"""{_APP}, d AS (SELECT a.*, row_number() OVER (PARTITION BY a.profile_id ORDER BY a.last_scan ASC NULLS FIRST, a.target_id) AS rn
     FROM app a JOIN profiles p ON p.id = a.profile_id WHERE NOT a.working AND (a.last_scan IS NULL OR a.last_scan <= TIMESTAMP '2001-12-01' - to_minutes(CAST(p.scan_cycle_minutes AS INT))))
     SELECT profile_id, target_id, last_scan, CAST(rn AS INT) AS place FROM d WHERE rn <= 20""")
def l2(t):
    return L.due_states(t.states, t.targets, t.profiles, t.links, NOW, 20).select("profile_id", "target_id", "last_scan", "place")


@cov("L3_orphan_states", f"{_OPEN.replace('NOT j.finished', "NOT j.finished AND j.job_creation >= TIMESTAMP '2001-03-01'")} SELECT profile_id, target_id FROM states s WHERE working AND NOT EXISTS (SELECT 1 FROM op WHERE op.profile_id = s.profile_id AND op.target_id = s.target_id)")
def l3(t):
    # older jobs have ended, so some working states have lost theirs
    jobs = t.jobs.withColumn("finished", F.expr("finished OR job_creation < timestamp_ntz'2001-03-01 00:00:00'"))
    return L.orphan_states(t.states, jobs, t.job_targets).select("profile_id", "target_id")


@cov("L4_release_targets", "SELECT id FROM targets t WHERE working AND NOT EXISTS (SELECT 1 FROM states s WHERE s.target_id = t.id AND s.working)")
def l4(t):
    return L.release_targets(t.targets, t.states).select("id")


@cov("L5_waiting_counts", "SELECT profile_id, count(*) AS waiting FROM jobs WHERE NOT active AND NOT finished GROUP BY profile_id")
def l5(t):
    return L.waiting_counts(t.jobs)


@cov("L6_queue_budget", f""", {PORTS_SQL}, w AS (SELECT profile_id, count(*) AS waiting FROM jobs WHERE NOT active AND NOT finished GROUP BY profile_id),
     d AS (SELECT p.id, p.priority, greatest(600 - coalesce(w.waiting, 0), 0) AS deficit FROM profiles p LEFT JOIN w ON w.profile_id = p.id
           WHERE p.scan_cycle_minutes > 0 AND p.id IN (SELECT profile_id FROM ports)),
     b AS (SELECT *, coalesce(sum(deficit) OVER (ORDER BY priority DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM d)
     SELECT id, priority, CAST(deficit AS BIGINT) AS deficit, CAST(least(deficit, greatest(3000 - bef, 0)) AS BIGINT) AS granted FROM b""")
def l6(t):
    return L.queue_budget(t.profiles, L.waiting_counts(t.jobs), t.ports, 600, 3000)


_DRIFT = ", dr AS (SELECT j.id, j.profile_id, j.priority, p.priority AS wanted, j.job_creation FROM jobs j JOIN profiles p ON p.id = j.profile_id WHERE NOT j.active AND NOT j.finished AND j.priority <> p.priority)"


@cov("L7_priority_drift", f"{_DRIFT} SELECT id, profile_id, priority, wanted FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY job_creation, id) AS rn FROM dr) WHERE rn <= 30")
def l7(t):
    return L.retag_priorities(t.jobs, t.profiles, 30)[0]


@cov("L7_priority_remaining", f"{_DRIFT} SELECT profile_id, count(*) > 160 AS has_remaining FROM dr GROUP BY profile_id")
def l7_remaining(t):
    return L.retag_priorities(t.jobs, t.profiles, 160)[1]


@cov("L8_applicable_states", f"{_APP} SELECT profile_id, target_id, working, units FROM app")
def l8(t):
    return L.applicable_states(t.states, t.targets, t.profiles, t.links).select("profile_id", "target_id", "working", "units")


@cov("L9_cycle_progress", f"""{_APP}, j AS (SELECT c.id, c.profile_id, c.completed_scan_unit_count AS stored, count(a.target_id) AS tc,
        count(*) FILTER (NOT a.working AND a.last_scan >= c.started_at) AS done, coalesce(sum(a.units), 0) AS su,
        coalesce(sum(a.units) FILTER (NOT a.working AND a.last_scan >= c.started_at), 0) AS du
        FROM cycles c LEFT JOIN app a ON a.profile_id = c.profile_id WHERE c.status = 'running' GROUP BY ALL),
     ju AS (SELECT cycle_id, sum(scan_unit_count) AS u FROM jobs WHERE finished GROUP BY cycle_id),
     un AS (SELECT profile_id, count(*) AS n FROM jobs WHERE NOT finished GROUP BY profile_id),
     f AS (SELECT j.*, coalesce(un.n, 0) AS open, CASE WHEN su > 0 THEN least(greatest(stored, du, coalesce(ju.u, 0)), su) ELSE greatest(stored, du, coalesce(ju.u, 0)) END AS best
        FROM j LEFT JOIN ju ON ju.cycle_id = j.id LEFT JOIN un ON un.profile_id = j.profile_id)
     SELECT id, profile_id, tc AS target_count, done AS completed_target_count, CAST(su AS BIGINT) AS scan_unit_count,
       CAST(CASE WHEN done >= tc AND open = 0 THEN su ELSE best END AS BIGINT) AS completed_scan_unit_count, open AS unfinished_jobs,
       CASE WHEN done >= tc AND open = 0 THEN 'finished' ELSE 'running' END AS status FROM f""")
def l9(t):
    return L.cycle_progress(t.cycles, t.states, t.targets, t.profiles, t.links, t.jobs, NOW).drop("finished_at")


@cov("L10_cycle_start", """SELECT DISTINCT profile_id, TIMESTAMP '2001-12-01' AS started_at, 'running' AS status FROM (SELECT profile_id FROM links UNION ALL SELECT id FROM profiles) w
     WHERE profile_id NOT IN (SELECT profile_id FROM cycles WHERE status = 'running' AND profile_id < 10)""")
def l10(t):
    cycles = t.cycles.withColumn("status", F.expr("CASE WHEN profile_id >= 10 AND status = 'running' THEN 'finished' ELSE status END"))
    wanted = t.links.select("profile_id").unionByName(t.profiles.selectExpr("id AS profile_id"))
    return L.open_cycles(wanted, cycles, NOW).withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))


@cov("L10_cycle_start_from_jobs", """SELECT profile_id, min(job_creation) AS started_at, 'running' AS status FROM jobs WHERE NOT finished
     AND profile_id NOT IN (SELECT profile_id FROM cycles WHERE status = 'running' AND profile_id < 10) GROUP BY profile_id""")
def l10_jobs(t):
    cycles = t.cycles.withColumn("status", F.expr("CASE WHEN profile_id >= 10 AND status = 'running' THEN 'finished' ELSE status END"))
    return L.open_cycles_from_jobs(t.jobs, cycles)


_KEPT = """, rk AS (SELECT *, CASE status WHEN 'running' THEN 0 WHEN 'finished' THEN 1 ELSE 2 END AS kind,
      row_number() OVER (PARTITION BY profile_id, status ORDER BY CASE WHEN status = 'finished' THEN coalesce(finished_at, started_at) ELSE started_at END DESC, started_at DESC, id DESC) AS rn FROM cycles),
    ct AS (SELECT profile_id, count(*) AS n, least(count(*) FILTER (status = 'running'), 1) AS r, count(*) FILTER (status = 'finished') AS f FROM cycles GROUP BY profile_id),
    kept AS (SELECT rk.id, rk.profile_id FROM rk JOIN ct USING (profile_id) WHERE n <= 6 OR (kind = 0 AND rn = 1) OR (kind = 1 AND rn <= 6 - r) OR (kind = 2 AND rn <= 6 - r - least(f, 6 - r)))"""


@cov("L11_cycle_retention", f"{_KEPT} SELECT id, profile_id FROM kept")
def l11(t):
    return L.prune_cycles(t.cycles, 6)[0].select("id", "profile_id")


@cov("L11_unlinked_jobs", f"{_KEPT} SELECT id, CASE WHEN cycle_id IN (SELECT id FROM kept) THEN cycle_id END AS cycle_id FROM jobs")
def l11_jobs(t):
    return L.unlink_jobs(t.jobs, L.prune_cycles(t.cycles, 6)[1]).select("id", "cycle_id")


@cov("L12_cycle_labels", """, r AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY started_at DESC, id DESC) AS place FROM cycles),
     w AS (SELECT *, count(*) FILTER (status <> 'running') OVER (PARTITION BY profile_id ORDER BY place) AS fin FROM r WHERE place <= 2)
     SELECT profile_id, CAST(place AS INT) AS place, id, CASE WHEN status = 'running' THEN 'Current' WHEN fin = 1 THEN 'Last' ELSE 'Previous' END AS label,
       round(least(100.0, CAST(completed_scan_unit_count AS DOUBLE) / scan_unit_count * 100), 1) AS progress FROM w""")
def l12(t):
    return L.cycle_rows(t.cycles, NOW).select("profile_id", "place", "id", "label", F.round("progress", 1).alias("progress"))


@cov("L13_previous_cycle", """SELECT c.id, c.profile_id, (SELECT arg_max(p.id, (p.finished_at, p.id)) FROM cycles p WHERE p.profile_id = c.profile_id
      AND p.status = 'finished' AND p.started_at < c.started_at) AS previous_id FROM cycles c""")
def l13(t):
    return L.previous_cycle(t.cycles)


@cov("L14_profile_status", f"""{_EFF}, j AS (SELECT e.target_id, e.profile_id, p.name AS profile_name, p.apply_to_all, coalesce(s.working, false) AS working, s.last_scan,
       CAST(epoch(s.last_scan) - epoch(s.last_previous_scan) AS BIGINT) AS d FROM eff e JOIN profiles p ON p.id = e.profile_id
       LEFT JOIN states s ON s.target_id = e.target_id AND s.profile_id = e.profile_id)
     SELECT target_id, profile_id, profile_name, apply_to_all, working, strftime(last_scan, '%Y-%m-%d %H:%M:%S') AS last_scan,
       CASE WHEN d IS NULL THEN '∞' WHEN d >= 3600 THEN printf('%02d:%02d:%02d', d // 3600, (d % 3600) // 60, d % 60) ELSE d || 's' END AS duration FROM j""")
def l14(t):
    return L.profile_stats(t.targets, t.profiles, t.links, t.states).select(
        "target_id", "profile_id", "profile_name", "apply_to_all", "working", "last_scan", "duration"
    )


_DONE = """, done AS (SELECT id FROM jobs WHERE active), touched AS (SELECT DISTINCT j.profile_id, jt.target_id FROM jobs j JOIN job_targets jt ON jt.job_id = j.id WHERE j.active),
   opn AS (SELECT j.profile_id, jt.target_id FROM jobs j JOIN job_targets jt ON jt.job_id = j.id WHERE NOT j.finished AND NOT j.active),
   freed AS (SELECT * FROM touched EXCEPT SELECT * FROM opn),
   ns AS (SELECT s.target_id, s.profile_id, s.working AND f.target_id IS NULL AS working, CASE WHEN f.target_id IS NULL THEN s.last_scan ELSE TIMESTAMP '2001-12-01' END AS last_scan,
      CASE WHEN f.target_id IS NULL THEN s.last_previous_scan ELSE s.last_scan END AS last_previous_scan
      FROM states s LEFT JOIN freed f ON f.target_id = s.target_id AND f.profile_id = s.profile_id)"""


def _complete(t):
    done = t.jobs.filter("active").select(F.col("id").alias("job_id"))
    return L.complete_jobs(t.states, t.targets, t.jobs, t.job_targets, done, NOW)


def _plain(df, *stamps):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in stamps else F.col(c) for c in df.columns])


@cov("L15_completed_states", f"{_DONE} SELECT * FROM ns")
def l15(t):
    return _plain(_complete(t)[0], "last_scan", "last_previous_scan")


@cov("L15_completed_targets", f"""{_DONE} SELECT t.id, CASE WHEN t.id IN (SELECT target_id FROM touched) THEN EXISTS (SELECT 1 FROM ns WHERE ns.target_id = t.id AND ns.working) ELSE t.working END AS working,
      CASE WHEN t.id IN (SELECT target_id FROM freed) THEN TIMESTAMP '2001-12-01' ELSE t.last_scan END AS last_scan,
      CASE WHEN t.id IN (SELECT target_id FROM freed) THEN t.last_scan ELSE t.last_previous_scan END AS last_previous_scan FROM targets t""")
def l15_targets(t):
    return _plain(_complete(t)[1].select("id", "working", "last_scan", "last_previous_scan"), "last_scan", "last_previous_scan")


@cov("L15_completed_jobs", "SELECT id, active AND false AS active, finished OR active AS finished, CASE WHEN active THEN TIMESTAMP '2001-12-01' ELSE job_end END AS job_end FROM jobs")
def l15_jobs(t):
    return _plain(_complete(t)[2].select("id", "active", "finished", "job_end"), "job_end")


@cov("L16_target_range", """SELECT target_id, CAST(epoch(min(least(last_scan, last_previous_scan))) AS BIGINT) - 86400 AS from_ts, CAST(1007164800 AS BIGINT) AS to_ts
      FROM states WHERE last_scan IS NOT NULL OR last_previous_scan IS NOT NULL GROUP BY target_id""")
def l16(t):
    return L.target_range(t.states, NOW)


@cov("L17_expired_jobs", "SELECT id FROM jobs WHERE NOT active AND exported AND finished AND job_end <= TIMESTAMP '2001-12-01' - INTERVAL 900 DAY")
def l17(t):
    return L.expired_jobs(t.jobs, t.job_targets, 900, NOW)[0].select("id")


@cov("L17_expired_links", "SELECT job_id, target_id FROM job_targets WHERE job_id IN (SELECT id FROM jobs WHERE NOT active AND exported AND finished AND job_end <= TIMESTAMP '2001-12-01' - INTERVAL 900 DAY)")
def l17_links(t):
    return L.expired_jobs(t.jobs, t.job_targets, 900, NOW)[1].select("job_id", "target_id")


@cov("L18_export_readiness", """, e AS (SELECT l_orderkey AS id, count(*) AS need, count(*) FILTER (l_returnflag <> 'R') AS have FROM lineitem GROUP BY 1)
     SELECT j.id, j.exported OR (NOT active AND finished AND coalesce(have, 0) >= coalesce(need, 0)) AS exported FROM jobs j LEFT JOIN e ON e.id = j.id""")
def l18(t):
    return L.mark_exported(t.jobs, t.documents, t.written).select("id", "exported")


@cov("L18_exportable", "SELECT id FROM jobs WHERE NOT active AND NOT exported AND finished")
def l18_exportable(t):
    return L.exportable(t.jobs).select("id")


@cov("L19_job_durations", """SELECT id, CAST(epoch(job_end) - epoch(job_start) AS BIGINT) AS seconds, CASE WHEN job_end IS NULL THEN 'oo'
      WHEN job_end = job_start THEN '0s' ELSE printf('%02d:00', CAST(epoch(job_end) - epoch(job_start) AS BIGINT) // 60) END AS duration FROM jobs""")
def l19(t):
    return L.job_durations(t.jobs)


@cov("L20_profile_ports", f", {PORTS_SQL} SELECT profile_id, string_agg(port, ',' ORDER BY port) AS ports FROM (SELECT DISTINCT profile_id, port FROM ports) GROUP BY profile_id")
def l20(t):
    return L.profile_ports(t.ports)


@cov("L20_profile_scripts", f", {PORTS_SQL} SELECT profile_id, string_agg(script, ',' ORDER BY script) AS scripts FROM (SELECT DISTINCT profile_id, script FROM ports) GROUP BY profile_id")
def l20_scripts(t):
    return L.profile_scripts(t.ports)


_SUB = "l_orderkey * 10 + l_linenumber AS sub_id, CASE WHEN l_tax = 0.0 THEN l_orderkey + 1000000000 ELSE l_orderkey END AS job_id, l_suppkey % 5 AS agent_id, l_shipdate AS received_at, l_discount > 0.01 AS has_result"


@cov("L21_submissions", f""", s AS (SELECT {_SUB} FROM lineitem)
     SELECT s.sub_id, s.job_id, CASE WHEN s.agent_id = 3 THEN 'forbidden' WHEN j.id IS NULL THEN 'unknown_job' WHEN j.finished AND NOT j.active THEN 'repeat'
       WHEN j.agent_id <> s.agent_id THEN 'forbidden' WHEN NOT j.active OR j.finished OR j.job_start IS NULL THEN 'not_active'
       WHEN epoch(s.received_at) - epoch(j.job_start) < 1 THEN 'too_quick' WHEN NOT s.has_result THEN 'missing_result' ELSE 'accepted' END AS status
     FROM s LEFT JOIN jobs j ON j.id = s.job_id""")
def l21(t):
    return L.classify_submissions(t.submissions, t.jobs, t.agents)


@cov("L22_targets_per_job", "SELECT j.id, count(jt.target_id) AS targets FROM jobs j LEFT JOIN job_targets jt ON jt.job_id = j.id GROUP BY j.id")
def l22(t):
    return L.job_target_counts(t.jobs, t.job_targets)


@cov("L23_open_priorities", "SELECT DISTINCT priority FROM jobs WHERE NOT active AND NOT finished AND priority BETWEEN 0 AND 4")
def l23(t):
    return L.open_priorities(t.jobs)
