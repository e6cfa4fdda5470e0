"""Scan-coverage analytics over targets, profiles, states, jobs and cycles.

Tables (see FIXTURES): targets(id, value, active, working, last_scan,
last_previous_scan, scan_unit_count), profiles(id, name, apply_to_all, priority,
scan_cycle_minutes), links(profile_id, target_id), states(target_id, profile_id,
working, last_scan, last_previous_scan), jobs(id, profile_id, cycle_id, active,
finished, exported, job_creation, job_start, job_end, priority,
scan_unit_count), job_targets(job_id, target_id), cycles(id, profile_id,
started_at, finished_at, status, completed_scan_unit_count).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.functions.text import sort_ports
from vantage.functions.times import (
    cycle_duration_text,
    duration_text,
    job_duration_text,
    percent,
    seconds_between,
    ts,
)
from vantage.operators.scale import running
from vantage.schema import (
    MAX_UNITS,
    MIN_JOB_SECONDS,
    PRIORITIES,
    QUEUE_BUDGET_PER_TICK,
    QUEUE_TARGET_PER_PROFILE,
    RETAINED_CYCLES,
)

WAITING = "NOT active AND NOT finished"


def _capped_sum(value: Column) -> Column:
    """Sum of BIGINT counters, saturating at the counter bound."""
    total = F.coalesce(F.sum(value.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return F.least(total, F.lit(MAX_UNITS).cast("decimal(38,0)")).cast("bigint")


def effective_links(targets: DataFrame, profiles: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct (profile_id, target_id): explicit links and apply-to-all profiles.

    The apply-to-all ids are a handful of configuration values, read as one
    scalar array and exploded per target; no join is needed for them.
    """
    everywhere = profiles.filter("apply_to_all").agg(F.collect_set("id")).scalar()
    implied = targets.select(F.explode(everywhere).alias("profile_id"), F.col("id").alias("target_id"))
    explicit = links.select("profile_id", "target_id").join(
        targets.select(F.col("id").alias("target_id")), "target_id", "left_semi"
    ).select("profile_id", "target_id")
    return explicit.unionByName(implied).distinct()


def missing_states(targets: DataFrame, profiles: DataFrame, links: DataFrame, states: DataFrame) -> DataFrame:
    """Pairs of active targets and their profiles without a state.

    Links and states meet as two sets of profile ids a target (at most the profiles there are); the complement is taken
    before anything is exploded, so only missing pairs become rows.  All steps share one partitioning by target.
    """
    def pairs(df: DataFrame, linked: bool) -> DataFrame:
        return df.select("target_id", "profile_id", F.lit(linked).alias("linked"))

    both = pairs(links, True).unionByName(pairs(states, False))
    sets = both.groupBy(F.col("target_id").alias("id")).agg(
        F.collect_set(F.when(F.col("linked"), F.col("profile_id"))).alias("linked"),
        F.collect_set(F.when(~F.col("linked"), F.col("profile_id"))).alias("present"),
    )
    none = F.array().cast(f"array<{profiles.schema['id'].dataType.simpleString()}>")
    everywhere = profiles.filter("apply_to_all").agg(F.collect_set("id")).scalar()
    wanted = F.array_union(F.coalesce("linked", none), F.coalesce(everywhere, none))
    known = targets.filter("active").select("id").distinct().join(sets, "id", "left")
    return known.select(F.explode(F.array_except(wanted, F.coalesce("present", none))).alias("profile_id"), F.col("id").alias("target_id"))


def applicable_states(states: DataFrame, targets: DataFrame, profiles: DataFrame, links: DataFrame) -> DataFrame:
    """States of active targets that belong to their profile now."""
    units = targets.filter("active").select(F.col("id").alias("target_id"), F.col("scan_unit_count").alias("units"))
    kind = profiles.select(F.col("id").alias("profile_id"), "apply_to_all")
    linked = links.select("profile_id", "target_id").distinct().withColumn("_linked", F.lit(True))
    return (
        states.join(units, "target_id").join(kind, "profile_id")
        .join(linked, ["profile_id", "target_id"], "left")
        .filter(F.col("apply_to_all") | F.col("_linked").isNotNull())
        .drop("apply_to_all", "_linked")
    )


def due_states(
    states: DataFrame, targets: DataFrame, profiles: DataFrame, links: DataFrame, now, limit: int
) -> DataFrame:
    """Due states per profile: never scanned first, then oldest, `limit` each."""
    cutoff = profiles.select(
        F.col("id").alias("profile_id"),
        (ts(now) - F.make_interval(mins=F.col("scan_cycle_minutes"))).alias("cutoff"),
    )
    due = (
        applicable_states(states.filter("NOT working"), targets, profiles, links)
        .join(cutoff, "profile_id")
        .filter(F.col("last_scan").isNull() | (ts(F.col("last_scan")) <= F.col("cutoff")))
        .drop("cutoff")
    )
    order = Window.partitionBy("profile_id").orderBy(F.col("last_scan").asc_nulls_first(), "target_id")
    return due.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def open_job_pairs(jobs: DataFrame, job_targets: DataFrame) -> DataFrame:
    """(profile_id, target_id) of unfinished jobs."""
    unfinished = jobs.filter("NOT finished").select(F.col("id").alias("job_id"), "profile_id")
    return unfinished.join(job_targets, "job_id").select("profile_id", "target_id")


def orphan_states(states: DataFrame, jobs: DataFrame, job_targets: DataFrame) -> DataFrame:
    """Working states without any unfinished job of the pair."""
    return states.filter("working").join(open_job_pairs(jobs, job_targets), ["profile_id", "target_id"], "left_anti")


def release_targets(targets: DataFrame, states: DataFrame) -> DataFrame:
    """Targets flagged working of which no state works any more."""
    busy = states.filter("working").select(F.col("target_id").alias("id"))
    return targets.filter("working").join(busy, "id", "left_anti")


def waiting_counts(jobs: DataFrame) -> DataFrame:
    return jobs.filter(f"{WAITING} AND profile_id IS NOT NULL").groupBy("profile_id").agg(F.count("id").alias("waiting"))


def queue_budget(
    profiles: DataFrame,
    waiting: DataFrame,
    profile_ports: DataFrame,
    per_profile: int = QUEUE_TARGET_PER_PROFILE,
    budget: int = QUEUE_BUDGET_PER_TICK,
) -> DataFrame:
    """Jobs each profile may add: its deficit, within a budget shared in priority order.

    Profiles without ports or without a cycle length are left out.
    """
    usable = profiles.filter(F.col("scan_cycle_minutes") > 0).join(
        profile_ports.select(F.col("profile_id").alias("id")), "id", "left_semi"
    )
    counted = usable.join(waiting.select(F.col("profile_id").alias("id"), "waiting"), "id", "left").select(
        "id", "priority", F.greatest(F.lit(per_profile) - F.coalesce("waiting", F.lit(0)), F.lit(0)).cast("bigint").alias("deficit")
    )
    shared = running(counted, [-F.col("priority"), F.col("id")], {"before": ("sum", F.col("deficit"))})
    left = F.greatest(F.lit(budget) - F.col("before"), F.lit(0).cast("bigint"))
    return shared.select("id", "priority", "deficit", F.least("deficit", left).alias("granted"))


def retag_priorities(jobs: DataFrame, profiles: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Queued jobs to move to their profile's priority, oldest first, `limit` per profile.

    The second frame tells per profile whether more remain.
    """
    wanted = profiles.select(F.col("id").alias("profile_id"), F.coalesce("priority", F.lit(0)).alias("wanted"))
    drift = jobs.filter(WAITING).join(wanted, "profile_id").filter(F.col("priority") != F.col("wanted"))
    order = Window.partitionBy("profile_id").orderBy("job_creation", "id")
    moved = drift.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    remaining = drift.groupBy("profile_id").agg((F.count("id") > limit).alias("has_remaining"))
    return moved.select("id", "profile_id", "priority", "wanted"), remaining


# --------------------------------------------------------------------------
# cycles


def cycle_progress(
    cycles: DataFrame, states: DataFrame, targets: DataFrame, profiles: DataFrame, links: DataFrame, jobs: DataFrame, now
) -> DataFrame:
    """Recomputed counters and status of every running cycle.

    A target is complete when its state does not work and was scanned since the
    cycle started; the cycle is finished when all are and no job of the profile
    is unfinished.
    """
    live = cycles.filter("status = 'running'").select(
        "id", "profile_id", "started_at", F.coalesce("completed_scan_unit_count", F.lit(0)).cast("bigint").alias("stored")
    )
    # the applicable states of a profile are summed once, per cycle start
    joined = live.select("id", "profile_id", "started_at").join(
        applicable_states(states, targets, profiles, links), "profile_id", "left"
    )
    done = ~F.col("working") & (ts(F.col("last_scan")) >= ts(F.col("started_at")))
    sums = joined.groupBy("id").agg(
        F.count("target_id").alias("target_count"),
        F.count_if(done).alias("completed_target_count"),
        _capped_sum(F.col("units")).alias("scan_unit_count"),
        _capped_sum(F.when(done, F.col("units"))).alias("state_units"),
    )
    job_units = jobs.filter("finished").groupBy(F.col("cycle_id").alias("id")).agg(
        _capped_sum(F.col("scan_unit_count")).alias("job_units")
    )
    unfinished = jobs.filter("NOT finished").groupBy("profile_id").agg(F.count("id").alias("unfinished_jobs"))
    merged = live.join(sums, "id").join(job_units, "id", "left").join(unfinished, "profile_id", "left")
    open_jobs = F.coalesce("unfinished_jobs", F.lit(0).cast("bigint"))
    best = F.greatest("stored", "state_units", F.coalesce("job_units", F.lit(0).cast("bigint")))
    best = F.when(F.col("scan_unit_count") > 0, F.least(best, F.col("scan_unit_count"))).otherwise(best)
    finished = (F.col("completed_target_count") >= F.col("target_count")) & (open_jobs == 0)
    return merged.select(
        "id", "profile_id", "target_count", "completed_target_count", "scan_unit_count",
        F.when(finished, F.col("scan_unit_count")).otherwise(best).alias("completed_scan_unit_count"),
        open_jobs.alias("unfinished_jobs"),
        F.when(finished, "finished").otherwise("running").alias("status"),
        F.when(finished, ts(now)).alias("finished_at"),
    )


def open_cycles(wanted: DataFrame, cycles: DataFrame, now) -> DataFrame:
    """New running cycles for profiles (`profile_id`) without one."""
    running_now = cycles.filter("status = 'running'").select("profile_id")
    return wanted.select("profile_id").distinct().join(running_now, "profile_id", "left_anti").select(
        "profile_id", ts(now).alias("started_at"), F.lit("running").alias("status")
    )


def open_cycles_from_jobs(jobs: DataFrame, cycles: DataFrame) -> DataFrame:
    """Cycles for profiles with open jobs but no running cycle, started at the oldest job."""
    running_now = cycles.filter("status = 'running'").select("profile_id")
    return (
        jobs.filter("NOT finished AND profile_id IS NOT NULL").groupBy("profile_id")
        .agg(F.min("job_creation").alias("started_at"))
        .join(running_now, "profile_id", "left_anti").withColumn("status", F.lit("running"))
    )


def prune_cycles(cycles: DataFrame, keep: int = RETAINED_CYCLES) -> tuple[DataFrame, DataFrame]:
    """Kept and dropped cycles per profile.

    The newest running cycle stays, newest finished ones fill up to `keep`, other
    states only when slots are left.  A profile within `keep` loses nothing.
    """
    keep = max(1, keep)
    kind = F.when(F.col("status") == "running", 0).when(F.col("status") == "finished", 1).otherwise(2)
    newest = F.when(F.col("status") == "finished", F.coalesce("finished_at", "started_at")).otherwise(F.col("started_at"))
    ranked = cycles.withColumn("_kind", kind).withColumn(
        "_rank",
        F.row_number().over(
            Window.partitionBy("profile_id", "_kind").orderBy(newest.desc(), F.desc("started_at"), F.desc("id"))
        ),
    ).filter(F.col("_rank") <= keep)
    counts = cycles.groupBy("profile_id").agg(
        F.count("id").alias("_all"),
        F.count_if(F.col("status") == "running").alias("_running"),
        F.count_if(F.col("status") == "finished").alias("_finished"),
    )
    slots = F.lit(keep) - F.least(F.col("_running"), F.lit(1))
    allowed = (
        F.when(F.col("_all") <= keep, F.col("_rank"))
        .when(F.col("_kind") == 0, 1)
        .when(F.col("_kind") == 1, slots)
        .otherwise(slots - F.least(F.col("_finished"), slots))
    )
    kept = ranked.join(counts, "profile_id").filter(F.col("_rank") <= allowed).select(*cycles.columns)
    return kept, cycles.join(kept.select("id"), "id", "left_anti").select(*cycles.columns)


def unlink_jobs(jobs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Jobs of dropped cycles lose their cycle reference."""
    gone = dropped.select(F.col("id").alias("cycle_id"), F.lit(True).alias("_gone"))
    return jobs.join(gone, "cycle_id", "left").select(
        *[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == "cycle_id" else F.col(c) for c in jobs.columns]
    )


def cycle_rows(cycles: DataFrame, now) -> DataFrame:
    """The two newest cycles of a profile as Current / Last / Previous."""
    order = Window.partitionBy("profile_id").orderBy(F.desc("started_at"), F.desc("id"))
    two = cycles.withColumn("place", F.row_number().over(order)).filter("place <= 2")
    finished = F.count_if(F.col("status") != "running").over(
        Window.partitionBy("profile_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    )
    label = F.when(F.col("status") == "running", "Current").when(finished == 1, "Last").otherwise("Previous")
    return two.select(
        "profile_id", "place", label.alias("label"), "id", "status", "started_at", "finished_at",
        cycle_duration_text(F.col("started_at"), F.col("finished_at"), ts(now)).alias("duration"),
        percent(F.col("completed_scan_unit_count"), F.col("scan_unit_count")).alias("progress"),
    )


def previous_cycle(cycles: DataFrame) -> DataFrame:
    """For every cycle the newest finished one of its profile that started earlier."""
    micros = F.unix_micros(ts(F.col("started_at")))
    before = Window.partitionBy("profile_id").orderBy(micros).rangeBetween(Window.unboundedPreceding, -1)
    candidate = F.when(F.col("status") == "finished", F.struct("finished_at", "id"))
    return cycles.select("id", "profile_id", F.max(candidate).over(before)["id"].alias("previous_id"))


# --------------------------------------------------------------------------
# targets and profiles


def profile_stats(
    targets: DataFrame, profiles: DataFrame, links: DataFrame, states: DataFrame
) -> DataFrame:
    """Effective profiles of every target with state and duration text."""
    kind = profiles.select(
        F.col("id").alias("profile_id"), F.col("name").alias("profile_name"), "scan_cycle_minutes", "apply_to_all"
    )
    mine = states.select("profile_id", "target_id", "working", "last_scan", "last_previous_scan")
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return (
        effective_links(targets, profiles, links).join(kind, "profile_id")
        .join(mine, ["profile_id", "target_id"], "left")
        .select(
            "target_id", "profile_id", "profile_name", "scan_cycle_minutes", "apply_to_all",
            F.coalesce("working", F.lit(False)).alias("working"), show("last_scan"), show("last_previous_scan"),
            duration_text(F.col("last_previous_scan"), F.col("last_scan")).alias("duration"),
        )
        .orderBy("target_id", F.lower("profile_name"))
    )


def complete_jobs(
    states: DataFrame, targets: DataFrame, jobs: DataFrame, job_targets: DataFrame, done: DataFrame, now
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Finish the jobs in `done` (job_id): updated states, targets and jobs.

    A pair without another open job shifts its scan times and stops working; a
    target works while any of its states does.
    """
    ended = done.select(F.col("job_id").alias("id")).distinct().withColumn("_done", F.lit(True))
    new_jobs = jobs.join(ended, "id", "left").select(
        *[
            F.when(F.col("_done"), v).otherwise(F.col(c)).alias(c) if v is not None else F.col(c)
            for c in jobs.columns
            for v in [{"finished": F.lit(True), "active": F.lit(False), "job_end": ts(now)}.get(c)]
        ]
    )
    touched = (
        jobs.join(ended.select("id"), "id", "left_semi").select(F.col("id").alias("job_id"), "profile_id")
        .join(job_targets, "job_id").select("profile_id", "target_id").distinct()
    )
    freed = touched.join(open_job_pairs(new_jobs, job_targets), ["profile_id", "target_id"], "left_anti").withColumn(
        "_free", F.lit(True)
    )
    free = F.col("_free").isNotNull()
    new_states = states.join(freed, ["profile_id", "target_id"], "left").select(
        "target_id", "profile_id",
        (F.col("working") & ~free).alias("working"),
        F.when(free, ts(now)).otherwise(ts(F.col("last_scan"))).alias("last_scan"),
        F.when(free, ts(F.col("last_scan"))).otherwise(ts(F.col("last_previous_scan"))).alias("last_previous_scan"),
    )
    busy = new_states.groupBy(F.col("target_id").alias("id")).agg(F.bool_or("working").alias("_busy"))
    shift = freed.select(F.col("target_id").alias("id")).distinct().withColumn("_shift", F.lit(True))
    seen = touched.select(F.col("target_id").alias("id")).distinct().withColumn("_seen", F.lit(True))
    moved = F.col("_shift").isNotNull()
    new_targets = (
        targets.join(seen, "id", "left").join(shift, "id", "left").join(busy, "id", "left")
        .select(
            *[c for c in targets.columns if c not in ("working", "last_scan", "last_previous_scan")],
            F.when(F.col("_seen"), F.coalesce("_busy", F.lit(False))).otherwise(F.col("working")).alias("working"),
            F.when(moved, ts(now)).otherwise(ts(F.col("last_scan"))).alias("last_scan"),
            F.when(moved, ts(F.col("last_scan"))).otherwise(ts(F.col("last_previous_scan"))).alias("last_previous_scan"),
        )
    )
    return new_states, new_targets, new_jobs


def target_range(states: DataFrame, now) -> DataFrame:
    """Per target: one day before its oldest scan stamp, until now (epoch seconds)."""
    oldest = F.min(F.least(ts(F.col("last_scan")), ts(F.col("last_previous_scan"))))
    return (
        states.groupBy("target_id").agg(oldest.alias("_o")).filter("_o IS NOT NULL")
        .select("target_id", (F.unix_seconds("_o") - 86_400).alias("from_ts"), F.unix_seconds(ts(now)).alias("to_ts"))
    )


# --------------------------------------------------------------------------
# jobs


def expired_jobs(jobs: DataFrame, job_targets: DataFrame, days: int, now) -> tuple[DataFrame, DataFrame]:
    """Exported, finished jobs ended at least `days` ago, and their links."""
    cutoff = ts(now) - F.make_interval(days=F.lit(days))
    old = jobs.filter("NOT active AND exported AND finished").filter(ts(F.col("job_end")) <= cutoff)
    links = job_targets.join(old.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    return old, links


def exportable(jobs: DataFrame) -> DataFrame:
    return jobs.filter("NOT active AND NOT exported AND finished")


def mark_exported(jobs: DataFrame, expected: DataFrame, written: DataFrame) -> DataFrame:
    """Exportable jobs become exported once all their documents are written.

    `expected` and `written` hold one row per document with `job_id`; a job
    without documents is complete at once.
    """
    need = expected.groupBy("job_id").agg(F.count("job_id").alias("_need"))
    have = written.groupBy("job_id").agg(F.count("job_id").alias("_have"))
    counted = jobs.join(need, jobs["id"] == need["job_id"], "left").drop("job_id")
    counted = counted.join(have, counted["id"] == have["job_id"], "left").drop("job_id")
    zero = F.lit(0).cast("bigint")
    complete = F.coalesce("_have", zero) >= F.coalesce("_need", zero)
    ready = ~F.col("active") & F.col("finished") & complete
    return counted.select(*[(F.col("exported") | ready).alias(c) if c == "exported" else F.col(c) for c in jobs.columns])


def job_durations(jobs: DataFrame) -> DataFrame:
    return jobs.select(
        "id", seconds_between(F.col("job_start"), F.col("job_end")).alias("seconds"),
        job_duration_text(F.col("job_start"), F.col("job_end")).alias("duration"),
    )


def profile_ports(ports: DataFrame) -> DataFrame:
    """Distinct ports of a profile, numeric order, comma separated (at most 65,535)."""
    return ports.groupBy("profile_id").agg(
        F.array_join(sort_ports(F.collect_set(F.col("port").cast("string"))), ",").alias("ports")
    )


def profile_scripts(scripts: DataFrame) -> DataFrame:
    """Distinct script names of a profile, sorted, comma separated (configuration)."""
    return scripts.groupBy("profile_id").agg(F.array_join(F.array_sort(F.collect_set("script")), ",").alias("scripts"))


def classify_submissions(submissions: DataFrame, jobs: DataFrame, agents: DataFrame) -> DataFrame:
    """Outcome of result submissions (sub_id, job_id, agent_id, received_at, has_result)."""
    known = agents.select(F.col("id").alias("agent_id"), F.lit(True).alias("_agent"))
    mine = jobs.select(
        F.col("id").alias("job_id"), F.lit(True).alias("_job"), "active", "finished", F.col("agent_id").alias("_owner"), "job_start"
    )
    elapsed = (F.unix_micros(ts(F.col("received_at"))) - F.unix_micros(ts(F.col("job_start")))) / 1_000_000
    status = (
        F.when(F.col("_agent").isNull(), "forbidden")
        .when(F.col("_job").isNull(), "unknown_job")
        .when(F.col("finished") & ~F.col("active"), "repeat")
        .when(~F.col("_owner").eqNullSafe(F.col("agent_id")), "forbidden")
        .when(~F.col("active") | F.col("finished") | F.col("job_start").isNull(), "not_active")
        .when(elapsed < MIN_JOB_SECONDS, "too_quick")
        .when(~F.col("has_result"), "missing_result")
        .otherwise("accepted")
    )
    return submissions.join(known, "agent_id", "left").join(mine, "job_id", "left").select("sub_id", "job_id", status.alias("status"))


def job_target_counts(jobs: DataFrame, job_targets: DataFrame) -> DataFrame:
    linked = job_targets.groupBy("job_id").agg(F.count("target_id").alias("n"))
    return jobs.select("id").join(linked, F.col("id") == F.col("job_id"), "left").select(
        "id", F.coalesce("n", F.lit(0).cast("bigint")).alias("targets")
    )


def open_priorities(jobs: DataFrame) -> DataFrame:
    """Distinct valid priorities with waiting jobs."""
    return jobs.filter(WAITING).filter(F.col("priority").isin(*PRIORITIES)).select("priority").distinct().orderBy("priority")
