"""Fielded search over the document table.

A search is a list of groups; a group is a list of terms ``(field, op, value)``
with op one of ``exact``, ``begin``, ``like``, ``not``.  Terms of a group are
AND-ed, groups are OR-ed.  Everything becomes one boolean column, so a search is
one scan with pushed range predicates plus one aggregation.
"""

from __future__ import annotations

import datetime as dt
import re
import shlex
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.functions.netaddr import address_key, in_network_num
from vantage.functions.text import HEADER_NAME_MAX, HEADER_NAME_RE, port_order
from vantage.functions.times import epoch, short_date
from vantage.schema import (
    FIELDS,
    PREFERRED_NAMESPACES,
    SEARCH_DEFAULT_MONTHS,
    SEARCH_MAX_WINDOW_DAYS,
    SEARCH_PAGE_LIMIT,
    SUGGESTION_LIMIT,
)
from vantage.session import local_table, materialize

Term = tuple[str, str, str]

# Modifier spellings.
MODIFIERS = {
    "": "exact",
    "lk": "like",
    "like": "like",
    "bg": "begin",
    "begin": "begin",
    "nt": "not",
    "not": "not",
}
DAY = 86_400


# --------------------------------------------------------------------------
# terms


def search_terms(text: str) -> list[list[Term]]:
    """Short-hand for term lists: ``field[.modifier]:value`` words, ``OR`` between groups.

    Raises ValueError on an unknown field, a bad modifier or an empty group.  A ``since:N`` word is no term; see
    :func:`since_days`.
    """
    groups: list[list[Term]] = [[]]
    for word in shlex.split(text):
        if word.upper() == "OR":
            groups.append([])
        elif word.upper() != "AND" and not word.lower().startswith("since:"):
            groups[-1].append(_term_of(word))
    if not all(groups):
        raise ValueError("empty search group")
    return groups


def since_days(text: str) -> int | None:
    """N of the ``since:N`` word of a search text, None without one; ValueError on two of them or on a bad N."""
    given = [w.partition(":")[2].strip() for w in shlex.split(text) if w.lower().startswith("since:")]
    if len(given) > 1:
        raise ValueError("only one since: word is allowed")
    if given and not (given[0].isdecimal() and int(given[0]) > 0):
        raise ValueError("since: takes a positive number of days")
    return int(given[0]) if given else None


def _term_of(word: str) -> Term:
    name, colon, value = word.partition(":")
    name = name.lower()
    if name == "http_headval" and colon:
        header, colon, value = value.partition(":")
        name, value = "http_headval", value.strip()
        header, _, modifier = _split_modifier(header.strip().lower())
        if not colon or not value or not re.fullmatch(HEADER_NAME_RE, header):
            raise ValueError(f"bad header term: {word}")
        if MODIFIERS[modifier] == "not":
            raise ValueError(f"bad modifier: {word}")
        return name, MODIFIERS[modifier], f"{header}:{value}".lower()
    name, _, modifier = _split_modifier(name)
    if not colon or name not in (*FIELDS, "ip", "net"):
        raise ValueError(f"bad search term: {word}")
    if name == "tag" and modifier:
        raise ValueError(f"bad modifier: {word}")
    return name, MODIFIERS[modifier], value.lower()


def _split_modifier(name: str) -> tuple[str, str, str]:
    base, dot, modifier = name.rpartition(".")
    return (base, dot, modifier) if dot and modifier in MODIFIERS else (name, "", "")


def term(field: str, value: str, op: str = "exact") -> Column:
    """Predicate of one term on an array field (values are stored lower-cased)."""
    value = value.strip().lower()
    if field == "ip":
        hit = F.col("ip") == value
        return ~hit if op == "not" else hit
    if field == "net":
        hit = in_network_num("ip_num", "ip_key", value)
        return ~hit if op == "not" else hit
    values = F.col(field)
    if op == "exact":
        return F.coalesce(F.array_contains(values, value), F.lit(False))
    if op == "not":
        return ~F.coalesce(F.array_contains(values, value), F.lit(False))
    if op == "begin":
        return F.coalesce(F.exists(values, lambda x: x.startswith(value)), F.lit(False))
    if op == "like":
        return F.coalesce(F.exists(values, lambda x: x.contains(value)), F.lit(False))
    raise ValueError(f"unknown operator {op}")


def header_value(name: str, value: str, op: str = "exact") -> Column:
    """Header-scoped value: exact header name, modifier on the value part only."""
    name, value = name.strip().lower(), value.strip().lower()
    if not value or len(name) > HEADER_NAME_MAX or not re.fullmatch(HEADER_NAME_RE, name):
        return F.lit(False)
    prefix = f"{name}:"
    if op == "exact":
        return term("http_headval", prefix + value)
    if op == "begin":
        return term("http_headval", prefix + value, "begin")
    if op == "like":
        inside = F.exists(
            F.col("http_headval"),
            lambda x: x.startswith(prefix) & F.substring(x, len(prefix) + 1, 1 << 30).contains(value),
        )
        return F.coalesce(inside, F.lit(False))
    return F.lit(False)


def _search_term(t: Term) -> Column:
    field, op, value = t
    if field == "http_headval":
        name, colon, rest = value.partition(":")
        return header_value(name, rest, op) if colon else F.lit(False)
    return term(field, value, op)


def all_of(terms: Iterable[Term]) -> Column:
    """One group: addresses and networks are alternatives, the rest is required."""
    terms = list(terms)
    places = [t for t in terms if t[0] in ("ip", "net") and t[1] == "exact"]
    rest = [t for t in terms if t not in places]
    parts = []
    if places:
        parts.append(reduce(lambda a, b: a | b, [_search_term(t) for t in places]))
    parts += [_search_term(t) for t in rest]
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(False)


def any_of(groups: Iterable[Iterable[Term]]) -> Column:
    parts = [all_of(g) for g in groups]
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


# --------------------------------------------------------------------------
# time


def overlaps(start: int, end: int) -> Column:
    """Seen interval touches [start, end]; reversed bounds are swapped."""
    start, end = min(start, end), max(start, end)
    return (F.col("last_seen") >= start) & (F.col("first_seen") <= end)


def seen_in(start: int, end: int) -> Column:
    start, end = min(start, end), max(start, end)
    return F.col("last_seen").between(start, end)


def resolve_range(
    start: int | None, end: int | None, now: dt.datetime, since_days: int | None = None
) -> tuple[int, int]:
    """Literal search bounds.

    ``since`` (N whole days back until the end of today) applies only when a
    bound is missing; otherwise a missing bound defaults to now and now minus
    three calendar months.
    """
    now = now.replace(tzinfo=dt.timezone.utc) if now.tzinfo is None else now
    if since_days is not None and (start is None or end is None):
        if since_days <= 0:
            raise ValueError("since expects a positive number of days")
        midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
        return (
            int((midnight - dt.timedelta(days=since_days)).timestamp()),
            int(midnight.timestamp()) + DAY - 1,
        )
    if start is None:
        index = now.year * 12 + now.month - 1 - SEARCH_DEFAULT_MONTHS
        first = dt.date(index // 12, index % 12 + 1, 1)
        following = dt.date((index + 1) // 12, (index + 1) % 12 + 1, 1)
        back = now.replace(
            year=first.year, month=first.month, day=min(now.day, (following - first).days)
        )
        start = int(back.timestamp())
    if end is None:
        end = int(now.timestamp())
    if start > end:
        raise ValueError("start time must be before end time")
    return start, end


# --------------------------------------------------------------------------
# grouping


def hits(docs: DataFrame, groups: Iterable[Iterable[Term]], start: int, end: int) -> DataFrame:
    return docs.filter(overlaps(start, end) & any_of(groups))


def by_ip(found: DataFrame) -> DataFrame:
    """Per address: number of hit documents and their seen range."""
    return by_ip_and(found)


def by_ip_and(found: DataFrame, *keys: Column) -> DataFrame:
    """As :func:`by_ip`, per address and further keys."""
    return found.groupBy("ip", *keys).agg(
        F.count("uid").alias("uid_count"),
        F.min("first_seen").alias("min_seen"),
        F.max("last_seen").alias("max_seen"),
    )


def uid_lists(found: DataFrame, chunk: int = 1000) -> DataFrame:
    """Per address the sorted document ids, in parts of about `chunk` ids.

    One list per address would put a hot address into one task; the part number
    comes from a hash of the id and the address count, so lists stay bounded and
    together are complete.
    """
    ids = found.select("ip", "uid").distinct()
    parts = ids.groupBy("ip").agg(F.ceil(F.count("uid") / chunk).cast("bigint").alias("parts"))
    return (
        ids.join(parts, "ip")
        .groupBy("ip", F.pmod(F.xxhash64("uid"), F.col("parts")).alias("part"))
        .agg(F.sort_array(F.collect_list("uid")).alias("uids"))
    )


def ordered(grouped: DataFrame) -> DataFrame:
    """Newest first, unknown or zero times last, then address text."""
    newest = F.coalesce(F.nullif(F.col("max_seen"), F.lit(0).cast("bigint")), F.lit(-1).cast("bigint"))
    return grouped.orderBy(newest.desc(), F.col("ip").asc())


def requested_names(found: DataFrame) -> DataFrame:
    """Sorted distinct requested names per hit document."""
    return found.select(
        "uid", F.array_sort(F.array_distinct(F.col("fqdn_requested"))).alias("requested")
    )


def search(docs: DataFrame, groups: Iterable[Iterable[Term]], start: int, end: int) -> DataFrame:
    """Full search: matching documents grouped by address, newest first."""
    return ordered(by_ip(hits(docs, groups, start, end)))


def search_text(docs: DataFrame, text: str, now: dt.datetime, start: int | None = None, end: int | None = None) -> DataFrame:
    """Full search of a search text, its ``since:N`` word included."""
    return search(docs, search_terms(text), *resolve_range(start, end, now, since_days(text)))


def search_totals(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """One row: store totals and number of returned addresses."""
    return object_counts(docs).select("*", grouped.agg(F.count("ip")).scalar().alias("returned"))


def object_counts(docs: DataFrame) -> DataFrame:
    return docs.agg(
        F.countDistinct("ip").alias("ip_count"), F.countDistinct("uid").alias("uid_count")
    )


def scoped(docs: DataFrame, scope: DataFrame) -> DataFrame:
    """Documents whose uid is in `scope`."""
    return docs.join(scope.select("uid"), "uid", "left_semi")


@dataclass(frozen=True)
class Page:
    """One page of a windowed search."""

    rows: DataFrame
    info: DataFrame
    window: tuple[int, int]


def search_page(
    docs: DataFrame,
    groups: Iterable[Iterable[Term]],
    bounds: tuple[int, int],
    cursor: int | None = None,
    seen: DataFrame | None = None,
    limit: int = SEARCH_PAGE_LIMIT,
    window_days: int = 1,
) -> Page:
    """Addresses last seen in one window of `window_days` back from `cursor`.

    Addresses in `seen` are skipped.  One address more than `limit` is probed to
    know whether the window is finished; `info` is a one-row frame with the next
    cursor.
    """
    start, end = bounds
    days = max(1, min(int(window_days or 1), SEARCH_MAX_WINDOW_DAYS))
    cursor = end if cursor is None or cursor > end else cursor
    if cursor < start:
        cursor = start - 1
    live = cursor >= start
    low = max(cursor - days * DAY + 1, start) if live else cursor
    scanned = max(1, (cursor - low) // DAY + 1) if live else 0

    found = docs.filter((seen_in(low, cursor) if live else F.lit(False)) & any_of(groups))
    grouped = by_ip(found)
    if seen is not None:
        grouped = grouped.join(seen.select("ip"), "ip", "left_anti")
    probe = ordered(grouped).limit(limit + 1)
    rows = ordered(probe.limit(limit)) if limit else probe.limit(0)
    next_cursor = low - 1 if live else cursor
    info = probe.agg(F.count("ip").alias("probed")).select(
        F.least(F.col("probed"), F.lit(limit)).alias("returned"),
        (F.col("probed") > limit).alias("stopped_in_window"),
        F.when(F.col("probed") > limit, F.lit(cursor)).otherwise(F.lit(next_cursor)).cast("bigint").alias("next_cursor"),
        F.when(F.col("probed") > limit, F.lit(True)).otherwise(F.lit(live and next_cursor >= start)).alias("has_more"),
        F.lit(scanned).cast("bigint").alias("scanned_days"),
        F.lit(days).cast("bigint").alias("window_days"),
    )
    return Page(rows, info, (low, cursor))


@dataclass(frozen=True)
class Cursor:
    """Where a search goes on: the end of the next window, and the place (newest second, address) of the last row shown."""

    at: int
    after: tuple[int, str] | None = None
    shown: int = 0


@dataclass(frozen=True)
class Summary:
    """Hits of a search by address and day back from its end, written once and clustered by the newest hit.

    `table` has rows (ip, day, uid_count, min_seen, max_seen, newest).
    """

    table: DataFrame
    bounds: tuple[int, int]


def summarize(docs: DataFrame, groups: Iterable[Iterable[Term]], bounds: tuple[int, int]) -> Summary:
    """The table that the pages of a search read: one scan of the documents, however many pages follow.

    An address has at most a row a day.  The rows are sorted into ranges of the newest hit, so a page opens only files
    and row groups of its window.
    """
    start, end = bounds
    day = F.floor((F.lit(end) - F.col("last_seen")) / DAY).cast("bigint")
    daily = materialize(by_ip_and(docs.filter(seen_in(start, end) & any_of(groups)), day.alias("day")), "search-days")
    newest = F.max("max_seen").over(Window.partitionBy("ip"))
    placed = daily.withColumn("newest", newest).repartitionByRange("newest", "ip").sortWithinPartitions("newest", "ip")
    return Summary(materialize(placed, "search-summary"), bounds)


def next_page(
    summary: Summary, cursor: Cursor | None = None, limit: int = SEARCH_PAGE_LIMIT, window_days: int = 1
) -> tuple[Page, Cursor | None]:
    """One page, and the cursor of the one after it (None at the end).

    Shows what :func:`search_page` shows with all earlier addresses as `seen`: an address belongs to the window of its
    newest hit and pages go back in time, so all that was shown lies before one place in the order (newest hit first, then
    address).  The page is a range of the summary from there on, and costs the same however many came before.  Its rows
    (at most `limit`) and its `info`, with the number of addresses shown so far, are local tables.
    """
    start, end = summary.bounds
    cursor = cursor or Cursor(end)
    days = max(1, min(int(window_days or 1), SEARCH_MAX_WINDOW_DAYS))
    live = cursor.at >= start
    low = max(cursor.at - days * DAY + 1, start) if live else cursor.at
    scanned = max(1, (cursor.at - low) // DAY + 1) if live else 0
    inside = F.col("newest").between(low, cursor.at) & F.col("day").between((end - cursor.at) // DAY, (end - low) // DAY)
    if cursor.after is not None:
        second, ip = cursor.after
        inside = inside & (F.col("newest") <= second) & ((F.col("newest") < second) | (F.col("ip") > ip))
    grouped = summary.table.filter(inside if live else F.lit(False)).groupBy("ip").agg(
        F.sum("uid_count").alias("uid_count"), F.min("min_seen").alias("min_seen"), F.max("max_seen").alias("max_seen")
    )
    probe = [tuple(r) for r in ordered(grouped).limit(limit + 1).collect()]
    rows, full = probe[:limit], len(probe) > limit
    spark, shown = summary.table.sparkSession, cursor.shown + len(rows)
    at = cursor.at if full or not live else low - 1
    more = full or (live and at >= start)
    info = (len(rows), shown, full, at, more, scanned, days)
    page = Page(
        local_table(spark, rows, "ip string, uid_count bigint, min_seen bigint, max_seen bigint"),
        local_table(
            spark, [info],
            "returned bigint, shown bigint, stopped_in_window boolean, next_cursor bigint, has_more boolean, scanned_days bigint, window_days bigint",
        ),
        (low, cursor.at),
    )
    after = (rows[-1][3], rows[-1][0]) if rows else cursor.after
    return page, (Cursor(at, after, shown) if more else None)


def page_names(docs: DataFrame, groups: Iterable[Iterable[Term]], page: Page) -> DataFrame:
    """Requested names (ip, uid, requested) of the hits on a page."""
    found = docs.filter(seen_in(*page.window) & any_of(groups)).join(page.rows.select("ip"), "ip", "left_semi")
    return found.select("ip", "uid", F.array_sort(F.array_distinct(F.col("fqdn_requested"))).alias("requested"))


def search_pages(
    docs: DataFrame,
    groups: list[list[Term]],
    bounds: tuple[int, int],
    limit: int = SEARCH_PAGE_LIMIT,
) -> Iterator[Page]:
    """Pages of a search, newest first.

    The window doubles while it finds nothing and returns to one day after a
    hit.
    """
    summary = summarize(docs, groups, bounds)
    cursor, days = Cursor(bounds[1]), 1
    while cursor is not None and cursor.at >= bounds[0]:
        shown = cursor.shown
        page, cursor = next_page(summary, cursor, limit, days)
        found = page.info.first()["shown"] > shown
        if found:
            yield page
        days = 1 if found else min(days * 2, SEARCH_MAX_WINDOW_DAYS)


# --------------------------------------------------------------------------
# lookups


def ip_info(docs: DataFrame, ip: str) -> DataFrame:
    """Every document of an address with its interval and the overall range.

    The range is a one-row aggregate joined back, not a window over the whole
    address.
    """
    mine = docs.filter(F.col("ip") == ip).select("ip", "uid", "first_seen", "last_seen")
    total = mine.groupBy("ip").agg(
        F.min("first_seen").alias("min_seen"), F.max("last_seen").alias("max_seen")
    )
    return mine.join(F.broadcast(total), "ip")  # one row by construction


def get_docs(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents by uid; a missing one keeps its row and carries a warning."""
    known = docs.withColumn("_known", F.lit(True))
    return wanted.select("uid").join(known, "uid", "left").select(
        "uid",
        *[c for c in docs.columns if c != "uid"],
        F.when(F.col("_known").isNull(), "document_not_found").alias("warning"),
    )


def token_search(docs: DataFrame, words: list[str], text: str = "body") -> DataFrame:
    """Documents containing every word, ordered by number of word hits.

    A word is a run of letters and digits.  Counting stays inside the row (no
    explode, no shuffle before the sort), and a plain substring test keeps the
    counting away from documents that cannot match.
    """
    wanted = sorted({p for w in words for p in re.findall(r"[^\W_]+", w.lower())})
    if not wanted:
        raise ValueError("no words to search")
    body = F.lower(F.col(text))
    possible = reduce(lambda a, b: a & b, [body.contains(w) for w in wanted])
    edge = r"[\p{L}\p{N}]"
    counts = [F.regexp_count(F.col("_b"), F.lit(rf"(?<!{edge}){w}(?!{edge})")) for w in wanted]
    counted = docs.filter(possible).select("uid", body.alias("_b")).select("uid", F.array(*counts).alias("_n"))
    total = F.aggregate("_n", F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    return (
        counted.filter(F.array_min("_n") > 0).select("uid", total.alias("hits")).orderBy(F.desc("hits"), "uid")
    )


# --------------------------------------------------------------------------
# suggestions


def tag_values(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct stored tags and tags of active rules, with `live` for the stored ones."""
    live = docs.select(F.explode("tag").alias("tag")).distinct().withColumn("live", F.lit(True))
    ruled = (
        rules.filter("active").select(F.explode("tags").alias("tag")).distinct().withColumn("live", F.lit(False))
    )
    return live.unionByName(ruled).groupBy("tag").agg(F.max("live").alias("live"))


def _namespace(tag: Column) -> Column:
    return F.trim(F.substring_index(tag, ":", 1))


def _tag_suffix(tag: Column) -> Column:
    return F.when(tag.contains(":"), F.regexp_replace(tag, "^[^:]*:", "")).otherwise(tag)


def namespace_order(namespace: Column) -> Column:
    """Preferred namespaces first, then alphabetical."""
    position = F.array_position(F.array(*[F.lit(n) for n in PREFERRED_NAMESPACES]), namespace)
    rank = F.when(position == 0, len(PREFERRED_NAMESPACES) + 1).otherwise(position)
    return F.named_struct(F.lit("rank"), rank.cast("int"), F.lit("name"), namespace)


def _tag_order(needle: str, namespace: str = "") -> list[Column]:
    """Closeness of a tag to the typed fragment."""
    tag = F.col("tag")
    suffix = _tag_suffix(tag)
    order = []
    if namespace:
        order.append(F.when(tag.startswith(f"{namespace}:"), 0).otherwise(1))
    if needle:
        order.append(F.when(suffix.startswith(needle), 0).otherwise(1))
        for text in (suffix, tag):
            order.append(F.coalesce(F.nullif(F.locate(needle, text), F.lit(0)), F.lit(9999)))
    return [*order, F.length(tag), tag]


def suggest_tags(tags: DataFrame, fragment: str, limit: int = SUGGESTION_LIMIT) -> DataFrame:
    """Suggestions for a partly typed tag: rows ``(ord, kind, label, value)``."""
    fragment = fragment.strip().lower()
    tag = F.col("tag")
    if ":" in fragment:
        namespace, needle = [p.strip() for p in fragment.split(":", 1)]
        cond = tag.startswith(f"{namespace}:") & F.lit(bool(namespace))
        if needle:
            cond = cond & _tag_suffix(tag).contains(needle)
        found = tags.filter(cond).orderBy(*_tag_order(needle, namespace)).limit(limit)
        parts = [(found, _tag_order(needle, namespace), "tag")]
    else:
        spaces = (
            tags.select(_namespace(tag).alias("tag")).filter(F.col("tag") != "").distinct()
        )
        if fragment:
            spaces = spaces.filter(F.col("tag").startswith(fragment))
        parts = [(spaces.orderBy(namespace_order(tag)).limit(limit), [namespace_order(tag)], "namespace")]
        if fragment:
            found = tags.filter(tag.contains(fragment)).orderBy(*_tag_order(fragment)).limit(limit)
            parts.append((found, _tag_order(fragment), "tag"))
    frames = []
    for part, (frame, order, kind) in enumerate(parts):
        value = F.concat(F.lit("tag:"), tag, F.lit(":" if kind == "namespace" else ""))
        frames.append(
            frame.select(
                F.lit(part).alias("part"),
                F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("o"),
                F.lit(kind).alias("kind"),
                tag.alias("label"),
                value.alias("value"),
            )
        )
    # at most two frames of `limit` rows each: numbering them is constant work
    numbered = [
        f.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("o"))).drop("o") for f in frames
    ]
    merged = reduce(DataFrame.unionByName, numbered)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("part", "n"))
    return merged.select(place.cast("bigint").alias("ord"), "kind", "label", "value").filter(F.col("ord") <= limit)


def suggest_headers(collection: DataFrame, fragment: str, limit: int = SUGGESTION_LIMIT) -> DataFrame:
    """Value-collected header names containing the fragment."""
    fragment = fragment.strip().lower()
    if ":" in fragment:
        return collection.select("header_name").limit(0)
    fragment = re.sub(r"\.(like|begin|lk|bg)$", "", fragment)
    if fragment and (len(fragment) > HEADER_NAME_MAX or not re.fullmatch(HEADER_NAME_RE, fragment)):
        return collection.select("header_name").limit(0)
    return (
        collection.filter(F.col("collect_value") & F.col("header_name").contains(fragment))
        .select("header_name", F.concat(F.lit("http_headval:"), "header_name", F.lit(":")).alias("value"))
        .orderBy("header_name")
        .limit(limit)
    )


# --------------------------------------------------------------------------
# timeline and names


def ip_timeline(docs: DataFrame, bodies: DataFrame, ip: str) -> DataFrame:
    """Observations of an address, per protocol and port, oldest first.

    One row per observation; documents without a body or without ports keep a
    row with `warning`.  The order is a distributed sort, so an address of any
    size works.
    """
    mine = docs.filter(F.col("ip") == ip).select("uid", "first_seen", "last_seen", "tag")
    # the address filter is repeated on the bodies so both scans prune
    body = bodies.filter(F.col("ip") == ip).select(F.col("id").alias("uid"), "body")
    joined = mine.join(body, "uid", "left")
    ports = F.filter(F.coalesce(F.col("body.ports"), F.array()), lambda p: p.isNotNull())
    names = F.coalesce(F.col("body.hostnames"), F.array())
    rows = joined.select(
        "uid", "first_seen", "last_seen",
        F.array_sort(F.array_distinct(F.col("tag"))).alias("tags"),
        F.when(F.col("body").isNull(), "document_not_found")
        .when(F.size(ports) == 0, "no_port_details").alias("warning"),
        F.col("body.starttime").alias("starttime"), F.col("body.endtime").alias("endtime"),
        ptr_names(names).alias("ptr_records"), resolved_names(names).alias("resolved_hosts"),
        user_names(names).alias("user_hostnames"),
        F.explode_outer(ports).alias("port"),
    )
    protocol = F.when(F.col("port").isNotNull(), F.lower(F.coalesce(F.col("port.protocol"), F.lit("unknown"))))
    portid = F.when(F.col("port").isNotNull(), F.coalesce(F.col("port.portid"), F.lit("?")))
    stamp = F.coalesce(F.nullif("last_seen", F.lit(0).cast("bigint")), "first_seen", F.lit(0).cast("bigint"))
    return rows.select(
        protocol.alias("protocol"), portid.alias("portid"), F.col("port.service.name").alias("service"),
        "uid", short_date("first_seen").alias("first_seen"), short_date("last_seen").alias("last_seen"),
        stamp.alias("timestamp_sort"),
        short_date(epoch("starttime")).alias("scan_start"), short_date(epoch("endtime")).alias("scan_end"),
        "ptr_records", "resolved_hosts", "user_hostnames", "tags", "warning",
    ).orderBy(
        F.col("protocol").asc_nulls_last(), port_order("portid"), "timestamp_sort", "uid"
    )


def ip_ports(timeline: DataFrame) -> DataFrame:
    """Per protocol and port: number of observations and service names.

    Service names are made distinct first, so the list holds names of services
    only, never one entry per observation.
    """
    mapped = timeline.filter(F.col("protocol").isNotNull())
    counts = mapped.groupBy("protocol", "portid").agg(F.count("uid").alias("observation_count"))
    services = (
        mapped.filter(F.coalesce("service", F.lit("")) != "")
        .select("protocol", "portid", "service").distinct()
        .groupBy("protocol", "portid")
        .agg(F.array_sort(F.collect_list("service")).alias("service_names"))
    )
    return (
        counts.join(services, ["protocol", "portid"], "left")
        .withColumn("service_names", F.coalesce("service_names", F.array()))
        .orderBy("protocol", port_order("portid"))
    )


def _entry_name(h: Column) -> Column:
    own = F.trim(F.coalesce(F.nullif(h["name"], F.lit("")), h["hostname"], F.lit("")))
    return own


def ptr_names(hostnames: Column) -> Column:
    """Distinct PTR names in original order."""
    mine = F.filter(hostnames, lambda h: (F.upper(F.coalesce(h["type"], F.lit(""))) == "PTR") & (_entry_name(h) != ""))
    return F.array_distinct(F.transform(mine, _entry_name))


def resolved_names(hostnames: Column) -> Column:
    """Distinct names that are not PTR records, in original order."""
    mine = F.filter(hostnames, lambda h: (F.upper(F.coalesce(h["type"], F.lit(""))) != "PTR") & (_entry_name(h) != ""))
    return F.array_distinct(F.transform(mine, _entry_name))


def user_names(hostnames: Column) -> Column:
    """Sorted distinct names the scan was asked for."""
    mine = F.filter(hostnames, lambda h: F.lower(F.coalesce(h["type"], F.lit(""))) == "user")
    names = F.filter(F.transform(mine, lambda h: F.trim(F.coalesce(h["name"], F.lit("")))), lambda n: n != "")
    return F.array_sort(F.array_distinct(names))


def recent_fqdns(docs: DataFrame, hours: int, now: int) -> DataFrame:
    """Sorted distinct names of recently seen documents, address literals out."""
    return (
        docs.filter(F.col("last_seen") >= now - hours * 3600)
        .select(F.explode("fqdn").alias("fqdn"))
        .filter(F.col("fqdn") != "")
        .distinct()
        .filter(~F.coalesce(F.length(address_key("fqdn")) == 8, F.lit(False)))
        .orderBy("fqdn")
    )


def learn_fqdns(names: DataFrame, patterns: list[str], resolutions: DataFrame) -> DataFrame:
    """Names matching any pattern (case-blind), flagged with `resolved`.

    `resolutions` has ``fqdn`` and ``addresses``; learned names are the resolved
    ones.
    """
    usable = [p.strip() for p in patterns if p.strip()]
    if not usable:
        return names.limit(0).withColumn("resolved", F.lit(False))
    cond = reduce(lambda a, b: a | b, [F.col("fqdn").rlike(f"(?i){p}") for p in usable])
    matched = names.filter(cond)
    known = resolutions.filter(F.size("addresses") > 0).select("fqdn").distinct().withColumn("_ok", F.lit(True))
    return matched.join(known, "fqdn", "left").select("fqdn", F.col("_ok").isNotNull().alias("resolved"))


def learn_counts(names: DataFrame, learned: DataFrame) -> DataFrame:
    return learned.agg(
        F.count("fqdn").alias("matched"), F.count_if(F.col("resolved")).alias("resolved")
    ).select(names.agg(F.count("fqdn")).scalar().alias("found"), "matched", "resolved")


