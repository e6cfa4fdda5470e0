"""Set algebra on addresses, networks and ranges; target import and work items.

Networks are ``(lo, hi, prefix)`` with hexadecimal keys (see `netaddr`); the key
length tells the version, so IPv4 and IPv6 share every operator.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from vantage.functions import netaddr as N
from vantage.operators.scale import running
from vantage.schema import CHUNK_ADDRESSES

# Texts of the AS lookup and the default description.
NOT_AN_ADDRESS = "Network info unavailable for non-IP targets"
NO_ANSWER = "resolutions backend unreachable"
DEFAULT_DESCRIPTION = "WHOIS range import"


def with_network(df: DataFrame, value: str = "value") -> DataFrame:
    """Add `version`, `prefix`, `lo`, `hi` of a target text (null if no network).

    A table that stores these columns already is taken as it is.
    """
    if {"version", "prefix", "lo", "hi"} <= set(df.columns):
        return df
    return df.withColumn("_n", N.network(value)).select("*", "_n.*").drop("_n")


# --------------------------------------------------------------------------
# containment


def ancestors(left: DataFrame, right: DataFrame, keep: list[str]) -> DataFrame:
    """Pairs (left network, right network containing it), as an equi-join.

    A left network can only be inside a right one whose prefix length occurs on
    the right side.  Those lengths are at most 33 + 129 rows, so they are
    broadcast; each left network is cut to every such length and looked up by
    key.  No range join and no nested loop.
    """
    lengths = right.select(F.length("lo").alias("_digits"), F.col("prefix").alias("_len")).distinct()
    probes = left.join(
        F.broadcast(lengths), (F.length("lo") == F.col("_digits")) & (F.col("_len") <= F.col("prefix"))
    ).withColumn("_anc", N.mask_key("lo", F.col("_len"), 0))
    wide = right.select(
        F.col("lo").alias("_anc"), F.col("prefix").alias("_len"), *[F.col(c).alias(f"r_{c}") for c in keep]
    )
    return probes.join(wide, ["_anc", "_len"])


def covering(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """Candidates ``(id, value)`` with the widest existing target containing them.

    A target never covers itself (same id), but an equal network does.
    `covered_by` is null for uncovered candidates.
    """
    wide = with_network(targets).filter("prefix IS NOT NULL")
    mine = with_network(candidates)
    pairs = ancestors(mine.filter("prefix IS NOT NULL"), wide, ["id", "value", "prefix"])
    pairs = pairs.filter(F.col("id").isNull() | (F.col("id") != F.col("r_id")))
    best = pairs.groupBy("id", "value").agg(
        F.min_by("r_value", F.struct("r_prefix", "r_id")).alias("covered_by")
    ).select(F.col("id").alias("_i"), F.col("value").alias("_v"), "covered_by")
    return mine.join(
        best, mine["id"].eqNullSafe(best["_i"]) & (mine["value"] == best["_v"]), "left"
    ).select(*[mine[c] for c in candidates.columns], "covered_by")


def import_targets(existing: DataFrame, entries: DataFrame) -> DataFrame:
    """Outcome of importing entries ``(ord, value)`` into targets ``(value)``.

    status: processed, duplicate (name already known), covered (inside a known
    or earlier network), invalid.  Coverage is transitive, so "an earlier valid
    entry contains it" decides without processing the entries one by one.
    """
    raw = entries.select(
        "ord", F.regexp_replace("value", "^[\\n\\r ,;'\"]+|[\\n\\r ,;'\"]+$", "").alias("entry")
    ).filter(F.col("entry") != "")
    typed = raw.select("*", N.target("entry").alias("_t")).select("ord", "entry", "_t.*")
    place = ["version", "prefix", "lo", "hi"]
    stored = with_network(existing).select(F.lit(-1).cast("bigint").alias("ord"), "value", *place)
    known = stored.unionByName(typed.filter(F.col("kind") != "invalid").select("ord", "value", *place))
    # earliest appearance of every value; existing targets come first
    earliest = known.groupBy("value").agg(
        F.min("ord").alias("ord"), *[F.first(c, ignorenulls=True).alias(c) for c in place]
    )
    cover = (
        ancestors(typed.filter(F.col("lo").isNotNull()), earliest.filter(F.col("lo").isNotNull()), ["ord", "value", "prefix"])
        .filter(F.col("r_ord") < F.col("ord"))
        .groupBy("ord").agg(F.min_by("r_value", F.struct("r_prefix", "r_ord")).alias("covered_by"))
    )
    names = earliest.select(F.col("value"), F.col("ord").alias("_first"))
    status = (
        F.when(F.col("kind") == "invalid", "invalid")
        .when(F.col("covered_by").isNotNull(), "covered")
        .when((F.col("kind") == "fqdn") & (F.col("_first") < F.col("ord")), "duplicate")
        .otherwise("processed")
    )
    text = (
        F.when(status == "invalid", F.concat("entry", F.lit(" Invalid IP/CIDR/FQDN or private IP")))
        .when(status == "covered", F.concat("entry", F.lit(" Not Processed, Target already covered by "), "covered_by"))
        .when(status == "duplicate", F.concat("entry", F.lit(" Not Processed, Target already in the database")))
        .when(F.col("kind") == "fqdn", F.concat("entry", F.lit(" FQDN Processed")))
        .otherwise(F.concat("entry", F.lit(" Processed")))
    )
    return (
        typed.join(cover, "ord", "left").join(names, "value", "left")
        .select("ord", "entry", "kind", "value", status.alias("status"), "covered_by", text.alias("log"))
    )


def reduce_ranges(networks: DataFrame) -> DataFrame:
    """Keep only networks not inside another network of the set.

    In address order a network is covered exactly when an earlier one ends at
    or after its end.  Equal networks keep one description.
    """
    unique = networks.groupBy("lo", "hi", "prefix").agg(F.min("description").alias("description"))
    unique = unique.withColumn("version", N.key_version("lo"))
    seen = running(unique, [F.col("lo"), F.col("prefix")], {"before": ("max", F.col("hi"))}, ["version"])
    return seen.filter(F.col("before").isNull() | (F.col("before") < F.col("hi"))).drop("before")


# --------------------------------------------------------------------------
# ranges and CIDR lists


_BLOCKS = ArrayType(StructType([StructField("lo", StringType()), StructField("prefix", IntegerType())]))


@F.pandas_udf(_BLOCKS)
def _range_blocks_v6(lo: pd.Series, hi: pd.Series) -> pd.Series:
    """Minimal cover of IPv6 ranges; 128-bit numbers do not exist in Spark."""
    import ipaddress

    def one(first: str, last: str):
        if first is None or last is None:
            return None
        blocks = ipaddress.summarize_address_range(
            ipaddress.IPv6Address(int(first, 16)), ipaddress.IPv6Address(int(last, 16))
        )
        return [{"lo": format(int(b[0]), "032x"), "prefix": b.prefixlen} for b in blocks]

    return pd.Series([one(a, b) for a, b in zip(lo, hi)])


def range_to_cidrs(ranges: DataFrame) -> DataFrame:
    """Ranges ``(lo, hi)`` (keys) to their smallest CIDR list, one row per CIDR.

    IPv4 is native; IPv6 rows take an Arrow function.  Reversed or mixed ranges
    give nothing.
    """
    rest = [c for c in ranges.columns if c not in ("lo", "hi", "prefix")]
    good = ranges.filter((F.length("lo") == F.length("hi")) & (F.col("lo") <= F.col("hi")))
    v4 = (
        good.filter(F.length("lo") == 8)
        .select(*rest, F.explode(N.range_blocks_v4(N.key_num("lo"), N.key_num("hi"))).alias("b"))
        .select(*rest, N.v4_key("b.start").alias("lo"), F.col("b.prefix").alias("prefix"))
    )
    v6 = (
        good.filter(F.length("lo") == 32)
        .select(*rest, F.explode(_range_blocks_v6("lo", "hi")).alias("b"))
        .select(*rest, "b.lo", "b.prefix")
    )
    both = v4.unionByName(v6)
    return both.select("*", N.network_text("lo", "prefix").alias("cidr"))


def count_to_cidrs(rows: DataFrame) -> DataFrame:
    """IPv4 start address and count to CIDRs."""
    last = N.ipv4_num("start") + F.col("count").try_cast("bigint") - 1
    rest = [c for c in rows.columns if c not in ("start", "count")]
    return range_to_cidrs(
        rows.select(*rest, N.address_key("start").alias("lo"), F.when(last < 2**32, N.v4_key(last)).alias("hi"))
    )


def range_text_bounds(text: Column) -> tuple[Column, Column]:
    """Keys of a ``start - end`` range text."""
    sides = F.split(text, "-", 2)
    return N.address_key(F.trim(F.get(sides, 0))), N.address_key(F.trim(F.get(sides, 1)))


def match_registry(records: DataFrame, countries: list[str], words: list[str]) -> DataFrame:
    """Registry records (`lines`) selected by country or word, as ranges.

    A record matches if any country line is in the list or any line contains a
    word; the first inetnum and netname are used.
    """
    wanted = sorted({c.strip().upper() for c in countries if c.strip()})
    needles = sorted({w.strip().lower() for w in words if w.strip()})
    lines = F.col("lines")

    def values(name: str) -> Column:
        mine = F.filter(lines, lambda x: F.lower(x).startswith(name + ":"))
        return F.transform(mine, lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", "")))

    in_country = F.exists(values("country"), lambda c: F.upper(c).isin(wanted) if wanted else F.lit(False))
    has_word = F.exists(lines, lambda x: _any_contains(F.lower(x), needles))
    lo, hi = range_text_bounds(F.get(values("inetnum"), 0))
    return (
        records.filter(in_country | has_word)
        .select(
            lo.alias("lo"), hi.alias("hi"),
            F.coalesce(F.get(values("netname"), 0), F.lit(DEFAULT_DESCRIPTION)).alias("description"),
        )
        .filter(F.col("lo").isNotNull() & F.col("hi").isNotNull())
    )


def _any_contains(text: Column, needles: list[str]) -> Column:
    cond = F.lit(False)
    for n in needles:
        cond = cond | text.contains(n)
    return cond


def match_delegated(rows: DataFrame, registry: str, countries: list[str], words: list[str]) -> DataFrame:
    """Delegated IPv4 rows of one registry by country or word, as CIDRs."""
    wanted = sorted({c.strip().upper() for c in countries if c.strip()})
    needles = sorted({w.strip().lower() for w in words if w.strip()})
    line = F.lower(F.concat_ws("|", *rows.columns))
    mine = rows.filter(
        (F.col("registry") == registry) & (F.col("type") == "ipv4")
        & ((F.upper("country").isin(wanted) if wanted else F.lit(False)) | _any_contains(line, needles))
    )
    return count_to_cidrs(
        mine.select("start", F.col("value").alias("count"), F.lit(DEFAULT_DESCRIPTION).alias("description"))
    )


def exact_total(exponent: Column, count: Column) -> Column:
    """Sum of ``count * 2^exponent`` as decimal text, exact for any prefix of both versions; null without rows.

    Powers are carried in two decimal halves, so that no product or sum leaves 38 digits.
    """
    half = 10**19
    powers = [divmod(2**e, half) for e in range(129)]

    def part(i: int) -> Column:
        digits = F.array(*[F.lit(str(p[i])).cast("decimal(20,0)") for p in powers])
        return F.sum((F.get(digits, exponent.cast("int")) * count.cast("decimal(17,0)")).cast("decimal(38,0)"))

    def text(t: Column) -> Column:
        high, low = t["high"], t["low"]
        carry = F.floor(low / F.lit(str(half)).cast("decimal(20,0)")).cast("decimal(38,0)")
        carry = F.when(carry * F.lit(str(half)).cast("decimal(20,0)") > low, carry - 1).otherwise(carry)  # a quotient may be rounded up
        return N.let(
            F.named_struct(
                F.lit("high"), (high + carry).cast("decimal(38,0)"),
                F.lit("low"), (low - carry * F.lit(str(half)).cast("decimal(20,0)")).cast("decimal(38,0)"),
            ),
            lambda n: F.when(n["high"] == 0, n["low"].cast("string")).otherwise(
                F.concat(n["high"].cast("string"), F.lpad(n["low"].cast("string"), 19, "0"))
            ),
        )

    return N.let(F.named_struct(F.lit("high"), part(0), F.lit("low"), part(1)), text)


def count_ips(networks: DataFrame) -> DataFrame:
    """Number of addresses: `ips_text` always exact, `ips` exact or null past 38 digits, `ips_double` rounded."""
    sizes = networks.groupBy((F.length("lo") * 4 - F.col("prefix")).alias("exponent")).agg(F.count(F.lit(1)).alias("n"))
    totals = sizes.agg(
        exact_total(F.col("exponent"), F.col("n")).alias("ips_text"),
        F.sum(F.pow(F.lit(2.0), F.col("exponent")) * F.col("n")).alias("ips_double"),
    )
    return totals.select(F.col("ips_text").try_cast("decimal(38,0)").alias("ips"), "ips_double", "ips_text")


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Union of ranges ``(lo, hi)``: disjoint, non-adjacent ranges in order.

    Gaps and islands over the address order, with two-level running maxima
    instead of one global window.
    """
    spans = ranges.groupBy("lo").agg(F.max("hi").alias("hi")).withColumn("version", N.key_version("lo"))
    order = [F.col("lo")]
    seen = running(spans, order, {"before": ("max", F.col("hi"))}, ["version"])
    starts = F.col("before").isNull() | (F.coalesce(N.next_key("before"), F.lit("~")) < F.col("lo"))
    seen = seen.withColumn("_start", F.when(starts, F.col("lo"))).drop("before")
    named = running(seen, order, {"_prev": ("max", F.col("_start"))}, ["version"])
    return (
        named.groupBy(F.coalesce("_start", "_prev").alias("lo"), "version")
        .agg(F.max("hi").alias("hi")).select("version", "lo", "hi")
    )


def merge_cidrs(ranges: DataFrame) -> DataFrame:
    """Minimal CIDR cover of a set of addresses, networks or ranges."""
    return range_to_cidrs(merge_ranges(ranges))


def network_blocks(networks: DataFrame, size: int = CHUNK_ADDRESSES) -> DataFrame:
    """Networks with `blocks`, the number of blocks of `size` addresses in each; exact for every prefix of both versions."""
    width = F.length("lo") * 4 - F.col("prefix") - (size.bit_length() - 1)
    powers = F.array(*[F.lit(str(2**e)).cast("decimal(38,0)") for e in range(128 - size.bit_length() + 2)])
    return networks.withColumn("blocks", F.get(powers, F.greatest(width, F.lit(0)).cast("int")))


def split_networks(networks: DataFrame, start: int = 0, count: int | None = None) -> DataFrame:
    """Networks above 256 addresses as blocks of 256, smaller ones as they are.

    `start` and `count` choose a slice of each network's blocks (see :func:`network_blocks`), the way to walk through
    a network with more blocks than one job should list; without `count` all blocks from `start` on are listed, and a
    list of more than 2^63-1 of them is an error.  Block numbers are spread digit by digit, so no array is longer than
    65,536 entries whatever the width.
    """
    bits, digits = 8, 15  # two hexadecimal digits inside a block; 15 digits are 60 bits of a block number
    rest = [c for c in networks.columns if c not in ("lo", "hi", "prefix")]
    sized = network_blocks(networks)
    small = sized.filter(F.length("lo") * 4 - F.col("prefix") <= bits)
    listed = sized.filter(F.length("lo") * 4 - F.col("prefix") > bits)
    zero = F.lit("0").cast("decimal(38,0)")
    left = F.greatest(F.col("blocks") - F.lit(str(start)).cast("decimal(38,0)"), zero)
    if count is not None:
        left = F.least(left, F.lit(str(count)).cast("decimal(38,0)"))
    rows = listed.withColumn("_n", left.cast("bigint")).filter("_n > 0").withColumn("_i", F.lit(0).cast("bigint"))
    for shift in (48, 32, 16, 0):
        steps = F.shiftright(F.col("_n") - 1 - F.col("_i"), shift)
        step = F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(steps, F.lit(65_535).cast("bigint"))))
        rows = rows.withColumn("_d", step).withColumn("_i", F.col("_i") + F.shiftleft("_d", shift))
    number = F.lpad(F.substr(F.col("lo"), F.lit(1), F.length("lo") - 2), 2 * digits, "0")
    start_high, start_low = divmod(start, 1 << 4 * digits)
    low = F.conv(F.substring(number, digits + 1, digits), 16, 10).cast("bigint") + F.lit(start_low).cast("bigint")
    # a block number and a step both stay below 2^60 and 2^63; the carry is taken from each before they meet
    mask = F.lit((1 << 4 * digits) - 1).cast("bigint")
    both = low.bitwiseAND(mask) + F.col("_i").bitwiseAND(mask)
    carry = F.shiftright(low, 4 * digits) + F.shiftright("_i", 4 * digits) + F.shiftright(both, 4 * digits)
    high = F.conv(F.substring(number, 1, digits), 16, 10).cast("bigint") + F.lit(start_high).cast("bigint") + carry
    text = F.concat(*[F.lpad(F.lower(F.hex(v)), digits, "0") for v in (high, both.bitwiseAND(mask))])
    block = F.substring(text, 1, 2 * digits)
    block = F.substr(block, F.lit(2 * digits + 1) - (F.length("lo") - 2), F.length("lo") - 2)
    blocks = rows.select(
        *rest, F.concat(block, F.lit("00")).alias("lo"), F.concat(block, F.lit("ff")).alias("hi"),
        (F.length("lo") * 4 - bits).cast("int").alias("prefix"),
    )
    columns = [*rest, "lo", "hi", "prefix"]
    return blocks.select(*columns).unionByName(small.filter(F.lit(start == 0 and count != 0)).select(*columns))


def pack_ranges(ranges: DataFrame, size: int = CHUNK_ADDRESSES) -> DataFrame:
    """Small networks packed in address order, `size` addresses per work item.

    A network has at most 256 addresses, so it lies in one block of the last two
    hexadecimal digits; merged CIDRs of an item do too.  One row per item with
    its CIDR list and source ids; lists hold at most `size` entries.
    """
    count = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length("lo") * 4 - F.col("prefix"))
    sized = ranges.select("id", "lo", "hi", "prefix", count.alias("n"))
    order = [F.length("lo"), F.col("lo"), F.col("id")]
    placed = running(sized, order, {"offset": ("sum", F.col("n"))})
    first = F.floor(F.col("offset") / size)
    last = F.floor((F.col("offset") + F.col("n") - 1) / size)
    pieces = placed.withColumn("item", F.explode(F.sequence(first, last)))
    base = F.substr(F.col("lo"), F.lit(1), F.length("lo") - 2)
    byte = F.conv(F.substring("lo", -2, 2), 16, 10).cast("bigint")
    begin = F.greatest(F.col("item") * size - F.col("offset"), F.lit(0).cast("bigint"))
    end = F.least((F.col("item") + 1) * size - F.col("offset"), F.col("n")) - 1
    pieces = pieces.select(
        "item", "id", base.alias("base"), (byte + begin).alias("b0"), (byte + end).alias("b1")
    )
    ids = pieces.groupBy("item").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    # at most `size` pieces per item and block
    spans = pieces.groupBy("item", "base").agg(
        F.array_sort(F.collect_set(F.struct("b0", "b1"))).alias("spans")
    )
    cidrs = spans.withColumn("b", F.explode(_merge_spans(F.col("spans")))).select(
        "item", "base", F.explode(N.range_blocks_v4("b.b0", "b.b1")).alias("c")
    )
    key = F.concat("base", F.lpad(F.lower(F.hex("c.start")), 2, "0"))
    prefix = F.length(key) * 4 - (32 - F.col("c.prefix"))
    cidrs = cidrs.select("item", F.named_struct(F.lit("l"), F.length(key), F.lit("k"), key, F.lit("p"), prefix.cast("int")).alias("c"))
    lists = cidrs.groupBy("item").agg(F.array_sort(F.collect_list("c")).alias("c")).select(
        "item", F.transform("c", lambda c: N.network_text(c["k"], c["p"])).alias("cidrs")
    )
    return lists.join(ids, "item").select("item", "cidrs", "ids")


def _merge_spans(spans: Column) -> Column:
    """Sorted spans of small integers to disjoint, non-adjacent spans."""
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<b0: BIGINT, b1: BIGINT>>)")

    def add(acc: Column, s: Column) -> Column:
        top = F.element_at(acc, -1)
        joined = F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1),
            F.array(F.named_struct(F.lit("b0"), top["b0"], F.lit("b1"), F.greatest(top["b1"], s["b1"]))),
        )
        return F.when((F.size(acc) > 0) & (s["b0"] <= top["b1"] + 1), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, empty, add)


def pack_names(names: DataFrame, order: list[Column], size: int = CHUNK_ADDRESSES) -> DataFrame:
    """Names in due order, `size` per work item: rows ``(item, names, ids)``."""
    placed = running(names, order, {"_before": ("sum", F.lit(1).cast("bigint"))})
    entry = F.named_struct(F.lit("p"), (F.col("_before") % size), F.lit("v"), F.col("value"), F.lit("i"), F.col("id"))
    items = placed.groupBy(F.floor(F.col("_before") / size).alias("item")).agg(
        F.array_sort(F.collect_list(entry)).alias("e")  # at most `size` entries
    )
    return items.select("item", F.col("e.v").alias("names"), F.col("e.i").alias("ids"))


def classify_due(targets: DataFrame, size: int = CHUNK_ADDRESSES) -> DataFrame:
    """Due targets as `name`, `large` (network above `size`) or `small`."""
    net = with_network(targets)
    wide = F.length("lo") * 4 - F.col("prefix") > size.bit_length() - 1
    return net.withColumn("class", F.when(N.is_fqdn("value"), "name").when(wide, "large").when(F.col("lo").isNotNull(), "small"))


def target_stats(targets: DataFrame) -> DataFrame:
    """One row: networks, names, addresses in networks and total hosts.

    The `..._text` columns are exact always, the decimals exact or null past 38 digits.
    """
    typed = targets.select(N.target(F.trim("value")).alias("t")).groupBy(
        F.col("t.kind").alias("kind"), F.when(F.col("t.kind") == "network", N.key_bits("t.lo") - F.col("t.prefix")).otherwise(0).alias("exponent")
    ).agg(F.count(F.lit(1)).alias("n"))
    network, valid = F.col("kind") == "network", F.col("kind") != "invalid"

    def total(which: Column) -> Column:
        return F.coalesce(exact_total(F.col("exponent"), F.when(which, F.col("n"))), F.lit("0"))

    counted = typed.agg(
        F.coalesce(F.sum(F.when(network, F.col("n"))), F.lit(0)).alias("cidr_count"),
        F.coalesce(F.sum(F.when(F.col("kind") == "fqdn", F.col("n"))), F.lit(0)).alias("fqdn_count"),
        total(network).alias("cidr_host_count_text"),
        total(valid).alias("total_hosts_to_scan_text"),
    )
    exact = [F.col(f"{c}_text").try_cast("decimal(38,0)").alias(c) for c in ("cidr_host_count", "total_hosts_to_scan")]
    return counted.select("cidr_count", "fqdn_count", *exact, "cidr_host_count_text", "total_hosts_to_scan_text")


def asn_lookup(targets: DataFrame, prefixes: DataFrame, as_names: DataFrame) -> DataFrame:
    """AS text of every target value: most specific route of its first address."""
    mine = with_network(targets.select("value").distinct())
    routes = with_network(prefixes.select(F.col("prefix").alias("route"), "asn"), "route").filter("lo IS NOT NULL")
    # a route may be announced by several sources: keep one AS per network
    routes = routes.groupBy("lo", "prefix").agg(F.min("asn").alias("asn"))
    point = mine.filter("lo IS NOT NULL").select("value", "lo", (F.length("lo") * 4).cast("int").alias("prefix"))
    best = (
        ancestors(point, routes, ["asn", "prefix"])
        .groupBy("value").agg(F.max_by("r_asn", "r_prefix").alias("asn"))
    )
    named = best.join(as_names.select("asn", F.col("description").alias("_d")), "asn", "left")
    text = (
        F.when(F.col("lo").isNull(), NOT_AN_ADDRESS)
        .when(F.col("asn").isNull() | F.col("_d").isNull(), NO_ANSWER)
        .otherwise(F.concat("asn", F.lit(", "), "_d"))
    )
    return mine.join(named, "value", "left").select("value", "asn", text.alias("text"))


def backfill_units(targets: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recompute the unit counters of targets (`value`) and jobs (`job` list)."""
    return (
        targets.withColumn("scan_unit_count", N.unit_count("value")),
        jobs.withColumn("scan_unit_count", N.unit_count_list("job")),
    )

