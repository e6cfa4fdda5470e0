"""Shaping of raw scan results into one document per address, port and content.

Scripts stay VARIANT values.  A shaped script is
``struct(id, output, payload)``: the identifier, the text output after the
cleaning rules, and the untouched probe payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.functions.netaddr import col
from vantage.functions.times import epoch, seen_range
from vantage.schema import PORT

# Name space of document ids, legacy icon output, script names.
UUID_DNS = "6ba7b8109dad11d180b400c04fd430c8"
UNKNOWN_ICON_RE = r"(?i)\bUnknown\s+favicon\s+MD5\s*:\s*([0-9a-f]{32})\b"
ICON_SCRIPT = "http-mm-sha-favicon"
BANNER_SCRIPT = "banner"


def doc_id(ip: Column | str, port: Column | str, content: Column | str) -> Column:
    """uuid5 (DNS name space) of ``ip:port:hash``; null if a part is empty."""
    parts = [F.nullif(F.trim(col(c).cast("string")), F.lit("")) for c in (ip, port, content)]
    name = F.concat(parts[0], F.lit(":"), parts[1], F.lit(":"), parts[2])
    digest = F.sha1(F.concat(F.unhex(F.lit(UUID_DNS)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"), variant,
        F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def script(raw: Column) -> Column:
    """VARIANT script to ``struct(id, output, payload)``."""
    return F.named_struct(
        F.lit("id"), F.try_variant_get(raw, "$.id", "string"),
        F.lit("output"), F.try_variant_get(raw, "$.output", "string"),
        F.lit("payload"), raw,
    )


def shape_scripts(scripts: Column) -> Column:
    """Scripts of one port as structs; non-object entries are dropped."""
    raw = F.filter(
        F.coalesce(scripts, F.array().cast("array<variant>")),
        lambda s: F.schema_of_variant(s).startswith("OBJECT"),
    )
    return F.transform(raw, script)


def clean_banner(scripts: Column) -> Column:
    """Remove line feeds inside banner outputs."""
    return F.transform(
        scripts,
        lambda s: F.named_struct(
            F.lit("id"), s["id"],
            F.lit("output"), F.when(s["id"] == BANNER_SCRIPT, F.replace(s["output"], F.lit("\n"), F.lit("")))
            .otherwise(s["output"]),
            F.lit("payload"), s["payload"],
        ),
    )


def normalize_favicon(scripts: Column) -> Column:
    """Legacy unknown-icon output becomes the icon script with its md5."""

    def rewrite(s: Column) -> Column:
        md5 = F.lower(F.regexp_extract(F.coalesce(s["output"], F.lit("")), UNKNOWN_ICON_RE, 1))
        legacy = md5 != ""
        return F.named_struct(
            F.lit("id"), F.when(legacy, F.lit(ICON_SCRIPT)).otherwise(s["id"]),
            F.lit("output"), F.when(legacy, F.concat(F.lit("\n favicon_md5: "), md5)).otherwise(s["output"]),
            F.lit("payload"), s["payload"],
        )

    return F.transform(scripts, rewrite)


def content_hash(port: Column) -> Column:
    """sha256 over the canonical JSON of one shaped port.

    Scripts are ordered by id and output, payload keys are sorted (VARIANT
    objects keep them so), and the old hash field takes no part.  The id and
    output inside the payload are the uncleaned ones and are left out.
    """

    def plain(s: Column) -> Column:
        keys = F.try_variant_get(s["payload"], "$", "map<string,variant>")
        rest = F.map_filter(keys, lambda k, _: ~k.isin("id", "output"))
        return F.named_struct(F.lit("id"), s["id"], F.lit("output"), s["output"], F.lit("payload"), F.to_json(rest))

    scripts = F.transform(port["scripts"], plain)
    canonical = F.named_struct(
        F.lit("portid"), port["portid"], F.lit("protocol"), port["protocol"],
        F.lit("service"), port["service"], F.lit("scripts"), F.array_sort(scripts),
    )
    return F.sha2(F.to_json(canonical), 256)


def shape_port(port: Column) -> Column:
    """Cleaned port without the helper hash."""
    return F.named_struct(
        F.lit("portid"), port["portid"], F.lit("protocol"), port["protocol"], F.lit("service"), port["service"],
        F.lit("scripts"), normalize_favicon(clean_banner(shape_scripts(port["scripts"]))),
    )


def strip_port_hash(ports: Column) -> Column:
    """Drop the inner hash of every port."""
    return F.transform(ports, lambda p: p.dropFields("hsh256"))


def split_ports(scans: DataFrame) -> DataFrame:
    """One document ``(id, ip, body)`` per port of a scan.

    The body is the scan with `ports` cut to the one port and the content hash
    added.  Scans without address or ports and ports without an id give nothing.
    """
    ports = F.filter(F.coalesce("ports", F.array().cast(f"array<{PORT}>")), lambda p: p.isNotNull())
    # an id needs an address and a port; asked of these, the hashes are made only where ids are wanted
    rows = scans.filter(F.trim("addr") != "").withColumn("_raw", F.explode(ports)).filter(F.trim("_raw.portid") != "")
    rest = [c for c in scans.columns if c != "ports"]
    shaped = rows.select(*rest, shape_port(F.col("_raw")).alias("_port"))
    hashed = shaped.select("*", content_hash(F.col("_port")).alias("_hash"))
    body = F.struct(*rest, F.array("_port").alias("ports"), F.col("_hash").alias("hsh256"))
    return hashed.select(
        doc_id("addr", "_port.portid", "_hash").alias("id"), F.col("addr").alias("ip"), body.alias("body")
    )


def observed(docs_raw: DataFrame) -> DataFrame:
    """Add the seen interval of a port document (its scan end time)."""
    end = epoch(F.col("body.endtime"))
    return docs_raw.select("id", "ip", "body", end.alias("first_seen"), end.alias("last_seen"))


def dedup_docs(docs: DataFrame) -> DataFrame:
    """One row per id: latest body, earliest first_seen, latest last_seen."""
    first, last = seen_range(F.col("first_seen"), F.col("last_seen"))
    tidy = docs.withColumn("_f", first).withColumn("_l", last)
    return (
        tidy.groupBy("id")
        .agg(
            F.max_by(F.struct("ip", "body"), F.coalesce("_l", F.lit(-1).cast("bigint"))).alias("_d"),
            F.min("_f").alias("first_seen"),
            F.max("_l").alias("last_seen"),
        )
        .select("id", "_d.ip", "_d.body", "first_seen", "last_seen")
    )
