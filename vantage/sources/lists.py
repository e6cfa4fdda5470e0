"""Text sources: registry files, target lists, passive DNS, suffixes, headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantage.functions.text import clean, is_header_name, report_hostname
from vantage.session import local_table

# Response headers collected by default ...
COLLECTED_HEADERS = (
    "cache-control", "clear-site-data", "content-type", "content-security-policy",
    "cross-origin-embedder-policy", "cross-origin-opener-policy", "cross-origin-resource-policy",
    "permissions-policy", "referrer-policy", "strict-transport-security", "x-content-type-options",
    "x-dns-prefetch-control", "x-frame-options", "x-permitted-cross-domain-policies", "$wsep", "host-header",
    "k-proxy-request", "liferay-portal", "oraclecommercecloud-version", "pega-host", "powered-by", "product",
    "sourcemap", "www-authenticate", "x-aspnet-version", "x-aspnetmvc-version", "x-atmosphere-error",
    "x-atmosphere-first-request", "x-atmosphere-tracking-id", "x-b3-parentspanid", "x-b3-sampled",
    "x-b3-spanid", "x-b3-traceid", "x-beserver", "x-backside-transport", "x-cf-powered-by", "x-cms",
    "x-calculatedbetarget", "x-cocoon-version", "x-content-encoded-by", "x-diaginfo",
    "x-envoy-attempt-count", "x-envoy-external-address", "x-envoy-internal", "x-envoy-original-dst-host",
    "x-envoy-upstream-service-time", "x-feserver", "x-framework", "x-generated-by", "x-generator",
    "x-gitlab-meta", "x-jitsi-release", "x-joomla-version", "x-kubernetes-pf-flowschema-ui",
    "x-kubernetes-pf-prioritylevel-uid", "x-litespeed-cache", "x-litespeed-purge", "x-litespeed-tag",
    "x-litespeed-vary", "x-litespeed-cache-control", "x-mod-pagespeed", "x-nextjs-cache",
    "x-nextjs-matched-path", "x-nextjs-page", "x-nextjs-redirect", "x-owa-version", "x-old-content-length",
    "x-oneagent-js-injection", "x-page-speed", "x-php-version", "x-powered-by", "x-powered-by-plesk",
    "x-powered-cms", "x-redirect-by", "x-server-powered-by", "x-sourcefiles", "x-sourcemap",
    "x-turbo-charged-by", "x-umbraco-version", "x-varnish-backend", "x-varnish-server",
    "x-woodpecker-version", "x-dtagentid", "x-dthealthcheck", "x-dtinjectedservlet", "x-ruxit-js-agent",
)
# ... and those among them whose value is collected too.
VALUE_HEADERS = (
    "x-powered-by", "x-server-powered-by", "powered-by", "product", "x-generator", "x-generated-by",
    "x-powered-cms", "x-varnish-backend", "x-varnish-server", "x-cms", "x-framework", "x-redirect-by",
    "x-turbo-charged-by", "liferay-portal", "x-content-encoded-by", "x-cf-powered-by", "x-owa-version",
    "x-cocoon-version", "x-jitsi-release", "oraclecommercecloud-version", "x-woodpecker-version",
    "x-joomla-version", "x-umbraco-version", "x-php-version", "x-aspnet-version", "x-aspnetmvc-version",
    "content-type", "www-authenticate",
)


def read_rpsl(spark: SparkSession, path: str, line_sep: str = "\n\n") -> DataFrame:
    """Registry records separated by blank lines, plain or gzip: one `lines` array each."""
    blocks = spark.read.option("lineSep", line_sep).option("recursiveFileLookup", True).text(path)
    # a separator line may hold blanks, which `lineSep` does not see
    record = F.explode(F.split("value", r"\n[ \t\r]*\n"))
    lines = F.filter(F.transform(F.split(F.col("record"), "\r?\n"), lambda x: F.rtrim(x)), lambda x: F.trim(x) != "")
    return blocks.select(record.alias("record")).select(lines.alias("lines")).filter(F.size("lines") > 0)


def read_delegated(spark: SparkSession, path: str) -> DataFrame:
    """Delegated-stats rows of at least seven columns; comments are dropped."""
    parts = F.split(clean("value"), r"\|")
    names = ("registry", "country", "type", "start", "value", "date", "status")
    return (
        spark.read.option("recursiveFileLookup", True).text(path).filter(~F.col("value").startswith("#"))
        .select(parts.alias("p")).filter(F.size("p") >= 7)
        .select(*[F.get("p", i).alias(n) for i, n in enumerate(names)])
    )


def file_place() -> Column:
    """Place of a row in its source, to be taken straight from the scan: file, start of the split, row.

    Rows of a split are numbered upwards, whichever task reads it, so places sort like the files by path and like the
    lines in them.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_target_list(spark: SparkSession, path: str, bulk: bool = False) -> DataFrame:
    """Targets of list files; `ord` grows with the files' paths, their lines and the entries of a line.

    Plain form: one target per line.  Bulk form: lines may hold carriage
    returns, and quotes, commas and semicolons around an entry are removed.
    `ord` is the number of the split (the only thing ordered as a whole, one row
    a split) above the number of the entry in it.
    """
    # with carriage returns kept inside a line, the bulk form can split on them
    rows = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    rows = rows.select(file_place().alias("at"), "value")
    splits = rows.select("at.file", "at.block").distinct()
    numbered = splits.withColumn("split", F.row_number().over(Window.orderBy("file", "block")).cast("bigint"))
    entry = F.explode(F.split("value", "\r")) if bulk else F.col("value")
    strip = "^[\\s,;'\"]+|[\\s,;'\"]+$" if bulk else r"^\s+|\s+$"
    # the lower 33 bits of the number count the rows of a task
    entries = rows.select("at.file", "at.block", entry.alias("raw")).withColumn(
        "n", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )
    return (
        entries.join(numbered, ["file", "block"])
        .select((F.shiftleft("split", 33) + F.col("n")).alias("ord"), F.regexp_replace("raw", strip, "").alias("value"))
        .filter("value <> ''")
    )


def read_first_seen(spark: SparkSession, path: str) -> DataFrame:
    """csv files ``uid,ip,first_seen,last_seen`` with a header; `ord` is the place of the row."""
    rows = spark.read.option("recursiveFileLookup", True).csv(path, header=True, schema="uid string, ip string, first_seen string, last_seen string")
    return rows.select("*", file_place().alias("ord"))


def _first_name(record: Column) -> Column:
    """First usable host name of a passive-DNS record, by field order."""
    # Fields that may carry the name.
    fields = ("rdata", "rrdata", "rrname", "name", "hostname", "fqdn")

    def values(field: str) -> Column:
        many = F.try_variant_get(record, f"$.{field}", "array<string>")
        return F.coalesce(many, F.array(F.try_variant_get(record, f"$.{field}", "string")))

    names = F.transform(F.concat(*[values(f) for f in fields]), report_hostname)
    return F.get(F.filter(names, lambda n: n.isNotNull()), 0)


def parse_pdns(lines: DataFrame) -> DataFrame:
    """Passive-DNS JSON text lines (`value`, `ip`, `seq`) to (ip, seq, fqdn).

    Broken lines, non-objects and records other than A give nothing.
    """
    record = F.try_parse_json(F.col("value"))
    rows = lines.select("ip", "seq", record.alias("r")).filter(
        F.try_variant_get("r", "$", "map<string,variant>").isNotNull()
    )
    own = lambda f: F.try_variant_get("r", f"$.{f}", "string")
    kind = F.coalesce(F.nullif(own("rrtype"), F.lit("")), own("type"), F.lit(""))
    return (
        rows.filter((kind == "") | (F.upper(kind) == "A"))
        .select(F.coalesce("ip", own("ip")).alias("ip"), "seq", _first_name(F.col("r")).alias("fqdn"))
        .filter("fqdn IS NOT NULL")
    )


def read_pdns(spark: SparkSession, path: str) -> DataFrame:
    """Passive-DNS NDJSON files; the address is the file stem or an `ip` field, `seq` the place of the line."""
    stem = F.nullif(F.regexp_extract("_metadata.file_name", r"^([0-9a-fA-F:.]+)\.(?:nd)?json$", 1), F.lit(""))
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        "value", stem.alias("ip"), file_place().alias("seq")
    )
    return parse_pdns(lines)


def read_suffixes(spark: SparkSession, path: str, extra: list[str] | None = None) -> DataFrame:
    """Known suffixes: one per line, comments and blanks dropped, plus extra ones."""
    listed = (
        spark.read.option("recursiveFileLookup", True).text(path).filter(~F.col("value").startswith("#"))
        .select(F.lower(clean("value")).alias("suffix")).filter("suffix <> ''")
    )
    if extra:
        more = [(s.strip().lower(),) for s in extra if s.strip()]
        listed = listed.unionByName(local_table(spark, more, "suffix string"))
    return listed.distinct()


def header_collection(spark: SparkSession, overrides: DataFrame | None = None) -> DataFrame:
    """Collected headers (header_name, collect_value).

    Stored rows (`overrides`) join the defaults; a default value flag is never
    turned off.  Invalid names are dropped.
    """
    default = local_table(spark, 
        [(h, h in VALUE_HEADERS) for h in COLLECTED_HEADERS], "header_name string, collect_value boolean"
    )
    if overrides is None:
        return default
    stored = overrides.select(
        F.lower(clean("header_name")).alias("header_name"), F.coalesce("collect_value", F.lit(False)).alias("collect_value")
    ).filter(is_header_name("header_name"))
    return default.unionByName(stored).groupBy("header_name").agg(F.bool_or("collect_value").alias("collect_value"))
