"""Field extraction: port documents to searchable documents.

The whole job is one map stage of native expressions: no shuffle and no Python
per row.  Configuration (suffixes, header collection) is small and becomes
literals of the plan, so every call has its own configuration.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.functions.netaddr import address_key, ipv4_num, key_version, let
from vantage.functions.text import clean, clean_list
from vantage.functions.times import epoch
from vantage.operators.rules import tag_documents
from vantage.operators.store import replace_field
from vantage.schema import FIELDS
from vantage.session import materialize

MAX_SUFFIXES = 100_000
MAX_HEADERS = 100_000

# Patterns of names, header lines and icon fields.
NAME_RE = r"""(?md)(?:^|[\s(/<>|@'"=:])([a-zA-Z0-9-]+(?:\.[a-zA-Z0-9_-]{2,})+)(?=$|[?\s#&/<>'",)])"""
HEADER_RE = r"^\s*([^:\s]+)\s*:\s*(.*?)\s*$"
LINE_RE = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
ICON_FIELDS = {
    "http_favicon_path": "favicon[_ -]file",
    "http_favicon_mmhash": "favicon[_ -]mmhash|faviconhash",
    "http_favicon_md5": "favicon[_ -]md5",
    "http_favicon_sha256": "favicon[_ -]sha256|sha256",
}


@dataclass(frozen=True)
class Config:
    """Per-call configuration of the extractors."""

    suffixes: tuple[str, ...] = ()
    headers: dict[str, bool] = field(default_factory=dict)


def load_config(suffixes: DataFrame, headers: DataFrame) -> Config:
    """Configuration tables to literals, after a size check."""

    def rows(df: DataFrame, bound: int, what: str):
        found = df.limit(bound + 1).collect()
        if len(found) > bound:
            raise ValueError(f"{what} table exceeds {bound} rows")
        return found

    return Config(
        tuple(sorted({r[0] for r in rows(suffixes.select("suffix"), MAX_SUFFIXES, "suffix")})),
        {r[0]: bool(r[1]) for r in rows(headers.select("header_name", "collect_value"), MAX_HEADERS, "header")},
    )


# --------------------------------------------------------------------------
# expressions


def lookup(payload: Column, path: str) -> Column:
    """VARIANT at a dotted path; keys match after ``-`` and blank become ``_``."""
    for segment in path.split("."):
        wanted = segment.replace("-", "_").replace(" ", "_")
        entries = F.map_entries(F.try_variant_get(payload, "$", "map<string,variant>"))
        payload = let(_matching(entries, wanted), lambda m: F.get(m, F.size(m) - 1)["value"])
    return payload


def _matching(entries: Column, wanted: str) -> Column:
    return F.filter(entries, lambda e: F.translate(e["key"], " -", "__") == wanted)


def lookup_text(payload: Column, path: str) -> Column:
    return F.try_variant_get(lookup(payload, path), "$", "string")


def scripts_of(ports: Column, name: str) -> Column:
    """Scripts with an id over all ports, in port order."""
    return F.flatten(F.transform(ports, lambda p: F.filter(p["scripts"], lambda s: s["id"] == name)))


def outputs_of(ports: Column, name: str) -> Column:
    """Non-empty text outputs of a script."""
    return F.filter(F.transform(scripts_of(ports, name), lambda s: s["output"]), lambda o: F.coalesce(o, F.lit("")) != "")


def fuse(*lists: Column) -> Column:
    """Union of lists, order kept, repeated and missing values dropped."""
    return F.array_distinct(F.array_compact(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])))


def _lines(texts: Column) -> Column:
    return F.flatten(F.transform(texts, lambda t: F.split(t, LINE_RE)))


def _after_colon(line: Column) -> Column:
    return clean(F.regexp_replace(line, "^[^:]*:", ""))


def _header_rest(lines: Column, name: str) -> Column:
    mine = F.filter(lines, lambda x: F.lower(clean(x)).startswith(name + ":"))
    return F.transform(mine, _after_colon)


def extract_cookiename(lines: Column) -> Column:
    return F.transform(_header_rest(lines, "set-cookie"), lambda v: clean(F.substring_index(v, "=", 1)))


def extract_etag(lines: Column) -> Column:
    return _header_rest(lines, "etag")


def extract_server(lines: Column) -> Column:
    return _header_rest(lines, "server")


def header_pairs(lines: Column) -> Column:
    """``struct(name, value)`` of header lines, lower-cased; tree marks removed."""

    def plain(line: Column) -> Column:
        return F.regexp_replace(clean(line), r"^\|_*\s*", "")

    def pair(line: Column) -> Column:
        return F.named_struct(
            F.lit("name"), F.lower(F.regexp_extract(line, HEADER_RE, 1)),
            F.lit("value"), F.lower(F.regexp_extract(line, HEADER_RE, 2)),
        )

    return F.filter(F.transform(F.transform(lines, plain), pair), lambda p: p["name"] != "")


def extract_header(pairs: Column, config: Config) -> Column:
    names = sorted(config.headers)
    return F.transform(F.filter(pairs, lambda p: p["name"].isin(names) if names else F.lit(False)), lambda p: p["name"])


def extract_headval(pairs: Column, config: Config) -> Column:
    valued = sorted(h for h, v in config.headers.items() if v)
    kept = F.filter(pairs, lambda p: (p["name"].isin(valued) if valued else F.lit(False)) & (p["value"] != ""))
    return F.transform(kept, lambda p: F.concat(p["name"], F.lit(":"), p["value"]))


def extract_favicon(scripts: Column, name: str) -> Column:
    """Icon values from payload keys at any depth and from ``key: value`` lines."""
    keys = ICON_FIELDS[name]
    in_key = rf'(?i)"(?:{keys})"\s*:\s*"?((?:[^"\\,}}\]]|\\.)*)"?'
    in_text = rf'(?im)(?:^|"|\\n)\s*(?:\|_?\s*)?(?:{keys})[ \t]*:[ \t]*(.*?)[ \t]*(?=$|\\n|")'

    def values(s: Column) -> Column:
        body = F.to_json(s["payload"])
        out = F.coalesce(s["output"], F.lit(""))
        return F.concat(
            F.regexp_extract_all(body, F.lit(in_key), F.lit(1)),
            F.regexp_extract_all(out, F.lit(in_text), F.lit(1)),
            F.regexp_extract_all(body, F.lit(in_text), F.lit(1)),
        )

    found = F.transform(F.flatten(F.transform(scripts, values)), clean)
    return F.array_distinct(F.filter(found, lambda v: (v != "") & (v != "null") & ~v.startswith("{") & ~v.startswith("[")))


def hostname_parts(name: Column, config: Config) -> Column:
    """``struct(fqdn, host, domain, tld)`` by the longest known suffix, else null."""
    known = list(config.suffixes)

    def parse(h: Column) -> Column:
        labels = F.split(h, r"\.")
        n = F.size(labels)
        tails = F.when(n >= 2, F.transform(F.sequence(F.lit(2), n), lambda i: F.array_join(F.slice(labels, i, n), ".")))
        tld = F.get(F.filter(tails, lambda s: s.isin(known) if known else F.lit(False)), 0)

        def split(suffix: Column) -> Column:
            root = F.substr(h, F.lit(1), F.length(h) - F.length(suffix) - 1)
            return F.when(
                suffix.isNotNull(),
                F.named_struct(
                    F.lit("fqdn"), h,
                    F.lit("host"), F.regexp_replace(root, r"(^|\.)[^.]*$", ""),
                    F.lit("domain"), F.concat(F.substring_index(root, ".", -1), F.lit("."), suffix),
                    F.lit("tld"), suffix,
                ),
            )

        return let(tld, split)

    return let(F.regexp_replace(F.lower(clean(name)), r"\.+$", ""), parse)


def hostname_candidates(texts: Column) -> Column:
    """Distinct delimited names found in texts."""
    found = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(NAME_RE), F.lit(1))))
    return F.array_distinct(F.transform(found, lambda n: F.lower(n)))


def requested_hostnames(hostnames: Column) -> Column:
    """Names the scan was asked for: lower-cased, distinct, suffix not checked."""
    mine = F.filter(hostnames, lambda h: F.lower(F.coalesce(h["type"], F.lit(""))) == "user")
    return clean_list(F.transform(mine, lambda h: h["name"]))


# --------------------------------------------------------------------------
# registry: extractor name -> expressions over the prepared columns


def _hosts(name: str) -> Callable[[Config], Column]:
    return lambda config: F.transform(F.col("_parts"), lambda p: p[name])


def _cert(path: str) -> Callable[[Config], Column]:
    return lambda config: F.transform(F.col("_certs"), lambda s: lookup_text(s["payload"], path))


def _icon(name: str) -> Callable[[Config], Column]:
    return lambda config: extract_favicon(F.col("_icons"), name)


EXTRACTORS: dict[str, Callable[[Config], Column]] = {
    "fqdn": _hosts("fqdn"),
    "host": _hosts("host"),
    "domain": _hosts("domain"),
    "tld": _hosts("tld"),
    "fqdn_requested": lambda config: F.col("_requested"),
    "domain_requested": lambda config: F.transform(
        F.filter(F.transform(F.col("_requested"), lambda n: hostname_parts(n, config)), lambda p: p.isNotNull()), lambda p: p["domain"]
    ),
    "port": lambda config: F.transform(F.col("_ports"), lambda p: p["portid"]),
    "http_title": lambda config: F.col("_titles"),
    "banner": lambda config: F.col("_banners"),
    "http_cookiename": lambda config: extract_cookiename(F.col("_lines")),
    "http_etag": lambda config: extract_etag(F.col("_lines")),
    "http_server": lambda config: extract_server(F.col("_lines")),
    "http_header": lambda config: extract_header(F.col("_pairs"), config),
    "http_headval": lambda config: extract_headval(F.col("_pairs"), config),
    "x509_issuer": _cert("issuer.commonName"),
    "x509_subject": _cert("subject.commonName"),
    "x509_md5": _cert("md5"),
    "x509_sha1": _cert("sha1"),
    "x509_sha256": _cert("sha256"),
    "x509_san": _cert("extensions.X509v3 Subject Alternative Name"),
    **{name: _icon(name) for name in ICON_FIELDS},
}


def extractor(name: str) -> Callable[[Config], Column]:
    """Extractor by name; an unknown name is an error."""
    if name not in EXTRACTORS:
        raise TypeError(f"unknown extractor {name}")
    return EXTRACTORS[name]


# --------------------------------------------------------------------------
# the job


def _prepared(docs_raw: DataFrame, config: Config) -> DataFrame:
    """Script outputs and name candidates, each computed once per document."""
    empty_ports = F.filter(F.col("body.ports"), lambda p: p.isNotNull())
    hostnames = F.coalesce(F.col("body.hostnames"), F.array())
    rest = [c for c in ("first_seen", "last_seen") if c in docs_raw.columns]
    base = docs_raw.select(
        F.col("id").alias("uid"), "ip", F.col("body.endtime").alias("_end"), *rest,
        empty_ports.alias("_ports"), hostnames.alias("_names"),
    )
    base = base.select(
        "*",
        outputs_of(F.col("_ports"), "http-headers").alias("_headers"),
        outputs_of(F.col("_ports"), "http-title").alias("_titles"),
        outputs_of(F.col("_ports"), "banner").alias("_banners"),
        scripts_of(F.col("_ports"), "ssl-cert").alias("_certs"),
        scripts_of(F.col("_ports"), "http-mm-sha-favicon").alias("_icons"),
        requested_hostnames(F.col("_names")).alias("_requested"),
    )
    texts = fuse(
        F.array(F.to_json("_names")), F.col("_headers"),
        F.transform("_certs", lambda s: lookup_text(s["payload"], "issuer.commonName")),
        F.transform("_certs", lambda s: lookup_text(s["payload"], "extensions.X509v3 Subject Alternative Name")),
        F.col("_banners"),
    )
    base = base.select("*", _lines(F.col("_headers")).alias("_lines"), hostname_candidates(texts).alias("_found"))
    parts = F.filter(F.transform("_found", lambda n: hostname_parts(n, config)), lambda p: p.isNotNull())
    return base.select("*", header_pairs(F.col("_lines")).alias("_pairs"), parts.alias("_parts"))


def extract_with(docs_raw: DataFrame, config: Config, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Searchable documents of port documents ``(id, ip, body)``; tags stay empty."""
    prepared = _prepared(docs_raw, config)
    empty = F.expr("CAST(array() AS ARRAY<STRING>)")
    columns = [(empty if f == "tag" else clean_list(extractor(f)(config))).alias(f) for f in fields]
    end = epoch("_end")
    first = F.col("first_seen") if "first_seen" in docs_raw.columns else end
    last = F.col("last_seen") if "last_seen" in docs_raw.columns else end
    keyed = prepared.withColumn("ip_key", address_key("ip"))
    return keyed.select(
        "uid", "ip", key_version("ip_key").alias("ip_version"), ipv4_num("ip").alias("ip_num"), "ip_key",
        first.alias("first_seen"), last.alias("last_seen"), *columns,
    )


def extract(
    docs_raw: DataFrame, suffixes: DataFrame, headers: DataFrame, rules: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """Searchable documents, tagged when rule tables are given.

    Tagging reads the documents several times, so the extracted ones are written
    to the shared folder first: they are parsed once and survive lost executors.
    """
    docs = extract_with(docs_raw, load_config(suffixes, headers))
    return tag_documents(materialize(docs, "extracted"), *rules) if rules else docs


def backfill_field(docs: DataFrame, docs_raw: DataFrame, name: str, config: Config) -> DataFrame:
    """Recompute one field of stored documents from their bodies."""
    return replace_field(docs, name, extract_with(docs_raw, config, (name,)).select("uid", name))
