"""Data model: searchable fields, nested scan schema and operating constants."""

from __future__ import annotations

# The searchable fields of a document.  `net` is derived from the
# address and carries no stored values, `ip` is a scalar column.
FIELDS = (
    "fqdn",
    "fqdn_requested",
    "host",
    "domain",
    "domain_requested",
    "tld",
    "tag",
    "port",
    "http_title",
    "http_favicon_path",
    "http_favicon_mmhash",
    "http_favicon_md5",
    "http_favicon_sha256",
    "http_cookiename",
    "http_etag",
    "http_header",
    "http_headval",
    "http_server",
    "x509_issuer",
    "x509_md5",
    "x509_sha1",
    "x509_sha256",
    "x509_subject",
    "x509_san",
    "banner",
)

# Fields whose values come from the observation (everything but computed tags).
OBSERVED_FIELDS = tuple(f for f in FIELDS if f != "tag")

# Operating limits.
MAX_UNITS = 2**63 - 1          # saturation bound of every unit counter
CHUNK_ADDRESSES = 256          # addresses or names per work item
QUEUE_TARGET_PER_PROFILE = 256 # waiting work items wanted per profile
QUEUE_BUDGET_PER_TICK = 1024   # new work items per tick over all profiles
RETAINED_CYCLES = 2
REPORT_NAME_LIMIT = 25
REPORT_PTR_MONTHS = 6
SEARCH_DEFAULT_MONTHS = 3
SEARCH_PAGE_LIMIT = 100
SEARCH_MAX_WINDOW_DAYS = 4096
SUGGESTION_LIMIT = 12
PREFERRED_NAMESPACES = ("lang", "soft", "hard")
MIN_JOB_SECONDS = 1.0
PRIORITIES = (0, 1, 2, 3, 4)

# One scan result as delivered by an agent.  Probe payloads differ per script,
# so a script stays a VARIANT and is opened by path when a field needs it.
SCRIPT = "variant"
PORT = (
    "struct<portid:string,protocol:string,hsh256:string,"
    "service:struct<name:string,product:string,version:string>,"
    f"scripts:array<{SCRIPT}>>"
)
SCAN = (
    "struct<addr:string,"
    "hostnames:array<struct<name:string,hostname:string,type:string>>,"
    "starttime:string,endtime:string,"
    f"ports:array<{PORT}>>"
)
