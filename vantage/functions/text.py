"""Text normalisation and validation expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vantage.functions.netaddr import address_key, col, let

# Accepted spellings.
HEADER_NAME_RE = r"^[!#$%&'*+\-.^_`|~0-9a-z]+$"
EMAIL_RE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
UUID_RE = r"^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"
HEADER_NAME_MAX = 128


def clean(text: Column | str) -> Column:
    """Trim all white space around a value."""
    return F.regexp_replace(col(text), r"^\s+|\s+$", "")


def _cleaned(v: Column) -> Column:
    """`clean` of a bound value, by characters; before a last character that ends a line without being `\\s`, the expression decides."""
    return F.when(F.substring(v, -1, 1).isin("\u0085", "\u2028", "\u2029"), clean(v)).otherwise(F.btrim(v, F.lit(" \t\n\x0b\f\r")))


def clean_list(values: Column | str) -> Column:
    """Trimmed, lower-cased, non-empty, distinct values in first-seen order."""
    values = F.transform(F.coalesce(col(values), F.expr("array()").cast("array<string>")), lambda v: F.lower(_cleaned(v)))
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))


def normalize_tag(tag: Column | str) -> Column:
    """Lower-cased ``namespace:value``; leading ``tag:`` prefixes are removed
    as long as a namespace remains behind them."""
    return F.regexp_replace(F.lower(clean(tag)), r"^(tag:\s*)+(?=[^:]*:)", "")


def normalize_tags(tags: Column | str) -> Column:
    tags = F.transform(F.coalesce(col(tags), F.expr("array()").cast("array<string>")), normalize_tag)
    return F.array_distinct(F.filter(tags, lambda t: t.isNotNull() & (t != "")))


def split_tags(text: Column | str) -> Column:
    """Editable tag text (newline or comma separated) to normalized tags."""
    return normalize_tags(F.split(F.coalesce(col(text), F.lit("")), r"[\n,]+"))


def join_tags(tags: Column | str) -> Column:
    return F.array_join(normalize_tags(tags), "\n")


def is_header_name(text: Column | str) -> Column:
    name = clean(text)
    return F.coalesce((F.length(name) <= HEADER_NAME_MAX) & name.rlike(HEADER_NAME_RE), F.lit(False))


def port_order(port: Column | str) -> Column:
    """Sort key: numeric ports by number, anything else after them by text."""
    number = col(port).try_cast("int")
    return F.named_struct(
        F.lit("kind"), F.when(number.isNull(), 1).otherwise(0),
        F.lit("number"), F.coalesce(number, F.lit(0)),
        F.lit("text"), col(port),
    )


def sort_ports(ports: Column | str) -> Column:
    """Distinct ports in port order."""
    keyed = F.transform(F.array_distinct(col(ports)), lambda p: port_order(p))
    return F.transform(F.array_sort(keyed), lambda k: k["text"])


def report_hostname(text: Column | str) -> Column:
    """Host name usable in a report, or null (no dot, or an address literal)."""
    # only digits and dots, or a colon, can be an address
    literal = lambda n: n.rlike(r"^[0-9.]+$|:") & address_key(n).isNotNull()
    return let(F.regexp_replace(F.lower(clean(text)), r"\.+$", ""), lambda n: F.when((n != "") & n.contains(".") & ~literal(n), n))


def split_recipients(text: Column | str) -> Column:
    """Recipient text (newline, comma or semicolon) to distinct addresses."""
    return clean_list(F.split(F.coalesce(col(text), F.lit("")), r"[\n,;]+"))


def recipients_valid(recipients: Column) -> Column:
    return (F.size(recipients) > 0) & F.forall(recipients, lambda r: r.rlike(EMAIL_RE))


def is_uuid(text: Column | str) -> Column:
    """36-character agent or job id."""
    text = col(text)
    return F.coalesce((F.length(text) == 36) & text.rlike(UUID_RE), F.lit(False))


def is_port_number(value: Column | str) -> Column:
    return F.coalesce(col(value).between(1, 65535), F.lit(False))


def protocol_label(value: Column | str) -> Column:
    """Upper-cased protocol label, null when blank."""
    return F.nullif(F.upper(clean(value)), F.lit(""))


def port_protocol_key(value: Column | str, proto_id: Column | str) -> Column:
    return F.concat_ws(":", col(value).cast("string"), col(proto_id).cast("string"))
