"""Address and network arithmetic as native column expressions.

An address is carried as a lower-case hexadecimal key, 8 digits for IPv4 and 32
for IPv6.  Keys of one version sort like the addresses, so containment is two
string comparisons, both versions share one code path, and no 128-bit number is
ever needed.  IPv4 additionally has a BIGINT form for arithmetic and Parquet
statistics.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vantage.schema import MAX_UNITS

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4_RE = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_V6_GROUPS = "[0-9a-f]{1,4}(:[0-9a-f]{1,4})*"
V6_FULL_RE = r"^[0-9a-f]{1,4}(:[0-9a-f]{1,4}){7}$"
V6_SHORT_RE = rf"^({_V6_GROUPS})?::({_V6_GROUPS})?$"

# Address blocks that are not publicly routable, and the public
# exceptions inside them (IANA special-purpose registries).
PRIVATE_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
    "255.255.255.255/32",
)
PUBLIC_V4 = ("192.0.0.9/32", "192.0.0.10/32")
PRIVATE_V6 = (
    "::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64",
    "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10",
)
PUBLIC_V6 = (
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48",
    "2001:20::/28", "2001:30::/28",
)


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column | str, body) -> Column:
    """Evaluate `value` once and use it many times in `body`.

    Without the binding, nested helpers would copy their argument expression at
    every use and the plan would grow exponentially.
    """
    return F.element_at(F.transform(F.array(col(value)), body), 1)


# --------------------------------------------------------------------------
# address text <-> key


def ipv4_num(text: Column | str) -> Column:
    """Dotted quad to BIGINT; null when the text is not a strict IPv4 address."""
    return F.aggregate(
        F.split(F.regexp_extract(col(text), V4_RE, 0), r"\."),
        F.lit(0).cast("bigint"),
        lambda acc, octet: acc * 256 + octet.try_cast("bigint"),
    )


def ipv4_text(num: Column | str) -> Column:
    """BIGINT to dotted quad."""
    num = col(num)
    return F.concat_ws(
        ".",
        *[F.shiftright(num, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)],
    )


def v4_key(num: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(col(num))), 8, "0")


def key_num(key: Column | str) -> Column:
    """Numeric value of an IPv4 key."""
    return F.conv(col(key), 16, 10).cast("bigint")


def ipv6_key(text: Column | str) -> Column:
    """IPv6 text (``::``, embedded IPv4 and zone allowed) to a 32-digit key."""

    def hex_tail(plain: Column) -> Column:
        number = ipv4_num(F.regexp_extract(plain, r":([0-9.]+\.[0-9.]+)$", 1))
        return let(
            number,
            lambda n: F.when(
                n.isNotNull(),
                F.concat(
                    F.regexp_replace(plain, r"[0-9]+\.[0-9.]+$", ""),
                    F.lower(F.hex(F.shiftright(n, 16))),
                    F.lit(":"),
                    F.lower(F.hex(n.bitwiseAND(F.lit(65535)))),
                ),
            ).otherwise(plain),
        )

    def groups(part: Column) -> Column:
        return F.filter(F.split(part, ":"), lambda g: g != "")

    def expand(t: Column) -> Column:
        sides = F.named_struct(
            F.lit("left"), groups(F.substring_index(t, "::", 1)),
            F.lit("right"), groups(F.substring_index(t, "::", -1)),
        )

        def short(side: Column) -> Column:
            gap = F.lit(8) - F.size(side["left"]) - F.size(side["right"])
            return F.when(
                gap >= 1, F.concat(side["left"], F.array_repeat(F.lit("0"), gap), side["right"])
            )

        return F.when(t.rlike(V6_FULL_RE), F.split(t, ":")).when(t.rlike(V6_SHORT_RE), let(sides, short))

    plain = F.lower(F.regexp_replace(col(text), r"%[^%/\s]+$", ""))
    full = let(let(plain, hex_tail), expand)
    return F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), "")


def address_key(text: Column | str) -> Column:
    """8-digit key for IPv4 text, 32-digit key for IPv6 text, null otherwise."""
    return let(
        text, lambda t: F.when(t.contains(":"), ipv6_key(t)).otherwise(v4_key(ipv4_num(t)))
    )


def key_version(key: Column | str) -> Column:
    key = col(key)
    return F.when(F.length(key) == 8, 4).when(F.length(key) == 32, 6)


def key_bits(key: Column | str) -> Column:
    return F.length(col(key)) * 4


def _v6_text(key: Column) -> Column:
    """Eight groups without leading zeros; the first longest zero run is cut."""
    groups = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.regexp_replace(F.substr(key, i * 4 + 1, F.lit(4)), "^0{1,3}", ""),
    )

    def shorten(long_form: Column) -> Column:
        runs = F.regexp_extract_all(long_form, F.lit("(?:^|:)(0(?::0)+)(?=:|$)"), F.lit(1))
        run = F.array_max(F.transform(runs, lambda r, i: F.named_struct(F.lit("n"), F.length(r), F.lit("i"), (-i), F.lit("r"), r)))["r"]
        padded = F.concat(F.lit(":"), long_form, F.lit(":"))

        def cut(r: Column) -> Column:
            at = F.call_function("instr", padded, F.concat(F.lit(":"), r, F.lit(":")))
            head = F.substr(padded, F.lit(2), at - 2)
            tail = F.rtrim(F.substr(padded, at + F.length(r) + 2), F.lit(":"))
            return F.when(r.isNull(), long_form).otherwise(F.concat(head, F.lit("::"), tail))

        return let(run, cut)

    mapped = F.concat(F.lit("::ffff:"), ipv4_text(key_num(F.substring(key, 25, 8))))
    return F.when(key.startswith("0" * 20 + "ffff"), mapped).otherwise(
        let(F.array_join(groups, ":"), shorten)
    )


def key_text(key: Column | str) -> Column:
    """Canonical address text of a key."""
    return let(
        key,
        lambda k: F.when(F.length(k) == 8, let(key_num(k), ipv4_text)).when(F.length(k) == 32, _v6_text(k)),
    )


def next_key(key: Column | str) -> Column:
    """Key of the following address (null after the last one)."""
    pattern = "^(.*?)([0-9a-e])(f*)$"

    def bump(k: Column) -> Column:
        digit = F.translate(F.regexp_extract(k, pattern, 2), "0123456789abcde", "123456789abcdef")
        tail = F.translate(F.regexp_extract(k, pattern, 3), "f", "0")
        return F.when(k.rlike(pattern), F.concat(F.regexp_extract(k, pattern, 1), digit, tail))

    return let(key, bump)


# --------------------------------------------------------------------------
# networks


def mask_key(key: Column | str, prefix: Column, fill: int) -> Column:
    """First (fill=0) or last (fill=1) key of the `prefix` network around a key."""

    def masked(at: Column) -> Column:
        key, prefix = at["key"], at["prefix"]
        whole = F.floor(prefix / 4).cast("int")
        nibble = F.conv(F.substr(key, whole + 1, F.lit(1)), 16, 10).cast("int")
        low_bits = F.element_at(F.array(*[F.lit(v) for v in (15, 7, 3, 1)]), prefix % 4 + 1)
        edge = nibble.bitwiseOR(low_bits) if fill else nibble.bitwiseAND(F.lit(15) - low_bits)
        return F.concat(
            F.substr(key, F.lit(1), whole),
            F.when(whole < F.length(key), F.lower(F.hex(edge))).otherwise(""),
            F.repeat(F.lit("f" if fill else "0"), F.greatest(F.length(key) - whole - 1, F.lit(0))),
        )

    return let(F.named_struct(F.lit("key"), col(key), F.lit("prefix"), prefix.cast("int")), masked)


def _v4_mask_prefix(text: Column) -> Column:
    """Prefix length of a dotted netmask or hostmask."""

    def ones(host: Column) -> Column:  # number of host bits of 2**k - 1
        contiguous = host.bitwiseAND(host + 1) == 0
        return F.when(contiguous, F.length(F.regexp_replace(F.bin(host), "^0$", "")))

    return let(
        ipv4_num(text),
        lambda m: F.lit(32) - F.coalesce(ones(F.lit(2**32 - 1) - m), ones(m)),
    )


def network(text: Column | str) -> Column:
    """Address or network text to ``struct(version, prefix, lo, hi)``.

    Host bits are cleared; a bare address is a full-length network; anything
    else is null.  ``lo``/``hi`` are the first and last address keys.
    """

    def parts(t: Column) -> Column:
        return F.named_struct(
            F.lit("key"), address_key(F.substring_index(t, "/", 1)),
            F.lit("mask"), F.when(t.contains("/"), F.regexp_replace(t, "^[^/]*/", "")),
        )

    def with_prefix(p: Column) -> Column:
        number = F.when(p["mask"].rlike("^[0-9]+$"), p["mask"].try_cast("int"))
        dotted = F.when(F.length(p["key"]) == 8, _v4_mask_prefix(p["mask"]))
        prefix = F.when(p["mask"].isNull(), key_bits(p["key"])).otherwise(F.coalesce(number, dotted))
        return F.named_struct(F.lit("key"), p["key"], F.lit("prefix"), prefix.cast("int"))

    def bounds(p: Column) -> Column:
        return F.when(
            (p["prefix"] >= 0) & (p["prefix"] <= key_bits(p["key"])),
            F.named_struct(
                F.lit("version"), key_version(p["key"]),
                F.lit("prefix"), p["prefix"],
                F.lit("lo"), mask_key(p["key"], p["prefix"], 0),
                F.lit("hi"), mask_key(p["key"], p["prefix"], 1),
            ),
        )

    return let(let(let(text, parts), with_prefix), bounds)


def network_text(lo: Column | str, prefix: Column | str) -> Column:
    return F.concat(key_text(lo), F.lit("/"), col(prefix).cast("string"))


def network_size(prefix: Column, bits: Column, cap: int = MAX_UNITS) -> Column:
    """Number of addresses, saturating at `cap`."""
    exponent = (bits - prefix).cast("int")
    return F.when(exponent >= 63, F.lit(cap)).when(
        exponent.isNotNull(), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(exponent, F.lit(62)))
    )


def _key_of(text: str) -> tuple[str, str]:
    """Literal bounds of a constant block (driver side, constants only)."""
    import ipaddress

    net = ipaddress.ip_network(text)
    digits = 8 if net.version == 4 else 32
    return format(int(net[0]), f"0{digits}x"), format(int(net[-1]), f"0{digits}x")


def _blocks(*groups: tuple[str, ...]) -> Column:
    """Constant blocks as one folded array of ``first-last`` key texts."""
    texts = ["-".join(_key_of(block)) for group in groups for block in group]
    return F.split(F.lit(",".join(texts)), ",")


def _is_private_keys(lo: Column, hi: Column) -> Column:
    def inside(key: Column, block: Column) -> Column:
        first, last = F.substring_index(block, "-", 1), F.substring_index(block, "-", -1)
        return (F.length(first) == F.length(key)) & key.between(first, last)

    private = F.exists(_blocks(PRIVATE_V4, PRIVATE_V6), lambda b: inside(lo, b) & inside(hi, b))
    public = F.exists(_blocks(PUBLIC_V4, PUBLIC_V6), lambda b: inside(lo, b) | inside(hi, b))
    return F.when(lo.isNotNull(), private & ~public)


def target(text: Column | str) -> Column:
    """Parse a scan target once: ``struct(kind, value, version, prefix, lo, hi)``.

    kind is `fqdn`, `address`, `network` or `invalid` (private or malformed);
    value is the canonical text of a valid target.
    """
    text = col(text)

    def classify(net: Column) -> Column:
        single = ~text.contains("/")
        mapped = single & (F.length(net["lo"]) == 32) & net["lo"].startswith("0" * 20 + "ffff")
        effective = F.when(mapped, F.substring(net["lo"], 25, 8)).otherwise(net["lo"])
        last = F.when(mapped, effective).otherwise(net["hi"])
        public = F.coalesce(~let(F.named_struct(F.lit("lo"), effective, F.lit("hi"), last), lambda e: _is_private_keys(e["lo"], e["hi"])), F.lit(False))
        kind = F.when(is_fqdn(text), "fqdn").when(public & single, "address").when(public, "network").otherwise("invalid")
        return F.named_struct(F.lit("kind"), kind, F.lit("net"), net)

    def describe(t: Column) -> Column:
        net = t["net"]
        place = t["kind"].isin("address", "network")
        value = F.when(t["kind"] == "fqdn", text).when(
            place,
            F.concat(
                key_text(net["lo"]),
                F.when(t["kind"] == "network", F.concat(F.lit("/"), net["prefix"].cast("string"))).otherwise(""),
            ),
        )
        return F.struct(
            t["kind"].alias("kind"), value.alias("value"),
            *[F.when(place, net[c]).alias(c) for c in ("version", "prefix", "lo", "hi")],
        )

    return let(let(network(text), classify), describe)


def is_public_address(text: Column | str) -> Column:
    """True for a well-formed address outside the private blocks."""

    def effective(key: Column) -> Column:
        mapped = (F.length(key) == 32) & key.startswith("0" * 20 + "ffff")
        return F.when(mapped, F.substring(key, 25, 8)).otherwise(key)

    return let(
        let(address_key(text), effective),
        lambda key: F.coalesce(~_is_private_keys(key, key), F.lit(False)),
    )


def is_public_network(text: Column | str) -> Column:
    """True for a well-formed network that is not inside one private block."""
    return let(
        network(text),
        lambda net: F.coalesce(~_is_private_keys(net["lo"], net["hi"]), F.lit(False)),
    )


def canonical_target(text: Column | str) -> Column:
    """Canonical text of a public address or network, else null."""
    return let(target(text), lambda t: F.when(t["kind"] != "fqdn", t["value"]))


def in_network(key: Column | str, cidr: str) -> Column:
    """Predicate: address key inside a literal network (false on bad CIDR)."""
    import ipaddress

    try:
        net = ipaddress.ip_network(cidr.strip(), strict=False)
    except ValueError:
        return F.lit(False)
    first, last = _key_of(str(net))
    return (F.length(col(key)) == len(first)) & col(key).between(first, last)


def in_network_num(ip_num: Column | str, ip_key: Column | str, cidr: str) -> Column:
    """As `in_network`, but IPv4 uses the numeric column so Parquet can prune."""
    import ipaddress

    try:
        net = ipaddress.ip_network(cidr.strip(), strict=False)
    except ValueError:
        return F.lit(False)
    if net.version == 4:
        return F.coalesce(col(ip_num).between(int(net[0]), int(net[-1])), F.lit(False))
    first, last = _key_of(str(net))
    return F.coalesce((F.length(col(ip_key)) == 32) & col(ip_key).between(first, last), F.lit(False))


def enclosing_networks(key: Column | str, first: int = 16, last: int = 24) -> Column:
    """Array of the enclosing networks of an address, one per prefix length."""
    key = col(key)
    return F.transform(
        F.sequence(F.lit(first), F.lit(last)),
        lambda p: network_text(mask_key(key, p, 0), p),
    )


def address_order(text: Column | str) -> Column:
    """Sort key: version, then numeric order; unparsable text last, by text."""
    text = col(text)
    return let(
        address_key(text),
        lambda key: F.named_struct(
            F.lit("version"), F.coalesce(key_version(key), F.lit(99)),
            F.lit("key"), F.coalesce(key, F.lit("")),
            F.lit("text"), F.when(key.isNull(), text).otherwise(F.lit("")),
        ),
    )


# --------------------------------------------------------------------------
# ranges


def range_blocks_v4(lo: Column | str, hi: Column | str) -> Column:
    """Smallest CIDR list of an IPv4 range as ``array<struct<start, prefix>>``.

    For every block size at most two aligned blocks can belong to the minimal
    cover: the first and the last aligned block inside the range, and they do
    belong exactly when the enclosing block of twice the size sticks out.
    """
    lo, hi = col(lo), col(hi)

    def blocks(exp: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), exp)
        first = lo + (size - lo % size) % size
        last = (hi + 1) - (hi + 1) % size - size

        def belongs(b: Column) -> Column:
            parent = b - b % (size * 2)
            inside = (b >= lo) & (b + size - 1 <= hi)
            parent_inside = (parent >= lo) & (parent + size * 2 - 1 <= hi)
            return inside & ~parent_inside

        kept = F.filter(F.array_distinct(F.array(first, last)), belongs)
        return F.transform(
            kept, lambda b: F.named_struct(F.lit("start"), b, F.lit("prefix"), (F.lit(32) - exp).cast("int"))
        )

    return F.array_sort(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(32)), blocks)))


# --------------------------------------------------------------------------
# targets


def unit_count(text: Column | str) -> Column:
    """Scan units of a target: 1 for an address or name, size of a network."""
    text = F.regexp_replace(F.trim(F.coalesce(col(text), F.lit(""))), r"\.+$", "")
    return let(
        network(text),
        lambda net: F.coalesce(
            network_size(net["prefix"], key_bits(net["lo"])), F.lit(1).cast("bigint")
        ),
    )


def unit_count_list(text: Column | str) -> Column:
    """Saturating sum over a comma list, at least 1."""
    parts = F.filter(
        F.transform(F.split(F.coalesce(col(text), F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != ""
    )
    total = F.aggregate(
        F.transform(parts, unit_count),
        F.lit(0).cast("bigint"),
        lambda acc, n: F.when(acc > F.lit(MAX_UNITS) - n, F.lit(MAX_UNITS)).otherwise(acc + n),
    )
    return F.greatest(total, F.lit(1).cast("bigint"))


def is_fqdn(text: Column | str) -> Column:
    """Shape test of a host name: two or more labels, the last of letters only; one trailing dot is accepted."""
    text = col(text)
    labels = F.split(F.regexp_replace(text, r"\.\z", ""), r"\.", -1)
    inner = F.slice(labels, F.lit(1), F.size(labels) - 1)
    return F.coalesce(
        (F.length(text) <= 253)
        & ~F.startswith(text, F.lit("-"))
        & (F.size(inner) > 0)
        & F.forall(inner, lambda label: label.rlike(r"^[a-zA-Z0-9-]{1,63}\z"))
        & F.element_at(labels, -1).rlike(r"^[a-zA-Z]{2,63}\z"),
        F.lit(False),
    )


def target_kind(text: Column | str) -> Column:
    """`fqdn`, `address`, `network` or `invalid` (private or malformed)."""
    return target(text)["kind"]
