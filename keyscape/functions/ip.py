"""IP and CIDR column expressions.

Addresses stay strings. ``ip_key`` gives a sortable text key, ``'4'`` plus eight
hex digits or ``'6'`` plus thirty-two, so numeric order is string order, ranges
are ``BETWEEN`` and an IPv4 range never covers an IPv6 address.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyscape.functions.columns import as_col, let, reusable

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(\.{_OCTET}){{3}}"
_MAPPED = "6" + "0" * 20 + "ffff"

# Nibble masks keeping the top 1, 2 or 3 bits of a hex digit, and the matching
# fill that sets the cleared bits.
_HEX = "0123456789abcdef"
_KEEP = {1: "0000000088888888", 2: "000044448888cccc", 3: "0022446688aaccee"}
_FILL = {1: "77777777ffffffff", 2: "33337777bbbbffff", 3: "1133557799bbddff"}


def is_ipv4(ip) -> Column:
    return as_col(ip).rlike(f"^{_V4}$")


def _v4_hex(ip: Column) -> Column:
    octets = F.split(ip, r"\.")
    return F.concat(
        *[
            F.lpad(F.lower(F.hex(octets.getItem(i).cast("int"))), 2, "0")
            for i in range(4)
        ]
    )


def _v6_key(ip: Column) -> Column:
    bare = F.lower(F.split(ip, "%", 2).getItem(0))
    return let(bare, lambda text: let(_undotted(text), _v6_groups_key))


def _undotted(text: Column) -> Column:
    """Rewrite a trailing dotted IPv4 part as two hex groups."""
    dotted = F.regexp_extract(text, rf"^[0-9a-f:]*:({_V4})$", 1)

    def rewrite(tail: Column) -> Column:
        head = F.substring(text, F.lit(1), F.length(text) - F.length(tail))
        digits = _v4_hex(tail)
        return F.concat(
            head, F.substring(digits, 1, 4), F.lit(":"), F.substring(digits, 5, 4)
        )

    return let(dotted, lambda t: F.when(t == "", text).otherwise(rewrite(t)))


def _v6_groups_key(text: Column) -> Column:
    nonempty = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    left = nonempty(F.substring_index(text, "::", 1))
    right = F.when(
        text.contains("::"), nonempty(F.substring_index(text, "::", -1))
    ).otherwise(F.array().cast("array<string>"))
    shape = (
        text.rlike("^[0-9a-f:]+$")
        & ~text.rlike(":::|^:[^:]|[^:]:$|::.*::")
        & ~text.rlike("[0-9a-f]{5}")
    )

    def assemble(halves: Column) -> Column:
        count = F.size(halves["l"]) + F.size(halves["r"])
        zeros = F.array_repeat(F.lit("0"), F.greatest(8 - count, F.lit(0)))
        groups = F.transform(
            F.concat(halves["l"], zeros, halves["r"]), lambda g: F.lpad(g, 4, "0")
        )
        fits = F.when(text.contains("::"), count <= 7).otherwise(count == 8)
        return F.when(shape & fits, F.concat(F.lit("6"), F.array_join(groups, "")))

    return let(F.struct(left.alias("l"), right.alias("r")), assemble)


@reusable
def ip_key(ip) -> Column:
    """Sortable key of an address, NULL when it does not parse."""
    ip = as_col(ip)
    return (
        F.when(is_ipv4(ip), F.concat(F.lit("4"), _v4_hex(ip)))
        .when(ip.contains(":"), _v6_key(ip))
        .otherwise(F.lit(None).cast("string"))
    )


@reusable
def is_ip(ip) -> Column:
    return F.coalesce(ip_key(ip).isNotNull(), F.lit(False))


def _width(key: Column) -> Column:
    return F.when(F.substring(key, 1, 1) == "4", F.lit(32)).otherwise(F.lit(128))


def key_prefix(key: Column, bits: Column) -> Column:
    """Leading ``bits`` of a key, as family + whole digits + masked digit."""
    whole = F.floor(bits / 4).cast("int")
    digit = key.substr(whole + F.lit(2), F.lit(1))
    rest = bits % 4
    partial = (
        F.when(rest == 1, F.translate(digit, _HEX, _KEEP[1]))
        .when(rest == 2, F.translate(digit, _HEX, _KEEP[2]))
        .when(rest == 3, F.translate(digit, _HEX, _KEEP[3]))
        .otherwise(F.lit(""))
    )
    return F.concat(key.substr(F.lit(1), whole + F.lit(1)), partial)


def range_lo(key: Column, bits: Column) -> Column:
    size = F.floor(_width(key) / 4).cast("int") + 1
    prefix = key_prefix(key, bits)
    return F.concat(prefix, F.repeat(F.lit("0"), size - F.length(prefix)))


def range_hi(key: Column, bits: Column) -> Column:
    size = F.floor(_width(key) / 4).cast("int") + 1
    whole = F.floor(bits / 4).cast("int")
    digit = key.substr(whole + F.lit(2), F.lit(1))
    rest = bits % 4
    partial = (
        F.when(rest == 1, F.translate(digit, _HEX, _FILL[1]))
        .when(rest == 2, F.translate(digit, _HEX, _FILL[2]))
        .when(rest == 3, F.translate(digit, _HEX, _FILL[3]))
        .otherwise(F.lit(""))
    )
    head = F.concat(key.substr(F.lit(1), whole + F.lit(1)), partial)
    return F.concat(head, F.repeat(F.lit("f"), size - F.length(head)))


@reusable
def cidr_parts(cidr) -> Column:
    """``struct(key, bits)`` of a CIDR as written; NULL fields when malformed."""

    def parse(c: Column) -> Column:
        return F.struct(
            ip_key(F.substring_index(c, "/", 1)).alias("key"),
            F.regexp_extract(c, r"^[^/%]+/(0|[1-9][0-9]{0,2})$", 1).try_cast("int").alias("bits"),
        )

    def check(p: Column) -> Column:
        fits = p["bits"] <= _width(p["key"])
        return F.struct(
            F.when(fits, p["key"]).alias("key"),
            F.when(p["key"].isNotNull() & fits, p["bits"]).alias("bits"),
        )

    return let(let(as_col(cidr), parse), check)


@reusable
def cidr_bits(cidr) -> Column:
    """Prefix length of a well-formed CIDR, else NULL."""
    return cidr_parts(cidr)["bits"]


@reusable
def cidr_range(cidr) -> Column:
    """``struct(lo, hi, bits)`` of a CIDR; NULL fields when malformed."""
    return let(
        cidr_parts(cidr),
        lambda p: F.struct(
            range_lo(p["key"], p["bits"]).alias("lo"),
            range_hi(p["key"], p["bits"]).alias("hi"),
            p["bits"].alias("bits"),
        ),
    )


@reusable
def network_cidr(cidr) -> Column:
    """Canonical text of the network a CIDR lies in, NULL when malformed."""
    return let(cidr_parts(cidr), lambda p: masked_cidr(p["key"], p["bits"]))


@reusable
def network_address(cidr) -> Column:
    return let(cidr_parts(cidr), lambda p: key_to_text(range_lo(p["key"], p["bits"])))


def contains(cidr, ip) -> Column:
    both = F.struct(cidr_range(cidr).alias("r"), ip_key(ip).alias("k"))
    inside = let(both, lambda x: x["k"].between(x["r"]["lo"], x["r"]["hi"]))
    return F.coalesce(inside, F.lit(False))


def _v6_in(key: Column, *ranges: tuple[str, str]) -> Column:
    """Key inside any range, where a mapped IPv4 address counts as IPv4."""

    def test(k: Column) -> Column:
        bare = F.when(
            k.startswith(_MAPPED), F.concat(F.lit("4"), F.substring(k, 26, 8))
        ).otherwise(k)
        hit = F.lit(False)
        for lo, hi in ranges:
            hit = hit | bare.between(lo, hi)
        return hit

    return let(key, test)


# Address blocks that are never hosts, and private space.
_ARTEFACT_V4 = (
    r"^(2(2[4-9]|3[0-9])\.|127\.|169\.254\.|0\.0\.0\.0$|255\.255\.255\.255$)"
)
_ARTEFACT_KEYS = [
    ("4e0000000", "4efffffff"),
    ("400000000", "400000000"),
    ("47f000000", "47fffffff"),
    ("4a9fe0000", "4a9feffff"),
    ("6ff" + "0" * 30, "6ff" + "f" * 30),
    ("6" + "0" * 32, "6" + "0" * 31 + "1"),
    ("6fe80" + "0" * 28, "6febf" + "f" * 28),
]
_PRIVATE_V4 = r"^(10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.)"
_PRIVATE_KEYS = [
    ("40a000000", "40affffff"),
    ("4ac100000", "4ac1fffff"),
    ("4c0a80000", "4c0a8ffff"),
    ("6fc" + "0" * 30, "6fd" + "f" * 30),
]


@reusable
def terrain_addr(ip) -> Column:
    """Whether an address can be a host: no multicast, unspecified, loopback,
    link-local or all-ones broadcast."""
    ip = as_col(ip)
    v6 = F.when(ip.contains(":"), ~_v6_in(ip_key(ip), *_ARTEFACT_KEYS))
    host = F.when(is_ipv4(ip), ~ip.rlike(_ARTEFACT_V4)).otherwise(v6)
    return F.coalesce(host, F.lit(False))


@reusable
def is_private(ip) -> Column:
    """RFC 1918 and fc00::/7."""
    ip = as_col(ip)
    v6 = F.when(ip.contains(":"), _v6_in(ip_key(ip), *_PRIVATE_KEYS))
    hit = F.when(is_ipv4(ip), ip.rlike(_PRIVATE_V4)).otherwise(v6)
    return F.coalesce(hit, F.lit(False))


@reusable
def internal_cidr(cidr) -> Column:
    """Whether a grouping CIDR is private address space."""
    cidr = as_col(cidr)
    return cidr_bits(cidr).isNotNull() & is_private(F.substring_index(cidr, "/", 1))


def _v4_text(key: Column) -> Column:
    return F.concat_ws(
        ".", *[F.conv(F.substring(key, i, 2), 16, 10) for i in (2, 4, 6, 8)]
    )


def _v6_text(key: Column) -> Column:
    groups = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.lower(F.conv(F.substring(key, i * 4 + 2, F.lit(4)), 16, 16)),
    )
    return let(F.array_join(groups, ":"), _squeeze)


def _squeeze(full: Column) -> Column:
    """Collapse the first longest run of two or more zero groups."""
    out = None
    for run in range(8, 1, -1):
        zeros = ":".join(["0"] * run)
        found = full.rlike(rf"(^|:){zeros}(:|$)")
        short = F.regexp_replace(full, rf"^(.*?)(^|:){zeros}(:|$)(.*)$", "$1::$4")
        out = F.when(found, short) if out is None else out.when(found, short)
    return out.otherwise(full)


def key_to_text(key: Column) -> Column:
    """Key back to canonical address text."""
    return let(
        key,
        lambda k: F.when(k.startswith("4"), _v4_text(k)).when(
            k.startswith("6"), _v6_text(k)
        ),
    )


def masked_cidr(key: Column, bits: Column) -> Column:
    """Canonical CIDR text of ``key`` masked to ``bits``."""
    low = let(key, lambda k: key_to_text(range_lo(k, bits)))
    return F.concat(low, F.lit("/"), bits.cast("string"))


@reusable
def subnet(ip) -> Column:
    """Grouping subnet: /24 for IPv4, /64 for IPv6, the raw text otherwise."""
    ip = as_col(ip)
    v6 = F.when(ip.contains(":"), masked_cidr(ip_key(ip), F.lit(64)))
    return F.when(
        is_ipv4(ip), F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24"))
    ).otherwise(F.coalesce(v6, ip))


def subnet_of(ip, prefix: int) -> Column:
    """CIDR of an IPv4 address at ``prefix``; empty for anything else."""
    ip = as_col(ip)
    return F.when(is_ipv4(ip), masked_cidr(ip_key(ip), F.lit(prefix))).otherwise("")


def group_cidr(ip, prefix: int) -> Column:
    """Map grouping key. Computed from the address itself, so a prefix finer
    than /24 really splits its /24."""
    ip = as_col(ip)
    if prefix == 24:
        return subnet(ip)
    return F.when(is_ipv4(ip), subnet_of(ip, prefix)).otherwise(subnet(ip))


@reusable
def mask_to_bits(mask) -> Column:
    """Prefix length of a dotted netmask, NULL unless it is contiguous."""
    return _ones(_v4_bits(as_col(mask)))


@reusable
def wildcard_to_bits(wildcard) -> Column:
    """Prefix length of a dotted wildcard mask, NULL unless contiguous."""
    return _ones(F.translate(_v4_bits(as_col(wildcard)), "01", "10"))


def _v4_bits(dotted: Column) -> Column:
    octets = F.split(dotted, r"\.")
    bits = F.concat(
        *[F.lpad(F.conv(octets.getItem(i), 10, 2), 8, "0") for i in range(4)]
    )
    return F.when(is_ipv4(dotted), bits)


def _ones(bits: Column) -> Column:
    return F.when(bits.rlike("^1*0*$"), F.length(F.regexp_replace(bits, "0", "")))
