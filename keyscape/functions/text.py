"""Text expressions: vendor lookup, role wording, certificate names, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyscape import config
from keyscape.functions.columns import as_col, map_literal, reusable

# Vendor of the first three MAC octets.
VENDOR_PREFIXES = {
    "Ubiquiti": ["0418d6", "245a4c", "44d9e7", "68d79a", "74acb9", "788a20",
                 "802aa8", "b4fbe4", "dc9fdb", "e063da", "f09fc2", "fcecda"],
    "Cisco": ["00000c", "0018b9", "001b0c", "00256b", "0025b4", "e8b7a3"],
    "Cisco Meraki": ["0c8ddb", "88153f", "ac17c8", "e0553d", "e8264b"],
    "Aruba/HPE": ["000b86", "204c03", "6cf37f", "9c1c12", "d8c7c8"],
    "Juniper": ["000585", "2c6bf5", "3c8ab0", "84b59c", "f4b52f"],
    "VMware": ["000c29", "001c14", "005056"],
    "Raspberry Pi": ["b827eb", "dca632", "e45f01"],
    "Apple": ["001451", "3c0754", "a45e60"],
    "Intel": ["001320", "0015f2", "00aa00"],
    "Microsoft": ["000d3a", "001dd8"],
    "Dell": ["00188b", "18a99b", "d067e5"],
}

# Documented wording that names an inferable role. Phrases match
# anywhere, tokens only as whole words; the first role that matches wins.
ROLE_PHRASES = {"DomainController": ["domain controller", "active directory"]}
ROLE_TOKENS = {
    "DomainController": ["dc", "ad"],
    "DNSServer": ["dns"],
    "FileServer": ["file", "nas", "smb", "fileserver"],
    "Database": ["db", "database", "sql", "oracle", "postgres", "mysql"],
    "JumpBox": ["jump", "bastion", "jumpbox"],
    "WebServer": ["web", "http", "https", "iis", "apache", "nginx", "webserver"],
}


@reusable
def vendor_for_mac(mac) -> Column:
    digits = F.substring(F.regexp_replace(F.lower(as_col(mac)), "[^0-9a-f]", ""), 1, 6)
    table = map_literal({p: v for v, ps in VENDOR_PREFIXES.items() for p in ps})
    return F.coalesce(F.element_at(table, digits), F.lit(""))


@reusable
def normalize_role(text) -> Column:
    lowered = F.lower(F.coalesce(as_col(text), F.lit("")))
    words = F.split(lowered, r"[^\p{L}\p{Nd}]+")
    expr = None
    for role, tokens in ROLE_TOKENS.items():
        hit = F.arrays_overlap(words, F.array(*[F.lit(t) for t in tokens]))
        for phrase in ROLE_PHRASES.get(role, []):
            hit = hit | lowered.contains(phrase)
        expr = F.when(hit, role) if expr is None else expr.when(hit, role)
    return expr.otherwise("")


def evidence_strength(evidence) -> Column:
    evidence = as_col(evidence)
    return (
        F.when(evidence == config.PROTOCOL_CONFIRMED, 2)
        .when(evidence == config.RESPONDER_CONFIRMED, 1)
        .otherwise(0)
    )


def confirmed(evidence) -> Column:
    """Unknown (empty) evidence passes; only proven port-only is barred."""
    return F.coalesce(as_col(evidence), F.lit("")) != config.PORT_ONLY


def role_confidence(have, minimum: int) -> Column:
    return F.least(
        F.lit(1.0), F.greatest(F.lit(0.5), as_col(have) / F.lit(5.0 * minimum))
    )


@reusable
def subject_cn(subject) -> Column:
    """Lower-cased first CN of a certificate subject, empty when absent."""
    parts = F.transform(F.split(F.coalesce(as_col(subject), F.lit("")), ","), lambda p: F.trim(p))
    names = F.filter(parts, lambda p: p.startswith("CN="))
    first = F.get(names, F.lit(0))
    return F.coalesce(F.lower(F.trim(F.regexp_replace(first, "^CN=", ""))), F.lit(""))


@reusable
def certificate_names(sans, subject) -> Column:
    """Sorted distinct lower-cased SANs plus the subject CN."""
    sans = F.coalesce(as_col(sans), F.array().cast("array<string>"))
    names = F.filter(F.transform(sans, lambda s: F.lower(F.trim(s))), lambda s: s != "")
    cn = subject_cn(subject)
    extra = F.when(cn != "", F.array(cn)).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_union(names, extra))


def glob_regex(pattern) -> Column:
    """Anchored regex of a glob: ``*`` and ``?`` never cross ``/``; classes and
    escapes keep their meaning."""
    out = F.regexp_replace(as_col(pattern), r"([.+^$(){}|])", r"\\$1")
    out = F.regexp_replace(out, r"\[\\\^", "[^")
    out = F.regexp_replace(out, r"(?<!\\)\*(?![^\[]*\])", "[^/]*")
    out = F.regexp_replace(out, r"(?<!\\)\?(?![^\[]*\])", "[^/]")
    return F.concat(F.lit("^"), out, F.lit("$"))


def glob_match(pattern, name) -> Column:
    return F.call_function("rlike", as_col(name), glob_regex(pattern))


def glob_is_valid(pattern) -> Column:
    """Whether classes are closed and not empty and no escape is at the end."""
    return as_col(pattern).rlike(r"^([^\[\\]|\\.|\[\^?([^\]\\]|\\.)+\])*$")


def glob_key(pattern) -> Column:
    """The text that every name a glob matches has, as an index key; null if there is none.

    ``E`` and the literal ending from a dot on, if it has two labels or is all there is;
    else ``G`` and the start (three characters at most) of the longest literal piece.
    """
    pattern = as_col(pattern)
    literal_end = F.regexp_extract(pattern, r"[^*?\]\\]*$", 0)
    ending = F.regexp_extract(literal_end, r"\..*$", 0)
    pieces = F.filter(F.split(pattern, r"\[[^\]]*\]|\\.|[*?]"), lambda x: x != "")
    longest = F.array_max(F.transform(pieces, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    return (
        F.when(ending.rlike(r"\..*\.") | ((ending != "") & (ending == longest)), F.concat(F.lit("E"), ending))
        .when(longest.isNotNull(), F.concat(F.lit("G"), F.substring(longest, 1, 3))))


def glob_keys_of(name) -> Column:
    """All index keys that a glob matching this name can have: its endings from a dot on, and
    its runs of one to three characters."""
    name = as_col(name)
    words = F.split(name, r"\.")
    endings = F.transform(
        F.sequence(F.lit(1), F.size(words)),
        lambda i: F.when(i < F.size(words), F.concat(
            F.lit("E."), F.array_join(F.slice(words, i + 1, F.size(words)), "."))))
    at = F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1)))

    def grams(n: int) -> Column:
        return F.transform(at, lambda i: F.concat(F.lit("G"), F.substring(name, i, F.lit(n))))

    return F.array_distinct(F.array_compact(F.concat(endings, grams(1), grams(2), grams(3))))


def x509_fingerprint(message) -> Column:
    return F.coalesce(F.get_json_object(as_col(message), "$.fingerprint"), F.lit(""))


def epoch_millis(value) -> Column:
    value = as_col(value)
    return F.when(value > 0, F.timestamp_millis(value.cast("bigint")))


def tier_of(role, composite) -> Column:
    role = as_col(role)
    return (
        F.when(role.isin(config.CORE_ROLES), "core")
        .when(role.isin(config.SERVICE_ROLES), "service")
        .when(as_col(composite) >= 2 * config.CLIENT_AGG_MAX_COMPOSITE, "service")
        .otherwise("client")
    )


def provider_key(ip, port) -> Column:
    return F.concat_ws(":", as_col(ip), as_col(port).cast("string"))


def edge_id(src, dst, port) -> Column:
    return F.concat(
        as_col(src), F.lit(">"), as_col(dst), F.lit(":"), as_col(port).cast("string")
    )


def rule_evidence(device, source, line, raw, confidence) -> Column:
    base = F.concat(
        as_col(device), F.lit(" "),
        F.element_at(F.split(as_col(source), "/"), -1), F.lit(":"),
        as_col(line).cast("string"), F.lit(" — "), as_col(raw),
    )
    return F.when(
        as_col(confidence) == "partial", F.concat(base, F.lit(" (confidence: partial)"))
    ).otherwise(base)


def display_label(hostnames, ip) -> Column:
    first = F.get(as_col(hostnames), F.lit(0))
    return F.when(first.isNotNull(), F.concat(first, F.lit("\n"), as_col(ip))).otherwise(
        as_col(ip)
    )


def why(drivers, roles) -> Column:
    """First score driver, else first evidence line of the first role."""
    role_line = F.get(F.get(as_col(roles), F.lit(0))["evidence"], F.lit(0))
    return F.coalesce(F.get(as_col(drivers), F.lit(0)), role_line, F.lit(""))


def set_added(old, new) -> Column:
    return F.array_sort(F.array_except(_arr(new), _arr(old)))


def set_removed(old, new) -> Column:
    return F.array_sort(F.array_except(_arr(old), _arr(new)))


def _arr(c) -> Column:
    return F.coalesce(as_col(c), F.array().cast("array<string>"))


@reusable
def port_range(text) -> Column:
    """``80`` or ``1000-2000`` (either order) as ``struct(lo, hi)``; empty text
    means any port, ``(0, 0)``; NULL when it is not a number or a range."""
    text = F.trim(F.coalesce(as_col(text), F.lit("")))
    shape = r"^([0-9]{1,5})\s*(?:-\s*([0-9]{1,5}))?$"
    a = F.regexp_extract(text, shape, 1).try_cast("int")
    b = F.coalesce(F.regexp_extract(text, shape, 2).try_cast("int"), a)
    span = F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    none = F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    return F.when(text == "", none).when((a <= 65535) & (b <= 65535), span)


def controller_address(text) -> Column:
    """Controller address field: empty means any, a bare IPv4 becomes a /32."""
    text = F.trim(F.coalesce(as_col(text), F.lit("")))
    return (
        F.when(text == "", "0.0.0.0/0")
        .when(~text.contains("/"), F.concat(text, F.lit("/32")))
        .otherwise(text)
    )
