"""Device configs as a fleet job: many files in, normalised tables out.

Router text becomes a table of lines that carry the section they are in;
controller JSON becomes a table of items told apart by their fields. Only named
constructs are extracted, so secrets never reach an output column. Whatever
cannot be modelled marks its rule with a caveat and is never widened to "any".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyscape.functions import ip as ipf
from keyscape.functions import text
from keyscape.functions.columns import let
from keyscape.session import materialize

ANY = "0.0.0.0/0"
SOURCE_PORT = "source-port match unavailable from flow data"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(source, content) per file; the file name is the source."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("source"), F.col("value").alias("content"))


def route(files: DataFrame) -> DataFrame:
    """Vendor by content: router text, controller JSON, or unknown."""
    ios = F.col("content").rlike(r"(?m)^[ \t]*(hostname|interface|access-list) ")
    shape = F.ltrim("content")
    unifi = shape.startswith("[") | (
        shape.startswith("{") & F.array_contains(F.json_object_keys("content"), "data"))
    return files.withColumn("vendor", F.when(ios, "cisco-ios").when(
        F.coalesce(unifi, F.lit(False)), "unifi").otherwise("unknown"))


def route_warnings(routed: DataFrame) -> DataFrame:
    return routed.filter("vendor = 'unknown'").select("source", F.concat(
        F.col("source"), F.lit(": unrecognized format (not router text or controller JSON)")
    ).alias("warning"))


# --- router text -----------------------------------------------------------

def ios_lines(files: DataFrame) -> DataFrame:
    """Lines with number, words and enclosing section.

    A section lasts over indented lines. An unindented or blank line ends it; in
    a block without one, an indented opener starts it. Lines of one file are
    ordered together; files are independent.
    """
    lines = files.select("source", F.posexplode(F.split("content", "\r?\n")).alias("n", "raw"))
    lines = lines.select("source", (F.col("n") + 1).alias("line"), "raw", F.trim(
        F.regexp_replace("raw", r"\s+", " ")).alias("t"))
    inner = F.col("raw").rlike(r"^[ \t]") & (F.col("t") != "")
    opener = (
        F.when(F.col("t").rlike(r"^interface \S"), "interface")
        .when(F.col("t").rlike(r"^ip access-list extended \S"), "extended")
        .when(F.col("t").rlike(r"^ip access-list standard \S"), "standard")
        .when(F.col("t").rlike(r"^ip dhcp pool( |$)"), "pool")
        .when(F.col("t").rlike(r"^vlan -?[0-9]+( |$)"), "vlan"))
    by_file = Window.partitionBy("source").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumns({"inner": inner, "opener": opener})
    marked = marked.withColumn("block", F.last(
        F.when(~F.col("inner"), F.struct("line", "opener", "t")), True).over(by_file))
    late = Window.partitionBy("source", "block.line").orderBy("line").rowsBetween(
        Window.unboundedPreceding, -1)
    inherited = F.first(F.when(
        F.col("inner") & F.col("opener").isNotNull(), F.struct("line", "opener", "t")), True).over(late)
    section = F.when(F.col("block.opener").isNotNull(), F.col("block")).otherwise(inherited)
    out = marked.withColumn("sec", F.when(F.col("inner"), section))
    return out.select(
        "source", "line", "t", F.split("t", " ").alias("w"), F.col("sec.line").alias("ord"),
        F.col("sec.opener").alias("section"), F.split("sec.t", " ").alias("h"),
        F.when(F.col("sec").isNull(), F.col("opener")).alias("opens"))


def _mask_cidr(address: Column, mask: Column) -> Column:
    """``address/len``, host bits kept; NULL for a mask that is not contiguous."""
    bits = ipf.mask_to_bits(mask)
    return F.when(ipf.is_ipv4(address) & bits.isNotNull(),
                  F.concat_ws("/", address, bits.cast("string")))


def _word(i: int) -> Column:
    return F.get("w", F.lit(i))


def ios_tables(files: DataFrame) -> dict[str, DataFrame]:
    lines = materialize(ios_lines(files), "lines")
    top = lines.filter("section IS NULL")
    inside = lambda s: lines.filter(F.col("section") == s)
    hostname = top.filter((_word(0) == "hostname") & (F.size("w") >= 2)).groupBy("source").agg(
        F.max_by(_word(1), "line").alias("device"))
    routing = top.filter(F.col("t").isin("ip routing", "no ip routing")).groupBy("source").agg(
        F.max_by(F.col("t") == "ip routing", "line").alias("routing"))
    devices = (
        files.select("source").join(hostname, "source", "left").join(routing, "source", "left")
        .select("source", F.coalesce("device", F.lit("")).alias("device"),
                F.lit("cisco-ios").alias("vendor"), F.coalesce("routing", F.lit(False)).alias("routing")))
    names = devices.select("source", "device")

    inner = inside("interface")
    t = F.col("t")
    vlan = F.coalesce(
        F.when(F.lower(t).rlike("^encapsulation dot1q "), _word(2).try_cast("int")),
        F.when(t.rlike("^switchport access vlan "), _word(3).try_cast("int")))
    facts = inner.groupBy("source", "ord").agg(
        F.max(_word(0) == "shutdown").alias("shutdown"),
        F.max(_word(0) == "switchport").alias("switchport"),
        F.max(t.rlike("^switchport mode trunk")).alias("trunk"), F.max_by(vlan, F.when(
            vlan.isNotNull(), F.col("line"))).alias("vlan"))
    interfaces = (
        top.filter("opens = 'interface'").select("source", F.col("line").alias("ord"), _word(1).alias("name"))
        .join(facts, ["source", "ord"], "left").join(names, "source")
        .select("source", "device", F.col("ord").cast("string").alias("iface"), "ord", "name",
                F.lit("").alias("model"), F.coalesce("vlan", F.lit(0)).alias("vlan"),
                *[F.coalesce(c, F.lit(False)).alias(c) for c in ("switchport", "trunk", "shutdown")],
                F.lit("").alias("mac")))
    prefixes = inner.filter((_word(0) == "ip") & (_word(1) == "address") & (F.size("w") >= 4)).select(
        "source", F.col("ord").cast("string").alias("iface"), F.col("line").alias("pos"),
        _mask_cidr(_word(2), _word(3)).alias("cidr")).filter("cidr IS NOT NULL").join(names, "source")
    bindings = inner.filter(
        (_word(0) == "ip") & (_word(1) == "access-group") & _word(3).isin("in", "out")
    ).select("source", F.col("ord").cast("string").alias("iface"), _word(2).alias("ruleset"),
             _word(3).alias("direction")).distinct()
    vlan_names = inside("vlan").filter((_word(0) == "name") & (F.size("w") >= 2)).groupBy(
        "source", "ord").agg(F.max_by(_word(1), "line").alias("name"))
    vlans = (
        top.filter("opens = 'vlan'").select("source", F.col("line").alias("ord"), _word(1).alias("v"))
        .join(vlan_names, ["source", "ord"], "left").join(names, "source")
        .select("source", "device", F.col("v").cast("int").alias("id"),
                F.coalesce("name", F.lit("")).alias("name"), F.lit("").alias("subnet"),
                F.lit("").alias("purpose"), "ord"))
    pool = inside("pool")
    pools = top.filter("opens = 'pool'").select("source", F.col("line").alias("ord")).join(
        pool.groupBy("source", "ord").agg(
            F.max_by(_mask_cidr(_word(1), _word(2)), F.when(_word(0) == "network", F.col("line"))).alias("network"),
            F.max_by(_word(1), F.when(_word(0) == "default-router", F.col("line"))).alias("router"),
            F.flatten(F.transform(
                F.array_sort(F.collect_list(F.when(_word(0) == "dns-server", F.struct("line", "w")))),
                lambda s: F.slice(s["w"], 2, F.greatest(F.size(s["w"]) - 1, F.lit(0))))).alias("dns")),
        ["source", "ord"], "left").join(names, "source")
    routes = top.filter(
        (_word(0) == "ip") & (_word(1) == "route") & (F.size("w") >= 5)
    ).select("source", "line", _mask_cidr(_word(2), _word(3)).alias("prefix"),
             _word(4).alias("next_hop")).filter("prefix IS NOT NULL").join(names, "source")
    numbered = top.filter(
        t.rlike(r"^access-list [0-9]+ (permit|deny)( |$)")
    ).select("source", "line", "t", _word(1).alias("ruleset"),
             (_word(1).cast("bigint").between(1, 99) | _word(1).cast("bigint").between(1300, 1999))
             .alias("standard"), F.slice("w", 3, 10**6).alias("w"))
    named = lines.filter(F.col("section").isin("extended", "standard") & _word(0).isin("permit", "deny")).select(
        "source", "line", "t", F.get("h", F.lit(3)).alias("ruleset"),
        (F.col("section") == "standard").alias("standard"), "w")
    rules = _numbered_rules(acl_rules(numbered.unionByName(named)).join(names, "source"))
    declared = lines.filter(F.col("opens").isin("extended", "standard")).select("source", _word(3).alias("ruleset"))
    rulesets = declared.unionByName(numbered.select("source", "ruleset")).distinct().join(names, "source").withColumn(
        "default_action", F.lit("deny"))
    return {"devices": devices, "interfaces": interfaces, "prefixes": prefixes, "bindings": bindings,
            "vlans": vlans, "pools": pools, "routes": routes, "rulesets": rulesets, "rules": rules,
            "warnings": _ios_warnings(lines, rules)}


def _numbered_rules(rules: DataFrame) -> DataFrame:
    """Rule position inside its ruleset (a ruleset belongs to one device)."""
    order = Window.partitionBy("source", "ruleset").orderBy("line", "seq")
    return rules.withColumn("idx", F.row_number().over(order) - 1).drop("seq")


_SPEC = r"any(?= |$)|host \S+|\S+ \S+"
_PORTS = r"(?:eq|gt|lt|neq) \S+|range \S+ \S+|range \S+$|(?:eq|gt|lt|neq|range)$"
_PORTED = rf"^({_SPEC})(?: ({_PORTS}))?(?: ({_SPEC})(?: ({_PORTS}))?)?(?: (.*))?$"
_PLAIN = rf"^({_SPEC})()(?: ({_SPEC})())?(?: (.*))?$"


def _spec(spec: Column) -> Column:
    """CIDR of an address part; NULL when a wildcard is not contiguous."""
    first, second = F.split_part(spec, F.lit(" "), F.lit(1)), F.split_part(spec, F.lit(" "), F.lit(2))
    network = let(ipf.wildcard_to_bits(second), lambda bits: F.when(
        bits.isNotNull(), ipf.masked_cidr(ipf.ip_key(first), bits)))
    return (
        F.when(spec == "any", ANY).when(first == "host", F.concat(second, F.lit("/32")))
        .when(ipf.is_ipv4(first), network))


def _port_part(part: Column) -> Column:
    """``struct(lo, hi, caveat)`` of a port clause; no clause is any port."""
    op, a, b = (F.split_part(part, F.lit(" "), F.lit(i)) for i in (1, 2, 3))
    num = lambda p: F.when(p.rlike("^[0-9]{1,9}$") & (p.try_cast("int") <= 65535), p.try_cast("int"))
    x, y = num(a), num(b)
    span = lambda lo, hi, why="": F.struct(
        (F.lit(lo) if isinstance(lo, int) else lo).alias("lo"),
        (F.lit(hi) if isinstance(hi, int) else hi).alias("hi"), F.lit(why).alias("caveat"))
    short = (a == "") | ((op == "range") & (b == ""))
    return (
        F.when((part == "") | short, span(0, 0))
        .when(x.isNull() | ((op == "range") & y.isNull()), span(0, 0, "named port unresolved"))
        .when(op == "eq", span(x, x))
        .when((op == "gt") & (x < 65535), span(x + 1, 65535)).when(op == "gt", span(0, 0))
        .when((op == "lt") & (x > 1), span(1, x - 1)).when(op == "lt", span(0, 0))
        .when(op == "range", span(F.least(x, y), F.greatest(x, y)))
        .otherwise(span(0, 0, "neq unsupported")))


def acl_rules(entries: DataFrame) -> DataFrame:
    """Normalise entries (source, line, t, ruleset, standard, w) where ``w`` are
    the words from the action on. The first caveat found stays."""
    proto = F.when(F.col("standard"), "ip").otherwise(F.coalesce(_word(1), F.lit("ip")))
    skip = F.when(F.col("standard"), 2).otherwise(3)
    clause = F.array_join(F.slice("w", skip, 10**6), " ")
    rows = entries.filter(~F.lower("t").contains("secret")).select(
        "source", "line", "ruleset", F.col("t").alias("raw"), _word(0).alias("action"),
        let(F.struct(proto.alias("proto"), F.col("standard").alias("standard"),
                     F.array_contains("w", "object-group").alias("grouped"), clause.alias("text")),
            lambda e: let(_acl_parts(e), _acl_rule)).alias("r"))
    return rows.select("source", "ruleset", "action", "r.*", "line", "raw", F.lit(0).alias("seq"))


def _acl_parts(e: Column) -> Column:
    """Split the text of an entry into its address and port parts."""
    known = e["proto"].isin("ip", "tcp", "udp", "icmp")
    body = F.when(known & ~e["grouped"], e["text"]).otherwise("")
    ported = e["proto"].isin("tcp", "udp")
    part = lambda i: F.when(ported, F.regexp_extract(body, _PORTED, i)).otherwise(
        F.regexp_extract(body, _PLAIN, i))
    return F.struct(
        e["proto"].alias("proto"), e["standard"].alias("standard"), e["grouped"].alias("grouped"),
        known.alias("known"),
        *[part(i).alias(n) for i, n in enumerate(("src", "sport", "dst", "dport", "tail"), 1)])


def _acl_rule(p: Column) -> Column:
    bad = lambda spec: spec.startswith("host ") & ~ipf.is_ipv4(F.substring(spec, 6, 10**6))
    stop = bad(p["src"])
    src = F.when(stop, "").otherwise(p["src"])
    deep = ~stop & ~p["standard"]
    dst = F.when(deep & ~bad(p["dst"]), p["dst"]).otherwise("")
    sport = F.when(stop, "").otherwise(p["sport"])
    dport = F.when(deep & ~bad(p["dst"]), p["dport"]).otherwise("")
    ends = F.struct(
        _spec(src).alias("src"), _spec(dst).alias("dst"), _port_part(sport).alias("sp"),
        _port_part(dport).alias("dp"), (src != "").alias("has_src"), (dst != "").alias("has_dst"))

    def finish(x: Column) -> Column:
        caveat = _first(
            F.when(~p["known"], "unsupported protocol"), F.when(p["grouped"], "object-group unresolved"),
            F.when(x["has_src"] & x["src"].isNull(), "discontiguous wildcard"), x["sp"]["caveat"],
            F.when(x["sp"]["hi"] > 0, SOURCE_PORT),
            F.when(x["has_dst"] & x["dst"].isNull(), "discontiguous wildcard"), x["dp"]["caveat"],
            F.when(deep & F.array_contains(F.split(p["tail"], " "), "established"), "established unsupported"))
        return F.struct(
            p["proto"].alias("r_proto"), F.coalesce(x["src"], F.lit(ANY)).alias("r_src"),
            F.coalesce(x["dst"], F.lit(ANY)).alias("r_dst"), x["dp"]["lo"].alias("port_lo"),
            x["dp"]["hi"].alias("port_hi"), caveat.alias("caveat"))

    return let(ends, finish)


def _ios_warnings(lines: DataFrame, rules: DataFrame) -> DataFrame:
    kinds = {
        "vrf configuration seen on %d line(s); not modeled": F.col("t").rlike("^(ip )?vrf( |$)"),
        "ip nat seen on %d line(s); not modeled": F.col("t").startswith("ip nat "),
        "route-map seen on %d line(s); not modeled": F.col("t").startswith("route-map "),
    }
    seen = lines.groupBy("source").agg(*[F.count_if(c).alias(f"k{i}") for i, c in enumerate(kinds.values())])
    entries = F.array(*[
        F.struct(F.col(f"k{i}").alias("n"), F.format_string(m, F.col(f"k{i}")).alias("warning"))
        for i, m in enumerate(kinds)])
    unmodelled = seen.select("source", F.inline(entries)).filter("n > 0").select("source", "warning")
    return unmodelled.unionByName(_caveat_warning(rules, "%d ACL rule(s) carry a caveat and are not evaluated"))


def _caveat_warning(rules: DataFrame, message: str) -> DataFrame:
    held = rules.filter("caveat <> ''").groupBy("source").agg(F.count("*").alias("n"))
    return held.select("source", F.format_string(message, F.col("n")).alias("warning"))


# --- controller JSON -------------------------------------------------------

_ITEM = """
_id STRING, id STRING, name STRING, purpose STRING, ip_subnet STRING, vlan INT, dhcpd_enabled BOOLEAN,
dhcpd_gateway STRING, dhcpd_dns_1 STRING, dhcpd_dns_2 STRING, dhcpd_dns_3 STRING, dhcpd_dns_4 STRING,
mac STRING, type STRING, model STRING, ip STRING, macAddress STRING, ipAddress STRING,
ruleset STRING, enabled BOOLEAN, src_address STRING, dst_address STRING, src_networkconf_id STRING,
dst_networkconf_id STRING, protocol STRING, src_port STRING, dst_port STRING, rule_index INT,
src_firewallgroup_ids ARRAY<STRING>, dst_firewallgroup_ids ARRAY<STRING>,
vlanId INT, management STRING, networkIds ARRAY<STRING>, index INT,
ipv4Configuration STRUCT<hostIpAddress: STRING, prefixLength: INT, additionalHostIpSubnets: ARRAY<STRING>,
  dhcpConfiguration: STRUCT<mode: STRING, gatewayIpAddressOverride: STRING, dnsServerIpAddressesOverride: ARRAY<STRING>>>,
connectionStateFilter ARRAY<STRING>, ipsecFilter STRING, schedule STRING,
ipProtocolScope STRUCT<ipVersion: STRING, protocolFilter: STRUCT<type: STRING, matchOpposite: BOOLEAN,
  protocol: STRUCT<name: STRING>, preset: STRUCT<name: STRING>>>
"""
_END = """STRUCT<zoneId: STRING, trafficFilter: STRUCT<type: STRING,
  networkFilter: STRUCT<networkIds: ARRAY<STRING>, matchOpposite: BOOLEAN>,
  ipAddressFilter: STRUCT<type: STRING, matchOpposite: BOOLEAN, items: ARRAY<STRUCT<type: STRING, value: STRING>>>,
  portFilter: STRUCT<type: STRING, matchOpposite: BOOLEAN,
    items: ARRAY<STRUCT<type: STRING, value: INT, start: INT, stop: INT>>>>>"""
_POLICY = f"action STRUCT<type: STRING>, source {_END}, destination {_END}"


def controller_items(files: DataFrame) -> DataFrame:
    """Items of (source, file, content) with their kind, told by their fields."""
    wrapped = F.from_json("content", "data ARRAY<STRING>")["data"]
    bare = F.from_json("content", "ARRAY<STRING>")
    items = files.select("source", "file", F.posexplode(F.coalesce(wrapped, bare)).alias("n", "json"))
    keys = F.json_object_keys("json")
    has = lambda *names: reduce(
        lambda a, b: a & b, [F.array_contains("k", n) for n in names])
    obj = lambda c: F.ltrim(F.get_json_object("json", f"$.{c}")).startswith("{")
    kind = (
        F.when(has("purpose", "ip_subnet"), "network")
        .when(has("id", "vlanId", "management"), "api-network")
        .when(has("id", "networkIds") & ~has("vlanId"), "zone")
        .when(has("ruleset", "action"), "rule").when(has("mac", "type"), "device")
        .when(has("id") & obj("action") & obj("source") & obj("destination"), "policy")
        .when(has("id", "macAddress", "model"), "api-device").otherwise("unknown"))
    return items.withColumn("k", keys).withColumn("kind", F.coalesce(kind, F.lit("unknown"))).select(
        "source", "file", "n", "kind", F.from_json("json", _ITEM).alias("i"),
        F.get_json_object("json", "$.action").alias("action"),
        F.when(F.col("kind") == "policy", F.from_json("json", _POLICY)).alias("p"))


def _networks(items: DataFrame) -> DataFrame:
    host = F.trim(F.coalesce("i.ipv4Configuration.hostIpAddress", F.lit("")))
    api = F.concat_ws("/", host, F.coalesce("i.ipv4Configuration.prefixLength", F.lit(0)).cast("string"))
    legacy = F.col("kind") == "network"
    subnet = F.when(legacy, F.coalesce("i.ip_subnet", F.lit(""))).when(
        (host != "") & ipf.cidr_bits(api).isNotNull(), api).otherwise("")
    return items.filter(F.col("kind").isin("network", "api-network")).select(
        "source", "file", "n", "kind", "i", F.when(legacy, F.col("i._id")).otherwise(F.col("i.id")).alias("net"),
        subnet.alias("subnet"))


def _first(*values: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(F.get(F.filter(F.array(*values), lambda v: v != ""), F.lit(0)), F.lit(""))


def _legacy_rules(items: DataFrame, nets: DataFrame) -> DataFrame:
    rows = items.filter((F.col("kind") == "rule") & F.coalesce("i.enabled", F.lit(False))).withColumn(
        "verb", F.lower("action")).filter(F.col("verb").isin("accept", "drop", "reject"))
    table = nets.filter("subnet <> ''").groupBy("source", "net").agg(F.max("subnet").alias("subnet"))
    for side in ("src", "dst"):
        known = table.select(F.col("source").alias("_source"), F.col("net").alias(f"_{side}"),
                             F.col("subnet").alias(f"{side}_net"))
        same = (F.col("source") == F.col("_source")) & (
            F.col(f"i.{side}_networkconf_id") == F.col(f"_{side}"))
        rows = rows.join(known, same, "left").drop("_source", f"_{side}")

    def end(side: str) -> tuple[Column, Column]:
        given = F.trim(F.coalesce(f"i.{side}_address", F.lit("")))
        ref = F.coalesce(f"i.{side}_networkconf_id", F.lit(""))
        cidr = F.when(given != "", text.controller_address(given)).when(
            ref != "", F.coalesce(f"{side}_net", F.lit(ANY))).otherwise(ANY)
        return cidr, (given == "") & (ref != "") & F.col(f"{side}_net").isNull()

    src, src_open = end("src")
    dst, dst_open = end("dst")
    p = F.lower(F.coalesce("i.protocol", F.lit("")))
    protos = (
        F.when(p == "tcp_udp", F.array(F.lit("tcp"), F.lit("udp")))
        .when(p.isin("tcp", "udp"), F.array(p)).when(p.isin("icmp", "icmpv6"), F.array(F.lit("icmp")))
        .otherwise(F.array(F.lit("ip"))))
    listed = lambda c: F.size(F.coalesce(c, F.array())) > 0
    sp, dp = text.port_range("i.src_port"), text.port_range("i.dst_port")
    caveat = _first(
        F.when(src_open | dst_open, "network-scoped rule unresolved"),
        F.when(~p.isin("", "all", "any", "tcp", "udp", "tcp_udp", "icmp", "icmpv6"), "unsupported protocol"),
        F.when(listed("i.src_firewallgroup_ids") | listed("i.dst_firewallgroup_ids"), "firewall group unresolved"),
        F.when(dp.isNull() | sp.isNull(), "named port unresolved"), F.when(sp["hi"] > 0, SOURCE_PORT))
    raw = F.concat(F.lit("unifi "), "i.ruleset", F.lit(": "), "verb", F.lit(" "), src, F.lit("->"), dst)
    return rows.select(
        "source", F.col("i.ruleset").alias("ruleset"),
        F.when(F.col("verb") == "accept", "permit").otherwise("deny").alias("action"),
        F.posexplode(protos).alias("q", "r_proto"), src.alias("r_src"), dst.alias("r_dst"),
        F.coalesce(dp["lo"], F.lit(0)).alias("port_lo"), F.coalesce(dp["hi"], F.lit(0)).alias("port_hi"),
        F.coalesce("i.rule_index", F.lit(0)).alias("line"), raw.alias("raw"), caveat.alias("caveat"), "file", "n",
    ).withColumn("seq", F.array("q")).drop("q")


def _endpoint(rows: DataFrame, side: str, zones: DataFrame, nets: DataFrame) -> DataFrame:
    """(key, cidrs, ports, caveat, zone) of one side of every policy."""
    e = F.col(f"p.{side}")
    tf = e["trafficFilter"]
    kind = F.upper(F.coalesce(tf["type"], F.lit("")))
    by_zone = tf.isNull() | (kind == "PORT")
    z = zones.select(F.col("source").alias("_zs"), F.col("i.id").alias("_zid"), F.col("i.name").alias("zone_name"),
                     F.col("i.networkIds").alias("zone_nets"))
    base = rows.join(z, (F.col("source") == F.col("_zs")) & (e["zoneId"] == F.col("_zid")), "left")
    empty = F.array().cast("array<string>")
    ids = F.when(by_zone, F.coalesce("zone_nets", empty)).when(
        kind == "NETWORK", F.coalesce(tf["networkFilter"]["networkIds"], empty)).otherwise(empty)
    asked = base.select("key", "source", F.posexplode(ids).alias("o", "net"))
    found = asked.join(nets.filter("subnet <> ''").select("source", "net", "subnet"), ["source", "net"]).groupBy(
        "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "subnet"))),
                               lambda s: s["subnet"]).alias("resolved"))
    base = base.join(found, "key", "left").withColumn("ids", ids)
    got = F.coalesce("resolved", empty)
    missing = F.size(got) != F.size("ids")
    ipfilter = tf["ipAddressFilter"]
    items = F.coalesce(ipfilter["items"], F.array().cast("array<struct<type:string,value:string>>"))
    def judge(x: Column) -> Column:
        """Value and problem of one listed address."""
        kind_of = F.upper(F.coalesce(x["type"], F.lit("")))
        value = F.when(kind_of == "IP_ADDRESS", text.controller_address(x["value"])).when(
            kind_of == "SUBNET", x["value"])
        bits = let(value, lambda v: F.struct(v.alias("cidr"), ipf.cidr_bits(v).alias("bits")))
        return F.struct(bits.alias("net"), F.when(
            ~kind_of.isin("IP_ADDRESS", "SUBNET"), "IP range filter unsupported").when(
            kind_of == "IP_ADDRESS", "invalid IP filter").otherwise("invalid subnet filter").alias("why"))

    base = base.withColumn("judged", F.transform(items, judge))
    good = F.filter("judged", lambda j: j["net"]["bits"].isNotNull())
    valid = F.transform(good, lambda j: j["net"]["cidr"])
    item_caveat = F.get(F.transform(F.filter(
        "judged", lambda j: j["net"]["bits"].isNull()), lambda j: j["why"]), F.lit(0))
    opposite = lambda f: F.coalesce(f["matchOpposite"], F.lit(False))
    listed = F.upper(F.coalesce(ipfilter["type"], F.lit(""))) == "IP_ADDRESSES"
    plain_ip = (kind == "IP_ADDRESS") & listed & ~opposite(ipfilter)
    cidrs = F.when(plain_ip, valid).otherwise(got)
    unresolved = lambda what: F.when(missing, F.lit(f"{what} includes an unresolved network"))
    caveat = (
        F.when(by_zone, _first(unresolved("firewall zone"), F.when(
            F.size(got) == 0, "firewall zone has no resolvable IPv4 networks")))
        .when(kind == "NETWORK", _first(
            F.when(opposite(tf["networkFilter"]), "negated network filter unsupported"),
            unresolved("network filter"), F.when(F.size(got) == 0, "network filter unresolved")))
        .when(kind == "IP_ADDRESS", _first(
            F.when(~listed, "traffic matching list unresolved"),
            F.when(listed & opposite(ipfilter), "negated IP filter unsupported"),
            F.when(plain_ip, item_caveat),
            F.when(plain_ip & (F.size(valid) == 0), "IP filter contains no usable addresses")))
        .when(kind == "", F.lit("")).otherwise("unsupported firewall traffic filter"))
    pf = tf["portFilter"]
    span_t = "array<struct<lo:int,hi:int>>"
    pitems = F.coalesce(pf["items"], F.array().cast("array<struct<type:string,value:int,start:int,stop:int>>"))
    span = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    ports = F.array_compact(F.transform(pitems, lambda x: F.when(
        (F.upper(x["type"]) == "PORT_NUMBER") & x["value"].between(1, 65535), span(x["value"], x["value"])).when(
        (F.upper(x["type"]) == "PORT_NUMBER_RANGE") & (x["start"] > 0) & (x["start"] <= x["stop"])
        & (x["stop"] <= 65535), span(x["start"], x["stop"]))))
    plain_ports = (F.upper(F.coalesce(pf["type"], F.lit(""))) == "PORTS") & ~opposite(pf)
    odd = F.exists(pitems, lambda x: ~F.upper(x["type"]).isin("PORT_NUMBER", "PORT_NUMBER_RANGE"))
    port_caveat = F.when(pf.isNull(), "").otherwise(_first(
        F.when(F.upper(F.coalesce(pf["type"], F.lit(""))) != "PORTS", "port traffic matching list unresolved"),
        F.when(opposite(pf), "negated port filter unsupported"), F.when(odd, "unsupported port filter"),
        F.when(plain_ports & (F.size(ports) == 0), "port filter contains no usable ports")))
    return base.select(
        "key", F.when(F.size(cidrs) > 0, cidrs).otherwise(F.array(F.lit(ANY))).alias(f"{side}_cidrs"),
        F.when(pf.isNotNull() & plain_ports, ports).otherwise(F.array().cast(span_t)).alias(f"{side}_ports"),
        _first(caveat, port_caveat).alias(f"{side}_caveat"),
        _first(F.col("zone_name"), e["zoneId"]).alias(f"{side}_zone"))


def _policy_rules(items: DataFrame, nets: DataFrame) -> DataFrame:
    verb = F.upper(F.coalesce("p.action.type", F.lit("")))
    rows = items.filter((F.col("kind") == "policy") & F.coalesce("i.enabled", F.lit(False))).filter(
        verb.isin("ALLOW", "BLOCK", "REJECT")).withColumn("key", F.concat_ws("|", "source", "file", "n"))
    zones = items.filter("kind = 'zone'")
    table = nets.groupBy("source", "net").agg(F.max("subnet").alias("subnet"))
    for side in ("source", "destination"):
        rows = rows.join(_endpoint(rows, side, zones, table), "key")
    scope = F.col("i.ipProtocolScope")
    pf = scope["protocolFilter"]
    ptype = F.upper(F.coalesce(pf["type"], F.lit("")))
    name = F.lower(F.coalesce(F.when(ptype == "NAMED_PROTOCOL", pf["protocol"]["name"]).when(
        ptype == "PRESET", pf["preset"]["name"]), F.lit("")))
    v6 = F.upper(F.coalesce(scope["ipVersion"], F.lit(""))) == "IPV6"
    negated = F.coalesce(pf["matchOpposite"], F.lit(False))
    judged = pf.isNotNull() & ~v6 & ~negated & ptype.isin("NAMED_PROTOCOL", "PRESET")
    protos = (
        F.when(judged & name.isin("tcp", "udp"), F.array(name))
        .when(judged & (name == "tcp_udp"), F.array(F.lit("tcp"), F.lit("udp")))
        .when(judged & name.isin("icmp", "icmpv6"), F.array(F.lit("icmp"))).otherwise(F.array(F.lit("ip"))))
    proto_caveat = _first(
        F.when(v6, "IPv6-only policy unsupported"), F.when(negated, "negated protocol filter unsupported"),
        F.when(pf.isNotNull() & ~ptype.isin("NAMED_PROTOCOL", "PRESET"), "unsupported protocol filter"),
        F.when(judged & ~name.isin("", "ip", "any", "all", "tcp", "udp", "tcp_udp", "icmp", "icmpv6"),
               "unsupported protocol"))
    caveat = _first(
        F.col("source_caveat"), F.col("destination_caveat"), proto_caveat,
        F.when(F.size("source_ports") > 0, SOURCE_PORT),
        F.when(F.size(F.coalesce("i.connectionStateFilter", F.array())) > 0,
               "connection-state match unavailable from aggregated flow data"),
        F.when(F.coalesce("i.ipsecFilter", F.lit("")) != "", "IPsec match unavailable from flow data"),
        F.when(F.ltrim("i.schedule").startswith("{"),
               "scheduled policy cannot be evaluated over an aggregated scan window"))
    any_port = F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(any_port)
    out = rows.withColumns({"protos": protos, "caveat": caveat}).select(
        "source", "file", "n", "i", "p", "caveat", "protos", "source_zone", "destination_zone",
        F.posexplode("source_cidrs").alias("q1", "r_src"), "destination_cidrs",
        some("source_ports").alias("sports"), some("destination_ports").alias("dports"))
    out = out.select("*", F.posexplode("destination_cidrs").alias("q2", "r_dst"))
    out = out.select("*", F.posexplode("sports").alias("q3", "sport"))
    out = out.select("*", F.posexplode("dports").alias("q4", "dport"))
    out = out.select("*", F.posexplode("protos").alias("q5", "r_proto"))
    word = F.col("p.action.type")
    raw = F.concat(F.lit('unifi policy "'), F.coalesce("i.name", F.lit("")), F.lit('": '), F.lower(word), F.lit(" "),
                   "r_src", F.lit("->"), "r_dst")
    seq = F.array("q1", "q2", "q3", "q4", "q5")
    return out.select(
        "source", F.concat(F.lit("ZONE:"), "source_zone", F.lit(" -> "), "destination_zone").alias("ruleset"),
        F.when(F.upper(word) == "ALLOW", "permit").otherwise("deny").alias("action"), seq.alias("seq"), "r_proto",
        "r_src", "r_dst", F.col("dport.lo").alias("port_lo"), F.col("dport.hi").alias("port_hi"),
        F.coalesce("i.index", F.lit(0)).alias("line"), raw.alias("raw"), "caveat", "file", "n")


def controller_tables(files: DataFrame) -> dict[str, DataFrame]:
    """Normalised tables of controllers; ``files`` is (source, file, content)."""
    items = materialize(controller_items(files), "items")
    nets = _networks(items)
    devices = items.filter("kind <> 'unknown'").select("source").distinct().select(
        "source", F.col("source").alias("device"), F.lit("unifi").alias("vendor"), F.lit(False).alias("routing"))
    names = devices.select("source", "device")
    ident = F.concat_ws("|", "file", F.col("n").cast("string"))
    api = F.col("kind") == "api-network"
    vlans = nets.select(
        "source", F.when(api, F.col("i.vlanId")).otherwise(F.coalesce("i.vlan", F.lit(0))).alias("id"),
        F.coalesce("i.name", F.lit("")).alias("name"), "subnet",
        F.when(api, F.lower(F.coalesce("i.management", F.lit("")))).otherwise(
            F.coalesce("i.purpose", F.lit(""))).alias("purpose"),
        F.col("n").alias("ord")).join(names, "source")
    gear = items.filter(F.col("kind").isin("device", "api-device")).select(
        "source", ident.alias("iface"), F.col("n").alias("ord"),
        _first(F.col("i.name"), F.col("i.mac"), F.col("i.macAddress")).alias("name"),
        _first(F.col("i.model"), F.when(F.col("kind") == "device", F.col("i.type"))).alias("model"),
        F.lit(0).alias("vlan"), _first(F.col("i.mac"), F.col("i.macAddress")).alias("mac"),
        _first(F.col("i.ip"), F.col("i.ipAddress")).alias("ip"))
    routed = nets.filter(api & (F.col("subnet") != "") & F.coalesce("i.enabled", F.lit(False))
                         & (F.upper("i.management") == "GATEWAY")).select(
        "source", ident.alias("iface"), F.col("n").alias("ord"), F.coalesce("i.name", F.lit("")).alias("name"),
        F.lit("").alias("model"), F.coalesce("i.vlanId", F.lit(0)).alias("vlan"), F.lit("").alias("mac"),
        F.col("subnet").alias("ip"))
    both = gear.withColumn("ip", F.when(F.col("ip") != "", text.controller_address("ip")).otherwise("")).unionByName(routed)
    flags = {c: F.lit(False) for c in ("switchport", "trunk", "shutdown")}
    interfaces = both.drop("ip").withColumns(flags).join(names, "source")
    prefixes = both.filter("ip <> ''").select(
        "source", "iface", F.lit(0).alias("pos"), F.col("ip").alias("cidr")).join(names, "source")
    legacy_dns = F.array_compact(F.array(*[F.nullif(f"i.dhcpd_dns_{i}", F.lit("")) for i in range(1, 5)]))
    dhcp = F.col("i.ipv4Configuration.dhcpConfiguration")
    serves = F.when(api, (F.upper(dhcp["mode"]) == "SERVER") & (F.col("subnet") != "")).otherwise(F.col("i.dhcpd_enabled"))
    pools = nets.filter(serves).select(
        "source", F.col("n").alias("ord"), F.col("subnet").alias("network"),
        F.when(api, _first(dhcp["gatewayIpAddressOverride"], F.col("i.ipv4Configuration.hostIpAddress")))
        .otherwise(F.coalesce("i.dhcpd_gateway", F.lit(""))).alias("router"),
        F.when(api, dhcp["dnsServerIpAddressesOverride"]).otherwise(legacy_dns).alias("dns")).join(names, "source")
    raw = _legacy_rules(items, nets).unionByName(_policy_rules(items, nets))
    order = Window.partitionBy("source", "ruleset").orderBy("file", "n", "seq")
    rules = raw.withColumn("idx", F.row_number().over(order) - 1).drop("seq", "file", "n").join(names, "source")
    rulesets = rules.select("source", "device", "ruleset").distinct().withColumn("default_action", F.lit("permit"))
    bindings = interfaces.filter(F.lit(False)).select(
        "source", "iface", F.lit("").alias("ruleset"), F.lit("").alias("direction"))
    return {"devices": devices, "interfaces": interfaces, "prefixes": prefixes, "bindings": bindings, "vlans": vlans,
            "pools": pools, "rulesets": rulesets, "rules": rules, "warnings": _controller_warnings(items, nets, rules)}


def _controller_warnings(items: DataFrame, nets: DataFrame, rules: DataFrame) -> DataFrame:
    off = ~F.coalesce("i.enabled", F.lit(False))
    verb = F.upper(F.when(F.col("kind") == "policy", F.coalesce("p.action.type", F.lit(""))).otherwise(
        F.coalesce("action", F.lit(""))))
    known = F.when(F.col("kind") == "policy", verb.isin("ALLOW", "BLOCK", "REJECT")).otherwise(
        verb.isin("ACCEPT", "DROP", "REJECT"))
    ruled = F.col("kind").isin("rule", "policy")
    extra = F.size(F.coalesce("i.ipv4Configuration.additionalHostIpSubnets", F.array()))
    seen = items.groupBy("source").agg(
        F.count_if(ruled & known & off).alias("off"), F.count_if(ruled & ~known).alias("odd"),
        F.count_if(F.col("kind") == "unknown").alias("strange"),
        F.sum(F.when(F.col("kind") == "api-network", extra).otherwise(0)).alias("more"))
    lines = {"off": "%d firewall rule(s) disabled and skipped",
             "odd": "%d firewall rule(s) with unrecognized action; skipped",
             "strange": "%d JSON item(s) not recognized as network/rule/device; skipped",
             "more": "%d additional network subnet(s) are not represented by the single-subnet VLAN model"}
    entries = F.array(*[F.struct(F.col(c).alias("n"), F.format_string(m, F.col(c)).alias("warning"))
                        for c, m in lines.items()])
    counted = seen.select("source", F.inline(entries)).filter("n > 0").select("source", "warning")
    return counted.unionByName(_caveat_warning(rules, "%d firewall rule(s) carry a caveat and are not evaluated"))


def ingest(
    files: DataFrame, controller: str = "unifi-controller", tables: tuple[str, ...] = (),
) -> dict[str, DataFrame]:
    """Mixed batch of (source, content): router files one device each, controller
    files one controller; both table sets united, odd files as warnings. Tables
    named in ``tables`` are written, so that later joins read small tables."""
    routed = materialize(route(files), "files")
    ios = ios_tables(routed.filter("vendor = 'cisco-ios'").select("source", "content"))
    api = controller_tables(routed.filter("vendor = 'unifi'").select(
        F.lit(controller).alias("source"), F.col("source").alias("file"), "content"))
    out = {n: ios[n].unionByName(api[n], allowMissingColumns=True) for n in api}
    out["routes"] = ios["routes"]
    out["warnings"] = out["warnings"].unionByName(route_warnings(routed))
    return {n: materialize(df, n) if n in tables else df for n, df in out.items()}
