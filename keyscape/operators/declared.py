"""Declared device configs against observed hosts and flows.

Inputs are the normalised ``declared_*`` tables of ``sources.configs``; every
table carries ``source`` (unique per device) and ``device`` (its hostname).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyscape.functions import ip as ipf
from keyscape.operators import ranges
from keyscape.session import materialize

ANY = "0.0.0.0/0"
IMPLICIT = "implicit deny (default)"


def owned_prefixes(interfaces: DataFrame, prefixes: DataFrame, vlans: DataFrame) -> DataFrame:
    """Distinct masked networks of live interfaces and VLANs per device."""
    up = interfaces.filter(~F.col("shutdown")).select("source", "iface")
    own = prefixes.join(up, ["source", "iface"], "left_semi").select("source", "device", "cidr")
    routed = vlans.filter(F.coalesce("subnet", F.lit("")) != "").select(
        "source", "device", F.col("subnet").alias("cidr"))
    return (
        own.unionByName(routed)
        .select("source", "device", ipf.network_cidr("cidr").alias("cidr"))
        .distinct().filter("cidr IS NOT NULL")
    )


def device_identity(devices: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Device type and whether it routes."""
    layer2 = interfaces.groupBy("source").agg(
        F.max(F.col("switchport") | F.lower("name").startswith("vlan")).alias("l2"))
    joined = devices.join(layer2, "source", "left").withColumn(
        "l2", F.coalesce("l2", F.lit(False)))
    ios = F.col("vendor") == "cisco-ios"
    kind = (
        F.when(~ios, "").when(~F.col("l2"), "Cisco IOS router")
        .when(F.col("routing"), "Cisco IOS Layer 3 switch").otherwise("Cisco IOS switch")
    )
    return joined.select("source", "device", "vendor", kind.alias("device_type"),
                         (~ios | ~F.col("l2") | F.col("routing")).alias("routes"))


def _own_addresses(interfaces: DataFrame, prefixes: DataFrame) -> DataFrame:
    up = interfaces.filter(~F.col("shutdown")).select("source", "iface", "name", "mac", "model", "ord")
    return prefixes.filter(ipf.cidr_bits("cidr").isNotNull()).join(up, ["source", "iface"]).select(
        "source", "device", "iface", "name", "cidr", "pos",
        F.substring_index("cidr", "/", 1).alias("ip"))


def _mac(c: str) -> Column:
    return F.lower(F.trim(c))


def device_matches(devices, interfaces, prefixes, nodes) -> DataFrame:
    """Devices found at observed hosts, by own address or by hardware address."""
    kinds = device_identity(devices, interfaces)
    own = _own_addresses(interfaces, prefixes).join(
        nodes.select("ip"), "ip", "left_semi").select("source", "ip", F.lit(False).alias("via_mac"))
    nics = interfaces.filter(~F.col("shutdown") & (F.coalesce("mac", F.lit("")) != "")).select(
        "source", _mac("mac").alias("m"))
    worn = nodes.filter(F.coalesce("mac", F.lit("")) != "").groupBy(_mac("mac").alias("m")).agg(
        F.max("ip").alias("ip"))
    by_mac = nics.join(worn, "m").select("source", "ip", F.lit(True).alias("via_mac"))
    hits = own.unionByName(by_mac).distinct()
    return hits.groupBy("source").agg(
        F.array_sort(F.collect_set("ip")).alias("ips"), F.min("via_mac").alias("by_mac")
    ).join(kinds, "source").select("device", "device_type", "source", "ips", "by_mac")


def adopted_devices(devices, interfaces, prefixes, nodes) -> DataFrame:
    """Controller-managed devices and the host they were seen at; a hardware
    address match beats a possibly stale address."""
    managed = devices.filter(F.col("vendor") == "unifi").select("source")
    nics = interfaces.filter(~F.col("shutdown") & (F.coalesce("mac", F.lit("")) != "")).join(
        managed, "source", "left_semi").select("source", "iface", "name", "model", _mac("mac").alias("m"))
    own = _own_addresses(interfaces, prefixes).groupBy("source", "iface").agg(
        F.min_by("ip", "pos").alias("ip"))
    seen = (
        _own_addresses(interfaces, prefixes).join(nodes.select("ip"), "ip", "left_semi")
        .groupBy("source", "iface").agg(F.max_by("ip", "pos").alias("own_ip")))
    worn = nodes.filter(F.coalesce("mac", F.lit("")) != "").groupBy(_mac("mac").alias("m")).agg(
        F.max("ip").alias("mac_ip"))
    keys = ["source", "iface"]
    return nics.join(own, keys, "left").join(seen, keys, "left").join(worn, "m", "left").select(
        "name", "model", F.coalesce("ip", F.lit("")).alias("ip"),
        F.coalesce("mac_ip", "own_ip", F.lit("")).alias("observed_ip"))


def declared_gateways(devices, interfaces, prefixes, nodes) -> DataFrame:
    """Interface addresses of routing devices whose subnet holds another host."""
    routing = device_identity(devices, interfaces).filter("routes").select("source")
    own = _own_addresses(interfaces, prefixes).join(routing, "source", "left_semi")
    nets = own.select("cidr", F.col("ip").alias("own")).distinct()
    inside = ranges.match(nodes.select(F.col("ip").alias("host")).distinct(), "host", nets, "cidr")
    live = inside.filter(F.col("host") != F.col("own")).select("cidr", "own").distinct()
    return (
        own.join(live.withColumnRenamed("own", "ip"), ["cidr", "ip"], "left_semi")
        .groupBy("ip").agg(F.max_by("device", "source").alias("device"))
    )


def silent_subnets(owned: DataFrame, nodes: DataFrame, zero_coverage: DataFrame) -> DataFrame:
    """Declared networks without an observed member."""
    cidrs = owned.select("cidr").distinct()
    live = ranges.match(nodes.select("ip").distinct(), "ip", cidrs, "cidr").select("cidr").distinct()
    quiet = owned.join(live, "cidr", "left_anti")
    blind = ranges.overlapping(quiet, "cidr", zero_coverage, "cidr").withColumn(
        "in_blind_spot", F.lit(True))
    return quiet.join(blind, "cidr", "left").select(
        "cidr", "device", F.coalesce("in_blind_spot", F.lit(False)).alias("in_blind_spot"))


def undeclared_cidrs(owned: DataFrame, nodes: DataFrame) -> DataFrame:
    """Observed subnets that no declared network contains."""
    # written, so that the CIDR is looked at once for each subnet: as a plain filter it would go
    # below the aggregation of the hosts, to every end of every edge, once for each use
    subnets = materialize(nodes.select(F.col("subnet").alias("cidr")).distinct(), "subnets").filter(
        ipf.cidr_bits("cidr").isNotNull())
    probes = subnets.withColumn("_ip", F.substring_index("cidr", "/", 1))
    covered = ranges.match(probes, "_ip", owned.select(F.col("cidr").alias("o")).distinct(), "o").filter(
        ipf.cidr_bits("o") <= ipf.cidr_bits("cidr")).select("cidr").distinct()
    return subnets.join(covered, "cidr", "left_anti")


# --- policy ----------------------------------------------------------------

def applications(devices, interfaces, prefixes, bindings, vlans, rulesets) -> DataFrame:
    """Enforcement points as (app, source, device, ruleset, kind, ord, cidr).

    ``kind`` says which side has to be inside the networks: ``in`` and ``lan``
    the client, ``out`` and ``wan`` the server, ``zone`` either.
    """
    up = interfaces.filter(~F.col("shutdown")).select("source", "iface")
    ios = devices.filter(F.col("vendor") != "unifi").select("source", "device")
    bound = (
        bindings.join(up, ["source", "iface"], "left_semi").join(ios, "source")
        .join(rulesets.select("source", "ruleset"), ["source", "ruleset"], "left_semi")
        .select("source", "device", "ruleset", "iface",
                F.col("direction").alias("kind"))
        .join(prefixes.select("source", "iface", "cidr", F.col("pos").alias("ord")),
              ["source", "iface"])
        .select(F.concat_ws("|", "source", "iface", "ruleset", "kind").alias("app"), "source",
                "device", "ruleset", "kind", "ord", "cidr")
    )
    unifi = devices.filter(F.col("vendor") == "unifi").select("source", "device")
    sets = rulesets.drop("device").join(unifi, "source").select("source", "device", "ruleset")
    kind = (
        F.when(F.col("ruleset").isin("LAN_IN", "GUEST_IN"), "lan")
        .when(F.col("ruleset") == "WAN_IN", "wan")
        .when(F.col("ruleset").startswith("ZONE:"), "zone")
    )
    sets = sets.withColumn("kind", kind).filter("kind IS NOT NULL")
    guest = F.coalesce("purpose", F.lit("")) == "guest"
    lans = vlans.filter(F.coalesce("subnet", F.lit("")) != "").select(
        "source", F.when(guest, "GUEST_IN").otherwise("LAN_IN").alias("ruleset"),
        F.col("subnet").alias("cidr"), F.col("ord"))
    own = materialize(owned_prefixes(interfaces, prefixes, vlans), "owned").select(
        "source", "cidr", F.lit(0).alias("ord"))
    scoped = sets.filter("kind = 'lan'").join(lans, ["source", "ruleset"]).unionByName(
        sets.filter("kind <> 'lan'").join(own, "source"))
    scoped = scoped.select(F.concat_ws("|", "source", "ruleset").alias("app"), "source", "device",
                           "ruleset", "kind", "ord", "cidr")
    rows = bound.unionByName(scoped).withColumn("cidr", ipf.network_cidr("cidr"))
    return rows.distinct().filter("cidr IS NOT NULL")


def governed_flows(edges: DataFrame, apps: DataFrame) -> DataFrame:
    """(edge, application) pairs where the flow crosses the enforcement point.

    Networks are looked up once per distinct host. An edge then meets the applications
    that one of its ends is in, and for each of them the other end's networks there. A
    flow that stays inside one network is never judged, nor is one with an end that is no
    address.
    """
    # written, so that an address is parsed once for each host: as a filter of the edges it
    # would be parsed for both ends of every edge, in each place that reads them
    hosts = materialize(edges.select(F.explode(F.array("src", "dst")).alias("ip")).distinct().select(
        "ip", F.coalesce(ipf.is_ip("ip"), F.lit(False)).alias("address")), "hosts")
    odd = hosts.filter("NOT address").select(F.col("ip").alias("_odd"))
    inside = ranges.match(hosts.filter("address").select("ip"), "ip", apps, "cidr")
    keys = ["app", "source", "device", "ruleset", "kind"]
    member = materialize(inside.groupBy("ip", *keys).agg(
        F.min_by("cidr", F.struct("ord", "cidr")).alias("first"), F.collect_set("cidr").alias("nets")), "members")
    other = member.select(F.col("ip").alias("_ip"), F.col("app").alias("_app"), F.col("nets").alias("_nets"))

    def met(side: str, opposite: str, kinds: list[str]) -> DataFrame:
        own = member.filter(F.col("kind").isin(kinds)).withColumnRenamed("ip", "_own")
        rows = edges.filter(F.col(opposite).isNotNull()).join(own, F.col(side) == F.col("_own")).join(
            odd, F.col(opposite) == F.col("_odd"), "left_anti")
        return rows.join(other, (F.col(opposite) == F.col("_ip")) & (F.col("app") == F.col("_app")), "left")

    outside = F.col("_ip").isNull()
    enters = (
        F.when(F.col("kind") == "in", outside)
        .when(F.col("kind") == "lan", outside | ~F.array_contains("_nets", F.col("first")))
        .otherwise(outside | ~F.arrays_overlap("_nets", "nets")))
    columns = [*edges.columns, "app", "source", "device", "ruleset"]
    entering = met("src", "dst", ["in", "lan", "zone"]).filter(enters).select(*columns)
    leaving = met("dst", "src", ["out", "wan", "zone"]).filter(outside).select(*columns)
    return entering.unionByName(leaving)


def _chains(ends: DataFrame, rules: DataFrame, cidr: str, name: str) -> DataFrame:
    """(source, ruleset, ip, ``name``): for each end of a ruleset's flows the networks that
    hold it, of those that the ruleset's own rules have on this side; one token for each of
    the ruleset's own prefix lengths is looked up."""
    nets = rules.select("source", "ruleset", ranges.network_token(cidr).alias("_token")).distinct()
    bits = F.array_sort(F.collect_set(F.substring_index("_token", "/", 1).cast("int")))
    own = nets.groupBy("source", "ruleset").agg(bits.alias("_bits"))
    token = lambda b: F.when((b <= 32) | F.col("_key").startswith("6"), F.concat_ws(
        "/", b.cast("string"), ipf.key_prefix(F.col("_key"), b)))
    probes = ends.withColumn("_key", ipf.ip_key("ip")).join(own, ["source", "ruleset"]).select(
        "source", "ruleset", "ip", F.explode(F.array_compact(F.transform("_bits", token))).alias("_token"))
    return probes.join(nets, ["source", "ruleset", "_token"]).groupBy("source", "ruleset", "ip").agg(
        F.array_sort(F.collect_list("_token")).alias(name))


def decisions(edges: DataFrame, apps: DataFrame, rules: DataFrame, rulesets: DataFrame) -> DataFrame:
    """First matching rule per (application, edge, evaluated transport).

    Each ruleset is indexed by the networks of its own rules: an end of a flow is looked up
    among them once for each ruleset that judges it, and an edge meets only the pairs of
    networks of that ruleset that hold both its ends, then the rules of a pair. What other
    rulesets hold, in number or in prefix lengths, adds nothing to it.

    Flows of one ruleset whose ends are in the same networks, with one port and transport, are
    a class with one answer: rules are looked up for classes, and flows take their class's.
    ``first_denied`` is the position of the first transport of the flow that is denied.
    """
    usable = materialize(rules.filter(
        (F.coalesce("caveat", F.lit("")) == "")
        & ipf.cidr_bits("r_src").isNotNull() & ipf.cidr_bits("r_dst").isNotNull()), "usable-rules")
    flows = materialize(governed_flows(edges, apps).join(
        rulesets.select("source", "ruleset", "default_action"), ["source", "ruleset"]), "governed-flows")
    protos = F.when(F.col("proto") != "", F.array("proto")).otherwise(F.array(F.lit("tcp"), F.lit("udp")))
    rows = flows
    for side in ("src", "dst"):
        ends = flows.select("source", "ruleset", F.col(side).alias("ip")).distinct()
        chain = _chains(ends, usable, f"r_{side}", f"_{side}_nets").withColumnRenamed("ip", side)
        rows = rows.join(chain, ["source", "ruleset", side], "left")
    none = F.array().cast("array<string>")
    rows = materialize(rows.withColumns({
        c: F.coalesce(c, none) for c in ("_src_nets", "_dst_nets")}), "flow-networks")
    same = ["source", "ruleset", "default_action", "_src_nets", "_dst_nets", "port", "proto"]
    probes = rows.select(*same).distinct().select(
        *same, F.explode_outer("_src_nets").alias("_s")).select(
        "*", F.explode_outer("_dst_nets").alias("_d")).select(
        "*", F.posexplode(protos).alias("p_ord", "p"))
    table = usable.select(
        F.col("source").alias("_rsource"), F.col("ruleset").alias("_rruleset"), "idx", "action",
        "r_proto", "line", "raw", "port_lo", "port_hi",
        ranges.network_token("r_src").alias("_rs"), ranges.network_token("r_dst").alias("_rd"))
    any_port = (F.col("port_lo") == 0) & (F.col("port_hi") == 0)
    hit = (
        (F.col("source") == F.col("_rsource")) & (F.col("ruleset") == F.col("_rruleset"))
        & (F.col("_s") == F.col("_rs")) & (F.col("_d") == F.col("_rd"))
        & ((F.col("r_proto") == "ip") | (F.col("r_proto") == F.col("p")))
        & (any_port | F.col("port").between(F.col("port_lo"), F.col("port_hi")))
    )
    matched = probes.join(table, hit, "left")
    rule = F.when(F.col("idx").isNotNull(), F.struct("idx", "action", "line", "raw"))
    answers = matched.groupBy(*same, "p_ord", "p").agg(F.min(rule).alias("rule"))
    answer = F.struct("p_ord", "p", "rule")
    classes = answers.groupBy(*same).agg(
        F.collect_list(answer).alias("_answers"), F.min(F.when(_denied(), F.col("p_ord"))).alias("first_denied"))
    carried = [c for c in edges.columns if c not in ("src", "dst", "port", "proto")]
    one = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in same])
    return rows.join(classes.withColumnsRenamed({c: f"_of_{c}" for c in same}), one).select("*", F.inline("_answers")).select(
        "app", "source", "device", "ruleset", "default_action", "src", "dst", "port", "proto",
        "p_ord", "p", "rule", "first_denied", *carried)


def _denied() -> Column:
    return F.when(F.col("rule").isNull(), F.col("default_action") == "deny").otherwise(F.col("rule.action") == "deny")


def skipped_rules(rules: DataFrame) -> DataFrame:
    return rules.agg(F.count_if(F.coalesce("caveat", F.lit("")) != "").alias("skipped_rules"))


def violations(decided: DataFrame, rules: DataFrame) -> DataFrame:
    """Flows a declared ruleset denies, with the rule of the first denied
    transport. A device with rules that could not be judged is only partial."""
    carried = [c for c in ("service", "evidence", "conn_count", "first_seen", "last_seen")
               if c in decided.columns]
    flows = decided.filter(F.col("p_ord") == F.col("first_denied"))
    partial = rules.filter(F.coalesce("caveat", F.lit("")) != "").select("source").distinct()
    flagged = flows.join(partial.withColumn("_p", F.lit("partial")), "source", "left")
    return flagged.select(
        "device", "source", "ruleset", "app", F.coalesce("rule.line", F.lit(0)).alias("line"),
        F.coalesce("rule.raw", F.lit(IMPLICIT)).alias("raw"), "src", "dst", "port", "proto",
        F.coalesce("_p", F.lit("full")).alias("confidence"), *carried)


def unused_permits(decided: DataFrame, rules: DataFrame, apps: DataFrame) -> DataFrame:
    """Judgeable permits of applied rulesets that decided no flow."""
    used = decided.filter(F.col("rule.action") == "permit").select(
        "source", "ruleset", F.col("rule.idx").alias("idx")).distinct()
    applied = apps.select("source", "ruleset").distinct()
    return (
        rules.filter((F.coalesce("caveat", F.lit("")) == "") & (F.col("action") == "permit"))
        .join(applied, ["source", "ruleset"], "left_semi")
        .join(used, ["source", "ruleset", "idx"], "left_anti")
        .select("device", "ruleset", "idx", "line", "raw")
    )


def findings(
    devices, warnings, matches, adopted, gateways, silent, undeclared, denied, unused, skipped
) -> DataFrame:
    """(pos, finding) lines: parser warnings (source, warning) with the device they are
    of, what was declared, what was matched, and the policy's counts."""
    # The wording of the lines.
    named = devices.select("source", F.col("device").alias("host"))
    text_of = lambda c: F.col(c).cast("string")
    out = warnings.join(named, "source", "left").select(
        F.when(F.col("host").isNull(), 0).otherwise(1).alias("pos"),
        F.concat(F.lit("device configs"), F.when(F.col("host").isNull(), "").otherwise(
            F.concat(F.lit(" ("), "host", F.lit(")"))), F.lit(": "), "warning").alias("finding"))
    sizes = {
        "devices": devices, "cisco": devices.filter("vendor = 'cisco-ios'"),
        "matched": matches.filter("device_type <> ''"), "adopted": adopted,
        "seen": adopted.filter("observed_ip <> ''"), "gateways": gateways, "silent": silent,
        "undeclared": undeclared, "denied": denied, "unused": unused}
    rows = skipped.select(F.lit("skipped").alias("what"), F.col("skipped_rules").cast("bigint").alias("n"))
    for name, df in sizes.items():
        rows = rows.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n"))
    counted = rows.agg(*[
        F.max(F.when(F.col("what") == name, F.col("n"))).alias(name) for name in ("skipped", *sizes)])
    lines = F.array(
        F.struct(F.lit(2).alias("pos"), F.concat(
            F.lit("device configs: "), text_of("devices"), F.lit(" device(s) declared, "), text_of("gateways"),
            F.lit(" gateway(s) identified, "), text_of("silent"), F.lit(" silent subnet(s), "),
            text_of("undeclared"), F.lit(" undeclared CIDR(s)")).alias("finding")),
        F.struct(F.lit(3).alias("pos"), F.when(F.col("cisco") > 0, F.concat(
            F.lit("device configs: "), text_of("matched"), F.lit(" of "), text_of("cisco"),
            F.lit(" Cisco IOS device(s) matched observed map nodes"))).alias("finding")),
        F.struct(F.lit(4).alias("pos"), F.when(F.col("adopted") > 0, F.concat(
            F.lit("device configs: "), text_of("seen"), F.lit(" of "), text_of("adopted"),
            F.lit(" adopted UniFi device(s) matched observed map nodes"))).alias("finding")),
        F.struct(F.lit(5).alias("pos"), F.concat(
            F.lit("declared policy: "), text_of("denied"), F.lit(" denied-but-observed violation(s), "),
            text_of("unused"), F.lit(" unused permit(s), "), text_of("skipped"),
            F.lit(" rule(s) skipped (caveated)")).alias("finding")))
    return out.unionByName(counted.select(F.inline(lines)).filter("finding IS NOT NULL"))
