"""Briefing map as tables: groups, nodes, bundled edges, gateways, members.

Host-level steps are joins and aggregations. Only results that are bounded by
the map's own limits (groups of an overview, top hosts of a segment, the edge
budget) use ordered limits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyscape import config
from keyscape.functions import ip as ipf
from keyscape.functions import ports, text
from keyscape.operators import ranges
from keyscape.operators.roles import top_role
from keyscape.session import materialize
from keyscape.sources.telemetry import in_cidr

PRIVATE_WORDS, PUBLIC_WORDS = ("private", "internal"), ("public", "external")


@dataclass
class MapOptions:
    """Overlays are small tables: segments (cidr, name), labels (cidr, label),
    pinned (ip), devices (ip, name, model), gateways (ip, device), node_flags
    (ip, flag), edge_flags (src, dst, port, flag).

    An overview keeps everything unless a limit is given: boxes of segments, hosts
    shown of each, hosts shown of all if ``retain_all_private``, and groups, nodes
    and edges together. What a limit leaves out is counted in the overview's
    ``omitted`` table."""

    prefix: int = config.GROUP_PREFIX
    min_conns: int = config.MAP_MIN_CONNS
    focus: str | None = None
    retain_all_private: bool = False
    max_segments: int | None = None
    hosts_per_segment: int | None = None
    max_private_hosts: int | None = None
    max_elements: int | None = None
    segments: DataFrame | None = None
    labels: DataFrame | None = None
    pinned: DataFrame | None = None
    devices: DataFrame | None = None
    gateways: DataFrame | None = None
    node_flags: DataFrame | None = None
    edge_flags: DataFrame | None = None


def condensed(**options) -> MapOptions:
    """Options with the limits of a one-page overview."""
    limits = {
        "max_segments": config.MAP_SEGMENT_MAX_GROUPS,
        "hosts_per_segment": config.MAP_SEGMENT_TOP_HOSTS,
        "max_private_hosts": config.MAP_ALL_PRIVATE_CAP,
        "max_elements": config.MAP_TARGET_ELEMENTS,
    }
    return MapOptions(**limits | options)


def focus_nodes(nodes: DataFrame, focus: str | None) -> DataFrame:
    if not focus:
        return nodes
    if focus in PRIVATE_WORDS:
        return nodes.filter(ipf.is_private("ip"))
    if focus in PUBLIC_WORDS:
        return nodes.filter(ipf.is_ip("ip") & ~ipf.is_private("ip"))
    return nodes.filter(in_cidr("ip", focus))


def focus_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in focus."""
    ips = nodes.select("ip")
    return edges.join(ips.withColumnRenamed("ip", "src"), "src", "left_semi").join(
        ips.withColumnRenamed("ip", "dst"), "dst", "left_semi")


def grouping(nodes: DataFrame, options: MapOptions) -> DataFrame:
    """Add the grouping CIDR: the most specific segment, else the prefix."""
    auto = ipf.group_cidr("ip", options.prefix)
    if options.segments is None:
        return nodes.withColumn("cidr", auto)
    seg = ranges.longest_match(
        nodes, "ip", options.segments.select(F.col("cidr").alias("seg")), "seg")
    return nodes.join(seg, "ip", "left").withColumn("cidr", F.coalesce("seg", auto)).drop("seg")


def _flagged(nodes: DataFrame, options: MapOptions) -> DataFrame:
    """Add the overlay columns every later rule looks at."""
    out = nodes
    if options.node_flags is not None:
        out = out.join(options.node_flags, "ip", "left")
    else:
        out = out.withColumn("flag", F.lit(None).cast("string"))
    if options.pinned is not None:
        out = out.join(options.pinned.select("ip", F.lit(True).alias("pinned")), "ip", "left")
    else:
        out = out.withColumn("pinned", F.lit(False))
    if options.devices is not None:
        out = out.join(options.devices.filter("name <> ''").select(
            "ip", F.col("name").alias("device"), F.col("model").alias("device_type")), "ip", "left")
    else:
        out = out.withColumn("device", F.lit(None).cast("string")).withColumn(
            "device_type", F.lit(None).cast("string"))
    return out.fillna({"flag": "", "pinned": False, "device": "", "device_type": ""})


def _named(groups: DataFrame, options: MapOptions) -> Column:
    label = F.col("cidr")
    if options.labels is not None:
        label = F.when(F.coalesce("label_name", F.lit("")) != "",
                       F.concat_ws(" — ", "cidr", "label_name")).otherwise(label)
    if options.segments is not None:
        label = F.when(F.coalesce("seg_name", F.lit("")) != "",
                       F.concat_ws(" — ", "cidr", "seg_name")).otherwise(label)
    return label


def _with_names(groups: DataFrame, options: MapOptions) -> DataFrame:
    if options.labels is not None:
        groups = groups.join(options.labels.groupBy("cidr").agg(
            F.min("label").alias("label_name")), "cidr", "left")
    if options.segments is not None:
        groups = groups.join(options.segments.groupBy("cidr").agg(
            F.max("name").alias("seg_name")), "cidr", "left")
    return groups


def groups(grouped: DataFrame, options: MapOptions) -> DataFrame:
    """Group boxes with sensors; groups below the minimum share one box."""
    sizes = grouped.groupBy("cidr").agg(F.count("*").alias("hosts"))
    sensors = (
        grouped.select("cidr", F.explode("sensors").alias("s")).distinct()
        .groupBy("cidr").agg(F.array_sort(F.collect_list("s")).alias("sensors")))
    big = _with_names(sizes.filter(F.col("hosts") >= config.SPARSE_GROUP_MIN_HOSTS), options).join(
        sensors, "cidr", "left").select(
        F.concat(F.lit("g:"), F.col("cidr")).alias("id"), "cidr", _named(None, options).alias("label"),
        "hosts", F.coalesce("sensors", F.array().cast("array<string>")).alias("sensors"),
        F.lit(False).alias("sparse"))
    small = (
        sizes.filter(F.col("hosts") < config.SPARSE_GROUP_MIN_HOSTS)
        .agg(F.sum("hosts").alias("hosts")).filter("hosts > 0")
        .select(F.lit("g:sparse").alias("id"), F.lit("").alias("cidr"),
                F.concat(F.lit("sparse hosts ("), F.col("hosts").cast("string"), F.lit(")")).alias("label"),
                "hosts", F.array().cast("array<string>").alias("sensors"), F.lit(True).alias("sparse")))
    return big.unionByName(small)


def with_group_ids(grouped: DataFrame) -> DataFrame:
    sizes = grouped.groupBy("cidr").agg(F.count("*").alias("_n"))
    gid = F.when(F.col("_n") < config.SPARSE_GROUP_MIN_HOSTS, "g:sparse").otherwise(
        F.concat(F.lit("g:"), F.col("cidr")))
    return grouped.join(sizes, "cidr").withColumn("gid", gid).drop("_n")


def host_rows(nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Map attributes of every host."""
    evidence = F.flatten(F.transform("roles", lambda r: r["evidence"]))
    if "terrain_evidence" in nodes.columns:
        evidence = F.concat(F.coalesce("terrain_evidence", F.array().cast("array<string>")), evidence)
    return nodes.withColumns({
        "label": text.display_label("hostnames", "ip"),
        "role": top_role(),
        "tier": text.tier_of(top_role(), "composite"),
        "evidence": evidence,
        "vendor": text.vendor_for_mac(F.coalesce("mac", F.lit(""))),
    })


def collapsible() -> Column:
    """Plain clients that only show as a count of their group."""
    return (
        (F.col("tier") == "client") & (F.col("role") == config.ROLE_UNKNOWN)
        & (F.col("composite") < config.CLIENT_AGG_MAX_COMPOSITE)
        & ~F.col("pinned") & (F.col("device") == "") & (F.col("flag") == ""))


def endpoints(nodes: DataFrame, visible: str = "visible") -> DataFrame:
    """Where every host's edges attach: itself or its group's client node."""
    at = F.when(F.col(visible), F.col("ip")).otherwise(F.concat("gid", F.lit(":clients")))
    return nodes.select("ip", at.alias("endpoint"), "gid", visible)


def _shown(hosts: DataFrame) -> DataFrame:
    """Visible hosts as map nodes, imported devices stamped on."""
    imported = F.col("device") != ""
    detail = F.when(F.col("device_type") != "", F.concat(
        F.col("device"), F.lit(" ("), F.col("device_type"), F.lit(")"))).otherwise(F.col("device"))
    note = F.concat(F.lit("device identity imported from device config: "), detail)
    return hosts.select(
        F.col("ip").alias("id"), F.col("gid").alias("group"), "label",
        F.when(imported, "NetworkGear").otherwise(F.col("role")).alias("role"),
        F.when(imported, "core").otherwise(F.col("tier")).alias("tier"), "composite", "rank",
        F.lit(False).alias("gateway"), F.lit(False).alias("inferred"),
        F.lit(0).cast("bigint").alias("agg_count"),
        F.when(imported, F.concat("evidence", F.array(note))).otherwise(F.col("evidence")).alias("evidence"),
        F.col("flag").alias("drift"), "device", "device_type", "vendor")


def _synthetic(df: DataFrame, id_: Column, group: Column, label: Column, role: str, tier: str,
               gateway: bool = False, inferred: bool = False, agg: Column | None = None,
               evidence: Column | None = None, drift: str = "") -> DataFrame:
    none = F.array().cast("array<string>")
    return df.select(
        id_.alias("id"), group.alias("group"), label.alias("label"), F.lit(role).alias("role"),
        F.lit(tier).alias("tier"), F.lit(0.0).alias("composite"), F.lit(0).alias("rank"),
        F.lit(gateway).alias("gateway"), F.lit(inferred).alias("inferred"),
        (agg if agg is not None else F.lit(0)).cast("bigint").alias("agg_count"),
        (F.array(evidence) if evidence is not None else none).alias("evidence"),
        F.lit(drift).alias("drift"), F.lit("").alias("device"), F.lit("").alias("device_type"),
        F.lit("").alias("vendor"))


def client_nodes(hosts: DataFrame, noun: str = "workstations") -> DataFrame:
    hidden = hosts.filter(~F.col("visible")).groupBy("gid").agg(F.count("*").alias("n"))
    return _synthetic(hidden, F.concat("gid", F.lit(":clients")), F.col("gid"),
                      F.concat_ws(" ", F.col("n").cast("string"), F.lit(noun)),
                      config.ROLE_UNKNOWN, "client", agg=F.col("n"))


def members(hosts: DataFrame) -> DataFrame:
    """Hosts behind every aggregate node."""
    return hosts.filter(~F.col("visible")).select(
        F.concat("gid", F.lit(":clients")).alias("agg_id"), "ip", "label", "role", "tier",
        "composite", "rank", "vendor")


def _attach(edges: DataFrame, ends: DataFrame) -> DataFrame:
    s = ends.select(F.col("ip").alias("src"), F.col("endpoint").alias("s"), F.col("gid").alias("sg"))
    d = ends.select(F.col("ip").alias("dst"), F.col("endpoint").alias("d"), F.col("gid").alias("dg"))
    return edges.join(s, "src").join(d, "dst")


def bundle_edges(
    edges: DataFrame, ends: DataFrame, min_conns: int = config.MAP_MIN_CONNS,
    edge_flags: DataFrame | None = None,
) -> DataFrame:
    """Edges merged by (visible source, visible target, class). Per-client sums
    come first, so a bundle with very many clients stays a plain count."""
    rows = edges.select("src", "dst", "port", "conn_count")
    if edge_flags is not None:
        rows = rows.join(edge_flags, ["src", "dst", "port"], "left")
    else:
        rows = rows.withColumn("flag", F.lit(None).cast("string"))
    per_client = (
        _attach(rows, ends).filter(F.col("s") != F.col("d"))
        .groupBy("s", "d", ports.service_class("port").alias("cls"), "src")
        .agg(F.sum("conn_count").alias("n"), F.min("flag").alias("lo"), F.max("flag").alias("hi"))
    )
    merged = per_client.groupBy("s", "d", "cls").agg(
        F.count("*").alias("hosts"), F.sum("n").alias("conns"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    drift = F.when(F.col("lo") != F.col("hi"), "changed").otherwise(F.coalesce("lo", F.lit("")))
    label = ports.class_label("cls")
    return (
        merged.withColumn("drift", drift)
        .filter((F.col("conns") >= min_conns) | (F.col("drift") != ""))
        .select(
            F.col("s").alias("src"), F.col("d").alias("dst"), label.alias("class"),
            ports.class_color("cls").alias("color"),
            F.when(F.col("hosts") > 1, F.concat(F.col("hosts").cast("string"), F.lit(" hosts → "), label))
            .otherwise(label).alias("label"),
            "hosts", "conns", (1 + F.log1p(F.col("hosts").cast("double"))).alias("width"), "drift"))


def edge_members(edges: DataFrame, ends: DataFrame, src: str, dst: str, label: str) -> DataFrame:
    """Real hosts behind the aggregated end(s) of one bundle."""
    rows = _attach(edges.select("src", "dst", "port"), ends).filter(
        (F.col("s") == src) & (F.col("d") == dst)
        & (ports.class_label(ports.service_class("port")) == label))
    return rows.select(F.explode(F.array("src", "dst")).alias("ip")).filter(
        ~F.col("ip").isin(src, dst)).distinct()


def crossing_groups(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """Groups with traffic to another group."""
    pairs = _attach(edges.select("src", "dst"), ends).filter("sg <> dg").select("sg", "dg").distinct()
    return pairs.select(F.explode(F.array("sg", "dg")).alias("gid")).distinct()


def observed_gateways(gateways: DataFrame) -> DataFrame:
    # The wording of notes and labels, here and in the next functions.
    note = F.concat(F.lit("MAC answered for "), F.col("ip_count").cast("string"),
                    F.lit(" distinct IPs (sensor "), F.col("sensor"), F.lit(") — observed L2 convergence"))
    return _synthetic(gateways, F.concat(F.lit("gw:"), "mac"), F.lit(""),
                      F.concat(F.lit("gateway "), "mac"), "Gateway", "core", gateway=True, evidence=note)


def inferred_gateways(group_rows: DataFrame, crossing: DataFrame) -> DataFrame:
    hit = group_rows.filter("cidr <> ''").join(
        crossing.withColumnRenamed("gid", "id"), "id", "left_semi")
    return _synthetic(hit, F.concat("id", F.lit(":gw")), F.col("id"), F.lit("gateway (inferred)"),
                      "Gateway", "core", gateway=True, inferred=True,
                      evidence=F.lit("synthesized from cross-subnet traffic — no L2 evidence on this grid"))


def declare_gateways(
    nodes: DataFrame, group_rows: DataFrame, hosts: DataFrame, options: MapOptions
) -> tuple[DataFrame, DataFrame]:
    """Declared gateways onto the map: badge the host shown at the address, else
    one gateway node per segment box, replacing an inferred one. Returns the
    nodes and the groups that are covered."""
    note = F.concat(F.lit("gateway declared by "), F.col("gw_device"), F.lit(" config"))
    gates = options.gateways.select(F.col("ip").alias("id"), F.col("device").alias("gw_device"))
    badged = nodes.join(gates, "id", "left").withColumn("_hit", F.col("gw_device").isNotNull())
    badged = badged.withColumns({
        "gateway": F.col("gateway") | F.col("_hit"),
        "label": F.when(F.col("_hit"), F.concat("label", F.lit(" (declared)"))).otherwise(F.col("label")),
        "evidence": F.when(F.col("_hit"), F.concat("evidence", F.array(note))).otherwise(F.col("evidence")),
    })
    covered = badged.filter("_hit").select(F.col("group").alias("gid")).distinct()
    placed = grouping(options.gateways, options)
    sized = hosts.select("cidr", "gid").distinct()
    boxes = group_rows.filter("cidr <> ''").select(F.col("id").alias("gid"))
    fresh = (
        placed.join(sized, "cidr").join(boxes, "gid", "left_semi").join(covered, "gid", "left_anti")
        .join(badged.filter("_hit").select(F.col("id").alias("ip")), "ip", "left_anti")
        .groupBy("gid").agg(F.min_by("device", "ip").alias("gw_device")))
    made = _synthetic(fresh, F.concat("gid", F.lit(":gw")), F.col("gid"), F.lit("gateway (declared)"),
                      "Gateway", "core", gateway=True, evidence=note)
    kept = badged.drop("gw_device", "_hit").join(made.select("id"), "id", "left_anti")
    return kept.unionByName(made), covered.unionByName(fresh.select("gid"))


def blind_spots(zero_coverage: DataFrame, focus: str | None = None) -> DataFrame:
    """Finding per uncovered CIDR, limited to a focus CIDR when one is given."""
    rows = zero_coverage.select("cidr").distinct()
    if focus and "/" in focus:
        one = zero_coverage.sparkSession.range(1).select(F.lit(focus).alias("f"))
        rows = ranges.overlapping(rows, "cidr", one, "f")
    # Fixed value: the wording of the line.
    return rows.select("cidr", F.concat(
        F.lit("possible blind spot: "), F.col("cidr"),
        F.lit(" is in scope but produced zero observed traffic")).alias("finding"))


def prepare(nodes: DataFrame, options: MapOptions) -> DataFrame:
    """Hosts in focus with group, overlay flags and visibility."""
    hosts = _flagged(host_rows(with_group_ids(grouping(focus_nodes(nodes, options.focus), options))), options)
    shown = F.lit(True) if options.retain_all_private else ~collapsible()
    return hosts.withColumn("visible", shown)


def detailed(nodes, edges, gateways, zero_coverage, options: MapOptions) -> dict[str, DataFrame]:
    hosts = prepare(nodes, options)
    ends = endpoints(hosts)
    boxes = groups(grouping(focus_nodes(nodes, options.focus), options), options)
    rows = _shown(hosts.filter("visible")).unionByName(client_nodes(hosts))
    if gateways.isEmpty():
        rows = rows.unionByName(inferred_gateways(boxes, crossing_groups(edges, ends)))
    else:
        rows = rows.unionByName(observed_gateways(gateways))
    if options.gateways is not None:
        rows, _ = declare_gateways(rows, boxes, hosts, options)
    return {
        "groups": boxes, "nodes": rows, "members": members(hosts),
        "edges": bundle_edges(edges, ends, options.min_conns, options.edge_flags),
        "findings": blind_spots(zero_coverage, options.focus),
    }


# --- condensed overview ----------------------------------------------------

def overview_segments(grouped: DataFrame, limit: int | None = None) -> tuple[DataFrame, int]:
    """The internal segments that keep a box (``limit`` at most), flagged ones first,
    then by host count; and how many do not."""
    internal = grouped.filter(ipf.internal_cidr("cidr")).groupBy("cidr").agg(
        F.count("*").alias("hosts"),
        F.max((F.col("flag") != "") | (F.col("device") != "")).alias("marked"))
    if limit is None:
        return internal, 0
    internal = materialize(internal, "segments")
    total = internal.count()
    order = [F.desc("marked"), F.desc("hosts"), F.asc("cidr")]
    if total <= limit:
        return internal, 0
    return internal.orderBy(*order).limit(limit - 1), total - limit + 1


def overview_hosts(grouped: DataFrame, segments: DataFrame, options: MapOptions) -> DataFrame:
    """Resolve groups and decide which hosts stay individual."""
    order = [
        F.desc((F.col("flag") != "") | (F.col("device") != "")), F.desc(F.col("rank") > 0),
        F.when(F.col("rank") > 0, F.col("rank")).otherwise(0).asc(), F.asc("ip")]
    kept = segments.select("cidr", F.lit(True).alias("kept"), "hosts", "marked")
    placed = grouped.join(kept, "cidr", "left")
    gid = (
        F.when(F.col("kept"), F.concat(F.lit("g:"), F.col("cidr")))
        .when(ipf.internal_cidr("cidr"), "g:other").otherwise("g:external"))
    placed = placed.withColumn("gid", gid).withColumn("terrain", ipf.terrain_addr("ip"))
    forced = placed.filter((F.col("pinned") | (F.col("device") != "")) & F.col("terrain"))
    pool = placed.filter(F.col("kept") & F.col("terrain") & ~F.col("pinned") & (F.col("device") == ""))
    chosen = pool
    if options.retain_all_private and options.max_private_hosts is not None:
        chosen = pool.orderBy(F.desc("marked"), F.desc("hosts"), F.asc("cidr"), *order).limit(
            options.max_private_hosts)
    elif not options.retain_all_private and options.hosts_per_segment is not None:
        seat = F.row_number().over(Window.partitionBy("cidr").orderBy(*order))
        chosen = pool.withColumn("_seat", seat).filter(F.col("_seat") <= options.hosts_per_segment)
    retained = forced.select("ip").unionByName(chosen.select("ip")).select(
        "ip", F.lit(True).alias("visible"))
    return placed.join(retained, "ip", "left").fillna({"visible": False}).drop("kept", "hosts", "marked")


def overview_groups(segments: DataFrame, hosts: DataFrame, options: MapOptions) -> DataFrame:
    boxes = _with_names(segments.select("cidr", "hosts"), options).select(
        F.concat(F.lit("g:"), F.col("cidr")).alias("id"), "cidr", _named(None, options).alias("label"))
    lumps = hosts.filter(F.col("gid").isin("g:other", "g:external")).select("gid").distinct().select(
        F.col("gid").alias("id"), F.lit("").alias("cidr"),
        F.when(F.col("gid") == "g:other", "other internal networks")
        .otherwise("external (internet / non-private)").alias("label"))
    return boxes.unionByName(lumps)


def trim_edges(bundles: DataFrame, nodes: DataFrame, budget: int) -> DataFrame:
    """Flagged and cross-group bundles always stay; of the others the strongest
    ``budget`` do, those touching a retained host first."""
    side = lambda c, g, r: nodes.select(
        F.col("id").alias(c), F.col("group").alias(g), (F.col("agg_count") == 0).alias(r))
    rows = bundles.join(side("src", "_gs", "_rs"), "src", "left").join(
        side("dst", "_gd", "_rd"), "dst", "left")
    crosses = F.coalesce(F.col("_gs") != F.col("_gd"), F.lit(False))
    protected = (F.col("drift") != "") | crosses
    touches = F.coalesce(F.col("_rs"), F.lit(False)) | F.coalesce(F.col("_rd"), F.lit(False))
    filler = rows.filter(~protected).orderBy(
        touches.desc(), F.desc("conns"), F.asc("src"), F.asc("dst"), F.asc("class")
    ).limit(max(budget, 0))
    return rows.filter(protected).unionByName(filler).drop("_gs", "_gd", "_rs", "_rd")


def overview(nodes, edges, gateways, zero_coverage, options: MapOptions) -> dict[str, DataFrame]:
    """Map of segments and chosen hosts. ``omitted`` has one row: segments without a
    box, hosts shown only in a number, and the flagged ones of them, bundles and
    gateways left out by the limits of ``options``."""
    focused = focus_nodes(nodes, options.focus)
    grouped = materialize(_flagged(host_rows(grouping(focused, options)), options), "map-hosts")
    segments, lost_segments = overview_segments(grouped, options.max_segments)
    hosts = materialize(overview_hosts(grouped, segments, options), "map-placed")
    boxes = materialize(overview_groups(segments, hosts, options), "map-groups")
    ends = endpoints(hosts)
    rows = _shown(hosts.filter("visible")).unionByName(client_nodes(hosts, "more hosts"))
    n_groups = boxes.count()
    ordered = gateways.orderBy(F.desc("ip_count"), F.asc("mac"), F.asc("sensor"))
    n_gateways = gateways.count()
    lost_gateways = 0
    if n_gateways:
        if options.max_elements is not None:
            ordered = ordered.limit(n_groups)
            lost_gateways = max(0, n_gateways - n_groups)
        rows = rows.unionByName(observed_gateways(ordered))
    covered = None
    if options.gateways is not None:
        rows, covered = declare_gateways(rows, boxes, hosts, options)
    rows = materialize(rows, "map-nodes")
    every = materialize(
        bundle_edges(edges, ends, options.min_conns, options.edge_flags), "map-bundles")
    bundles, n_rows = every, rows.count()
    limited = options.max_elements is not None
    if limited and not options.retain_all_private:
        bundles = materialize(
            trim_edges(every, rows, options.max_elements - n_groups - n_rows), "map-edges")
    if not n_gateways:
        bare = boxes.join(hosts.filter("visible").select(F.col("gid").alias("id")), "id", "left_anti")
        if covered is not None:
            bare = bare.join(covered.withColumnRenamed("gid", "id"), "id", "left_anti")
        routed = materialize(bare.filter("cidr <> ''").join(
            crossing_groups(edges, ends).withColumnRenamed("gid", "id"), "id", "left_semi"), "map-routed")
        some = routed
        if limited:
            left = max(0, options.max_elements - n_groups - n_rows - bundles.count())
            some = routed.orderBy("id").limit(left)
            lost_gateways = max(0, routed.count() - left)
        rows = rows.unionByName(inferred_gateways(some, routed.select(F.col("id").alias("gid"))))
    hidden = hosts.filter(~F.col("visible")).agg(
        F.count("*").alias("hosts"), F.count_if(F.col("flag") != "").alias("flagged_hosts"))
    omitted = hidden.select(
        F.lit(lost_segments).cast("bigint").alias("segments"), "hosts", "flagged_hosts",
        F.lit(every.count() - bundles.count()).cast("bigint").alias("edges"),
        F.lit(lost_gateways).cast("bigint").alias("gateways"))
    return {"groups": boxes, "nodes": rows, "edges": bundles, "members": members(hosts),
            "findings": blind_spots(zero_coverage), "omitted": omitted}
