"""Dependency edges, nodes and the distinct-client measures on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyscape import config
from keyscape.functions import ip as ipf
from keyscape.functions import ports, text
from keyscape.operators.positions import with_position
from keyscape.session import materialize

EDGE_KEYS = ["src", "dst", "port", "proto"]
_LEVELS = [config.PORT_ONLY, config.RESPONDER_CONFIRMED, config.PROTOCOL_CONFIRMED]
#: Sensors whose sets fit one mask of bits; the sets of more are collected.
MASKED_SENSORS = 63
#: Sensors whose sets are all listed beforehand, to be looked up by their mask.
_LISTED_SENSORS = 6
#: Ports that make a client count, by the name of the count.
_MEASURES = {
    "dependents": ports.is_critical,
    "db_clients": ports.is_database,
    "printer_clients": ports.is_printer,
    "camera_clients": ports.is_camera,
    "mail_clients": ports.is_mail,
    "gear_clients": ports.is_gear,
}
_CLIENTS = [name for name in _MEASURES if name != "dependents"]


def evidence_grade(service, state, bytes_in) -> Column:
    """0, 1 or 2: attempt only, responder took part, protocol recognised.

    A row-level grade whose maximum is the grade of the edge, so it needs no
    histogram of states or protocols."""
    named = ~F.coalesce(F.col(service), F.lit("")).isin(config.PLACEHOLDER_PROTOCOLS)
    answered = F.col(state).isin(config.RESPONDED_STATES) | (F.col(bytes_in) > 0)
    return F.when(named, 2).when(F.coalesce(answered, F.lit(False)), 1).otherwise(0)


def evidence_level(grade: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in _LEVELS]), grade + 1)


def sensor_names(conn: DataFrame, limit: int = MASKED_SENSORS) -> list[str] | None:
    """All sensors of a log in order, or none if there are more than ``limit``."""
    names = conn.select("sensor").filter(F.col("sensor").isNotNull()).distinct().limit(limit + 1).collect()
    return sorted(r["sensor"] for r in names) if len(names) <= limit else None


def aggregate_edges(conn: DataFrame, masked: int = MASKED_SENSORS) -> DataFrame:
    """One row per (src, dst, port, proto).

    The sensors are read first. Up to ``masked`` of them, an edge's set is a mask of bits, and
    the log is aggregated once, on fixed-width buffers. With more there are two aggregations:
    per sensor first, which reduces the log before its shuffle, then the sensor set per edge.
    """
    names = sensor_names(conn, masked)
    if names is None:
        return merge_edges(_graded(conn).groupBy(*EDGE_KEYS, "sensor").agg(*_partial()))
    return _edges(_listed(_masked_edges(conn, names), names))


def stored_edges(conn: DataFrame, masked: int = MASKED_SENSORS) -> tuple[DataFrame, DataFrame]:
    """Edges of a log, written once, and their endpoints. Sensors are written as masks, grades
    as numbers: names are put in when an edge is read, and endpoints are made without."""
    names = sensor_names(conn, masked)
    if names is None:
        edges = materialize(aggregate_edges(conn, masked), "edges")
        return edges, endpoints(edges)
    rows = materialize(_masked_edges(conn, names), "edges")
    ends = rows.select(F.explode(F.array("src", "dst")).alias("ip"), "first_seen", "last_seen", "mask")
    nodes = ends.groupBy("ip").agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.bit_or("mask").alias("mask"),
    )
    return _edges(_listed(rows, names)), _listed(nodes, names).withColumn("subnet", ipf.subnet("ip"))


def _graded(conn: DataFrame) -> DataFrame:
    return conn.filter(
        F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("port").isNotNull()
    ).select(
        "src",
        "dst",
        F.col("port").cast("int").alias("port"),
        F.coalesce("proto", F.lit("")).alias("proto"),
        "sensor",
        "ts",
        "bytes_out",
        "bytes_in",
        evidence_grade("service", "state", "bytes_in").alias("grade"),
    )


def _partial() -> list[Column]:
    return [
        F.count("*").alias("n"),
        F.sum("bytes_out").alias("o"),
        F.sum("bytes_in").alias("i"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
        F.max("grade").alias("grade"),
    ]


def _names(names: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in names]).cast("array<string>")


def _listed(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with the names of the sensors in ``mask`` instead of it."""
    mask = F.col("mask")
    if len(names) <= _LISTED_SENSORS:
        sets = [[x for at, x in enumerate(names) if m >> at & 1] for m in range(1 << len(names))]
        found = F.element_at(F.array(*[_names(own) for own in sets]), (mask + 1).cast("int"))
    else:
        found = F.filter(_names(names), lambda x, at: F.call_function("getbit", mask, at) == 1)
    return rows.withColumn("mask", found).withColumnRenamed("mask", "sensors")


def _masked_edges(conn: DataFrame, names: list[str]) -> DataFrame:
    """Edges with ``grade`` and, bit k for the name k, ``mask`` of their sensors."""
    bit = F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), (F.array_position(_names(names), F.col("sensor")) - 1).cast("int"))
    merged = _graded(conn).groupBy(*EDGE_KEYS).agg(
        *_partial(), F.bit_or(F.coalesce(bit, F.lit(0).cast("bigint"))).alias("mask"))
    return merged.select(
        *EDGE_KEYS,
        F.col("n").alias("conn_count"),
        F.coalesce("o", F.lit(0)).alias("bytes_out"),
        F.coalesce("i", F.lit(0)).alias("bytes_in"),
        F.col("first").alias("first_seen"),
        F.col("last").alias("last_seen"),
        "grade",
        "mask",
    )


def merge_edges(per_sensor: DataFrame) -> DataFrame:
    """Edges of partial rows (keys, sensor, n, o, i, first, last, grade)."""
    return _edges(per_sensor.groupBy(*EDGE_KEYS).agg(
        F.sum("n").alias("conn_count"),
        F.coalesce(F.sum("o"), F.lit(0)).alias("bytes_out"),
        F.coalesce(F.sum("i"), F.lit(0)).alias("bytes_in"),
        F.min("first").alias("first_seen"),
        F.max("last").alias("last_seen"),
        F.max("grade").alias("grade"),
        F.array_sort(F.collect_set("sensor")).alias("sensors"),
    ))


def _edges(merged: DataFrame) -> DataFrame:
    return merged.select(
        *EDGE_KEYS,
        ports.service_name("port").alias("service"),
        evidence_level(F.col("grade")).alias("evidence"),
        "conn_count", "bytes_out", "bytes_in", "first_seen", "last_seen", "sensors",
    )


def confirmed(edges: DataFrame) -> DataFrame:
    return edges.filter(text.confirmed("evidence"))


def cap_edges(edges: DataFrame, max_edges: int) -> tuple[DataFrame, Column]:
    """First ``max_edges`` edges in key order, and a column expression over a
    count that says whether the cap was reached (also when it is just met)."""
    ordered = edges.withColumn("_s", ipf.ip_key("src")).withColumn("_d", ipf.ip_key("dst"))
    kept = (
        with_position(ordered, ["_s", "_d", "port", "proto"], "_pos")
        .filter(F.col("_pos") <= max_edges)
        .drop("_s", "_d", "_pos")
    )
    return kept, F.count("*") >= max_edges


def endpoints(edges: DataFrame) -> DataFrame:
    """Nodes: union of endpoints over all edges, port-only ones included."""
    ends = edges.select(
        F.explode(F.array("src", "dst")).alias("ip"), "first_seen", "last_seen", "sensors"
    ).select("ip", "first_seen", "last_seen", F.explode_outer("sensors").alias("sensor"))
    per_sensor = ends.groupBy("ip", "sensor").agg(
        F.min("first_seen").alias("f"), F.max("last_seen").alias("l")
    )
    nodes = per_sensor.groupBy("ip").agg(
        F.min("f").alias("first_seen"),
        F.max("l").alias("last_seen"),
        F.array_sort(F.collect_set("sensor")).alias("sensors"),
    )
    return nodes.withColumn("subnet", ipf.subnet("ip"))


def distinct_clients(edges: DataFrame, **measures: Column) -> DataFrame:
    """Distinct clients per responder under each port predicate.

    (src, dst) pairs are reduced to one row of flags first, so a responder with
    very many clients is a plain partial count, not a set in one task.
    """
    flags = [F.max(test).alias(name) for name, test in measures.items()]
    pairs = confirmed(edges).groupBy("dst", "src").agg(*flags)
    return pairs.groupBy(F.col("dst").alias("ip")).agg(
        *[F.count_if(F.col(name)).alias(name) for name in measures]
    )


def client_counts(edges: DataFrame) -> DataFrame:
    return distinct_clients(edges, **{name: _MEASURES[name]("port") for name in _CLIENTS})


def host_measures(edges: DataFrame) -> DataFrame:
    """``critical_in_degree``, ``client_counts`` and ``subnet_spread`` of every responder from
    one reduction of the edges to (src, dst) pairs; ``clients_of`` has the second."""
    bits = [F.when(test("port"), 1 << at).otherwise(0) for at, test in enumerate(_MEASURES.values())]
    pairs = confirmed(edges).groupBy("dst", "src").agg(F.bit_or(sum(bits[1:], bits[0])).alias("mask"))
    parts = pairs.groupBy("dst", ipf.subnet("src").alias("subnet")).agg(*[
        F.count_if(F.col("mask").bitwiseAND(1 << at) > 0).alias(name) for at, name in enumerate(_MEASURES)])
    return parts.groupBy(F.col("dst").alias("ip")).agg(
        *[F.sum(name).alias(name) for name in _MEASURES], F.count("*").alias("spread"))


def clients_of(measures: DataFrame) -> DataFrame:
    return measures.select("ip", *_CLIENTS)


def admin_shape(edges: DataFrame) -> DataFrame:
    """Distinct administration peers in and out of every host that has any."""
    pairs = (
        confirmed(edges).filter(ports.is_admin("port")).select("src", "dst").distinct()
    )
    ends = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("dst").alias("ip"), F.lit(1).alias("i"), F.lit(0).alias("o")),
                F.struct(F.col("src").alias("ip"), F.lit(0).alias("i"), F.lit(1).alias("o")),
            )
        ).alias("e")
    ).select("e.*")
    return ends.groupBy("ip").agg(
        F.sum("i").alias("admin_in"), F.sum("o").alias("admin_out")
    )


def critical_in_degree(edges: DataFrame) -> DataFrame:
    return distinct_clients(edges, dependents=ports.is_critical("port"))


def subnet_spread(edges: DataFrame) -> DataFrame:
    """Distinct client subnets per responder over any confirmed port."""
    pairs = confirmed(edges).select("dst", ipf.subnet("src").alias("subnet")).distinct()
    return pairs.groupBy(F.col("dst").alias("ip")).agg(F.count("*").alias("spread"))


def services(edges: DataFrame) -> DataFrame:
    """Named services a host was asked for, in port order, over all edges."""
    named = (
        edges.select("dst", "port")
        .distinct()
        .withColumn("name", ports.known_service("port"))
        .filter(F.col("name") != "")
        .groupBy("dst", "name")
        .agg(F.min("port").alias("port"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("port", "name")))
    return named.groupBy(F.col("dst").alias("ip")).agg(
        F.transform(ordered, lambda s: s["name"]).alias("services")
    )
