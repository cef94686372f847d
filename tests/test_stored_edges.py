import pytest
from pyspark.sql import functions as F

from keyscape.operators import edges as E

DDL = ("ts timestamp, src string, dst string, port int, proto string, state string, service string, "
       "bytes_out long, bytes_in long, sensor string")


def _log(spark, sensors):
    ports = [88, 389, 5432, 9100, 554, 25, 5246, 22, 443]
    row = F.col("id")
    pick = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), (row % len(values) + 1).cast("int"))
    rows = spark.range(600).select(
        F.timestamp_seconds(row * 7 % 1000), F.concat(F.lit("10.1."), row % 5, F.lit("."), row % 11),
        F.concat(F.lit("10.0.0."), row % 7), pick(ports), pick(["tcp", None]), pick(["SF", "S0", "REJ"]),
        pick(["app", "-", "", None]), row, row % 2, pick(sensors))
    return spark.createDataFrame(rows.collect(), DDL)


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("sensors, masked", [
    ([None], 63), (["b", None, "a", "c"], 63), ([f"s{i}" for i in range(9)], 63), (["b", None, "a", "c"], 2)])
def test_stored_edges_and_their_nodes(spark, sensors, masked):
    log = _log(spark, sensors)
    want = E.merge_edges(E._graded(log).groupBy(*E.EDGE_KEYS, "sensor").agg(*E._partial()))
    edges, nodes = E.stored_edges(log, masked)
    assert _rows(edges) == _rows(want) == _rows(E.aggregate_edges(log, masked))
    assert _rows(nodes) == _rows(E.endpoints(want))


def test_measures_of_hosts_from_one_reduction(spark):
    edges = E.aggregate_edges(_log(spark, ["a"]))
    got = E.host_measures(edges)
    want = E.critical_in_degree(edges).join(E.subnet_spread(edges), "ip").join(E.client_counts(edges), "ip")
    assert got.count() == 7 and _rows(got) == _rows(want.select(got.columns))
    assert _rows(E.clients_of(got)) == _rows(E.client_counts(edges))
