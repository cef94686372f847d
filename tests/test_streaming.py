"""Partials kept up by a stream against direct aggregation of the log."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keyscape.operators import edges as edge_ops
from keyscape.operators import evidence, quality, temporal
from keyscape.streaming import partials

CONN = ("ts timestamp, src string, dst string, port int, proto string, service string, state string, bytes_out bigint, "
        "bytes_in bigint, sensor string, dst_mac string, dataset string, src_mac string")
DAY = datetime(2024, 1, 1)


def conn(spark, n=600, seed=1):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        rows.append((
            DAY + timedelta(seconds=r.randrange(5 * 86400)), r.choice(["10.1.0.1", "10.1.0.2", "10.1.0.3", None]),
            r.choice(["10.0.0.1", "10.0.0.2", None]), r.choice([53, 88, 445, None]), r.choice(["tcp", "udp", None]),
            r.choice(["dns", "-", None]), r.choice(["SF", "S0", None]), r.choice([10, None]), r.choice([0, 5, None]),
            r.choice(["s1", "s2", None]), r.choice(["m1", "m2", None]), r.choice(["conn", "other"]), r.choice(["x", None])))
    return spark.createDataFrame(rows, CONN)


def same(a, b):
    assert a.columns == b.columns
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def streamed(spark, log, root, kind="flow", parts=5):
    log.repartition(parts).write.parquet(f"{root}/log")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/log")
    partials.append(stream, kind, root).awaitTermination()
    return partials.read(spark, root, kind)


def test_stream_over_split_input_equals_the_batch(spark, tmp_path):
    log, root = conn(spark), str(tmp_path / "p")
    flow = streamed(spark, log, root)
    assert flow.select(F.sum("n")).first()[0] == 600
    assert same(partials.edges(flow), edge_ops.aggregate_edges(log))
    macs, gateways = partials.identity(flow, 2)
    assert same(macs, evidence.node_macs(log, 2))
    assert same(gateways, evidence.gateway_candidates(log, 2))
    assert same(partials.profiles(flow, "Europe/Berlin"), temporal.histograms(log, "Europe/Berlin"))
    found = {(r.what, r["value"]): r.n for r in partials.discovery(flow).collect()}
    assert {k[1]: n for k, n in found.items() if k[0] == "sensor"} == {r.sensor: r.n for r in quality.sensor_counts(log).collect()}
    assert {k[1]: n for k, n in found.items() if k[0] == "dataset"} == {r.dataset: r.n for r in quality.dataset_counts(log).collect()}
    whole = quality.mac_coverage(log).first()
    assert [found[x, ""] for x in ("total", "with_src_mac", "with_dst_mac")] == list(whole)


def test_stopped_stream_and_a_repeated_batch_count_once(spark, tmp_path):
    """New files after a stop, and late ones, are added; a batch whose end was lost is
    written again in its own place."""
    log, root = conn(spark), str(tmp_path / "p")
    first, late = log.filter(F.col("ts") >= "2024-01-03"), log.filter(F.col("ts") < "2024-01-03")
    first.coalesce(2).write.parquet(f"{root}/log")
    source = lambda: spark.readStream.schema(log.schema).parquet(f"{root}/log")
    partials.append(source(), "flow", root).awaitTermination()
    assert same(partials.edges(partials.read(spark, root, "flow")), edge_ops.aggregate_edges(first))
    late.coalesce(1).write.mode("append").parquet(f"{root}/log")
    partials.append(source(), "flow", root).awaitTermination()
    partials.append(source(), "flow", root).awaitTermination()
    assert same(partials.edges(partials.read(spark, root, "flow")), edge_ops.aggregate_edges(log))
    commits = sorted((tmp_path / "p/checkpoint-flow/commits").glob("[0-9]*"))
    (tmp_path / "p/flow" / f"batch={commits[-1].name}" / "_SUCCESS").unlink()
    assert partials.read(spark, root, "flow").select(F.sum("n")).first()[0] < 600
    for f in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        f.unlink(missing_ok=True)
    partials.append(source(), "flow", root).awaitTermination()
    assert same(partials.edges(partials.read(spark, root, "flow")), edge_ops.aggregate_edges(log))


@pytest.mark.parametrize(("start", "end"), [
    ("2024-01-02 00:00:00", "2024-01-04 00:00:00"), ("2024-01-02 10:15:01", "2024-01-04 03:59:59"),
    ("2024-01-02 10:15:01", "2024-01-02 10:40:00"), ("2024-01-02 10:59:59", "2024-01-02 11:00:01"),
    ("2024-01-02 10:00:00", "2024-01-02 10:30:00"), ("2024-01-03 07:30:00", None), ("2030-01-01 00:00:00", None)])
def test_any_window_is_a_merge(spark, start, end):
    log = conn(spark, 3000, 2)
    cut = log.filter(F.col("ts") >= start).filter(F.lit(True) if end is None else F.col("ts") < F.lit(end))
    flow = partials.window(partials.flow_partials(log), log, "flow", start, end)
    assert same(partials.edges(flow), edge_ops.aggregate_edges(cut))
    logs = log.select(F.col("service").alias("kind"), F.col("dst").alias("responder"), F.col("src").alias("client"), "ts")
    few = logs.filter(F.col("ts") >= start).filter(F.lit(True) if end is None else F.col("ts") < F.lit(end))
    pairs = partials.window(partials.pair_partials(logs), logs, "pairs", start, end)
    assert same(partials.cardinality(pairs, 2), evidence.responder_cardinality(few, 2))


def test_partials_of_one_hour_twice_and_of_nothing(spark, tmp_path):
    log = conn(spark, 50, 3)
    once = partials.flow_partials(log)
    twice = partials.flow_partials(log.limit(20)).unionByName(partials.flow_partials(log.exceptAll(log.limit(20))))
    assert same(partials.edges(once), partials.edges(twice))
    assert partials.read(spark, str(tmp_path), "flow").count() == 0
    assert partials.edges(partials.read(spark, str(tmp_path), "flow")).count() == 0


def test_days_close_behind_the_watermark(spark, tmp_path):
    log, root = conn(spark, 400, 4), str(tmp_path)
    for day in range(5):
        log.filter(F.to_date("ts") == F.lit(DAY.date() + timedelta(day))).coalesce(1).write.mode("append").parquet(f"{root}/log")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/log")
    query = partials.closed_days(stream, "6 hours").writeStream.outputMode("append").option(
        "checkpointLocation", f"{root}/c").trigger(availableNow=True).start(f"{root}/out", format="parquet")
    query.awaitTermination()
    got = spark.read.parquet(f"{root}/out")
    rows = log.filter("src is not null and dst is not null and port is not null").filter(F.col("ts") < "2024-01-05")
    want = rows.groupBy(F.date_trunc("day", "ts").alias("day"), "src", "dst", "port", F.coalesce("proto", F.lit("")).alias("proto")).agg(
        F.count("*").alias("conn_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    assert same(got, want)


def test_large_batch_is_dealt_by_rows(spark, tmp_path, monkeypatch):
    """A batch in one file is reduced and written in pieces, with the same result."""
    monkeypatch.setattr(partials, "TASK_ROWS", 50)
    for kind, log, keys in (("flow", conn(spark), partials.FLOW_KEYS),
                            ("pairs", conn(spark).select(F.lit("dns").alias("kind"), F.col("dst").alias("responder"), F.col("src").alias("client"), "ts"), partials.PAIR_KEYS)):
        got = streamed(spark, log, str(tmp_path / kind), kind, parts=1)
        assert len(got.inputFiles()) > 4
        want = partials.REDUCE[kind](log)
        assert same(got.select(*want.columns), want)
        assert got.count() == got.select(*keys).distinct().count()
