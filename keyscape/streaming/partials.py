"""Hourly partial aggregates of the logs, kept up by a stream; any window is a merge of them.

One table serves everything that is counted from connections: edges, hardware addresses,
gateways, activity, sensors, coverage. It has a row for each hour and combination of
``FLOW_KEYS``, so a log is read once, when it arrives. Distinct clients come from a second
table of pairs. All aggregates merge: counts and sums add up, times and grades take their
extremes, distinct values stay keys. A window of whole hours reads partials only; the hours
at its ends come from the log.

``append`` is a Structured Streaming query. Each micro-batch is reduced and written to a
folder of its own, which a repeated batch overwrites, so every row counts once however
often the stream is stopped, and however late the row is. Files hold ranges of hours, so a
window skips those of other times by their statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keyscape import config
from keyscape.operators import edges as edge_ops
from keyscape.operators import evidence, temporal

FLOW_KEYS = ["hour", "src", "dst", "port", "proto", "sensor", "dst_mac", "dataset"]
PAIR_KEYS = ["hour", "kind", "responder", "client"]
_FLOW = (
    "hour timestamp, src string, dst string, port int, proto string, sensor string, dst_mac string, dataset string, "
    "n bigint, o bigint, i bigint, first timestamp, last timestamp, grade int, with_src_mac bigint, with_dst_mac bigint")
_PAIR = "hour timestamp, kind string, responder string, client string, n bigint, first timestamp, last timestamp"
SCHEMAS = {"flow": _FLOW, "pairs": _PAIR}
#: Rows of a batch in one task that reduces or sorts them, about.
TASK_ROWS = 500_000


def _with(df: DataFrame, *columns: str) -> DataFrame:
    """Text columns that an input may lack, as nulls."""
    missing = {c: F.lit(None).cast("string") for c in columns if c not in df.columns}
    return df.withColumns(missing) if missing else df


def flow_partials(conn: DataFrame, pieces: int | None = None) -> DataFrame:
    """Connections reduced to one row for each hour and combination of keys. Rows without an
    instant are in the hour null, which is in no window. With ``pieces`` they are first dealt
    to so many tasks."""
    rows = _with(conn, "dst_mac", "src_mac", "dataset")
    rows = rows.select(
        F.date_trunc("hour", "ts").alias("hour"), "src", "dst", F.col("port").cast("int").alias("port"), "proto", "sensor",
        "dst_mac", "dataset", "ts", "bytes_out", "bytes_in", "src_mac",
        edge_ops.evidence_grade("service", "state", "bytes_in").alias("grade"))
    if pieces:
        rows = rows.repartition(pieces, "hour", "src", "dst")
    return rows.groupBy(*FLOW_KEYS).agg(
        F.count("*").alias("n"), F.sum("bytes_out").alias("o"), F.sum("bytes_in").alias("i"),
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("grade").alias("grade"),
        F.count("src_mac").alias("with_src_mac"), F.count("dst_mac").alias("with_dst_mac"))


def pair_partials(logs: DataFrame, pieces: int | None = None) -> DataFrame:
    """Protocol log rows (kind, responder, client, ts) reduced in the same way."""
    rows = logs.select("kind", "responder", "client", "ts", F.date_trunc("hour", "ts").alias("hour"))
    if pieces:
        rows = rows.repartition(pieces, "hour", "responder", "client")
    return rows.groupBy(*PAIR_KEYS).agg(
        F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


REDUCE = {"flow": flow_partials, "pairs": pair_partials}


def append(stream: DataFrame, kind: str, root: str, **trigger) -> StreamingQuery:
    """Start a stream of connections ("flow") or protocol log rows ("pairs") into the partials
    at ``root``; ``trigger`` as in ``DataStreamWriter.trigger``, everything there is by
    default. The checkpoint is at ``root`` too, so a stream that is started again goes on
    where it stopped.

    A batch is dealt to tasks by its number of rows, so that what a task holds depends neither
    on the size of a batch nor on that of its files."""
    def write(batch: DataFrame, number: int) -> None:
        pieces = max(1, -(-batch.count() // TASK_ROWS))
        rows = REDUCE[kind](batch, pieces)
        rows = rows.repartitionByRange(pieces, "hour", *rows.columns[1:3]).sortWithinPartitions("hour")
        rows.write.mode("overwrite").parquet(f"{root}/{kind}/batch={number}")

    return stream.writeStream.foreachBatch(write).option(
        "checkpointLocation", f"{root}/checkpoint-{kind}").trigger(**(trigger or {"availableNow": True})).start()


def read(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Partials of all batches that were written to their end. One key may have a row in
    several of them."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{kind}/batch=*/_SUCCESS")
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    paths = [f.getPath().getParent().toString() for f in files]
    if not paths:
        return spark.createDataFrame([], SCHEMAS[kind])
    schema = f"{SCHEMAS[kind]}, batch bigint"
    return spark.read.schema(schema).option("basePath", f"{root}/{kind}").parquet(*paths).drop("batch")


def window(partials: DataFrame, raw: DataFrame, kind: str, start, end=None) -> DataFrame:
    """Partials of ``start`` <= ts < ``end`` (no end: everything since): whole hours as they
    are, the hours that the window cuts from ``raw``, the log itself, by a filter on its
    instant."""
    start = F.lit(start).cast("timestamp")
    end = None if end is None else F.lit(end).cast("timestamp")
    floor = F.date_trunc("hour", start)
    whole = F.when(floor == start, start).otherwise(floor + F.expr("INTERVAL 1 HOUR"))
    inside, head = F.col("hour") >= whole, (F.col("ts") >= start) & (F.col("ts") < whole)
    cut = head
    if end is not None:
        last = F.date_trunc("hour", end)
        inside = inside & (F.col("hour") < last)
        head = head & (F.col("ts") < end)
        cut = head | ((F.col("ts") >= F.greatest(last, whole)) & (F.col("ts") < end))
    return partials.filter(inside).unionByName(REDUCE[kind](raw.filter(cut)))


def edges(flow: DataFrame) -> DataFrame:
    """``aggregate_edges`` of the rows behind the partials."""
    keep = F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("port").isNotNull()
    per_sensor = flow.filter(keep).withColumn("proto", F.coalesce("proto", F.lit(""))).groupBy(
        *edge_ops.EDGE_KEYS, "sensor").agg(
        F.sum("n").alias("n"), F.sum("o").alias("o"), F.sum("i").alias("i"), F.min("first").alias("first"),
        F.max("last").alias("last"), F.max("grade").alias("grade"))
    return edge_ops.merge_edges(per_sensor)


def identity(flow: DataFrame, min_ips: int = config.GATEWAY_MIN_IPS) -> tuple[DataFrame, DataFrame]:
    """``node_macs`` and ``gateway_candidates``, both from one reduction of the partials to
    (sensor, hardware address, responder) counts."""
    seen = flow.filter(F.col("dst_mac").isNotNull() & F.col("dst").isNotNull()).groupBy("sensor", "dst_mac", "dst").agg(
        F.sum("n").alias("n"))
    counts = seen.groupBy("dst", "dst_mac").agg(F.sum("n").alias("n"))
    return evidence.macs_of(counts, min_ips), evidence.gateway_candidates(seen, min_ips)


def profiles(flow: DataFrame, tz: str = "UTC") -> DataFrame:
    """``histograms`` of the responders; hours are the grain of the partials."""
    return temporal.fold_hours(flow.groupBy("dst", F.col("hour").alias("h")).agg(F.sum("n").alias("n")), tz)


def discovery(flow: DataFrame) -> DataFrame:
    """(what, value, n): rows of every sensor and dataset, and all rows with their coverage
    of hardware addresses, from one pass."""
    row = lambda what, value, n: F.struct(F.lit(what).alias("what"), value.alias("value"), F.col(n).alias("n"))
    counted = F.array(
        row("sensor", F.col("sensor"), "n"), row("dataset", F.col("dataset"), "n"),
        *[row(what, F.lit(""), n) for what, n in (
            ("total", "n"), ("with_src_mac", "with_src_mac"), ("with_dst_mac", "with_dst_mac"))])
    return flow.select(F.inline(counted)).filter("value IS NOT NULL").groupBy("what", "value").agg(F.sum("n").alias("n"))


def cardinality(pairs: DataFrame, samples: int = config.SAMPLE_HOSTS) -> DataFrame:
    """``responder_cardinality``: distinct clients and the most frequent ones. Hours of one
    pair are merged first, so a client counts once in any window."""
    keys = ["kind", "responder"]
    merged = pairs.filter(F.col("responder").isNotNull()).groupBy(*keys, "client").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc("client"))
    best = merged.filter(F.col("client").isNotNull()).withColumn("pos", F.row_number().over(order)).filter(
        F.col("pos") <= samples).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "client"))).alias("s")).select(
        *keys, F.transform("s", lambda e: e["client"]).alias("sample_hosts"))
    return merged.groupBy(*keys).agg(F.count("client").alias("clients")).join(best, keys, "left")


def seen_between(pairs: DataFrame) -> DataFrame:
    """(kind, responder, client, n, first_seen, last_seen) of every pair in the window."""
    return pairs.groupBy("kind", "responder", "client").agg(
        F.sum("n").alias("n"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"))


def closed_days(stream: DataFrame, delay: str) -> DataFrame:
    """A stream of final daily edge counts in append mode: a day is emitted when the
    watermark, the latest instant seen less ``delay``, has passed its end. Rows that are
    later than that are not in it; ``append`` has them all."""
    rows = stream.filter(F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("port").isNotNull())
    return rows.withWatermark("ts", delay).groupBy(
        F.window("ts", "1 day").alias("w"), "src", "dst", F.col("port").cast("int").alias("port"),
        F.coalesce("proto", F.lit("")).alias("proto")
    ).agg(F.count("*").alias("conn_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")).select(
        F.col("w.start").alias("day"), "src", "dst", "port", "proto", "conn_count", "first_seen", "last_seen")

