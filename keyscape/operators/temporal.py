"""Activity shape per responder: hour and weekday histograms and their class."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyscape import config


def histograms(conn: DataFrame, tz: str = "UTC", only: DataFrame | None = None) -> DataFrame:
    """24 hour-of-day and 7 day-of-week counts (Sunday first) per responder.

    ``only`` limits the work to given addresses before anything is aggregated.
    Hour buckets are cut in UTC and then folded to local time.
    """
    rows = conn.select("dst", "ts")
    if only is not None:
        rows = rows.join(only.select(F.col("ip").alias("dst")), "dst", "left_semi")
    per_hour = rows.groupBy("dst", F.date_trunc("hour", "ts").alias("h")).agg(
        F.count("*").alias("n")
    )
    return fold_hours(per_hour, tz)


def fold_hours(per_hour: DataFrame, tz: str = "UTC") -> DataFrame:
    """The same from counts (dst, h, n) of hours ``h`` in UTC."""
    local = F.from_utc_timestamp("h", tz)
    folded = per_hour.select(
        "dst", "n", F.hour(local).alias("hod"), (F.dayofweek(local) - 1).alias("dow")
    )
    def slot(column: str, i: int) -> Column:
        return F.sum(F.when(F.col(column) == i, F.col("n")).otherwise(0))

    hours = [slot("hod", i).alias(f"h{i}") for i in range(24)]
    days = [slot("dow", i).alias(f"d{i}") for i in range(7)]
    return (
        folded.groupBy(F.col("dst").alias("ip"))
        .agg(*hours, *days)
        .select(
            "ip",
            F.array(*[f"h{i}" for i in range(24)]).alias("hours"),
            F.array(*[f"d{i}" for i in range(7)]).alias("dow"),
        )
    )


def classify(hours="hours", dow="dow") -> Column:
    """First class that applies; empty when none does."""
    h = F.col(hours) if isinstance(hours, str) else hours
    d = F.col(dow) if isinstance(dow, str) else dow

    def add(items: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, items)

    total = F.aggregate(h, F.lit(0).cast("bigint"), lambda a, x: a + x)
    dominant = total * F.lit(config.TEMPORAL_DOMINANT)
    band = [h.getItem(i) for i in config.NIGHT_BAND]
    width = config.NIGHT_WINDOW
    night = F.greatest(*[add(band[i:i + width]) for i in range(len(band))])
    start, end = config.BUSINESS_HOURS
    business = add([h.getItem(i) for i in range(start, end)])
    weekend = d.getItem(0) + d.getItem(6)
    active = F.size(F.filter(h, lambda x: x > 0))
    return (
        F.when(total < config.TEMPORAL_SPARSE_MAX, "Sparse")
        .when(night >= dominant.cast("bigint"), "Nightly")
        .when(F.array_max(h) >= dominant, "Burst")
        .when(
            (business >= dominant) & (weekend < total * F.lit(config.TEMPORAL_WEEKEND)),
            "BusinessHours",
        )
        .when(active >= config.TEMPORAL_CONSTANT_HOURS, "Constant")
        .otherwise("")
    )


def profiles(conn: DataFrame, tz: str = "UTC", only: DataFrame | None = None) -> DataFrame:
    return histograms(conn, tz, only).withColumn("class", classify())


def attach(edges: DataFrame, profile: DataFrame) -> DataFrame:
    """Put the responder's profile on each of its inbound edges."""
    packed = profile.select(
        F.col("ip").alias("dst"), F.struct("hours", "dow", "class").alias("temporal")
    )
    return edges.join(packed, "dst", "left")
