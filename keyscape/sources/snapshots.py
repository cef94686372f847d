"""Immutable snapshots: tables staged in folders of their own, published by a manifest.

``root/data/<table>/snapshot_id=<id>/attempt=<unique>`` holds what one attempt to save has
written, ``root/manifest`` one row for each snapshot that is complete: its id and, for each
table, the attempt, the schema and the number of rows. The row is one file, written last,
so a snapshot is there with all its tables or not at all. What a crash leaves is never
read; saving again is a new attempt.
"""

from __future__ import annotations

import json
import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

TABLES = ["meta", "nodes", "edges", "gateways"]
_MANIFEST = (
    "snapshot_id string, attempt string, committed_at timestamp, "
    "tables array<struct<name: string, schema: string, rows: bigint>>")


class UnknownSnapshot(LookupError):
    """No complete snapshot has the table that was asked for."""


def snapshot_id(created: datetime | None = None) -> str:
    created = created or datetime.now(timezone.utc)
    return created.strftime("%Y%m%dT%H%M%SZ-") + uuid.uuid4().hex[:8]


def _folder(root: str, table: str, sid: str, attempt: str) -> str:
    return f"{root}/data/{table}/snapshot_id={sid}/attempt={attempt}"


def stage(tables: dict[str, DataFrame], root: str, sid: str) -> dict:
    """Write all tables of a snapshot without publishing them; what ``publish`` needs.

    Tables other than ``meta`` go first, in parts as they are, and are counted from what
    was written; ``meta`` gets the number of nodes and edges.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", sid):
        raise ValueError(f"not a snapshot id: {sid!r}")
    spark = tables["meta"].sparkSession
    attempt, entries = uuid.uuid4().hex, {}

    def write(name: str, df: DataFrame) -> int:
        df = df.drop("snapshot_id")
        path = _folder(root, name, sid, attempt)
        df.write.parquet(path)
        rows = spark.read.schema(df.schema).parquet(path).count()
        entries[name] = {"name": name, "schema": df.schema.json(), "rows": rows}
        return rows

    counts = {name: write(name, df) for name, df in tables.items() if name != "meta"}
    own = {f"{t}_count": F.lit(counts.get(t, 0)).cast("bigint") for t in ("nodes", "edges")}
    write("meta", tables["meta"].withColumns(own))
    return {"snapshot_id": sid, "attempt": attempt, "tables": list(entries.values())}


def publish(spark: SparkSession, root: str, staged: dict) -> str:
    """Make a staged snapshot visible. An id that is already there is refused; of two
    attempts that publish one id at the same time the first one is read."""
    sid = staged["snapshot_id"]
    if not manifest(spark, root).filter(F.col("snapshot_id") == sid).isEmpty():
        raise ValueError(f"snapshot {sid} exists")
    row = (sid, staged["attempt"], datetime.now(timezone.utc), [
        (t["name"], t["schema"], t["rows"]) for t in staged["tables"]])
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return sid


def save(tables: dict[str, DataFrame], root: str, sid: str) -> str:
    """Write and publish one snapshot; an id that exists is refused, before anything is
    written. A save that fails leaves nothing that is read, and can be repeated."""
    spark = tables["meta"].sparkSession
    if not manifest(spark, root).filter(F.col("snapshot_id") == sid).isEmpty():
        raise ValueError(f"snapshot {sid} exists")
    return publish(spark, root, stage(tables, root, sid))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row for each complete snapshot: the first attempt published under its id."""
    path = f"{root}/manifest"
    if not _exists(spark, path):
        return spark.createDataFrame([], _MANIFEST)
    first = Window.partitionBy("snapshot_id").orderBy("committed_at", "attempt")
    return spark.read.schema(_MANIFEST).parquet(path).withColumn("_n", F.row_number().over(first)).filter(
        "_n = 1").drop("_n")


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    target, fs = _path(spark, path)
    return fs.exists(target)


def _merged(schemas: list[str], table: str) -> T.StructType:
    """Fields of all schemas by name; one name with two types is an error."""
    fields: dict[str, T.StructField] = {}
    for schema in schemas:
        for f in T.StructType.fromJson(json.loads(schema)).fields:
            known = fields.setdefault(f.name, T.StructField(f.name, f.dataType))
            if known.dataType != f.dataType:
                raise ValueError(f"{table}.{f.name} has types {known.dataType} and {f.dataType}")
    return T.StructType(list(fields.values()))


def read(spark: SparkSession, root: str, table: str, sid: str | None = None) -> DataFrame:
    """A table of every complete snapshot, or of one: only its folder is read.

    Its columns are those of all snapshots that have the table, null where a snapshot has
    not, and ``snapshot_id``. An id without the table gives no rows, a table that no
    snapshot has is an error. The driver holds an entry for each snapshot.
    """
    found = manifest(spark, root).select("snapshot_id", "attempt", F.inline("tables")).filter(
        F.col("name") == table).collect()
    if not found:
        raise UnknownSnapshot(f"no snapshot at {root} has {table}")
    schema = _merged([r["schema"] for r in found], table)
    schema = T.StructType([*schema.fields, T.StructField("snapshot_id", T.StringType()),
                           T.StructField("attempt", T.StringType())])
    paths = [_folder(root, table, r.snapshot_id, r.attempt) for r in found if sid in (None, r.snapshot_id)]
    if not paths:
        return spark.createDataFrame([], schema).drop("attempt")
    # ids are text in the schema: left to inference, 0012 and 12 would be one number
    return spark.read.schema(schema).option("basePath", f"{root}/data/{table}").parquet(*paths).drop("attempt")


def load(spark: SparkSession, root: str, sid: str) -> dict[str, DataFrame]:
    """All tables of one snapshot by name."""
    row = manifest(spark, root).filter(F.col("snapshot_id") == sid).first()
    if row is None:
        raise UnknownSnapshot(f"no snapshot {sid} at {root}")
    return {t["name"]: read(spark, root, t["name"], sid) for t in row.tables}


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """Newest first, with node and edge counts. Reads the metadata only."""
    return read(spark, root, "meta").select(
        "snapshot_id", "created_at", "window", "cluster_name", F.col("nodes_count").alias("nodes"),
        F.col("edges_count").alias("edges"),
    ).orderBy(F.desc("created_at"), F.desc("snapshot_id"))


def discard_unfinished(spark: SparkSession, root: str) -> int:
    """Delete the folders of attempts that no manifest row names; how many there were. Only
    for a time when nothing is being saved."""
    kept = {(r.snapshot_id, r.attempt) for r in manifest(spark, root).select("snapshot_id", "attempt").collect()}
    top, fs = _path(spark, f"{root}/data")
    gone = 0
    for at in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/data/*/snapshot_id=*/attempt=*")) or []:
        path = at.getPath()
        name = (path.getParent().getName().split("=", 1)[1], path.getName().split("=", 1)[1])
        if name not in kept:
            fs.delete(path, True)
            gone += 1
    return gone


def merge_artifacts(*listings: DataFrame) -> DataFrame:
    """Artifacts of one run side by side. Each listing is (stem, kind, path)."""
    rows = listings[0]
    for other in listings[1:]:
        rows = rows.unionByName(other)
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("path"))).alias(kind)
    return rows.groupBy("stem").agg(pick("snapshot"), pick("report"), pick("map")).orderBy(F.desc("stem"))


def export_json(tables: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines per table."""
    for name, df in tables.items():
        df.write.mode("errorifexists").json(f"{path}/{name}")


def import_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Nodes and edges of snapshot documents (JSON, gzip by extension)."""
    docs = spark.read.option("multiLine", True).json(path).withColumn(
        "snapshot_file", F.col("_metadata.file_name"))
    return {
        name: docs.select("snapshot_file", F.inline(name))
        for name in ("nodes", "edges") if name in docs.columns
    } | {"meta": docs.select("snapshot_file", "meta.*")}
