"""Snapshot tables, exports, overlays and asset files on disk."""

import gzip
import json

import pytest

from pyspark.sql import functions as F

from keyscape.sources import assets, overlays, snapshots


def test_snapshot_round_trip(spark, tmp_path):
    root = str(tmp_path / "snaps")
    nodes = spark.createDataFrame([("10.0.0.1",), ("10.0.0.2",)], "ip string")
    edges = spark.createDataFrame([("10.0.0.1", "10.0.0.2", 53)], "src string, dst string, port int")
    for sid, day in (("a", "2024-01-01"), ("b", "2024-01-02")):
        meta = spark.createDataFrame([(day, "1h", "grid")], "created_at string, window string, cluster_name string")
        snapshots.save({"meta": meta, "nodes": nodes, "edges": edges}, root, sid)
    listed = snapshots.catalogue(spark, root).select("snapshot_id", "nodes", "edges").collect()
    assert [tuple(r) for r in listed] == [("b", 2, 1), ("a", 2, 1)]
    assert snapshots.read(spark, root, "nodes", "a").count() == 2
    try:
        snapshots.save({"meta": meta, "nodes": nodes, "edges": edges}, root, "a")
        raise AssertionError("an existing id must be refused")
    except ValueError:
        pass
    snapshots.export_json({"edges": edges}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "edges")).count() == 1


def _tables(spark, ips, gateways=True, **more):
    made = {
        "meta": spark.createDataFrame([("2024-01-01", "1h", "grid")], "created_at string, window string, cluster_name string"),
        "nodes": spark.createDataFrame([(x,) for x in ips], "ip string"),
        "edges": spark.createDataFrame([(x, x, 53) for x in ips], "src string, dst string, port int")}
    if gateways:
        made["gateways"] = spark.createDataFrame([], "sensor string, mac string, ip_count bigint")
    return {**made, **more}


def test_empty_tables_are_read_back_with_their_schema(spark, tmp_path):
    root = str(tmp_path / "snaps")
    snapshots.save(_tables(spark, []), root, "none")
    got = snapshots.load(spark, root, "none")
    assert {t: got[t].count() for t in got} == {"meta": 1, "nodes": 0, "edges": 0, "gateways": 0}
    assert got["gateways"].columns == ["sensor", "mac", "ip_count", "snapshot_id"]
    assert dict(got["edges"].dtypes)["port"] == "int"
    with pytest.raises(snapshots.UnknownSnapshot):
        snapshots.load(spark, root, "other")
    with pytest.raises(snapshots.UnknownSnapshot):
        snapshots.read(spark, str(tmp_path / "nowhere"), "nodes")
    with pytest.raises(ValueError, match="not a snapshot id"):
        snapshots.save(_tables(spark, []), root, "a/b")


@pytest.mark.parametrize("broken", ["nodes", "gateways", "meta"])
def test_crash_and_retry_gives_each_row_once(spark, tmp_path, broken):
    """A save that fails in any table shows nothing; the same id can be saved again."""
    root = str(tmp_path / "snaps")
    snapshots.save(_tables(spark, ["10.0.0.9"]), root, "before")
    bad = _tables(spark, ["10.0.0.1", "10.0.0.2"])
    bad[broken] = bad[broken].unionByName(spark.createDataFrame([tuple([None] * len(bad[broken].columns))], bad[broken].schema)).withColumn(
        bad[broken].columns[0], F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        snapshots.save(bad, root, "again")
    assert [r.snapshot_id for r in snapshots.catalogue(spark, root).collect()] == ["before"]
    assert [r.ip for r in snapshots.read(spark, root, "nodes").collect()] == ["10.0.0.9"]
    snapshots.save(_tables(spark, ["10.0.0.1", "10.0.0.2"]), root, "again")
    assert sorted(r.ip for r in snapshots.read(spark, root, "nodes", "again").collect()) == ["10.0.0.1", "10.0.0.2"]
    assert snapshots.read(spark, root, "nodes").count() == 3
    assert snapshots.discard_unfinished(spark, root) > 0
    assert snapshots.discard_unfinished(spark, root) == 0
    assert snapshots.read(spark, root, "edges").count() == 3


def test_two_attempts_under_one_id(spark, tmp_path):
    """Staged side by side, published one after the other: the first is read."""
    root = str(tmp_path / "snaps")
    one = snapshots.stage(_tables(spark, ["10.0.0.1"]), root, "x")
    two = snapshots.stage(_tables(spark, ["10.0.0.2"]), root, "x")
    with pytest.raises(snapshots.UnknownSnapshot):
        snapshots.read(spark, root, "nodes")
    snapshots.publish(spark, root, two)
    with pytest.raises(ValueError, match="exists"):
        snapshots.publish(spark, root, one)
    assert [r.ip for r in snapshots.read(spark, root, "nodes").collect()] == ["10.0.0.2"]


def test_tables_and_columns_that_only_some_snapshots_have(spark, tmp_path):
    root = str(tmp_path / "snaps")
    snapshots.save(_tables(spark, ["10.0.0.1"], gateways=False), root, "0012")
    wider = spark.createDataFrame([("10.0.0.2", 7)], "ip string, rank int")
    snapshots.save(_tables(spark, [], nodes=wider), root, "12")
    rows = {r.ip: (r.snapshot_id, r["rank"]) for r in snapshots.read(spark, root, "nodes").collect()}
    assert rows == {"10.0.0.1": ("0012", None), "10.0.0.2": ("12", 7)}
    assert snapshots.read(spark, root, "gateways", "0012").count() == 0
    snapshots.save(_tables(spark, [], nodes=wider.withColumn("rank", F.lit("x"))), root, "text")
    with pytest.raises(ValueError, match="rank has types"):
        snapshots.read(spark, root, "nodes")


def test_one_snapshot_reads_its_own_folder_only(spark, tmp_path):
    root = str(tmp_path / "snaps")
    for sid in ("a", "b"):
        snapshots.save(_tables(spark, ["10.0.0.1"]), root, sid)
    files = snapshots.read(spark, root, "nodes", "b").select(F.input_file_name()).distinct().collect()
    assert files and all("snapshot_id=b" in r[0] for r in files)


def test_snapshot_documents_and_their_artifacts(spark, tmp_path):
    doc = {"meta": {"created_at": "2024-01-01T00:00:00Z", "window": "1h"}, "nodes": [{"ip": "10.0.0.1"}],
           "edges": [{"src": "10.0.0.2", "dst": "10.0.0.1", "port": 53}, {"src": "10.0.0.3", "dst": "10.0.0.1", "port": 53}]}
    with gzip.open(tmp_path / "one.json.gz", "wt") as f:
        json.dump(doc, f, indent=1)
    t = snapshots.import_json(spark, str(tmp_path / "*.json.gz"))
    assert [tuple(r) for r in t["edges"].select("snapshot_file", "src", "port").orderBy("src").collect()] == [
        ("one.json.gz", "10.0.0.2", 53), ("one.json.gz", "10.0.0.3", 53)]
    assert t["meta"].first().window == "1h" and t["nodes"].count() == 1
    listing = lambda kind, stems: spark.createDataFrame(
        [(s, kind, f"{kind}/{s}") for s in stems], "stem string, kind string, path string")
    got = snapshots.merge_artifacts(listing("snapshot", ["b", "a"]), listing("report", ["b"]), listing("map", ["c"]))
    assert [tuple(r) for r in got.collect()] == [
        ("c", None, None, "map/c"), ("b", "snapshot/b", "report/b", None), ("a", "snapshot/a", None, None)]


def test_overlay_document(spark, tmp_path):
    path = tmp_path / "registry.json"
    path.write_text(json.dumps({
        "devices": [{"name": "d1", "type": "server", "ips": ["10.0.0.1", "10.0.0.2"], "notes": "private"}],
        "labels": {"10.0.0.1": ["x", "y"]}, "role_overrides": {"10.0.0.1": "box"}, "pinned": ["10.0.0.9"],
        "segments": [{"cidr": "10.0.0.0/25", "name": "low"}], "approved_providers": ["10.0.0.1:53"]}))
    t = overlays.read(spark, str(path))
    assert t["devices"].count() == 2 and t["labels"].count() == 2
    assert t["segments"].first().name == "low" and t["approved"].first().provider == "10.0.0.1:53"


def test_asset_file(spark, tmp_path):
    path = tmp_path / "assets.csv"
    path.write_text("﻿MAC Address,IP,Asset Name,VLAN Name\naa,10.0.0.1,one,v1\nbb,none,two,v2\ncc,10.0.0.1,three,v3\n")
    good, bad = assets.parse(assets.read_rows(spark, str(path), width=5))
    assert [(r.ip, r.hostname, r.segment, r.row) for r in good.collect()] == [("10.0.0.1", "one", "v1", 2)]
    assert sorted(r.row for r in bad.select(F.col("row")).collect()) == [3, 4]


def test_run_scope_deletes_intermediates(spark):
    from pathlib import Path

    from keyscape.session import durable_dir, materialize, run_scope

    folder = Path(durable_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    with run_scope(spark):
        assert materialize(spark.range(3), "scratch").count() == 3
        assert set(folder.iterdir()) != before
    assert set(folder.iterdir()) == before
