"""Asset list ingest: find the columns, keep usable rows, explain the rest."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyscape.functions import ip as ipf
from keyscape.operators.positions import with_position

# Header wording, checked in this order.
IP_TOKENS = ["ip", "ipaddress", "ipaddr", "ipv4", "ipv6"]
ADDRESS_WORDS = ["address", "addr"]
KEYWORDS = {
    "segment": ["vlan", "segment", "subnet", "site", "enclave", "zone", "network"],
    "hostname": ["host", "name", "fqdn", "asset", "system", "device"],
    "role": ["role", "function", "type", "purpose", "service", "description"],
}


def header_columns(header: list[str]) -> dict[str, int]:
    """Column positions by header wording; no ``ip`` entry when it is not a
    header row. One row of cells, so plain Python on the driver."""
    cells = [(c or "").replace("﻿", "").strip().lower() for c in header]
    found: dict[str, int] = {}
    for i, cell in enumerate(cells):
        if set(re.split(r"[\W_]+", cell)) & set(IP_TOKENS):
            found["ip"] = i
            break
    else:
        for i, cell in enumerate(cells):
            if "mac" not in cell and any(w in cell for w in ADDRESS_WORDS):
                found["ip"] = i
                break
    for i, cell in enumerate(cells):
        if i == found.get("ip"):
            continue
        for name, words in KEYWORDS.items():
            if name not in found and any(w in cell for w in words):
                found[name] = i
                break
    return found


def read_rows(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """Cells of every record as ``c0..`` plus the 1-based ``row``. There are as many
    columns as the first record has cells, or ``width``; short records are padded
    with NULL. Quoted cells may hold line breaks."""
    source = (
        spark.read.option("header", False).option("mode", "PERMISSIVE")
        .option("ignoreLeadingWhiteSpace", True).option("multiLine", True)
    )
    if width is None:
        width = len(source.csv(path).columns)
    raw = source.schema(", ".join(f"c{i} STRING" for i in range(width))).csv(path)
    tagged = raw.select("*", F.col("_metadata.file_block_start").alias("_block"),
                        F.monotonically_increasing_id().alias("_line"))
    return with_position(tagged, ["_block", "_line"], "row").drop("_block", "_line")


def parse(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(assets, warnings)`` from cell rows. A list without a header uses the
    column with most addresses."""
    cells = [c for c in rows.columns if c != "row"]
    first = rows.filter("row = 1").select(*cells).first()
    columns = header_columns(list(first) if first else [])
    headered = "ip" in columns
    if not headered:
        hits = rows.agg(*[F.count_if(ipf.is_ip(F.trim(c))).alias(c) for c in cells]).first()
        best = max(cells, key=lambda c: (hits[c], -cells.index(c)))
        if hits[best] == 0:
            raise ValueError("no IP column: no ip/address header and no column of addresses")
        columns = {"ip": cells.index(best)}
    data = rows.filter("row > 1") if headered else rows

    def cell(name: str):
        if name not in columns:
            return F.lit("")
        return F.trim(F.coalesce(F.col(cells[columns[name]]), F.lit("")))

    text = F.concat_ws("", *cells)
    shaped = data.select(
        "row", ipf.key_to_text(ipf.ip_key(cell("ip"))).alias("ip"), cell("ip").alias("given"),
        cell("hostname").alias("hostname"), cell("role").alias("role"),
        cell("segment").alias("segment"), (F.trim(text) == "").alias("blank"))
    good = shaped.filter("ip IS NOT NULL")
    first_row = good.groupBy("ip").agg(F.min("row").alias("row"))
    assets = good.join(first_row, ["ip", "row"]).select("ip", "hostname", "role", "segment", "row")
    bad = shaped.filter("ip IS NULL AND NOT blank").select("row", F.concat(
        F.lit("row "), F.col("row").cast("string"), F.lit(': no parseable IP ("'), F.col("given"),
        F.lit('") — skipped')).alias("warning"))
    again = good.join(first_row.select(F.col("ip"), F.col("row").alias("kept")), "ip").filter(
        "row <> kept").select("row", F.concat(
            F.lit("row "), F.col("row").cast("string"), F.lit(": duplicate IP "), F.col("ip"),
            F.lit(" — first occurrence kept")).alias("warning"))
    return assets, bad.unionByName(again)
