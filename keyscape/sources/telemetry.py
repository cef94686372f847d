"""Telemetry scan: physical columns onto fixed concepts, window, scope."""

from __future__ import annotations

import ipaddress
import json
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyscape.functions import ip as ipf
from keyscape.functions.columns import as_col

# Default physical name of every concept, and its type here.
DEFAULT_COLUMNS = {
    "ts": ("@timestamp", "timestamp"),
    "dataset": ("event.dataset", "string"),
    "sensor": ("observer.name", "string"),
    "message": ("message", "string"),
    "server_name": ("ssl.server_name", "string"),
    "host_key": ("ssh.host_key", "string"),
    "src": ("source.ip", "string"),
    "dst": ("destination.ip", "string"),
    "port": ("destination.port", "int"),
    "proto": ("network.transport", "string"),
    "service": ("network.protocol", "string"),
    "bytes_out": ("source.bytes", "bigint"),
    "bytes_in": ("destination.bytes", "bigint"),
    "src_mac": ("source.mac", "string"),
    "dst_mac": ("destination.mac", "string"),
    "state": ("connection.state", "string"),
    "dhcp_server": ("server.address", "string"),
    "dhcp_client": ("client.address", "string"),
    "assigned_ip": ("dhcp.assigned_ip", "string"),
    "lease_hostname": ("dhcp.host_name", "string"),
    "lease_mac": ("host.mac", "string"),
    "lease_time": ("dhcp.lease_time", "string"),
    "san_dns": ("x509.san_dns", "array<string>"),
    "subject": ("x509.certificate.subject", "string"),
}
DEFAULT_DATASETS = {
    "conn": ["conn", "zeek.conn"],
    "dns": ["dns", "zeek.dns"],
    "kerberos": ["kerberos", "zeek.kerberos"],
    "smb": ["smb_mapping", "smb_files", "zeek.smb_mapping", "zeek.smb_files"],
    "ssl": ["ssl", "zeek.ssl"],
    "http": ["http", "zeek.http"],
    "dhcp": ["dhcp", "zeek.dhcp"],
    "ldap": ["ldap", "zeek.ldap"],
    "x509": ["x509", "zeek.x509"],
    "ssh": ["ssh", "zeek.ssh"],
}
REQUIRED = ["ts", "dataset", "src", "dst", "port"]


@dataclass(frozen=True)
class FieldMap:
    columns: dict[str, str] = field(
        default_factory=lambda: {k: v[0] for k, v in DEFAULT_COLUMNS.items()}
    )
    datasets: dict[str, list[str]] = field(
        default_factory=lambda: {k: list(v) for k, v in DEFAULT_DATASETS.items()}
    )

    def override(self, columns: dict | None = None, datasets: dict | None = None):
        """Empty entries keep what is already mapped."""
        return FieldMap(
            {**self.columns, **{k: v for k, v in (columns or {}).items() if v}},
            {**self.datasets, **{k: v for k, v in (datasets or {}).items() if v}},
        )


def load_field_map(path: str | None = None) -> FieldMap:
    """Defaults merged with a small JSON or YAML override file."""
    if not path:
        return FieldMap()
    with open(path, encoding="utf-8") as fh:
        text = fh.read()
    try:
        raw = json.loads(text)
    except ValueError:
        import yaml

        raw = yaml.safe_load(text) or {}
    datasets = raw.pop("datasets", {})
    return FieldMap().override(raw.get("columns", raw), datasets)


def _has(schema: T.StructType, parts: list[str]) -> bool:
    for i, part in enumerate(parts):
        if part not in schema.fieldNames():
            return False
        kind = schema[part].dataType
        if i == len(parts) - 1:
            return True
        if not isinstance(kind, T.StructType):
            return False
        schema = kind
    return False


def physical_column(df: DataFrame, name: str) -> Column | None:
    """Resolve a dotted name: a flat column of that name first, then a nested
    field; None when the source has neither."""
    if name in df.columns:
        return F.col(f"`{name}`")
    parts = name.split(".")
    if _has(df.schema, parts):
        return F.col(".".join(f"`{p}`" for p in parts))
    return None


def canonical(
    df: DataFrame, fields: FieldMap, concepts: Iterable[str] | None = None
) -> DataFrame:
    """Project onto concepts. A missing optional column becomes NULL, a missing
    required one is an error."""
    out = []
    for concept in concepts or DEFAULT_COLUMNS:
        kind = DEFAULT_COLUMNS[concept][1]
        found = physical_column(df, fields.columns[concept])
        if found is None and concept in REQUIRED:
            raise ValueError(
                f"required column {fields.columns[concept]!r} ({concept}) not found"
            )
        value = F.lit(None) if found is None else found
        out.append(value.cast(kind).alias(concept))
    return df.select(*out)


def in_window(df: DataFrame, as_of, seconds: int, ts: str = "ts") -> DataFrame:
    """Rows no older than ``seconds`` before ``as_of``. The instant is an
    argument, so a run can be repeated."""
    start = F.lit(as_of).cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds))
    return df.filter(F.col(ts) >= start)


def of_dataset(df: DataFrame, fields: FieldMap, kind: str) -> DataFrame:
    return df.filter(F.col("dataset").isin(fields.datasets[kind]))


def in_cidr(ip, cidr: str) -> Column:
    """Membership in one literal CIDR. Octet-aligned IPv4 blocks become string
    prefixes, which Parquet can skip row groups on."""
    ip = as_col(ip)
    net = ipaddress.ip_network(cidr, strict=False)
    if net.version == 4 and net.prefixlen == 32:
        return ip == str(net.network_address)
    if net.version == 4 and net.prefixlen % 8 == 0 and net.prefixlen > 0:
        octets = str(net.network_address).split(".")[: net.prefixlen // 8]
        return ip.startswith(".".join(octets) + ".") & ipf.is_ipv4(ip)
    width = net.max_prefixlen // 4
    family = "4" if net.version == 4 else "6"
    lo = family + format(int(net.network_address), "x").zfill(width)
    hi = family + format(int(net.broadcast_address), "x").zfill(width)
    return F.coalesce(ipf.ip_key(ip).between(lo, hi), F.lit(False))


def in_scope(
    df: DataFrame, cidrs: list[str], src: str = "src", dst: str = "dst"
) -> DataFrame:
    """Keep rows with either end inside any CIDR; no CIDRs keeps everything."""
    if not cidrs:
        return df
    test = None
    for cidr in cidrs:
        hit = in_cidr(src, cidr) | in_cidr(dst, cidr)
        test = hit if test is None else test | hit
    return df.filter(test)


def present(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.filter(F.col(c).isNotNull())
    return df
