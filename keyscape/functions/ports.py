"""Responder-port dimension: service class, service name, port predicates."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyscape.functions.columns import as_col, map_literal, reusable

# Results depend on these lists.
CLASS_PORTS = {
    "auth": [88, 389, 464, 636, 749, 1812, 3268, 3269, 9389],
    "name": [53, 137, 3702, 5353],
    "file": [21, 139, 445, 548, 873, 2049],
    "db": [1433, 1434, 1521, 3306, 5432, 5672, 5984, 6379, 8086, 9092, 9200,
           11211, 27017],
    "web": [80, 443, 3000, 4343, 5000, 6443, 8000, 8006, 8080, 8123, 8443, 8530,
            8531, 8843, 8888, 9090, 10443, 32400],
    "admin": [22, 23, 830, 1494, 2375, 2376, 2598, 3389, 5900, 5901, 5902, 5985,
              5986],
}
CLASS_LABELS = {
    "auth": "auth",
    "name": "name resolution",
    "file": "file",
    "db": "database",
    "web": "web",
    "admin": "admin (RDP/SSH)",
    "other": "other",
}
CLASS_COLORS = {
    "auth": "#d95f30",
    "name": "#3d7edb",
    "file": "#3f9d5a",
    "db": "#8858c8",
    "web": "#8a8f98",
    "admin": "#d8a02e",
    "other": "#c3c7cd",
}
PORT_NAMES = {
    21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 49: "tacacs", 53: "dns",
    67: "dhcp", 68: "dhcp", 69: "tftp", 80: "http", 88: "kerberos", 110: "pop3",
    123: "ntp", 135: "msrpc", 137: "netbios-ns", 139: "netbios", 143: "imap",
    161: "snmp", 162: "snmp-trap", 389: "ldap", 443: "https", 445: "smb",
    464: "kpasswd", 465: "smtps", 500: "ike", 514: "syslog", 546: "dhcpv6",
    547: "dhcpv6", 548: "afp", 554: "rtsp", 587: "submission", 593: "rpc-http",
    631: "ipp", 636: "ldaps", 749: "kadmin", 830: "netconf", 873: "rsync",
    902: "vmware", 993: "imaps", 995: "pop3s", 1194: "openvpn", 1433: "mssql",
    1434: "mssql-browser", 1494: "citrix-ica", 1521: "oracle",
    1645: "radius-legacy", 1646: "radius-legacy-acct", 1723: "pptp",
    1812: "radius", 1883: "mqtt", 1900: "ssdp", 2049: "nfs", 2083: "radsec",
    2375: "docker", 2376: "docker-tls", 2598: "citrix-cgp", 3000: "grafana",
    3221: "jms", 3268: "ldap-gc", 3269: "ldaps-gc", 3306: "mysql", 3389: "rdp",
    3478: "stun", 3702: "ws-discovery", 4343: "aruba-https", 4500: "ipsec-nat",
    4786: "smart-install", 5000: "upnp/octoprint", 5060: "sip", 5061: "sips",
    5246: "capwap", 5247: "capwap-data", 5353: "mdns", 5432: "postgres",
    5672: "amqp", 5900: "vnc", 5901: "vnc", 5902: "vnc", 5984: "couchdb",
    5985: "winrm", 5986: "winrm-tls", 6379: "redis", 6443: "kubernetes",
    6789: "unifi-speedtest", 7734: "meraki-cloud", 7804: "juniper-space",
    8000: "http-alt", 8006: "proxmox", 8080: "http-alt", 8086: "influxdb",
    8123: "home-assistant", 8211: "papi", 8443: "https-alt", 8530: "wsus",
    8531: "wsus-tls", 8843: "unifi-guest", 8880: "unifi-http", 8883: "mqtts",
    8888: "http-alt", 9090: "prometheus", 9092: "kafka", 9100: "jetdirect",
    9200: "elasticsearch", 9350: "meraki-mtunnel", 9389: "adws",
    10001: "unifi-discovery", 10443: "unifi", 11211: "memcached",
    25565: "minecraft", 27017: "mongodb", 32400: "plex", 51820: "wireguard",
}
GEAR_PORTS = [49, 4786, 5246, 5247, 6789, 8211, 8880]
MAIL_PORTS = [25, 110, 143, 465, 587, 993, 995]
PRINTER_PORTS = [631, 9100]
CAMERA_PORTS = [554]
EXTRA_SENSITIVE_PORTS = [67, 123]

CRITICAL_PORTS = sorted(chain(*(CLASS_PORTS[c] for c in ("auth", "name", "file", "db"))))
AUTH_EDGE_PORTS = sorted(CLASS_PORTS["auth"] + CLASS_PORTS["name"])
SENSITIVE_PORTS = sorted(CRITICAL_PORTS + EXTRA_SENSITIVE_PORTS)


def _lookup(mapping: dict, key: Column) -> Column:
    return F.element_at(map_literal(mapping), key)


@reusable
def service_class(port) -> Column:
    port = as_col(port)
    expr = None
    for name, ports in CLASS_PORTS.items():
        hit = port.isin(ports)
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    return expr.otherwise("other")


@reusable
def class_label(cls) -> Column:
    return F.coalesce(_lookup(CLASS_LABELS, as_col(cls)), F.lit("other"))


@reusable
def class_color(cls) -> Column:
    return F.coalesce(
        _lookup(CLASS_COLORS, as_col(cls)), F.lit(CLASS_COLORS["other"])
    )


@reusable
def known_service(port) -> Column:
    """Short name of a notable port, empty otherwise."""
    return F.coalesce(_lookup(PORT_NAMES, as_col(port).cast("int")), F.lit(""))


@reusable
def service_name(port) -> Column:
    port = as_col(port)
    return F.coalesce(
        _lookup(PORT_NAMES, port.cast("int")),
        F.concat(F.lit("port-"), port.cast("string")),
    )


@reusable
def is_critical(port) -> Column:
    return as_col(port).isin(CRITICAL_PORTS)


@reusable
def is_auth_edge(port) -> Column:
    return as_col(port).isin(AUTH_EDGE_PORTS)


@reusable
def is_admin(port) -> Column:
    return as_col(port).isin(CLASS_PORTS["admin"])


@reusable
def is_database(port) -> Column:
    return as_col(port).isin(CLASS_PORTS["db"])


@reusable
def is_sensitive(port) -> Column:
    return as_col(port).isin(SENSITIVE_PORTS)


@reusable
def is_gear(port) -> Column:
    return as_col(port).isin(GEAR_PORTS)


@reusable
def is_mail(port) -> Column:
    return as_col(port).isin(MAIL_PORTS)


def is_printer(port) -> Column:
    return as_col(port).isin(PRINTER_PORTS)


def is_camera(port) -> Column:
    return as_col(port).isin(CAMERA_PORTS)
