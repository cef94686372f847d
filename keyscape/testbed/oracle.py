"""Reference SQL of the checked queries: common table expressions plus bodies.

``sql(name)`` puts every expression a body mentions, directly or through other
expressions, in front of it.
"""

from __future__ import annotations

import re

from keyscape.functions import ports, text
from keyscape.testbed import projection as P

CTES: dict[str, str] = {}
BODIES: dict[str, str] = {}


def _in(values) -> str:
    return "(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in values) + ")"


def _server(key: str) -> str:
    return (f"'10.0.' || CAST(floor({key} / 25) AS BIGINT) % 250 || '.' || (10 + {key} % 25)")


def _client(c: str) -> str:
    return f"'10.' || (1 + {c} % 3) || '.' || CAST(floor({c} / 200) AS BIGINT) % 250 || '.' || (10 + {c} % 200)"


def _subnet(ip: str) -> str:
    return f"regexp_extract({ip}, '^(\\d+\\.\\d+\\.\\d+)\\.', 1) || '.0/24'"


_ARTEFACT = "'^(2(2[4-9]|3[0-9])\\.|127\\.|169\\.254\\.|0\\.0\\.0\\.0$|255\\.255\\.255\\.255$)'"
_PRIVATE = "'^(10\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|192\\.168\\.)'"


def _terrain(ip: str) -> str:
    return f"(NOT regexp_matches({ip}, {_ARTEFACT}))"


def _private(ip: str) -> str:
    return f"regexp_matches({ip}, {_PRIVATE})"


def _cls(port: str) -> str:
    whens = " ".join(f"WHEN {port} IN {_in(ps)} THEN '{c}'" for c, ps in ports.CLASS_PORTS.items())
    return f"(CASE {whens} ELSE 'other' END)"


def _map(expr: str, table: dict, default: str) -> str:
    whens = " ".join(
        f"WHEN {k if isinstance(k, int) else repr(k)} THEN '{v}'" for k, v in table.items())
    return f"(CASE {expr} {whens} ELSE {default} END)"


def _name(port: str) -> str:
    return _map(port, ports.PORT_NAMES, f"'port-' || {port}")


CTES["raw"] = f"""
SELECT o.o_custkey AS c, l.l_orderkey AS k, CAST(l.l_shipdate AS TIMESTAMP) AS d, l.l_returnflag AS flag,
  l.l_linestatus AS ls, l.l_quantity AS q, l.l_extendedprice AS x, l.l_suppkey AS dk, {_client('o.o_custkey')} AS src
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
UNION ALL
SELECT o.o_custkey, l.l_orderkey, CAST(l.l_shipdate AS TIMESTAMP), l.l_returnflag, l.l_linestatus, l.l_quantity,
  l.l_extendedprice, CASE WHEN l.l_suppkey % 25 = 0 THEN 6 + 16 * (l.l_partkey % 6) ELSE l.l_partkey % 40 END,
  {_server('l.l_suppkey')}
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderpriority = '1-URGENT'"""
CTES["conn"] = f"""
SELECT (CASE WHEN dk % 5 = 0 AND isodow(d) >= 6 THEN d - INTERVAL 2 DAY ELSE d END)
    + to_hours(CAST(CASE dk % 5 WHEN 0 THEN 9 + k % 8 WHEN 1 THEN 22 + k % 2 WHEN 2 THEN 14 WHEN 3 THEN k % 24
      ELSE k % 12 END AS INTEGER)) AS ts, 'conn' AS dataset, src,
  CASE dk % 100 WHEN 97 THEN '224.0.0.251' WHEN 98 THEN '255.255.255.255' WHEN 99 THEN '8.8.8.8'
    ELSE {_server('dk')} END AS dst,
  CAST(CASE WHEN dk BETWEEN 41 AND 46 THEN list_extract([1521, 3306, 6379, 9200, 9092, 2049], CAST(dk - 40 AS INTEGER))
    WHEN dk BETWEEN 51 AND 56 AND d >= TIMESTAMP '1997-07-01' THEN 636
    ELSE list_extract({list(P.PORTS)}, CAST(dk % 16 + 1 AS INTEGER)) END AS INTEGER) AS port,
  CASE WHEN dk % 7 = 6 THEN NULL WHEN dk % 16 IN (2, 11, 12) THEN 'udp' ELSE 'tcp' END AS proto,
  CASE flag WHEN 'A' THEN 'SF' WHEN 'N' THEN 'S0' ELSE 'REJ' END AS state,
  CASE WHEN flag = 'A' AND ls = 'F' THEN 'app' WHEN flag = 'R' THEN '-' ELSE '' END AS service,
  CAST(floor(x) AS BIGINT) AS bytes_out, CASE WHEN flag = 'A' THEN CAST(q AS BIGINT) ELSE 0 END AS bytes_in,
  'sensor-' || (k % 4) AS sensor,
  CASE WHEN dk % 3 = 0 THEN '{P.GATEWAY_MAC}' ELSE '24:5a:4c:00:00:' || lpad(CAST(dk % 100 AS VARCHAR), 2, '0') END AS dst_mac,
  c, k, dk, CASE WHEN d < TIMESTAMP '1997-07-01' THEN 1 WHEN d < TIMESTAMP '2000-01-01' THEN 2 ELSE 3 END AS snapshot
FROM raw"""
CTES["logs"] = """
SELECT u.kind, dst AS responder, src AS client, ts, snapshot FROM conn, (VALUES ('kerberos'), ('ldap'), ('dns'), ('smb'),
  ('ssl'), ('http'), ('dhcp')) u(kind)
WHERE (kind = 'kerberos' AND port = 88) OR (kind = 'ldap' AND port IN (88, 389)) OR (kind = 'dns' AND port = 53)
  OR (kind = 'smb' AND port = 445) OR (kind = 'ssl' AND port = 443) OR (kind = 'http' AND port = 443 AND k % 2 = 0)
  OR (kind = 'dhcp' AND port = 67)"""

_WINDOW_SCOPE = ("ts >= TIMESTAMP '1997-04-06' AND (src LIKE '10.1.%' OR dst LIKE '10.1.%' OR src LIKE '10.0.3.%' "
                 "OR dst LIKE '10.0.3.%')")
for sfx, where in (("", "TRUE"), ("_1", "snapshot = 1"), ("_2", "snapshot = 2"), ("_3", "snapshot = 3"),
                   ("_w", _WINDOW_SCOPE)):
    CTES[f"edges{sfx}"] = f"""
SELECT src, dst, port, coalesce(proto, '') AS proto, {_name('port')} AS service,
  list_extract(['port-only', 'responder-confirmed', 'protocol-confirmed'], CAST(1 + max(CASE WHEN service NOT IN
    ('', '-', 'unknown') THEN 2 WHEN state IN ('SF', 'S1', 'S2', 'S3', 'RSTO', 'RSTR') OR bytes_in > 0 THEN 1 ELSE 0 END)
    AS INTEGER)) AS evidence,
  count(*) AS conn_count, CAST(sum(bytes_out) AS BIGINT) AS bytes_out, CAST(sum(bytes_in) AS BIGINT) AS bytes_in,
  min(ts) AS first_seen, max(ts) AS last_seen, list_sort(list(DISTINCT sensor)) AS sensors
FROM conn WHERE {where} GROUP BY src, dst, port, coalesce(proto, '')"""
    CTES[f"conf{sfx}"] = f"SELECT * FROM edges{sfx} WHERE evidence <> 'port-only'"
    CTES[f"ends{sfx}"] = f"""
SELECT src AS ip, first_seen, last_seen, sensors FROM edges{sfx} UNION ALL
SELECT dst, first_seen, last_seen, sensors FROM edges{sfx}"""
    CTES[f"hosts{sfx}"] = f"""
SELECT ip, min(first_seen) AS first_seen, max(last_seen) AS last_seen,
  list_sort(list_distinct(flatten(list(sensors)))) AS sensors, {_subnet('ip')} AS subnet, {_terrain('ip')} AS terrain
FROM ends{sfx} GROUP BY ip"""
    CTES[f"crit{sfx}"] = f"""
SELECT dst AS ip, count(DISTINCT CASE WHEN port IN {_in(ports.CRITICAL_PORTS)} THEN src END) AS dependents,
  count(DISTINCT {_subnet('src')}) AS spread FROM conf{sfx} GROUP BY dst"""
    CTES[f"raw_scores{sfx}"] = f"""
SELECT h.*, coalesce(c.dependents, 0) AS dependents, coalesce(c.spread, 0) AS spread
FROM hosts{sfx} h LEFT JOIN crit{sfx} c USING (ip)"""
    CTES[f"scored{sfx}"] = f"""
SELECT ip, subnet, terrain, dependents, spread, first_seen, last_seen, sensors, composite,
  CAST(row_number() OVER (ORDER BY composite DESC, ip) AS INTEGER) AS rank FROM (
  SELECT r.*, CASE WHEN terrain THEN round(
    0.40 * CASE WHEN b.hd > b.ld THEN (dependents - b.ld) / CAST(b.hd - b.ld AS DOUBLE) ELSE 0 END
    + 0.15 * CASE WHEN b.hs > b.ls THEN (spread - b.ls) / CAST(b.hs - b.ls AS DOUBLE) ELSE 0 END, 12) ELSE 0.0 END AS composite
  FROM raw_scores{sfx} r, (SELECT min(dependents) ld, max(dependents) hd, min(spread) ls, max(spread) hs
    FROM raw_scores{sfx} WHERE terrain) b)"""
    CTES[f"card{sfx}"] = f"""
SELECT kind, responder, count(DISTINCT client) AS clients FROM logs WHERE {where} GROUP BY kind, responder"""
    CTES[f"shape{sfx}"] = f"""
SELECT ip, count(DISTINCT i) AS admin_in, count(DISTINCT o) AS admin_out FROM (
  SELECT dst AS ip, src AS i, NULL AS o FROM conf{sfx} WHERE port IN {_in(ports.CLASS_PORTS['admin'])}
  UNION ALL SELECT src, NULL, dst FROM conf{sfx} WHERE port IN {_in(ports.CLASS_PORTS['admin'])}) GROUP BY ip"""
    CTES[f"portcount{sfx}"] = f"""
SELECT dst AS ip, count(DISTINCT CASE WHEN port IN {_in(ports.CLASS_PORTS['db'])} THEN src END) AS db_clients,
  count(DISTINCT CASE WHEN port IN (631, 9100) THEN src END) AS printer_clients,
  count(DISTINCT CASE WHEN port = 554 THEN src END) AS camera_clients,
  count(DISTINCT CASE WHEN port IN {_in(ports.MAIL_PORTS)} THEN src END) AS mail_clients,
  count(DISTINCT CASE WHEN port IN {_in(ports.GEAR_PORTS)} THEN src END) AS gear_clients
FROM conf{sfx} GROUP BY dst"""
    _k = lambda kind: f"(SELECT responder AS ip, clients FROM card{sfx} WHERE kind = '{kind}')"
    CTES[f"held{sfx}"] = f"""
SELECT ip, role, ord, least(1.0, greatest(0.5, n / (5.0 * mn))) AS confidence, n FROM (
  SELECT ip, 'DomainController' AS role, 1 AS ord, clients AS n, 5 AS mn FROM {_k('kerberos')}
    WHERE ip IN (SELECT ip FROM {_k('ldap')})
  UNION ALL SELECT ip, 'DNSServer', 2, clients, 5 FROM {_k('dns')}
  UNION ALL SELECT ip, 'DHCPServer', 3, clients, 2 FROM {_k('dhcp')}
  UNION ALL SELECT ip, 'FileServer', 4, clients, 3 FROM {_k('smb')}
  UNION ALL SELECT ip, 'Database', 5, db_clients, 2 FROM portcount{sfx}
  UNION ALL SELECT responder, 'WebServer', 6, max(clients), 5 FROM card{sfx} WHERE kind IN ('http', 'ssl') GROUP BY responder
  UNION ALL SELECT ip, 'Printer', 7, printer_clients, 1 FROM portcount{sfx}
  UNION ALL SELECT ip, 'Camera', 8, camera_clients, 1 FROM portcount{sfx}
  UNION ALL SELECT ip, 'MailServer', 9, mail_clients, 2 FROM portcount{sfx}
  UNION ALL SELECT ip, 'NetworkGear', 10, gear_clients, 1 FROM portcount{sfx}) WHERE n >= mn
UNION ALL SELECT ip, 'JumpBox', 11, 0.8, NULL FROM shape{sfx} WHERE admin_in <= 3 AND admin_out >= 5"""
    CTES[f"roles{sfx}"] = f"""
SELECT h.ip, coalesce(arg_min(x.role, CAST(100 - x.confidence * 10 AS DOUBLE) * 1000 + x.ord), 'Unknown') AS top,
  coalesce(string_agg(x.role, ',' ORDER BY x.role), 'Unknown') AS roles
FROM hosts{sfx} h LEFT JOIN held{sfx} x USING (ip) GROUP BY h.ip"""
    CTES[f"sens{sfx}"] = f"""
SELECT * FROM conf{sfx} WHERE port IN {_in(ports.SENSITIVE_PORTS)} AND {_terrain('dst')}"""
    CTES[f"ssh{sfx}"] = f"""
SELECT dst AS ip, list_sort(list(DISTINCT 'key-' || dk || '-' || CASE WHEN dk % 32 = 6 THEN snapshot ELSE 0 END)) AS keys
FROM conn WHERE port = 22 AND {where} GROUP BY dst"""
    CTES[f"names{sfx}"] = f"""
SELECT DISTINCT dst, 'host' || dk || '.corp.example' AS server_name FROM conn WHERE port = 443 AND {where}"""
    CTES[f"tls{sfx}"] = f"""
SELECT dst AS ip, list_sort(list(DISTINCT fp)) AS fps FROM names{sfx} n JOIN certs c
  ON c.name = n.server_name OR (c.name = '*.corp.example' AND n.server_name LIKE '%.corp.example') GROUP BY dst"""

CTES["certs"] = """
SELECT 'fp-' || s_suppkey AS fp, CASE WHEN s_suppkey = 1 THEN '*.corp.example' ELSE 'host' || s_suppkey || '.corp.example' END AS name
FROM supplier UNION ALL SELECT 'fp-' || s_suppkey, 'web' || s_suppkey || '.corp.example' FROM supplier"""
CTES["scope"] = "SELECT * FROM (VALUES ('10.0.0.0/16', '10.0.'), ('10.1.0.0/16', '10.1.'), ('10.9.0.0/24', '10.9.0.')) t(cidr, prefix)"
CTES["gaps"] = "SELECT cidr, prefix FROM scope WHERE NOT EXISTS (SELECT 1 FROM hosts WHERE ip LIKE prefix || '%')"
CTES["leases"] = """
SELECT src AS ip, 'h' || (k % 50) AS host, 'b8:27:eb:00:00:' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS mac FROM conn WHERE port = 67"""
CTES["lease"] = """
SELECT h.ip, h.v AS hostname, m.v AS mac FROM
  (SELECT ip, host AS v, row_number() OVER (PARTITION BY ip ORDER BY count(*) DESC, host) AS r FROM leases GROUP BY ip, host) h
  JOIN (SELECT ip, mac AS v, row_number() OVER (PARTITION BY ip ORDER BY count(*) DESC, mac) AS r FROM leases GROUP BY ip, mac) m
  ON h.ip = m.ip AND h.r = 1 AND m.r = 1"""
CTES["nic"] = """
SELECT ip, mac FROM (SELECT dst AS ip, dst_mac AS mac, row_number() OVER (PARTITION BY dst ORDER BY count(*) DESC, dst_mac) AS r
  FROM conn GROUP BY dst, dst_mac) WHERE r = 1
  AND mac NOT IN (SELECT dst_mac FROM conn GROUP BY dst_mac HAVING count(DISTINCT dst) >= 10)"""
CTES["node_mac"] = "SELECT h.ip, coalesce(n.mac, l.mac, '') AS mac, coalesce(l.hostname, '') AS hostname FROM hosts h LEFT JOIN nic n USING (ip) LEFT JOIN lease l ON l.ip = h.ip"
CTES["assets"] = f"""
SELECT CASE WHEN s_suppkey % 10 = 9 THEN '10.9.0.' || CAST(floor(s_suppkey / 10) AS BIGINT) % 250 ELSE {_server('s_suppkey')} END AS ip,
  s_name AS hostname, list_extract(['Domain Controller', 'Primary DNS', 'SQL DB', 'printer', ''], CAST(s_suppkey % 5 + 1 AS INTEGER)) AS role,
  CASE WHEN s_suppkey % 25 = 0 THEN 'seg-' || CAST(floor(s_suppkey / 25) AS BIGINT) ELSE '' END AS segment
FROM supplier QUALIFY row_number() OVER (PARTITION BY ip ORDER BY s_suppkey) = 1"""
CTES["authority"] = f"""
SELECT dst AS ip, port, {_name('port')} AS service, count(DISTINCT src) AS clients,
  list_extract(['responder-confirmed', 'protocol-confirmed'], CAST(max(CASE evidence WHEN 'protocol-confirmed' THEN 2 ELSE 1 END) AS INTEGER)) AS evidence,
  min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM sens GROUP BY dst, port"""
CTES["contra"] = """
SELECT a.ip, a.role AS documented, e.expected, r.roles AS observed FROM assets a JOIN (VALUES
  ('Domain Controller', 'DomainController'), ('Primary DNS', 'DNSServer'), ('SQL DB', 'Database')) e(t, expected) ON a.role = e.t
  JOIN roles r ON r.ip = a.ip WHERE NOT list_contains(string_split(r.roles, ','), e.expected)"""
CTES["gains"] = """
SELECT n.dst, n.port, n.service, n.src, p.dst AS from_ip, p.port AS from_port FROM
  (SELECT DISTINCT dst, port, service, src FROM sens_2) n
  LEFT JOIN (SELECT service, src, dst, port, row_number() OVER (PARTITION BY service, src ORDER BY
      CAST(split_part(dst, '.', 1) AS INT), CAST(split_part(dst, '.', 2) AS INT), CAST(split_part(dst, '.', 3) AS INT),
      CAST(split_part(dst, '.', 4) AS INT), port) AS r FROM (SELECT DISTINCT dst, port, service, src FROM sens_1)) p
  ON p.service = n.service AND p.src = n.src AND p.r = 1
WHERE (n.dst, n.port, n.src) NOT IN (SELECT (dst, port, src) FROM sens_1)"""
CTES["moves"] = "SELECT dst, port, service, from_ip, from_port, count(*) AS clients FROM gains GROUP BY ALL"
# map
_TIER = """(CASE WHEN top IN ('DomainController', 'DNSServer', 'DHCPServer', 'NetworkGear') THEN 'core'
  WHEN top IN ('FileServer', 'Database', 'WebServer', 'JumpBox', 'MailServer') OR composite >= 0.3 THEN 'service' ELSE 'client' END)"""
CTES["cells"] = f"""
SELECT s.ip, s.rank, s.composite, s.subnet, s.terrain, r.top, {_TIER} AS tier, n.hostname, n.mac,
  CASE WHEN count(*) OVER (PARTITION BY s.subnet) < 2 THEN 'g:sparse' ELSE 'g:' || s.subnet END AS gid
FROM scored s JOIN roles r USING (ip) JOIN node_mac n USING (ip)"""
CTES["placed"] = """
SELECT *, NOT (tier = 'client' AND top = 'Unknown' AND composite < 0.15) AS visible,
  CASE WHEN NOT (tier = 'client' AND top = 'Unknown' AND composite < 0.15) THEN ip ELSE gid || ':clients' END AS endpoint FROM cells"""


def _bundles(where: str) -> str:
    label = _map(_cls("e.port"), ports.CLASS_LABELS, "'other'")
    return f"""SELECT s.endpoint AS src, d.endpoint AS dst, {label} AS class, count(DISTINCT e.src) AS hosts,
  CAST(sum(e.conn_count) AS BIGINT) AS conns FROM edges e JOIN {where} s ON s.ip = e.src JOIN {where} d ON d.ip = e.dst
  WHERE s.endpoint <> d.endpoint GROUP BY ALL HAVING sum(e.conn_count) >= 5"""


CTES["bundles"] = _bundles("placed")
CTES["segs"] = f"""
SELECT subnet AS cidr, count(*) AS hosts, row_number() OVER (ORDER BY count(*) DESC, subnet) AS r, count(*) OVER () AS total
FROM hosts WHERE {_private('ip')} GROUP BY subnet"""
CTES["kept"] = "SELECT cidr, hosts FROM segs WHERE r <= CASE WHEN total > 64 THEN 63 ELSE 64 END"
CTES["over"] = f"""
SELECT c.*, CASE WHEN k.cidr IS NOT NULL THEN 'g:' || k.cidr WHEN {_private('c.ip')} THEN 'g:other' ELSE 'g:external' END AS ogid,
  k.cidr IS NOT NULL AND c.terrain AND row_number() OVER (PARTITION BY c.subnet, k.cidr IS NOT NULL AND c.terrain ORDER BY c.rank, c.ip) <= 5 AS shown
FROM cells c LEFT JOIN kept k ON k.cidr = c.subnet"""
CTES["overends"] = "SELECT ip, ogid, CASE WHEN shown THEN ip ELSE ogid || ':clients' END AS endpoint FROM over"
CTES["overbundles"] = _bundles("overends")
# declared
CTES["routers"] = "SELECT DISTINCT 1 + c_custkey % 3 AS r, CAST(floor(c_custkey / 200) AS BIGINT) % 250 AS b FROM customer"
CTES["nets"] = "SELECT DISTINCT CAST(floor(s_suppkey / 25) AS BIGINT) % 250 AS n FROM supplier"
_NET_ORD = "row_number() OVER (PARTITION BY ruleset ORDER BY n, item, seq) - 1"
CTES["acl"] = """
SELECT 'edge-' || r || '-' || b AS device, r, b, v.* FROM routers, (VALUES
 (0, 0, 'deny', 'tcp', '0.0.0.0/0', 445, 445, '', 'deny tcp any any eq 445', 13),
 (1, 1, 'permit', 'tcp', '10.0.0.0/16', 80, 443, '', 'permit tcp any 10.0.0.0 0.0.255.255 range 443 80', 14),
 (2, 2, 'permit', 'udp', '8.8.8.8/32', 101, 65535, '', 'permit udp any host 8.8.8.8 gt 100', 15),
 (3, 3, 'permit', 'tcp', '0.0.0.0/0', 0, 0, 'established unsupported', 'permit tcp any any established', 16),
 (4, 4, 'permit', 'tcp', 'lan', 22, 22, '', 'lan', 16),
 (5, 5, 'permit', 'icmp', '0.0.0.0/0', 0, 0, '', 'permit icmp any any', 17)) v(slot, o, action, proto, dst, lo, hi, caveat, raw, line)
WHERE slot <> 3 OR b % 2 = 0"""
CTES["rules_ios"] = """
SELECT device, 'EDGE' AS ruleset, row_number() OVER (PARTITION BY device ORDER BY o) - 1 AS idx, action, proto AS r_proto,
  '0.0.0.0/0' AS r_src, CASE dst WHEN 'lan' THEN '10.0.' || b || '.0/24' ELSE dst END AS r_dst, lo AS port_lo, hi AS port_hi, caveat,
  CASE raw WHEN 'lan' THEN 'permit tcp any 10.0.' || b || '.0 0.0.0.255 eq 22' ELSE raw END AS raw, r, b FROM acl"""
CTES["rules_ctl"] = f"""
SELECT 'ctl' AS device, ruleset, {_NET_ORD} AS idx, action, r_proto, r_src, r_dst, port_lo, port_hi, caveat FROM (
  SELECT n, 1 AS item, seq, 'LAN_IN' AS ruleset, 'deny' AS action, p AS r_proto, '10.0.' || n || '.1/24' AS r_src, '10.0.0.0/24' AS r_dst,
    22 AS port_lo, 90 AS port_hi, '' AS caveat FROM nets, (VALUES (0, 'tcp'), (1, 'udp')) v(seq, p)
  UNION ALL SELECT n, 2, 0, 'GUEST_IN', 'deny', 'udp', '0.0.0.0/0', '0.0.0.0/0', 53, 53, '' FROM nets
  UNION ALL SELECT n, 3, 0, 'LAN_IN', 'permit', 'ip', '0.0.0.0/0', '0.0.0.0/0', 0, 0, 'network-scoped rule unresolved' FROM nets)"""

B = BODIES
B["top_servers"] = f"SELECT ip, dependents, spread FROM crit WHERE {_terrain('ip')}"
B["edges"] = """SELECT src, dst, port, proto, service, evidence, conn_count, bytes_out, bytes_in,
  strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen,
  array_to_string(sensors, ',') AS sensors FROM edges"""
_octets = lambda c: ", ".join(f"CAST(split_part({c}, '.', {i}) AS INT)" for i in range(1, 5))
B["edge_cap"] = f"SELECT src, dst, port, proto, conn_count FROM edges ORDER BY {_octets('src')}, {_octets('dst')}, port, proto LIMIT 1000"
B["evidence_mix"] = "SELECT evidence, count(*) AS edges FROM edges GROUP BY evidence"
B["dataset_counts"] = "SELECT dataset, count(*) AS n FROM (SELECT dataset FROM conn UNION ALL SELECT kind FROM logs) GROUP BY dataset"
B["sensor_counts"] = "SELECT sensor, count(*) AS n FROM conn GROUP BY sensor"
B["mac_coverage"] = "SELECT count(*) AS total, count(proto) AS with_src_mac, count(dst_mac) AS with_dst_mac FROM conn"
CTES["hint_pairs"] = """
SELECT DISTINCT 'hostname' AS kind, hostname AS v, ip FROM node_mac WHERE hostname <> ''
UNION SELECT 'mac', mac, ip FROM node_mac WHERE mac <> ''"""
CTES["hint_groups"] = f"""
SELECT kind || ':' || v AS "key", any_value(v) AS v, count(DISTINCT h.ip) AS n, string_agg(DISTINCT h.ip, ',' ORDER BY h.ip) AS ips
FROM hint_pairs h LEFT JOIN (SELECT {_server('s_suppkey')} AS ip, 'dev-' || CAST(floor(s_suppkey / 2) AS BIGINT) AS device FROM supplier
  WHERE s_suppkey % 10 < 4) d ON d.ip = h.ip GROUP BY kind, v
HAVING count(DISTINCT h.ip) >= 2 AND NOT (count(*) = count(device) AND min(device) = max(device))"""
B["hint_classes"] = """SELECT g."key", h.ip, g.n FROM hint_groups g JOIN hint_pairs h ON h.kind || ':' || h.v = g."key\""""
B["same_device_hints"] = """SELECT "key", CASE WHEN "key" LIKE 'mac:24:5a:4c%' THEN 'Ubiquiti' WHEN "key" LIKE 'mac:b8:27:eb%' THEN 'Raspberry Pi' ELSE v END AS name, ips FROM hint_groups
WHERE "key" NOT IN (SELECT 'hostname:h' || (p_partkey % 50) FROM part WHERE p_size < 5)"""
B["streamed_edges"] = B["edges"]
B["streamed_identity"] = """SELECT 'mac' AS what, ip AS "key", mac AS "value", 0 AS n FROM nic WHERE mac <> ''
UNION ALL SELECT 'gateway', sensor, dst_mac, count(DISTINCT dst) FROM conn GROUP BY sensor, dst_mac HAVING count(DISTINCT dst) >= 10
UNION ALL SELECT 'sensor', '', sensor, count(*) FROM conn GROUP BY sensor UNION ALL SELECT 'dataset', '', dataset, count(*) FROM conn GROUP BY dataset
UNION ALL SELECT 'total', '', '', count(*) FROM conn UNION ALL SELECT 'with_src_mac', '', '', count(proto) FROM conn
UNION ALL SELECT 'with_dst_mac', '', '', count(dst_mac) FROM conn"""
B["streamed_profiles"] = "SELECT dst AS ip, " + ", ".join(
    "concat_ws(',', " + ", ".join(f"count(*) FILTER ({f} = {k})" for k in range(n)) + f") AS {name}"
    for name, f, n in (("hours", "hour(ts)", 24), ("dow", "dayofweek(ts)", 7))) + " FROM conn GROUP BY dst"
B["window_edges"] = """SELECT src, dst, port, coalesce(proto, '') AS proto, list_extract(['port-only', 'responder-confirmed', 'protocol-confirmed'],
  CAST(1 + max(CASE WHEN service NOT IN ('', '-', 'unknown') THEN 2 WHEN state IN ('SF', 'S1', 'S2', 'S3', 'RSTO', 'RSTR') OR bytes_in > 0 THEN 1
  ELSE 0 END) AS INTEGER)) AS evidence, count(*) AS conn_count, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM conn
WHERE ts >= TIMESTAMP '1996-03-05 09:30:00' AND ts < TIMESTAMP '1997-06-10 14:00:01' GROUP BY ALL"""
B["window_clients"] = """WITH days AS (SELECT unnest(['1993-02-01', '1994-05-10', '1995-11-20', '1996-08-15', '1998-03-01']) AS day),
seen AS (SELECT day, kind, responder, client, count(*) AS n, max(ts) AS last FROM logs, days WHERE ts >= CAST(day AS TIMESTAMP)
  AND ts < CAST(day AS TIMESTAMP) + INTERVAL 14 DAY GROUP BY day, kind, responder, client)
SELECT day, kind, responder, count(*) AS clients, arg_min(client, (-n, client)) AS most_seen, CAST(sum(n) AS BIGINT) AS n,
  strftime(max(last), '%Y-%m-%d %H:%M:%S') AS last_seen FROM seen GROUP BY day, kind, responder"""
B["field_presence"] = """SELECT 'src' AS concept, 'source.ip' AS "column", TRUE AS present, count(src) AS filled, count(*) AS total FROM conn
UNION ALL SELECT 'proto', 'network.inner.transport', TRUE, count(proto), count(*) FROM conn
UNION ALL SELECT 'service', 'network.protocol', FALSE, 0, count(*) FROM conn"""
B["zero_coverage"] = "SELECT cidr FROM gaps"
B["field_map_scan"] = "SELECT dst, port, count(*) AS n, CAST(0 AS BIGINT) AS with_proto FROM conn GROUP BY dst, port"
B["window_filter"] = """SELECT CAST(snapshot AS INTEGER) AS snapshot, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first FROM conn
WHERE ts >= TIMESTAMP '1999-01-01' - INTERVAL 365 DAY GROUP BY snapshot"""
_last = lambda c: f"CAST(split_part({c}, '.', 4) AS INT) < 128"
B["scope_filter"] = f"""SELECT src, count(*) AS n FROM conn WHERE src LIKE '10.1.%' OR dst LIKE '10.1.%' OR dst = '8.8.8.8'
  OR (src LIKE '10.0.1.%' AND {_last('src')}) OR (dst LIKE '10.0.1.%' AND {_last('dst')}) GROUP BY src"""
B["focus_private"] = f"SELECT dst, count(*) AS n FROM edges WHERE {_private('src')} AND {_private('dst')} GROUP BY dst"
_f = lambda c: f"({c} LIKE '10.0.%' AND CAST(split_part({c}, '.', 3) AS INT) < 4)"
B["focus_cidr"] = f"SELECT src, dst, CAST(sum(conn_count) AS BIGINT) AS conns FROM edges WHERE {_f('src')} AND {_f('dst')} GROUP BY src, dst"
_o = lambda i: f"CAST(split_part(ip, '.', {i}) AS INT)"
B["ip_functions"] = f"""SELECT ip, '4' || printf('%02x%02x%02x%02x', {_o(1)}, {_o(2)}, {_o(3)}, {_o(4)}) AS ip_key, subnet, terrain,
  {_private('ip')} AS private, split_part(ip, '.', 1) || '.' || split_part(ip, '.', 2) || '.' || ({_o(3)} // 16 * 16) || '.0/20' AS wide,
  regexp_extract(ip, '^(\\d+\\.\\d+\\.\\d+)\\.', 1) || '.' || ({_o(4)} // 64 * 64) || '/26' AS fine FROM hosts"""
B["ipv6_functions"] = """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '620010db8' || repeat('0', 20) || lpad(h, 4, '0')
  WHEN 1 THEN '6fd00' || lpad(h, 4, '0') || repeat('0', 8) || '0001' || repeat('0', 8) || '0005'
  ELSE '6fe80' || repeat('0', 20) || '0001' || lpad(h, 4, '0') END AS ip_key, c_custkey % 3 <> 2 AS terrain, c_custkey % 3 = 1 AS private
FROM (SELECT c_custkey, printf('%x', c_custkey % 65536) AS h FROM customer)"""
B["cidr_functions"] = f"""SELECT s_suppkey, '4' || printf('%08x', base) AS lo, '4' || printf('%08x', base + size - 1) AS hi,
  CAST(s_suppkey % 33 AS INTEGER) AS bits, 167772177 BETWEEN base AND base + size - 1 AS holds FROM (
  SELECT s_suppkey, size, addr // size * size AS base FROM (SELECT s_suppkey, CAST(pow(2, 32 - s_suppkey % 33) AS BIGINT) AS size,
    167772160 + CAST(floor(s_suppkey / 25) AS BIGINT) % 250 * 256 + 10 + s_suppkey % 25 AS addr FROM supplier))"""
_pc = _cls("port")
B["port_functions"] = f"""SELECT port, {_pc} AS cls, {_map(_pc, ports.CLASS_LABELS, "'other'")} AS label,
  {_map(_pc, ports.CLASS_COLORS, "''")} AS color, {_name('port')} AS service, {_map('port', ports.PORT_NAMES, "''")} AS known,
  {_pc} IN ('auth', 'name', 'file', 'db') AS critical, {_pc} IN ('auth', 'name') AS auth, {_pc} = 'admin' AS admin,
  {_pc} IN ('auth', 'name', 'file', 'db') OR port IN (67, 123) AS sensitive, port IN {_in(ports.GEAR_PORTS)} AS gear,
  port IN {_in(ports.MAIL_PORTS)} AS mail FROM (SELECT DISTINCT port FROM conn)"""
B["mac_vendor"] = """SELECT DISTINCT dst_mac, CASE WHEN dst_mac LIKE '24:5a:4c%' THEN 'Ubiquiti' ELSE 'Cisco' END AS vendor,
  CASE WHEN dst_mac LIKE '24:5a:4c%' THEN 'Ubiquiti' ELSE 'Cisco' END AS dashed FROM conn"""
B["role_text"] = """SELECT p_partkey, list_extract(['', 'DomainController', 'DomainController', '', 'DNSServer', 'FileServer', '', 'Database',
  'JumpBox', 'WebServer', ''], CAST(p_partkey % 11 + 1 AS INTEGER)) AS role FROM part"""
B["string_functions"] = f"""SELECT s_suppkey, 'web' || s_suppkey AS cn, array_to_string(list_sort(['a', 'b' || s_suppkey, 'web' || s_suppkey]), ',') AS names,
  s_name LIKE '%5' AS globbed, CAST(least(s_suppkey, s_suppkey * 7 % 500) AS INTEGER) AS lo, CAST(greatest(s_suppkey, s_suppkey * 7 % 500) AS INTEGER) AS hi,
  {_server('s_suppkey')} || '/32' AS addr, {_server('s_suppkey')} || ':' || (s_suppkey % 3000) AS provider,
  {_server('s_suppkey')} || '>x:' || (s_suppkey % 3000) AS edge, 'f' || s_suppkey AS fp,
  CASE WHEN s_suppkey > 50 THEN strftime(make_timestamp((s_suppkey - 50) * 1000000000), '%Y-%m-%d %H:%M:%S') END AS at,
  CASE WHEN s_suppkey % 2 = 1 OR (s_suppkey % 10) >= 3 THEN 'service' ELSE 'client' END AS tier,
  round(least(1.0, greatest(0.5, (s_suppkey % 30) / 15.0)), 6) AS confidence,
  s_name || ' a.cfg:' || s_suppkey || ' — deny ip any any' || CASE WHEN s_suppkey % 2 = 0 THEN ' (confidence: partial)' ELSE '' END AS rule
FROM supplier"""
B["mask_functions"] = """SELECT s_suppkey, CASE WHEN s_suppkey % 7 <> 3 THEN CAST(s_suppkey % 33 AS INTEGER) END AS wild,
  CASE WHEN s_suppkey % 7 <> 3 THEN CASE s_suppkey % 33 WHEN 0 THEN 32 WHEN 32 THEN 0 END END AS mask FROM supplier"""
B["responder_cardinality"] = """SELECT c.kind, c.responder, c.clients, string_agg(t.client, ',' ORDER BY t.r) AS sample_hosts FROM card c JOIN (
  SELECT kind, responder, client, row_number() OVER (PARTITION BY kind, responder ORDER BY count(*) DESC, client) AS r FROM logs
  GROUP BY kind, responder, client) t ON t.kind = c.kind AND t.responder = c.responder AND t.r <= 3 GROUP BY ALL"""
B["top_clients"] = """SELECT dst, src, n, CAST(pos AS INTEGER) AS pos FROM (SELECT dst, src, count(*) AS n, row_number() OVER (PARTITION BY dst ORDER BY
  count(*) DESC, src) AS pos FROM conn GROUP BY dst, src) WHERE pos <= 3"""
B["gateway_candidates"] = "SELECT sensor, dst_mac AS mac, count(DISTINCT dst) AS ip_count FROM conn GROUP BY sensor, dst_mac HAVING count(DISTINCT dst) >= 10"
B["node_mac"] = "SELECT ip, mac FROM nic"
B["dhcp_leases"] = "SELECT ip, hostname, mac FROM lease"
B["tls_names"] = f"SELECT dst, server_name FROM names WHERE {_private('dst')}"
B["certificates"] = """SELECT 'fp-' || s_suppkey AS fingerprint, 'O=Corp, CN=Web' || s_suppkey || '.corp.example' AS subject,
  CASE WHEN s_suppkey = 1 THEN '*' ELSE 'host' || s_suppkey END || '.corp.example,web' || s_suppkey || '.corp.example' AS names FROM supplier"""
B["tls_match"] = "SELECT ip, array_to_string(fps, ',') AS fingerprints FROM tls"
B["ssh_keys"] = "SELECT ip, array_to_string(keys, ',') AS keys FROM ssh"
B["node_identity"] = """SELECT n.ip, n.mac, n.hostname AS hostnames, CAST(coalesce(len(t.fps), 0) AS INTEGER) AS certs,
  CAST(coalesce(len(s.keys), 0) AS INTEGER) AS keys FROM node_mac n LEFT JOIN tls t USING (ip) LEFT JOIN ssh s ON s.ip = n.ip"""
B["nodes"] = """SELECT ip, subnet, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen,
  array_to_string(sensors, ',') AS sensors FROM hosts"""
B["client_counts"] = "SELECT * FROM portcount"
B["admin_shape"] = "SELECT * FROM shape"
B["critical_in_degree"] = "SELECT ip, dependents FROM crit"
B["subnet_spread"] = "SELECT ip, spread FROM crit"
B["services"] = f"""SELECT ip, string_agg(name, ',' ORDER BY port) AS services FROM (SELECT dst AS ip, {_map('port', ports.PORT_NAMES, "''")} AS name,
  min(port) AS port FROM edges GROUP BY ALL) WHERE name <> '' GROUP BY ip"""
_h = " || ',' || ".join(f"count(*) FILTER (WHERE hour(ts) = {i})" for i in range(24))
_d = " || ',' || ".join(f"count(*) FILTER (WHERE dayofweek(ts) = {i})" for i in range(7))
B["temporal_hist"] = f"SELECT dst AS ip, {_h} AS hours, {_d} AS dow FROM conn GROUP BY dst"
_w = ", ".join("count(*) FILTER (WHERE hour(ts) IN (" + ", ".join(map(str, w)) + "))" for w in
               [(20, 21, 22), (21, 22, 23), (22, 23, 0), (23, 0, 1), (0, 1, 2), (1, 2, 3), (2, 3, 4), (3, 4, 5)])
CTES["shapes"] = f"""
SELECT ip, CASE WHEN t < 10 THEN 'Sparse' WHEN night >= CAST(floor(t * CAST(0.8 AS DOUBLE)) AS BIGINT) THEN 'Nightly'
  WHEN peak >= t * CAST(0.8 AS DOUBLE) THEN 'Burst' WHEN biz >= t * CAST(0.8 AS DOUBLE) AND wk < t * CAST(0.2 AS DOUBLE) THEN 'BusinessHours'
  WHEN active >= 20 THEN 'Constant' ELSE '' END AS shape FROM (SELECT dst AS ip, count(*) AS t, greatest({_w}) AS night,
  count(*) FILTER (WHERE hour(ts) BETWEEN 8 AND 17) AS biz, count(*) FILTER (WHERE dayofweek(ts) IN (0, 6)) AS wk,
  count(DISTINCT hour(ts)) AS active FROM conn GROUP BY dst) JOIN (SELECT dst AS ip, max(n) AS peak FROM (
  SELECT dst, hour(ts) AS h, count(*) AS n FROM conn GROUP BY dst, hour(ts)) GROUP BY dst) USING (ip)"""
B["temporal_class"] = "SELECT ip, shape FROM shapes"
B["temporal_edges"] = """SELECT e.dst, s.shape, count(*) AS n FROM edges e JOIN shapes s ON s.ip = e.dst WHERE e.dst IN (
  SELECT dst FROM edges GROUP BY dst ORDER BY sum(conn_count) DESC, dst LIMIT 50) GROUP BY e.dst, s.shape"""
CTES["wedges"] = f"""
SELECT src, dst, sum(ln(1 + CAST(conn_count AS DOUBLE)) * CASE WHEN port IN {_in(ports.AUTH_EDGE_PORTS)} THEN 3.0 ELSE 1.0 END) AS weight
FROM conf WHERE src <> dst GROUP BY src, dst"""
CTES["shares"] = "SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM wedges"
CTES["pr0"] = "SELECT ip, 1.0 / count(*) OVER () AS x, count(*) OVER () AS n FROM hosts"
for _i in range(1, 41):
    CTES[f"pr{_i}"] = f"""
SELECT v.ip, CAST(0.15 AS DOUBLE) / v.n + CAST(0.85 AS DOUBLE) * coalesce(g.g, 0) AS x, v.n FROM pr{_i - 1} v LEFT JOIN (
  SELECT s.dst AS ip, sum(s.share * p.x) AS g FROM shares s JOIN pr{_i - 1} p ON p.ip = s.src GROUP BY s.dst) g USING (ip)"""
B["weighted_edges"] = "SELECT src, dst, round(weight, 6) AS weight FROM wedges"
B["pagerank_fixed"] = "SELECT ip, round(x / sum(x) OVER (), 9) AS pagerank FROM pr10"
B["pagerank"] = "SELECT ip, round(x / sum(x) OVER (), 6) AS pagerank FROM pr40"
CTES["pr10n"] = "SELECT ip, x / sum(x) OVER () AS pagerank FROM pr10"
_norm = lambda c: f"CASE WHEN max({c}) FILTER (WHERE terrain) OVER () > min({c}) FILTER (WHERE terrain) OVER () THEN ({c} - min({c}) FILTER (WHERE terrain) OVER ()) / CAST(max({c}) FILTER (WHERE terrain) OVER () - min({c}) FILTER (WHERE terrain) OVER () AS DOUBLE) ELSE 0 END"
CTES["terrain_all"] = f"""
SELECT *, CASE WHEN terrain THEN round(pd + pp + ps, 12) ELSE 0.0 END AS composite FROM (
  SELECT r.ip, dependents, spread, terrain, pagerank, 0.40 * {_norm('dependents')} AS pd, 0.25 * {_norm('pagerank')} AS pp, 0.15 * {_norm('spread')} AS ps
  FROM raw_scores r JOIN pr10n USING (ip))"""
B["terrain_scores"] = "SELECT ip, dependents, spread, terrain, round(composite, 6) AS composite FROM terrain_all"
B["rank"] = "SELECT ip, rank, round(composite, 6) AS composite FROM scored"
B["score_drivers"] = """SELECT ip, rank, CAST((dependents > 0)::INT + (spread > 0)::INT + 1 AS INTEGER) AS n,
  CASE WHEN dependents > 0 AND pd >= ps AND pd >= pp THEN dependents || ' distinct hosts depend on it for critical services'
    WHEN spread > 0 AND ps >= pp THEN 'blast radius: dependencies reach it from ' || spread || ' subnets'
    ELSE 'dependency centrality: PageRank ' || printf('%.4f', pagerank) || ' from weighted incoming traffic' END AS first
FROM (SELECT *, CAST(row_number() OVER (ORDER BY composite DESC, ip) AS INTEGER) AS rank FROM terrain_all) WHERE rank <= 20 AND terrain"""
B["top_ranked"] = "SELECT ip, rank FROM scored WHERE rank <= 10"
B["top_role"] = f"SELECT r.ip, r.top AS role, r.roles, {_TIER} AS tier FROM roles r JOIN scored s USING (ip)"
B["snapshot_meta"] = """SELECT '2009-01-01 00:00:00' AS created_at, '1h0m0s' AS "window", '10.0.0.0/16,10.1.0.0/16,10.9.0.0/24' AS scope,
  (SELECT string_agg(DISTINCT sensor, ',' ORDER BY sensor) FROM conn) AS sensors, 'grid' AS cluster_name,
  (SELECT coalesce(string_agg(cidr, ',' ORDER BY cidr), '') FROM gaps) AS zero_coverage"""
B["snapshot_catalogue"] = """SELECT '000' || e.snapshot AS snapshot_id, '200' || e.snapshot || '-01-01 00:00:00' AS created_at,
  (e.snapshot + 1) || 'h0m0s' AS "window", n.nodes, e.edges FROM (SELECT snapshot, count(*) AS edges FROM (SELECT DISTINCT snapshot, src, dst, port,
  coalesce(proto, '') FROM conn) GROUP BY snapshot) e JOIN (SELECT snapshot, count(DISTINCT ip) AS nodes FROM (SELECT snapshot, src AS ip FROM conn
  UNION ALL SELECT snapshot, dst FROM conn) GROUP BY snapshot) n USING (snapshot)"""
B["snapshot_store"] = " UNION ALL ".join(
    f"SELECT '000{k}' AS snapshot_id, ip, rank, round(composite, 6) AS composite, 0 AS gateways FROM scored_{k}" for k in (1, 2, 3))
B["stored_scan"] = """WITH best AS (SELECT dst AS ip, dst_mac AS mac, row_number() OVER (PARTITION BY dst ORDER BY count(*) DESC, dst_mac) AS r
  FROM conn WHERE ts >= TIMESTAMP '1997-04-06' GROUP BY dst, dst_mac),
shared AS (SELECT dst_mac FROM conn WHERE ts >= TIMESTAMP '1997-04-06' GROUP BY dst_mac HAVING count(DISTINCT dst) >= 10)
SELECT '0012' AS snapshot_id, s.ip, s.rank, round(s.composite, 6) AS composite, coalesce(b.mac, '') AS mac FROM scored_w s
LEFT JOIN best b ON b.ip = s.ip AND b.r = 1 AND b.mac NOT IN (SELECT dst_mac FROM shared)"""
B["drift_nodes"] = """SELECT ip, 'appeared' AS change FROM hosts_2 WHERE ip NOT IN (SELECT ip FROM hosts_1)
UNION ALL SELECT ip, 'disappeared' FROM hosts_1 WHERE ip NOT IN (SELECT ip FROM hosts_2)"""
B["drift_ranks"] = """SELECT a.ip, a.rank AS from_rank, b.rank AS to_rank, a.rank - b.rank AS delta FROM scored_1 a JOIN scored_2 b USING (ip)
WHERE abs(a.rank - b.rank) >= 5"""
B["drift_roles"] = "SELECT a.ip, a.roles AS from_roles, b.roles AS to_roles FROM roles_1 a JOIN roles_2 b USING (ip) WHERE a.roles <> b.roles"
_diff = lambda p, t, c: f"""SELECT h.ip, '{p}' AS protocol, array_to_string(list_sort(list_filter(coalesce(y.{c}, []), lambda v: NOT list_contains(coalesce(x.{c}, []), v))), ',') AS added,
  array_to_string(list_sort(list_filter(coalesce(x.{c}, []), lambda v: NOT list_contains(coalesce(y.{c}, []), v))), ',') AS removed
  FROM (SELECT ip FROM hosts_1 INTERSECT SELECT ip FROM hosts_2) h LEFT JOIN {t}_1 x USING (ip) LEFT JOIN {t}_2 y ON y.ip = h.ip"""  # noqa: E731
CTES["identity"] = f"SELECT * FROM ({_diff('tls', 'tls', 'fps')} UNION ALL {_diff('ssh', 'ssh', 'keys')}) WHERE added <> '' OR removed <> ''"
B["drift_identity"] = "SELECT * FROM identity"
CTES["edge_changes"] = """
SELECT DISTINCT 'new' AS change, src, dst, port FROM edges_2 WHERE (src, dst, port) NOT IN (SELECT (src, dst, port) FROM edges_1)
  AND dst IN (SELECT ip FROM scored_2 WHERE rank <= 20)
UNION ALL SELECT DISTINCT 'vanished', src, dst, port FROM edges_1 WHERE (src, dst, port) NOT IN (SELECT (src, dst, port) FROM edges_2)
  AND dst IN (SELECT ip FROM scored_1 WHERE rank <= 20)"""
B["drift_edges"] = "SELECT * FROM edge_changes"
CTES["newprov"] = f"""
SELECT s.dst AS ip, s.port, s.service, count(DISTINCT s.src) AS clients, s.dst NOT IN (SELECT ip FROM hosts_1) AS new_host, r.rank
FROM sens_2 s JOIN scored_2 r ON r.ip = s.dst WHERE (s.dst, s.port) NOT IN (SELECT (dst, port) FROM conf_1 WHERE port IN {_in(ports.SENSITIVE_PORTS)})
GROUP BY s.dst, s.port, s.service, r.rank"""
B["new_providers"] = "SELECT * FROM newprov"
B["displacement"] = """SELECT m.dst AS ip, m.port, m.service, CAST(coalesce(sum(clients) FILTER (WHERE from_ip IS NULL), 0) AS BIGINT) AS clients_added,
  coalesce(string_agg(from_ip || ':' || from_port || ':' || clients, ',' ORDER BY clients DESC, from_ip, from_port) FILTER (WHERE from_ip IS NOT NULL), '') AS migrated_from,
  r.rank FROM moves m JOIN scored_2 r ON r.ip = m.dst GROUP BY m.dst, m.port, m.service, r.rank"""
B["drift_order"] = """
SELECT 'providers' AS signal, row_number() OVER (ORDER BY clients DESC, ip, port) AS pos, ip, '' AS src, port FROM newprov
UNION ALL SELECT 'displacement', row_number() OVER (ORDER BY sum(clients) DESC, dst, port), dst, '', port FROM moves GROUP BY dst, port
UNION ALL SELECT 'ranks', row_number() OVER (ORDER BY a.ip), a.ip, '', 0 FROM scored_1 a JOIN scored_2 b USING (ip) WHERE abs(a.rank - b.rank) >= 5
UNION ALL SELECT 'gained', row_number() OVER (ORDER BY dst, src, port), dst, src, port FROM edge_changes WHERE change = 'new'"""
B["compat_warnings"] = """SELECT CAST(0 AS INTEGER) AS pos, 'window differs: "2h0m0s" vs "3h0m0s"' AS warning"""
B["node_stability"] = """SELECT ip, count(*) AS occurrences, count(*) FILTER (WHERE rank <= 20) AS top_n_occurrences, round(max(p), 6) AS best, round(min(p), 6) AS worst,
  round(median(p), 6) AS median_pct, count(DISTINCT CASE WHEN top <> 'Unknown' THEN top END) <= 1 AS role_consistent,
  CASE WHEN bool_or(s = 1) AND bool_or(s = 3) THEN 'persistent' WHEN bool_or(s = 3) THEN 'emerging' ELSE 'transient' END AS classification FROM (
  SELECT *, (count(*) OVER (PARTITION BY s) - rank) / CAST(count(*) OVER (PARTITION BY s) - 1 AS DOUBLE) AS p FROM (""" + " UNION ALL ".join(
    f"SELECT {i} AS s, a.ip, a.rank, r.top FROM scored_{i} a JOIN roles_{i} r USING (ip)" for i in (1, 2, 3)) + ")) GROUP BY ip"
B["service_authority"] = """SELECT a.ip, r.top AS role, a.service, a.port, a.evidence, a.clients, strftime(a.first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen,
  strftime(a.last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen, s.rank FROM authority a JOIN roles r USING (ip) JOIN scored s ON s.ip = a.ip"""
B["provider_enrichment"] = f"""SELECT ip, port, array_to_string(list_slice(list_sort(list(DISTINCT src)), 1, 5), ',') AS sample_clients,
  array_to_string(list_sort(list(DISTINCT {_subnet('src')})), ',') AS subnets,
  array_to_string(list_sort(list_distinct(flatten(list(sensors)))), ',') AS sensors FROM (SELECT *, dst AS ip FROM sens) GROUP BY ip, port"""
B["alternate_providers"] = """SELECT ip, port, string_agg(alt, ',' ORDER BY alt) AS alternates FROM (SELECT DISTINCT a.dst AS ip, a.port, b.dst || ':' || b.port AS alt
  FROM sens a JOIN sens b ON a.service = b.service AND a.src = b.src AND (a.dst <> b.dst OR a.port <> b.port)) GROUP BY ip, port"""
B["provider_classes"] = """WITH sets AS (SELECT service, src, list_sort(list(DISTINCT dst || ':' || port)) AS p FROM sens GROUP BY service, src
  HAVING count(DISTINCT dst || ':' || port) > 1)
SELECT service, src, min(src) OVER w AS cls, len(p) AS providers, count(*) OVER w AS least, count(*) OVER w AS most FROM sets
WINDOW w AS (PARTITION BY service, p)"""
B["sole_providers"] = """SELECT service, min(dst) AS ip, min(port) AS port FROM sens WHERE list_contains(sensors, 'sensor-0') GROUP BY service
HAVING count(DISTINCT dst || ':' || port) = 1"""
B["reconcile_silent"] = """SELECT ip, hostname, role, EXISTS (SELECT 1 FROM gaps WHERE a.ip LIKE prefix || '%') AS in_blind_spot FROM assets a
WHERE ip NOT IN (SELECT ip FROM hosts)"""
B["reconcile_undocumented"] = "SELECT ip, subnet FROM hosts WHERE ip NOT IN (SELECT ip FROM assets)"
B["reconcile_contradicted"] = "SELECT ip, documented, expected, observed, observed <> 'Unknown' AS strict FROM contra"
B["asset_rows"] = f"""WITH sheet AS (SELECT s_suppkey + 2 AS row, s_name, s_suppkey % 4 AS v, CASE s_suppkey % 20 WHEN 7 THEN 'n/a'
  WHEN 8 THEN {_server('(s_suppkey - 1 - s_suppkey % 2)')} ELSE {_server('s_suppkey')} END AS ip FROM supplier),
  good AS (SELECT *, min(row) OVER (PARTITION BY ip) AS kept FROM sheet WHERE ip <> 'n/a')
SELECT row, ip, s_name AS hostname, 'DNS' AS role, 'v' || v AS segment, '' AS warning FROM good WHERE row = kept
UNION ALL SELECT row, '', '', '', '', 'row ' || row || ': no parseable IP ("n/a") — skipped' FROM sheet WHERE ip = 'n/a'
UNION ALL SELECT row, '', '', '', '', 'row ' || row || ': duplicate IP ' || ip || ' — first occurrence kept' FROM good WHERE row <> kept"""
B["config_rules"] = """SELECT device, ruleset, CAST(idx AS INTEGER) AS idx, action, r_proto, r_src, r_dst, CAST(port_lo AS INTEGER) AS port_lo,
  CAST(port_hi AS INTEGER) AS port_hi, caveat FROM rules_ios
UNION ALL SELECT device, ruleset, CAST(idx AS INTEGER), action, r_proto, r_src, r_dst, CAST(port_lo AS INTEGER), CAST(port_hi AS INTEGER), caveat FROM rules_ctl"""
B["config_interfaces"] = """SELECT 'edge-' || r || '-' || b AS device, 'Gi0' AS name, '10.' || r || '.' || b || '.1/24' AS cidr, FALSE AS shutdown, '' AS mac, '' AS model FROM routers
UNION ALL SELECT 'edge-' || r || '-' || b, 'Gi1', '172.16.' || b || '.1/24', TRUE, '', '' FROM routers
UNION ALL SELECT 'ctl', 'sw-' || n, '10.0.' || n || '.10/32', FALSE, '24:5A:4C:00:00:0' || (n % 10), 'USW' FROM nets"""
B["config_warnings"] = """SELECT 'edge-' || r || '-' || b || '.cfg' AS source, '1 ACL rule(s) carry a caveat and are not evaluated' AS warning FROM routers WHERE b % 2 = 0
UNION ALL SELECT 'ctl', count(*) || ' firewall rule(s) disabled and skipped' FROM nets UNION ALL
SELECT 'ctl', count(*) || ' JSON item(s) not recognized as network/rule/device; skipped' FROM nets UNION ALL
SELECT 'ctl', count(*) || ' firewall rule(s) carry a caveat and are not evaluated' FROM nets"""
B["config_vendor"] = """SELECT 'cisco-ios' AS vendor, count(*) AS files FROM routers UNION ALL SELECT 'unifi', count(*) FROM nets
UNION ALL SELECT 'unknown', count(*) FROM documents"""
B["device_identity"] = """SELECT 'edge-' || r || '-' || b AS device, 'Cisco IOS router' AS device_type, TRUE AS routes FROM routers
UNION ALL SELECT 'ctl', '', TRUE"""
B["declared_gateways"] = """SELECT '10.' || r || '.' || b || '.1' AS ip, 'edge-' || r || '-' || b AS device FROM routers
WHERE EXISTS (SELECT 1 FROM hosts WHERE ip LIKE '10.' || r || '.' || b || '.%' AND ip <> '10.' || r || '.' || b || '.1')"""
CTES["owned"] = """
SELECT '10.' || r || '.' || b || '.' AS p, 'edge-' || r || '-' || b AS device FROM routers UNION ALL SELECT '10.0.' || n || '.', 'ctl' FROM nets"""
B["undeclared_cidrs"] = "SELECT DISTINCT subnet AS cidr FROM hosts WHERE subnet NOT IN (SELECT p || '0/24' FROM owned)"
B["silent_subnets"] = """SELECT p || '0/24' AS cidr, device, p LIKE '10.2.%' AND CAST(split_part(p, '.', 3) AS INT) < 4 AS in_blind_spot FROM owned
WHERE NOT EXISTS (SELECT 1 FROM hosts WHERE ip NOT LIKE '10.2.%' AND ip LIKE p || '%')
UNION ALL SELECT '10.0.' || n || '.10/32', 'ctl', FALSE FROM nets WHERE '10.0.' || n || '.10' NOT IN (SELECT ip FROM hosts)"""
B["adopted_devices"] = """SELECT 'sw-' || n AS name, 'USW' AS model, '10.0.' || n || '.10' AS ip, coalesce((SELECT max(ip) FROM node_mac m WHERE
  lower(m.mac) = '24:5a:4c:00:00:0' || (n % 10)), (SELECT ip FROM hosts h WHERE h.ip = '10.0.' || n || '.10'), '') AS observed_ip FROM nets"""
B["skipped_rules"] = """SELECT (SELECT count(*) FROM rules_ios WHERE caveat <> '') + (SELECT count(*) FROM rules_ctl WHERE caveat <> '') AS skipped_rules"""
CTES["ios_flows"] = """
SELECT e.*, rt.r, rt.b, p.o AS po, p.p AS ep FROM edges e JOIN routers rt ON e.src LIKE '10.' || rt.r || '.' || rt.b || '.%'
  AND e.dst NOT LIKE '10.' || rt.r || '.' || rt.b || '.%', (VALUES (0, 'tcp'), (1, 'udp')) p(o, p) WHERE e.proto = '' OR e.proto = p.p"""
CTES["ios_match"] = """
SELECT f.src, f.dst, f.port, f.proto, f.po, f.r, f.b, min(a.idx) AS idx FROM ios_flows f LEFT JOIN rules_ios a ON a.r = f.r AND a.b = f.b
  AND a.caveat = '' AND a.r_proto = f.ep AND (a.r_dst = '0.0.0.0/0' OR (a.r_dst = '8.8.8.8/32' AND f.dst = '8.8.8.8')
    OR (a.r_dst = '10.0.0.0/16' AND f.dst LIKE '10.0.%') OR (a.r_dst LIKE '%.0/24' AND f.dst LIKE '10.0.' || f.b || '.%'))
  AND (a.port_hi = 0 OR f.port BETWEEN a.port_lo AND a.port_hi) GROUP BY ALL"""
CTES["lan"] = "SELECT n, '10.0.' || n || '.' AS p, n % 3 = 2 AS guest FROM nets"
CTES["violations"] = """
SELECT 'edge-' || m.r || '-' || m.b AS device, 'EDGE' AS ruleset, arg_min(coalesce(a.line, 0), m.po) AS line,
  arg_min(coalesce(x.raw, 'implicit deny (default)'), m.po) AS raw, m.src, m.dst, m.port, m.proto,
  CASE WHEN m.b % 2 = 0 THEN 'partial' ELSE 'full' END AS confidence
FROM ios_match m LEFT JOIN rules_ios x ON x.r = m.r AND x.b = m.b AND x.idx = m.idx
  LEFT JOIN (SELECT device, row_number() OVER (PARTITION BY device ORDER BY o) - 1 AS idx, line + CASE WHEN o > 3 AND b % 2 = 0 THEN 1 ELSE 0 END AS line FROM acl) a
  ON a.device = 'edge-' || m.r || '-' || m.b AND a.idx = m.idx
WHERE coalesce(x.action, 'deny') = 'deny' GROUP BY m.r, m.b, m.src, m.dst, m.port, m.proto
UNION ALL SELECT 'ctl', 'LAN_IN', l.n, 'unifi LAN_IN: drop 10.0.' || l.n || '.1/24->10.0.0.0/24', e.src, e.dst, e.port, e.proto, 'partial'
FROM edges e JOIN lan l ON NOT l.guest AND e.src LIKE l.p || '%' AND e.dst NOT LIKE l.p || '%' WHERE e.dst LIKE '10.0.0.%' AND e.port BETWEEN 22 AND 90
UNION ALL SELECT 'ctl', 'GUEST_IN', (SELECT n FROM nets ORDER BY lpad(CAST(n AS VARCHAR), 3, '0') LIMIT 1), 'unifi GUEST_IN: reject 0.0.0.0/0->0.0.0.0/0', e.src, e.dst, e.port, e.proto, 'partial'
FROM edges e JOIN lan l ON l.guest AND e.src LIKE l.p || '%' AND e.dst NOT LIKE l.p || '%' WHERE e.port = 53 AND e.proto IN ('', 'udp')"""
B["policy_violations"] = "SELECT device, ruleset, CAST(line AS INTEGER) AS line, raw, src, dst, port, proto, confidence FROM violations"
B["unused_permits"] = """SELECT x.device, x.ruleset, CAST(x.idx AS INTEGER) AS idx, x.raw FROM rules_ios x LEFT JOIN (SELECT DISTINCT r, b, idx FROM ios_match) m
  ON m.r = x.r AND m.b = x.b AND m.idx = x.idx WHERE x.action = 'permit' AND x.caveat = '' AND m.idx IS NULL"""
B["segment_lookup"] = f"""SELECT ip, CASE WHEN ip LIKE '10.1.%' THEN '10.1.0.0/16' WHEN ip LIKE '10.0.%' AND CAST(split_part(ip, '.', 3) AS INT) IN (SELECT n FROM nets)
  AND CAST(split_part(ip, '.', 4) AS INT) < 64 THEN regexp_extract(ip, '^(\\d+\\.\\d+\\.\\d+)\\.', 1) || CASE WHEN CAST(split_part(ip, '.', 4) AS INT) < 32 THEN '.0/27' ELSE '.32/27' END
  ELSE subnet END AS cidr FROM hosts"""
B["map_nodes"] = f"""SELECT ip AS id, gid AS "group", CASE WHEN hostname <> '' THEN hostname || chr(10) || ip ELSE ip END AS label, top AS role, tier, round(composite, 6) AS composite,
  FALSE AS gateway, CAST(0 AS BIGINT) AS agg_count, CASE WHEN mac LIKE '24:5a:4c%' THEN 'Ubiquiti' WHEN mac LIKE 'b8:27:eb%' THEN 'Raspberry Pi' WHEN mac = '{P.GATEWAY_MAC}' THEN 'Cisco' ELSE '' END AS vendor
FROM placed WHERE visible
UNION ALL SELECT gid || ':clients', gid, count(*) || ' workstations', 'Unknown', 'client', 0.0, FALSE, count(*), '' FROM placed WHERE NOT visible GROUP BY gid
UNION ALL SELECT 'gw:' || dst_mac, '', 'gateway ' || dst_mac, 'Gateway', 'core', 0.0, TRUE, 0, '' FROM conn GROUP BY sensor, dst_mac HAVING count(DISTINCT dst) >= 10"""
B["map_members"] = "SELECT gid || ':clients' AS agg_id, ip, top AS role, tier, rank FROM placed WHERE NOT visible"
_lab = "CASE WHEN hosts > 1 THEN hosts || ' hosts → ' || class ELSE class END AS label"
B["map_edges"] = f"SELECT src, dst, class, {_lab}, hosts, conns, round(1 + ln(1 + hosts), 6) AS width FROM bundles"
B["map_edge_members"] = f"""SELECT DISTINCT e.src AS ip FROM edges e JOIN placed s ON s.ip = e.src WHERE s.endpoint = 'g:10.1.0.0/24:clients'
  AND e.dst = '10.0.0.26' AND {_cls('e.port')} = 'auth' AND (SELECT visible FROM placed WHERE ip = '10.0.0.26')"""
B["map_inferred_gateways"] = """SELECT DISTINCT g || ':gw' AS id, g AS "group" FROM (SELECT unnest([s.gid, d.gid]) AS g FROM edges e JOIN cells s ON s.ip = e.src
  JOIN cells d ON d.ip = e.dst WHERE s.gid <> d.gid) WHERE g <> 'g:sparse'"""
B["map_blind_spots"] = "SELECT cidr, 'possible blind spot: ' || cidr || ' is in scope but produced zero observed traffic' AS finding FROM gaps"
B["map_overview_groups"] = "SELECT cidr, hosts, FALSE AS marked FROM kept"
CTES["overgates"] = """
SELECT dst_mac AS mac FROM conn GROUP BY sensor, dst_mac HAVING count(DISTINCT dst) >= 10 ORDER BY count(DISTINCT dst) DESC, dst_mac, sensor LIMIT 66"""
CTES["overnodes"] = """
SELECT ip AS id, ogid AS "group", CASE WHEN hostname <> '' THEN hostname || chr(10) || ip ELSE ip END AS label, top AS role, CAST(0 AS BIGINT) AS agg_count FROM over WHERE shown
UNION ALL SELECT ogid || ':clients', ogid, count(*) || ' more hosts', 'Unknown', count(*) FROM over WHERE NOT shown GROUP BY ogid
UNION ALL SELECT 'gw:' || mac, '', 'gateway ' || mac, 'Gateway', 0 FROM overgates"""
B["map_overview"] = "SELECT * FROM overnodes"
B["map_edge_budget"] = """SELECT src, dst, class, hosts, conns FROM (SELECT b.*, s.g <> d.g AS crosses, row_number() OVER (PARTITION BY s.g <> d.g ORDER BY
    (s.a = 0 OR d.a = 0) DESC, b.conns DESC, b.src, b.dst, b.class) AS r FROM overbundles b
  JOIN (SELECT DISTINCT id, "group" AS g, agg_count AS a FROM overnodes) s ON s.id = b.src JOIN (SELECT DISTINCT id, "group" AS g, agg_count AS a FROM overnodes) d ON d.id = b.dst)
WHERE crosses OR r <= 60 - (SELECT count(DISTINCT ogid) FROM over) - (SELECT count(*) FROM overnodes)"""
B["map_omitted"] = """SELECT CAST(CASE WHEN max(total) > 64 THEN max(total) - 63 ELSE 0 END AS BIGINT) AS segments,
  (SELECT count(*) FROM over WHERE NOT shown) AS hosts FROM segs"""
B["map_services"] = f"""SELECT ip AS id, string_agg(name, ',' ORDER BY name) AS services FROM (SELECT DISTINCT dst AS ip,
  {_map('port', ports.PORT_NAMES, "''")} AS name FROM edges) WHERE name <> '' AND ip IN (SELECT ip FROM placed WHERE visible) GROUP BY ip"""
B["operator_facts"] = f"""SELECT {_server('s_suppkey')} AS ip, CASE WHEN s_suppkey % 10 < 4 THEN 'dev-' || CAST(floor(s_suppkey / 2) AS BIGINT) ELSE '' END AS device,
  CASE WHEN s_suppkey % 10 < 4 THEN 'server' ELSE '' END AS device_type,
  CASE WHEN s_suppkey % 20 = 5 THEN 'Printer' WHEN s_suppkey % 10 = 5 THEN 'box-' || (s_suppkey % 3) ELSE '' END AS role_override, 'nation-' || s_nationkey AS labels FROM supplier"""
B["pin_set"] = f"SELECT DISTINCT {_server('s_suppkey')} AS ip FROM supplier WHERE s_acctbal > 9000 OR s_suppkey % 10 < 4 OR s_suppkey % 20 = 15"
B["overlay_integrity"] = f"""WITH d AS (SELECT CAST(floor(s_suppkey / 3) AS BIGINT) AS id, CASE WHEN s_suppkey % 9 < 3 THEN '' ELSE 'Dev' || CAST(floor(s_suppkey / 3) AS BIGINT) % 20 END AS device,
  CASE WHEN s_suppkey % 11 = 0 THEN 'bad' ELSE {_server('(s_suppkey - s_suppkey % 4)')} END AS ip FROM supplier)
SELECT 'blank-name' AS problem, CAST(id AS VARCHAR) AS subject FROM (SELECT DISTINCT id FROM d WHERE device = '')
UNION ALL SELECT 'repeated-name', lower(device) FROM (SELECT DISTINCT id, device FROM d WHERE device <> '') GROUP BY lower(device) HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'bad-address', ip FROM d WHERE ip = 'bad'
UNION ALL SELECT 'shared-address', ip FROM d WHERE ip <> 'bad' GROUP BY ip HAVING count(DISTINCT id) > 1"""
B["evidence_pack_nodes"] = """SELECT s.ip AS id, s.subnet, s.rank, n.mac, CASE WHEN n.mac LIKE '24:5a:4c%' THEN 'Ubiquiti' WHEN n.mac LIKE 'b8:27:eb%' THEN 'Raspberry Pi' ELSE '' END AS vendor
FROM scored s JOIN node_mac n USING (ip) WHERE s.rank <= 100"""
B["evidence_pack_edges"] = """SELECT src || '>' || dst || ':' || port AS id, conn_count, service FROM edges WHERE src IN (SELECT ip FROM scored WHERE rank <= 100)
  AND dst IN (SELECT ip FROM scored WHERE rank <= 100) ORDER BY conn_count DESC, src, dst, port, proto LIMIT 500"""
B["citation_check"] = f"""SELECT c_name AS title, 'no citations' AS problem, '' AS id FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 4 <> 1
UNION ALL SELECT c_name, 'unknown edge', '10.250.0.1>10.250.0.2:1' FROM customer WHERE c_custkey % 4 = 1
UNION ALL SELECT c_name, 'unknown edge', e FROM (SELECT c_name, {_client('c_custkey')} || '>' || {_server('(c_custkey % 100)')} || ':53' AS e FROM customer
  WHERE c_custkey % 4 = 1) WHERE e NOT IN (SELECT src || '>' || dst || ':' || port FROM edges)
UNION ALL SELECT c_name, 'unknown node', '10.250.0.1' FROM customer WHERE c_custkey % 5 <> 0
UNION ALL SELECT c_name, 'unknown node', {_client('c_custkey')} FROM customer WHERE c_custkey % 5 <> 0 AND {_client('c_custkey')} NOT IN (SELECT ip FROM hosts)"""
B["tag_check"] = f"""SELECT ip AS node_id, CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE 'db,core' END AS tags, CASE WHEN ip NOT IN (SELECT ip FROM hosts WHERE ip < '10.0.2') THEN 'unknown node'
  WHEN s_suppkey % 12 > 10 THEN 'confidence outside 0..1' WHEN s_suppkey % 4 = 0 THEN 'no rationale' WHEN s_suppkey % 6 = 0 THEN 'no tags' ELSE '' END AS problem
FROM (SELECT s_suppkey, {_server('s_suppkey')} AS ip FROM supplier)"""
B["suggestion_merge"] = f"""SELECT {_server('s_suppkey')} AS node_id, 'new' AS tag FROM supplier WHERE s_acctbal > 5000
UNION ALL SELECT {_server('s_suppkey')}, 'old' FROM supplier WHERE s_acctbal <= 4000"""
CTES["links"] = "SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM conf WHERE src <> dst UNION ALL SELECT dst, src FROM conf WHERE src <> dst)"
CTES["near0"] = f"SELECT DISTINCT {_server('s_suppkey')} AS ip, 0 AS depth FROM supplier WHERE s_acctbal > 9500 AND {_server('s_suppkey')} IN (SELECT ip FROM hosts)"
for _i in (1, 2, 3):
    CTES[f"near{_i}"] = f"""
SELECT * FROM near{_i - 1} UNION ALL SELECT DISTINCT b, {_i} FROM links WHERE a IN (SELECT ip FROM near{_i - 1} WHERE depth = {_i - 1})
  AND b NOT IN (SELECT ip FROM near{_i - 1})"""
B["mission"] = "SELECT ip, depth = 0 AS in_scope, CAST(depth AS INTEGER) AS depth, round(1.0 / (1 + depth), 6) AS mission_score FROM near3"
_roles_text = _map("x.role", {
    "DomainController": "% distinct hosts made Kerberos requests to this host; LDAP also observed",
    "DNSServer": "% distinct hosts issued DNS queries to this host", "DHCPServer": "% distinct hosts received a DHCP lease from this host",
    "FileServer": "% distinct hosts opened SMB sessions to this host", "Database": "% distinct hosts connected on a database port",
    "WebServer": "% distinct hosts made HTTP/TLS requests to this host", "Printer": "% distinct hosts sent print traffic (ipp/jetdirect) to this host",
    "Camera": "% distinct hosts pulled RTSP streams from this host", "MailServer": "% distinct hosts connected on mail ports (smtp/imap/pop3)",
    "NetworkGear": "% host(s) used network-infrastructure protocols (capwap/papi/tacacs/smart-install) to this host"}, "''")
B["role_assertions"] = f"""SELECT h.ip, coalesce(x.role, 'Unknown') AS role, coalesce(round(CAST(x.confidence AS DOUBLE), 6), 0.0) AS confidence,
  CASE WHEN x.role = 'JumpBox' THEN 'RDP/SSH from ' || s.admin_in || ' host(s) in, out to ' || s.admin_out || ' host(s) — pivot shape'
    WHEN x.role IS NULL THEN '' ELSE replace({_roles_text}, '%', CAST(x.n AS VARCHAR)) END AS evidence
FROM hosts h LEFT JOIN held x USING (ip) LEFT JOIN shape s ON s.ip = h.ip"""
B["dataset_resolution"] = """SELECT kind, coalesce(string_agg(name, ','), '') AS found, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, max(blind) AS blind FROM (
  SELECT 'conn' AS kind, 'conn' AS name, count(*) AS n, '' AS blind FROM conn
  UNION ALL SELECT kind, 'zeek.' || kind, count(*), '' FROM logs WHERE kind <> 'smb' GROUP BY kind
  UNION ALL SELECT 'smb', NULL, 0, 'file server inference blind' UNION ALL SELECT 'x509', NULL, 0, 'TLS certificate continuity blind'
  UNION ALL SELECT 'ssh', NULL, 0, 'SSH host-key continuity blind') GROUP BY kind"""

# --- graph searches, unrolled -------------------------------------------------
_DEPTH = 8


def _levels(tag: str, sources: str) -> None:
    """Level-synchronous search and backward sums as one expression for each level."""
    CTES[f"{tag}f0"] = f"SELECT ip AS s, ip AS v, CAST(1 AS DOUBLE) AS sigma FROM {sources}"
    for k in range(1, _DEPTH + 1):
        before = " UNION ALL ".join(f"SELECT s, v FROM {tag}f{j}" for j in range(k))
        CTES[f"{tag}f{k}"] = f"""
SELECT f.s, p.dst AS v, sum(f.sigma) AS sigma FROM {tag}f{k - 1} f JOIN bwpairs p ON p.src = f.v
WHERE NOT EXISTS (SELECT 1 FROM ({before}) b WHERE b.s = f.s AND b.v = p.dst) GROUP BY f.s, p.dst"""
    CTES[f"{tag}d{_DEPTH}"] = f"SELECT s, v, sigma, CAST(0 AS DOUBLE) AS delta FROM {tag}f{_DEPTH}"
    for k in range(_DEPTH - 1, 0, -1):
        CTES[f"{tag}d{k}"] = f"""
SELECT f.s, f.v, f.sigma, f.sigma * coalesce(x.pull, 0) AS delta FROM {tag}f{k} f LEFT JOIN (
  SELECT d.s, p.src AS v, sum((1 + d.delta) / d.sigma) AS pull FROM {tag}d{k + 1} d JOIN bwpairs p ON p.dst = d.v
  GROUP BY d.s, p.src) x ON x.s = f.s AND x.v = f.v"""
    CTES[f"{tag}sum"] = "SELECT v AS ip, sum(delta) AS b FROM (" + " UNION ALL ".join(
        f"SELECT v, delta FROM {tag}d{k}" for k in range(1, _DEPTH + 1)) + ") GROUP BY v"


CTES["bwpairs"] = "SELECT DISTINCT src, dst FROM conf WHERE src <> dst"
CTES["bwplaces"] = "SELECT ip, row_number() OVER (ORDER BY ip) - 1 AS pos, count(*) OVER () AS n FROM hosts"
CTES["bwpivots"] = """
SELECT ip FROM bwplaces WHERE pos % (n // least(64, n)) = 0 AND pos // (n // least(64, n)) < least(64, n)"""
_levels("bwx", "hosts")
_levels("bwp", "bwpivots")
BODIES["betweenness"] = """SELECT h.ip, round(coalesce(b, 0), 6) AS betweenness FROM hosts h LEFT JOIN bwxsum USING (ip)"""
BODIES["betweenness_pivots"] = """SELECT h.ip, round(coalesce(b, 0) * n / least(64, n), 6) AS betweenness FROM bwplaces h LEFT JOIN bwpsum USING (ip)"""

# --- drift lines ------------------------------------------------------------------
for _n in ("drift_nodes", "drift_ranks", "drift_edges", "drift_identity", "compat_warnings"):
    CTES[f"all_{_n}"] = BODIES[_n]
BODIES["drift_findings"] = """SELECT CAST(0 AS INTEGER) AS pos, 'warning' AS kind, 'comparison warning: ' || warning AS finding FROM all_compat_warnings
UNION ALL SELECT 1, 'summary', 'drift vs 20010101T000000Z: ' || (SELECT count(*) FILTER (WHERE change = 'appeared') || ' appeared, ' ||
    count(*) FILTER (WHERE change = 'disappeared') || ' vanished, ' FROM all_drift_nodes) || (SELECT count(*) FROM all_drift_ranks) || ' rank changes, ' ||
  (SELECT count(*) FILTER (WHERE change = 'new') || ' new edges to top terrain, ' || count(*) FILTER (WHERE change = 'vanished') || ' vanished critical edges, ' FROM all_drift_edges) ||
  (SELECT count(*) FROM all_drift_identity) || ' identity changes, ' || (SELECT count(*) FROM newprov) || ' new sensitive-service providers, ' ||
  (SELECT count(DISTINCT (dst, port)) FROM moves) || ' provider displacements'
UNION ALL SELECT 2, 'identity', upper(protocol) || ' identity changed on ' || ip || ': added [' || replace(added, ',', ' ') || '] removed [' || replace(removed, ',', ' ') || ']' FROM all_drift_identity
UNION ALL SELECT 3, 'provider', 'new provider: ' || ip || ' began serving ' || service || ' (port ' || port || ') to ' || clients || ' client(s)' ||
  CASE WHEN new_host THEN ', host first seen this window' ELSE '' END || ' — investigate if unexpected' FROM newprov
UNION ALL SELECT 4, 'migration', clients || ' client(s) moved from ' || from_ip || ':' || from_port || ' to ' || dst || ':' || port || ' for ' || service FROM moves WHERE from_ip IS NOT NULL"""

# --- declared lines ---------------------------------------------------------------
for _n in ("config_warnings", "declared_gateways", "undeclared_cidrs", "adopted_devices", "policy_violations",
           "unused_permits", "skipped_rules"):
    CTES[f"all_{_n}"] = BODIES[_n]
CTES["all_silent"] = """
SELECT p AS cidr FROM owned WHERE NOT EXISTS (SELECT 1 FROM hosts WHERE ip LIKE p || '%')
UNION ALL SELECT '10.0.' || n || '.10' FROM nets WHERE '10.0.' || n || '.10' NOT IN (SELECT ip FROM hosts)"""
BODIES["declared_findings"] = """SELECT CAST(1 AS INTEGER) AS pos, 'device configs (' || replace(source, '.cfg', '') || '): ' || warning AS finding FROM all_config_warnings
UNION ALL SELECT 2, 'device configs: ' || (SELECT count(*) + 1 FROM routers) || ' device(s) declared, ' || (SELECT count(*) FROM all_declared_gateways) ||
  ' gateway(s) identified, ' || (SELECT count(*) FROM all_silent) || ' silent subnet(s), ' || (SELECT count(*) FROM all_undeclared_cidrs) || ' undeclared CIDR(s)'
UNION ALL SELECT 3, 'device configs: ' || (SELECT count(*) FROM routers WHERE '10.' || r || '.' || b || '.1' IN (SELECT ip FROM hosts)) || ' of ' ||
  (SELECT count(*) FROM routers) || ' Cisco IOS device(s) matched observed map nodes'
UNION ALL SELECT 4, 'device configs: ' || (SELECT count(*) FILTER (WHERE observed_ip <> '') || ' of ' || count(*) FROM all_adopted_devices) || ' adopted UniFi device(s) matched observed map nodes'
UNION ALL SELECT 5, 'declared policy: ' || (SELECT count(*) FROM all_policy_violations) || ' denied-but-observed violation(s), ' || (SELECT count(*) FROM all_unused_permits) ||
  ' unused permit(s), ' || (SELECT skipped_rules FROM all_skipped_rules) || ' rule(s) skipped (caveated)'"""

# --- map overlays ---------------------------------------------------------------
CTES["looked"] = BODIES["segment_lookup"]
CTES["lookgroups"] = """
SELECT cidr, count(*) AS hosts, list_sort(list_distinct(flatten(list(sensors)))) AS sensors FROM looked JOIN hosts USING (ip) GROUP BY cidr"""
BODIES["map_groups"] = f"""SELECT 'g:' || cidr AS id, cidr, CASE WHEN seg <> '' THEN cidr || ' — ' || seg WHEN lab <> '' THEN cidr || ' — ' || lab ELSE cidr END AS label,
  hosts, array_to_string(sensors, ',') AS sensors, FALSE AS sparse FROM (SELECT g.*, coalesce(CASE WHEN cidr = '10.1.0.0/16' THEN 'clients'
    WHEN cidr LIKE '%.0/27' THEN 'low-' || split_part(cidr, '.', 3) END, '') AS seg, coalesce(a.segment, '') AS lab
  FROM lookgroups g LEFT JOIN (SELECT {_subnet('ip')} AS net, arg_min(segment, CAST(regexp_extract(hostname, '[0-9]+') AS BIGINT)) AS segment FROM assets WHERE segment <> '' GROUP BY net) a
  ON a.net = g.cidr) WHERE hosts >= 2
UNION ALL SELECT 'g:sparse', '', 'sparse hosts (' || sum(hosts) || ')', CAST(sum(hosts) AS BIGINT), '', TRUE FROM lookgroups WHERE hosts < 2 HAVING count(*) > 0"""
BODIES["map_drift"] = """WITH u AS (SELECT ip, subnet FROM hosts_2 UNION ALL SELECT ip, subnet FROM hosts_1 WHERE ip NOT IN (SELECT ip FROM hosts_2)),
g AS (SELECT ip, CASE WHEN count(*) OVER (PARTITION BY subnet) < 2 THEN 'g:sparse' ELSE 'g:' || subnet END AS gid FROM u),
f AS (SELECT ip, 'new' AS drift FROM hosts_2 WHERE ip NOT IN (SELECT ip FROM hosts_1)
  UNION ALL SELECT ip, 'vanished' FROM hosts_1 WHERE ip NOT IN (SELECT ip FROM hosts_2)
  UNION ALL SELECT a.ip, CASE WHEN a.rank > b.rank THEN 'rank-up' ELSE 'rank-down' END FROM scored_1 a JOIN scored_2 b USING (ip) WHERE abs(a.rank - b.rank) >= 5)
SELECT ip AS id, gid AS "group", drift FROM g JOIN f USING (ip)"""
BODIES["map_reconcile"] = f"""SELECT drift, count(*) AS n FROM (SELECT ip, CASE WHEN ip IN (SELECT ip FROM contra WHERE observed <> 'Unknown') THEN 'contradicted'
    WHEN ip NOT IN (SELECT ip FROM assets) THEN 'undocumented' ELSE '' END AS drift FROM hosts) WHERE drift <> '' GROUP BY drift
UNION ALL SELECT 'silent', count(*) FROM assets WHERE ip NOT IN (SELECT ip FROM hosts) AND 'g:' || {_subnet('ip')} IN (SELECT gid FROM cells)"""

BODIES["reconcile_lines"] = f"""WITH quiet AS (SELECT 'g:' || {_subnet('ip')} IN (SELECT gid FROM cells) AS shown FROM assets WHERE ip NOT IN (SELECT ip FROM hosts)),
tally AS (SELECT (SELECT count(*) FROM quiet) AS n, (SELECT count(*) FROM quiet WHERE shown) AS g,
  (SELECT count(*) FROM hosts WHERE ip NOT IN (SELECT ip FROM assets)) AS u, (SELECT count(*) FROM contra WHERE observed <> 'Unknown') AS k),
maps AS (SELECT unnest(['detailed', 'overview']) AS "map")
SELECT "map", 0 AS pos, n || ' documented assets produced no observed traffic (' || CASE "map" WHEN 'overview' THEN 0 ELSE g END ||
  ' shown ghosted; cross-check blind spots before calling them decommissioned)' AS finding FROM tally, maps WHERE n > 0
UNION ALL SELECT "map", 1, u || ' observed hosts are not in the asset list' FROM tally, maps WHERE u > 0
UNION ALL SELECT "map", 2, k || ' hosts contradict their documented role' FROM tally, maps WHERE k > 0"""


_ORDER = list(CTES)


def sql(name: str) -> str:
    body = BODIES[name]
    needed: set[str] = set()
    words = set(re.findall(r"[a-z_][a-z_0-9]*", body)) & set(CTES)
    while words:
        w = words.pop()
        if w not in needed:
            needed.add(w)
            words |= set(re.findall(r"[a-z_][a-z_0-9]*", CTES[w])) & set(CTES) - needed
    own = re.match(r"\s*WITH\s+", body)
    parts = []
    done: set[str] = set()

    def place(w: str):
        if w in done:
            return
        done.add(w)
        for dep in sorted(set(re.findall(r"[a-z_][a-z_0-9]*", CTES[w])) & needed - {w}):
            place(dep)
        parts.append(f"{w} AS MATERIALIZED ({CTES[w]})")

    for w in sorted(needed, key=_ORDER.index):
        place(w)
    if not parts:
        return body
    if own:
        return "WITH " + ",\n".join(parts) + ",\n" + body[own.end():]
    return "WITH " + ",\n".join(parts) + "\n" + body


def all_sql() -> dict[str, str]:
    return {name: sql(name) for name in BODIES}
