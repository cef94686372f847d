"""Role inference: eleven rules over protocol evidence and graph shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyscape import config
from keyscape.functions import ports
from keyscape.functions.text import role_confidence
from keyscape.operators.edges import admin_shape, client_counts, clients_of

KINDS = ["kerberos", "dns", "smb", "http", "ssl", "ldap", "dhcp"]

# Evidence sentence of every counted role.
_SENTENCES = {
    "DomainController": "%d distinct hosts made Kerberos requests to this host; "
    "LDAP also observed",
    "DNSServer": "%d distinct hosts issued DNS queries to this host",
    "DHCPServer": "%d distinct hosts received a DHCP lease from this host",
    "FileServer": "%d distinct hosts opened SMB sessions to this host",
    "Database": "%d distinct hosts connected on a database port",
    "WebServer": "%d distinct hosts made HTTP/TLS requests to this host",
    "Printer": "%d distinct hosts sent print traffic (ipp/jetdirect) to this host",
    "Camera": "%d distinct hosts pulled RTSP streams from this host",
    "MailServer": "%d distinct hosts connected on mail ports (smtp/imap/pop3)",
    "NetworkGear": "%d host(s) used network-infrastructure protocols "
    "(capwap/papi/tacacs/smart-install) to this host",
}


def facts(
    nodes: DataFrame, edges: DataFrame, cardinality: DataFrame, measures: DataFrame | None = None
) -> DataFrame:
    """All counts the rules need, one row per node. ``measures``: ``host_measures`` of the
    edges, if they are at hand."""
    logs = cardinality.groupBy(F.col("responder").alias("ip")).agg(
        *[F.max(F.when(F.col("kind") == k, F.col("clients"))).alias(k) for k in KINDS]
    )
    joined = nodes.join(logs, "ip", "left")
    joined = joined.join(client_counts(edges) if measures is None else clients_of(measures), "ip", "left")
    joined = joined.join(admin_shape(edges), "ip", "left")
    if "temporal" in edges.columns:
        shape = (
            edges.filter(ports.is_database("port") & F.col("temporal").isNotNull())
            .groupBy(F.col("dst").alias("ip"))
            .agg(F.max("temporal.class").alias("db_class"))
        )
        return joined.join(shape, "ip", "left")
    return joined.withColumn("db_class", F.lit(None).cast("string"))


def _assertion(order: int, role: str, have: Column, suffix: Column | None = None,
               extra: Column | None = None) -> Column:
    minimum = config.ROLE_MIN_CLIENTS[role]
    sentence = F.format_string(_SENTENCES[role], have.cast("bigint"))
    if suffix is not None:
        sentence = F.concat(sentence, suffix)
    test = have >= minimum
    if extra is not None:
        test = test & extra
    return F.when(test, F.struct(
        (-role_confidence(have, minimum)).alias("o1"),
        F.lit(order).alias("o2"),
        F.lit(role).alias("role"),
        role_confidence(have, minimum).alias("confidence"),
        F.array(sentence).alias("evidence"),
    ))


def infer(fact: DataFrame) -> DataFrame:
    """Roles of every node, most confident first, rule order on ties."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    noted = F.when(
        F.col("db_class").isin("Constant", "BusinessHours"),
        F.concat(F.lit(" ("), F.col("db_class"), F.lit(" activity)")),
    ).otherwise("")
    jump_in, jump_out = zero("admin_in"), zero("admin_out")
    jump = F.when(
        (jump_in <= config.JUMP_MAX_IN) & (jump_out >= config.JUMP_MIN_OUT),
        F.struct(
            F.lit(-config.JUMP_CONFIDENCE).alias("o1"),
            F.lit(11).alias("o2"),
            F.lit("JumpBox").alias("role"),
            F.lit(config.JUMP_CONFIDENCE).alias("confidence"),
            F.array(F.format_string(
                "RDP/SSH from %d host(s) in, out to %d host(s) — pivot shape",
                jump_in, jump_out,
            )).alias("evidence"),
        ),
    )
    rules = F.array(
        _assertion(1, "DomainController", zero("kerberos"), extra=F.col("ldap").isNotNull()),
        _assertion(2, "DNSServer", zero("dns")),
        _assertion(3, "DHCPServer", zero("dhcp")),
        _assertion(4, "FileServer", zero("smb")),
        _assertion(5, "Database", zero("db_clients"), suffix=noted),
        _assertion(6, "WebServer", F.greatest(zero("http"), zero("ssl"))),
        _assertion(7, "Printer", zero("printer_clients")),
        _assertion(8, "Camera", zero("camera_clients")),
        _assertion(9, "MailServer", zero("mail_clients")),
        _assertion(10, "NetworkGear", zero("gear_clients")),
        jump,
    )
    held = F.transform(
        F.array_sort(F.array_compact(rules)),
        lambda r: F.struct(r["role"].alias("role"), r["confidence"].alias("confidence"),
                           r["evidence"].alias("evidence")),
    )
    unknown = F.array(F.struct(
        F.lit(config.ROLE_UNKNOWN).alias("role"),
        F.lit(0.0).alias("confidence"),
        F.array().cast("array<string>").alias("evidence"),
    ))
    return fact.withColumn("_held", held).select(
        "ip", F.when(F.size("_held") > 0, F.col("_held")).otherwise(unknown).alias("roles")
    )


def top_role(roles="roles") -> Column:
    c = F.col(roles) if isinstance(roles, str) else roles
    return F.coalesce(F.get(c, F.lit(0))["role"], F.lit(config.ROLE_UNKNOWN))


def role_names(roles="roles") -> Column:
    """Sorted distinct role names of a host."""
    c = F.col(roles) if isinstance(roles, str) else roles
    names = F.transform(c, lambda r: r["role"])
    return F.array_sort(F.array_distinct(F.coalesce(names, F.array().cast("array<string>"))))
