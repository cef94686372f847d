"""Address-in-CIDR joins as equi joins.

An address lies in at most one network of each prefix length, so it has one possible join
token, ``(bits, masked address)``, for each length that occurs in the CIDR table: at most
33 + 129, usually a handful, whatever the size of either side. A small CIDR table is
broadcast. A large one is merged with the addresses in one range sort, where every address
meets the last network of each length that starts before it; only tokens of networks that
are there go on, and they are dealt by token and range, so that not even 0.0.0.0/0 is one
key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from keyscape.functions import ip as ipf
from keyscape.functions.columns import let, reusable
from keyscape.session import materialize

#: CIDR tables of at most so many rows are broadcast.
BROADCAST_CIDRS = 100_000


def prefix_lengths(cidrs: DataFrame, column: str) -> list[int]:
    """Distinct prefix lengths (at most 162 values)."""
    rows = cidrs.select(ipf.cidr_bits(column).alias("b")).distinct().collect()
    return sorted(r["b"] for r in rows if r["b"] is not None)


@reusable
def network_token(cidr) -> Column:
    """Join token of a CIDR: length and masked network."""
    return let(
        ipf.cidr_parts(cidr),
        lambda p: F.when(p["bits"].isNotNull(), F.concat_ws(
            "/", p["bits"].cast("string"), ipf.key_prefix(p["key"], p["bits"]))),
    )


def address_tokens(key: Column, lengths: list[int]) -> Column:
    """Tokens of one address at the given lengths that fit its family."""
    def token(k: Column, bits: int) -> Column:
        value = F.concat_ws("/", F.lit(str(bits)), ipf.key_prefix(k, F.lit(bits)))
        return value if bits <= 32 else F.when(k.startswith("6"), value)

    none = F.array().cast("array<string>")
    if not lengths:
        return none
    return let(key, lambda k: F.array_compact(F.array(*[token(k, b) for b in lengths])))


def match(
    addresses: DataFrame,
    ip: str,
    cidrs: DataFrame,
    cidr: str,
    lengths: list[int] | None = None,
    broadcast_cidrs: int = BROADCAST_CIDRS,
) -> DataFrame:
    """Every (address row, CIDR row) where the CIDR contains the address. Malformed ones
    match nothing; repeated rows on either side count each. ``lengths``: the prefix lengths
    of the CIDRs, if they are known."""
    right = cidrs.withColumn("_token", network_token(cidr)).filter("_token IS NOT NULL")
    found = right.agg(F.count("*").alias("n"), F.collect_set(F.substring_index("_token", "/", 1).cast("int")).alias("b")).first()
    lengths = sorted(set(found.b) if lengths is None else set(found.b) & set(lengths))
    if found.n <= broadcast_cidrs:
        left = addresses.withColumn("_token", F.explode(address_tokens(ipf.ip_key(ip), lengths)))
        return left.join(F.broadcast(right), "_token").drop("_token")
    tokens = materialize(network_tokens(addresses, ip, cidrs, cidr, lengths), "cidr-tokens")
    there = tokens.select("_token", "_part").distinct()
    pairs = tokens.join(right.join(there, "_token"), ["_token", "_part"]).drop("_token", "_part")
    return pairs if addresses.columns == [ip] else addresses.join(pairs.withColumnRenamed(ip, "_ip"), F.col(ip) == F.col("_ip")).drop("_ip")


def network_tokens(
    addresses: DataFrame, ip: str, cidrs: DataFrame, cidr: str, lengths: list[int]
) -> DataFrame:
    """(ip, _part, _token): each distinct address with the networks that hold it, from a sweep
    over both in the order of their keys. ``_part`` is the range that the address is in.

    Networks of one length don't overlap, so of each length only the last one that starts at
    or before an address can hold it. Within a range that is a running value; at a range's
    start it is the last of all ranges before, of which there is one row each.
    """
    networks = cidrs.select(ipf.cidr_range(cidr).alias("r")).select(
        F.col("r.lo").alias("_key"), F.col("r.bits").alias("_bits")).distinct().filter("_key IS NOT NULL")
    hosts = addresses.select(ip).distinct().select(
        ipf.ip_key(ip).alias("_key"), F.lit(None).cast("int").alias("_bits"), ip).filter("_key IS NOT NULL")
    rows = networks.withColumn(ip, F.lit(None).cast(hosts.schema[ip].dataType)).select("_key", "_bits", ip).unionByName(hosts)
    order = [F.col("_key"), F.col("_bits").isNull(), F.col("_bits"), F.col(ip)]
    swept = materialize(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_tag", F.monotonically_increasing_id()), "cidr-sweep"
    ).withColumn("_part", F.shiftright("_tag", 33))
    start = {b: F.when(F.col("_bits") == b, F.col("_key")) for b in lengths}
    running = Window.partitionBy("_part").orderBy("_tag").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range
    borders = swept.groupBy("_part").agg(*[F.max(c).alias(f"_m{b}") for b, c in start.items()]).select(
        "_part", *[F.max(f"_m{b}").over(earlier).alias(f"_b{b}") for b in lengths])
    inside = swept.select("*", *[F.last(c, ignorenulls=True).over(running).alias(f"_s{b}") for b, c in start.items()])
    inside = inside.filter("_bits IS NULL").join(F.broadcast(borders), "_part")

    def token(bits: int) -> Column:
        own = ipf.key_prefix(F.col("_key"), F.lit(bits))
        last = ipf.key_prefix(F.coalesce(f"_s{bits}", f"_b{bits}"), F.lit(bits))
        return F.when(own == last, F.concat_ws("/", F.lit(str(bits)), own))

    held = F.array_compact(F.array(*[token(b) for b in lengths])) if lengths else F.array().cast("array<string>")
    return inside.select(ip, "_part", F.explode(held).alias("_token"))


def contained_in(
    addresses: DataFrame, ip: str, cidrs: DataFrame, cidr: str,
    lengths: list[int] | None = None,
) -> DataFrame:
    """Distinct addresses inside any CIDR."""
    return match(addresses.select(ip).distinct(), ip, cidrs.select(cidr).distinct(),
                 cidr, lengths).select(ip).distinct()


def longest_match(
    addresses: DataFrame, ip: str, cidrs: DataFrame, cidr: str,
    lengths: list[int] | None = None,
) -> DataFrame:
    """Most specific CIDR per distinct address; NULL when none contains it."""
    hosts = addresses.select(ip).distinct()
    found = match(hosts, ip, cidrs.select(cidr).distinct(), cidr, lengths)
    best = F.max(F.struct(ipf.cidr_bits(cidr).alias("bits"), F.col(cidr).alias("cidr")))
    picked = found.groupBy(ip).agg(best.alias("b")).select(ip, F.col("b.cidr").alias(cidr))
    return hosts.join(picked, ip, "left")


def overlapping(left: DataFrame, left_cidr: str, right: DataFrame, right_cidr: str) -> DataFrame:
    """Distinct left CIDRs that share addresses with any right CIDR: one of two
    overlapping CIDRs contains the network address of the other."""
    a = left.select(left_cidr).distinct()
    b = right.select(F.col(right_cidr).alias("_r")).distinct()

    inside = match(
        a.withColumn("_ip", ipf.network_address(left_cidr)), "_ip", b, "_r"
    ).select(left_cidr)
    around = match(
        b.withColumn("_ip", ipf.network_address("_r")), "_ip", a, left_cidr
    ).select(left_cidr)
    return inside.unionByName(around).distinct()
