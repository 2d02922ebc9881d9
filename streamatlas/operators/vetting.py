"""Vetting of URLs against the addresses their hosts resolve to."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType

from ..fixed import catalogue as fc
from ..functions import urls
from .keyed import lookup_by_key

# IPv4 ranges that are private, loopback, link-local, reserved or multicast, and the two exceptions.
UNSAFE_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
SAFE_V4 = ("192.0.0.9/32", "192.0.0.10/32")


def _within(number: Column, networks) -> Column:
    out = F.lit(False)
    for net in map(ipaddress.ip_network, networks):
        out = out | number.between(int(net.network_address), int(net.broadcast_address))
    return out


def unsafe_v4(ip: Column) -> Column:
    """True for a dotted IPv4 address that must not be fetched; malformed text counts as unsafe."""
    parts = F.split(ip, r"\.")
    octet = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("long")
    number = octet(1) * 2**24 + octet(2) * 2**16 + octet(3) * 2**8 + octet(4)
    return F.coalesce(_within(number, UNSAFE_V4) & ~_within(number, SAFE_V4), F.lit(True))


@F.pandas_udf(BooleanType())
def unsafe_v6(ips: pd.Series) -> pd.Series:
    def test(text: str) -> bool:
        try:
            a = ipaddress.ip_address(text)
        except ValueError:
            return True
        return a.is_private or a.is_loopback or a.is_link_local or a.is_reserved or a.is_multicast

    return ips.map(test)


def vet_hosts(dns: DataFrame) -> DataFrame:
    """(host, unsafe, ip): a host is unsafe when any of its addresses is; `ip` is the first answer."""
    is_v6 = F.contains(F.col("ip"), F.lit(":"))
    v4 = dns.where(~is_v6).withColumn("_unsafe", unsafe_v4(F.col("ip")))
    v6 = dns.where(is_v6).withColumn("_unsafe", unsafe_v6("ip"))
    return v4.unionByName(v6).groupBy("host").agg(
        F.bool_or("_unsafe").alias("unsafe"), F.min(F.struct("seq", "ip"))["ip"].alias("ip")
    )


def vet_urls(url_rows: DataFrame, dns: DataFrame) -> DataFrame:
    """URL rows (url, ...) with `verdict` (ok, bad-scheme, dns-error, blocked-ip) and the address to pin.

    dns: (host, seq, ip), one row per address in answer order.
    """
    rows = url_rows.withColumn("host", F.nullif(urls.host(F.col("url")), F.lit("")))
    found = lookup_by_key(rows, vet_hosts(dns), "host", F.xxhash64("url"), ["unsafe", "ip"])
    good_scheme = urls.scheme(F.col("url")).isin("http", "https") & F.col("host").isNotNull()
    verdict = (
        F.when(~good_scheme, fc.BAD_SCHEME)
        .when(F.col("unsafe").isNull(), fc.DNS_ERROR)
        .when(F.col("unsafe"), fc.BLOCKED_IP)
        .otherwise(fc.OK)
    )
    return found.withColumn("verdict", verdict).withColumn("ip", F.when(F.col("verdict") == fc.OK, F.col("ip"))).drop("unsafe")
