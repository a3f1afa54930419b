"""Address guards and request headers: CIDR tests, header rules by domain."""

from __future__ import annotations

import base64
import ipaddress
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import urls

#: Networks that are never fetched from.
PRIVATE_NETWORKS = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "::1/128", "fc00::/7", "fe80::/10")
#: Further reserved IPv4 networks.
RESERVED_NETWORKS = ("0.0.0.0/8", "100.64.0.0/10", "192.0.0.0/24", "192.0.2.0/24", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4")


def ipv4_number(ip: Column) -> Column:
    """The address as an integer, or null if it is no dotted quad."""
    p = F.split(ip, r"\.")
    part = lambda k: p[k].try_cast("bigint")
    n = part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3)
    ok = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}\z") & (part(0) < 256) & (part(1) < 256) & (part(2) < 256) & (part(3) < 256)
    return F.when(ok, n)


def _ranges(networks) -> list[tuple[int, int]]:
    nets = [ipaddress.ip_network(n) for n in networks]
    return sorted((int(n.network_address), int(n.broadcast_address)) for n in nets if n.version == 4)


def is_private_ipv4(ip: Column, reserved: bool = True) -> Column:
    """In one of the fixed ranges: a few comparisons of the address's number, no join."""
    n = ipv4_number(ip)
    out = F.lit(False)
    for lo, hi in _ranges(PRIVATE_NETWORKS + (RESERVED_NETWORKS if reserved else ())):
        out = out | n.between(lo, hi)
    return out


def _private_ipv6(col: pa.Array) -> pa.Array:
    nets = [ipaddress.ip_network(n) for n in PRIVATE_NETWORKS]
    out = []
    for s in col.to_pylist():
        try:
            ip = ipaddress.ip_address(s)
            out.append(ip.is_private or ip.is_reserved or ip.is_loopback or ip.is_link_local or any(ip in n for n in nets if n.version == ip.version))
        except (ValueError, TypeError):
            out.append(True)
    return pa.array(out, pa.bool_())


def dns_guard(dns: DataFrame, ipv6: bool = True) -> DataFrame:
    """(hostname, allowed) of a table (hostname, ip): false if any address is private or no address at all.

    IPv4 is arithmetic; IPv6 takes an Arrow step.  Without ``ipv6`` such addresses count as unparsable.
    """
    ip = F.col("ip")
    bad = F.when(ipv4_number(ip).isNotNull(), is_private_ipv4(ip)).otherwise(F.arrow_udf(_private_ipv6, "boolean")(ip) if ipv6 else F.lit(True))
    return dns.groupBy("hostname").agg((~F.bool_or(F.coalesce(bad, F.lit(True)))).alias("allowed"))


def guarded(requests: DataFrame, guard: DataFrame, literal_bypass: bool = False) -> DataFrame:
    """Adds ``allowed`` to requests (hostname): unknown hosts pass, literal addresses are tested unless bypassed."""
    literal = F.col("hostname").rlike(r"^[\d.]+\z")
    own = F.lit(True) if literal_bypass else F.coalesce(ipv4_number(F.col("hostname")).isNotNull() & ~is_private_ipv4(F.col("hostname")), F.lit(False))
    return requests.join(guard, "hostname", "left").withColumn("allowed", F.when(literal, own).otherwise(F.coalesce("allowed", F.lit(True))))


def ipv6_hex(ip: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address, or null if it is none (zone names are not read).

    A dotted quad at the end counts as two groups; one '::' stands for at least one group of zeros.
    """
    none = F.array().cast("array<string>")

    def without_quad(t):
        quad = F.regexp_extract(t, r":(\d{1,3}(?:\.\d{1,3}){3})\z", 1)
        return F.when(t.rlike(r":\d+\.\d+\.\d+\.\d+\z"), urls.let(quad, lambda q: urls.let(ipv4_number(q), lambda n: F.concat(t.substr(F.lit(1), F.length(t) - F.length(q)), F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(65535)))))).otherwise(t)

    def filled(head, tail, halves):
        size = F.size(head) + F.size(tail)
        fits = ((halves == 1) & (size == 8)) | ((halves == 2) & (size < 8))
        return F.when(fits, F.concat(head, F.array_repeat(F.lit("0"), 8 - size), tail))

    def expanded(halves):
        groups = lambda h: F.when(h == "", none).otherwise(F.split(h, ":", -1))
        return urls.let(groups(F.get(halves, F.lit(0))), lambda head: urls.let(groups(F.coalesce(F.get(halves, F.lit(1)), F.lit(""))), lambda tail: filled(head, tail, F.size(halves))))

    # Groups that are not one to four digits are left out here, so the length tells.
    joined = lambda g: F.array_join(F.transform(F.filter(g, lambda x: x.rlike(r"^[0-9a-f]{1,4}\z")), lambda x: F.lpad(x, 4, "0")), "")
    digits = urls.let(F.split(F.lower(without_quad(ip)), "::", -1), lambda h: joined(expanded(h)))
    return urls.let(F.when(ip.contains(":"), digits), lambda d: F.when(F.length(d) == 32, d))


def address_hex(ip: Column) -> Column:
    """Hexadecimal digits of an address, 8 for IPv4 and 32 for IPv6, or null."""
    return F.when(ip.contains(":"), ipv6_hex(ip)).otherwise(F.lower(F.lpad(F.hex(ipv4_number(ip)), 8, "0")))


def _leading(digits: Column, bits: Column) -> Column:
    """The first ``bits`` bits: whole digits, and what is left of the next one."""
    whole, rest = F.floor(bits / 4).cast("int"), bits % 4
    digit = F.conv(digits.substr(whole + 1, F.lit(1)), 16, 10).cast("int")
    part = F.floor(digit / F.pow(F.lit(2), 4 - rest))
    return F.concat(digits.substr(F.lit(1), whole), F.when(rest > 0, F.concat(F.lit("/"), part.cast("string"))).otherwise(F.lit("")))


def _matches(ips: DataFrame, networks: DataFrame) -> DataFrame:
    """(ip, network, bits) by an equi-join: an address has one key for each length that occurs in its family (at most 33 and 129).

    Bits of a network beyond its length are ignored; without a length it is one address.  What cannot be read matches nothing.
    """
    nets = networks.select("network", address_hex(F.split("network", "/")[0]).alias("digits"), F.try_element_at(F.split("network", "/"), F.lit(2)).alias("size")).filter("digits IS NOT NULL")
    nets = nets.withColumn("width", F.length("digits") * 4).withColumn("bits", F.when(F.col("size").isNull(), F.col("width")).otherwise(F.col("size").try_cast("int"))).filter("bits BETWEEN 0 AND width")
    keyed = nets.select("network", "width", "bits", _leading(F.col("digits"), F.col("bits")).alias("key"))
    lengths = nets.agg(F.collect_set(F.struct("width", "bits")).alias("lengths"))  # one row, at most 162 entries
    asked = ips.select("ip", address_hex(F.col("ip")).alias("digits")).filter("digits IS NOT NULL").crossJoin(F.broadcast(lengths))
    asked = asked.select("ip", "digits", F.explode(F.filter("lengths", lambda x: x["width"] == F.length("digits") * 4)).alias("x")).select("ip", "digits", "x.width", "x.bits")
    asked = asked.select("ip", "width", "bits", _leading(F.col("digits"), F.col("bits")).alias("key"))
    return asked.join(keyed, ["width", "bits", "key"]).select("ip", "network", "bits")


def in_networks(ips: DataFrame, networks: DataFrame) -> DataFrame:
    """(ip, network): all pairs of addresses (ip) and networks (network) that hold them, IPv4 and IPv6."""
    return _matches(ips, networks).select("ip", "network")


def longest_network(ips: DataFrame, networks: DataFrame) -> DataFrame:
    """(ip, network): the longest network that holds each different address; equal ones in two writings count as the later text.

    Addresses are made different first, so a frequent one is one row.
    """
    return _matches(ips.select("ip").distinct(), networks.distinct()).groupBy("ip").agg(F.max_by("network", F.struct("bits", "network")).alias("network"))


def basic_header(user: Column, password: Column) -> Column:
    return F.create_map(F.lit("Authorization"), F.concat(F.lit("Basic "), F.base64(F.encode(F.concat(user, F.lit(":"), password), "UTF-8"))))


def bearer_header(token: Column) -> Column:
    return F.create_map(F.lit("Authorization"), F.concat(F.lit("Bearer "), token))


def merged_headers(*maps: Column) -> Column:
    """Later maps win."""
    over = lambda old, new: F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
    return reduce(over, maps)


def headers_of(config: dict) -> dict[str, str]:
    """Headers of one strategy: none, basic, bearer, custom; cookies add none; others are a ValueError."""
    kind = config.get("type", "none").lower()
    if kind in ("none", "cookie"):
        return {}
    if kind == "basic":
        pair = f"{config.get('username', '')}:{config.get('password', '')}"
        return {"Authorization": "Basic " + base64.b64encode(pair.encode()).decode()}
    if kind == "bearer":
        return {"Authorization": f"Bearer {config.get('token', '')}"}
    if kind == "custom":
        return dict(config.get("headers", {}))
    raise ValueError(f"unknown authentication type: {kind}")


def composite_headers(configs: list[dict]) -> dict[str, str]:
    """Headers of several strategies; later ones win."""
    return {k: v for c in configs for k, v in headers_of(c).items()}


def auth_rules(spark, config: dict) -> DataFrame:
    """(domain, priority, headers) of a configuration; the default has a null domain."""
    rows = [(None, 1 << 30, headers_of(config.get("default", {"type": "none"}) if config.get("type") == "domain_based" else config))]
    if config.get("type") == "domain_based":
        rows += [(d.lower(), k, headers_of(c)) for k, (d, c) in enumerate(config.get("domains", {}).items())]
    return spark.createDataFrame(rows, "domain string, priority int, headers map<string,string>")


def match_auth(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, headers): the rule of the exact domain, else the first registered one that it is below, else the default.

    A host's suffixes are exploded, so the suffix test is an equi-join.
    """
    host = urls.domain(F.col("url"))
    labels = F.split(host, r"\.")
    below = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("domain")))
    named = rules.filter("domain IS NOT NULL").select("domain", "priority", "headers")
    asked = requests.select("url").distinct().select("url", F.explode(below).alias("s")).select("url", "s.*")
    first = W.partitionBy("url").orderBy(F.when(F.col("k") == 1, 0).otherwise(1), "priority")
    best = asked.join(named, "domain").withColumn("r", F.row_number().over(first)).filter("r = 1").select("url", "headers")
    default = rules.filter("domain IS NULL").select(F.col("headers").alias("_default")).limit(1)
    out = requests.select("url").join(best, "url", "left").join(default, F.lit(True), "left")
    return out.select("url", F.coalesce("headers", "_default", F.create_map().cast("map<string,string>")).alias("headers"))


def redacted(headers: Column) -> Column:
    """Header values for logs and sinks: credentials are hidden."""
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin("authorization", "cookie", "proxy-authorization"), "***").otherwise(v))
