"""The URL index: tokens, exact, prefix, domain and glob look-ups, statistics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls


def tokens(url: Column, strict_host: bool = False) -> Column:
    """Scheme, host labels from the top, path segments, '?query'.  ``strict_host`` marks where the host ends."""
    none = F.array().cast("array<string>")
    host = F.when(urls.domain(url) != "", F.reverse(F.split(urls.domain(url), r"\."))).otherwise(none)
    parts = F.filter(F.split(urls.path(url), "/"), lambda p: p != "")
    out = [F.when(urls.scheme(url) != "", F.array(urls.scheme(url))).otherwise(none), host]
    if strict_host:
        out.append(F.array(F.lit("/")))
    return F.concat(*out, parts, F.when(urls.query(url) != "", F.array(F.concat(F.lit("?"), urls.query(url)))).otherwise(none))


def build(records: DataFrame, order: str = "seq", strict_host: bool = False) -> DataFrame:
    """One row per token list: the last URL and path win, metadata are merged (later keys win).
    Repeats are aggregated before they are shuffled, so a URL with very many records is no large group.

    ``records``: url, local_path, metadata, and a column that orders the inserts.
    """
    entry = "struct<k:string,v:string>"
    # A row of its own for each metadata entry, and one without a key for the record: what meets in a group is the latest only.
    entries = F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    each = F.concat(F.array(F.lit(None).cast(entry)), F.transform(entries, lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))))
    rows = records.select(tokens(F.col("url"), strict_host).alias("tokens"), "url", "local_path", F.col(order).alias("o"), F.explode(each).alias("e"))
    latest = rows.groupBy("tokens", F.col("e.k").alias("k")).agg(F.max(F.struct("o", "url", "local_path")).alias("r"), F.max(F.struct("o", "e.v")).alias("m"), F.count("*").alias("n"))
    own = F.col("k").isNull()
    merged = F.map_from_entries(F.sort_array(F.collect_list(F.when(~own, F.struct("k", "m.v")))))
    found = latest.groupBy("tokens").agg(F.max(F.when(own, F.col("r"))).alias("r"), merged.alias("metadata"), F.max(F.when(own, F.col("n"))).alias("inserts"))
    return found.select("tokens", "r.url", "r.local_path", "metadata", "inserts", urls.domain(F.col("r.url")).alias("domain"))


def search(index: DataFrame, queries: DataFrame, strict_host: bool = False) -> DataFrame:
    """Exact look-ups of ``queries`` (url): equal token lists, so a trailing slash makes no difference."""
    asked = queries.select(F.col("url").alias("asked"), tokens(F.col("url"), strict_host).alias("tokens"))
    return asked.join(index, "tokens").select("asked", "url", "local_path", "metadata")


def starts_with(index: DataFrame, prefix: str) -> DataFrame:
    p = tokens(F.lit(prefix))
    return index.filter(F.slice("tokens", F.lit(1), F.size(p)) == p)


def starts_with_any(index: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Many prefixes at once: an equi-join on the index rows' own prefixes of the lengths that are asked for."""
    asked = prefixes.select(F.col("prefix"), tokens(F.col("prefix")).alias("p"))
    sizes = asked.agg(F.sort_array(F.collect_set(F.size("p"))).alias("sizes"))  # one row, as many entries as lengths
    rows = index.crossJoin(F.broadcast(sizes)).withColumn("k", F.explode(F.filter("sizes", lambda k: k <= F.size("tokens")))).withColumn("p", F.slice("tokens", F.lit(1), F.col("k")))
    return rows.join(asked, "p").select("prefix", "url", "local_path")


def by_domain(index: DataFrame, domain: str) -> DataFrame:
    return index.filter(F.col("domain") == domain.lower())


def by_domain_like(records: DataFrame, domain: str) -> DataFrame:
    """The pattern flavour: '%://domain/%' in any case; '_' and '%' in the domain are wildcards."""
    return records.filter(F.col("url").ilike(f"%://{domain}/%"))


def glob_pattern(glob: str) -> str:
    return "(?i)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def by_glob(index: DataFrame, glob: str) -> DataFrame:
    """Globs over whole URLs, any case: '*' for any characters, '?' for one."""
    return index.filter(F.col("url").rlike(glob_pattern(glob)))


def stats(index: DataFrame) -> DataFrame:
    """One row: inserts, distinct prefixes with the root, longest token list, distinct domains."""
    prefixes = index.filter(F.size("tokens") > 0).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("tokens")), lambda k: F.slice("tokens", F.lit(1), k))).alias("p")).distinct().agg((F.count("*") + 1).alias("total_nodes"))
    own = index.agg(F.coalesce(F.sum("inserts"), F.lit(0)).alias("total_urls"), F.coalesce(F.max(F.size("tokens")), F.lit(0)).cast("long").alias("max_depth"), F.count_distinct(F.nullif("domain", F.lit(""))).alias("unique_domains"))
    return own.crossJoin(prefixes)  # one row each
