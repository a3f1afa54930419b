"""The URL index in token order: every URL has a position, every prefix an interval of positions.

A URL's key is the bytes of its tokens, each closed by a mark, so a token list
is a prefix of another exactly if its key is one, and what begins with it lies
between its key and its key followed by the byte 255.  The table is written
sorted by key: one prefix reads only the row groups that can hold it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.sinks import scratch
from .index import tokens

#: Bits of ``monotonically_increasing_id`` that count the rows of a task.
ROW_BITS = 33


def key(t: Column) -> Column:
    """Bytes of a token list; a zero in a token is escaped, two zeros close it."""
    return F.array_join(F.transform(t, lambda x: F.concat(F.replace(x, F.lit("\0"), F.lit("\0\1")), F.lit("\0\0"))), "").cast("binary")


def key_end(k: Column) -> Column:
    """After all keys that begin with ``k``: UTF-8 has no byte 255."""
    return F.concat(k, F.lit(bytearray([255])))


@dataclass(frozen=True)
class Labelled:
    """``rows``: the index with key, part and pos (0, 1, ... in key order).  ``parts``: part, lo, hi_tokens, size, offset, one row for each range."""

    rows: DataFrame
    parts: DataFrame


def label(index: DataFrame, parts: int | None = None) -> Labelled:
    """Positions for the rows of ``index.build``; rows without tokens are left out.

    One range shuffle, written to the shared folder.  Positions follow from the
    row numbers of the tasks and the sizes of the ``parts`` before.
    """
    spark = index.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = index.filter(F.col("tokens").isNotNull()).withColumn("key", key(F.col("tokens")))
    path = scratch(spark, "intervals")
    keyed.repartitionByRange(n, "key").sortWithinPartitions("key").withColumn("mark", F.monotonically_increasing_id()).write.parquet(path)
    table = spark.read.parquet(path).withColumn("part", F.shiftright("mark", ROW_BITS))
    sizes = table.groupBy("part").agg(F.count("*").alias("size"), F.min("key").alias("lo"), F.max_by("tokens", "key").alias("hi_tokens"))
    # As many rows as parts, whatever the size of the index.
    offsets = sizes.withColumn("offset", F.sum("size").over(W.orderBy("part")) - F.col("size"))
    rows = table.join(F.broadcast(offsets.select("part", "offset")), "part")
    return Labelled(rows.withColumn("pos", F.col("offset") + F.col("mark").bitwiseAND((1 << ROW_BITS) - 1)).drop("mark", "offset"), offsets)


def starts_with(labelled: Labelled, prefix: str) -> DataFrame:
    """One prefix: a range of keys, which the scan prunes by the statistics of the sorted files."""
    lo, hi = labelled.rows.sparkSession.range(1).select(key(tokens(F.lit(prefix))).alias("lo")).select("lo", key_end(F.col("lo"))).first()
    return labelled.rows.filter((F.col("key") >= F.lit(lo)) & (F.col("key") < F.lit(hi)))


def intervals(labelled: Labelled, prefixes: DataFrame) -> DataFrame:
    """(prefix, first, last) of each different prefix; last is first - 1 where nothing begins with it.  Null prefixes are left out.

    Both ends of a prefix go to the part that holds them and are counted in among its keys; parts without an end are not read.
    """
    asked = prefixes.select("prefix").distinct().withColumn("lo", key(tokens(F.col("prefix")))).filter("lo IS NOT NULL")
    ends = asked.select("prefix", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("lo").alias("key")), F.struct(F.lit(1).alias("end"), key_end(F.col("lo")).alias("key")))).alias("e")).select("prefix", "e.*")
    # One row that lists the parts in order.
    bounds = labelled.parts.agg(F.sort_array(F.collect_list(F.struct("lo", "part", "offset"))).alias("bounds"))
    before = F.filter("bounds", lambda b: b["lo"] < F.col("key"))
    routed = ends.crossJoin(F.broadcast(bounds)).withColumn("b", F.try_element_at(before, F.lit(-1))).select("prefix", "end", "key", "b.part", "b.offset")
    inside = routed.filter("part IS NOT NULL")
    rows = labelled.rows.join(inside.select("part").distinct(), "part", "left_semi").select("part", "key", F.lit(1).alias("own"), F.lit(None).cast("string").alias("prefix"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("long").alias("offset"))
    both = rows.unionByName(inside.withColumn("own", F.lit(0)))
    # At equal keys the end comes first, so it counts the keys before it.
    counted = both.withColumn("n", F.sum("own").over(W.partitionBy("part").orderBy("key", "own").rowsBetween(W.unboundedPreceding, 0))).filter("own = 0")
    at = counted.select("prefix", "end", (F.col("offset") + F.col("n")).alias("at")).unionByName(routed.filter("part IS NULL").select("prefix", "end", F.lit(0).cast("long").alias("at")))
    return at.groupBy("prefix").agg(F.max(F.when(F.col("end") == 0, F.col("at"))).alias("first"), (F.max(F.when(F.col("end") == 1, F.col("at"))) - 1).alias("last"))


def starts_with_any(labelled: Labelled, prefixes: DataFrame, block: int = 4096) -> DataFrame:
    """(prefix, url, local_path) for a table of prefixes (prefix), each different one once.

    An interval is whole blocks of positions and less than two blocks of single
    ones.  Both meet the index by equality, so what is shuffled is no more than
    the result and the index, and a prefix of everything is spread over all blocks.
    """
    spans = intervals(labelled, prefixes).filter("last >= first")
    spans = spans.withColumn("b0", F.ceil(F.col("first") / block)).withColumn("b1", F.floor((F.col("last") + 1) / block))
    none = F.array().cast("array<bigint>")
    run = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(none)
    whole = F.col("b0") < F.col("b1")
    edges = F.when(whole, F.concat(run(F.col("first"), F.col("b0") * block - 1), run(F.col("b1") * block, F.col("last")))).otherwise(run(F.col("first"), F.col("last")))
    rows = labelled.rows.select("pos", "url", "local_path")
    single = rows.join(spans.select("prefix", F.explode(edges).alias("pos")), "pos")
    blocks = rows.withColumn("block", F.floor(F.col("pos") / block)).join(spans.filter(whole).select("prefix", F.explode(F.sequence("b0", F.col("b1") - 1)).alias("block")), "block")
    return single.select("prefix", "url", "local_path").unionByName(blocks.select("prefix", "url", "local_path"))


def common(a: Column, b: Column) -> Column:
    """How many leading tokens two different lists share."""
    return F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False) - 1


def stats(labelled: Labelled) -> DataFrame:
    """The row of ``index.stats``: a URL adds the tokens that it does not share with its neighbour before, so no prefix is listed."""
    earlier = labelled.parts.select("part", F.lag("hi_tokens").over(W.orderBy("part")).alias("earlier"))  # as many rows as parts
    rows = labelled.rows.select("part", "pos", "tokens", "inserts", "domain").join(F.broadcast(earlier), "part")
    before = F.coalesce(F.lag("tokens").over(W.partitionBy("part").orderBy("pos")), F.col("earlier"))
    new = F.size("tokens") - F.coalesce(common(F.col("before"), F.col("tokens")), F.lit(0))
    each = rows.withColumn("before", before).withColumn("new", new)
    return each.agg(
        F.coalesce(F.sum("inserts"), F.lit(0)).alias("total_urls"),
        F.coalesce(F.max(F.size("tokens")), F.lit(0)).cast("long").alias("max_depth"),
        F.count_distinct(F.nullif("domain", F.lit(""))).alias("unique_domains"),
        (F.coalesce(F.sum("new"), F.lit(0)) + 1).alias("total_nodes"),
    )
