"""Many globs at once over the labelled URL index: posting lists of trigrams, then verification."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .intervals import Labelled

#: Positions of one posting list: lists are cut into blocks, so none grows with the index.
BLOCK = 4096


def folded(s: Column) -> Column:
    """ASCII letters in lower case, as the match compares them."""
    return F.translate(s, string.ascii_uppercase, string.ascii_lowercase)


def grams(s: Column) -> Column:
    """All different runs of three characters, in linear time: the characters are bound once, as a lambda's argument."""
    runs = lambda c: F.when(F.size(c) > 2, F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda k: F.concat(F.get(c, k), F.get(c, k + 1), F.get(c, k + 2)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.get(F.transform(F.array(F.split(s, "")), runs), F.lit(0)))


def postings(labelled: Labelled) -> DataFrame:
    """(gram, block, ids): the positions of URLs that hold a gram, at most ``BLOCK`` in a row."""
    each = labelled.rows.filter("url IS NOT NULL").select("pos", F.explode(grams(folded(F.col("url")))).alias("gram"))
    return each.groupBy("gram", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list("pos")).alias("ids"))


def pattern(glob: Column) -> Column:
    """The regular expression of a glob column, like ``index.glob_pattern`` of one glob."""
    quoted = F.regexp_replace(glob, r"([^A-Za-z0-9*?])", r"\\$1")
    return F.concat(F.lit("(?i)^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def match(labelled: Labelled, lists: DataFrame, patterns: DataFrame, most: int = 3) -> DataFrame:
    """(pattern, url, local_path) for a table of globs (pattern), each different one once; null patterns are left out.

    A URL is a candidate if it holds the pattern's ``most`` rarest grams; all
    candidates are verified.  A pattern without three plain characters in a row
    has no gram: it is verified on every block.
    """
    asked = patterns.select("pattern").distinct().filter("pattern IS NOT NULL")
    asked = asked.withColumn("grams", F.array_distinct(F.flatten(F.transform(F.split(folded(F.col("pattern")), "[*?]"), grams))))
    wanted = asked.select("pattern", F.explode("grams").alias("gram"))
    sizes = lists.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.sum(F.size("ids")).alias("n"))
    # The number of rows of a pattern is bounded by its length.
    ranked = wanted.join(sizes, "gram", "left").withColumn("rank", F.row_number().over(W.partitionBy("pattern").orderBy(F.col("n").asc_nulls_first(), "gram")))
    chosen = ranked.filter(F.col("rank") <= most).withColumn("k", F.count("*").over(W.partitionBy("pattern")))
    meets = chosen.filter("n IS NOT NULL").join(lists, "gram").groupBy("pattern", "k", "block").agg(F.collect_list("ids").alias("found")).filter("size(found) = k")
    ids = F.aggregate(F.slice("found", 2, most), F.get("found", F.lit(0)), F.array_intersect)
    rows = labelled.rows.select("pos", "url", "local_path")
    narrow = meets.select("pattern", F.explode(ids).alias("pos")).join(rows, "pos")
    last = labelled.parts.agg(F.floor((F.sum("size") - 1) / BLOCK).alias("last")).filter("last IS NOT NULL")  # one row
    wide = asked.filter(F.size("grams") == 0).crossJoin(F.broadcast(last)).select("pattern", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("block"))
    every = wide.join(rows.withColumn("block", F.floor(F.col("pos") / BLOCK)), "block")
    candidates = narrow.select("pattern", "url", "local_path").unionByName(every.select("pattern", "url", "local_path"))
    return candidates.filter(F.rlike("url", pattern(F.col("pattern"))))
