"""Readers: page snapshots, text files of unknown encoding, request logs, saved state."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators.accounting import known_anti


def pages(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot (page_id, url, html)."""
    return spark.read.parquet(path)


def decoded(content: Column) -> Column:
    """UTF-8 where it is valid, else ISO-8859-1, which decodes any bytes."""
    return F.when(F.is_valid_utf8(content), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def text_files(spark: SparkSession, root: str, pattern: str = "*.{html,htm,css}") -> DataFrame:
    """(path, text) of all files below ``root`` whose name matches."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.select("path", decoded(F.col("content")).alias("text"))


def fetch_from_snapshot(wanted: DataFrame, snapshot: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Results of fetching URLs from a snapshot: a left join on canonical URLs, minus what is done already.

    (url, success, content, file_size, error)
    """
    todo = known_anti(wanted, done) if done is not None else wanted.select("url").distinct()
    have = snapshot.select(urls.canonical(F.col("url")).alias("key"), F.col("html").alias("content")).groupBy("key").agg(F.min("content").alias("content"))
    joined = todo.withColumn("key", urls.canonical(F.col("url"))).join(have, "key", "left")
    return joined.select("url", F.col("content").isNotNull().alias("success"), "content", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("file_size"), F.when(F.col("content").isNull(), "HTTP 404").alias("error"))


def events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_state(spark: SparkSession, path: str, target_url: str) -> dict[str, DataFrame] | None:
    """The tables of ``sinks.save_state``, or None if there are none or they are of another target."""
    try:
        manifest = spark.read.text(f"{path}/manifest").first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    facts = json.loads(manifest["value"])
    if facts["target_url"] != target_url:
        return None
    return {name: spark.read.parquet(f"{path}/{name}") for name in facts["tables"]}
