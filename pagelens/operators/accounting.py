"""Run accounting: counters, rates, event statistics, verification sets, top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.classify import is_essential
from ..sources.sinks import scratch

SIZE_TOLERANCE = 1024


def rate(size: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, size / seconds).otherwise(0.0)


def download_stats(results: DataFrame) -> DataFrame:
    """One row: files, successes, failures, bytes, elapsed seconds, bytes per second."""
    ok = F.col("success")
    t = F.col("ts").cast("timestamp").cast("double")
    totals = results.agg(F.count("*").alias("total_files"), F.count_if(ok).alias("downloaded_files"), F.count_if(~ok).alias("failed_files"), F.coalesce(F.sum(F.when(ok, F.col("file_size"))), F.lit(0)).alias("total_bytes"), F.coalesce(F.max(t) - F.min(t), F.lit(0.0)).alias("elapsed_time"))
    return totals.withColumn("download_rate", rate(F.col("total_bytes"), F.col("elapsed_time")))


def clone_info(discovered: DataFrame, results: DataFrame) -> DataFrame:
    found = discovered.agg(F.count_distinct("url").alias("total_urls_discovered"))
    return found.crossJoin(results.agg(F.count_if("success").alias("successful_downloads"), F.count_if(~F.col("success")).alias("failed_downloads")))  # one row each


def known_anti(wanted: DataFrame, *known: DataFrame) -> DataFrame:
    """URLs not yet downloaded or failed."""
    out = wanted.select("url").distinct()
    for k in known:
        out = out.join(k.select("url"), "url", "left_anti")
    return out


def known_semi(wanted: DataFrame, known: DataFrame) -> DataFrame:
    return wanted.join(known.select("url"), "url", "left_semi")


def with_validity(results: DataFrame) -> DataFrame:
    """``invalid``: null, 'empty file' or 'size mismatch' (by more than a tolerance)."""
    bad = F.abs(F.col("file_size") - F.col("expected_size")) > SIZE_TOLERANCE
    return results.withColumn("invalid", F.when(F.col("file_size") == 0, "empty file").when(bad, "size mismatch"))


def verification(discovered: DataFrame, results: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(url, issue, essential): missing results, failures, and successes whose file is absent or empty."""
    missing = discovered.select("url").distinct().join(results.select("url"), "url", "left_anti").select("url", F.lit("missing").alias("issue"), F.lit("").alias("error"))
    failed = results.filter(~F.col("success")).select("url", F.lit("failed").alias("issue"), F.coalesce("error", F.lit("")).alias("error"))
    out = missing.unionByName(failed)
    if files is not None:
        there = files.filter("size > 0").select("local_path")
        out = out.unionByName(results.filter("success").join(there, "local_path", "left_anti").select("url", F.lit("missing_file").alias("issue"), F.lit("").alias("error")))
    return out.withColumn("essential", is_essential(F.col("url"), F.col("error"))).drop("error")


def run_summary(discovered: DataFrame, results: DataFrame) -> DataFrame:
    """One row: counters with issues by kind and the verdict (no essential issue)."""
    issues = verification(discovered, results).agg(
        F.count_if(F.col("essential") & (F.col("issue") == "failed")).alias("essential_failures"),
        F.count_if(~F.col("essential") & (F.col("issue") == "failed")).alias("other_failures"),
        F.count_if(F.col("issue") == "missing").alias("missing"),
        F.coalesce(~F.bool_or("essential"), F.lit(True)).alias("ok"),
    )
    return download_stats(results).crossJoin(issues)


def event_stats(events: DataFrame) -> DataFrame:
    """One row of progress events (event_type, ts, size, phase): counters, success rate, phases in order."""
    is_ = lambda k: F.col("event_type") == k
    phases = F.transform(F.sort_array(F.collect_list(F.when(is_("phase_completed"), F.struct("ts", "phase")))), lambda s: s["phase"])
    out = events.agg(
        F.count_if(is_("download_started")).alias("downloads_started"),
        F.count_if(is_("download_completed")).alias("downloads_completed"),
        F.count_if(is_("download_failed")).alias("downloads_failed"),
        F.coalesce(F.sum(F.when(is_("download_completed"), F.coalesce("size", F.lit(0)))), F.lit(0)).alias("total_bytes"),
        F.count_if(is_("error_occurred")).alias("errors"),
        F.count_if(is_("warning_raised")).alias("warnings"),
        phases.alias("phases_completed"),
    )
    return out.withColumn("success_rate", F.col("downloads_completed") / F.greatest("downloads_started", F.lit(1)))


def completed_phases(events: DataFrame, parts: int | None = None) -> DataFrame:
    """(position, ts, phase): the phases of a log in order of time and name, counted from 0; a null time comes first.

    The table form of ``phases_completed``, for logs of any length: equal rows
    are counted first, so a frequent one is one row until the end; ranges are
    numbered by themselves and moved by the sizes of the ranges before.
    """
    spark = events.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = events.filter("event_type = 'phase_completed'").groupBy("ts", "phase").agg(F.count("*").alias("n"))
    path = scratch(spark, "phases")
    counted.repartitionByRange(n, "ts", "phase").withColumn("part", F.spark_partition_id()).write.parquet(path)
    table = spark.read.parquet(path)
    offsets = table.groupBy("part").agg(F.sum("n").alias("size"))  # as many rows as parts
    offsets = offsets.select("part", (F.sum("size").over(W.orderBy("part")) - F.col("size")).alias("offset"))
    first = F.col("offset") + F.sum("n").over(W.partitionBy("part").orderBy("ts", "phase")) - F.col("n")
    rows = table.join(F.broadcast(offsets), "part").withColumn("first", first)
    return rows.select(F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("position"), "ts", "phase")


def as_events(results: DataFrame) -> DataFrame:
    """One started and one completed or failed event per result."""
    kind = F.when(F.col("success"), "download_completed").otherwise("download_failed")
    started = results.select(F.lit("download_started").alias("event_type"), "ts", "url", F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("phase"))
    ended = results.select(kind.alias("event_type"), "ts", "url", F.col("file_size").alias("size"), "error", F.lit(None).cast("string").alias("phase"))
    return started.unionByName(ended)


def top_failures(results: DataFrame, k: int = 10) -> DataFrame:
    """The first ``k`` failures by time and URL: a bounded top list, no full sort."""
    return results.filter(~F.col("success")).orderBy("ts", "url").limit(k).select("url", "error", "ts")


def mapping_stats(mapping: DataFrame) -> DataFrame:
    """One row: mappings, distinct hosts as written, distinct files."""
    from ..functions.urls import authority

    return mapping.agg(F.count("*").alias("total_mappings"), F.count_distinct(authority(F.col("url"))).alias("unique_domains"), F.count_distinct("relative_url").alias("local_files"))


def retry_settings(attempt: Column, retries: int = 5, timeout: int = 30, delay: float = 1.0) -> Column:
    """struct(retries, timeout, delay) of a batch retry: each attempt is more patient, within limits."""
    return F.struct(F.least(F.lit(5), F.lit(retries) + attempt).alias("retries"), F.least(F.lit(60), F.lit(timeout) + 10 * attempt).alias("timeout"), (F.lit(delay) + 0.5 * attempt).alias("delay"))


def attempts(log: DataFrame, retry_delay: float = 1.0, timeout: int = 60, slice_seconds: int = 3600) -> DataFrame:
    """Adds attempt (from 1), the linear delay and the timeout of each try, and the exponential backoff before it.

    Tries are numbered within slices of time and the earlier slices' counts
    added, so a frequent URL is many groups.  Requests without a time come first.
    """
    columns = log.columns
    own = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(slice_seconds * 1_000_000)).cast("long")
    # The URL in a struct, so that null joins null.
    rows = log.select(F.struct(*columns).alias("row"), F.struct("url").alias("k"), F.coalesce(own, F.lit(-(1 << 62))).alias("slice"))
    earlier = W.partitionBy("k").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    before = rows.groupBy("k", "slice").agg(F.count("*").alias("n")).select("k", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("k", "slice").orderBy("row.ts", "row.request_id"))
    numbered = rows.withColumn("within", within).join(before, ["k", "slice"]).select("row.*", (F.col("within") + F.col("before")).cast("int").alias("attempt"))
    return numbered.withColumn("delay", retry_delay * F.col("attempt")).withColumn("timeout", F.lit(timeout) * F.col("attempt")).withColumn("backoff", F.pow(F.lit(2.0), F.col("attempt") - 1))
