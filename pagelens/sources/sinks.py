"""Sinks: sites as files or tables, metadata and state, index page, event logs."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import is_safe_path
from . import tree


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir (on a local master one of our own); removed when Python ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: files need a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pagelens-files-")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def remove():
        try:
            clear_state(spark, path)
        except Exception:  # the JVM may have ended first; it is scratch space
            pass

    atexit.register(remove)
    return path


def site_table(files: DataFrame, path: str) -> None:
    """(local_path, content) as Parquet: the scalable form of a site."""
    files.filter(is_safe_path(F.col("local_path")) & ~F.col("local_path").startswith("/")).write.mode("overwrite").parquet(path)


def site_tree(files: DataFrame, root: str) -> DataFrame:
    """Write each row (local_path string, content string or binary) to its own file below ``root`` (a URI all executors reach).

    Returns (local_path, written, bytes); a path that leaves the root is not written. See ``tree`` for repeated paths and failures.
    """
    return tree.write_tree(files, root).drop("sha256")


def with_index(files: DataFrame, main_path: str) -> DataFrame:
    """Adds index.html as a copy of the main page if the site has none."""
    index = files.filter(F.col("local_path") == main_path).limit(1).withColumn("local_path", F.lit("index.html"))
    return files.unionByName(index.join(files.select("local_path"), "local_path", "left_anti").select(*files.columns))


def json_row(df: DataFrame, path: str) -> None:
    """A table of one row (statistics, run information) as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def json_mapping(mapping: DataFrame, path: str) -> None:
    mapping.select("url", "relative_url").write.mode("overwrite").json(path)


def event_log(events: DataFrame, path: str) -> None:
    """One line per event, appended."""
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "event_type", F.to_json(F.struct(*[c for c in events.columns if c not in ("ts", "event_type")])))
    events.select(line.alias("value")).write.mode("append").text(path)


def save_state(spark: SparkSession, path: str, target_url: str, **tables: DataFrame) -> None:
    """Tables first, the manifest last: a run that dies in between leaves no state that looks whole."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    facts = json.dumps({"target_url": target_url, "tables": sorted(tables)})
    spark.createDataFrame([(facts,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def clear_state(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def admissible(metrics: DataFrame, per_file_bytes: int = 1024**2) -> DataFrame:
    """Adds ``enough_space`` (files, free_bytes) with a margin of a fifth, and ``fits_memory`` (largest_file, free_memory)."""
    out = metrics.withColumn("enough_space", F.col("free_bytes") > 1.2 * per_file_bytes * F.col("files"))
    return out.withColumn("fits_memory", (F.col("largest_file") <= 100 * 1024**2) | (F.col("largest_file") <= 0.1 * F.col("free_memory")))
