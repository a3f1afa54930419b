"""URL records as a table: insert, get, update, delete, find, count.

Every operation takes the table and returns the new one; ``save`` writes it
partitioned by status, so status look-ups read one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls

STATUSES = ("pending", "downloading", "completed", "failed")
SCHEMA = "url string, local_path string, status string, metadata map<string,string>, created_at timestamp, updated_at timestamp, attempts int, last_error string"
#: Columns that an update may set.
UPDATABLE = ("local_path", "status", "metadata", "attempts", "last_error")


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def add(table: DataFrame, new: DataFrame, now: Column | None = None, key: str = "url") -> DataFrame:
    """Insert the URLs that are not there yet (one, arbitrary, of repeated ones); others stay as they are.

    ``key``: what a record is one of; with ``local_path``, a URL that several files have is as many records.
    """
    now = F.current_timestamp() if now is None else now
    column = lambda c, otherwise: F.col(c) if c in new.columns else otherwise
    rows = new.dropDuplicates([key]).join(table.select(key), key, "left_anti")
    rows = rows.select(
        "url",
        column("local_path", F.lit(None).cast("string")).alias("local_path"),
        F.lit("pending").alias("status"),
        F.coalesce(column("metadata", F.lit(None)).cast("map<string,string>"), F.create_map().cast("map<string,string>")).alias("metadata"),
        now.cast("timestamp").alias("created_at"),
        now.cast("timestamp").alias("updated_at"),
        F.lit(0).alias("attempts"),
        F.lit(None).cast("string").alias("last_error"),
    )
    return table.unionByName(rows)


def get(table: DataFrame, url: str) -> DataFrame:
    return table.filter(F.col("url") == url)


def update(table: DataFrame, changes: DataFrame, now: Column | None = None, key: str = "url") -> DataFrame:
    """Set the columns of ``changes`` (the key and some of UPDATABLE, null: unchanged) and the time of update.

    Of several changes of a key the greatest ``seq`` counts where there is
    such a column, else the greatest row; a key stays one record.
    """
    now = F.current_timestamp() if now is None else now
    set_ = [c for c in changes.columns if c in UPDATABLE and c != key]
    if not set_:
        return table
    order = [F.col("seq")] if "seq" in changes.columns else []
    comparable = [F.to_json(c) if dict(changes.dtypes)[c].startswith("map") else F.col(c) for c in set_]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*set_), F.struct(*order, *comparable)).alias("last"))
    renamed = last.select(key, F.lit(True).alias("_hit"), *[F.col(f"last.{c}").alias(f"_new_{c}") for c in set_])
    joined = table.join(renamed, key, "left")
    out = []
    for c in table.columns:
        if c in set_:
            out.append(F.coalesce(f"_new_{c}", c).alias(c))
        elif c == "updated_at":
            out.append(F.when(F.col("_hit"), now.cast("timestamp")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def upsert_latest(versions: DataFrame, key: str = "url", order: str = "version") -> DataFrame:
    """The last version of each key; of several with one number the greatest row."""
    rest = [c for c in versions.columns if c not in (key, order)]
    comparable = [F.to_json(c) if dict(versions.dtypes)[c].startswith("map") else F.col(c) for c in rest]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, *comparable)).alias("r")).select(key, "r.*")


def delete(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select("url"), "url", "left_anti")


def find_by_status(table: DataFrame, status: str) -> DataFrame:
    return table.filter(F.col("status") == status)


def find_by_domain(table: DataFrame, domain: str) -> DataFrame:
    return table.filter(urls.domain(F.col("url")) == domain.lower())


def count(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("n"))


def clear(table: DataFrame) -> DataFrame:
    return table.limit(0)


def statistics(table: DataFrame) -> DataFrame:
    """One row: the number of records, and of each status."""
    return table.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def save(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").partitionBy("status").parquet(path)


def load(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)
