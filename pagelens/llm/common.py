"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: The folder of a local session that names none.
_LOCAL_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, this process makes one temporary folder on a local
    master (tests); a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: this operator needs a folder that all executors share")
        if not _LOCAL_DIR:
            _LOCAL_DIR.append("file://" + tempfile.mkdtemp(prefix="pagelens-shared-"))
        root = _LOCAL_DIR[0]
    return root.rstrip("/")


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores behind it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/pagelens/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_quietly, spark, path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        if spark._jsc.sc().isStopped():
            return
        remove_path(spark, path)
    except Exception:  # the JVM may be gone at exit; the folder is scratch space
        pass


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._pagelens_path = path
    return out


def drop_materialized(df: DataFrame) -> None:
    """Remove a table of ``materialize`` that no later plan reads."""
    if path := getattr(df, "_pagelens_path", None):
        remove_path(df.sparkSession, path)


def held_out(doc_id: str, modulus: int) -> Column:
    """True where crc32(doc_id as text) mod ``modulus`` is 2; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == 2, F.lit(False))


def table_parts(df: DataFrame, least: int = 1) -> int:
    """The session's number of shuffle partitions, ``least`` at least."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def raw_column(batch: pa.RecordBatch, k: int) -> list[bytes]:
    """The UTF-8 bytes of a text column; nulls are empty."""
    return pc.fill_null(batch.column(k).cast(pa.binary()), b"").to_pylist()


def batches_by_size(batches, name: str = "text", chars: int = 1_000_000):
    """Record batches cut so that each holds about ``chars`` bytes of the text column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(name))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        part = np.cumsum(sizes) // chars
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)


_KEPT: dict = {}


def kept(key, make):
    """An object that this worker process keeps from task to task.

    Only the last one asked for stays, so the memory of stages that share
    workers does not add up.
    """
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


#: 64-bit odd mixing constants.
MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xBF58476D1CE4E5B9)
MIX_C = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, vectorised."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX_B
        x = (x ^ (x >> np.uint64(27))) * MIX_C
        return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of byte words through a bounded cache."""

    def __init__(self, most: int = 400_000):
        from xxhash import xxh3_64_intdigest

        self.digest, self.most, self.known = xxh3_64_intdigest, most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        out = np.fromiter(map(known.get, words, repeat(0)), np.uint64, len(words))
        for k in np.flatnonzero(out == 0).tolist():
            w = words[k]
            out[k] = h = known.get(w) or self.digest(w)
            known[w] = h
        return out


_LETTERS_DIGITS = re.compile(r"[^\W_]+")


def plain_words(text: str) -> list[bytes]:
    """Lower-case runs of letters and digits, as bytes."""
    return [w.encode() for w in _LETTERS_DIGITS.findall(text.lower())]
