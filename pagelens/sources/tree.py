"""A site as a tree of files: a data source whose tasks stage and whose commit decides, and a job that publishes.

``files.write.format("site_tree").mode("append").save(root)`` writes rows
(local_path string, content binary) into ``<root>.jobs/<job>/<attempt>``: each
attempt of a task has a folder with all its bytes in one file and a list of
what lies where, so small files exist only once, at their places.  The commit names the attempts that count and
removes all others; an abort marks the job and removes it, and a task that
still ran removes its own folder when it sees the mark (one that was killed
after that leaves its folder to the next ``publish``).  So nothing of a failed
or killed task reaches the site.  ``publish`` writes the files of committed jobs to their places below
``root`` as a Spark job over the lists; it may be run again after any failure.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import time
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

LISTED = "attempt string, row long, local_path string, place string, start long, bytes long, sha256 string"
#: Bytes of a staged file that one task writes to their places.
STRETCH = 1 << 24
PUBLISHED = "local_path string, written boolean, bytes long, sha256 string"
LIST = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in LISTED.split(", "))])


def place_of(path: str | None) -> str | None:
    """The normal form of a relative path, or None if it is empty, leaves the root or holds NUL."""
    norm = posixpath.normpath(path) if path else ".."
    return None if norm == "." or "\0" in norm or norm.startswith("/") or norm.split("/")[0] == ".." else norm


def _where(uri: str):
    from pyarrow import fs

    where, base = fs.FileSystem.from_uri(uri)
    return where, base.rstrip("/")


def _write_whole(uri: str, text: str) -> None:
    where, path = _where(uri)
    where.create_dir(posixpath.dirname(path), recursive=True)
    with where.open_output_stream(path + ".part") as out:
        out.write(text.encode())
    where.move(path + ".part", path)


def _there(uri: str) -> bool:
    from pyarrow import fs

    where, path = _where(uri)
    return where.get_file_info(path).type != fs.FileType.NotFound


def _remove(uri: str, tries: int = 5) -> None:
    where, path = _where(uri)
    for k in range(tries):
        try:
            return where.delete_dir(path)
        except FileNotFoundError:
            return None
        except OSError:  # a task was still writing into it
            if k == tries - 1:
                raise
            time.sleep(0.2)


def _names(uri: str) -> list[str]:
    from pyarrow import fs

    where, path = _where(uri)
    return sorted(f.base_name for f in where.get_file_info(fs.FileSelector(path, allow_not_found=True)))


class Staged(WriterCommitMessage):
    """What the driver learns of a task: the folder's name, whatever the number of files."""

    def __init__(self, attempt: str):
        self.attempt = attempt


class TreeWriter(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.jobs = root.rstrip("/") + ".jobs"
        self.job = f"{time.time_ns():020d}-{uuid.uuid4().hex}"

    def write(self, iterator):
        from pyarrow import parquet

        task = TaskContext.get()
        attempt = f"{task.partitionId()}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        where, folder = _where(f"{self.jobs}/{self.job}/{attempt}")
        where.create_dir(folder, recursive=True)
        try:
            with where.open_output_stream(f"{folder}/data") as out, where.open_output_stream(f"{folder}/list.parquet") as sink, parquet.ParquetWriter(sink, LIST) as listed:
                row = end = 0
                for batch in iterator:
                    rows = []
                    for path, content in zip(batch.column("local_path"), batch.column("content")):
                        place, start, data = place_of(path.as_py()), None, content.as_py()
                        if place is not None and data is not None:
                            data = data.encode() if isinstance(data, str) else data
                            out.write(data)
                            start, end = end, end + len(data)
                        kept, row = start is not None, row + 1
                        rows.append((attempt, row, path.as_py(), place, start, len(data) if kept else 0, hashlib.sha256(data).hexdigest() if kept else None))
                    listed.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), LIST)] if rows else [pa.array([], f.type) for f in LIST], schema=LIST))
            if _there(f"{self.jobs}/aborted/{self.job}"):
                raise RuntimeError(f"job {self.job} was aborted")
        except BaseException:
            _remove(f"{self.jobs}/{self.job}/{attempt}")
            raise
        return Staged(attempt)

    def commit(self, messages):
        kept = {m.attempt for m in messages if m is not None}
        for name in _names(f"{self.jobs}/{self.job}"):
            if name not in kept:
                _remove(f"{self.jobs}/{self.job}/{name}")
        _write_whole(f"{self.jobs}/committed/{self.job}.json", "".join(json.dumps({"attempt": a}) + "\n" for a in sorted(kept)))

    def abort(self, messages):
        _write_whole(f"{self.jobs}/aborted/{self.job}", "")
        _remove(f"{self.jobs}/{self.job}")


class Part(InputPartition):
    def __init__(self, file: str):
        self.file = file


class TreeReader(DataSourceReader):
    """Reads what one job published, a part for each file of its list."""

    def __init__(self, root: str, job: str | None):
        self.root, self.job = root.rstrip("/"), job

    def partitions(self):
        jobs = [self.job] if self.job else _names(self.root + ".jobs/published")
        if len(jobs) > 1:
            raise ValueError("several jobs are published below this root: name one by the option job")
        return [Part(f"{self.root}.jobs/published/{j}/{f}") for j in jobs for f in _names(f"{self.root}.jobs/published/{j}") if f.endswith(".parquet")] or [Part("")]

    def read(self, partition):
        from pyarrow import parquet

        if not partition.file:
            return
        where, path = _where(partition.file)
        base = _where(self.root)[1]
        with where.open_input_file(path) as source:
            for batch in parquet.ParquetFile(source).iter_batches(256, columns=["local_path", "written", "sha256"]):
                for row in batch.to_pylist():
                    if row["written"]:
                        with where.open_input_stream(f"{base}/{place_of(row['local_path'])}") as file:
                            data = file.read()
                        yield (row["local_path"], data, hashlib.sha256(data).hexdigest() == row["sha256"])


class SiteTree(DataSource):
    """Format ``site_tree``: (local_path, content) out, (local_path, content, intact) in; ``intact`` compares with the digest of the list."""

    @classmethod
    def name(cls):
        return "site_tree"

    def schema(self):
        return "local_path string, content binary, intact boolean"

    def reader(self, schema):
        return TreeReader(self.options["path"], self.options.get("job"))

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("site_tree only appends: a published path replaces the file that was there")
        return TreeWriter(self.options["path"])


def _placed(root: str, job: str):
    def run(batches):
        from pyarrow.fs import FileType

        where, base = _where(root)
        folder = _where(f"{root}.jobs/{job}")[1]
        opened, source = None, None
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                if r["written"]:
                    if r["attempt"] != opened:
                        if source is not None:
                            source.close()
                        opened, source = r["attempt"], where.open_input_file(f"{folder}/{r['attempt']}/data")
                    source.seek(r["start"])
                    steps = [posixpath.join(base, *r["place"].split("/")[: k + 1]) for k in range(r["place"].count("/") + 1)]
                    kinds = [i.type for i in where.get_file_info(steps)]
                    # A folder of an earlier job stands where this file belongs, or a file where its folder does.
                    r["written"] = kinds[-1] != FileType.Directory and FileType.File not in kinds[:-1]
                    if r["written"]:
                        where.create_dir(posixpath.dirname(steps[-1]), recursive=True)
                        with where.open_output_stream(steps[-1] + ".part") as out:
                            out.write(source.read(r["bytes"]))
                        where.move(steps[-1] + ".part", steps[-1])
                if not r["written"]:
                    r["bytes"], r["sha256"] = 0, None
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in ("local_path", "written", "bytes", "sha256")} for r in rows], pa.schema([("local_path", pa.string()), ("written", pa.bool_()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    return run


def publish(spark: SparkSession, root: str) -> list[str]:
    """Writes the files of committed jobs to their places, oldest job first; returns the published jobs.

    Of rows with one place the one with the smallest digest and path is
    written, so the result doesn't depend on tasks; a file whose place is the
    folder of another is not written.  Every row keeps a line in the job's
    list.  What a job staged stays until all is written, so an interrupted
    ``publish`` is finished by the next.
    """
    root = root.rstrip("/")
    done = []
    for job in _names(f"{root}.jobs/aborted"):  # the marks stay: such a task may still run
        _remove(f"{root}.jobs/{job}")
    for name in _names(f"{root}.jobs/committed"):
        job = name.removesuffix(".json")
        if not name.endswith(".json"):
            continue
        out = f"{root}.jobs/published/{job}"
        if "_SUCCESS" not in _names(out):
            counted = spark.read.schema("attempt string").json(f"{root}.jobs/committed/{name}")
            stage = f"{root}.jobs/{job}"
            if any(_names(stage)):
                listed = spark.read.schema(LISTED).parquet(f"{stage}/*/list.parquet").join(counted, "attempt", "left_semi")
            else:
                listed = spark.createDataFrame([], LISTED)
            best = listed.filter("start IS NOT NULL").groupBy("place").agg(F.min_by(F.struct("attempt", "row"), F.struct("sha256", "local_path", "attempt", "row")).alias("best"))
            parts = F.split("place", "/")
            above = best.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("up"), "place").filter("up <> place").select(F.col("up").alias("place")).distinct()
            winners = best.join(above, "place", "left_anti").select("best.*", F.lit(True).alias("won"))
            rows = listed.join(winners, ["attempt", "row"], "left").withColumn("written", F.coalesce("won", F.lit(False))).drop("won")
            # A task writes whole stretches of a staged file, in its order.
            stretch = F.coalesce(F.floor(F.col("start") / STRETCH), F.pmod(F.xxhash64("local_path"), F.lit(64)))
            rows = rows.repartition("attempt", stretch).sortWithinPartitions("attempt", "start")
            rows.mapInArrow(_placed(root, job), PUBLISHED).write.mode("overwrite").parquet(out)
        _remove(f"{root}.jobs/{job}")
        where, path = _where(f"{root}.jobs/committed/{name}")
        where.delete_file(path)
        done.append(job)
    return done


def published(spark: SparkSession, root: str, jobs: list[str] | None = None) -> DataFrame:
    """(local_path, written, bytes, sha256, job): the lists of all published jobs, or of some."""
    names = _names(f"{root.rstrip('/')}.jobs/published") if jobs is None else jobs
    out = spark.createDataFrame([], PUBLISHED + ", job string")
    for job in names:
        out = out.unionByName(spark.read.schema(PUBLISHED).parquet(f"{root.rstrip('/')}.jobs/published/{job}").withColumn("job", F.lit(job)))
    return out


def write_tree(files: DataFrame, root: str) -> DataFrame:
    """Writes and publishes (local_path, content string or binary); returns (local_path, written, bytes, sha256), one row for each row."""
    spark = files.sparkSession
    spark.dataSource.register(SiteTree)
    files.select("local_path", F.col("content").cast("binary").alias("content")).write.format("site_tree").mode("append").save(root)
    return published(spark, root, publish(spark, root)[-1:]).drop("job")


def read_tree(spark: SparkSession, root: str, job: str | None = None) -> DataFrame:
    """(local_path, content, intact) of a published job; its name may be left out where there is one only. Not intact: a later job replaced the file."""
    spark.dataSource.register(SiteTree)
    reader = spark.read.format("site_tree")
    return (reader.option("job", job) if job else reader).load(root)
