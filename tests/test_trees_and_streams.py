"""Site trees under failures, and streams against plain versions."""

import hashlib
import os
import random
import subprocess
import sys
import textwrap
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagelens.operators import accounting
from pagelens.plans import stored
from pagelens.sources import sinks, tree
from pagelens.streaming import events

FILES = "local_path string, content binary"


def site(root):
    """Every file below a root, its bytes by name."""
    top = root.removeprefix("file://")
    return {os.path.relpath(os.path.join(at, n), top): open(os.path.join(at, n), "rb").read() for at, _, names in os.walk(top) for n in names}


def left(root):
    """What the jobs keep but for the published lists."""
    return sorted(n for n in site(root + ".jobs") if not n.startswith(("published/", "aborted/")))


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/site"


def test_places(spark, root):
    rows = [("a/b.txt", b"1"), ("a/b.txt", b"2"), ("./a//b.txt", b"3"), ("a", b"folder"), ("../z", b"q"), ("c/../../z", b"q"), ("/abs", b"n"), ("x\0y", b"n"), (".", b"n"), (None, b"n"), ("n", None), ("", b"e"), ("e", b""), ("e", b""), ("é/ü.html", "ß".encode()), ("..c", b"dots"), ("long", b"x" * 3_000_000)]
    expected = {"a/b.txt": min((b"1", b"2", b"3"), key=lambda b: hashlib.sha256(b).hexdigest()), "e": b"", "é/ü.html": "ß".encode(), "..c": b"dots", "long": b"x" * 3_000_000}
    for parts in (1, 4):
        at = f"{root}{parts}"
        got = tree.write_tree(spark.createDataFrame(rows, FILES).repartition(parts), at)
        assert got.count() == len(rows) and got.filter("written").count() == len(expected)
        assert site(at) == expected and left(at) == []
        back = tree.read_tree(spark, at).collect()
        assert {tree.place_of(r.local_path): r.content for r in back} == expected and all(r.intact for r in back)
    # Text content, and a later job that replaces one file.
    sinks.site_tree(spark.createDataFrame([("e", "new")], "local_path string, content string"), at)
    assert site(at)["e"] == b"new"
    jobs = sorted({r.job for r in tree.published(spark, at).collect()})
    assert len(jobs) == 2
    assert {r.local_path: r.intact for r in tree.read_tree(spark, at, jobs[0]).collect()}["e"] is False
    # A file where an earlier job has a folder, and below a file: neither is written.
    again = tree.write_tree(spark.createDataFrame([("a", b"1"), ("e/f", b"2"), ("g", b"3")], FILES), at)
    assert {r.local_path: (r.written, r.bytes) for r in again.collect()} == {"a": (False, 0), "e/f": (False, 0), "g": (True, 1)}
    assert left(at) == []


def test_no_files(spark, root):
    assert tree.write_tree(spark.createDataFrame([], FILES), root).collect() == []
    assert tree.read_tree(spark, root).collect() == [] and site(root) == {}
    with pytest.raises(Exception, match="only appends"):
        spark.createDataFrame([("a", b"")], FILES).write.format("site_tree").mode("overwrite").save(root)


def test_failed_job_reaches_nothing(spark, root):
    tree.write_tree(spark.createDataFrame([("kept", b"1")], FILES), root)

    @F.udf("binary")
    def bad(k):
        if k == 390:
            raise ValueError("planted")
        return b"y"

    with pytest.raises(Exception, match="planted"):
        tree.write_tree(spark.range(400).repartition(4).select(F.concat(F.lit("f"), "id").alias("local_path"), bad("id").alias("content")), root)
    assert site(root) == {"kept": b"1"}
    for _ in range(50):  # tasks may outlive their job by a moment
        tree.publish(spark, root)
        if not left(root):
            break
        time.sleep(0.2)
    assert left(root) == [] and site(root) == {"kept": b"1"}


def test_publish_is_finished_by_the_next(spark, root, monkeypatch):
    spark.dataSource.register(tree.SiteTree)
    files = spark.createDataFrame([(f"d{k % 3}/f{k}", str(k).encode()) for k in range(30)], FILES).repartition(3)
    files.write.format("site_tree").mode("append").save(root)
    assert site(root) == {} and left(root)
    # A publish that died after it had moved some files.
    (job,) = [n.removesuffix(".json") for n in tree._names(root + ".jobs/committed")]
    stage = f"{root}.jobs/{job}"
    listed = spark.read.schema(tree.LISTED).parquet(f"{stage}/*/list.parquet").collect()
    for r in listed[:11]:
        target = f"{root}/{r.place}".removeprefix("file://")
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(f"{stage}/{r.attempt}/data".removeprefix("file://"), "rb") as source, open(target, "wb") as out:
            source.seek(r.start)
            out.write(source.read(r.bytes))
    assert tree.publish(spark, root) == [job]
    assert site(root) == {f"d{k % 3}/f{k}": str(k).encode() for k in range(30)} and left(root) == []
    assert tree.publish(spark, root) == []


KILLED = """
import os, sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pagelens.sources import tree

class Killed(tree.TreeWriter):
    def write(self, iterator):
        def some():
            for k, batch in enumerate(iterator):
                if k == 2 and TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() == 1:
                    os.kill(os.getpid(), 9)
                yield batch
        return super().write(some())

class Source(tree.SiteTree):
    def writer(self, schema, overwrite):
        return Killed(self.options["path"])

tree.SiteTree = Source
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.execution.arrow.maxRecordsPerBatch", "10").getOrCreate()
files = spark.range(0, 200, 1, 2).selectExpr("concat('f', id) AS local_path", "cast(cast(id AS string) AS binary) AS content")
print("ROWS", tree.write_tree(files, sys.argv[1]).filter("written").count())
"""


def test_killed_task_leaves_no_file(root):
    """A worker killed in the middle of its files: the second attempt's count, and the first one's are gone."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(KILLED), root], cwd=here, env=os.environ | {"PYTHONPATH": here}, capture_output=True, text=True, timeout=180)
    assert "ROWS 200" in out.stdout, out.stderr[-2000:]
    assert "exited unexpectedly" in out.stderr or "crashed" in out.stderr
    assert site(root) == {f"f{k}": str(k).encode() for k in range(200)} and left(root) == []


T0 = datetime(2024, 3, 1)


def batches(spark, tmp_path, name, rows, schema, form, key="ts"):
    """Runs a stream over batches of rows, one file each, each batch from the checkpoint of the one before; returns all that it gave."""
    where, out, state = (str(tmp_path / f"{name}-{k}") for k in ("in", "out", "state"))
    before = {k: spark.conf.get(k) for k in stored.STATE}
    for k, v in stored.STATE.items():
        spark.conf.set(k, v)
    try:
        for batch in rows:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(where)
            result = form(spark.readStream.schema(schema).parquet(where))
            result.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(result.schema).parquet(out).collect()


def test_verdict_stream(spark, tmp_path):
    """Several batches with a hot host, ties, repeated and null rows, against a plain loop; a verdict beyond the watermark is late."""
    r = random.Random(4)
    rows = [(k, r.choice(["h", "h", "h", "i", None]), T0 + timedelta(seconds=r.randrange(1800)), r.choice([None, None, True, False])) for k in range(240)]
    rows += [(500, "h", T0, True), (501, "h", T0, False), (502, "h", T0 + timedelta(seconds=300), None), (503, "h", T0 + timedelta(seconds=299, microseconds=999999), None), (504, "h", None, None)]
    rows += rows[:5]
    rows.sort(key=lambda x: x[2] or T0)
    end = [(-1, "h", datetime(2030, 1, 1), None), (-2, "h", datetime(2030, 1, 1), True)]
    late = [(900, "h", T0, False)]

    def form(log):
        return events.verdict_stream(log.filter("allowed IS NULL").select("request_id", "hostname", "ts"), log.filter("allowed IS NOT NULL").select("hostname", F.col("ts").alias("checked_at"), F.col("request_id").alias("verdict_id"), "allowed"))

    third = len(rows) // 3
    got = batches(spark, tmp_path, "verdicts", [rows[:third], rows[third : 2 * third], rows[2 * third :], end, late], "request_id long, hostname string, ts timestamp, allowed boolean", form)
    expected = set()
    for q, host, ts, allowed in rows:
        if allowed is None and ts is not None:
            known = [(t, v, a) for v, h, t, a in rows if a is not None and h is not None and h == host and t <= ts and ts - t < timedelta(seconds=300)]
            expected.add((q, host, ts, max(known)[2] if known else None))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_phase_stream(spark, tmp_path):
    """Phases over several batches and slices against the batch form; equal rows, null names and times, a slice that waits for its timer."""
    r = random.Random(8)
    log = [(r.choice(["phase_completed", "phase_completed", "warning_raised"]), T0 + timedelta(seconds=60 * r.randrange(240)), r.choice(["a", "b", "ü", "", None])) for _ in range(300)] + [("phase_completed", T0, "hot")] * 50 + [("phase_completed", None, "none")]
    log.sort(key=lambda x: x[1] or T0)
    schema = "event_type string, ts timestamp, phase string"
    parts = [log[:100], log[100:220], log[220:]]
    end = [("phase_completed", datetime(2030, 1, 1), "end")]
    got = batches(spark, tmp_path, "phases", [*parts, end], schema, events.phase_stream)
    assert all(x.slice <= x.ts < x.slice + timedelta(hours=1) for x in got)
    ordered = sorted(got, key=lambda x: (x.slice, x.position))
    batch = accounting.completed_phases(spark.createDataFrame(log, schema).filter("ts IS NOT NULL")).orderBy("position").collect()
    assert [(x.ts, x.phase) for x in ordered] == [(x.ts, x.phase) for x in batch]
    for s in {x.slice for x in got}:
        assert sorted(x.position for x in got if x.slice == s) == list(range(sum(x.slice == s for x in got)))
    # Without the closing row the last slices are still open.
    some = batches(spark, tmp_path, "open", parts, schema, events.phase_stream)
    assert 0 < len(some) < len(got)
