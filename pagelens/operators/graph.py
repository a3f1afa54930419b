"""Bounded closures and cycles of link and import graphs.

Closures keep a frontier and a visited table; each round is one join and one
anti-join, stored with checkpoint() so that lineage stays short and lost
executors are survived.  Edges are stored once, bucketed and sorted by source,
so that a round shuffles the frontier and never the edges.

Cycles are found by labels that travel along edges and jump along labels, so
that the number of rounds grows with the logarithm of a path, not its length.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.sinks import clear_state, scratch


@dataclass(frozen=True)
class Caps:
    """Limits of a style-sheet closure."""

    rounds: int = 10
    files: int = 500
    depth: int = 8
    imports: int = 2000
    imports_per_file: int = 50
    file_bytes: int = 10 * 1024**2


def _ready(spark: SparkSession) -> None:
    """A checkpoint folder: the cluster's, or on a local master (tests) one of our own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: closures need a folder that all executors share")
        sc.setCheckpointDir(where or "file://" + tempfile.mkdtemp(prefix="pagelens-graph-"))


@contextmanager
def by_source(edges: DataFrame):
    """``edges`` as a table bucketed and sorted by ``src``, for the time of a block: joins on ``src`` do not shuffle it."""
    spark = edges.sparkSession
    _ready(spark)
    name = f"pagelens_edges_{uuid.uuid4().hex}"
    where = spark.sparkContext._jsc.sc().getCheckpointDir().get() + f"/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One task per bucket writes, so a bucket is one file.
    edges.repartition(buckets, "src").write.format("parquet").option("path", where).bucketBy(buckets, "src").sortBy("src").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back; unlike a checkpoint, what the optimizer inferred of it does not pile up over rounds."""
    path = scratch(df.sparkSession, "labels")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _dropped(df: DataFrame) -> None:
    """Remove a stored table that no later plan reads."""
    clear_state(df.sparkSession, df._stored_at)


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int = 8) -> DataFrame:
    """(node, depth): every node within ``max_depth`` steps of a seed, with its least depth."""
    _ready(edges.sparkSession)
    visited = seeds.select(F.col("node"), F.lit(0).alias("depth")).distinct().checkpoint()
    frontier = visited
    with by_source(edges.select("src", "dst").distinct()) as stored:
        for depth in range(1, max_depth + 1):
            found = frontier.join(stored, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
            frontier = found.join(visited, "node", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
            if frontier.isEmpty():
                break
            visited = visited.unionByName(frontier).checkpoint()
    return visited


def _greatest_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, f, b): the greatest node (by string) that reaches each node, and the greatest that it reaches, itself included.

    A label travels along an edge, and a node takes its label's label: on a
    path, what a label has covered doubles from round to round.
    """
    labels = _stored(nodes.select("node", F.col("node").alias("f"), F.col("node").alias("b")))
    old = labels
    link = lambda of, to, ahead: [F.col(of).alias("of"), F.col(to).alias("to"), F.lit(ahead).alias("ahead")]
    both = _stored(edges.select(*link("src", "dst", True)).union(edges.select(*link("dst", "src", False))))
    while True:
        # Whose label a node hears: its neighbours', and its own label's.
        heard = both.union(labels.filter("f <> node").select(*link("f", "node", True))).union(labels.filter("b <> node").select(*link("b", "node", False)))
        heard = heard.join(labels, F.col("of") == F.col("node")).groupBy(F.col("to").alias("node")).agg(F.max(F.when(F.col("ahead"), F.col("f"))).alias("nf"), F.max(F.when(~F.col("ahead"), F.col("b"))).alias("nb"))
        moved = F.coalesce(F.col("nf") > F.col("f"), F.lit(False)) | F.coalesce(F.col("nb") > F.col("b"), F.lit(False))
        # greatest() skips nulls.
        new = _stored(labels.join(heard, "node", "left").select("node", F.greatest("f", "nf").alias("f"), F.greatest("b", "nb").alias("b"), moved.alias("moved")))
        _dropped(old)
        old, labels = new, new.drop("moved")
        if new.filter("moved").isEmpty():
            _dropped(both)
            return labels


def strong_components(edges: DataFrame, trims: int = 2) -> DataFrame:
    """(node, component, size): the strongly connected component of every node, named by its least node.

    Nodes without predecessors or successors are trimmed: they are components
    of their own.  What is left is searched forward and backward from all
    nodes at once: in each round a node learns the greatest node (in random
    order) that reaches it and the greatest that it reaches.  Where the two are
    the same, that is the node's component; two nodes of one component always
    agree in both, so edges between nodes that do not are dropped before the
    next round.  Null nodes are not read; loops and repeated edges change nothing.
    """
    _ready(edges.sparkSession)
    sound = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL")
    # The names that order nodes at random: their hash, then themselves.
    name = lambda c: F.concat(F.lpad(F.hex(F.xxhash64(c)), 16, "0"), F.col(c))
    named = _stored(sound.select(name("src").alias("src"), name("dst").alias("dst")).distinct())
    nodes = _stored(named.select(F.col("src").alias("node")).union(named.select(F.col("dst").alias("node"))).distinct())
    left, found = named.filter("src <> dst"), None
    while True:
        for _ in range(trims):
            left = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            left = left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        left = _stored(left)
        if left.isEmpty():
            break
        labels = _greatest_labels(left.select(F.col("src").alias("node")).union(left.select(F.col("dst").alias("node"))).distinct(), left)
        done = _stored(labels.filter("f = b").select("node", F.col("f").alias("root")))
        found = done if found is None else found.union(done)
        rest = labels.filter("f <> b")
        same = [F.col("f1") == F.col("f2"), F.col("b1") == F.col("b2")]
        ends = [rest.select(F.col("node").alias(e), F.col("f").alias(f"f{k}"), F.col("b").alias(f"b{k}")) for k, e in ((1, "src"), (2, "dst"))]
        left = left.join(ends[0], "src").join(ends[1], "dst").filter(same[0] & same[1]).select("src", "dst")
    rooted = nodes.withColumn("root", F.col("node")) if found is None else nodes.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    plain = rooted.select(F.expr("substring(node, 17)").alias("node"), "root")
    sizes = plain.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("size"))
    return plain.join(sizes, "root").select("node", "component", "size")


def on_cycles(edges: DataFrame) -> DataFrame:
    """(node, reaches_cycle) of every node: whether it lies on a cycle or leads to one."""
    _ready(edges.sparkSession)
    edges = _stored(edges.select("src", "dst"))  # read three times
    parts = strong_components(edges)
    loops = edges.filter("src = dst").select(F.col("src").alias("node")).distinct().withColumn("loop", F.lit(True))
    # Cyclic nodes get the greatest names, so one backward search tells who reaches any of them.
    mark = _stored(parts.join(loops, "node", "left").select("node", F.concat(F.when((F.col("size") > 1) | F.coalesce("loop", F.lit(False)), "1").otherwise("0"), F.lpad(F.hex(F.xxhash64("node")), 16, "0"), F.col("node")).alias("name")))
    pairs = edges.join(mark.select(F.col("node").alias("src"), F.col("name").alias("s")), "src").join(mark.select(F.col("node").alias("dst"), F.col("name").alias("d")), "dst")
    labels = _greatest_labels(mark.select(F.col("name").alias("node")), pairs.select(F.col("s").alias("src"), F.col("d").alias("dst")).filter("src <> dst").distinct())
    return labels.select(F.expr("substring(node, 18)").alias("node"), F.col("b").startswith("1").alias("reaches_cycle"))


def capped_imports(imports: DataFrame, caps: Caps = Caps()) -> DataFrame:
    """Imports of files of bounded size, the first of each file by URL."""
    rows = imports.filter(F.coalesce(F.col("src_bytes") <= caps.file_bytes, F.lit(True))) if "src_bytes" in imports.columns else imports
    rows = rows.select("src", "dst").distinct()
    each = rows.withColumn("k", F.row_number().over(W.partitionBy("src").orderBy("dst"))).filter(F.col("k") <= caps.imports_per_file)
    return each.select("src", "dst")


def css_closure(imports: DataFrame, seeds: DataFrame, caps: Caps = Caps()) -> DataFrame:
    """The style sheets that seeds import, directly or not, with their least depths.

    Seeds are (node) or (target, node); the caps on files and imports hold for
    each target, without targets for each seed.  Files count by depth, then
    URL.  The imports of reached files are added up in that order; the file
    that passes the cap, and those after it, are reached but not followed.
    """
    _ready(imports.sparkSession)
    named = "target" in seeds.columns
    with by_source(capped_imports(imports, caps).filter("dst IS NOT NULL")) as edges:
        visited = _css_rounds(edges, seeds, caps, named)
    reached = visited if named else visited.groupBy("node").agg(F.min("depth").alias("depth"))
    return reached.orderBy(*(["target"] if named else []), "depth", "node")


def _css_rounds(edges: DataFrame, seeds: DataFrame, caps: Caps, named: bool) -> DataFrame:
    sizes = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k"))
    by_url = W.partitionBy("target").orderBy("node")
    first = seeds.select(F.col("target" if named else "node").alias("target"), "node").distinct()
    frontier = first.withColumn("n", F.row_number().over(by_url)).filter(F.col("n") <= caps.files).select("target", "node", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("spent")).checkpoint()
    visited = frontier.select("target", "node", "depth")
    for depth in range(1, min(caps.rounds, caps.depth) + 1):
        running = F.col("spent") + F.sum(F.coalesce("k", F.lit(0))).over(by_url.rowsBetween(W.unboundedPreceding, 0))
        counted = frontier.join(sizes, "node", "left").withColumn("total", running).select("target", "node", "total").checkpoint()
        spent = counted.groupBy("target").agg(F.max("total").alias("spent"))
        found = counted.filter(F.col("total") <= caps.imports).join(edges, F.col("node") == F.col("src")).select("target", F.col("dst").alias("node")).distinct()
        new = found.join(visited, ["target", "node"], "left_anti").withColumn("n", F.row_number().over(by_url))
        files = visited.groupBy("target").agg(F.count("*").alias("files"))
        frontier = new.join(files, "target").filter(F.col("files") + F.col("n") <= caps.files).join(spent, "target").select("target", "node", F.lit(depth).alias("depth"), "spent").checkpoint()
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier.select("target", "node", "depth")).checkpoint()
    return visited


def closure_summary(reached: DataFrame, imports: DataFrame) -> DataFrame:
    """One row: greatest depth, files, imports among them."""
    used = imports.join(reached.select(F.col("node").alias("src")), "src", "left_semi")
    return reached.agg(F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("max_depth"), F.count("*").alias("files")).crossJoin(used.agg(F.count("*").alias("imports")))
