"""Operator 13: the prefix trie of conversations, built as a Patricia trie.

1. Sort.  Turns are sorted by conversation and turn over all tasks, and a
   running sum over the sorted rows (``running``) numbers them; a second one
   over the rebuilt turns gives every prefix its digest (two 64-bit sums of
   hashes of position and turn, so that a prefix is a running sum) and its
   bytes.  Sorting the prefixes by digest tells, for each conversation, at
   which depth it leaves all conversations with smaller ids: it owns the nodes
   from there to its end, one chain of which it is the smallest member.
2. Points.  Only these nodes are created: the ends of conversations (leaves
   among them) and the nodes where a chain branches off, with compressed edges
   between the points of a chain.
3. Aggregates on the compressed trie: a point's subtree is the rest of its own
   chain and the whole chains of its other members.
4. Expansion.  The nodes on an edge have the counts of the point below, and
   its saved tokens plus those of the edge from there on: a difference of
   running sums of bytes.

Turns count by null-first ``turn``; equal turns of a conversation are ordered
by the digest of role and text.  Null roles and texts are empty.  Rows without
a conversation id belong to none and are not read.  Repeated rows are turns of
their own.  An empty table gives no rows.  Other columns are not read.

A conversation or a node may hold a third of all rows: running sums cross the
borders of tasks by one carried row a task, counts are pre-aggregated, ids of
one node's members are gathered by ranges and hashed block by block.  SHA-256
is sequential, so the blocks of one node pass through one task, one at a time.
Windows are used for the points of one chain alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table_parts

#: Cycle of the rebuilding rule and the longest borrowed head.
FAMILY, HEADS = 5, 9


def _hold(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def running(df: DataFrame, key: str, order: list[Column], sums: list[str], parts: int) -> DataFrame:
    """``df`` (long columns) with ``<c>_run`` and ``<c>_was`` for each of ``sums``: its sum over the rows of ``key`` with and without this one, modulo 2**64.

    Rows are sorted by key and order over all tasks.  Each task sums its own
    rows; the last row of each is read, which tells the others what to add, so
    a key may span any number of tasks.
    """
    names = df.columns
    outs = [f"{c}_{x}" for x in ("run", "was") for c in sums]
    schema = ", ".join(f"{c} long" for c in [*names, *outs])
    rows = df.repartitionByRange(parts, F.col(key), *order).sortWithinPartitions(F.col(key), *order)

    def local(batches):
        part, first, last, held, waiting = TaskContext.get().partitionId(), None, None, [0] * len(sums), None

        def marked(batch, final: bool):
            marks = np.zeros(batch.num_rows, np.int64)
            marks[-1] = final
            fixed = [pa.array(np.full(batch.num_rows, v, np.int64)) for v in (part, first)]
            return pa.RecordBatch.from_arrays([*batch.columns, *fixed, pa.array(marks)], names=[*names, *outs, "part", "first", "final"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _hold(batch, key)
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes, runs, befores = np.diff(np.r_[starts, len(keys)]), [], []
            for k, c in enumerate(sums):
                value = _hold(batch, c)
                total = np.cumsum(value)
                before = np.r_[0, total[starts[1:] - 1]]
                if last == keys[0]:
                    before[0] -= held[k]
                run = total - np.repeat(before, sizes)
                held[k] = run[-1]
                runs.append(pa.array(run))
                befores.append(pa.array(run - value))
            last = keys[-1]
            if first is None:
                first = keys[0]
            if waiting is not None:
                yield marked(waiting, False)
            waiting = pa.RecordBatch.from_arrays([*batch.columns, *runs, *befores], names=[*names, *outs])
        if waiting is not None:
            yield marked(waiting, True)

    found = materialize(rows.mapInArrow(local, schema + ", part long, first long, final long"), "running")
    tails = found.filter("final = 1").select("part", "first", key, *(f"{c}_run" for c in sums)).orderBy("part").collect()  # one row per task
    size = tails[-1]["part"] + 1 if tails else 1
    has, whose, add = np.zeros(size, bool), np.zeros(size, np.int64), np.zeros((len(sums), size), np.int64)
    for r, after in zip(tails, tails[1:]):
        total = np.array(r[3:], dtype=np.int64)
        if has[r["part"]] and whose[r["part"]] == r[key]:
            total = total + add[:, r["part"]]
        has[after["part"]], whose[after["part"]], add[:, after["part"]] = True, r[key], total
    sent = df.sparkSession.sparkContext.broadcast((has, whose, add))  # a few numbers per task

    def fix(batches):
        has, whose, add = sent.value
        for batch in batches:
            if batch.num_rows:
                part = _hold(batch, "part")
                on = has[part] & (whose[part] == _hold(batch, key))
                out = [pa.array(_hold(batch, f"{c}_{x}") + np.where(on, add[k][part], 0)) for x in ("run", "was") for k, c in enumerate(sums)]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), *out], names=[*names, *outs])

    return found.mapInArrow(fix, schema)


def numbered_turns(conversations: DataFrame, parts: int) -> DataFrame:
    """(conv, r, t1, t2, bytes): every turn's number from 1 in its conversation, the digest of role and text, the bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows = rows.select("conv", "turn", F.xxhash64("digest").alias("t1"), F.xxhash64(F.lit(1), F.col("digest")).alias("t2"), "bytes", F.lit(1).cast("long").alias("one"), F.monotonically_increasing_id().alias("uid"))
    order = [F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2"), F.col("uid")]
    return running(rows, "conv", order, ["one"], parts).select("conv", F.col("one_run").alias("r"), "t1", "t2", "bytes")


def rebuild(turns: DataFrame) -> DataFrame:
    """(conv, d, t1, t2, bytes, total) of every rebuilt conversation: a head of its family's first one, then its own turns; d = 0 is before the first turn."""
    convs = turns.groupBy("conv").agg(F.max("r").alias("n"))
    convs = convs.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).withColumn("base", F.col("conv") - F.col("conv") % FAMILY)
    first = convs.filter("conv = base").select("base", F.col("n").alias("there"))
    convs = convs.join(first, "base", "left").withColumn("head", F.least("h", F.coalesce("there", F.lit(0))))
    convs = materialize(convs.select("conv", "base", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "conversations")
    out = ["conv", "d", "t1", "t2", "bytes", "total"]
    heads = turns.filter(f"conv % {FAMILY} = 0 AND r < {HEADS}").select(F.col("conv").alias("base"), F.col("r").alias("d"), "t1", "t2", "bytes")
    heads = heads.join(convs.filter("head > 0"), "base").filter("d <= head").select(*out)
    tails = turns.join(convs, "conv").filter("r > h").withColumn("d", F.col("r") - F.col("h") + F.col("head")).select(*out)
    none = F.lit(0).cast("long")
    roots = convs.select("conv", none.alias("d"), none.alias("t1"), none.alias("t2"), none.alias("bytes"), "total")
    return heads.unionByName(tails).unionByName(roots)


NODE = ["d", "h1", "h2"]


def end_digests(ends: DataFrame, parts: int, block_bytes: int = 1 << 16) -> DataFrame:
    """(d, h1, h2, ends_sha256) of the nodes at which conversations end (d, h1, h2, conv)."""

    def blocks(batches):
        rows, now, ids, size = [], None, [], 0
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for d, h1, h2, conv in zip(*columns):
                if (d, h1, h2) != now or size >= block_bytes:
                    if ids:
                        rows.append((*now, ids[0], ",".join(map(str, ids))))
                    now, ids, size = (d, h1, h2), [], 0
                ids.append(conv)
                size += 21
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*rows))[:4]), pa.array([r[4] for r in rows])], names=[*NODE, "first", "ids"])
                rows = []
        if ids:
            yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in (*now, ids[0])), pa.array([",".join(map(str, ids))])], names=[*NODE, "first", "ids"])

    def digests(batches):
        now, sha = None, None
        make = lambda rows: pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*rows))[:3]), pa.array([r[3] for r in rows])], names=[*NODE, "ends_sha256"])
        for batch in batches:
            rows = []
            for d, h1, h2, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4))):
                if (d, h1, h2) != now:
                    if sha:
                        rows.append((*now, sha.hexdigest()))
                    now, sha = (d, h1, h2), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if rows:
                yield make(rows)
        if sha:
            yield make([(*now, sha.hexdigest())])

    dealt = ends.select(*NODE, "conv").repartitionByRange(parts, "conv").sortWithinPartitions(*NODE, "conv")
    gathered = dealt.mapInArrow(blocks, "d long, h1 long, h2 long, first long, ids string")
    return gathered.repartition(parts, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digests, "d long, h1 long, h2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, parts: int) -> DataFrame:
    """The nodes of the trie of (conv, d, t1, t2, bytes, total), d = 0 to total of every conversation.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).
    """
    deep = F.col("d") > 0
    hashed = turns.select(
        "conv",
        "d",
        "total",
        "bytes",
        F.when(deep, F.xxhash64("d", "t1", "t2")).otherwise(F.lit(0)).alias("e1"),
        F.when(deep, F.xxhash64("t2", "t1", "d", F.lit(7))).otherwise(F.lit(0)).alias("e2"),
    )
    paths = running(hashed, "conv", [F.col("d")], ["e1", "e2", "bytes"], parts)
    paths = paths.select("conv", "d", "total", "bytes", F.col("e1_run").alias("h1"), F.col("e2_run").alias("h2"), F.col("e1_was").alias("p1"), F.col("e2_was").alias("p2"), F.col("bytes_run").alias("b"))
    # Sort: who owns a prefix, and where each conversation leaves all smaller ones.
    least = [F.min(c).alias(c) for c in ("bytes", "b", "p1", "p2")]
    nodes = materialize(paths.groupBy(*NODE).agg(F.min("conv").alias("own"), F.count("*").alias("n"), *least), "prefixes")
    top = F.min(F.struct("d", "p1", "p2", (F.col("b") - F.col("bytes")).alias("above")))
    chains = nodes.groupBy("own").agg(top.alias("top"), F.max("d").alias("stop"))
    chains = materialize(chains.select("own", F.col("top.d").alias("start"), "top.p1", "top.p2", "top.above", "stop"), "chains")
    # Points: ends, branches and the root.
    ends = paths.filter("d = total").select(*NODE, "conv")
    mark = lambda n: F.lit(n).cast("long").alias("branches")
    marks = ends.select(*NODE, mark(0)).unionByName(chains.filter("start > 0").select((F.col("start") - 1).alias("d"), F.col("p1").alias("h1"), F.col("p2").alias("h2"), mark(1)))
    marks = marks.unionByName(nodes.filter("d = 0").select(*NODE, mark(0))).groupBy(*NODE).agg(F.sum("branches").alias("branches"))
    points = marks.join(nodes.select(*NODE, "own", "n", "bytes", "b"), NODE).join(chains.select("own", "start", "above", "stop"), "own")
    chain = Window.partitionBy("own").orderBy("d")
    points = points.select(*NODE, "own", "n", "bytes", "b", "start", (F.col("branches") + (F.col("d") < F.col("stop")).cast("long")).alias("n_children"), F.coalesce(F.lag("d").over(chain), F.col("start") - 1).alias("over"), F.coalesce(F.lag("b").over(chain), "above").alias("over_b"))
    points = points.withColumn("weight", (F.col("n") - 1) * (F.col("b") - F.col("over_b")))
    points = points.withColumn("down", F.sum("weight").over(chain.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    points = materialize(points, "points")
    # Aggregates: whole chains of a point's other members, and the rest of its own.
    sums = points.groupBy("own").agg(F.sum("weight").alias("chain_saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("chain_leaves"))
    members = paths.select("conv", *NODE).join(sums.withColumnRenamed("own", "conv"), "conv").join(points.select(*NODE), NODE)
    members = members.groupBy(*NODE).agg(F.sum("chain_saved").alias("all_saved"), F.sum("chain_leaves").alias("n_leaves"))
    parents = chains.join(points.select((F.col("d") + 1).alias("start"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("own").alias("above_own")), ["start", "p1", "p2"]).select("own", "above_own")
    full = points.join(members, NODE).join(parents, "own", "left").join(end_digests(ends, parts), NODE, "left")
    full = full.withColumn("saved", F.col("all_saved") - F.col("down") + (F.col("n") - 1) * F.col("bytes"))
    # Expansion: the nodes of an edge, in slices so that no row holds a long list.
    low, high, slice_of = F.col("over") + 1, F.col("d"), 1024
    edges = full.select("own", "d", "n", "start", "above_own", "n_children", "n_leaves", "saved", "ends_sha256", low.alias("low"), (F.col("b") - F.col("bytes")).alias("before"), F.explode(F.sequence(F.floor(low / slice_of), F.floor(high / slice_of))).alias("slice"))
    edges = edges.withColumn("depth", F.explode(F.sequence(F.greatest("low", F.col("slice") * slice_of), F.least("d", F.col("slice") * slice_of + slice_of - 1))))
    every = nodes.select("own", F.col("d").alias("depth"), (F.col("b") - F.col("bytes")).alias("own_before"))
    here = F.col("depth") == F.col("d")
    return edges.join(every, ["own", "depth"]).select(
        F.col("own").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > F.col("start"), F.col("own")).otherwise(F.col("above_own")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(here, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("saved") + (F.col("n") - 1) * (F.col("before") - F.col("own_before"))).alias("saved_tokens"),
        F.when(here & F.col("ends_sha256").isNotNull(), F.col("ends_sha256")).otherwise(F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def rebuilt_prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of (conv_id, turn, role, text)."""
    parts = table_parts(conversations)
    return prefix_trie(rebuild(numbered_turns(conversations, parts)), parts)
