"""Operator 9: conflict-constrained best-fit packing of documents into bins.

Each bin holds at most ``capacity`` tokens, one document of any source and
one of any duplicate cluster.  A shard's documents come longest first.  Open
bins are ordered by the room that is left; the search starts at the tightest
bin with enough room and goes on to its successors until a bin's source and
cluster bitmaps are free of the document's bits; else a new bin opens.

A document longer than ``capacity`` is cut into full pieces, each a bin of
its own, and a rest that is packed like any document.  Rows are dealt to
shards of about ``shard_rows`` by hash, so a hot source or a large cluster is
spread evenly over bounded tasks; bins never span shards.

Null and empty texts count their end token only.  A null source or cluster
conflicts with nothing.  Repeated rows are documents of one cluster (they go
to different bins).  An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_size, materialize, raw_column
from .token_pack import encoder


def best_fit(sizes: list[int], masks: list[tuple[int, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, items in the given order; ``masks``: each item's source and cluster bits."""
    rooms: list[tuple[int, int]] = []  # (room left, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for size, (source, cluster) in zip(sizes, masks):
        i = bisect_left(rooms, (size, -1))
        while i < len(rooms) and (sources[rooms[i][1]] & source or clusters[rooms[i][1]] & cluster):
            i += 1
        if i < len(rooms):
            room, b = rooms.pop(i)
        else:
            room, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= source
        clusters[b] |= cluster
        out.append((b, capacity - room))
        if room > size:
            insort(rooms, (room - size, b))
    return out


def _bits(values: list) -> list[int]:
    """One bit for each value that occurs twice or more; others, and null, conflict with nothing."""
    seen: dict = {}
    for v in values:
        seen[v] = seen.get(v, 0) + 1
    seen.pop(None, None)
    bit = {v: 1 << k for k, v in enumerate(v for v, n in seen.items() if n > 1)}
    return [bit.get(v, 0) for v in values]


def pack(items: DataFrame, capacity: int, shard_rows: int = 4096) -> DataFrame:
    """Pack ``items`` (doc_id long, source string, cluster long, n_tokens long).

    Returns one row per piece: doc_id, piece, n_pieces, bin, offset, n_tokens,
    bin_tokens (the bin's fill).  ``items`` is read twice: pass a stored table.
    """
    shards = max(1, -(-items.count() // shard_rows))
    # Rows that are equal in everything are spread by the stored partitions they lie in.
    where = F.pmod(F.xxhash64("doc_id", "source", "cluster", "n_tokens", F.spark_partition_id()), F.lit(shards)).cast("int")

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        ids, size = table.column("doc_id").to_pylist(), table.column("n_tokens").to_pylist()
        sources, clusters = table.column("source").to_pylist(), table.column("cluster").to_pylist()
        keys = [(-(n % capacity or capacity), d is None, d or 0, c or 0, s or "") for n, d, c, s in zip(size, ids, clusters, sources)]
        order = sorted(range(len(ids)), key=keys.__getitem__)
        masks = list(zip(_bits(sources), _bits(clusters)))
        rest = [size[k] % capacity or capacity for k in order]
        placed = best_fit(rest, [masks[k] for k in order], capacity)
        opened = max((b for b, _ in placed), default=-1) + 1
        fill: dict[int, int] = {}
        rows = []
        for k, n, (b, offset) in zip(order, rest, placed):
            pieces = -(-size[k] // capacity)
            for p in range(pieces - 1):
                rows.append((ids[k], p, pieces, opened, 0, capacity))
                fill[opened] = capacity
                opened += 1
            rows.append((ids[k], pieces - 1, pieces, b, offset, n))
            fill[b] = fill.get(b, 0) + n
        doc, piece, of, bin_, offset, n = (list(c) for c in zip(*rows))
        return pa.Table.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(of, pa.int32()), pa.array([shard << 32 | b for b in bin_], pa.int64()), pa.array(offset, pa.int64()), pa.array(n, pa.int64()), pa.array([fill[b] for b in bin_], pa.int64())],
            names=["doc_id", "piece", "n_pieces", "bin", "offset", "n_tokens", "bin_tokens"],
        )

    return (
        items.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("cluster").cast("long"), F.col("n_tokens").cast("long"))
        .withColumn("shard", where)
        .groupBy("shard")
        .applyInArrow(run, "doc_id long, piece int, n_pieces int, bin long, offset long, n_tokens long, bin_tokens long")
    )


def measure(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, source, cluster, n_tokens): token counts with the end id; the cluster is a hash of the text's words, ASCII letters in lower case."""

    def run(batches):
        from xxhash import xxh3_64_intdigest

        enc = encoder(tokenizer)
        for batch in batches_by_size(batches):
            texts = raw_column(batch, 2)
            sizes = enc.lengths(texts)
            clusters = [xxh3_64_intdigest(b" ".join(t.lower().split())) - (1 << 63) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(clusters, pa.int64()), pa.array(sizes + 1, pa.int64())], names=["doc_id", "source", "cluster", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text").mapInArrow(run, "doc_id long, source string, cluster long, n_tokens long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Token counts, clusters and bins of whole documents."""
    return pack(materialize(measure(docs, tokenizer), "lengths"), capacity)
