"""Operator 11: exact duplicates, owned by the terminal nodes of compressed tries.

A text is compared without the bytes 20 and 09 to 0D (hexadecimal).  Every task first inserts its
own rows' byte strings into a radix trie with compressed edges; a terminal
node counts its rows and keeps the best of them, so a text that a third of
all rows share leaves a task once.  These distinct texts are partitioned by
length and content hash, sorted by both, and inserted whole, below that key,
into the tries of the second step.  Their terminal nodes add up the counts
and hold the owner: the row with the most code points before the white space
went, then the smallest id.  Rows find their owner by the number of their
terminal node in the first step, so no text takes part in that join.

Memory: a task's trie holds ``most_bytes`` of labels and nodes.  Beyond it the
first step hands on whole subtrees below the root, the largest first, and
forgets them; a text that comes again is another terminal, which the second
step merges.  In the second step rows come in the order of their keys, so
every subtree left of the current key is finished and is handed on.

Null texts are empty, empty texts equal each other.  Ids may repeat or be
null (null is the largest); of wholly equal rows one is kept.  An empty table
gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_size, materialize, raw_column, table_parts

#: Fixed value: the bytes that the comparison leaves out.
BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes of a node beside its label.
NODE = 300
#: Rows a task may number.
ROWS = 1 << 36


class Node:
    """A label of bytes, the nodes below by their first byte, and what ends here."""

    __slots__ = ("label", "below", "end")

    def __init__(self, label: bytes):
        self.label, self.below, self.end = label, None, None


class RadixTrie:
    """A compressed radix trie over byte strings."""

    def __init__(self):
        self.root, self.bytes = Node(b""), 0

    def _leaf(self, above: Node, label: bytes) -> Node:
        leaf = Node(label)
        if above.below is None:
            above.below = {}
        above.below[label[0]] = leaf
        self.bytes += len(label) + NODE
        return leaf

    def insert(self, key: bytes) -> Node:
        """The node at which ``key`` ends."""
        node, at, size = self.root, 0, len(key)
        while at < size:
            down = node.below.get(key[at]) if node.below else None
            if down is None:
                return self._leaf(node, key[at:])
            label = down.label
            if not key.startswith(label, at):
                # Divide the edge where the two part.
                same, off = 1, min(len(label), size - at)
                while same < off:
                    half = (same + off + 1) // 2
                    if key.startswith(label[:half], at):
                        same = half
                    else:
                        off = half - 1
                middle = Node(label[:same])
                middle.below = {label[same]: down}
                down.label = label[same:]
                node.below[label[0]] = middle
                self.bytes += NODE
                down = middle
                label = middle.label
            at += len(label)
            node = down
        return node

    def ends(self, top: Node | None = None, prefix: bytes = b""):
        """(key, end) of the terminal nodes below ``top``, in the order of their keys."""
        todo = [(top or self.root, prefix)]
        while todo:
            node, key = todo.pop()
            key += node.label
            if node.end is not None:
                yield key, node.end
            if node.below:
                todo += [(node.below[c], key) for c in sorted(node.below, reverse=True)]

    def spill(self, most: int):
        """Hand on (key, end) of subtrees below the root, the largest first, until half of ``most`` bytes are left."""

        def weight(top: Node) -> int:
            total, todo = 0, [top]
            while todo:
                node = todo.pop()
                total += len(node.label) + NODE
                if node.below:
                    todo += node.below.values()
            return total

        below = self.root.below or {}
        for size, c in sorted(((weight(node), c) for c, node in below.items()), reverse=True):
            if self.bytes <= most // 2:
                break
            yield from self.ends(below.pop(c))
            self.bytes -= size


def _better(a: list, b: list) -> bool:
    """Whether the first of two [points, doc_id, row] stays rather than the second."""
    order = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    return order(a) < order(b)


FIRST = "length long, hash long, doc_id long, points long, row long, terminal long, n long, sha binary, text binary"


def _local(most_bytes: int, batch_bytes: int = 4_000_000):
    """Rows (doc_id, text, points): one row for each, and one for each distinct text that a trie hands on."""
    names = [c.split()[0] for c in FIRST.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.binary()] * 2

    def rows_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def handed_on(found):
        rows, size = [], 0
        for key, (points, doc_id, row, terminal, n) in found:
            sha = hashlib.sha256(key).digest()
            rows.append((len(key), int.from_bytes(sha[:8], "little", signed=True), doc_id, points, row, terminal, n, sha, key))
            size += len(key) + 100
            if size > batch_bytes:
                yield rows_of(rows)
                rows, size = [], 0
        if rows:
            yield rows_of(rows)

    def run(batches):
        first = TaskContext.get().partitionId() * ROWS
        row = terminal = first
        trie = RadixTrie()
        for batch in batches_by_size(batches):
            out = []
            for doc_id, text, points in zip(batch.column(0).to_pylist(), raw_column(batch, 1), batch.column(2).to_pylist()):
                node = trie.insert(text.translate(None, BLANKS))
                end = node.end
                if end is None:
                    end = node.end = [points, doc_id, row, terminal, 0]
                    terminal += 1
                elif _better((points, doc_id, row), end):
                    end[:3] = points, doc_id, row
                end[4] += 1
                out.append((None, None, doc_id, None, row, end[3], None, None, None))
                row += 1
            yield rows_of(out)
            if trie.bytes > most_bytes:
                yield from handed_on(trie.spill(most_bytes))
        yield from handed_on(trie.ends())

    return run


def _global(most_bytes: int):
    """Distinct texts in the order of length and hash: for each terminal of the first step its owner."""
    names, kinds = ["terminal", "keep_id", "keep_row", "group_size", "sha"], [pa.int64()] * 4 + [pa.binary()]

    def owners(trie: RadixTrie):
        rows = []
        for _, (_, keep_id, keep_row, sha, n, terminals) in trie.ends():
            for a in range(0, len(terminals), 10_000):
                rows += [(t, keep_id, keep_row, n, sha) for t in terminals[a : a + 10_000]]
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        trie, last = RadixTrie(), None
        for batch in batches_by_size(batches):
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("length", "hash", "doc_id", "points", "row", "terminal", "n", "sha", "text")]
            for length, content, doc_id, points, row, terminal, n, sha, text in zip(*columns):
                if (length, content) != last:
                    if trie.bytes > most_bytes:
                        yield from owners(trie)
                        trie = RadixTrie()
                    last = length, content
                node = trie.insert(length.to_bytes(8, "big") + (content + (1 << 63)).to_bytes(8, "big") + text)
                end = node.end
                if end is None:
                    node.end = [points, doc_id, row, sha, n, [terminal]]
                    continue
                if _better((points, doc_id, row), end):
                    end[:3] = points, doc_id, row
                end[4] += n
                end[5].append(terminal)
        yield from owners(trie)

    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = 128_000_000) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("points"))
    found = materialize(read.mapInArrow(_local(most_bytes), FIRST), "local-tries", compression="zstd")
    texts = found.filter("length IS NOT NULL").repartition(table_parts(docs), "length", "hash").sortWithinPartitions("length", "hash")
    owners = texts.mapInArrow(_global(most_bytes), "terminal long, keep_id long, keep_row long, group_size long, sha binary")
    owners = materialize(owners, "owners")
    rows = found.filter("length IS NULL").select("doc_id", "row", "terminal").join(owners, "terminal")
    return rows.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = 128_000_000) -> DataFrame:
    """``docs`` without the rows of the ids that ``exact_duplicates`` drops; ids must be unique and not null."""
    dropped = exact_duplicates(docs, id_col, text_col, most_bytes).filter(~F.col("kept")).select(F.col("doc_id").alias("dropped_id"))
    return docs.join(dropped, docs[id_col].cast("long") == dropped["dropped_id"], "left_anti")
