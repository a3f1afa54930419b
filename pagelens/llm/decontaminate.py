"""Operator 3: benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared as lower-case words of letters and digits
with single spaces.  An item of m characters may differ from a passage by
k = floor(error_rate * m) edits.  It is split into k + 1 pieces: any passage
within k edits holds one of them unchanged.  One Aho-Corasick pass finds all
pieces' exact hits in a whole text; each hit fixes the place of the item, and
Myers' bit-parallel distance verifies the window around it.

The items are a query set: they are scanned in blocks of bounded size against
all documents, so a larger set takes more passes and never more memory.  The
driver reads one block at a time, sends it as a broadcast of at most
``block_chars`` characters (one item at least), and stores what the block
finds before it reads the next.

Null and empty texts and items match nothing.  Repeated items or rows match
each on their own.  An empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_materialized, kept, materialize

WORDS = re.compile(r"[^\W_]+")


def normal(text: str) -> str:
    words = WORDS.findall(text.lower())
    return f" {' '.join(words)} " if words else ""


def budget(length: int, error_rate: float) -> int:
    return int(length * error_rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 parts of nearly equal length with their offsets."""
    n = errors + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """The least edit distance of ``pattern`` to any part of ``text`` and the first end of such a part; None over ``most``."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for k, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best = full, 0, m, (most + 1, 0)
    get = masks.get
    for j, c in enumerate(text):
        x = get(c, 0) | vn
        d0 = (((x & vp) + vp) ^ vp) | x
        hp = vn | ~(d0 | vp)
        hn = vp & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp <<= 1
        vp = ((hn << 1) | ~(d0 | hp)) & full
        vn = d0 & hp & full
        if score < best[0]:
            best = score, j + 1
    return best if best[0] <= most else None


class Matcher:
    """All items of one block, ready to scan texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.items = []
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normal(text or "")
            if not text:
                continue
            k = budget(len(text), error_rate)
            for offset, piece in pieces(text, k):
                found.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, text, k))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the normal text) of each item that is in the text, at its best place."""
        if not text or not self.items or not (text := normal(text)):
            return []
        places: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for item, offset in where:
                places.setdefault(item, set()).add(end + 1 - size - offset)
        out = []
        for item, starts in places.items():
            item_id, pattern, k = self.items[item]
            best = None
            a = b = None
            for start in [*sorted(starts), None]:
                if start is not None and b is not None and start - k <= b:
                    b = start + len(pattern) + k
                    continue
                if a is not None and (got := myers(pattern, text[max(0, a) : max(0, b)], k)) and (best is None or got[0] < best[0]):
                    best = got[0], got[1] + max(0, a)
                if start is not None:
                    a, b = start - k, start + len(pattern) + k
            if best:
                out.append((item_id, *best))
        return sorted(out)


def blocks(benchmark: DataFrame, block_chars: int = 4_000_000, id_col: str = "item_id", text_col: str = "text"):
    """The items in blocks of at most ``block_chars`` characters (one item at least), and whether more follow; rows of a block reach the driver together."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).filter("text != ''")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    # Rows in hash order, read partition by partition: nothing but the block and one partition is on the driver.
    parts = max(1, -(-total // block_chars))
    rows = items.repartition(parts, F.xxhash64("item_id", "text")).toLocalIterator() if parts > 1 else iter(items.collect())
    held, size = [], 0
    for r in rows:
        if held and size + len(r["text"]) > block_chars:
            yield held, True
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += len(r["text"])
    yield held, False


def matches(spark: SparkSession, text: Column, items: list[tuple[int, str]], error_rate: float) -> Column:
    """array<struct(item_id, distance, end)> of a text's items."""
    name, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(items)

    @F.arrow_udf("array<struct<item_id:long,distance:int,end:int>>")
    def run(col: pa.Array) -> pa.Array:
        own = kept(("matcher", name), lambda: Matcher(sent.value, error_rate))
        rows = [[{"item_id": i, "distance": d, "end": e} for i, d, e in own.find(t.as_py())] for t in col]
        return pa.array(rows, pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int32())])))

    return run(text)


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.06, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, item_id, distance, end): every item found in every document, at its best place."""
    out = None
    for items, more in blocks(benchmark, **options):
        found = docs.select(F.col(id_col).alias("doc_id"), F.explode(matches(docs.sparkSession, F.col(text_col), items, error_rate)).alias("m")).select("doc_id", "m.*")
        if more or out is not None:
            found = materialize(found, "contaminated")
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.06, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns unchanged; with several blocks, stored after each but the last."""
    left, stored = docs, None
    for items, more in blocks(benchmark, **options):
        left = left.filter(F.size(matches(docs.sparkSession, F.col(text_col), items, error_rate)) == 0)
        if more:
            left = materialize(left, "uncontaminated")
            if stored is not None:  # only tables of this function: ``docs`` is the caller's
                drop_materialized(stored)
            stored = left
    return left
