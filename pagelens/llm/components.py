"""Connected components of a table of links, as DataFrame joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, materialize


class Forest:
    """Union-find over integers; the root of a tree is its smallest member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, r = self.up, x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r and p != x:
            up[x], x = r, p
        return r

    def join(self, a: int, b: int) -> bool:
        """True if the two were apart."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up.setdefault(a, a)
        self.up[b] = a
        return True

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """Each member that is no root, and its root."""
        pairs = [(x, self.root(x)) for x in list(self.up)]
        pairs = [p for p in pairs if p[0] != p[1]]
        both = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


def _contract(links: DataFrame) -> DataFrame:
    """Replace the links of each task's part by stars: the same components, fewer links and shorter paths."""

    def run(batches):
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.join(a, b)
        a, b = forest.stars()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every id in ``links`` (a long, b long); the component is its smallest id.

    Large-star and small-star steps alternate until no link changes: in each,
    a vertex's neighbours are linked to the least of them.  Minima are
    pre-aggregated and joined back, so a vertex with very many links is one
    skewed join key, which Spark splits, and never one task's group.
    """
    edges = materialize(_contract(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct(), "links")
    state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).filter("a != b").distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("a", "b", "m")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        new = materialize(small.distinct(), "small-star")
        after = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        drop_materialized(edges)
        drop_materialized(large)
        edges, before, state = new, state, after
        if before == after:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
