"""Operator 8: embedding near-duplicates by product quantisation.

Unit vectors are indexed in coarse inverted lists (k-means centroids); what a
centroid leaves over, the residual, is coded by subspace: one byte per group
of dimensions.  Distances are estimated by table look-ups (exact query side,
coded index side); every pair whose estimate is within the coded vector's own
error of the threshold is reranked by exact cosine in double precision.

A vector probes a list if the list's radius allows a neighbour, and if the
plane between the list's centre and its own is near enough.  No neighbour lies
further behind that plane than the whole distance that the threshold allows;
but it would have to lie straight across.  How far neighbours do go is measured
on the sample, on its links and on vectors moved to the threshold in the
directions of the data, and the planes are read to the ``recall`` quantile.
With ``recall`` = 1 the whole distance counts, and no link is lost.

Equal unit vectors of a label are one vector with a weight: they are grouped
before the index is built, a link counts for the copies of its other end, and
copies link with each other, so a vector that a third of all rows repeat costs
no more than another.

Centroids and codebooks are fitted on a bounded sample of different vectors, in
the order of a hash of the vector: eight rows for each list, ``sample`` at least and
``most_sample`` at most.  There are as many lists as it takes for ``list_rows``
rows in each, up to an eighth of ``most_sample``; from there on lists grow and
are read in blocks.  Every row is indexed and every row queries.  Vectors are
compared only within equal, non-null labels, and each vector length has an
index of its own.

A vector lies in one list, so link counts need no pair table: each task adds
up the links that it finds and keeps a spanning forest of them.  Of two lists
only the rows of the first probe the second, and a link counts for both ends.

Null vectors, null labels, zero vectors, vectors with null or non-finite
components and rows with a null id link with nothing.  Repeated vectors link
with each other; every row is a vector, also where ids repeat.  An empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, materialize
from .components import Forest, components

CODES = 256
#: Far above the rounding of double precision, far below any distance that matters.
ROUNDING = 1e-6


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Plain Lloyd rounds from distinct random rows; empty clusters keep their centre."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, step: int = 4096) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[a : a + step] @ centres.T - half, axis=1) for a in range(0, len(x), step)] or [np.empty(0, np.int64)])


class Index:
    """Coarse centroids, subspace codebooks, and the radius of each list over all its rows."""

    def __init__(self, centres: np.ndarray, books: np.ndarray, radii: np.ndarray | None = None):
        self.centres, self.books, self.radii = centres, books, radii
        self.width = books.shape[2]

    def lists(self, x: np.ndarray) -> np.ndarray:
        return nearest(x, self.centres)

    def beyond(self, x: np.ndarray, home: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Squared distances of rows to centres, how much they exceed those to their own, and twice the distance of the two centres."""
        centres = self.centres[some]
        square = np.maximum((x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * x @ centres.T, 0)
        homes, at = np.unique(home, return_inverse=True)
        own = self.centres[homes]
        apart = np.sqrt(np.maximum((own**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * own @ centres.T, 0))
        return square, square - ((x - self.centres[home]) ** 2).sum(axis=1)[:, None], 2 * apart[at]

    def probed(self, x: np.ndarray, home: np.ndarray, some: np.ndarray, reach: float, margin: float) -> np.ndarray:
        """Whether each row asks each of ``some`` lists for vectors within ``reach``; of the pairs of lists, those not before the row's own."""
        square, beyond, apart = self.beyond(x, home, some)
        inside = (np.sqrt(square) <= self.radii[some] + reach + ROUNDING) & (beyond <= apart * reach * margin + ROUNDING)
        return (inside | (some == home[:, None])) & (some >= home[:, None])

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = x - self.centres[lists]
        return np.stack([nearest(rest[:, m * self.width : (m + 1) * self.width], self.books[m]) for m in range(len(self.books))], axis=1).astype(np.uint8)

    def decode(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centres[lists] + np.hstack([self.books[m][codes[:, m]] for m in range(len(self.books))])

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of each query with every codeword of every subspace."""
        return np.stack([queries[:, m * self.width : (m + 1) * self.width] @ self.books[m].T for m in range(len(self.books))], axis=1)

    def estimate(self, queries: np.ndarray, centre: int, codes: np.ndarray) -> np.ndarray:
        """Estimated cosine of each query with each coded vector of one list: table look-ups only."""
        tables = self.tables(queries)
        out = np.repeat((queries @ self.centres[centre])[:, None], len(codes), axis=1)
        for m in range(tables.shape[1]):
            out += tables[:, m][:, codes[:, m]]
        return out


def fit(sample: np.ndarray, lists: int, subspaces: int) -> Index:
    """Fit centroids, in the order of their main axis (neighbours get near numbers), and codebooks."""
    centres = kmeans(sample, lists)
    axis = np.linalg.svd(centres - centres.mean(axis=0), full_matrices=False)[2][0]
    centres = centres[np.argsort(centres @ axis, kind="stable")]
    own = nearest(sample, centres)
    rest = sample - centres[own]
    width = sample.shape[1] // subspaces
    books = []
    for m in range(subspaces):
        part = rest[:, m * width : (m + 1) * width]
        book = kmeans(part, CODES, rounds=6, seed=m)
        books.append(np.vstack([book, np.repeat(book[:1], CODES - len(book), axis=0)]))
    return Index(centres, np.stack(books))


def measure_margin(index: Index, x: np.ndarray, labels: np.ndarray, threshold: float, recall: float, queries: int = 2048, most: int = 200_000) -> float:
    """The share of the greatest possible distance behind the planes that holds ``recall`` of the neighbours of a sample."""
    if recall >= 1 or len(index.centres) < 2 or len(x) < 2:
        return 1.0
    rng, reach = np.random.default_rng(7), float(np.sqrt(max(1e-12, 2 - 2 * threshold)))
    home = index.lists(x)

    def needed(a: np.ndarray, ha: np.ndarray, hb: np.ndarray) -> np.ndarray:
        """What the row of the first list needs to ask the second."""
        out = np.zeros(len(a))
        for k in range(0, len(a), 4096):
            c, own = index.centres[hb[k : k + 4096]], index.centres[ha[k : k + 4096]]
            part = a[k : k + 4096]
            gap = ((part - c) ** 2).sum(axis=1) - ((part - own) ** 2).sum(axis=1)
            out[k : k + 4096] = gap / np.maximum(2 * np.linalg.norm(c - own, axis=1) * reach, 1e-12)
        return np.where(ha == hb, 0.0, out)

    some = rng.permutation(len(x))[:queries]
    # Links within the sample, a bounded number of them.
    left, right = [], []
    for k in range(0, len(some), 256):
        rows = some[k : k + 256]
        i, j = np.nonzero((x[rows] @ x.T >= threshold) & (labels[rows][:, None] == labels[None, :]) & (rows[:, None] != np.arange(len(x))[None, :]))
        pick = rng.permutation(len(i))[: most * 256 // queries]
        left.append(rows[i[pick]])
        right.append(j[pick])
    i, j = np.concatenate(left), np.concatenate(right)
    first = home[i] <= home[j]
    real = needed(x[np.where(first, i, j)], np.minimum(home[i], home[j]), np.maximum(home[i], home[j]))
    # Sample vectors moved to the threshold in the direction of other sample vectors.
    a = x[some]
    way = x[rng.integers(0, len(x), len(some))] - x[rng.integers(0, len(x), len(some))] + rng.normal(scale=1e-6, size=a.shape)
    way -= (way * a).sum(axis=1)[:, None] * a
    b = threshold * a + np.sqrt(max(0.0, 1 - threshold**2)) * way / np.maximum(np.linalg.norm(way, axis=1), 1e-12)[:, None]
    ha, hb = home[some], index.lists(b)
    moved = needed(np.where((ha <= hb)[:, None], a, b), np.minimum(ha, hb), np.maximum(ha, hb))
    return float(np.clip(max(np.quantile(v, recall) if len(v) else 0.0 for v in (real, moved)), 0.0, 1.0))


def _unit_rows(table: pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    flat = table.column(table.schema.get_field_index(column))
    return np.frombuffer(b"".join(flat.to_pylist()), "<f8").reshape(-1, dim)


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(key, vec_id, label, dim, unit) of every row: unit vectors in double precision, as bytes; null where the row cannot link."""
    x = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("embedding"))

    def run(batches):
        for batch in batches:
            unit, dim = [], []
            for r in batch.column(3).to_pylist():
                dim.append(None if r is None else len(r))
                if r is not None:
                    v = np.array(r, dtype=np.float64)
                    v = v / np.abs(v).max()
                    r = (v / np.linalg.norm(v)).tobytes()
                unit.append(r)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(dim, pa.int32()), pa.array(unit, pa.binary())], names=["key", "vec_id", "label", "dim", "unit"])

    return rows.withColumn("embedding", F.when(sound, x)).mapInArrow(run, "key long, vec_id long, label string, dim int, unit binary")


def find_links(sound: DataFrame, dim: int, total: int, threshold: float, recall: float, sample: int, most_sample: int, list_rows: int, subspaces: int, block: int) -> DataFrame:
    """(key, other, links) of the ``total`` different vectors of one length (key, label, unit, weight): link counts by weight (other null) and a spanning forest (links 0)."""
    spark = sound.sparkSession
    parts_of = next(s for s in range(min(subspaces, dim), 0, -1) if dim % s == 0)
    lists = int(np.clip(total // list_rows, 1, max(1, most_sample // 8)))
    # The bounded sample.
    rows = sound.select("unit", F.xxhash64("label").alias("label")).orderBy(F.xxhash64("unit"), "key").limit(int(np.clip(8 * lists, sample, max(sample, most_sample)))).toArrow()
    x = np.frombuffer(b"".join(rows.column("unit").to_pylist()), "<f8").reshape(-1, dim)
    index = fit(x, lists, parts_of)
    lists = len(index.centres)
    margin = measure_margin(index, x, rows.column("label").to_numpy(), threshold, recall)
    del x, rows
    fitted = spark.sparkContext.broadcast((index.centres, index.books))
    # Unit vectors with a cosine of ``threshold`` are this far apart.
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def deal(batches):
        own = Index(*fitted.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit_rows(batch, "unit", dim)
            home = own.lists(x)
            codes = own.encode(x, home)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in range(4)),
                    pa.array(home.astype(np.int32)),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(np.linalg.norm(x - own.decode(home, codes), axis=1)),
                    pa.array(np.linalg.norm(x - own.centres[home], axis=1)),
                ],
                names=["key", "label", "unit", "weight", "home", "codes", "error", "radius"],
            )

    dealt = materialize(sound.select("key", "label", "unit", "weight").mapInArrow(deal, "key long, label string, unit binary, weight long, home int, codes binary, error double, radius double"), "inverted-lists")
    radii = np.zeros(lists)
    for r in dealt.groupBy("home").agg(F.max("radius").alias("radius")).collect():  # one row per list
        radii[r["home"]] = r["radius"]
    sent = spark.sparkContext.broadcast((index.centres, index.books, radii))
    # The lists of a label are read in runs of about ``block`` rows, so a query goes once to each run and not to each list.
    labels = dealt.groupBy("label").agg(F.least(F.lit(lists), F.ceil(F.count("*") / block)).cast("int").alias("runs"))
    based = dealt.join(labels, "label")
    chunk = max(16, min(512, (1 << 21) // lists))

    def ask(batches):
        own, every_list = Index(*sent.value), np.arange(lists)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, home, runs = _unit_rows(batch, "unit", dim), batch.column(4).to_numpy(), batch.column(5).to_numpy()
            asked = []
            for a in range(0, len(x), chunk):
                for k, row in enumerate(own.probed(x[a : a + chunk], home[a : a + chunk], every_list, reach, margin), a):
                    asked.append(np.unique(np.flatnonzero(row) * int(runs[k]) // lists).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(asked, pa.list_(pa.int32()))], names=["key", "label", "unit", "weight", "home", "asked"])

    queries = materialize(based.select("key", "label", "unit", "weight", "home", "runs").mapInArrow(ask, "key long, label string, unit binary, weight long, home int, asked array<int>"), "vector-queries")
    # Large runs are cut into blocks of index rows times blocks of queries, by counts of both.
    run = F.floor(F.col("home").cast("long") * F.col("runs") / F.lit(lists)).cast("int")
    indexed = based.select("key", "label", run.alias("run"), F.lit(1).alias("indexed"), "home", "unit", "weight", "codes", "error")
    asking = queries.select("key", "label", F.explode("asked").alias("run"), F.lit(0).alias("indexed"), "home", "unit", "weight", F.lit(b"").alias("codes"), F.lit(0.0).alias("error"))
    cut = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / block)).cast("int")
    sizes = indexed.groupBy("label", "run").agg(F.count("*").alias("n_index")).join(asking.groupBy("label", "run").agg(F.count("*").alias("n_query")), ["label", "run"])
    sized = indexed.unionByName(asking).join(sizes.select("label", "run", cut("n_index").alias("bi"), cut("n_query").alias("bq")), ["label", "run"])
    mine = F.pmod(F.xxhash64("key"), F.when(F.col("indexed") == 1, F.col("bi")).otherwise(F.col("bq"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("indexed") == 1, F.col("bq")).otherwise(F.col("bi")) - 1))
    tasks = sized.withColumn("mine", mine).withColumn("other", other).withColumn("task", F.xxhash64("label", "run", F.when(F.col("indexed") == 1, F.col("mine")).otherwise(F.col("other")), F.when(F.col("indexed") == 1, F.col("other")).otherwise(F.col("mine"))))

    def search(table: pa.Table) -> pa.Table:
        own = Index(*sent.value)
        side = table.column("indexed").to_numpy()
        ids, home, units = table.column("key").to_numpy(), table.column("home").to_numpy(), table.column("unit").to_pylist()
        weight = table.column("weight").to_numpy()
        q, x = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        links, forest = {}, Forest()
        if len(q) and len(x):
            matrix = lambda rows: np.frombuffer(b"".join([units[k] for k in rows]), "<f8").reshape(-1, dim)
            x = x[np.argsort(home[x], kind="stable")]
            queries, base, asked = matrix(q), matrix(x), home[q]
            listed, error, coded = home[x], table.column("error").to_numpy()[x], table.column("codes").to_pylist()
            codes = np.frombuffer(b"".join([coded[k] for k in x]), np.uint8).reshape(len(x), -1)
            some, first = np.unique(listed, return_index=True)
            last = np.append(first[1:], len(x))
            for a in range(0, len(q), 512):
                probed = own.probed(queries[a : a + 512], asked[a : a + 512], some, reach, margin)
                for n, (c, start, stop) in enumerate(zip(some.tolist(), first, last)):
                    at = a + np.flatnonzero(probed[:, n])
                    if not len(at):
                        continue
                    k, j = np.nonzero(own.estimate(queries[at], c, codes[start:stop]) >= threshold - error[start:stop] - ROUNDING)
                    k, j = at[k], j + start
                    sure = ids[q[k]] != ids[x[j]]
                    k, j = k[sure], j[sure]
                    sure = np.concatenate([np.einsum("ij,ij->i", queries[k[i : i + 65536]], base[j[i : i + 65536]]) for i in range(0, len(k), 65536)] or [np.empty(0)]) >= threshold
                    k, j = k[sure], j[sure]
                    # Within a list both ends ask; between two lists only the first does.
                    outer = asked[k] != c
                    for rows, ends in ((q[k], x[j]), (x[j[outer]], q[k[outer]])):
                        found, at_row = np.unique(ids[rows], return_inverse=True)
                        sums = np.zeros(len(found), np.int64)
                        np.add.at(sums, at_row, weight[ends])
                        for v, m in zip(found.tolist(), sums.tolist()):
                            links[v] = links.get(v, 0) + m
                    for one, two in zip(ids[q[k]].tolist(), ids[x[j]].tolist()):
                        forest.join(one, two)
        a, b = forest.stars()
        return pa.Table.from_arrays(
            [pa.array([*links, *a.tolist()], pa.int64()), pa.array([*[None] * len(links), *b.tolist()], pa.int64()), pa.array([*links.values(), *[0] * len(a)], pa.int64())], names=["key", "other", "links"]
        )

    found = materialize(tasks.select("task", "key", "indexed", "home", "unit", "weight", "codes", "error").groupBy("task").applyInArrow(search, "key long, other long, links long"), "vector-links")
    for t in (dealt, queries):
        drop_materialized(t)
    return found


def near_vectors(
    vectors: DataFrame, threshold: float = 0.93, recall: float = 0.999, sample: int = 20_000, most_sample: int = 100_000, list_rows: int = 512, subspaces: int = 16, block: int = 2048, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    every = materialize(unit_vectors(vectors, id_col, vec_col, label_col), "unit-vectors")
    # Equal vectors of a label are one: the least key, and how many there are.
    same = ["label", "dim", "unit"]
    groups = every.filter("unit IS NOT NULL").groupBy(*same).agg(F.min("key").alias("rep"), F.count("*").alias("weight"), F.min("vec_id").alias("least_id"))
    groups = materialize(groups, "different-vectors")
    dims = groups.groupBy("dim").count().orderBy("dim").collect()  # one row per vector length
    found = every.sparkSession.createDataFrame([], "key long, other long, links long")
    for r in dims:
        if r["count"] > 1:
            some = groups.filter(F.col("dim") == r["dim"]).select(F.col("rep").alias("key"), "label", "unit", "weight")
            found = found.unionByName(find_links(some, r["dim"], r["count"], threshold, recall, sample, most_sample, list_rows, subspaces, block))
    counts = found.filter("other IS NULL").groupBy(F.col("key").alias("rep")).agg(F.sum("links").alias("links"))
    parts = components(found.filter("other IS NOT NULL").select(F.col("key").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "rep")
    least = parts.join(groups.select("rep", "least_id"), "rep").groupBy("component").agg(F.min("least_id").alias("part_id"))
    known = groups.join(counts, "rep", "left").join(parts.join(least, "component").select("rep", "part_id"), "rep", "left")
    known = known.select(*same, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("part_id", "least_id").alias("component_id"))
    out = every.select("vec_id", *same).join(known, same, "left")
    group = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), group.alias("component_id"), F.coalesce(group == F.col("vec_id"), F.lit(True)).alias("kept"))
