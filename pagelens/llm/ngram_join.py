"""Operator 5: n-gram Jaccard self-join by chosen paths.

A document is the set of its five-word shingles (lower-case runs of letters
and digits; a shorter text is one shingle).  Documents with equal sets form a
class; one representative per class is joined.

1. Each representative gets a sketch of minhash values, its tokens.
2. Chosen paths: at a node of the tree, a token is sampled when the hash of
   (path, token) falls below boost / (threshold * tokens); records that share
   a sampled token meet in a child node.  A pair at the threshold shares
   ``boost`` sampled tokens on average at each level.  Buckets of up to
   ``bucket`` records are compared by brute force, larger ones are split
   again, and what is left at the last level, or does not shrink, is compared
   in blocks: nothing is capped or dropped.  The number of runs follows from
   the target recall.
3. A bucket's comparison estimates similarity from sketches, well below the
   threshold, and keeps a spanning forest of the pairs that pass.  The forest's
   components hold every pair of the join (at the target recall).
4. Within a component all pairs are verified exactly on shingle sets, again in
   blocks; tasks return link counts and a spanning forest, never the pairs.

Results: one row per document with its class (the smallest id that its links
reach) and its number of links; copies count as links of each other.

Null and empty texts, and texts without words, link with nothing.  A row with
a null id is returned with a null class and no links.  Repeated rows are
copies of each other; if an id has several texts, each row has the class and
links of its own.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_A, WordHashes, batches_by_size, drop_materialized, free_name, kept, materialize, mix64, plain_words, table_parts
from .components import Forest, components

TOKENS = 64
#: Sketch agreement from which a pair is verified: four standard deviations below the threshold.
SLACK = 4.0


def shingle_sets(texts: list[str | None], n: int, hashes: WordHashes) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    each = [plain_words(t) if t else [] for t in texts]
    flat = hashes([w for words in each for w in words])
    out, at = [], 0
    with np.errstate(over="ignore"):
        for words in each:
            h = flat[at : at + len(words)]
            at += len(words)
            if not len(h):
                out.append(np.empty(0, np.uint64))
                continue
            k = min(n, len(h))
            acc = np.zeros(len(h) - k + 1, np.uint64)
            for j in range(k):
                acc = acc * MIX_A + h[j : j + len(acc)]
            out.append(np.unique(mix64(acc + np.uint64(k))))
    return out


def _seeds(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, count, dtype=np.uint64)


def sketches(sets: list[np.ndarray], seed: int = 5) -> np.ndarray:
    """Minhash values, one row of TOKENS unsigned 32-bit integers per (non-empty) set."""
    a, b = _seeds(TOKENS, seed)
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    h = np.concatenate(sets)
    out = np.empty((len(sets), TOKENS), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(TOKENS):
            out[:, i] = np.minimum.reduceat(((h * a[i] + b[i]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def survival(boost: float, depth: int) -> float:
    """The chance that a pair at the threshold still shares a node after ``depth`` levels."""
    s = 1.0
    for _ in range(depth):
        s = 1 - math.exp(-boost * s)
    return s


def runs_for(recall: float, boost: float, depth: int) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(boost, depth))))


def child_paths(path: np.ndarray, tokens: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) of every sampled token: ``path`` one per row, ``tokens`` a row of the sketch each."""
    with np.errstate(over="ignore"):
        token = mix64((tokens.astype(np.uint64) << np.uint64(8)) + np.arange(TOKENS, dtype=np.uint64))
        key = mix64(token ^ (path[:, None] * MIX_A))
    row, col = np.nonzero((key >> np.uint64(32)) < np.uint64(int(rate * 2**32)))
    return row, mix64(key[row, col] + np.uint64(1))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _tokens(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<u4").reshape(-1, TOKENS)


def agreements(a: np.ndarray, b: np.ndarray, rows: int = 128) -> np.ndarray:
    """How many bytes of each row of ``a`` equal those of each row of ``b``; some rows at a time, to stay in cache."""
    out = np.zeros((len(a), len(b)), np.uint8)
    columns = np.ascontiguousarray(b.T)
    for s in range(0, len(a), rows):
        part, block = out[s : s + rows], a[s : s + rows]
        for i in range(TOKENS):
            part += block[:, i][:, None] == columns[i][None, :]
    return out


def spanning(hit: np.ndarray, within: bool):
    """(row, columns) pairs that connect whatever the hits connect, each vertex reached once.

    ``within``: rows and columns are the same vertices; else they are two sides.
    """
    todo = np.ones(hit.shape[1], bool)
    if within:
        for s in range(len(hit)):
            if todo[s]:
                todo[s] = False
                stack = [s]
                while stack:
                    k = stack.pop()
                    new = np.flatnonzero(hit[k] & todo)
                    if len(new):
                        todo[new] = False
                        stack.extend(new.tolist())
                        yield k, new
        return
    left = np.ones(hit.shape[0], bool)
    for s in range(len(hit)):
        if left[s]:
            left[s] = False
            stack = [s]
            while stack:
                k = stack.pop()
                new = np.flatnonzero(hit[k] & todo)
                if len(new):
                    todo[new] = False
                    yield k, new
                    for j in new.tolist():
                        rows = np.flatnonzero(hit[:, j] & left)
                        left[rows] = False
                        stack.extend(rows.tolist())
                        for r in rows.tolist():
                            yield r, np.array([j])


def _bucket_forest(bucket: np.ndarray, side: np.ndarray, rid: np.ndarray, low: np.ndarray, least: int) -> Forest:
    """Spanning forest of the pairs with ``least`` equal sketch bytes in the buckets of one task."""
    order = np.lexsort((rid, side, bucket))
    bucket, side, rid, low = bucket[order], side[order], rid[order], low[order]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    sizes = np.diff(starts)
    forest = Forest()
    small = 8
    for shift in range(1, small):
        i = np.flatnonzero((bucket[:-shift] == bucket[shift:]) if shift < len(bucket) else np.empty(0, bool))
        i = i[np.repeat(sizes, sizes)[i] <= small]
        i = i[side[i] == side[i + shift]]
        for k in i[(low[i] == low[i + shift]).sum(axis=1) >= least]:
            forest.join(int(rid[k]), int(rid[k + shift]))
    for s, n in zip(starts[:-1][sizes > small], sizes[sizes > small]):
        cut = s + int(np.searchsorted(side[s : s + n], 1))
        within = cut == s + n
        left, other = slice(s, cut), slice(s, cut) if within else slice(cut, s + n)
        ids, others = rid[left], rid[other]
        for k, found in spanning(agreements(low[left], low[other]) >= least, within):
            for j in others[found].tolist():
                forest.join(int(ids[k]), j)
    return forest


def _blocks(rows: DataFrame, size: str, key: str, block: int, tasks: int) -> DataFrame:
    """Deal the rows of each ``key`` (with ``size`` rows in all) to tasks.

    A key of up to ``block`` rows goes to one of ``tasks`` shared tasks; a
    larger one is cut into blocks, and each pair of blocks is a task of its
    own.  Adds ``task``, ``bucket`` and ``side``.
    """
    n = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64("rid"), n).cast("int")
    small = rows.filter(F.col(size) <= block).withColumn("task", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(tasks))).withColumn("bucket", F.col(key)).withColumn("side", F.lit(0))
    large = (
        rows.filter(F.col(size) > block)
        .withColumn("own", own)
        .withColumn("with", F.explode(F.sequence(F.lit(0), n - 1)))
        .withColumn("lo", F.least("own", "with"))
        .withColumn("hi", F.greatest("own", "with"))
        .withColumn("task", F.xxhash64(key, "lo", "hi"))
        .withColumn("bucket", F.col("task"))
        .withColumn("side", F.when(F.col("own") > F.col("lo"), 1).otherwise(0))
        .drop("own", "with", "lo", "hi")
    )
    return small.unionByName(large)


def _forest_batch(forest: Forest) -> pa.Table:
    a, b = forest.stars()
    return pa.Table.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def candidate_links(reps: DataFrame, threshold: float, recall: float, bucket: int = 2048, depth: int = 3, boost: float = 2.0) -> DataFrame:
    """(a, b): stars whose components hold, at the target recall, all pairs of ``reps`` (rid, sketch) over the threshold."""
    runs = runs_for(recall, boost, depth)
    rate = boost / (threshold * TOKENS)
    sd = math.sqrt(threshold * (1 - threshold) / TOKENS)
    least = math.ceil(TOKENS * (threshold - SLACK * sd))
    parts = table_parts(reps)

    def first(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rid, tokens = batch.column(0).to_numpy(), _tokens(batch.column(1))
            for run in range(runs):
                row, path = child_paths(np.full(len(rid), run + 1, np.uint64), tokens, rate)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(path)), pa.array(rid[row]), pa.array(np.full(len(row), 1 << 62, np.int64))], names=["path", "rid", "above"])

    def deeper(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rid, path, n = (batch.column(k).to_numpy() for k in (0, 1, 2))
            row, child = child_paths(path.view(np.uint64), _tokens(batch.column(3)), rate)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(child)), pa.array(rid[row]), pa.array(n[row])], names=["path", "rid", "above"])

    def compare(table: pa.Table) -> pa.Table:
        low = _tokens(table.column("sketch")).astype(np.uint8)
        cols = (table.column(c).to_numpy() for c in ("bucket", "side", "rid"))
        return _forest_batch(_bucket_forest(*cols, low, least))

    nodes, links = materialize(reps.select("rid", "sketch").mapInArrow(first, "path long, rid long, above long"), "paths"), None
    for level in range(1, depth + 1):
        sizes = nodes.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
        sized = materialize(nodes.join(sizes, "path"), "sized-paths")
        drop_materialized(nodes)
        last = level == depth
        splits = F.lit(False) if last else (F.col("n") > bucket) & (F.col("n") < F.col("above").cast("double") * 0.7)
        leaf = _blocks(sized.filter(~splits).select("path", "rid", "n"), "n", "path", bucket, parts * 4)
        found = leaf.select("task", "bucket", "side", "rid").join(reps.select("rid", "sketch"), "rid").groupBy("task").applyInArrow(compare, "a long, b long")
        found = materialize(found, "candidate-links")
        links = found if links is None else links.unionByName(found)
        if last or not sized.filter(splits).limit(1).count():
            break
        nodes = materialize(sized.filter(splits).join(reps.select("rid", "sketch"), "rid").select("rid", "path", "n", "sketch").mapInArrow(deeper, "path long, rid long, above long"), "paths")
        drop_materialized(sized)
    return links


def shared(a: list[np.ndarray], b: list[np.ndarray], columns: int = 16_384) -> np.ndarray:
    """The sizes of all intersections of sets in ``a`` with sets in ``b``, as products of incidence matrices, some columns at a time."""
    if len(a) * len(b) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a], dtype=np.int64)
    ka, kb = np.concatenate(a), np.concatenate(b)
    keys = np.intersect1d(ka, kb)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    ca, cb = np.searchsorted(keys, ka), np.searchsorted(keys, kb)
    oka = keys[np.minimum(ca, len(keys) - 1)] == ka if len(keys) else np.zeros(len(ka), bool)
    okb = keys[np.minimum(cb, len(keys) - 1)] == kb if len(keys) else np.zeros(len(kb), bool)
    ra, ca, rb, cb = ra[oka], ca[oka], rb[okb], cb[okb]
    # Columns that all rows share are counted once; columns of one row only meet themselves.
    out = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, len(keys), columns):
        width = min(columns, len(keys) - start)
        ma, mb = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        pa_, pb_ = (ca >= start) & (ca < start + width), (cb >= start) & (cb < start + width)
        ma[ra[pa_], ca[pa_] - start] = 1
        mb[rb[pb_], cb[pb_] - start] = 1
        out += ma @ mb.T
    return np.rint(out).astype(np.int64)


def _shared_within(sets: list[np.ndarray]) -> np.ndarray:
    """``shared`` of a list with itself; shingles of one set only count on the diagonal."""
    keys, count = np.unique(np.concatenate(sets), return_counts=True)
    common = keys[count > 1]
    out = shared(cut := [s[np.isin(s, common, assume_unique=True)] for s in sets], cut) if len(sets) > 4 else shared(sets, sets)
    return out


def verify(members: DataFrame, threshold: float, block: int = 256) -> DataFrame:
    """(rid, other, links): exact link counts (other null) and a spanning forest of the links (links 0).

    ``members``: component, size, rid, copies, shingles of the candidate
    components; all pairs within a component are compared.
    """
    parts = table_parts(members)

    def compare(table: pa.Table) -> pa.Table:
        bucket, side, rid, copies = (table.column(c).to_numpy() for c in ("bucket", "side", "rid", "copies"))
        data = table.column("shingles").to_pylist()
        order = np.lexsort((rid, side, bucket))
        again = np.zeros(len(order), bool)  # repeated rows of the representative
        again[1:] = (np.diff(bucket[order]) == 0) & (np.diff(side[order]) == 0) & (np.diff(rid[order]) == 0)
        order = order[~again]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
        forest, links = Forest(), {}
        for s, e in zip(starts[:-1], starts[1:]):
            rows = order[s:e]
            left, right = rows[side[rows] == 0], rows[side[rows] == 1]
            a = [np.frombuffer(data[k], np.uint64) for k in left]
            within = not len(right)
            if within:
                right, b = left, a
            else:
                b = [np.frombuffer(data[k], np.uint64) for k in right]
            if not len(left):
                continue
            both = _shared_within(a) if within else shared(a, b)
            na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
            hit = both >= threshold * (na[:, None] + nb[None, :] - both) - 1e-9
            if within:
                np.fill_diagonal(hit, False)
            for k, n in zip(left, hit @ copies[right]):
                links[int(rid[k])] = links.get(int(rid[k]), 0) + int(n)
            if not within:
                for k, n in zip(right, copies[left] @ hit):
                    links[int(rid[k])] = links.get(int(rid[k]), 0) + int(n)
            for k, found in spanning(hit, within):
                for j in rid[right[found]].tolist():
                    forest.join(int(rid[left[k]]), j)
        x, y = forest.stars()
        ids = list(links)
        return pa.Table.from_arrays(
            [pa.array([*ids, *x.tolist()], pa.int64()), pa.array([*[None] * len(ids), *y.tolist()], pa.int64()), pa.array([*(links[i] for i in ids), *[0] * len(x)], pa.int64())], names=["rid", "other", "links"]
        )

    dealt = _blocks(members, "size", "component", block, parts * 4)
    return dealt.select("task", "bucket", "side", "rid", "copies", "shingles").groupBy("task").applyInArrow(compare, "rid long, other long, links long")


def ngram_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.995, id_col: str = "doc_id", text_col: str = "text", with_text_hash: bool = False) -> DataFrame:
    """(doc_id, class_id, n_links, kept) of every row: kept marks the document that gives its class the id.

    Of several texts with that id one is marked.  ``with_text_hash`` adds a
    hash of the text, which tells them apart.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def sketch(batches):
        from xxhash import xxh3_128_digest

        hashes = kept("word hashes", WordHashes)
        for batch in batches_by_size(batches):
            sets = shingle_sets(batch.column(1).to_pylist(), n, hashes)
            full = [k for k, s in enumerate(sets) if len(s)]
            sk = sketches([sets[k] for k in full]) if full else []
            sketch_of = [None] * len(sets)
            for k, row in zip(full, sk):
                sketch_of[k] = row.astype("<u4").tobytes()
            sig = [xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sig, pa.binary()), pa.array(sketch_of, pa.binary())], names=["doc_id", "text_hash", "sig", "sketch"])

    # A row is known by its id and a hash of its text: an id may have several texts.
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    table = materialize(hashed.select("doc_id", "text", "text_hash").mapInArrow(sketch, "doc_id long, text_hash long, sig binary, sketch binary"), "sketches")
    sound = table.filter("sig IS NOT NULL AND doc_id IS NOT NULL")
    # One representative row for each set of shingles; ``rid`` numbers the sets.
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    classes = sound.groupBy("sig").agg(first, F.count("*").alias("copies"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("rid"), "sig", "first.*", "copies", "sketch"), "classes")
    reps = classes.select("rid", "sketch")
    links = candidate_links(reps, threshold, recall)
    candidates = materialize(components(links), "candidate-components")
    sizes = candidates.groupBy("component").agg(F.count("*").alias("size"))
    members = candidates.join(sizes, "component").join(classes.select(F.col("rid").alias("id"), "doc_id", "text_hash", "copies"), "id")
    members = members.select(F.col("id").alias("rid"), "component", "size", "copies", "doc_id", "text_hash")

    def shingles(batches):
        hashes = kept("word hashes", WordHashes)
        for batch in batches_by_size(batches):
            out = batch.append_column("shingles", pa.array([s.tobytes() for s in shingle_sets(batch.column(1).to_pylist(), n, hashes)], pa.binary()))
            yield out.select(["rid", "component", "size", "copies", "shingles"])

    text = hashed.join(members, ["doc_id", "text_hash"]).select("rid", "text", "component", "size", "copies")
    sets = text.mapInArrow(shingles, "rid long, component long, size long, copies long, shingles binary")
    verified = materialize(verify(materialize(sets, "shingle-sets"), threshold), "verified")
    counts = verified.filter("other IS NULL").groupBy("rid").agg(F.sum("links").alias("links"))
    final = components(verified.filter("other IS NOT NULL").select(F.col("rid").alias("a"), F.col("other").alias("b")))
    ids = final.withColumnRenamed("id", "rid").join(classes.select("rid", F.struct("doc_id", "text_hash").alias("head")), "rid")
    least = ids.groupBy("component").agg(F.min("head").alias("head"))
    heads = ids.select("rid", "component").join(least, "component").select("rid", "head")
    by_class = classes.select("rid", "sig", F.struct("doc_id", "text_hash").alias("own"), "copies").join(counts, "rid", "left").join(heads, "rid", "left")
    by_class = by_class.select("sig", F.coalesce("head", "own").alias("head"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = table.select("doc_id", "text_hash", F.when(F.col("doc_id").isNotNull(), F.col("sig")).alias("sig")).join(by_class, "sig", "left")
    kept_row = F.coalesce((F.col("head.doc_id") == F.col("doc_id")) & (F.col("head.text_hash") == F.col("text_hash")), F.lit(True))
    out = out.select("doc_id", F.coalesce("head.doc_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), kept_row.alias("kept"), "text_hash")
    return out if with_text_hash else out.drop("text_hash")


def _sized(keys: DataFrame, most: int) -> DataFrame:
    """Keys stored, and broadcast if there are at most ``most`` rows; else Spark shuffles for the join."""
    keys = materialize(keys, "keys")
    return F.broadcast(keys) if keys.count() <= most else keys


def drop_near_copies(docs: DataFrame, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = 200_000) -> DataFrame:
    """One row of each class of ``ngram_join``, the one with the smallest id; all columns unchanged.

    Texts without words stay, but one row of each id and text; rows with a
    null id all stay.  The ids that go are broadcast if they are at most
    ``most_broadcast``.
    """
    columns = docs.columns
    names = [free_name(c, columns) for c in ("gone_id", "gone_text")]
    pair = F.col("doc_id").alias(names[0]), F.col("text_hash").alias(names[1])
    joined = materialize(ngram_join(docs, n, threshold, id_col=id_col, text_col=text_col, with_text_hash=True).filter("doc_id IS NOT NULL"), "joined")
    gone = joined.filter("NOT kept").select(*pair)
    again = materialize(joined.filter("kept").groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows")).filter("rows > 1").select(*pair), "repeated-rows")
    same = (F.col(id_col).cast("long") == F.col(names[0])) & (F.xxhash64(F.col(text_col)) == F.col(names[1]))
    once = docs.join(_sized(gone.unionByName(again).distinct(), most_broadcast), same, "left_anti")
    if again.isEmpty():
        return once
    # Of repeated rows of an id and text one stays, whichever; pre-aggregated, so very many of them do no harm.
    several = docs.join(_sized(again, most_broadcast), same, "left_semi").groupBy(F.col(id_col).alias(names[0]), F.xxhash64(F.col(text_col)).alias(names[1])).agg(F.first(F.struct(*columns)).alias("row")).select("row.*")
    return once.unionByName(several)
