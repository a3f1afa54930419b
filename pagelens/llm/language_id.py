"""Operator 2: language identification by language-bitmask n-gram filters.

Training counts the byte n-grams of all training texts per language.  An
n-gram belongs to a language if it is frequent enough there in relation to
the language that uses it most.  A bit-sliced Bloom filter keeps, for each of
its positions, a word with one bit per language: ANDing an n-gram's positions
returns all languages that contain it at once.  A text's popcounts per
language, corrected for each slice's false-positive rate, decide.

The filter grows with its n-grams, so its false-positive rate does not.  A
language keeps n-grams of at least ``least_rate`` of its own, so it has at
most 1 / ``least_rate`` of them, however large the corpus.

Null texts and texts without letters are ``und`` with score 0.  Ties go to
the language with more training text, then to the smaller name.  Without any
training row every text is ``und``.  Repeated rows count as often as they
occur; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import batches_by_size, held_out, mix64, table_parts

GRAM_BYTES = 4
HASHES = 4
LANGUAGES_PER_WORD = 63


def _letters_only() -> bytes:
    """ASCII signs and digits become spaces; other bytes stand for themselves."""
    return bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


CLEAN = _letters_only()


def grams(text: str) -> np.ndarray:
    """The byte 4-grams of a text's lower-case letters as integers; grams over two separate spaces in a row are left out."""
    raw = np.frombuffer(b" " + text.lower().encode().translate(CLEAN) + b" ", np.uint8)
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    raw = raw[keep].astype(np.uint32)
    if len(raw) < GRAM_BYTES:
        return np.empty(0, np.uint32)
    return raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24


def positions(keys: np.ndarray, size: int) -> list[np.ndarray]:
    """The HASHES positions of each key in a filter of ``size`` (a power of 2) words."""
    h = mix64(keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = (h >> np.uint64(32)) | np.uint64(1)
    mask = np.uint64(size - 1)
    with np.errstate(over="ignore"):
        return [((h + np.uint64(k) * step) & mask).astype(np.int64) for k in range(HASHES)]


class Filters:
    """The bit-sliced filter: ``words[plane][position]`` has a bit for each language."""

    def __init__(self, languages: list[str], words: list[np.ndarray]):
        self.languages, self.words = languages, words
        self.size = len(words[0]) if words else 0
        self.rates = np.array([float(np.mean((words[k // LANGUAGES_PER_WORD] >> np.uint64(k % LANGUAGES_PER_WORD)) & np.uint64(1))) ** HASHES for k in range(len(languages))])

    def counts(self, keys: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Popcounts per text (rows, bounded by ``edges``) and language (columns)."""
        at = positions(keys, self.size)
        out = np.zeros((len(edges) - 1, len(self.languages)), np.int64)
        for plane, words in enumerate(self.words):
            found = words[at[0]]
            for p in at[1:]:
                found = found & words[p]
            for k in range(LANGUAGES_PER_WORD * plane, min(len(self.languages), LANGUAGES_PER_WORD * (plane + 1))):
                sums = np.concatenate([[0], np.cumsum((found >> np.uint64(k % LANGUAGES_PER_WORD)) & np.uint64(1), dtype=np.int64)])
                out[:, k] = sums[edges[1:]] - sums[edges[:-1]]
        return out

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        each = [grams(t) if t and any(map(str.isalpha, t)) else None for t in texts]
        sizes = np.array([0 if g is None else len(g) for g in each], dtype=np.int64)
        if not self.languages or not len(each):
            return ["und"] * len(each), np.zeros(len(each))
        edges = np.concatenate([[0], np.cumsum(sizes)])
        keys = np.concatenate([g for g in each if g is not None] or [np.empty(0, np.uint32)])
        counts = self.counts(keys, edges)
        corrected = np.maximum(0.0, (counts - sizes[:, None] * self.rates) / (1 - np.minimum(self.rates, 0.999)))
        best = corrected.argmax(axis=1)
        total = corrected.sum(axis=1)
        top = corrected[np.arange(len(best)), best]
        share = np.where(total > 0, top / np.maximum(total, 1e-9), 0.0)
        names = ["und" if g is None else self.languages[k] for g, k in zip(each, best)]
        return names, np.where([g is None for g in each], 0.0, np.clip(share, 0.0, 1.0))


def gram_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, n) partial counts of all rows with a language."""

    def flush(held: dict[str, list]):
        for lang, parts in held.items():
            keys, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            n = np.bincount(which, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
            held[lang] = [(keys, n)]
        return held

    def run(batches):
        held: dict[str, list] = {}
        size = 0
        for batch in batches_by_size(batches):
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    by.setdefault(lang, []).append(grams(text))
            for lang, parts in by.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                held.setdefault(lang, []).append((keys, n))
                size += len(keys)
            if size > 4_000_000:
                held = flush(held)
                size = sum(len(p[0][0]) for p in held.values())
                if size > 2_000_000:  # very many distinct n-grams: pass them on, Spark adds them up
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(flush(held))

    def rows(held):
        for lang, parts in held.items():
            for keys, n in parts:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64), pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    return docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "lang string, gram long, n long")


def filter_size(n: int, bits_per_gram: int) -> int:
    """Positions of a filter of ``n`` n-grams: at most HASHES / ``bits_per_gram`` of them are set, so that share to the power of HASHES is the false-positive rate at most."""
    return 1 << max(12, (max(1, n) * bits_per_gram - 1).bit_length())


def train(docs: DataFrame, least: int = 3, least_rate: float = 1e-6, ratio: float = 0.15, bits_per_gram: int = 16, most_bytes: int = 1 << 30, lang_col: str = "lang", text_col: str = "text") -> Filters:
    """Filters from every row of ``docs`` that has a language.

    ``least``: an n-gram's occurrences in a language; ``least_rate``: its
    relative frequency there; ``ratio``: that frequency over the highest of all
    languages.  With 16 bits an n-gram the false-positive rate of a slice is
    0.4 % at most.  A filter that would take more than ``most_bytes`` raises an
    error (which 1,000,000 n-grams for each of some sixty languages may do).
    """
    from .common import drop_materialized, materialize

    counts = materialize(gram_counts(docs, lang_col, text_col).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # one row per language
    languages = sorted(totals, key=lambda k: (-totals[k], k))
    if not languages:
        return Filters([], [])
    spark = docs.sparkSession
    own = F.broadcast(spark.createDataFrame([(k, i, float(totals[k])) for i, k in enumerate(languages)], "lang string, bit int, total double"))
    kept = (
        counts.join(own, "lang")
        .withColumn("rate", F.col("n") / F.col("total"))
        .withColumn("top", F.max("rate").over(W.partitionBy("gram")))
        .filter((F.col("n") >= least) & (F.col("rate") >= least_rate) & (F.col("rate") >= ratio * F.col("top")))
        .groupBy("gram")
        .agg(F.collect_set("bit").alias("bits"))
    )
    kept = materialize(kept, "kept-grams")
    n = kept.count()
    size = filter_size(n, bits_per_gram)
    planes = -(-len(languages) // LANGUAGES_PER_WORD)
    if size * planes * 8 > most_bytes:
        raise ValueError(f"filters of {n} n-grams take {size * planes * 8} bytes, more than most_bytes = {most_bytes}; raise that or least_rate")

    def place(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            bits = batch.column(1).to_pylist()
            at = positions(keys, size)
            for plane in range(planes):
                mask = np.array([sum(1 << (b % LANGUAGES_PER_WORD) for b in bs if b // LANGUAGES_PER_WORD == plane) for bs in bits], dtype=np.int64)
                where = np.concatenate(at)
                yield pa.RecordBatch.from_arrays([pa.array([plane] * len(where), pa.int32()), pa.array(where, pa.int64()), pa.array(np.tile(mask, HASHES), pa.int64())], names=["plane", "pos", "mask"])

    # At most HASHES positions of each n-gram, within ``most_bytes``.
    got = kept.repartition(table_parts(kept), "gram").mapInArrow(place, "plane int, pos long, mask long").groupBy("plane", "pos").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = [np.zeros(size, np.uint64) for _ in range(planes)]
    plane, pos, mask = (got.column(c).to_numpy() for c in ("plane", "pos", "mask"))
    for k in range(planes):
        words[k][pos[plane == k]] = mask[plane == k].astype(np.uint64)
    for t in (counts, kept):
        drop_materialized(t)
    return Filters(languages, words)


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.words))

    def run(batches):
        own = Filters(*sent.value)
        for batch in batches_by_size(batches):
            names, scores = own.decide(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def predict_documents(docs: DataFrame, modulus: int = 4) -> DataFrame:
    """Learn from the rows that are not held out, predict all: (doc_id, held_out, lang_pred, score)."""
    filters = train(docs.filter(~held_out("doc_id", modulus)))
    return identify(docs, filters).withColumn("held_out", held_out("doc_id", modulus)).select("doc_id", "held_out", "lang_pred", "score")
