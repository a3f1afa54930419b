"""Encodings of bytes: byte order marks, validity of UTF-8 and UTF-16, then statistics of each code page.

The statistics are counted by Spark on texts that the caller gives, encoded in
each page: of byte pairs, at most 65,536 counts a page, or of wider windows, at
most a million a page, whatever the texts.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import in_pieces

#: Byte order marks, longer ones first.
MARKS = ((codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
#: Pages by default: western Windows, Macintosh and DOS.
PAGES = ("cp1252", "mac_roman", "cp850")
PAIRS = 65536
#: Bytes of a window, and the numbers that windows are hashed to.
WIDTH = 5
WINDOWS = 1 << 20


def high_pairs(data: bytes) -> np.ndarray:
    """Numbers of the pairs of neighbours of which one is no ASCII."""
    a = np.frombuffer(data, np.uint8)
    p = a[:-1].astype(np.int64) * 256 + a[1:]
    return p[(a[:-1] | a[1:]) > 127]


def high_windows(data: bytes) -> np.ndarray:
    """Numbers of the different windows of which some byte is no ASCII; a repeated word counts once."""
    a = np.frombuffer(b" " * (WIDTH - 2) + data + b" " * (WIDTH - 2), np.uint8)
    if len(a) < WIDTH:
        return np.zeros(0, np.int64)
    start = (np.flatnonzero(a > 127)[:, None] - np.arange(WIDTH)).ravel()
    start = start[(start >= 0) & (start <= len(a) - WIDTH)]
    w = np.zeros(len(start), np.uint64)
    for k in range(WIDTH):
        w = w * np.uint64(256) + a[start + k]
    return np.unique((np.unique(w) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def pair_counts(texts: DataFrame, pages: tuple[str, ...] = PAGES) -> DataFrame:
    """(page, pair, n) of all ``texts`` (text) in each page, without the characters that it lacks; counted in each task before they are shuffled."""

    def run(batches):
        counts = np.zeros((len(pages), PAIRS), np.int64)
        for b in batches:
            for s in b.column("text").drop_null():
                for k, page in enumerate(pages):
                    # A space before and after: the ends of a text are ends of words.
                    pair, n = np.unique(high_pairs(b" " + s.as_py().encode(page, "ignore") + b" "), return_counts=True)
                    counts[k, pair] += n
        at, pair = counts.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array([pages[k] for k in at], pa.string()), pa.array(pair, pa.int32()), pa.array(counts[at, pair], pa.int64())], ["page", "pair", "n"])

    return texts.select("text").mapInArrow(run, "page string, pair int, n long").groupBy("page", "pair").agg(F.sum("n").alias("n"))


def window_shares(texts: DataFrame, pages: tuple[str, ...] = PAGES) -> np.ndarray:
    """As ``model``, of windows: the texts (text) that have each in each page.  A window that none has weighs more than common ones can make good."""

    def run(batches):
        counts = np.zeros((len(pages), WINDOWS), np.int64)
        for b in batches:
            for s in b.column("text").drop_null():
                text = s.as_py()
                if not text.isascii():
                    for k, page in enumerate(pages):
                        counts[k, high_windows(b" " + text.encode(page, "ignore") + b" ")] += 1
        counts = counts.ravel()
        at = counts.nonzero()[0]
        for k in range(0, len(at), PAIRS):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + PAIRS], pa.int32()), pa.array(counts[at[k : k + PAIRS]], pa.int64())], ["at", "n"])

    counts = texts.select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(len(pages) * WINDOWS)
    n[counts["at"].to_numpy()] = counts["n"].to_numpy()
    n = n.reshape(len(pages), WINDOWS)
    return np.log((n + 0.001) / (n.sum(axis=1, keepdims=True) + 0.001 * WINDOWS)).astype(np.float32)


def model(counts: DataFrame, pages: tuple[str, ...] = PAGES) -> np.ndarray:
    """Logarithms of the pairs' smoothed shares, a row for each page."""
    n = np.zeros((len(pages), PAIRS))
    for r in counts.filter(F.col("page").isin(*pages)).toLocalIterator():
        n[pages.index(r["page"]), r["pair"]] = r["n"]
    return np.log((n + 0.5) / (n.sum(axis=1, keepdims=True) + 0.5 * PAIRS)).astype(np.float32)


def _decodes(data: bytes, encoding: str) -> str | None:
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return None


def detect(data: bytes, shares: np.ndarray, pages: tuple[str, ...] = PAGES) -> tuple[str, str]:
    """(encoding, text).  A mark decides if the rest is valid; then UTF-16 (zero bytes on one side only), UTF-8, the likeliest page that has all bytes, ISO-8859-1.

    ``shares``: of pairs (``model``) or of windows (``window_shares``).
    """
    for mark, encoding in MARKS:
        if data.startswith(mark) and (text := _decodes(data[len(mark) :], encoding)) is not None:
            return encoding, text
    if len(data) % 2 == 0 and (data.count(0) > 0):
        even, odd = data[::2].count(0), data[1::2].count(0)
        for encoding, zeros, others in (("utf-16-le", odd, even), ("utf-16-be", even, odd)):
            if zeros > 4 * others and (text := _decodes(data, encoding)) is not None:
                return encoding, text
    if (text := _decodes(data, "utf-8")) is not None:
        return "utf-8", text
    grams = high_pairs if shares.shape[1] == PAIRS else high_windows
    likely = shares[:, grams(b" " + data + b" ")].sum(axis=1, dtype=np.float64)
    for k in np.argsort(-likely, kind="stable"):
        if (text := _decodes(data, pages[k])) is not None:
            return pages[k], text
    return "iso-8859-1", data.decode("iso-8859-1")


def detector(shares: np.ndarray, pages: tuple[str, ...] = PAGES) -> Callable[[Column], Column]:
    """struct(encoding, text) of a binary column; null stays null."""

    def each(rows: list) -> list:
        return [None if v is None else dict(zip(("encoding", "text"), detect(v, shares, pages))) for v in rows]

    def run(col: pa.Array) -> pa.Array:
        return in_pieces(each, pa.struct([("encoding", pa.string()), ("text", pa.string())]), col)

    return F.arrow_udf(run, "struct<encoding:string,text:string>")
