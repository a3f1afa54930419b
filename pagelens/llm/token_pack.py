"""Operator 1: token ids as fixed-width bit-packed binary files.

Each id takes the minimum number of bits that the vocabulary needs.  A file
(one per shard, shards in ascending ``doc_id`` order) is laid out as::

    payload  blocks of packed ids; each block starts on a byte
    docs     doc_id int64[n], valid uint8[n], start uint64[n + 1]               (starts count ids of this file)
    offsets  uint64[blocks + 1]                                                 (byte offset of each block's payload)
    trailer  magic, version, bit width, ids per block, documents, ids, blocks   (little endian)

A reader seeks to the block of any id and unpacks it with numpy alone.  A
writer holds one block and its documents' numbers, not the shard.

A shard has about ``shard_rows`` documents, so shards grow in number with the
corpus, not in size.  Rows of one id that would fill several shards, or of no
id, are divided among these by the hash of their text.

Null, empty and repeated rows: a null or empty text has only the end id; each
row is one document even if its ``doc_id`` repeats or is null (nulls come
first); equal ids are written in order of their text's hash.  An empty table
gives no files and no rows.  Other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_by_size, kept, raw_column, scratch_path

MAGIC = b"PLTOKENS"
TRAILER = "<8sHHIQQQ"
BLOCK_IDS = 65_536


def bit_width(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, width: int) -> bytes:
    """Ids as ``width`` bits each, lowest bit first."""
    if width == 16:
        return ids.astype("<u2").tobytes()
    if width == 32:
        return ids.astype("<u4").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_ids(data: bytes, width: int, count: int) -> np.ndarray:
    if width == 16:
        return np.frombuffer(data, "<u2", count).astype(np.uint32)
    if width == 32:
        return np.frombuffer(data, "<u4", count).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width, bitorder="little").reshape(count, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class ShardReader:
    """Random access to one file: ``ids(a, b)`` reads only the blocks that hold ids a to b."""

    def __init__(self, file):
        self.file = file
        end = file.size() - struct.calcsize(TRAILER)
        file.seek(end)
        magic, version, self.width, self.block, self.n_docs, self.n_ids, self.n_blocks = struct.unpack(TRAILER, file.read(struct.calcsize(TRAILER)))
        if magic != MAGIC or version != 2:
            raise ValueError("not a token file")
        file.seek(end - 8 * (self.n_blocks + 1) - 8 * (self.n_docs + 1) - 9 * self.n_docs)
        self.doc_id = np.frombuffer(file.read(8 * self.n_docs), "<i8")
        self.valid = np.frombuffer(file.read(self.n_docs), np.uint8).astype(bool)
        self.start = np.frombuffer(file.read(8 * (self.n_docs + 1)), "<u8").astype(np.int64)
        self.offset = np.frombuffer(file.read(8 * (self.n_blocks + 1)), "<u8").astype(np.int64)

    def ids(self, a: int, b: int) -> np.ndarray:
        if b <= a:
            return np.empty(0, np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        self.file.seek(int(self.offset[first]))
        data = self.file.read(int(self.offset[last + 1] - self.offset[first]))
        parts = []
        for k in range(first, last + 1):
            at = int(self.offset[k] - self.offset[first])
            parts.append(unpack_ids(data[at : at + int(self.offset[k + 1] - self.offset[k])], self.width, min(self.block, self.n_ids - k * self.block)))
        return np.concatenate(parts)[a - first * self.block : b - first * self.block]


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_TAIL = re.compile(r"^([^\W\d_]+)([^\w\s]*)$")
#: Signs that never join the letters before them.
PLAIN_SIGNS = b'!"#$%&()*+,-./:;=>?@[\\]^`{|}~'


class WordEncoder:
    """Ids of texts under a word-based tokenizer, with a bounded cache of white-space-separated pieces.

    The tokenizer's pre-tokenizer never joins characters across white space,
    and never a letter with a following sign, so a text's ids are the ids of
    its pieces in order.  Every piece is encoded by the tokenizers library.
    Apostrophes keep their piece whole (contractions are single pieces there).
    """

    def __init__(self, path: str, most: int = 600_000):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.most = self.tokenizer.model, most
        self.letters = _byte_letters()  # also a table for str.translate of bytes read as Latin-1
        spec = json.loads(self.tokenizer.to_str())
        self.by_word = spec["model"].get("end_of_word_suffix") == "</w>" and any(n.get("type") == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}  # of whole ids: a place in the arrays
        self.sizes: dict[bytes, int] = {}  # where only lengths are asked for
        self.cores: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}
        self.flat, self.size = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.start = np.empty(0, np.int64)
        self.hits = np.empty(0, np.int32)  # in how many calls

    # Ids of a piece are kept as bytes (little-endian unsigned 32-bit integers): small, and nothing for the garbage collector to visit.

    def whole(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def core(self, core: str) -> bytes:
        """Ids of lower-case letters."""
        ids = self.cores.get(core)
        if ids is None:
            word = core if core.isascii() else core.encode().decode("latin-1").translate(self.letters)
            ids = self.cores[core] = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        return ids

    def sign(self, sign: str) -> bytes:
        ids = self.signs.get(sign)
        if ids is None:
            ids = self.signs[sign] = self.whole(sign)
        return ids

    def piece(self, raw: bytes) -> bytes:
        text = raw.decode()
        m = _TAIL.match(text)
        if not m or "'" in m[2] or "<" in m[2] or "Σ" in text or not m[2].isascii():
            return self.whole(text)
        core, sign = m[1].lower(), m[2]
        if not core.isascii():
            core = unicodedata.normalize("NFC", core)
            if not core.isalpha() or (sign and unicodedata.normalize("NFC", core[-1] + sign) != core[-1] + sign):
                return self.whole(text)
        return self.core(core) + self.sign(sign) if sign else self.core(core)

    def pieces(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of ``words``; most are ASCII letters, with one sign at the end at most."""
        get, core, out = self.cores.get, self.core, []
        for raw, low in zip(words, b" ".join(words).lower().decode().split(" ")):
            if raw.isalpha():
                out.append(get(low) or core(low))
            elif raw[-1] in PLAIN_SIGNS and raw[:-1].isalpha():
                low, sign = low[:-1], low[-1]
                out.append((get(low) or core(low)) + self.sign(sign))
            else:
                out.append(self.piece(raw))
        return out

    def learn(self, words: list[bytes]) -> None:
        """Add the pieces of ``words``, distinct and new, to the cache."""
        ids = self.pieces(words)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.index.update(zip(words, range(len(self.size), len(self.size) + len(ids))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.hits = np.concatenate([self.hits, np.zeros(len(ids), np.int32)])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u4")])

    def forget(self) -> None:
        """Drop what was of use in one call only; all of it, if that would not halve the cache."""
        keep = np.flatnonzero(self.hits > 1)
        if not len(self.index) or len(keep) > self.most // 2:
            self.clear()
            return
        kept_words = list(compress(self.index, self.hits > 1))
        size, start, flat = self.size[keep], self.start[keep], self.flat
        self.clear()
        self.index = dict(zip(kept_words, range(len(kept_words))))
        ends = np.cumsum(size)
        self.flat = flat[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self.size, self.start, self.hits = size, ends - size, np.zeros(len(size), np.int32)

    def words(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """The white-space-separated words of all texts in order, and where each text's begin and end."""
        if len(self.index) + len(self.sizes) > self.most:
            self.forget()
        parts = [t.split() for t in texts]
        return list(chain.from_iterable(parts)), np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text (UTF-8)."""
        if not self.by_word:
            each = [e.ids for e in self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
            return np.array([i for ids in each for i in ids], dtype=np.uint32), np.array([len(x) for x in each], dtype=np.int64)
        words, edges = self.words(texts)
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            late = [words[k] for k in new]
            self.learn(list(dict.fromkeys(late)))
            at[new] = np.fromiter(map(self.index.get, late), np.int64, len(late))
        self.hits[at] += 1
        sizes = self.size[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.start[at] - ends[:-1], sizes) + np.arange(int(ends[-1]))]
        return ids, ends[edges[1:]] - ends[edges[:-1]]

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """The number of ids of each text."""
        if not self.by_word:
            return self.encode(texts)[1]
        words, edges = self.words(texts)
        known = self.sizes
        sizes = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(sizes < 0)
        if len(new):
            late = [words[k] for k in new]
            fresh = list(dict.fromkeys(late))
            known.update((w, len(ids) // 4) for w, ids in zip(fresh, self.pieces(fresh)))
            sizes[new] = np.fromiter(map(known.get, late), np.int64, len(late))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ends[edges[1:]] - ends[edges[:-1]]


def encoder(path: str) -> WordEncoder:
    return kept(("encoder", path), lambda: WordEncoder(path))


class Shards:
    """Which shard a row belongs to: by ranges of ids, and by ranges of the text's hash for ids that fill several shards."""

    def __init__(self, quantiles: list[int], null_shards: int):
        """``quantiles``: ids that divide the rows evenly; one that comes again fills as many shards."""
        bounds, times = np.unique(np.array(quantiles, np.int64), return_counts=True)
        self.bounds, self.times = bounds, times
        # Each bound closes a shard, or, if it comes again, one of the ids before it and some of its own.
        width = np.where(times > 1, 1 + times, 1)
        self.first = null_shards + np.cumsum(width) - width
        self.null_shards, self.count = null_shards, null_shards + int(width.sum()) + 1

    def of(self, ids: np.ndarray, valid: np.ndarray, text_hash: np.ndarray) -> np.ndarray:
        share = (text_hash.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(np.float64) / 2.0**64
        at = np.searchsorted(self.bounds, ids, "left")
        out = np.append(self.first, self.count - 1)[at]
        inside = np.minimum(at, max(0, len(self.bounds) - 1))
        hot = (at < len(self.bounds)) & (self.bounds[inside] == ids) & (self.times[inside] > 1) if len(self.bounds) else np.zeros(len(ids), bool)
        out = np.where(hot, out + 1 + np.minimum((share * self.times[inside]).astype(np.int64), self.times[inside] - 1) if len(self.bounds) else out, out)
        return np.where(valid, out, np.minimum((share * self.null_shards).astype(np.int64), max(0, self.null_shards - 1)))


def plan_shards(docs: DataFrame, shard_rows: int, id_col: str) -> Shards | None:
    """Shards of about ``shard_rows`` rows; None for an empty table.  Only ids are read, so texts are read and encoded once."""
    key = F.col(id_col).cast("long")
    rows, ids = docs.agg(F.count(F.lit(1)), F.count(key)).first()
    if not rows:
        return None
    wanted = -(-rows // shard_rows)
    nulls = -(-wanted * (rows - ids) // rows)
    parts = max(1, wanted - nulls)
    quantiles = docs.select(F.percentile_approx(key, [k / parts for k in range(1, parts)], min(100 * parts, 1_000_000))).first()[0] if parts > 1 else []
    return Shards(quantiles or [], nulls)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: Shards | None = None) -> DataFrame:
    """(doc_id, text_hash, n_tokens, ids, shard): ids as little-endian unsigned 16- or 32-bit integers, the end id included; shard is 0 without ``shards``."""
    sent = docs.sparkSession.sparkContext.broadcast(shards)

    def run(batches):
        enc, where = encoder(tokenizer), sent.value
        kind = "<u2" if bit_width(enc.tokenizer.get_vocab_size()) <= 16 else "<u4"
        for batch in batches_by_size(batches):
            ids, sizes = enc.encode(raw_column(batch, 1))
            data = np.insert(ids, np.cumsum(sizes), end_id).astype(kind).tobytes()
            ends = np.concatenate([[0], np.cumsum(sizes + 1)]) * int(kind[-1])
            out = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype("<i8").tobytes()), pa.py_buffer(data)]).cast(pa.binary())
            shard = np.zeros(len(sizes), np.int64)
            if where is not None:
                shard = where.of(pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False), np.asarray(pc.is_valid(batch.column(0)).to_numpy(zero_copy_only=False)), batch.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes + 1, pa.int64()), out, pa.array(shard, pa.int32())], names=["doc_id", "text_hash", "n_tokens", "ids", "shard"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_tokens long, ids binary, shard int")


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_rows: int = 8192, block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` and write one file per shard below ``path`` (a URI that all executors reach).

    A task writes to a name of its own and renames it at the end: a repeated
    task leaves one whole file.  Returns the manifest (shard, file, n_docs,
    n_tokens), ordered by shard.
    """
    from tokenizers import Tokenizer

    schema = "shard int, file string, n_docs long, n_tokens long"
    width = bit_width(Tokenizer.from_file(tokenizer).get_vocab_size())
    shards = plan_shards(docs, shard_rows, id_col)
    if shards is None:
        return docs.sparkSession.createDataFrame([], schema)
    encoded = encode_documents(docs, tokenizer, end_id, id_col, text_col, shards)
    placed = encoded.repartitionById(shards.count, F.col("shard")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text_hash").select("doc_id", "n_tokens", "ids", "shard")
    kind = "<u2" if width <= 16 else "<u4"

    def write(batches):
        where, base = _open(path)
        where.create_dir(base, recursive=True)
        batches = (b for b in batches if b.num_rows)
        batch = next(batches, None)
        if batch is None:
            return
        shard = batch.column(3)[0].as_py()
        name, temp = f"{base}/shard-{shard:06d}.bin", f"{base}/.{uuid.uuid4().hex}.part"
        docs_, valid, sizes, offsets, held, held_ids = [], [], [], [0], [], 0
        with where.open_output_stream(temp) as out:

            def flush(ids: np.ndarray):
                for k in range(0, len(ids), block_ids):
                    data = pack_ids(ids[k : k + block_ids], width)
                    out.write(data)
                    offsets.append(offsets[-1] + len(data))

            for batch in chain([batch], batches):
                valid.append(np.asarray(pc.is_valid(batch.column(0)).to_numpy(zero_copy_only=False)))
                docs_.append(pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False))
                sizes.append(batch.column(1).to_numpy(zero_copy_only=False))
                held.append(np.frombuffer(b"".join(batch.column(2).to_pylist()), kind))
                held_ids += len(held[-1])
                if held_ids >= block_ids:
                    ids = np.concatenate(held)
                    cut = len(ids) // block_ids * block_ids
                    flush(ids[:cut])
                    held, held_ids = [ids[cut:].copy()], len(ids) - cut
            flush(np.concatenate(held))
            doc_id, ok, size = np.concatenate(docs_), np.concatenate(valid), np.concatenate(sizes)
            total = int(size.sum())
            out.write(doc_id.astype("<i8").tobytes() + ok.astype(np.uint8).tobytes())
            out.write(np.concatenate([[0], np.cumsum(size)]).astype("<u8").tobytes())
            out.write(np.array(offsets, "<u8").tobytes())
            out.write(struct.pack(TRAILER, MAGIC, 2, width, block_ids, len(doc_id), total, len(offsets) - 1))
        where.move(temp, name)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [f"shard-{shard:06d}.bin"], "n_docs": pa.array([len(doc_id)], pa.int64()), "n_tokens": pa.array([total], pa.int64())})

    # One row per shard, not per document: the manifest is small by construction.
    rows = placed.mapInArrow(write, schema).collect()
    return docs.sparkSession.createDataFrame(sorted(tuple(r) for r in rows), schema)


def read_tokens(manifest: DataFrame, path: str, per_read: int = 2_000_000) -> DataFrame:
    """Read the files of ``write_tokens`` back: (doc_id, start, n_tokens, ids_crc32), one row per document.

    Files are read in parallel, a bounded run of blocks at a time.
    """
    spark = manifest.sparkSession
    rows = [r.asDict() for r in manifest.orderBy("shard").collect()]
    first = 0
    for r in rows:
        r["first"], first = first, first + r["n_tokens"]
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.createDataFrame([(r["shard"], r["file"], r["first"]) for r in rows], "shard int, file string, first long").repartitionById(len(rows), F.col("shard"))

    def read(batches):
        where, base = _open(path)
        for batch in batches:
            for name, before in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                with where.open_input_file(f"{base}/{name}") as file:
                    shard = ShardReader(file)
                    start = shard.start
                    a = 0
                    while a < shard.n_docs:
                        b = max(a + 1, int(np.searchsorted(start, start[a] + per_read, "right")) - 1)
                        b = min(b, shard.n_docs)
                        ids = shard.ids(int(start[a]), int(start[b])).astype("<u4")
                        crc = [zlib.crc32(ids[start[k] - start[a] : start[k + 1] - start[a]].tobytes()) for k in range(a, b)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(shard.doc_id[a:b], pa.int64(), mask=~shard.valid[a:b]), pa.array(before + start[a:b], pa.int64()), pa.array(np.diff(start[a : b + 1]), pa.int64()), pa.array(crc, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        a = b

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def pack_and_read(docs: DataFrame, tokenizer: str, end_id: int = 1, **options) -> DataFrame:
    """Write ``docs`` into a new folder of the shared space and read it back."""
    path = scratch_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, path, tokenizer, end_id, **options), path)
