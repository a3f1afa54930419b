"""Operator 10: language-model scores by a weighted backoff automaton.

Training counts all n-grams of up to ``order`` tokens in the documents that
are not held out.  Dirichlet priors smooth them: a context h is given ``prior``
virtual tokens that follow the distribution of its suffix h',

    p(w)     = (c(w) + 1) / (N + V + 1)          an unseen word is one virtual type
    p(w | h) = (c(h w) + prior p(w | h')) / (c(h) + prior)

In the automaton every seen n-gram of less than ``order`` tokens is a state.
It has an arc for each token seen after it, of weight log p(w | h), and a
failure arc of weight log(prior / (c(h) + prior)) to the state of its suffix;
the start state has an arc for every token.  A text is read once from left to
right: where the state has no arc for the token, failure arcs are followed
until a state has one; the state after it is carried to the next token.

The automaton grows with the corpus and is never sent to every executor.
Documents are dealt to blocks of bounded size.  A block sends its n-grams, as
sorted hash keys with its own training counts, to the parts that add them up;
a part is a range of keys, and answers a block with what differs from the
block's own counts.  So each block holds the part of the automaton that its
own texts can reach.  An n-gram occurs once in a block's message however
frequent it is, so no part is hot.  A block sends to ``fan_out`` parts at most:
with more blocks, messages of that many blocks are merged, divided again and
passed on, so the number of messages grows with the corpus (times the number
of hops, a logarithm), not with its square.  All n-grams are kept.

Keys of words have 62 bits.  Keys of longer n-grams have 20 bits more than it
takes to number all of the corpus, so that one in a million may be taken for
another.  Null and empty texts have one token, the end.  Repeated rows are
documents of their own; a null id is in training.  Without training text every
probability is 1.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_A, MIX_B, WordHashes, held_out, mix64

#: The hash of the end token; no word has it but by a 64-bit coincidence.
END = 0x5851F42D4C957F2D
WORD_BITS = 62
#: Steps of one sweep over many texts; a longer text is read in pieces, each from the state that the piece before leaves.
SWEEP = 2048


def pack_array(x: np.ndarray, steps: bool = False) -> bytes:
    """Integers for a shuffle: as differences if ``steps`` (ascending numbers), by byte planes, compressed."""
    import zstandard

    x = np.asarray(x).astype(np.uint64)
    if steps:
        x = np.diff(x, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_array(data: bytes, steps: bool = False) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    x = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.cumsum(x, dtype=np.uint64) if steps else x


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text without the end: ASCII letters in lower case, split at ASCII white space."""
    return text.lower().split() if text else []


class Block:
    """The n-grams of one block's documents: per order their sorted keys, own training counts, and where they end in the texts."""

    def __init__(self, texts: list[bytes | None], train: np.ndarray, bits: list[int]):
        words = WordHashes(most=1 << 62)
        hashes, end = [], np.array([END], np.uint64)
        for t in texts:  # one text's words at a time
            hashes += [words(tokens(t)), end]
        self.sizes = np.array([len(h) + 1 for h in hashes[::2]], dtype=np.int64)
        word = np.concatenate(hashes)
        del hashes, words
        self.starts = np.cumsum(self.sizes) - self.sizes
        weight = np.repeat(train, self.sizes)
        self.keys, self.counts, self.at, self.one = [], [], [], []
        whole, left = mix64(word * MIX_A), np.ones(len(word), bool)
        for k, b in enumerate(bits):
            if k:
                # An n-gram from the one before it, less its first token, and its last: none ends in a text's first tokens.
                left = left & np.concatenate([[False], left[:-1]])
                left[self.starts] = False
                with np.errstate(over="ignore"):
                    whole = mix64(np.concatenate([whole[:1], whole[:-1]]) * MIX_B + word)
            ends = np.flatnonzero(left)
            keys, one, at = np.unique(whole[ends] >> np.uint64(64 - b), return_index=True, return_inverse=True)
            # Positions without an n-gram of this order point behind the last one.
            where = np.full(len(word), len(keys), np.int32)
            where[ends] = at
            self.keys.append(keys)
            self.one.append(ends[one])
            self.at.append(where)
            self.counts.append(np.bincount(at[weight[ends]], minlength=len(keys)).astype(np.int64))


def ranges(bits: int, part: int, of: int, into: int) -> np.ndarray:
    """Bounds of ``into`` equal ranges of the keys of one of ``of`` equal ranges."""
    return np.array([(((part * into + k) << bits) + of * into - 1) // (of * into) for k in range(into + 1)], np.uint64)


class Merged:
    """Equal keys of several messages, added up: per order the keys, their counts, and each message's place among them."""

    def __init__(self, messages: list[list[tuple[np.ndarray, np.ndarray]]]):
        self.messages = messages
        self.keys, self.counts, self.at = [], [], []
        for k in range(len(messages[0])):
            keys, at = np.unique(np.concatenate([m[k][0] for m in messages]), return_inverse=True)
            self.counts.append(np.bincount(at, weights=np.concatenate([m[k][1] for m in messages]).astype(np.float64), minlength=len(keys)).astype(np.int64))
            self.keys.append(keys)
            self.at.append(np.split(at, np.cumsum([len(m[k][0]) for m in messages])[:-1]))

    def answers(self):
        """For each message, per order, the positions of counts that others change, and those counts."""
        for i, m in enumerate(self.messages):
            out = []
            for k, (_, own) in enumerate(m):
                total = self.counts[k][self.at[k][i]]
                changed = np.flatnonzero(total != own.astype(np.int64))
                out.append((changed, total[changed]))
            yield out


class Automaton:
    """The states, arcs and failure arcs that one block's texts can reach; ``counts`` are those of the whole corpus."""

    def __init__(self, block: Block, counts: list[np.ndarray], n: int, v: int, prior: float):
        self.block, self.n = block, n
        self.known = [np.append(c > 0, False) for c in counts]
        p, self.arc, self.failure = None, [], []
        for k, c in enumerate(counts):
            if k == 0:
                p = (c + 1) / (n + v + 1) if n else np.ones(len(c))
            else:
                # Any occurrence of an n-gram tells its suffix and its context.
                one = block.one[k]
                context = counts[k - 1][block.at[k - 1][one - 1]]
                p = (c + prior * p[block.at[k - 1][one]]) / (context + prior)
            with np.errstate(invalid="ignore"):
                self.arc.append(np.append(np.where((c > 0) | (k == 0), np.log10(p), np.nan), np.nan))
            self.failure.append(np.append(np.log10(prior / (c + prior)), 0.0))

    def read(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per document: the model's log10 probability, the base score and the number of seen tokens."""
        b = self.block
        order = len(self.arc)
        # Texts in pieces of up to SWEEP tokens, the longest first; all take their next token together.
        pieces = -(-b.sizes // SWEEP)
        doc = np.repeat(np.arange(len(b.sizes)), pieces)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = b.starts[doc] + number * SWEEP
        length = np.minimum(SWEEP, b.sizes[doc] - number * SWEEP)
        by_length = np.argsort(-length, kind="stable")
        first, length, doc, number = first[by_length], length[by_length], doc[by_length], number[by_length]
        # A state is the number of its tokens: the longest seen n-gram, of less than ``order`` tokens, that ends here.
        state = np.zeros(len(first), np.int8)
        for k in range(order - 1):
            state[(number > 0) & self.known[k][b.at[k][np.maximum(first - 1, 0)]]] = k + 1
        total = np.zeros(len(first))
        reading = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
        for t, m in enumerate(reading.tolist()):
            at, now, sums = first[:m] + t, state[:m], total[:m]
            after = np.full(m, -1, np.int8)
            for k in range(order - 1, 0, -1):
                here = np.flatnonzero((now == k) & (after < 0))
                if len(here):
                    arc = self.arc[k][b.at[k][at[here]]]
                    fails = np.isnan(arc)
                    sums[here] += np.where(fails, self.failure[k - 1][b.at[k - 1][at[here] - 1]], arc)
                    now[here[fails]] = k - 1
                    after[here[~fails]] = min(k + 1, order - 1)
            here = np.flatnonzero(after < 0)
            word = b.at[0][at[here]]
            sums[here] += self.arc[0][word]
            after[here] = np.minimum(self.known[0][word], order - 1)
            state[:m] = after
        return np.bincount(doc, weights=total, minlength=len(b.sizes)), np.add.reduceat(self.arc[0][b.at[0]], b.starts), np.add.reduceat(self.known[0][b.at[0]].astype(np.int64), b.starts)


def hops(blocks: int, parts: int, fan_out: int) -> list[int]:
    """Into how many ranges keys are divided at each hop."""
    out = []
    while blocks > fan_out:
        out.append(fan_out)
        blocks, parts = -(-blocks // fan_out), -(-parts // fan_out)
    return [*out, max(1, min(parts, 4 * fan_out))]


def lm_score(docs: DataFrame, modulus: int = 7, order: int = 3, prior: float = 64.0, block_bytes: int = 8_000_000, part_bytes: int = 12_000_000, fan_out: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``block_bytes`` of text make a block, ``part_bytes`` of text a part.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    radix = hops(n_blocks, -(-size // part_bytes), fan_out)
    bits = [WORD_BITS, *[min(WORD_BITS, max(40, size.bit_length() + 20))] * (order - 1)]
    block = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n_blocks)).cast("long")
    dealt = docs.withColumn("held_out", held_out("doc_id", modulus)).withColumn("block", block).repartition(n_blocks, "block")

    sent = [f"{c}{k}" for k in range(order) for c in ("keys", "counts")]
    told = [f"{c}{k}" for k in range(order) for c in ("places", "sums")]
    sent_type = "part long, block long, " + ", ".join(f"{c} binary" for c in sent)
    told_type = "part long, block long, " + ", ".join(f"{c} binary" for c in told) + ", n long, v long"

    def of_table(table: pa.Table) -> Block:
        return Block(table.column("text").cast(pa.binary()).to_pylist(), ~np.asarray(table.column("held_out").to_pylist(), dtype=bool), bits)

    def cuts(keys: list[np.ndarray], part: int, of: int, into: int) -> list[np.ndarray]:
        return [np.searchsorted(x, ranges(b, part, of, into)) for x, b in zip(keys, bits)]

    def packed(keys: list[np.ndarray], counts: list[np.ndarray], sender: int, part: int, of: int, into: int) -> pa.Table:
        """A message to each of ``into`` ranges of a range."""
        edges = cuts(keys, part, of, into)
        cols = []
        for x, c, e in zip(keys, counts, edges):
            cols.append(pa.array([pack_array(x[e[p] : e[p + 1]], True) for p in range(into)], pa.binary()))
            cols.append(pa.array([pack_array(c[e[p] : e[p + 1]]) for p in range(into)], pa.binary()))
        return pa.Table.from_arrays([pa.array([part * into + p for p in range(into)], pa.int64()), pa.array([sender] * into, pa.int64()), *cols], names=["part", "block", *sent])

    def merged(table: pa.Table) -> Merged:
        cols = [table.column(c).to_pylist() for c in sent]
        return Merged([[(unpack_array(cols[2 * k][i], True), unpack_array(cols[2 * k + 1][i])) for k in range(order)] for i in range(table.num_rows)])

    def replies(m: Merged, table: pa.Table, n: int, v: int) -> pa.Table:
        cols = [[] for _ in told]
        for reply in m.answers():
            for k, (places, sums) in enumerate(reply):
                cols[2 * k].append(pack_array(places, True))
                cols[2 * k + 1].append(pack_array(sums))
        rows = table.num_rows
        return pa.Table.from_arrays([table.column("part"), table.column("block"), *(pa.array(c, pa.binary()) for c in cols), pa.array([n] * rows, pa.int64()), pa.array([v] * rows, pa.int64())], names=["part", "block", *told, "n", "v"])

    def learn(keys: list[np.ndarray], counts: list[np.ndarray], answers: pa.Table, part: int, of: int, into: int) -> tuple[list[np.ndarray], int, int]:
        """``counts`` with what the answers change, and the sums of N and V."""
        edges = cuts(keys, part, of, into)
        counts = [c.copy() for c in counts]
        which = answers.column("part").to_pylist()
        for k in range(order):
            for p, places, sums in zip(which, answers.column(f"places{k}").to_pylist(), answers.column(f"sums{k}").to_pylist()):
                counts[k][edges[k][p - part * into] + unpack_array(places, True).astype(np.int64)] = unpack_array(sums).astype(np.int64)
        return counts, sum(answers.column("n").to_pylist()), sum(answers.column("v").to_pylist())

    def send(table: pa.Table) -> pa.Table:
        own = of_table(table)
        return packed(own.keys, own.counts, table.column("block")[0].as_py(), 0, 1, radix[0])

    def count(table: pa.Table) -> pa.Table:
        m = merged(table)
        return replies(m, table, int(m.counts[0].sum()), int((m.counts[0] > 0).sum()))

    def exchange(messages: DataFrame, hop: int, of: int) -> DataFrame:
        """The answers to ``messages``; ``of`` parts divide all keys."""
        if hop == len(radix):
            # As many tasks as parts, however many shuffle partitions are set.
            return messages.repartition(of, "part").groupBy("part").applyInArrow(count, told_type)
        into = radix[hop]
        joint = F.floor(F.col("block") / fan_out).alias("joint")

        def pass_on(table: pa.Table) -> pa.Table:
            m = merged(table)
            return packed(m.keys, m.counts, table.column("block")[0].as_py() // fan_out, table.column("part")[0].as_py(), of, into)

        def pass_back(table: pa.Table, answers: pa.Table) -> pa.Table:
            m = merged(table)
            m.counts, n, v = learn(m.keys, m.counts, answers, table.column("part")[0].as_py(), of, into)
            return replies(m, table, n, v)

        answers = exchange(messages.groupBy("part", joint).applyInArrow(pass_on, sent_type), hop + 1, of * into)
        back = answers.groupBy(F.floor(F.col("part") / into).alias("part"), F.col("block").alias("joint"))
        return messages.groupBy("part", joint).cogroup(back).applyInArrow(pass_back, told_type)

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        own = of_table(table)
        counts, n, v = learn(own.keys, own.counts, answers, 0, 1, radix[0])
        total, base, known = Automaton(own, counts, n, v, prior).read()
        return pa.Table.from_arrays([table.column("doc_id"), table.column("held_out"), pa.array(own.sizes), pa.array(known), pa.array([n] * table.num_rows, pa.int64()), pa.array(base), pa.array(total)], schema=schema)

    messages = dealt.groupBy("block").applyInArrow(send, sent_type)
    answers = exchange(messages, 1, radix[0]).repartition(n_blocks, "block")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
