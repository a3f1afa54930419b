"""Operators 11 to 13 against brute force, and on awkward tables."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from .test_operators import DOC, awkward, empty, prose, words  # noqa: F401

# 11: exact duplicates


def owners(rows):
    """{row: (keep_id, group_size, kept, sha)} by definition; rows are (doc_id, text)."""
    groups = collections.defaultdict(list)
    for k, (doc_id, text) in enumerate(rows):
        text = text or ""
        groups[text.encode().translate(None, b" \t\n\x0b\x0c\r")].append((-len(text), doc_id is None, doc_id or 0, k))
    out = collections.Counter()
    for key, members in groups.items():
        best = min(members)
        for m in members:
            doc_id = rows[m[3]][0]
            out[doc_id, None if best[1] else best[2], len(members), m[:3] == best[:3], hashlib.sha256(key).hexdigest()] += 1
    return out


def result(df):
    return collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())


@pytest.mark.parametrize("most_bytes", [1, 5_000, 1 << 30])
def test_exact_duplicates_equal_brute_force(spark, words, most_bytes):  # noqa: F811
    from pagelens.llm.exact_dedup import drop_duplicates, exact_duplicates

    rng = random.Random(3)
    base = [prose(words, rng, rng.randint(1, 30)) for _ in range(120)]
    base += [b[: rng.randint(0, len(b))] for b in base[:40]] + [b + "x" for b in base[:20]]
    hot = base[0]
    texts = [hot.replace(" ", rng.choice([" ", "\n", "  ", "\t\r\x0b\x0c"])) if rng.random() < 0.35 else rng.choice(base).replace(" ", rng.choice([" ", "", "  "])) for _ in range(900)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(exact_duplicates(docs, most_bytes=most_bytes)) == owners(rows)
    left = drop_duplicates(docs, most_bytes=most_bytes).collect()
    assert sorted(r["doc_id"] for r in left) == sorted({k[1] for k in owners(rows)})


def test_exact_duplicates_awkward(spark, awkward):  # noqa: F811
    from pagelens.llm.exact_dedup import exact_duplicates

    rows = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    want, got = owners(rows), result(exact_duplicates(awkward))
    # Of wholly equal rows one is kept.
    twice = [k for k, n in want.items() if n > 1 and k[3]]
    for k in twice:
        assert got[k] == 1
    assert sum(got.values()) == len(rows)
    assert {k: n for k, n in got.items() if k[0] != 3} == {k: n for k, n in want.items() if k[0] != 3}
    assert exact_duplicates(empty(spark)).collect() == []


def test_radix_trie_holds_all_keys():
    from pagelens.llm.exact_dedup import RadixTrie

    rng = random.Random(5)
    keys = [bytes(rng.choice(b"ab\xff") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    trie, count = RadixTrie(), collections.Counter(keys)
    for k in keys:
        node = trie.insert(k)
        node.end = (node.end or 0) + 1
    assert list(trie.ends()) == sorted(count.items())
    handed = list(trie.spill(0))
    assert collections.Counter(dict(handed)) + collections.Counter(dict(trie.ends())) == count and handed
    # Edges are compressed: no node but an end or the root has a single node below.
    trie = RadixTrie()
    for k in keys:
        trie.insert(k).end = 1
    todo = [trie.root]
    while todo:
        node = todo.pop()
        below = list((node.below or {}).values())
        assert node.end or node is trie.root or len(below) > 1
        todo += below


# 12: whitening


def whitened(rows, most=8):
    """(n, deviations, whitened up to sign, explained) by numpy."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in rows]
    n, total = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * v - s) ** 2 for v, s in zip(r, total)) for r in x]
    centred = np.array([[v - s / n for v, s in zip(r, total)] for r in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, len(values))
    return n, deviation, centred @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


@pytest.mark.parametrize("most_sums", [7, 4096])
def test_whitening_equals_numpy(spark, most_sums):
    from pagelens.llm.whitening import whiten

    rng = np.random.default_rng(1)
    mix = rng.normal(size=(10, 10))
    rows = [(k, [float(c) for c in (rng.normal(size=10) @ mix).astype(np.float32)]) for k in range(300)]
    bad = [(900, None), (901, [1.0, None] + [0.0] * 8), (902, [float("nan")] + [1.0] * 9), (903, [float("inf")] * 10), (904, [])]
    vectors = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("n", F.lit("mine")).withColumn("component", F.lit(3)).repartition(3)
    got = {(r["vec_id"], r["component"]): r for r in whiten(vectors, most_sums=most_sums).collect()}
    n, deviation, w, explained = whitened(rows)
    assert len(got) == 300 * 8
    for c in range(8):
        col = np.array([got[k, c + 1]["whitened"] for k in range(300)])
        sign = np.sign(col @ w[:, c])
        assert np.allclose(col * sign, w[:, c], atol=1e-8)
        assert all(abs(got[k, c + 1]["explained"] / explained[c] - 1) < 1e-9 for k in range(300))
    assert all(got[k, 1]["deviation"] == deviation[k] and got[k, 1]["n"] == n for k in range(300))
    assert {r["identity_error"] for r in got.values()} == {got[0, 1]["identity_error"]} and got[0, 1]["identity_error"] < 1e-9


def test_whitening_awkward(spark):
    from pagelens.llm.whitening import exact_deviation, whiten

    kind = "vec_id long, embedding array<double>"
    assert whiten(spark.createDataFrame([], kind)).collect() == []
    one = whiten(spark.createDataFrame([(None, [1.0, 2.0])], kind)).collect()
    assert [(r["vec_id"], r["component"], r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in one] == [(None, c, 0.0, 0.0, 1.0, 0) for c in (1, 2)]
    # Lengths have fit lists of their own; a constant dimension is no component; entries with no exact long go.
    rows = [(1, [0.0, 5.0]), (1, [1.0, 5.0]), (2, [1.0]), (3, [2.0]), (4, [1e300, 1.0]), (5, [-1e16, 0.0])]
    got = collections.defaultdict(list)
    for r in whiten(spark.createDataFrame(rows, kind)).collect():
        got[r["n"], r["component"], r["identity_error"]].append((r["vec_id"], round(abs(r["whitened"]), 9), r["explained"]))
    assert sorted(got[2, 1, 0.0]) == [(2, 1.0, 1.0), (3, 1.0, 1.0)]
    flat = next(k for k in got if k[1] == 2)
    assert sorted(got[2, 2, flat[2]]) == [(1, 0.0, 0.0), (1, 0.0, 0.0)] and flat[2] == 1.0
    # Deviations are exact, or null beyond a long.
    x = np.array([[1 << 30, 5], [3, 7]])
    assert exact_deviation(x, 3, [11, 13]) == [(3 * (1 << 30) - 11) ** 2 + 4, 4 + 64] or exact_deviation(x, 3, [11, 13])[0] is None
    assert exact_deviation(np.array([[1 << 52], [1]]), 1 << 20, [5]) == [None, ((1 << 20) - 5) ** 2]


# 13: conversation prefix trie


def trie(rows):
    """The nodes of the rebuilt conversations by definition."""
    turns = collections.defaultdict(list)
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns[conv].append((role or "", text or ""))
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        rebuilt[c] = turns.get(base, [])[:h] + turns[c][h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k in sorted(members, key=len, reverse=True):
        leaves[k] += not children[k]
        if k:
            saved[k] += (len(members[k]) - 1) * len(k[-1][1].encode())
            saved[k[:-1]] += saved[k]
            leaves[k[:-1]] += leaves[k]
    return collections.Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got_trie(df):
    return collections.Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_conversation_trie_equals_brute_force(spark):
    from pagelens.llm.conversation_trie import rebuilt_prefix_trie

    rng = random.Random(11)
    rows = []
    for c in range(-40, 160):
        n = rng.choice([0, 1, 2, 3, 5, 8, 12])
        rows += [(c, t, rng.choice(["user", "assistant", None]) if t else "user", "hot" if t == 0 and rng.random() < 0.6 else rng.choice(["", None, "a", "bé", "ccc"])) for t in range(n)]
    rows += [(c, t, "user", f"copy {t}") for c in range(1000, 1090) for t in range(9)]
    rows += [(7000, t, "user", "long") for t in range(1300)] + [(7001, t, "user", "long" if t != 1200 else "x") for t in range(1300)]
    rows += [(None, 1, "user", "no conversation"), (2000, None, "user", "first"), (2000, -1, "user", "second"), (2005, 1, "user", "twice"), (2005, 1, "user", "twice")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("d", F.lit("x")).withColumn("own", F.lit(1)).repartition(5)
    assert got_trie(rebuilt_prefix_trie(df)) == trie(rows)


def test_conversation_trie_of_turnless_conversations_and_nothing(spark):
    from pagelens.llm.conversation_trie import rebuilt_prefix_trie

    kind = "conv_id long, turn long, role string, text string"
    assert rebuilt_prefix_trie(spark.createDataFrame([], kind)).collect() == []
    # Conversations without a family's first one lose their head; those with as few turns are turnless.
    rows = [(c, 0, "user", "x") for c in range(1, 40) if c % 5]
    assert got_trie(rebuilt_prefix_trie(spark.createDataFrame(rows, kind))) == trie(rows)


def test_running_sums_cross_all_tasks(spark):
    from pagelens.llm.conversation_trie import running

    rng = np.random.default_rng(2)
    rows = [(int(k), i, int(v)) for i, (k, v) in enumerate(zip(np.sort(rng.choice([1, 2, 3, 4, 5], 3000, p=[0.02, 0.9, 0.02, 0.02, 0.04])), rng.integers(-(1 << 62), 1 << 62, 3000)))]
    got = running(spark.createDataFrame(rows, "k long, i long, v long"), "k", [F.col("i")], ["v"], 16).collect()
    want, sums = {}, collections.Counter()
    wrap = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    for k, i, v in rows:
        sums[k] += v
        want[i] = (wrap(sums[k]), wrap(sums[k] - v))
    assert {r["i"]: (r["v_run"], r["v_was"]) for r in got} == want
