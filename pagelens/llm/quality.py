"""Operator 6: a quality classifier learned from positive and unlabelled text.

Trusted positives and unlabelled web text train a small network under the
non-negative unbiased PU risk: with class prior p,

    risk = p * E_pos[loss(+)] + max(0, E_unl[loss(-)] - p * E_pos[loss(-)])

Logistic loss makes the sigmoid of the network's output an estimate of
P(positive | text).  The prior is estimated from positives and unlabelled text
alone (``estimate_prior``); label 0 is never learned from.

Features describe form, not words, so any language can be scored.  Training
takes a bounded sample (``most`` rows of each kind, chosen by hash of id and
text); scoring covers all rows and whole texts.

Null and empty texts have the features of an empty text and get a score.
Repeated label rows count once (quality 1 wins only if no row says 0);
documents without positives in training get the prior as score.  An empty
table gives no rows.
"""

from __future__ import annotations

from itertools import pairwise
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_size, held_out, kept

# Byte classes of the feature counts.
SPACE, LOWER, UPPER, DIGIT, STOP, SIGN, HIGH, LINE = range(8)


def _byte_classes() -> np.ndarray:
    out = np.full(256, SIGN, np.uint8)
    out[128:] = HIGH
    for chars, cls in ((b" \t\r\x0b\x0c", SPACE), (b"\n", LINE), (b".,;:'\"-()?!", STOP)):
        out[list(chars)] = cls
    for a, b, cls in ((97, 122, LOWER), (65, 90, UPPER), (48, 57, DIGIT)):
        out[a : b + 1] = cls
    return out


BYTE_CLASS = _byte_classes()
N_FEATURES = 20


def features(text: str) -> list[float]:
    """Ratios and logarithms that describe the form of a text."""
    raw = text.encode()
    n = len(raw)
    if not n:
        return [0.0] * N_FEATURES
    cls = BYTE_CLASS[np.frombuffer(raw, np.uint8)]
    c = np.bincount(cls, minlength=8)
    letters = max(1, int(c[LOWER] + c[UPPER] + c[HIGH]))
    sign = cls == SIGN
    mark = sign | (cls == STOP)
    words = raw.split()
    n_words = max(1, len(words))
    kinds = set(words)
    repeats = sum(map(eq, words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    n_lines = max(1, len(lines))
    runs = int(np.count_nonzero(mark[1:] & mark[:-1]))
    pairs = len(set(pairwise(words)))
    alone = sum(len(w) == 1 and not w.isalnum() for w in words)
    return [
        np.log1p(n),
        np.log1p(n_words),
        c[UPPER] / letters,
        c[DIGIT] / n,
        c[STOP] / n_words,
        c[SIGN] / n_words,
        runs / n_words,
        alone / n_words,
        c[HIGH] / n,
        len(kinds) / n_words,
        len(kinds) / np.sqrt(n_words),
        repeats / n_words,
        pairs / max(1, n_words - 1),
        letters / n_words / 10,
        np.log1p(n_lines),
        len(set(lines)) / n_lines,
        np.log1p(n / n_lines),
        min(1.0, raw.count(b".") / n_words * 5),
        sum(w[:1].isupper() for w in words) / n_words,
        sum(w.isupper() for w in words) / n_words,
    ]


class Model:
    """Standardised features with their squares, one hidden layer, a sigmoid."""

    def __init__(self, mean, scale, weights, prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([z, np.tanh(z) ** 2])

    def logits(self, z: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(z @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.inputs(x)), -40, 40)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, steps: int = 600, rate: float = 0.02, decay: float = 1e-4, seed: int = 11) -> Model:
    """Full-batch Adam on the non-negative PU risk; where its negative part falls below 0, the step ascends it."""
    if not len(positive) or not len(unlabelled):
        return Model(0.0, 1.0, None, prior)
    both = np.vstack([positive, unlabelled])
    model = Model(both.mean(axis=0), both.std(axis=0) + 1e-6, None, prior)
    zp, zu = model.inputs(positive), model.inputs(unlabelled)
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, 0.3, (zp.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(())]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    soft = lambda x: np.logaddexp(0, x)
    for t in range(1, steps + 1):
        hp, hu = np.tanh(zp @ w[0] + w[1]), np.tanh(zu @ w[0] + w[1])
        gp, gu = hp @ w[2] + w[3], hu @ w[2] + w[3]
        negative = soft(gu).mean() - prior * soft(gp).mean()
        if negative >= 0:
            dp = (prior * (sig(gp) - 1) - prior * sig(gp)) / len(gp)
            du = sig(gu) / len(gu)
        else:
            dp, du = prior * sig(gp) / len(gp), -sig(gu) / len(gu)
        grads = [0.0] * 4
        for z, h, d in ((zp, hp, dp), (zu, hu, du)):
            back = np.outer(d, w[2]) * (1 - h * h)
            for k, g in enumerate((z.T @ back, back.sum(axis=0), h.T @ d, d.sum())):
                grads[k] = grads[k] + g
        for k in range(4):
            g = grads[k] + decay * w[k] * (k in (0, 2))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    model.weights = w
    return model


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, slack: float = 0.01) -> float:
    """The share of positives among the unlabelled, by the best bin of held-out scores.

    A plain positive-against-unlabelled fit ranks the rows that it has not
    seen.  Above any score lie at least prior times the positives' share, so
    the least ratio of the two shares bounds the prior from above, and is it
    where a top of the ranking holds positives only.  The bin is chosen by an
    upper confidence bound of the ratio.  Both halves take each part once.
    """
    found = []
    for turn in (0, 1):
        fit, test = slice(turn, None, 2), slice(1 - turn, None, 2)
        p, u = positive[fit], unlabelled[fit]
        plain = fit_nnpu(p, u, 0.5, steps=200)
        held_p, held_u = (positive[test], unlabelled[test]) if len(positive) > 1 and len(unlabelled) > 1 else (p, u)
        sp, su = np.sort(plain.score(held_p)), np.sort(plain.score(held_u))
        cuts = np.unique(sp)
        share_p = 1 - np.searchsorted(sp, cuts) / len(sp)
        share_u = 1 - np.searchsorted(su, cuts) / len(su)
        doubt = (np.sqrt(np.log(4 / delta) / 2 / len(su)) + np.sqrt(np.log(4 / delta) / 2 / len(sp))) * (1 + slack)
        best = np.argmin((share_u + doubt) / share_p)
        found.append(share_u[best] / share_p[best])
    return float(np.clip(np.mean(found), 0.02, 0.98))


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x array<double>) of whole texts."""

    def run(batches):
        for batch in batches_by_size(batches):
            x = [features(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[float(v) for v in r] for r in x], pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, most: int = 12_000, modulus: int = 4) -> Model:
    """Fit on rows that are not held out: up to ``most`` trusted positives and ``most`` unlabelled texts, by order of a hash."""
    open_labels = labels.filter(~held_out("doc_id", modulus) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sound = docs.filter(~held_out("doc_id", modulus) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # At most ``most`` ids; a repeated one may have any number of rows, of which ``most`` features come back.
    ids = open_labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    order = F.xxhash64("doc_id", "text")
    top = sound.select(order.alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0]

    def sample(rows: DataFrame) -> np.ndarray:
        """Features of at most ``most`` rows, in an order of their own."""
        x = np.array(feature_table(rows).limit(most).toArrow().column("x").to_pylist(), dtype=float).reshape(-1, N_FEATURES)
        return x[np.lexsort(x.T)]

    positive, rest = sample(sound.join(F.broadcast(ids), "doc_id")), sample(sound.filter(order <= F.lit(top)))
    if not len(positive) or not len(rest):
        return fit_nnpu(positive, rest, 0.5)
    shuffled = lambda x, seed: x[np.random.default_rng(seed).permutation(len(x))]
    return fit_nnpu(positive, rest, estimate_prior(shuffled(positive, 1), shuffled(rest, 2)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    spread = [model.mean, model.scale, model.weights, model.prior]

    def run(batches):
        kept(None, object)  # frees what another stage left here
        own = Model(*spread)
        for batch in batches_by_size(batches):
            x = np.array([features(t or "") for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.score(x), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, all columns unchanged."""
    spread = [model.mean, model.scale, model.weights, model.prior]

    @F.arrow_udf("double")
    def run(col: pa.Array) -> pa.Array:
        kept(None, object)  # frees what another stage left here
        own = Model(*spread)
        x = np.array([features(t.as_py() or "") for t in col]).reshape(-1, N_FEATURES)
        return pa.array(own.score(x), pa.float64())

    return docs.filter(run(F.col(text_col)) >= threshold)
