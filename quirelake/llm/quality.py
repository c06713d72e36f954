"""Quality classifier by positive-unlabelled learning.

A linear model over whole-text features is fitted by minimising the non-negative unbiased
risk  pi R_p(+) + max(0, R_u(-) - pi R_p(-))  with logistic loss: R_p over trusted
positives, R_u over unlabelled web text, pi the estimated class prior. Labels of bad documents
are never read: the prior too comes from positives and unlabelled texts alone. The fit sees a
bounded sample (``n_positive`` and ``n_unlabelled`` documents, least hashes of the id), so
what reaches the driver has a fixed size; scoring reads every whole text in one scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches

N_POSITIVE = 4000
N_UNLABELLED = 8000
HASHED = 256
WINDOW = 48
THRESHOLD = 0.3

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1
_LETTER = np.zeros(256, np.uint8)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1
_DIGIT = np.zeros(256, np.uint8)
_DIGIT[48:58] = 1
_PUNCT = 1 - _LETTER - _DIGIT
_PUNCT[[9, 10, 11, 12, 13, 32]] = 0
DENSE = 3 * 7 + 3


def features(text: bytes | None) -> np.ndarray:
    """float32 vector of one whole text: statistics of its words, their means and extremes over
    windows of words, and hashed shares of word endings. Null and empty texts give zeros."""
    out = np.zeros(DENSE + HASHED, np.float32)
    if not text:
        return out
    b = np.frombuffer(text, np.uint8)
    gap = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    n = len(start)
    if not n:
        return out
    size = end - start
    cls = [np.add.reduceat(t[b], start) for t in (_UPPER, _LETTER, _DIGIT, _PUNCT)] if n else []
    # reduceat runs to the next start; blanks between count in no class
    upper, letter, digit, punct = (np.asarray(c, np.float32) for c in cls)
    last, before, third = b[end - 1], b[np.maximum(end - 2, start)], b[np.maximum(end - 3, start)]
    first = b[start].astype(np.uint32)
    sign = (first << 24) ^ (b[np.minimum(start + 1, end - 1)].astype(np.uint32) << 16) ^ (before.astype(np.uint32) << 8) ^ last ^ (size.astype(np.uint32) * np.uint32(2654435761))
    again = np.concatenate(([False], sign[1:] == sign[:-1]))
    order = np.argsort(sign, kind="stable")
    same = sign[order][1:] == sign[order][:-1]
    near = np.zeros(n, bool)
    near[order[1:]] = same & (np.diff(order) <= 40) & (size[order[1:]] > 3)
    per_word = np.stack(
        [
            upper / np.maximum(letter, 1),
            punct / size,
            digit / size,
            again,
            near,
            (size > 1) & (_PUNCT[last] == 1) & (_PUNCT[before] == 1),
            (letter == 0) & (size >= 1),
        ]
    ).astype(np.float32)
    cuts = np.arange(0, n, WINDOW)
    if len(cuts) > 1 and n - cuts[-1] < WINDOW // 2:
        cuts = cuts[:-1]
    sums = np.add.reduceat(per_word, cuts, axis=1) / np.diff(np.append(cuts, n))
    k = per_word.shape[0]
    out[:k] = per_word.mean(axis=1)
    out[k : 2 * k] = sums.max(axis=1)
    out[2 * k : 3 * k] = (sums > 0.3).mean(axis=1)
    out[3 * k : 3 * k + 3] = size.mean() / 10, size.std() / 10, np.log1p(n) / 10
    code = (last.astype(np.uint32) + (before.astype(np.uint32) << 8) + (third.astype(np.uint32) << 16)) * np.uint32(2654435761)
    out[DENSE:] = np.sqrt(np.bincount(code >> np.uint32(24), minlength=HASHED) / n)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weight + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def risk_step(p: np.ndarray, u: np.ndarray, w: np.ndarray, b: float, prior: float) -> tuple[float, np.ndarray]:
    """Non-negative PU risk of a linear model on a batch, and the step's direction (weights, then
    bias): the gradient, or where the negative part falls below zero, up that part's gradient."""
    zp, zu = p @ w + b, u @ w + b
    sp, su = 1 / (1 + np.exp(-np.clip(zp, -40, 40))), 1 / (1 + np.exp(-np.clip(zu, -40, 40)))
    positive = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    g_neg = np.append(su @ u, su.sum()) / len(u) - prior * np.append(sp @ p, sp.sum()) / len(p)
    if negative < 0:
        return positive, -g_neg
    return positive + negative, g_neg - prior * np.append((1 - sp) @ p, (1 - sp).sum()) / len(p)


def fit_nnpu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 600, rate: float = 0.02, l2: float = 1e-4, seed: int = 7) -> Model:
    """Linear model of least non-negative PU risk, by Adam on batches."""
    both = np.concatenate((p, u))
    mean, scale = both.mean(0), both.std(0) + 0.02
    p, u = (p - mean) / scale, (u - mean) / scale
    w, b = np.zeros(p.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    rng = np.random.default_rng(seed)
    for t in range(1, steps + 1):
        _, g = risk_step(p[rng.integers(0, len(p), 1000)], u[rng.integers(0, len(u), 2000)], w, b, prior)
        g[:-1] += l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(mean, scale, w, float(b))


def _apart(p: np.ndarray, u: np.ndarray, steps: int = 200, rate: float = 0.05) -> Model:
    """Logistic model of positives against unlabelled texts, both weighing alike."""
    x, y = np.concatenate((p, u)), np.repeat([1.0, 0.0], [len(p), len(u)])
    share = np.repeat([0.5 / len(p), 0.5 / len(u)], [len(p), len(u)])
    mean, scale = x.mean(0), x.std(0) + 0.02
    x = (x - mean) / scale
    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        d = (1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40))) - y) * share
        g = np.append(x.T @ d + 1e-3 * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(mean, scale, w, float(b))


def estimate_prior(p: np.ndarray, u: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, from the scores of held-back rows.

    Either half of the rows is scored by a model of the other half. Above any score, the share of
    the unlabelled over the share of the positives bounds the prior from above, and is the prior
    where only positives score so high; of all scores the one of the least bound, with room for
    chance, is taken.
    """
    high_p, high_u = np.zeros(len(p)), np.zeros(len(u))
    for k in (0, 1):
        if len(p[1 - k :: 2]) and len(u[1 - k :: 2]):
            model = _apart(p[1 - k :: 2], u[1 - k :: 2])
            high_p[k::2], high_u[k::2] = model.score(p[k::2]), model.score(u[k::2])
    at = np.unique(np.concatenate((high_p, high_u)))
    q_p = 1 - np.searchsorted(np.sort(high_p), at) / len(p)
    q_u = 1 - np.searchsorted(np.sort(high_u), at) / len(u)
    at, q_p, q_u = at[q_p > 0], q_p[q_p > 0], q_u[q_p > 0]
    room = np.sqrt(np.log(4 / delta) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    best = int(np.argmin((q_u + room) / q_p))
    return float(min(max(q_u[best] / q_p[best], 0.05), 0.98))


@F.arrow_udf(T.BinaryType())
def _feature_bytes(text: pa.Array) -> pa.Array:
    return pa.array([features(t.as_py()).tobytes() for t in text], pa.binary())


def held_out(id_col: str, folds: int = 5, fold: int = 0):
    """crc32 of the id as text, modulo ``folds``, is ``fold``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    n_positive: int = N_POSITIVE,
    n_unlabelled: int = N_UNLABELLED,
) -> Model | None:
    """Model from rows outside the held-out fold; None where there is no positive or no other text.

    Rows without an id or a label take no part. An id counts once, as a positive if none of its
    labels says otherwise; of rows that share an id, the text of least hash is learnt from. Rows are
    taken in the order of their ids, so the model doesn't depend on how tables are stored.
    """
    bound_batches(docs.sparkSession)
    seen = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where(~held_out("i")).dropna()
    trusted = seen.groupBy("i").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).where("lo = 1 AND hi = 1")
    positive = trusted.select("i").orderBy(F.xxhash64("i"), "i").limit(n_positive)
    other = docs.select(F.col(id_col).alias("i")).where(~held_out("i")).dropna().distinct().orderBy(F.xxhash64("i", F.lit(1)), "i").limit(n_unlabelled)
    wanted = positive.select("i", F.lit(1).alias("role")).unionByName(other.select("i", F.lit(0).alias("role")))
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("t")).join(F.broadcast(wanted), "i")
    texts = texts.groupBy("role", "i").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t"))["t"].alias("t"))
    rows = sorted(texts.select("role", "i", _feature_bytes("t").alias("x")).collect(), key=lambda r: r["i"])
    p = np.array([np.frombuffer(r["x"], np.float32) for r in rows if r["role"] == 1], dtype=np.float64)
    u = np.array([np.frombuffer(r["x"], np.float32) for r in rows if r["role"] == 0], dtype=np.float64)
    return fit_nnpu(p, u, estimate_prior(p, u)) if len(p) and len(u) else None


def score(docs: DataFrame, model: Model | None, text_col: str = "text", out_col: str = "quality_score") -> DataFrame:
    """Documents with ``out_col``, the probability of good quality; 0.5 without a model.

    Defined cases: null, empty and blank texts score as a text whose features are all zero; repeated
    rows keep their places; an input column named ``out_col`` is replaced, all others are kept.
    """
    bound_batches(docs.sparkSession)
    if model is None:
        return docs.withColumn(out_col, F.lit(0.5))

    @F.arrow_udf(T.DoubleType())
    def scored(text: pa.Array) -> pa.Array:
        x = np.array([features(t.as_py()) for t in text]).reshape(len(text), DENSE + HASHED)
        return pa.array(model.score(x), pa.float64())

    return docs.withColumn(out_col, scored.asNondeterministic()(F.col(text_col).cast("binary")))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; repeated ids give a row each."""
    model = train(docs, labels)
    out = score(docs.select("doc_id", "text"), model, out_col="score")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents whose score reaches the threshold, with their own columns."""
    scored = score(docs, train(docs, labels), out_col="__quality")
    return scored.where(F.col("__quality") >= threshold).drop("__quality")
