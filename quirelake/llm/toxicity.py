"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another; each later model also sees the predicted log
odds of all earlier categories. It is trained on out-of-fold predictions of them, so at
training time they are as uncertain as they will be on new texts.

A text's features are the 64-bit hashes of its distinct words (ASCII letters lower-cased,
runs of other ASCII marks taken as blanks) and of their first four and five bytes. A model
keeps the features that are clearly more frequent in texts of the category, at most
``MAX_FEATURES``; a text without any of them is judged by what speaks for no category.

The fit sees a bounded sample of labelled rows: ``N_POSITIVE`` and ``N_NEGATIVE`` for each
category, least hashes of the id, as far as their features take ``MAX_BYTES``. Scoring reads
every whole text in one scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stage, bound_batches, item_words

N_POSITIVE, N_NEGATIVE = 2500, 3500
MAX_FEATURES = 6000
MAX_BYTES = 96 << 20  # of features that are learnt from
FOLDS = 4
THRESHOLD = 0.5
#: Category, label column and the value that means it; in the order of the chain.
CHAIN = (("low_quality", "quality", 0), ("toxic", "toxic", 1))

_h = xxhash.xxh3_64_intdigest


def features(text: bytes | None) -> np.ndarray:
    """Sorted distinct feature hashes of one whole text; none for null, empty and blank texts."""
    words = set(item_words(text))
    out = set(map(_h, words))
    for size in (4, 5):
        tag = b"%d " % size
        out.update(map(_h, {tag + w[:size] for w in words if len(w) >= size}))
    return np.array(sorted(out), dtype=np.uint64)


@dataclass
class Linear:
    keys: np.ndarray  # sorted feature hashes
    weight: np.ndarray
    earlier: np.ndarray  # weights of the earlier categories' log odds
    bias: float

    def margin(self, x: np.ndarray, before: np.ndarray) -> float:
        z = self.bias + float(before @ self.earlier)
        if len(x) and len(self.keys):
            at = np.searchsorted(self.keys, x)
            at[at == len(self.keys)] = 0
            z += float(self.weight[at[self.keys[at] == x]].sum())
        return z


def fit_linear(xs: list[np.ndarray], y: np.ndarray, before: np.ndarray, steps: int = 300, rate: float = 0.05, l2: float = 2e-3) -> Linear:
    """Logistic model of selected features and the earlier log odds; classes weigh alike."""
    positive, negative = int((y == 1).sum()), int((y == 0).sum())
    if not positive or not negative:
        return Linear(np.zeros(0, np.uint64), np.zeros(0), np.zeros(before.shape[1]), 6.0 if positive else -6.0)
    row = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    flat = np.concatenate(xs) if len(row) else np.zeros(0, np.uint64)
    keys, inverse = np.unique(flat, return_inverse=True)
    in_pos = np.bincount(inverse, weights=y[row], minlength=len(keys))
    in_neg = np.bincount(inverse, minlength=len(keys)) - in_pos
    odds = np.log((in_pos + 0.5) / (positive + 1)) - np.log((in_neg + 0.5) / (negative + 1))
    often = in_pos >= max(4, 0.004 * positive)
    value = np.where(often & (odds > 1.5), odds * np.sqrt(in_pos / positive), 0)
    best = np.sort(np.argsort(-value, kind="stable")[:MAX_FEATURES])
    best = best[value[best] > 0]
    place = np.full(len(keys), -1)
    place[best] = np.arange(len(best))
    col = place[inverse]
    row, col = row[col >= 0], col[col >= 0]
    k, e = len(best), before.shape[1]
    w, m, v = np.zeros(k + e + 1), np.zeros(k + e + 1), np.zeros(k + e + 1)
    share = np.where(y == 1, 0.5 / positive, 0.5 / negative)
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=w[col], minlength=len(xs)) + before @ w[k : k + e] + w[-1]
        d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * share
        g = np.concatenate((np.bincount(col, weights=d[row], minlength=k), before.T @ d, [d.sum()]))
        g[:-1] += l2 * w[:-1] / max(1, np.sqrt(k))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Linear(keys[best], w[:k], w[k : k + e], float(w[-1]))


def fit_chain(xs: list[np.ndarray], ys: np.ndarray) -> list[Linear]:
    """One model a category (column of ys); later ones on out-of-fold log odds of earlier ones."""
    n, models = len(xs), []
    fold = np.random.default_rng(11).permutation(n) % FOLDS
    before = np.zeros((n, 0))
    for c in range(ys.shape[1]):
        models.append(fit_linear(xs, ys[:, c], before))
        if c + 1 < ys.shape[1]:
            out = np.zeros(n)
            for f in range(FOLDS):
                rest = np.flatnonzero(fold != f)
                part = fit_linear([xs[i] for i in rest], ys[rest, c], before[rest])
                for i in np.flatnonzero(fold == f):
                    out[i] = part.margin(xs[i], before[i])
            before = np.column_stack((before, np.clip(out, -10, 10)))
    return models


def chain_scores(models: list[Linear], x: np.ndarray) -> list[float]:
    before: list[float] = []
    for m in models:
        before.append(float(np.clip(m.margin(x, np.array(before)), -10, 10)))
    return [float(1 / (1 + np.exp(-z))) for z in before]


@F.arrow_udf(T.BinaryType())
def _feature_bytes(text: pa.Array) -> pa.Array:
    return pa.array([features(t.as_py()).tobytes() for t in text], pa.binary())


def train(docs: DataFrame, labels: DataFrame, chain=CHAIN, id_col: str = "doc_id", text_col: str = "text") -> list[Linear]:
    """The chain, from labelled rows whose crc32 of the id as text is no multiple of five.

    Labels with a null take no part. An id counts once: it is of a category if any of its rows says
    so; of its texts that of least hash is learnt from. Rows are taken in the order of their ids, so
    the models don't depend on how tables are stored.
    """
    bound_batches(docs.sparkSession)
    says = [F.max((F.col(c).cast("int") == value).cast("int")).alias(f"y{k}") for k, (_, c, value) in enumerate(chain)]
    known = labels.dropna(subset=[id_col, *{c for _, c, _ in chain}]).where(F.crc32(F.col(id_col).cast("string")) % 5 != 0)
    known = known.groupBy(F.col(id_col).alias("i")).agg(*says)
    wanted = None
    for k in range(len(chain)):
        for yes, size in ((1, N_POSITIVE), (0, N_NEGATIVE)):
            some = known.where(F.col(f"y{k}") == yes).orderBy(F.xxhash64("i"), "i").limit(size)
            wanted = some if wanted is None else wanted.unionByName(some)
    names = [f"y{k}" for k in range(len(chain))]
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("t")).join(F.broadcast(wanted.distinct()), "i")
    texts = texts.groupBy("i", *names).agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t"))["t"].alias("t"))
    held = Stage(docs.sparkSession).cut(texts.select("i", *names, _feature_bytes("t").alias("x")), "features")
    taken, ids = 0, []
    for r in held.select("i", F.octet_length("x").alias("n")).orderBy(F.xxhash64("i"), "i").collect():  # a row for each of the sample
        if taken + r["n"] <= MAX_BYTES:
            taken += r["n"]
            ids.append((r["i"],))
    chosen = docs.sparkSession.createDataFrame(ids, held.select("i").schema)
    rows = sorted(held.join(F.broadcast(chosen), "i", "left_semi").collect(), key=lambda r: r["i"])
    xs = [np.frombuffer(r["x"], np.uint64) for r in rows]
    ys = np.array([[float(r[c]) for c in names] for r in rows]).reshape(len(rows), len(chain))
    return fit_chain(xs, ys)


def score(docs: DataFrame, labels: DataFrame, chain=CHAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, a probability <category>_score for each category of the chain,
    and for the last one a boolean of its name, true from ``THRESHOLD``.

    Defined cases: null, empty and blank texts score as texts without features; repeated ids give a
    row each; without labels of both kinds a category scores near 0 (or near 1 if all have it);
    labelled ids that are null or unknown take no part; other columns are ignored.
    """
    models = train(docs, labels, chain, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def scored(text: pa.Array) -> pa.Array:
        return pa.array([chain_scores(shared.value, features(t.as_py())) for t in text], pa.list_(pa.float64()))

    out = docs.select(F.col(id_col).alias("doc_id"), scored.asNondeterministic()(F.col(text_col).cast("binary")).alias("s"))
    scores = [F.col("s")[k].alias(f"{name}_score") for k, (name, _, _) in enumerate(chain)]
    return out.select("doc_id", *scores, (F.col("s")[len(chain) - 1] >= THRESHOLD).alias(chain[-1][0]))
