"""A quality classifier: naive Bayes support vectors over n-gram indicators.

A text's features are indicators of n-grams in three views of its words: the words themselves with pairs of
neighbours, the shape of each word (letters, digits and marks folded into classes, with runs shortened), and repetition: whether
a word equals the one before it, and how large the share of different words, of letters and of marks is, in steps.
Each indicator is scaled by its class log-count ratio, and a linear hinge-loss model is fitted to the scaled indicators by dual
coordinate descent, interpolated with the plain ratios. The fit sees at most `SAMPLE` labelled rows; scores cover all.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm._tables import stored
from marketlake.llm._words import mix, split, text_groups

#: Labelled rows that the model is fitted to, at most.
SAMPLE = 8_000
BITS = 18
#: Of the fit: smoothing of counts, weight of the hinge loss, passes, and share of the fitted weights against their mean.
ALPHA, COST, PASSES, SHARE = 1.0, 0.1, 12, 0.75

# Classes of bytes: 1 lower-case letter or part of a letter beyond ASCII, 2 upper case, 3 digit, 4 and more single marks.
_CLASS = np.ones(256, np.uint8)
_CLASS[:128] = np.arange(128) + 4
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 1, 2, 3
_ONE = np.uint64(1)


def _hash(view: int, x: np.ndarray) -> np.ndarray:
    return (mix(x + np.uint64(view * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - BITS)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature number of each indicator, in order of text."""
    starts, ends, h = split(data)
    first = np.searchsorted(starts, offsets)
    n = len(offsets) - 1
    counts = np.diff(first)
    of = np.repeat(np.arange(n), counts)
    # The shape of a word: its bytes' classes with runs made one.
    kinds = _CLASS[data]
    fresh = np.concatenate(([True], kinds[1:] != kinds[:-1]))
    fresh[starts] = True
    slim = np.flatnonzero(fresh)
    folded, lo, hi = kinds[slim].copy(), np.searchsorted(slim, starts), np.searchsorted(slim, ends)
    text = np.full(len(folded) + 1, 10, np.uint8)
    text[:-1] = folded
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(text[:-1].astype(np.uint64)) * (np.arange(len(folded), dtype=np.uint64) * np.uint64(2) + _ONE))))
    at = np.arange(len(folded) + 1, dtype=np.uint64)
    plain = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(text[:-1].astype(np.uint64)))))
    # Sum over the word of mix(class) * (2 * place in the word + 1).
    shape = (sums[hi] - sums[lo]) - (plain[hi] - plain[lo]) * (at[lo] * np.uint64(2))
    pair = np.zeros(len(h), bool)
    if len(h) > 1:
        pair[1:] = of[1:] == of[:-1]
    same = np.zeros(len(h), bool)
    same[1:] = pair[1:] & (h[1:] == h[:-1])
    two = np.flatnonzero(pair)
    prior, shapes = np.concatenate((np.zeros(1, np.uint64), h[:-1])), np.concatenate((np.zeros(1, np.uint64), shape[:-1]))
    texts = [of, of[two], of, of[two], of[same]]
    numbers = [
        _hash(1, h), _hash(2, mix(prior[two]) + h[two]), _hash(3, shape), _hash(4, mix(shapes[two]) + shape[two]),
        _hash(5, np.zeros(int(same.sum()), np.uint64)),
    ]
    total = np.maximum(counts, 1)
    size = np.maximum(np.diff(offsets) - 1, 1)
    different = np.unique(of << 40 | (h >> np.uint64(24)).astype(np.int64))
    kinds_of = np.bincount(different >> 40, minlength=n)
    byte_of = np.repeat(np.arange(n), np.diff(offsets))
    figures = (
        np.bincount(of, same, n) / total,
        kinds_of / np.maximum(total, 1) ** 0.9,
        np.bincount(byte_of, kinds <= 2, n) / size,
        np.bincount(byte_of, kinds == 3, n) / size,
        np.bincount(byte_of, (kinds > 3) & (data != 32) & (data != 10), n) / size,
        np.bincount(byte_of, kinds == 2, n) / size,
        np.bincount(of, ends - starts, n) / total / 20,
        np.log2(counts + 1) / 20,
    )
    for k, value in enumerate(figures):
        step = np.floor(np.sqrt(np.clip(value, 0, 4)) * 16).astype(np.uint64)
        for width in (1, 3):  # fine and coarse steps
            texts.append(np.arange(n))
            numbers.append(_hash(6, step // np.uint64(width) + np.uint64(1000 * k + 100000 * width)))
    key = np.concatenate(texts) << BITS | np.concatenate(numbers)
    key = np.unique(key)
    return key >> BITS, key & ((1 << BITS) - 1)


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 0) -> dict:
    """Weights, and a scale from margins to probabilities."""
    ids, first = _collect(texts)
    y = np.where(labels > 0, 1.0, -1.0)
    counts = [np.full(1 << BITS, ALPHA), np.full(1 << BITS, ALPHA)]
    for i in range(len(texts)):
        counts[int(y[i] > 0)][ids[first[i] : first[i + 1]]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    # Half of the rows set the scale of the margins for each other's weights; then all give the weights.
    fold = np.random.default_rng(seed).permutation(len(texts)) % 2
    margins = np.zeros(len(texts))
    for k in (0, 1):
        w = _descend(ids, first, y, ratio, np.flatnonzero(fold != k), seed)
        for i in np.flatnonzero(fold == k):
            margins[i] = _margin(ids[first[i] : first[i + 1]], w)
    a, b = _scale(margins, y)
    return {"weights": _descend(ids, first, y, ratio, np.arange(len(texts)), seed).astype(np.float32), "a": a, "b": b}


def _collect(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    column, parts, counts = pa.array(texts, pa.large_binary()), [], []
    for i, j, data, offsets in text_groups(column):
        t, f = features(data, offsets)
        parts.append(f.astype(np.int32))
        counts.append(np.bincount(t, minlength=j - i))
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


def _margin(features: np.ndarray, weights: np.ndarray) -> float:
    return float(weights[features].sum() / np.sqrt(max(1, len(features))))


def _descend(ids, first, y, ratio, rows, seed: int) -> np.ndarray:
    """Dual coordinate descent for the squared norm plus hinge loss, over the scaled indicators of `rows`.

    A row's indicators are divided by the root of their number. Classes weigh alike. Returns weights of the plain indicators.
    """
    w, rng = np.zeros(1 << BITS), np.random.default_rng(seed)
    alpha = np.zeros(len(y))
    share = {s: len(rows) / (2.0 * max(1, int((y[rows] == s).sum()))) for s in (1.0, -1.0)}
    for _ in range(PASSES):
        for i in rng.permutation(rows):
            f = ids[first[i] : first[i + 1]]
            x = ratio[f] / np.sqrt(max(1, len(f)))
            gradient = y[i] * float(w[f] @ x) - 1.0
            new = min(max(alpha[i] - gradient / max(float(x @ x), 1e-12), 0.0), COST * share[y[i]])
            if new != alpha[i]:
                w[f] += (new - alpha[i]) * y[i] * x
                alpha[i] = new
    mean = np.abs(w).sum() / max(1, np.count_nonzero(w))
    return (SHARE * w + (1 - SHARE) * mean) * ratio


def _scale(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a and b of 1 / (1 + exp(-(a * margin + b))), by Newton steps with a light penalty; classes weigh alike."""
    spread = margins.std() or 1.0
    x, t = margins / spread, (y > 0).astype(float)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    theta = np.array([1.0, 0.0])
    design = np.stack((x, np.ones_like(x)), 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        g = design.T @ (weight * (p - t)) + np.array([1e-3, 0.0]) * theta
        h = (design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + np.diag([1e-3, 1e-9])
        theta = theta - np.linalg.solve(h, g)
    return float(max(theta[0], 0.0) / spread), float(theta[1])


def _fitter(table):
    import pandas as pd

    table = table.sort_values(["label", "doc_id"]).drop_duplicates("text")
    model = fit([t.encode() for t in table["text"]], table["label"].to_numpy())
    return pd.DataFrame({"model": [pickle.dumps(model)]})


def train(docs: DataFrame, labels: DataFrame, held_out, label: str = "quality", sample: int = SAMPLE) -> dict:
    """The model fitted to at most `sample` rows of `labels` (doc_id, label) that are not held out.

    Rows of each class are taken in order of a hash of their id, half of the sample each at most. Only they leave the scan of `docs`;
    the fit runs in one task, on the sample. Null labels, ids and texts are not learnt from. Without rows of both
    classes every score is the share of 1, or 0.5.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    picked = None
    for value in (0, 1):
        some = (
            usable.where(F.col(label) == value)
            .select(F.col("doc_id").alias("_id"), F.lit(value).alias("label"))
            .distinct()
            .orderBy(F.xxhash64("_id"), "_id")
            .limit(sample // 2)
        )
        picked = some if picked is None else picked.unionByName(some)
    picked = stored(picked, "quality-picked")
    # At most `sample` rows of two numbers.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).where("text is not null")
    rows = stored(rows.select("doc_id", "text", "label"), "quality-sample")
    seen = {r["label"] for r in rows.select("label").distinct().collect()}
    if len(seen) < 2:
        return {"weights": np.zeros(1 << BITS, np.float32), "a": 0.0, "b": 30.0 if seen == {1} else -30.0 if seen else 0.0}
    fitted = rows.groupBy().applyInPandas(_fitter, "model binary")
    return pickle.loads(fitted.first()["model"])


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for i, j, data, offsets in text_groups(b.column("text")):
                t, f = features(data, offsets)
                n = np.maximum(np.bincount(t, minlength=j - i), 1)
                margin = np.bincount(t, model["weights"][f], j - i) / np.sqrt(n)
                p = 1 / (1 + np.exp(-np.clip(model["a"] * margin + model["b"], -30, 30)))
                rest = [b.column(k)[i:j] for k, name in enumerate(b.schema.names) if name != "text"]
                names = [name for name in b.schema.names if name != "text"]
                yield pa.record_batch([*rest, pa.array(p, pa.float64())], names=[*names, "score"])

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score, 0 to 1, of every row of `docs` (doc_id, text); a null text scores as an empty one.

    The model, of a fixed size, goes to the executors once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scorer(shared), f"doc_id {kind}, score double")
