"""Toxic passages by maximum-scoring segments.

A token's score is its log-odds of standing in a toxic rather than a clean text, with Dirichlet priors in two
steps: all texts' rate is the prior of the rate of a token's beginning, which is the prior of the token's own. Less a drift, so
that clean text scores negatively on average; a token that only repeats the one before it adds nothing. One linear scan
finds all maximal scoring segments of a text (Ruzzo and Tompa): the passages no part of which can be cut off or added for a higher sum. The highest segment of a clean text
follows an extreme-value law that moves with the logarithm of the number of tokens; fitted to clean texts, it turns
each passage into a significance, and the significant passages of a text together into its score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm._tables import all_of, fresh, stored
from marketlake.llm._words import mix, split, text_groups

#: Labelled rows that the model is fitted to, at most; counts of them fit in 16 bits.
SAMPLE = 12_000
BITS = 20
#: Bytes of a token's beginning.
STEM = 4
#: Strength of the prior of beginnings and of tokens, drift per token, and the p-value of a significant passage.
STEM_PRIOR, TOKEN_PRIOR, DRIFT, SIGNIFICANT = 8.0, 4.0, 0.7, 0.01

# A token is a run of letters, digits and bytes beyond ASCII, read in lower case.
_APART = np.ones(256, bool)
_LOWER = np.arange(256, dtype=np.uint8)
_APART[128:] = False
for _a, _z in ("09", "az", "AZ"):
    _APART[ord(_a) : ord(_z) + 1] = False
_LOWER[ord("A") : ord("Z") + 1] += 32


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of each text's first token, then the number of a token and of its beginning."""
    low = _LOWER[data]
    starts, ends, h = split(low, _APART)
    word = (h >> np.uint64(64 - BITS)).astype(np.int64)
    stem = np.zeros(len(starts), np.uint64)
    for k in range(STEM):
        at = starts + k
        inside = at < ends
        stem = stem * np.uint64(257) + np.where(inside, low[np.minimum(at, len(low) - 1)], 0).astype(np.uint64)
    return np.searchsorted(starts, offsets), word, (mix(stem) >> np.uint64(64 - BITS)).astype(np.int64)


def log_odds(counts: np.ndarray, stems: np.ndarray, base: float, prior_tokens: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Scores of tokens, given their counts and those of their beginnings (clean, toxic)."""
    word, stem = prior_tokens
    clean, toxic = stems[:, stem].astype(np.float64)
    rate = (toxic + STEM_PRIOR * base) / (clean + toxic + STEM_PRIOR)
    clean, toxic = counts[:, word].astype(np.float64)
    rate = (toxic + TOKEN_PRIOR * rate) / (clean + toxic + TOKEN_PRIOR)
    return np.log(rate / (1 - rate)) - np.log(base / (1 - base))


def drifted(odds: np.ndarray, first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Scores of tokens in their texts: the log-odds less the drift; a token right after itself adds no evidence."""
    again = np.concatenate(([False], word[1:] == word[:-1])) if len(word) else np.zeros(0, bool)
    again[first[:-1][first[:-1] < len(word)]] = False
    return np.where(again, 0.0, odds) - DRIFT


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, sum) of a sequence, in linear time.

    Only the few positive scores enter the scan; what lies between them is a difference of running sums.
    """
    total = np.concatenate(([0.0], np.cumsum(scores)))
    # Begin, end, sum before, sum after, and the nearest one to the left that starts lower.
    held: list[tuple[int, int, float, float, int]] = []
    for i in np.flatnonzero(scores > 0):
        begin, end, left, right = int(i), int(i) + 1, float(total[i]), float(total[i + 1])
        while True:
            k = len(held) - 1
            while k >= 0 and held[k][2] >= left:
                k = held[k][4]
            if k < 0 or held[k][3] >= right:
                break
            begin, left = held[k][0], held[k][2]
            del held[k:]
        held.append((begin, end, left, right, k))
    return [(b, e, r - x) for b, e, x, r, _ in held]


def _groups(first: np.ndarray, scores: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    for k in range(len(first) - 1):
        s = scores[first[k] : first[k + 1]]
        yield k, segments(s) if (s > 0).any() else []


def significance(best: np.ndarray | float, n: np.ndarray | int, law: dict) -> np.ndarray | float:
    """The chance that a clean text of `n` tokens has a segment of the sum `best` or more."""
    place = law["place"] + law["slope"] * np.log(np.maximum(n, 1))
    return -np.expm1(-np.exp(-np.clip((best - place) / law["width"], -30, 600)))


def fit_law(best: np.ndarray, n: np.ndarray) -> dict:
    """Place (with its slope by ln n) and width of the extreme-value law of the highest sums of clean texts.

    By moments on the residuals of a line; their median deviation, so that a few odd texts do not widen the law.
    """
    x = np.log(np.maximum(n, 1))
    slope = max(0.0, float(np.cov(x, best)[0, 1] / max(x.var(ddof=1), 1e-9))) if len(x) > 2 else 0.0
    rest = best - slope * x
    middle = float(np.median(rest))
    # The quartiles of the standard law are 1.5725 apart, its median is at 0.3665.
    width = max(float(np.subtract(*np.quantile(rest, [0.75, 0.25]))) / 1.5725, 0.25)
    return {"slope": slope, "width": width, "place": middle - 0.3665 * width}


def _evidence(found: list[tuple[int, int, float]], n: int, law: dict) -> float:
    """Minus log10 of the significances of a text's significant passages, added up; that of the best one at least."""
    if not found:
        return 0.0
    p = np.maximum(significance(np.array([s for _, _, s in found]), n, law), 1e-30)
    strong = -np.log10(p[p <= SIGNIFICANT])
    return float(strong.sum()) if len(strong) else float(-np.log10(p.min()))


def fit(texts: list[bytes], labels: np.ndarray) -> dict:
    """Scores of tokens from one half of the texts, law and calibration from the other, in turn; then scores from all.

    Texts are read twice, a group at a time, so that their tokens are never all in memory.
    """
    column, toxic, fold = pa.array(texts, pa.large_binary()), labels > 0, np.arange(len(texts)) % 2
    # How many texts of each half and class hold a token, and a beginning.
    counts, stems = np.zeros((2, 2, 2, 1 << BITS), np.float32)
    for i, j, data, offsets in text_groups(column):
        first, word, stem = tokens(data, offsets)
        text = np.repeat(np.arange(j - i), np.diff(first))
        for table, ids in ((counts, word), (stems, stem)):
            pairs = np.unique(text << BITS | ids)
            of, what = pairs >> BITS, pairs & ((1 << BITS) - 1)
            np.add.at(table, (fold[i:j][of], toxic[i:j][of].astype(int), what), 1)
    best, evidence, n = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    found: list[list] = [[] for _ in texts]
    for i, j, data, offsets in text_groups(column):
        first, word, stem = tokens(data, offsets)
        n[i:j] = np.diff(first)
        for k in (0, 1):
            base = toxic[fold != k].mean()
            s = drifted(log_odds(counts[1 - k], stems[1 - k], base, (word, stem)), first, word)
            for x, segs in _groups(first, s):
                if fold[i + x] == k:
                    found[i + x] = segs
                    best[i + x] = max((total for _, _, total in segs), default=0.0)
    law = fit_law(best[~toxic], n[~toxic])
    for i in range(len(texts)):
        evidence[i] = _evidence(found[i], n[i], law)
    a, b = _calibrate(evidence, toxic)
    return {"counts": counts.sum(axis=0).astype(np.uint16), "stems": stems.sum(axis=0).astype(np.uint16), "base": toxic.mean(), "law": law, "a": a, "b": b}


def _calibrate(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """The logistic curve through the cut of the evidence with the fewest errors, there at 0.3, as steep as it is apart."""
    order = np.argsort(evidence)
    e, t = evidence[order], toxic[order]
    below, above = np.concatenate(([0], np.cumsum(t))), (~t).sum() - np.concatenate(([0], np.cumsum(~t)))
    errors = (below + above).astype(float)
    errors[1:-1][e[1:] == e[:-1]] = np.inf  # no cut between equals
    k = int(np.argmin(errors))
    cut = (e[min(k, len(e) - 1)] + e[max(k - 1, 0)]) / 2
    a = 2.0 / max(cut, 0.5)
    return float(a), float(np.log(0.3 / 0.7) - a * cut)


def _fitter(table):
    import pandas as pd

    table = table.sort_values(["label", "doc_id"]).drop_duplicates("text").reset_index(drop=True)
    table = table.sample(frac=1, random_state=0).reset_index(drop=True)
    model = fit([t.encode() for t in table["text"]], table["label"].to_numpy())
    return pd.DataFrame({"model": [pickle.dumps(model)]})


def train(docs: DataFrame, labels: DataFrame, held_out, label: str = "toxic", sample: int = SAMPLE) -> dict | None:
    """The model fitted to at most `sample` rows of `labels` (doc_id, label) that are not held out.

    Toxic rows fill up to half of the sample, clean ones the other half, in order of a hash of their ids. The
    fit runs in one task, on the sample. Null labels, ids and texts are not learnt from. None without rows of both classes.
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
    picked = stored(picked, "toxic-picked")
    # At most `sample` rows of two numbers.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).where("text is not null")
    rows = stored(rows.select("doc_id", "text", "label"), "toxic-sample")
    if rows.select("label").distinct().count() < 2:
        return None
    return pickle.loads(rows.groupBy().applyInPandas(_fitter, "model binary").first()["model"])


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for i, j, data, offsets in text_groups(b.column("text")):
                first, word, stem = tokens(data, offsets)
                s = drifted(log_odds(model["counts"], model["stems"], model["base"], (word, stem)), first, word)
                n = np.diff(first)
                evidence, spans = np.zeros(j - i), []
                for k, segs in _groups(first, s):
                    evidence[k] = _evidence(segs, n[k], model["law"])
                    spans.append([
                        {"begin": x, "end": y, "sum": z, "p": float(p)}
                        for x, y, z in segs
                        if (p := significance(z, n[k], model["law"])) <= SIGNIFICANT
                    ])
                score = 1 / (1 + np.exp(-np.clip(model["a"] * evidence + model["b"], -30, 30)))
                kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("sum", pa.float64()), ("p", pa.float64())]))
                yield pa.record_batch(
                    [b.column(0)[i:j], pa.array(score, pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "passages"]
                )

    return run


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score (0 to 1) and significant passages (token numbers, sum, p-value) of every row of `docs` (doc_id, text).

    Null and empty texts hold no passage and get the lowest score; without a model all score 0. The model has a fixed size.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    passages = "array<struct<begin:int,end:int,sum:double,p:double>>"
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.array().cast(passages).alias("passages"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_scorer(shared), f"doc_id {kind}, score double, passages {passages}")


def drop_toxic(docs: DataFrame, model: dict | None, least: float = 0.3) -> DataFrame:
    """The rows of `docs` whose text scores below `least`, with all their columns."""
    (row,) = fresh(docs, "toxic_row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "toxic-docs")
    scored = score(rows.select(F.col(row).alias("doc_id"), "text"), model)
    bad = scored.where(F.col("score") >= least).select("doc_id")
    return rows.join(bad, rows[row] == bad["doc_id"], "left_anti").select(*all_of(docs))
