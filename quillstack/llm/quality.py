"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are quality + (1 - toxic), 0 to 2. One weight vector over hashed tokens and a few text measures is shared
by all grades, with ordered thresholds: P(grade <= k) = sigmoid(threshold_k - score). It gives the expected
grade and the tail probability P(grade = 2); a document is kept where the tail probability is at least `least`.

Fitting uses at most SAMPLE labelled documents, those with the least hash of doc_id; scoring reads every text whole.
A distinct token of a document counts once, as its word without marks and as that word's first 4, 5 and 6
characters, each hashed to 32 bits. Only hashes that the fitted documents hold MIN_DOCS times and that tell the
highest grade from the others by ERRORS standard errors have weights, the KEPT best ones at most, and soft
thresholding holds those at 0 unless they matter, so long texts are not drowned in noise. Hashes are counted and
chosen in executors; the driver gets, of each sampled document, at most its places among the chosen ones.

Defined results: a null text is the empty text; labels that are null, out of 0 and 1, or of unknown documents are
not used; a doc_id labelled twice is used twice; without labels of two different grades every document is kept with
tail probability 1; an empty table gives no rows. Texts of any length are scored whole, one at a time; equal texts get
equal grades. Other columns of docs stay, whatever their names, but for those named as results.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, binary_array, discard, free, stored

SAMPLE = 12_000
KEPT = 8192
MIN_DOCS = 4
#: Least distance, in standard errors, of a hash's share of the highest grade from the share overall.
ERRORS = 4.0
#: SPARSITY is divided by the root of the number of fitted documents: fewer documents, more shrinking.
STEPS, RATE, SPARSITY = 220, 0.05, 0.022
GRADES = 3
LEAST = 0.7
RESULT = ["expected_grade", "tail_probability", "keep"]

#: Class of each byte: upper, lower, digit, space, newline, other ASCII, not ASCII.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[:128] = 5
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[32], _CLASS[10] = 0, 1, 2, 3, 4
MEASURES = 12


_MARKS = " .,;:!?\"'()[]{}<>*#$%&|-_"


def hashes(token: str) -> list[int]:
    """32-bit hashes of a token's word and its beginnings."""
    word = token.strip(_MARKS) or token
    parts = [" " + word, *(word[:n] for n in (4, 5, 6))]
    return [xxhash.xxh32_intdigest(p.encode("utf-8", "surrogatepass"), n) for n, p in enumerate(parts)]


def measures(text: str, tokens: list[str], distinct: int) -> list[float]:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    share = np.bincount(_CLASS[raw], minlength=7) / max(len(raw), 1)
    n = max(len(tokens), 1)
    same = sum(map(operator.eq, tokens, tokens[1:])) / n
    return [*share, distinct / n, same, len(raw) / n / 10, np.log1p(len(tokens)), float(len(tokens) < 5)]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tokens_out, measures_out = [], []
        for text in b.column("text").to_pylist():
            tokens = text.lower().split()
            distinct = set(tokens)
            tokens_out.append(np.array([h for t in distinct for h in hashes(t)], "<u4").tobytes())
            measures_out.append(np.array(measures(text, tokens, len(distinct)), "<f8").tobytes())
        yield pa.RecordBatch.from_arrays([b.column("grade"), binary_array(tokens_out), binary_array(measures_out)], names=["grade", "tokens", "measures"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Model:
    """Weights by token hash, weights of the standardised measures, and ordered thresholds."""

    def __init__(self, weights: dict[int, float], dense: np.ndarray, mean: np.ndarray, scale: np.ndarray, thresholds: np.ndarray):
        self.weights, self.dense, self.mean, self.scale, self.thresholds = weights, dense, mean, scale, thresholds

    def grades(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and P(highest grade)."""
        above = 1 - _sigmoid(self.thresholds[None, :] - score[:, None])
        return above.sum(axis=1), above[:, -1]


def tally(tokens: list[np.ndarray], top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each hash, how often the documents hold it, and how often those of the highest grade do."""
    each = np.concatenate([np.empty(0, np.uint32), *tokens])
    of_top = np.repeat(top, [len(t) for t in tokens])
    used, place = np.unique(each, return_inverse=True)
    return used, np.bincount(place, minlength=len(used)), np.bincount(place[of_top], minlength=len(used))


def telling(used: np.ndarray, often: np.ndarray, held: np.ndarray, base: float) -> np.ndarray:
    """The hashes that get weights, in order: how far their share of the highest grade is from `base`, its share overall."""
    some = often >= MIN_DOCS
    used, often, held = used[some], often[some], held[some]
    gain = np.abs(held - often * base) / np.sqrt(often * base * (1 - base) + 1e-9)
    best = np.argsort(-gain, kind="stable")[:KEPT]
    return np.sort(used[best[gain[best] >= ERRORS]])


def located(tokens: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Places in `used` of the tokens that are there."""
    if not len(used):
        return np.empty(0, np.int64)
    at = np.searchsorted(used, tokens)
    return at[used[np.minimum(at, len(used) - 1)] == tokens]


def slope(p: np.ndarray, row: np.ndarray, index: np.ndarray, x: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood (with the measures' small ridge) and its gradient.

    p holds the token weights, the measure weights, the first threshold and logs of the gaps between thresholds.
    """
    n, b = len(grades), len(p) - GRADES + 1
    a = b - x.shape[1]
    theta = p[b] + np.concatenate([[0], np.cumsum(np.exp(p[b + 1 :]))])
    score = np.bincount(row, p[index], n) + x @ p[a:b]
    cdf = np.concatenate([np.zeros((n, 1)), _sigmoid(theta[None, :] - score[:, None]), np.ones((n, 1))], axis=1)
    pdf = cdf * (1 - cdf)
    take = np.arange(n)
    prob = np.maximum(cdf[take, grades + 1] - cdf[take, grades], 1e-9)
    to_score = (pdf[take, grades + 1] - pdf[take, grades]) / prob / n
    g = np.empty(len(p))
    g[:a] = np.bincount(index, to_score[row], a)
    g[a:b] = x.T @ to_score + 1e-4 * p[a:b]
    to_theta = np.zeros(GRADES - 1)
    for k in range(GRADES - 1):
        to_theta[k] = -((pdf[:, k + 1] * (grades == k) - pdf[:, k + 1] * (grades == k + 1)) / prob).sum() / n
    g[b] = to_theta.sum()
    for k in range(1, GRADES - 1):
        g[b + k] = to_theta[k:].sum() * np.exp(p[b + k])
    return -np.log(prob).mean() + 0.5e-4 * (p[a:b] ** 2).sum(), g


def fitted(grades: np.ndarray, used: np.ndarray, places: list[np.ndarray], dense: np.ndarray, steps: int = STEPS) -> Model | None:
    """Proximal Adam from each document's places in `used`; None without two different grades."""
    if len(np.unique(grades)) < 2:
        return None
    n = len(grades)
    mean, scale = dense.mean(axis=0), dense.std(axis=0) + 1e-6
    x = np.clip((dense - mean) / scale, -6, 6)
    row = np.repeat(np.arange(n), [len(t) for t in places])
    index = np.concatenate([np.empty(0, np.int64), *places]).astype(np.int64)
    a, b = len(used), len(used) + x.shape[1]
    p = np.zeros(b + GRADES - 1)
    first, second = np.zeros(len(p)), np.zeros(len(p))
    share = np.clip(np.array([(grades <= k).mean() for k in range(GRADES - 1)]), 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    p[b:] = [start[0], *np.log(np.maximum(np.diff(start), 0.05))]
    for t in range(1, steps + 1):
        _, g = slope(p, row, index, x, grades)
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        rate = RATE / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)
        p -= rate * first / (1 - 0.9**t)
        p[:a] = np.sign(p[:a]) * np.maximum(np.abs(p[:a]) - np.minimum(rate[:a] * SPARSITY / np.sqrt(n), 0.02), 0)
    weights = {int(h): float(w) for h, w in zip(used, p[:a]) if w}
    return Model(weights, p[a:b], mean, scale, p[b] + np.concatenate([[0], np.cumsum(np.exp(p[b + 1 :]))]))


def fit(grades: np.ndarray, tokens: list[np.ndarray], dense: np.ndarray, steps: int = STEPS) -> Model | None:
    """From documents held in memory."""
    top = grades == GRADES - 1
    used = telling(*tally(tokens, top), top.mean())
    return fitted(grades, used, [located(t, used) for t in tokens], dense, steps)


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tokens = [np.frombuffer(t, "<u4") for t in b.column("tokens").to_pylist()]
        used, often, held = tally(tokens, b.column("grade").to_numpy() == GRADES - 1)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (used, often, held)], names=["hash", "often", "held"])


def _placed(batches: Iterator[pa.RecordBatch], used: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        places = [located(np.frombuffer(t, "<u4"), used).astype("<u2").tobytes() for t in b.column("tokens").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("grade"), binary_array(places), b.column("measures")], names=["grade", "places", "measures"])


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fitted on the driver, which gets at most KEPT hashes and, of each sampled document, its places among them."""
    spark = docs.sparkSession
    arrow_rows(spark)
    graded = labels.where("quality in (0, 1) and toxic in (0, 1) and doc_id is not null")
    graded = graded.select(F.col("doc_id").cast("long").alias("__id"), (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))
    # At most SAMPLE rows of two numbers: small enough to broadcast whatever the tables' size.
    sample = graded.orderBy(F.xxhash64("__id"), "__id", "grade").limit(SAMPLE)
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(texts.join(F.broadcast(sample), "__id").select("grade", "text").mapInArrow(_features, "grade int, tokens binary, measures binary"), "quality-sample")
    n, top = rows.agg(F.count(F.lit(1)), F.sum((F.col("grade") == GRADES - 1).cast("int"))).first()
    if not n:
        return None
    base = top / n
    counts = rows.mapInArrow(_tallied, "hash long, often long, held long").groupBy("hash").agg(F.sum("often").alias("often"), F.sum("held").alias("held")).where(f"often >= {MIN_DOCS}")
    gain = F.abs(F.col("held") - F.col("often") * F.lit(base)) / F.sqrt(F.col("often") * F.lit(base) * F.lit(1 - base) + F.lit(1e-9))
    best = counts.withColumn("gain", gain).orderBy(F.desc("gain"), "hash").limit(KEPT).where(F.col("gain") >= ERRORS)
    used = np.sort(np.array([r["hash"] for r in best.select("hash").collect()], np.uint32))
    held = rows.mapInArrow(lambda it: _placed(it, used), "grade int, places binary, measures binary").toArrow()
    discard(rows)
    places = [np.frombuffer(t.as_buffer() or b"", "<u2") for t in held.column("places")]
    return fitted(held.column("grade").to_numpy().astype(np.int64), used, places, np.stack([np.frombuffer(m.as_buffer(), "<f8") for m in held.column("measures")]))


class _Weights(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.weights = model.weights

    def __missing__(self, token: str) -> float:
        if len(self) > 300_000:
            self.clear()
        get = self.weights.get
        self[token] = value = sum(get(h, 0.0) for h in hashes(token))
        return value


def graded(docs: DataFrame, model: Model | None, least: float = LEAST) -> DataFrame:
    """docs with expected_grade, tail_probability and keep."""
    kept = [c for c in docs.columns if c not in RESULT]
    if model is None:
        return docs.select(*kept, F.lit(float(GRADES - 1)).alias("expected_grade"), F.lit(1.0).alias("tail_probability"), F.lit(True).alias("keep"))
    arrow_rows(docs.sparkSession)

    @F.pandas_udf("expected_grade double, tail_probability double")
    def grade(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        get = _Weights(model).__getitem__
        for texts in series:
            score, dense = [], []
            for text in texts:
                tokens = text.lower().split()
                distinct = set(tokens)
                score.append(sum(map(get, distinct)))
                dense.append(measures(text, tokens, len(distinct)))
            x = np.clip((np.array(dense).reshape(-1, MEASURES) - model.mean) / model.scale, -6, 6)
            expected, tail = model.grades(np.array(score, float) + x @ model.dense)
            yield pd.DataFrame({"expected_grade": expected, "tail_probability": tail})

    (result,) = free(docs, "__grade")
    found = docs.withColumn(result, grade(F.coalesce("text", F.lit(""))))
    tail = F.col(f"{result}.tail_probability")
    return found.select(*kept, F.col(f"{result}.expected_grade").alias("expected_grade"), tail.alias("tail_probability"), (tail >= least).alias("keep"))
