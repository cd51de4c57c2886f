"""Quality classifier: n-gram indicators scaled by class log-count ratios, then a linear hinge-loss model."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.llm.store import save
from quire.llm.words import byte_words, mixed, slices

#: Words and pairs of neighbouring words are hashed to this many indicators.
SIZE = 1 << 18
#: The model is fitted on at most so many labelled documents (those of smallest id hash) and indicators.
SAMPLE_ROWS = 12_000
SAMPLE_INDICATORS = 8_000_000
THRESHOLD = 0.7
HELD_OUT, FOLDS = 2, 4

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Model(NamedTuple):
    ratio: np.ndarray  # class log-count ratio of each indicator
    weight: np.ndarray  # its weight in the linear model, times the ratio
    bias: float
    slope: float  # score = sigmoid(slope * margin + length * log(1 + indicators) + offset)
    length: float
    offset: float


def indicators(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct indicators of each text: all numbers, and the edges between texts.

    Words, pairs of neighbours, and one indicator for any pair of equal words,
    which a vocabulary of pairs cannot hold for words that training never saw.
    """
    _, first, _, hashes = byte_words(texts, fold=False)
    base = np.cumsum([0] + [len(t) + 1 for t in texts])
    text = np.searchsorted(base, first, side="right") - 1
    pair = np.flatnonzero(text[1:] == text[:-1])
    pairs = mixed(hashes[pair] * _FACTOR + hashes[pair + 1])
    twice = pair[hashes[pair] == hashes[pair + 1]]
    every = np.concatenate([hashes, pairs, np.full(len(twice), _FACTOR)]) & np.uint64(SIZE - 1)
    keys = np.unique(np.concatenate([text, text[pair], text[twice]]) * SIZE + every.astype(np.int64))
    return (keys % SIZE).astype(np.int32), np.searchsorted(keys, np.arange(len(texts) + 1) * SIZE)


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 4, is 2 (a null id is not, and trains nothing)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, label, order, indicators of the sampled labelled rows outside the held-out fold.

    A document with labels of both kinds is left out, as are null labels and ids.
    """
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("_other")).where("label = _other")
    order = F.xxhash64(F.lit(11), "doc_id")
    chosen = save(known.select(F.col("doc_id").alias("_id"), F.col("label").cast("int").alias("label"), order.alias("order")).orderBy("order").limit(rows), "sample")
    # at most `rows` rows of 24 bytes
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).dropDuplicates(["doc_id"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text", 2 << 20):
                flat, edges = indicators(texts)
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), lists], ["label", "order", "indicators"])

    return found.select("text", "label", "order").mapInArrow(spread, "label int, order long, indicators array<int>")


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, cost: np.ndarray, epochs: int = 12) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model with L2 penalty, one dual variable at a time.

    Every dual variable alpha of a row stays in [0, cost]; a step minimises the
    dual along it and moves the weights by the difference. The bias is a constant feature.
    """
    weight, bias = np.zeros(SIZE), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for v in values])
    dice = np.random.default_rng(3)
    for _ in range(epochs):
        most = 0.0
        for i in dice.permutation(len(rows)):
            slope = sign[i] * (weight[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                weight[rows[i]] += step * sign[i] * values[i]
                bias += step * sign[i]
                alpha[i] = new
                most = max(most, abs(step) / cost[i])
        if most < 1e-3:
            break
    return weight, bias


def calibrate(margin: np.ndarray, size: np.ndarray, label: np.ndarray) -> tuple[float, float, float]:
    """Slope (positive), length term and offset of the sigmoid of largest likelihood, by Newton steps on smoothed labels.

    A short text says little, so its margin is small whatever it is; the
    length term (times the logarithm of its indicators) lets it score as short texts do.
    """
    good, bad = int(label.sum()), int(len(label) - label.sum())
    target = np.where(label == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([margin, np.log1p(size), np.ones(len(margin))], axis=1)
    ridge = np.diag([1e-3, 1e-3, 1e-6])
    weight = np.array([1.0, 0.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge, x.T @ (target - p) - ridge @ weight)
        weight = weight + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(weight.tolist()) if weight[0] > 0 and np.isfinite(weight).all() else (1.0, 0.0, 0.0)


def fit_rows(rows: list[np.ndarray], label: np.ndarray) -> Model:
    """The model of labelled rows of indicators; without both classes, one that scores every text by the labels' share."""
    good = label == 1
    if not len(label) or good.all() or not good.any():
        share = (good.sum() + 1) / (len(label) + 2)
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, 1.0, 0.0, float(np.log(share / (1 - share))))

    def fit(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        counts = [np.ones(SIZE), np.ones(SIZE)]
        for i in own:  # a row's indicators are distinct
            counts[0 if good[i] else 1][rows[i]] += 1.0
        ratio = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
        values = []
        for i in own:
            v = ratio[rows[i]]
            values.append((v / max(np.sqrt(v @ v), 1e-12)).astype(np.float32))
        sign = np.where(good[own], 1.0, -1.0)
        # both classes weigh the same
        cost = np.where(good[own], len(own) / (2.0 * max(1, good[own].sum())), len(own) / (2.0 * max(1, (~good[own]).sum())))
        weight, bias = dual_coordinate_descent([rows[i] for i in own], values, sign, cost)
        return ratio, weight, bias

    # the sigmoid comes from rows that its model has not seen
    every = np.arange(len(rows))
    apart = every % 5 == 4
    margin = None
    if good[~apart].any() and not good[~apart].all() and apart.any():
        ratio, weight, bias = fit(every[~apart])
        margin = margins(rows, ratio, weight * ratio, bias)[apart]
    size = np.array([len(r) for r in rows])
    sigmoid = calibrate(margin, size[apart], label[apart]) if margin is not None else (1.0, 0.0, 0.0)
    ratio, weight, bias = fit(every)
    return Model(ratio, weight * ratio, bias, *sigmoid)


def margins(rows: list[np.ndarray], ratio: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    return np.array([weight[r].sum() / max(np.sqrt((ratio[r] ** 2).sum()), 1e-12) + bias for r in rows])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_INDICATORS) -> Model:
    """Fits in one task on the bounded sample; the model (2 x SIZE numbers) comes to the driver."""
    sample = save(training_rows(docs, labels, rows), "training")

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labels, found, held = [], [], 0
        for frame in frames:
            for label, own in zip(frame["label"], frame["indicators"]):
                if held + len(own) > most and found:
                    continue
                labels.append(label)
                found.append(np.asarray(own, np.int32))
                held += len(own)
        m = fit_rows(found, np.array(labels, np.int64))
        yield pd.DataFrame({"ratio": [m.ratio], "weight": [m.weight], "bias": [m.bias], "slope": [m.slope], "length": [m.length], "offset": [m.offset]})

    one = sample.repartition(1).sortWithinPartitions("order").select("label", "indicators")
    got = save(one.mapInPandas(fit, "ratio array<double>, weight array<double>, bias double, slope double, length double, offset double"), "model").first()
    if got is None:
        return fit_rows([], np.zeros(0, np.int64))
    return Model(np.array(got["ratio"]), np.array(got["weight"]), got["bias"], got["slope"], got["length"], got["offset"])


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All rows and columns, and the score of every whole text (a column of that name is replaced). Null texts score like empty ones."""
    kept = [c for c in docs.columns if c != name]
    columns = docs.select(*kept)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        square = m.ratio**2
        for batch in batches:
            for part, texts in slices(batch, "text", 2 << 20):
                flat, edges = indicators(texts)
                zero = np.zeros(1)
                above = np.diff(np.concatenate([zero, np.cumsum(m.weight[flat])])[edges])
                below = np.diff(np.concatenate([zero, np.cumsum(square[flat])])[edges])
                size = np.diff(edges)
                margin = above / np.maximum(np.sqrt(np.maximum(below, 0)), 1e-12) * (size > 0) + m.bias
                score = 1 / (1 + np.exp(-np.clip(m.slope * margin + m.length * np.log1p(size) + m.offset, -500, 500)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*kept, name])

    return columns.mapInArrow(rows, StructType(list(columns.schema)).add(name, "double"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per input row.

    Labels are learnt from outside the held-out fold only; the score sees the
    text alone. Repeated rows score alike, extra columns are ignored, an empty
    table gives an empty result, and without labels of both kinds the score is the same everywhere.
    """
    scored = with_score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def in_fold(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT
