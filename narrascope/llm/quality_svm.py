"""Quality by NB-SVM (Wang and Manning 2012): n-gram indicators scaled by log-count ratios, under a linear
hinge-loss model fitted by dual coordinate descent (Hsieh et al. 2008).
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.llm.spark import drop_table, labelled_sample, remainder, small_batches, with_scores, write_table
from narrascope.llm.texts import char_grams, code_points, gram_hashes, mix

BITS = 17
CHAR_ORDERS, SHAPE_ORDERS = (1, 2, 3), (1, 2, 3, 4)
PIECE = 1 << 16
SCHEMA = "score double, decision double"
_UPPER, _LOWER, _DIGIT, _SPACE, _OTHER = range(5)


def _kinds(codes: np.ndarray) -> np.ndarray:
    """Upper case, lower case, digit, white space or other, by code point. Letters beyond Latin-1 count as lower case."""
    table = np.full(256, _OTHER, dtype=np.int8)
    for i in range(256):
        c = chr(i)
        table[i] = (_UPPER if c.isupper() else _LOWER if c.isalpha() else _DIGIT if c.isdigit() else
                    _SPACE if c.isspace() else _OTHER)
    return np.where(codes < 256, table[np.minimum(codes, 255)], _LOWER)


def word_shapes(codes: np.ndarray) -> np.ndarray:
    """For each word a small number: same as the word before or not, and which kinds of characters it starts with,
    ends with and holds."""
    kinds = _kinds(codes)
    space = kinds == _SPACE
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    sums = np.concatenate(([0], np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)), dtype=np.uint64)))
    word = sums[ends] - sums[starts]
    same = np.concatenate(([False], word[1:] == word[:-1])).astype(np.int64)
    held = np.zeros(len(starts), dtype=np.int64)
    for kind in (_UPPER, _LOWER, _DIGIT, _OTHER):
        counts = np.concatenate(([0], np.cumsum(kinds == kind)))
        n = counts[ends] - counts[starts]
        held = held * 3 + np.minimum(n, 2)
    return ((held * 5 + kinds[starts]) * 5 + kinds[ends - 1]).astype(np.uint64) * np.uint64(2) + same.astype(np.uint64)


def indicators(text: str | None) -> np.ndarray:
    """Slots (of 2 ** BITS) of the n-grams that a text holds: of its characters, and of its words' shapes.

    Character n-grams are taken in pieces, shapes over the whole text. A text without words has no slots.
    """
    if not text:
        return np.empty(0, dtype=np.int64)
    codes = code_points(text)
    shift, held = np.uint64(64 - BITS), np.zeros(1 << BITS, dtype=bool)
    for at in range(0, len(codes), PIECE):
        for n in CHAR_ORDERS:
            held[(char_grams(codes[at:at + PIECE + n - 1], n) >> shift).astype(np.int64)] = True
    shapes = word_shapes(codes)
    if not len(shapes):
        return np.empty(0, dtype=np.int64)
    for n in SHAPE_ORDERS:
        held[(mix(gram_hashes(shapes, n) + np.uint64(n)) >> shift).astype(np.int64)] = True
    return np.flatnonzero(held)


@dataclasses.dataclass
class QualityModel:
    """weights: by slot, ratios included; slope, intercept: from the decision value to log odds."""

    weights: np.ndarray
    bias: float
    slope: float
    intercept: float

    def decision(self, slots: np.ndarray) -> float:
        return float(self.weights[slots].sum() / max(1.0, len(slots)) ** 0.5 + self.bias)

    def score(self, text: str | None) -> tuple[float, float]:
        value = self.decision(indicators(text))
        return float(1 / (1 + np.exp(-np.clip(self.slope * value + self.intercept, -30, 30)))), value


def coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, signs: np.ndarray, penalty: float, rounds: int,
                       seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights of the L2-regularised hinge-loss model over unit rows scale[slots] / sqrt(len(slots)), and a bias.

    Each step solves the dual for one row exactly and keeps its multiplier between 0 and the penalty. Stops early
    once no row's projected gradient is above 0.001.
    """
    weights, bias, dual = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    values = [scale[r] / max(1.0, len(r)) ** 0.5 for r in rows]
    norms = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            gradient = signs[i] * (weights[rows[i]] @ values[i] + bias) - 1
            projected = min(gradient, 0) if dual[i] <= 0 else max(gradient, 0) if dual[i] >= penalty else gradient
            worst = max(worst, abs(projected))
            if projected:
                new = min(max(dual[i] - gradient / norms[i], 0.0), penalty)
                step = (new - dual[i]) * signs[i]
                weights[rows[i]] += step * values[i]
                bias, dual[i] = bias + step, new
        if worst < 1e-3:
            break
    return weights, bias


def _calibrate(values: np.ndarray, signs: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of log odds by Newton steps on the weighted logistic loss, with smoothed targets (Platt)."""
    slope, intercept = 1.0, 0.0
    if not len(values):
        return slope, intercept
    p, n = (signs > 0).sum(), (signs < 0).sum()
    goal = np.where(signs > 0, (p + 1) / (p + 2), 1 / (n + 2))
    for _ in range(50):
        prob = 1 / (1 + np.exp(-np.clip(slope * values + intercept, -30, 30)))
        error, curve = weight * (prob - goal), weight * prob * (1 - prob)
        x = np.stack((values, np.ones_like(values)), 1)
        step = np.linalg.solve(x.T @ (x * curve[:, None]) + 1e-3 * np.eye(2), x.T @ error + 1e-3 * np.array((slope - 1, intercept)))
        slope, intercept = max(0.05, slope - step[0]), intercept - step[1]
        if abs(step).max() < 1e-6:
            break
    return slope, intercept


def fit_model(slots: list[np.ndarray], labels: np.ndarray, class_share: dict[int, float], penalty: float = 1.0,
              rounds: int = 30) -> QualityModel:
    """Fit on the sample's rows: four fifths for the weights, the rest for the calibration at the classes' true shares."""
    signs = np.where(labels == 1, 1.0, -1.0)
    if not len(slots) or (signs > 0).all() or (signs < 0).all():
        share = class_share.get(1, 0.0) or (0.5 if not len(slots) else 0.0)
        return QualityModel(np.zeros(1 << BITS), 0.0, 1.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    held = np.arange(len(slots)) % 5 == 4
    train = np.flatnonzero(~held)
    p, q = np.ones(1 << BITS), np.ones(1 << BITS)
    for i in train:
        (p if signs[i] > 0 else q)[slots[i]] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    raw, bias = coordinate_descent([slots[i] for i in train], ratio, signs[train], penalty, rounds)
    model = QualityModel((raw * ratio).astype(np.float32), bias, 1.0, 0.0)
    rest = np.flatnonzero(held)
    values = np.array([model.decision(slots[i]) for i in rest])
    weight = np.array([class_share[int(labels[i])] / max(1, (labels[rest] == labels[i]).sum()) for i in rest])
    slope, intercept = _calibrate(values, signs[rest], weight * len(rest))
    return dataclasses.replace(model, slope=slope, intercept=intercept)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2000) -> QualityModel:
    """Fit on about `per_class` labelled texts of each class, drawn by hash and bounded by that parameter.

    One task fits the model on this sample; the driver gets its weights, 2 ** BITS numbers. With a single class or
    no labelled text the score is the share of label 1 (0.5 without any).
    """
    small_batches(docs.sparkSession)
    found, counts = labelled_sample(docs, labels, label, per_class)
    total = max(1, sum(counts.values()))
    share = {k: n / total for k, n in counts.items()}
    sample, path = write_table(found.withColumn("key", F.xxhash64("text", label)))

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch.iloc[:, 0], "key": batch.iloc[:, 2], "one": 1, "slots": [
                indicators(t).astype(np.int32).tobytes() for t in batch.iloc[:, 1]]})

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "label"], kind="stable")
        model = fit_model([np.frombuffer(s, np.int32) for s in rows["slots"]], rows["label"].to_numpy(), share)
        return pd.DataFrame({"weights": [model.weights.astype(np.float32).tobytes()], "bias": [model.bias],
                             "slope": [model.slope], "intercept": [model.intercept]})

    fitted = sample.select(label, "text", "key").mapInPandas(slots, "label int, key long, one int, slots binary").groupBy(
        "one").applyInPandas(fit, "weights binary, bias double, slope double, intercept double").first()
    drop_table(docs.sparkSession, path)
    if fitted is None:
        return fit_model([], np.empty(0), share)
    return QualityModel(np.frombuffer(fitted.weights, np.float32), fitted.bias, fitted.slope, fitted.intercept)


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "quality") -> DataFrame:
    """Add a struct column (score, decision). Every text is read whole; null, empty and wordless texts hold no n-gram
    and get the score of the bias alone."""
    def make() -> Callable[[str | None], tuple[Any, ...]]:
        return model.score

    return with_scores(docs, text, out, make, SCHEMA)


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract of op10: learn from labelled documents whose id leaves a remainder other than 1, score all."""
    model = fit_quality(docs, labels.where(remainder(F.col("doc_id"), 3) != 1))
    return score_quality(docs.select("doc_id", "text"), model).select(
        "doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "quality.score",
        (F.col("quality.score") >= 0.5).cast("int").alias("predicted"))
