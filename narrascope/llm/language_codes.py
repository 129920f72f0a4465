"""Language identification by error-correcting output codes (Dietterich and Bakiri 1995).

Each language has a codeword of +1 and -1. One binary classifier over character n-grams predicts each bit, and
loss-weighted decoding (Escalera et al. 2010) chooses the codeword at the least weighted loss.
"""

from __future__ import annotations

import dataclasses
import itertools
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.llm.spark import bounded_rows, bounded_sample, class_counts, drop_table, remainder, small_batches, with_scores, write_table
from narrascope.llm.texts import char_grams, code_points, letter_table

ORDERS = (1, 2, 3)
BITS = 15
#: Code points handled at once, so that a very long text takes no more memory than a short one.
PIECE = 1 << 16
SCHEMA = "lang_pred string, score double, ambiguous boolean, gap double"


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """A code matrix (classes x bits) of +1 and -1.

    Up to seven classes it is the exhaustive code. Beyond, it is the random code of 10 log2(classes) bits with the
    largest least distance of 200 drawn ones.
    """
    if classes < 2:
        return np.ones((classes, 1), dtype=np.int8)
    if classes <= 7:
        columns = [(1, *c) for c in itertools.product((1, -1), repeat=classes - 1) if -1 in c]
        return np.array(columns, dtype=np.int8).T
    rng, best, most = np.random.default_rng(seed), None, -1
    length = int(np.ceil(10 * np.log2(classes)))
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), (classes, length))
        code = code[:, np.abs(code.sum(0)) < classes]
        apart = (code.shape[1] - code.astype(int) @ code.T.astype(int)) // 2
        least = apart[~np.eye(classes, dtype=bool)].min()
        if least > most:
            best, most = code, least
    return best


def pieces(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text's letters, lower-cased, anything else being one space; in pieces that overlap by the
    longest n-gram less one."""
    codes = code_points(text.lower())
    kept = np.where(letter_table()[np.minimum(codes, 0x10FFFF)], codes, 0).astype(np.uint64)
    kept = np.concatenate(([0], kept, [0])).astype(np.uint64)
    kept = kept[np.concatenate(([True], (kept[1:] != 0) | (kept[:-1] != 0)))]
    if not kept.any():
        return
    mask = np.uint64(64 - BITS)
    for at in range(0, len(kept), PIECE):
        found = []
        for n in ORDERS:
            grams = char_grams(kept[at:at + PIECE + n - 1], n) >> mask
            found.append(grams[kept[at:at + len(grams)] != 0] if n == 1 else grams)
        yield np.concatenate(found).astype(np.int64)


@dataclasses.dataclass
class LanguageModel:
    """languages: in order; code: their codewords; weights: log odds by n-gram and bit; trust: weight by language and bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    slope: float = 6.0
    sharpness: float = 3.0
    least_gap: float = 0.05

    def margins(self, text: str | None) -> np.ndarray | None:
        """Mean log odds of each bit, or None for a text without letters."""
        if not text:
            return None
        total, count = np.zeros(self.weights.shape[1]), 0
        for grams in pieces(text):
            total += self.weights[grams].sum(0, dtype=np.float64)
            count += len(grams)
        return total / count if count else None

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool, float]:
        """Nearest codeword: language, share of the best among all, whether the two best are too close, their gap."""
        loss = (self.trust * np.logaddexp(0, -self.slope * self.code * margins)).sum(1)
        order = np.argsort(loss, kind="stable")
        weight = np.exp(-self.sharpness * (loss - loss[order[0]]))
        gap = float(loss[order[1]] - loss[order[0]]) if len(loss) > 1 else 1.0
        return self.languages[order[0]], float(1 / weight.sum()), gap < self.least_gap, gap

    def predict(self, text: str | None) -> tuple[str, float, bool, float]:
        if not self.languages or (margins := self.margins(text)) is None:
            return "und", 0.0, True, 0.0
        return self.decode(margins)


def _gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for label, text in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
            own = counts.setdefault(label, np.zeros(1 << BITS, dtype=np.int64))
            for grams in pieces(text):
                own += np.bincount(grams, minlength=1 << BITS)
    for label, own in counts.items():
        at = np.flatnonzero(own)
        yield pd.DataFrame({"label": label, "gram": at, "n": own[at]})


def fit_languages(docs: DataFrame, label: str = "lang", text: str = "text", per_language: int = 3000) -> LanguageModel:
    """Learn from a hashed sample of about `per_language` rows of each language (all of a rarer one).

    Counts are summed by Spark. What reaches the driver is one number for each language and n-gram slot
    (2 ** BITS of them), and one for each language and bit. Rows without label or text take no part.
    """
    small_batches(docs.sparkSession)
    labelled = docs.where(F.col(text).isNotNull())
    sample, path = write_table(bounded_sample(labelled, label, text, class_counts(labelled, label), per_language))
    counted = sample.mapInPandas(_gram_counts, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    table = bounded_rows(counted)
    languages = sorted(table["label"].unique())
    code = codewords(len(languages))
    rate = np.zeros((len(languages), 1 << BITS))
    rate[np.searchsorted(languages, table["label"].to_numpy(dtype=object)) if languages else [],
         table["gram"].to_numpy(dtype=np.int64)] = table["n"]
    rate = (rate + 0.5) / (rate.sum(1, keepdims=True) + 0.5 * (1 << BITS))
    weights = np.zeros((1 << BITS, code.shape[1]), dtype=np.float32)
    for b in range(code.shape[1] if len(languages) > 1 else 0):
        weights[:, b] = np.log(rate[code[:, b] > 0].mean(0)) - np.log(rate[code[:, b] < 0].mean(0))
    model = LanguageModel(languages, code, weights, np.full(code.shape, 1 / code.shape[1]))

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        right, seen = np.zeros(code.shape), np.zeros(len(languages))
        place = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            for name, body in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                if name in place and (margins := model.margins(body)) is not None:
                    right[place[name]] += code[place[name]] * margins > 0
                    seen[place[name]] += 1
        yield pd.DataFrame([(i, b, right[i, b], seen[i]) for i in range(code.shape[0]) for b in range(code.shape[1])],
                           columns=["i", "b", "hit", "seen"])

    if len(languages) > 1:
        for r in sample.mapInPandas(hits, "i int, b int, hit double, seen double").groupBy("i", "b").agg(
                F.sum("hit").alias("hit"), F.sum("seen").alias("seen")).collect():
            model.trust[r.i, r.b] = (r.hit + 0.5) / (r.seen + 1)
        model.trust /= model.trust.sum(1, keepdims=True)
    drop_table(docs.sparkSession, path)
    return model


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text", out: str = "language") -> DataFrame:
    """Add a struct column (lang_pred, score, ambiguous, gap). Every text is read whole.

    Null, empty and letterless texts give `und` with score 0 and count as ambiguous, as all texts do when no
    language was learned. Equal distances go to the first language in order. Other columns stay as they are.
    """
    def make() -> Callable[[str | None], tuple[Any, ...]]:
        return model.predict

    return with_scores(docs, text, out, make, SCHEMA)


def language_query(docs: DataFrame) -> DataFrame:
    """The contract of op1: learn from documents whose id leaves a remainder, predict all."""
    docs = docs.select("doc_id", "text", "lang", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"))
    model = fit_languages(docs.where("not held_out"))
    return identify_languages(docs.select("doc_id", "text", "held_out"), model).select(
        "doc_id", "held_out", "language.lang_pred", "language.score", "language.ambiguous")
