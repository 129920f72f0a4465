"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Every word of every example is a term; none is left out. A term weighs its inverse document frequency times the root
of its log-likelihood ratio between the classes (Dunning 1993), so words that both classes use alike are light, but
still count. The examples lie in an inverted index cut into blocks. Each (term, block) keeps the largest weight it
holds, so the cosine of a query with a whole block is bounded from above (Ding and Suel 2011, block-max indexes).
Blocks are opened in order of that bound until no unopened block can hold a nearer example than the k-th found.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.llm.spark import bounded_rows, labelled_sample, remainder, small_batches, with_scores
from narrascope.llm.texts import word_hashes

PIECE = 1 << 20
#: Added to each log-likelihood ratio, so that a term without any lean keeps a share of its weight.
LEAN_FLOOR = 0.1
SCHEMA = "score double, votes double, neighbours array<struct<example: long, label: int, cosine: double>>"
_BREAKS = re.compile(r"[\W_]+")
#: Runs of scripts that write no blanks between words: Thai to Myanmar, Khmer, kana, Han.
_UNSPACED = re.compile("[฀-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿]+")


def _pairs(run: re.Match[str]) -> str:
    signs = run.group()
    return " " + (" ".join(map("".join, zip(signs, signs[1:], strict=False))) or signs) + " "


def text_terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the text's distinct terms and how often it holds each.

    Terms are the lower-cased runs of letters and digits; in scripts without blanks, pairs of neighbouring signs. The
    text is hashed in pieces that end between words.
    """
    words = _BREAKS.sub(" ", _UNSPACED.sub(_pairs, text.lower()))
    pieces, at = [], 0
    while at < len(words):
        end = words.find(" ", at + PIECE)
        end = len(words) if end < 0 else end
        pieces.append(word_hashes(words[at:end], lower=False))
        at = end
    return np.unique(np.concatenate([*pieces, np.empty(0, np.uint64)]), return_counts=True)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of the half-open ranges, one range after another, and the lengths of the ranges."""
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum()), sizes


def _damped(counts: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(counts)


@dataclasses.dataclass
class ToxicIndex:
    """grams: sorted hashes of the terms; weight: by term; examples, weights: postings in order of term and example;
    run_starts, run_blocks, run_tops: first posting, block and largest weight of each (term, block); term_runs: first
    run and largest weight of each term (term_tops); labels, example_ids: by example, ordered so that like examples share a block."""

    grams: np.ndarray
    weight: np.ndarray
    term_runs: np.ndarray
    run_starts: np.ndarray
    run_blocks: np.ndarray
    run_tops: np.ndarray
    term_tops: np.ndarray
    examples: np.ndarray
    weights: np.ndarray
    labels: np.ndarray
    example_ids: np.ndarray
    class_weight: tuple[float, float]
    prior: float
    block: int
    k: int = 15
    power: float = 2.0
    smoothing: float = 0.2
    ahead: int = 4
    light: float = 0.02

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and weights of a text's unit vector; empty if it holds no term of any example."""
        none = np.empty(0, np.int64), np.empty(0)
        if not text or not len(self.grams):
            return none
        grams, counts = text_terms(text)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        known = self.grams[at] == grams
        terms = at[known]
        weights = self.weight[terms] * _damped(counts[known])
        length = np.sqrt((weights ** 2).sum())
        return (terms, weights / length) if length else none

    def nearest(self, terms: np.ndarray, weights: np.ndarray) -> list[tuple[int, float]]:
        """The k examples of largest cosine above zero, ties to the earlier example.

        The lightest terms, which together add at most `light` to any cosine, are left for last. The other terms open
        the blocks of largest bound first, then all whose bound reaches the k-th cosine found. The light terms are
        looked up only in blocks that still hold an example within reach of it.
        """
        most = weights * self.term_tops[terms]
        by_most = np.argsort(most, kind="stable")
        added = np.cumsum(most[by_most])
        cut = int(np.searchsorted(added, self.light, side="right"))
        rest = float(added[cut - 1]) if cut else 0.0
        late, early = by_most[:cut], by_most[cut:]
        runs, asked, where = self._runs(terms[early], weights[early])
        bounds = np.bincount(where, asked * self.run_tops[runs], -(-len(self.labels) // self.block)) + rest
        cosines = np.zeros(len(self.labels))
        first = np.zeros(len(bounds), dtype=bool)
        first[np.argsort(-bounds, kind="stable")[:self.ahead]] = True
        self._open(cosines, first, runs, asked, where)
        opened = (bounds >= self._kth(cosines) - 1e-9) & ~first
        self._open(cosines, opened, runs, asked, where)
        near = np.flatnonzero(cosines >= self._kth(cosines) - rest - 1e-9)
        within = np.zeros(len(bounds), dtype=bool)
        within[near // self.block] = True
        self._open(cosines, within, *self._runs(terms[late], weights[late]))
        best = near[np.lexsort((near, -cosines[near]))][:self.k]
        return [(int(i), float(cosines[i])) for i in best if cosines[i] > 1e-9]

    def _runs(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The (term, block) runs of terms, with the weight asked and the block of each."""
        runs, sizes = _ranges(self.term_runs[terms], self.term_runs[terms + 1])
        return runs, np.repeat(weights, sizes), self.run_blocks[runs]

    def _open(self, cosines: np.ndarray, blocks: np.ndarray, runs: np.ndarray, asked: np.ndarray, where: np.ndarray) -> None:
        """Add what the runs hold for the examples of some blocks."""
        chosen = np.flatnonzero(blocks[where])
        postings, sizes = _ranges(self.run_starts[runs[chosen]], self.run_starts[runs[chosen] + 1])
        cosines += np.bincount(self.examples[postings], np.repeat(asked[chosen], sizes) * self.weights[postings], len(cosines))

    def _kth(self, cosines: np.ndarray) -> float:
        return float(np.partition(cosines, -self.k)[-self.k]) if len(cosines) > self.k else 0.0

    def score(self, text: str | None) -> tuple[float, float, list[dict[str, Any]]]:
        """Share of the toxic votes, each weighted by its cosine and its class's share of all documents and drawn
        towards the share of toxic labels; all votes; the neighbours as evidence. Without any term it is that share."""
        terms, weights = self.vector(text)
        if not len(terms):
            return self.prior, 0.0, []
        found = self.nearest(terms, weights)
        votes = [0.0, 0.0]
        for i, cosine in found:
            votes[self.labels[i]] += cosine ** self.power * self.class_weight[self.labels[i]]
        drawn = self.smoothing * self.class_weight[1]
        return (votes[1] + drawn * self.prior) / (sum(votes) + drawn), sum(votes), [
            {"example": int(self.example_ids[i]), "label": int(self.labels[i]), "cosine": c} for i, c in found]


def _example_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        held = [text_terms(t) for t in batch["text"]]
        yield pd.DataFrame({"label": batch["label"], "example": batch["example"],
                            "grams": [g.view(np.int64) for g, _ in held], "counts": [c for _, c in held]})


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 1500, block: int = 64) -> ToxicIndex:
    """Index a hashed sample of about `per_class` labelled texts of each class (labels 0 and 1), with all their terms.

    Terms are counted by Spark; the driver gets the examples' term counts, as many as the sampled texts have distinct
    words. Texts without any term (empty ones) are no examples.
    """
    small_batches(docs.sparkSession)
    found, counts = labelled_sample(docs, labels, label, per_class)
    sample = found.select(F.col(label).alias("label"), "text", F.xxhash64(label, "text").alias("example"))
    rows = bounded_rows(sample.mapInPandas(_example_terms, "label int, example long, grams array<long>, counts array<long>"))
    return _indexed(rows[rows["grams"].map(len) > 0], counts, block)


def _term_weights(df1: np.ndarray, df0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Inverse document frequency times the root of the log-likelihood ratio of a term's presence in both classes."""
    held, size = df1 + df0, n1 + n0

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return seen * np.log(np.where(seen > 0, seen, 1.0) / np.where(seen > 0, expected, 1.0))

    lean = 2 * (part(df1, held * n1 / size) + part(df0, held * n0 / size)
                + part(n1 - df1, (size - held) * n1 / size) + part(n0 - df0, (size - held) * n0 / size))
    return np.log1p(size / held) * np.sqrt(np.maximum(lean, 0.0) + LEAN_FLOOR)


def _indexed(rows: pd.DataFrame, counts: dict[int, int], block: int) -> ToxicIndex:
    """The index of the examples' term counts, ordered by strongest term so that blocks hold like examples."""
    rows = rows.sort_values(["example", "label"], ignore_index=True)
    labels, sizes = rows["label"].to_numpy(dtype=np.int8), rows["grams"].map(len).to_numpy(dtype=np.int64)
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    grams, terms = np.unique(np.concatenate([*rows["grams"], np.empty(0, np.int64)]).astype(np.int64).view(np.uint64), return_inverse=True)
    own = np.repeat(np.arange(len(rows)), sizes)
    df = np.bincount(terms, minlength=len(grams)).astype(float)
    df1 = np.bincount(terms, labels[own] == 1, len(grams))
    weight = _term_weights(df1, df - df1, n1, n0)
    weights = weight[terms] * _damped(np.concatenate([*rows["counts"], np.empty(0, np.int64)]))
    weights /= np.sqrt(np.bincount(own, weights ** 2, len(rows)))[own]
    # The last posting of an example in order of weight is its strongest term.
    by_weight = np.lexsort((weights, own))
    order = np.lexsort((np.arange(len(rows)), terms[by_weight[np.cumsum(sizes) - 1]]))
    place = np.empty(len(rows), dtype=np.int64)
    place[order] = np.arange(len(rows))
    sorted_by = np.lexsort((place[own], terms))
    terms, examples, weights = terms[sorted_by], place[own][sorted_by], weights[sorted_by].astype(np.float32)
    first = np.flatnonzero(np.diff(terms * (len(rows) + 1) + examples // block, prepend=-1))
    tops = np.zeros(len(grams))
    np.maximum.at(tops, terms, weights)
    return ToxicIndex(
        grams, weight, np.searchsorted(terms[first], np.arange(len(grams) + 1)).astype(np.int64),
        np.append(first, len(terms)).astype(np.int64), (examples[first] // block).astype(np.int32),
        np.maximum.reduceat(weights, first) if len(first) else weights, tops, examples.astype(np.int32), weights,
        labels[order], rows["example"].to_numpy(dtype=np.int64)[order],
        (counts.get(0, 0) / max(1, n0), counts.get(1, 0) / max(1, n1)),
        counts.get(1, 0) / sum(counts.values()) if counts else 0.0, block)


def score_toxicity(docs: DataFrame, index: ToxicIndex, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Add a struct column (score, votes, neighbours). Every text is read whole; neighbours name the hash of the
    example's label and text, its label and the cosine.

    Null and empty texts, and texts without any term of an example, get the share of toxic labels (0 without labels).
    Equal cosines go to the earlier example of the index.
    """
    def make() -> Callable[[str | None], tuple[Any, ...]]:
        return index.score

    return with_scores(docs, text, out, make, SCHEMA)


def toxicity_query(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The contract of op6: learn from labelled documents whose id leaves a remainder other than 1, score all."""
    index = fit_toxicity(docs, labels.where(remainder(F.col("doc_id"), 3) != 1))
    scored = score_toxicity(docs.select("doc_id", "text"), index)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "toxicity.score",
                         (F.col("toxicity.score") >= threshold).cast("int").alias("predicted"),
                         F.expr("transform(toxicity.neighbours, n -> n.example)").alias("evidence"))
