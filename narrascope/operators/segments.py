"""Languages within one post: the likeliest sequence of languages over its words."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.functions import text as X
from narrascope.operators.models import char_grams
from narrascope.operators.rows import explode_rows
from narrascope.session import cut_lineage


#: Words of the texts whose paths are found together.
PATH_WORDS = 1 << 18


def likeliest_paths(scores: Sequence[np.ndarray], switch_cost: float) -> list[np.ndarray]:
    """Viterbi: for each table and row of it the column of the path of the highest sum, less the cost for each change of column; ties to the first
    column and to no change. The tables, none of them empty, take each step together, the longest first."""
    lengths = np.array([len(s) for s in scores])
    order = np.argsort(-lengths, kind="stable")
    # Step i holds the first active[i] tables; its rows lie together.
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(lengths.max()), "right")
    starts = np.append(0, np.cumsum(active))
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths))
    edges = np.append(0, np.cumsum(lengths))
    step = np.arange(edges[-1]) - np.repeat(edges[:-1], lengths)
    place = starts[step] + np.repeat(rank, lengths)
    width = scores[0].shape[1]
    rows = np.empty((edges[-1], width))
    rows[place] = np.concatenate(scores)
    came, stay, each = np.zeros((edges[-1], width), np.int64), np.arange(width), np.arange(len(lengths))
    last, total = np.empty(len(lengths), np.int64), rows[:active[0]]
    for i, n in enumerate(active[1:], 1):
        last[n:len(total)] = total[n:].argmax(1)
        total = total[:n]
        top = total.argmax(1)
        best = (total[each[:n], top] - switch_cost)[:, None]
        changed = best > total
        came[starts[i]:starts[i + 1]] = np.where(changed, top[:, None], stay)
        total = np.where(changed, best, total) + rows[starts[i]:starts[i + 1]]
    last[:len(total)] = total.argmax(1)
    paths = np.empty(edges[-1], np.int64)
    for i in range(len(active) - 1, -1, -1):
        n = active[i]
        paths[starts[i]:starts[i + 1]] = last[:n]
        last[:n] = came[starts[i] + each[:n], last[:n]]
    return np.split(paths[place], edges[1:-1])


def likeliest_path(scores: np.ndarray, switch_cost: float) -> np.ndarray:
    """The path of one table; see `likeliest_paths`."""
    return likeliest_paths([scores], switch_cost)[0]


def word_scores(df: DataFrame, profile: DataFrame, languages: Sequence[str], id_column: str, text: str = "text", n: int = 3) -> DataFrame:
    """(id, pos, scores): log-likelihood of each word in each language by its character n-grams (see `fit_language_profile`).

    Words are counted from 0. The profile is joined once, one row of gains for each n-gram; what moves after it is sums for each word.
    """
    gains = profile.groupBy("gram").agg(*[F.coalesce(F.max(F.when(F.col("lang") == v, F.col("gain"))), F.lit(0.0)).alias(f"g{i}") for i, v in enumerate(languages)])
    base = profile.groupBy().agg(*[F.max(F.when(F.col("lang") == v, F.col("base"))).alias(f"b{i}") for i, v in enumerate(languages)])
    words = df.select(id_column, F.posexplode(F.split(X.strip(X.text_or_empty(F.col(text))), r"\s+")).alias("pos", "word")).where("word != ''")
    grams = explode_rows(words.select(id_column, "pos", char_grams(F.col("word"), n).alias("_g")), "_g", "gram", id_column, "pos")
    joined = grams.join(gains, "gram", "left")
    summed = joined.groupBy(id_column, "pos").agg(F.count("*").alias("_n"), *[F.coalesce(F.sum(f"g{i}"), F.lit(0.0)).alias(f"g{i}") for i in range(len(languages))])
    # One row of bases.
    scored = summed.join(F.broadcast(base))
    return scored.select(id_column, "pos", F.array(*[F.col(f"g{i}") - F.col("_n") * F.col(f"b{i}") for i in range(len(languages))]).alias("scores"))


def language_segments(df: DataFrame, profile: DataFrame, id_column: str, text: str = "text", switch_cost: float = 12.0, n: int = 3) -> DataFrame:
    """(id, segments): runs of words of one language, as (lang, first, last) with words counted from 0, of texts that have words.

    A change of language costs `switch_cost` of log-likelihood, so that a foreign name makes no segment.
    """
    languages = sorted(r.lang for r in profile.select("lang").distinct().collect())
    scores = cut_lineage(word_scores(df, profile, languages, id_column, text, n))
    rows = scores.groupBy(id_column).agg(F.sort_array(F.collect_list(F.struct("pos", "scores"))).alias("w"))

    def run(values: pd.Series) -> pd.Series:
        tables = [value.reshape(-1, len(languages)) for value in values]
        held = np.cumsum([len(t) for t in tables]) // PATH_WORDS
        out = []
        for group in np.split(np.arange(len(tables)), np.flatnonzero(np.diff(held)) + 1):
            for path in likeliest_paths([tables[i] for i in group], switch_cost) if len(group) else ():
                edges = np.flatnonzero(np.diff(path)) + 1
                out.append([{"lang": languages[path[a]], "first": int(a), "last": int(b) - 1} for a, b in zip((0, *edges), (*edges, len(path)))])
        return pd.Series(out, dtype=object)

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    pick = F.pandas_udf(run, "array<struct<lang:string,first:int,last:int>>")
    return rows.select(id_column, pick(F.flatten(F.transform("w", lambda e: e["scores"]))).alias("segments"))


def languages_within(segments: DataFrame, id_column: str, least_words: int = 3) -> DataFrame:
    """(id, languages): the languages with at least `least_words` words in all, by name; `language` is the one of most words."""
    parts = segments.select(id_column, F.explode("segments").alias("s")).groupBy(id_column, "s.lang").agg(
        F.sum(F.col("s.last") - F.col("s.first") + 1).alias("words"))
    return parts.groupBy(id_column).agg(
        F.array_sort(F.collect_set(F.when(F.col("words") >= least_words, F.col("lang")))).alias("languages"),
        F.min(F.struct((-F.col("words")).alias("w"), "lang")).alias("m")).select(id_column, "languages", F.col("m.lang").alias("language"))
