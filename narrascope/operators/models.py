"""Batched models: language, embedding, sentiment. Each has a built-in baseline and a plug-in form."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import HashingTF, IDF, IndexToString, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope import fixed_values as fixed
from narrascope.functions import text as X
from narrascope.operators.rows import compute_once, explode_rows
from narrascope.session import cut_lineage

UNKNOWN_LANGUAGE = "unknown"


def score_batches(df: DataFrame, loader: Callable[[], Callable[[Sequence[str]], Sequence]], text: str, to: str,
                  kind: str, batch_size: int) -> DataFrame:
    """Add the outputs of a model over texts, in batches; `loader` runs once per Python worker task.

    Only the text goes through Python. The planner evaluates the model once, also where a filter on its output follows.
    """
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loader()
        for part in parts:
            found: list = []
            for start in range(0, len(part), batch_size):
                found += list(model(part.iloc[start:start + batch_size].tolist()))
            yield pd.Series(found, dtype=object)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(to, F.pandas_udf(run, kind).asNondeterministic()(F.col(text)))


# Language ------------------------------------------------------------------------------------

def char_grams(value: Column, n: int = 3) -> Column:
    """All runs of n characters, in one regex pass."""
    spaced = F.concat(F.lit(" "), X.collapse_spaces(F.lower(value)), F.lit(" "))
    return F.regexp_extract_all(spaced, F.lit(f"(?s)(?=({'.' * n}))"), F.lit(1))


def fit_language_model(labelled: DataFrame, text: str = "text", language: str = "lang", n: int = 3,
                       features: int = 1 << 14) -> PipelineModel:
    """Naive Bayes over hashed character n-grams. One pass of counting; scoring is row by row."""
    stages = [StringIndexer(inputCol=language, outputCol="_label", stringOrderType="alphabetAsc"),
              HashingTF(inputCol="_grams", outputCol="_features", numFeatures=features),
              NaiveBayes(featuresCol="_features", labelCol="_label", predictionCol="_class",
                         rawPredictionCol="_raw", probabilityCol="_prob")]
    data = labelled.where(F.col(language).isNotNull()).withColumn("_grams", char_grams(F.col(text), n))
    model = Pipeline(stages=stages).fit(data)
    index, hashing, bayes = model.stages
    return PipelineModel([hashing, bayes, IndexToString(inputCol="_class", outputCol="_code", labels=index.labels)])


def identify_language(df: DataFrame, model: PipelineModel, text: str = "text", to: str = "detected_language",
                      n: int = 3, min_chars: int = 1) -> DataFrame:
    """Add the language code of each text, `unknown` for one too short."""
    columns = df.columns
    scored = model.transform(df.withColumn("_grams", char_grams(X.text_or_empty(F.col(text)), n)))
    enough = F.length(X.strip(X.text_or_empty(F.col(text)))) >= min_chars
    return scored.select(*columns, F.when(enough, F.col("_code")).otherwise(UNKNOWN_LANGUAGE).alias(to))


def candidate_languages(df: DataFrame, model: PipelineModel, text: str = "text", to: str = "detected_languages",
                        n: int = 3, min_prob: float = 0.2) -> DataFrame:
    """Add the array of languages above a probability, most likely first."""
    columns, codes = df.columns, model.stages[-1].getLabels()
    scored = model.transform(df.withColumn("_grams", char_grams(X.text_or_empty(F.col(text)), n)))
    pairs = F.zip_with(vector_to_array("_prob"), F.array(*[F.lit(c) for c in codes]),
                       lambda p, c: F.struct((-p).alias("p"), c.alias("c")))
    likely = F.transform(F.filter(F.array_sort(pairs), lambda s: -s["p"] > min_prob), lambda s: s["c"])
    return scored.select(*columns, likely.alias(to))


def fit_language_profile(labelled: DataFrame, text: str = "text", language: str = "lang", n: int = 3) -> DataFrame:
    """(lang, gram, gain, base): per language and character n-gram ln(count + 1), and ln of the language's n-grams and
    all distinct ones together, which smooths by one. Plain counting, so SQL can repeat it."""
    grams = explode_rows(labelled.where(F.col(language).isNotNull()).select(
        F.col(language).alias("lang"), char_grams(X.text_or_empty(F.col(text)), n).alias("_g")), "_g", "gram", "lang")
    counts = cut_lineage(grams.groupBy("lang", "gram").agg(F.count("*").alias("n")))
    distinct = counts.agg(F.countDistinct("gram")).scalar()
    sums = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    return counts.join(sums, "lang").select("lang", "gram", F.ln(F.col("n") + 1.0).alias("gain"),
                                            F.ln((F.col("total") + distinct).cast("double")).alias("base"))


def identify_by_profile(df: DataFrame, profile: DataFrame, id_column: str, text: str = "text", n: int = 3) -> DataFrame:
    """(id, lang): the likeliest language of each text, ties to the first by name; texts that share no n-gram with any
    language are left out. Only (id, language) sums are shuffled after the join by n-gram."""
    grams = explode_rows(df.select(id_column, char_grams(X.text_or_empty(F.col(text)), n).alias("_g")), "_g", "gram", id_column)
    counted = grams.groupBy(id_column, "gram").agg(F.count("*").alias("tf"))
    length = counted.groupBy(id_column).agg(F.sum("tf").alias("_length"))
    gains = counted.join(profile.select("lang", "gram", "gain"), "gram").groupBy(id_column, "lang").agg(
        F.sum(F.col("tf") * F.col("gain")).alias("_gain"))
    base = profile.groupBy("lang").agg(F.max("base").alias("base"))
    scored = gains.join(length, id_column).join(base, "lang").withColumn("_score", F.round(F.col("_gain") - F.col("_length") * F.col("base"), 6))
    best = scored.groupBy(id_column).agg(F.min(F.struct((-F.col("_score")).alias("s"), F.col("lang"))).alias("_b"))
    return best.select(id_column, F.col("_b.lang").alias("lang"))


def guarded_language(code: Column, value: Column, reason: Column, min_chars: int = fixed.MIN_LANGUAGE_CHARS) -> Column:
    """The code, but empty for failed records and short texts."""
    return F.when((reason == "") & (F.length(value) >= min_chars), F.coalesce(code, F.lit(""))).otherwise("")


# Embedding -----------------------------------------------------------------------------------

def fit_embedding(df: DataFrame, terms: str = "terms", features: int = 256) -> PipelineModel:
    """Hashed TF-IDF of unit length; the fit is one aggregate of `features` counts."""
    stages = [HashingTF(inputCol=terms, outputCol="_tf", numFeatures=features),
              IDF(inputCol="_tf", outputCol="_tfidf"), Normalizer(inputCol="_tfidf", outputCol="_unit")]
    return Pipeline(stages=stages).fit(df)


def embed_text(df: DataFrame, model: PipelineModel, to: str = "embedding") -> DataFrame:
    columns = df.columns
    return model.transform(df).select(*columns, vector_to_array("_unit", "float32").alias(to))


def embed_with(df: DataFrame, loader: Callable, text: str = "clean_text", to: str = "embedding",
               batch_size: int = fixed.EMBED_BATCH) -> DataFrame:
    """Embeddings of an external model: `loader()` returns a function from texts to vectors."""
    return score_batches(df, loader, text, to, "array<float>", batch_size)


# Sentiment -----------------------------------------------------------------------------------

def lexicon_sentiment(value: Column, positive: Iterable[str], negative: Iterable[str],
                      labels: Sequence[str] = fixed.SENTIMENT_LABELS) -> Column:
    """Negative, neutral or positive by the balance of two word lists."""
    positive, negative = list(positive), list(negative)
    points = F.aggregate(X.words(value), F.lit(0), lambda s, w: s + F.when(w.isin(positive), 1).when(w.isin(negative), -1)
                         .otherwise(0))
    return F.when(points < 0, labels[0]).when(points > 0, labels[2]).otherwise(labels[1])


def fit_sentiment(labelled: DataFrame, terms: str = "terms", label: str = "sentiment", features: int = 1 << 14) -> PipelineModel:
    """Logistic regression over hashed terms, from a labelled table."""
    stages = [StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc"),
              HashingTF(inputCol=terms, outputCol="_features", numFeatures=features),
              LogisticRegression(featuresCol="_features", labelCol="_label", predictionCol="_class", rawPredictionCol="_raw",
                                 probabilityCol="_prob", regParam=0.01, maxIter=20)]
    model = Pipeline(stages=stages).fit(labelled)
    index, hashing, regression = model.stages
    return PipelineModel([hashing, regression, IndexToString(inputCol="_class", outputCol="_code", labels=index.labels)])


def score_sentiment(df: DataFrame, model: PipelineModel, to: str = "sentiment") -> DataFrame:
    """Add the label of each row's terms. The model runs once per row, also where a filter on the label follows."""
    scored = model.transform(df).select(*df.columns, "_code")
    return compute_once(scored, **{to: F.col("_code")}).select(*[c for c in df.columns if c != to], to)


def sentiment_with(df: DataFrame, loader: Callable, text: str = "clean_text", to: str = "sentiment",
                   batch_size: int = fixed.SENTIMENT_BATCH) -> DataFrame:
    """Labels of an external model: `loader()` returns a function from texts to labels."""
    return score_batches(df, loader, text, to, "string", batch_size)
