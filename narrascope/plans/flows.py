"""The three flows: fetched records, categorised posts, narrative analysis."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCAModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope import fixed_values as fixed
from narrascope.functions import page as P
from narrascope.functions import text as X
from narrascope.functions.time import to_utc_timestamp
from narrascope.operators import aggregates as A
from narrascope.operators import cluster as C
from narrascope.operators import joins as J
from narrascope.operators import lexicon as L
from narrascope.operators import models as M
from narrascope.operators import predicates as R
from narrascope.operators import topics as T
from narrascope.operators import windows as W
from narrascope.operators.reachability import reachability_clusters
from narrascope.operators.rows import compute_once
from narrascope.session import cut_lineage


# Fetched records -----------------------------------------------------------------------------

def extract_records(pages: DataFrame, id_column: str = "id", text_tag: str = r"\w+",
                    text_attribute: str = f'data-testid="{fixed.TEXT_TESTID}"', compat: bool = False) -> DataFrame:
    """Records from stored pages (id, html): text, tags, media, links, metrics, score, failure."""
    html = F.col("html")
    table = pages.select(F.col(id_column).cast("string").alias("tweet_id"), "html")
    table = compute_once(table, _fields=P.page_fields(html, text_tag, text_attribute))
    table = compute_once(table, _found=P.extraction_cascade(F.col("_fields"), compat=compat))
    table = table.withColumn("text", F.col("_found.text"))
    table = table.withColumn("hydration_score", P.quality_score(F.col("text"), F.col("_found.points")))
    # Each status has a regex of its own: the text that all of them search is made once, and only where a reason is asked for.
    low = F.col("hydration_score") <= fixed.LOW_SCORE
    table = compute_once(table, _search=F.when(low, P.page_search_text(html)))
    table = compute_once(table, fail_reason=L.classify_failure(F.col("_search"), F.col("hydration_score")))
    return table.select(
        "tweet_id", "text", X.extract_hashtags(F.col("text")).alias("hashtags"), P.media_flag(html).alias("media"),
        X.has_link(F.col("text")).alias("has_link"), *P.metrics(html), X.permalink(F.col("tweet_id")).alias("URL"),
        "fail_reason", "hydration_score")


def add_language(records: DataFrame, model: PipelineModel | None) -> DataFrame:
    """Guarded language code; empty without a model."""
    if model is None:
        return records.withColumn("language", F.lit(""))
    # Texts whose code would be emptied do not go through the model.
    used = M.guarded_language(F.col("text"), F.col("text"), F.col("fail_reason"))
    found = M.identify_language(records.withColumn("_used", used), model, text="_used", to="_code")
    return found.withColumn("language", M.guarded_language(F.col("_code"), F.col("text"), F.col("fail_reason"))).drop("_code", "_used")


def fetch_plan(ids: DataFrame, seen: DataFrame, status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids to fetch, skipped ids with the reason)."""
    marked = J.split_skipped(ids, seen, status)
    skipped = marked.where("skip_reason is not null").select("id", F.col("skip_reason").alias("reason"))
    return marked.where("skip_reason is null").drop("skip_reason", "status_code"), skipped


def merge_records(records: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(merged records, one-row summary): first record per id, counts taken before texts are blanked."""
    merged = W.keep_first(records, "tweet_id", list(order))
    return R.declutter(merged), A.run_summary(merged)


# Categorised posts ---------------------------------------------------------------------------

def add_fallback_language(posts: DataFrame, model: PipelineModel) -> DataFrame:
    """Add candidate languages, the likeliest of them and whether there are several; blank languages take the likeliest."""
    posts = M.candidate_languages(posts, model)
    known = F.nullif(F.col("language"), F.lit("")) if "language" in posts.columns else F.lit(None).cast("string")
    posts = posts.withColumn("fallback_language", X.primary_language(F.col("detected_languages")))
    return (posts.withColumn("multi_language", X.is_multi_language(F.col("detected_languages")))
            .withColumn("language", F.coalesce(known, F.col("fallback_language"))))


def categorise_posts(posts: DataFrame, entries: Iterable[L.Entry] | None = None,
                     general_terms: Sequence[str] = fixed.GENERAL_TERMS, compat: bool = False,
                     language_model: PipelineModel | None = None) -> DataFrame:
    """Posts with language bucket, UTC time, categories and fallback; one pass, no shuffle.

    With a language model, posts without language are put in the bucket of the detected one.
    """
    posts = R.fill_blank(R.rename_text(posts))
    if language_model is not None:
        posts = add_fallback_language(posts, language_model)
    posts = R.add_lang_bucket(R.add_lineage(posts))
    posts = posts.withColumn("language", F.col("lang_bucket"))
    posts = L.with_normalised(posts, compat=compat)
    posts = L.categorise(posts, entries, normalised="normalised", compat=compat)
    return L.assign_fallback(posts, "normalised", general_terms, compat=compat).drop("normalised")


def deduplicate_outputs(routed: DataFrame, order: Sequence[str], key: str = "tweetid") -> DataFrame:
    """First row per output and post id, all with `is_duplicate` False."""
    if key not in routed.columns:
        return routed.withColumn("is_duplicate", F.lit(False))
    firsts = W.keep_first(routed, ["category", "lang_bucket", key], list(order))
    return firsts.withColumn("is_duplicate", F.lit(False))


# Narrative analysis --------------------------------------------------------------------------

def prepare_corpus(corpus: DataFrame, keep_languages: Iterable[str] = ("en",), time: str = "tweetcreatedts",
                   order: Sequence[str] = ("doc_id",), drop_reposts: bool = True,
                   repost_mode: str = "prefix_or_count", min_chars: int = fixed.MIN_DOC_CHARS) -> DataFrame:
    """The corpus filters in order, then the first post per cleaned text."""
    docs = R.filter_language(corpus, keep_languages)
    docs = R.require_columns(docs.withColumn(time, to_utc_timestamp(F.col(time))), "text", time)
    docs = R.drop_flagged_duplicates(docs)
    if drop_reposts:
        docs = R.drop_reposts(docs, mode=repost_mode)
    docs = R.min_length(compute_once(docs, clean_text=X.clean_text(F.col("text"))), chars=min_chars)
    return W.keep_first(docs, "clean_text", list(order), by_digest=True)


def narrative_tables(docs: DataFrame, time: str = "tweetcreatedts", stop_words: Iterable[str] | None = None,
                     sentiment: Callable[[DataFrame], DataFrame] | None = None, dims: int = 3, levels: int = 8,
                     bins: int = fixed.TIME_BINS, min_cluster_size: int = fixed.MIN_CLUSTER_SIZE,
                     labels: Sequence[str] = fixed.SENTIMENT_LABELS, clusters: str = "grid") -> dict[str, DataFrame]:
    """All analysis tables of prepared docs (doc_id, clean_text, time [, embedding] [, topic]).

    Docs are written out after the filters, after embedding and after clustering, as each of these
    results is read several times. A given `topic` column skips clustering, a given `embedding` column
    the built-in embedding. `sentiment` adds a `sentiment` column to the docs. `clusters` is `grid`, whose model places new
    posts too, or `reachability`, the clusters of the mutual-reachability tree.
    """
    if clusters not in ("grid", "reachability"):
        raise ValueError(f"no clusters of kind {clusters}")
    if "topic" not in docs.columns:
        docs = cut_lineage(docs)
        if "embedding" not in docs.columns:
            tokenised = T.tokenise_ngrams(docs, "clean_text", stop_words)
            docs = cut_lineage(M.embed_text(tokenised, M.fit_embedding(tokenised)).drop("terms"))
        docs = C.reduce_dimensions(docs, dims)
        if clusters == "grid":
            docs = C.density_cluster(docs, "reduced", "doc_id", dims, levels, min_cluster_size).drop("reduced")
        else:
            found = reachability_clusters(docs, "reduced", "doc_id", dims, levels, min_cluster_size).withColumnRenamed("id", "doc_id")
            docs = docs.drop("reduced").join(found, "doc_id", "left").na.fill(-1, ["topic"]).na.fill(0.0, ["prob"])
    elif "prob" not in docs.columns:
        docs = docs.withColumn("prob", F.when(F.col("topic") >= 0, 1.0).otherwise(0.0))
    docs = T.tokenise_ngrams(docs, "clean_text", stop_words)
    if sentiment is not None:
        docs = sentiment(docs)
    docs = cut_lineage(docs)

    weights = cut_lineage(T.ctfidf(T.partial_counts(docs)))
    representative = cut_lineage(T.with_text(T.representative_docs(docs, weights), docs))
    plain = docs.drop("terms", "embedding")
    tables = {
        "posts_with_topics": plain.drop("sentiment"),
        "topic_info": T.topic_info(docs, weights, representative),
        "topic_representative_docs": representative.select("topic", "rank", "doc"),
        "topics_over_time": T.topics_over_time(docs, weights, time, bins),
        "topic_weights": weights,
    }
    if sentiment is not None:
        tables["posts_with_topics_and_sentiment"] = plain
        tables["sentiment_by_topic"] = A.label_shares(docs, "topic", "sentiment", labels)
    return tables


def save_topic_model(weights: DataFrame, path: str, embedding: PipelineModel | None = None,
                     reduction: PCAModel | None = None, density: tuple[DataFrame, DataFrame] | None = None) -> None:
    """Topic weights as a table, and beside them what places new posts: embedding, reduction, cells and box."""
    weights.write.mode("overwrite").parquet(f"{path}/weights")
    if embedding is not None:
        embedding.write().overwrite().save(f"{path}/embedding")
    if reduction is not None:
        reduction.write().overwrite().save(f"{path}/reduction")
    if density is not None:
        for name, table in zip(("cells", "box"), density, strict=True):
            table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_topic_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/weights")


def assign_saved_topics(docs: DataFrame, path: str) -> DataFrame:
    """Add topic and prob to docs (terms, or embedding) by a saved model; -1 where no topic was found."""
    spark = docs.sparkSession
    if "embedding" not in docs.columns:
        docs = M.embed_text(docs, PipelineModel.load(f"{path}/embedding"))
    docs = C.apply_reduction(docs, PCAModel.load(f"{path}/reduction"))
    return C.assign_density(docs, spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/box")).drop("reduced")
