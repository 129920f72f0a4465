import random

from pyspark.sql import functions as F

from narrascope.operators import models as M
from narrascope.operators import topics as T
from narrascope.plans import flows

SAMPLES = {"en": "the people and the war with help of red cross that is", "fr": "les gens et la guerre avec une aide de la croix que les",
           "ru": "люди и война с помощью красного креста что это"}


def labelled(spark, n=90):
    rng = random.Random(8)
    rows = [(i, lang, " ".join(rng.choice(SAMPLES[lang].split()) for _ in range(10))) for i, lang in ((i, list(SAMPLES)[i % 3]) for i in range(n))]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string")


def test_language(spark):
    docs = labelled(spark)
    model = M.fit_language_model(docs)
    found = M.identify_language(docs, model, min_chars=3)
    assert found.where("lang = detected_language").count() == docs.count()
    short = M.identify_language(spark.createDataFrame([("ab",), (None,)], "text string"), model, min_chars=3)
    assert {r.detected_language for r in short.collect()} == {"unknown"}
    assert {tuple(r.detected_languages) for r in M.candidate_languages(docs, model).collect()} == {("en",), ("fr",), ("ru",)}
    codes = docs.select(M.guarded_language(F.lit("en"), F.lit("long enough"), F.lit("")), M.guarded_language(F.lit("en"), F.lit("short"), F.lit("")),
                        M.guarded_language(F.lit("en"), F.lit("long enough"), F.lit("deleted"))).first()
    assert tuple(codes) == ("en", "", "")


def test_language_fallback_of_posts(spark):
    posts = spark.createDataFrame([("1", SAMPLES["ru"], ""), ("2", SAMPLES["en"], None), ("3", SAMPLES["en"], "FR"), ("4", SAMPLES["fr"], "")],
                                  "tweetid string, text string, language string")
    done = flows.categorise_posts(posts, language_model=M.fit_language_model(labelled(spark)))
    assert {r.tweetid: r.lang_bucket for r in done.collect()} == {"1": "ru", "2": "en", "3": "other", "4": "other"}
    assert {r.tweetid: (r.fallback_language, r.multi_language) for r in done.collect()}["4"] == ("fr", False)


def test_embeddings(spark):
    docs = T.tokenise_ngrams(labelled(spark), "text", ())
    out = M.embed_text(docs, M.fit_embedding(docs, features=32)).collect()
    assert all(len(r.embedding) == 32 and abs(sum(v * v for v in r.embedding) - 1) < 1e-4 for r in out)


def test_plugged_in_models(spark):
    def load_embedder():
        return lambda texts: [[float(len(t)), float(len(texts))] for t in texts]

    def load_classifier():
        return lambda texts: ["LABEL_2" if "help" in t else "LABEL_1" for t in texts]

    docs = labelled(spark).withColumnRenamed("text", "clean_text")
    for r in M.embed_with(docs, load_embedder, batch_size=16).collect():
        assert r.embedding[0] == len(r.clean_text) and r.embedding[1] <= 16
    for r in M.sentiment_with(docs, load_classifier).collect():
        assert (r.sentiment == "LABEL_2") == ("help" in r.clean_text)


def test_sentiment(spark):
    docs = T.tokenise_ngrams(labelled(spark), "text", ())
    docs = docs.withColumn("sentiment", F.when(F.col("lang") == "en", "LABEL_0").when(F.col("lang") == "fr", "LABEL_1").otherwise("LABEL_2"))
    scored = M.score_sentiment(docs.withColumnRenamed("sentiment", "expected"), M.fit_sentiment(docs))
    assert scored.where("expected = sentiment").count() == docs.count()
    row = spark.createDataFrame([("good good bad",), ("bad",), ("none",)], "t string").coalesce(1)
    assert [r[0] for r in row.select(M.lexicon_sentiment(F.col("t"), ["good"], ["bad"])).collect()] == ["LABEL_2", "LABEL_0", "LABEL_1"]


def test_sentiment_is_scored_once_where_a_filter_follows(spark):
    docs = spark.createDataFrame([(i, ["good" if i % 2 else "bad", "day"], "up" if i % 2 else "down") for i in range(8)], "id long, words array<string>, sentiment string")
    docs = docs.withColumn("terms", F.filter("words", lambda w: w != "day"))
    model = M.fit_sentiment(docs)
    scored = M.score_sentiment(docs.drop("sentiment"), model).where("sentiment is not null")
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "UDF(" in line] and plan.count("filter(words") == 1
    assert [r.sentiment for r in scored.orderBy("id").collect()] == ["down", "up"] * 4
    assert scored.columns == ["id", "words", "terms", "sentiment"]
