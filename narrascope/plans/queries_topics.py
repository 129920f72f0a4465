"""Topic and cluster queries. The source number minus 1 stands in for the topic, so that source 0 is the outlier class."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.operators import aggregates as A
from narrascope.operators import cluster as C
from narrascope.operators import models as M
from narrascope.operators import topics as T
from narrascope.plans import flows
from narrascope.plans.queries_text import WORD, sql_clean
from narrascope.plans.registry import load, query
from narrascope.session import cut_lineage, scratch_path

# Query parameter: a short stop list in the languages of the documents.
STOP_WORDS = ("the", "and", "of", "in", "de", "la", "le", "und", "die", "der", "que", "les", "en")

SQL_TERMS = f"""docs as (select doc_id, substr(source, 4)::int - 1 as topic,
[t for t in regexp_extract_all(lower(text), '{WORD}{{2,}}') if t not in {STOP_WORDS!r}] as toks from documents),
terms as (select doc_id, topic, unnest(toks) as term from docs union all select doc_id, topic,
unnest([toks[i] || ' ' || toks[i + 1] for i in range(1, len(toks))]) as term from docs)"""
SQL_COUNTS = f"{SQL_TERMS}, counts as (select topic, term, count(*) as n from terms group by topic, term)"
SQL_VOCABULARY = f"""{SQL_COUNTS}, vocabulary as (select term, count(*) as df, sum(n)::bigint as f from counts group by term
having count(*) >= 2 and count(*) <= 0.95 * (select count(distinct topic) from counts))"""
SQL_WEIGHTS = f"""{SQL_VOCABULARY}, kept as (select topic, term, n, f, sum(n) over (partition by topic) as words
from counts join vocabulary using (term)),
mean as (select floor(avg(words))::double as a from (select distinct topic, words from kept)),
weights as (select topic, term, n, ln(1.0 + a / f) as idf, n / words * ln(1.0 + a / f) as weight from kept, mean)"""
SQL_TOP = f"""{SQL_WEIGHTS}, ranked as (select *, row_number() over (partition by topic order by weight desc, term) as rank from weights)"""


def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", "text", (F.substring("source", 4, 9).cast("int") - 1).alias("topic"))


def topic_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tokenise_ngrams(labelled_docs(spark, sf_dir), "text", STOP_WORDS)


def topic_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ctfidf(T.partial_counts(topic_docs(spark, sf_dir)))


@query("tokenise_ngrams", f"""with {SQL_TERMS}
select doc_id, count(*) as terms, count(distinct term) as distinct_terms from terms group by doc_id""")
def tokenise_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and word pairs without stop words."""
    docs = topic_docs(spark, sf_dir).where(F.size("terms") > 0)
    return docs.select("doc_id", F.size("terms").cast("long").alias("terms"),
                       F.size(F.array_distinct("terms")).cast("long").alias("distinct_terms"))


@query("class_term_frequency", f"""with {SQL_COUNTS}
select topic, count(*) as terms, sum(n)::bigint as occurrences, sum(n * length(term))::bigint as chars, max(n) as most from counts group by topic""")
def class_term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term counts per topic, added up by topic."""
    counts = T.class_term_frequency(topic_docs(spark, sf_dir))
    return counts.groupBy("topic").agg(F.count("*").alias("terms"), F.sum("n").alias("occurrences"),
                                       F.sum(F.col("n") * F.length("term")).alias("chars"), F.max("n").alias("most"))


@query("document_frequency", f"""with {SQL_COUNTS}
select df, count(*) as terms, sum(f)::bigint as occurrences from (select term, count(*) as df, sum(n) as f from counts group by term) group by df""")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many terms occur in how many topics."""
    found = T.document_frequency(T.class_term_frequency(topic_docs(spark, sf_dir)))
    return found.groupBy("df").agg(F.count("*").alias("terms"), F.sum("f").alias("occurrences"))


@query("prune_vocabulary", f"with {SQL_VOCABULARY} select term, df, f from vocabulary")
def prune_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in at least two topics and at most 95 % of them."""
    return T.prune_vocabulary(T.partial_counts(topic_docs(spark, sf_dir)))


@query("ctfidf_top_terms", f"with {SQL_TOP} select topic, rank, term, round(weight, 6) as weight from ranked where rank <= 10")
def ctfidf_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten heaviest terms per topic."""
    top = T.top_terms(topic_weights(spark, sf_dir))
    return top.select("topic", F.col("rank").cast("long").alias("rank"), "term", F.round("weight", 6).alias("weight"))


SQL_SIMILAR = f"""{SQL_TOP}, tf as (select doc_id, topic, term, count(*) as tf from terms group by all),
norms as (select topic, sum(weight * weight) as topic2 from weights group by topic),
sims as (select doc_id, topic, round(sum(tf * idf * weight) / sqrt(sum((tf * idf) * (tf * idf)) * any_value(topic2)), 9) as similarity
from tf join weights using (topic, term) join norms using (topic) group by doc_id, topic),
best as (select *, row_number() over (partition by topic order by similarity desc, doc_id) as doc_rank from sims)"""


@query("representative_docs", f"""with {SQL_SIMILAR}
select topic, doc_rank as rank, doc_id, round(similarity, 6) as similarity from best where doc_rank <= 3""")
def representative_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three documents nearest to each topic, with their rank."""
    docs = topic_docs(spark, sf_dir)
    weights = cut_lineage(topic_weights(spark, sf_dir))
    found = T.representative_docs(docs, weights)
    return found.select("topic", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("similarity", 6).alias("similarity"))


@query("topic_info", f"""with {SQL_SIMILAR},
reps as (select topic, string_agg(md5(text), ',' order by doc_rank) as doc_md5s from best join documents using (doc_id)
    where doc_rank <= 3 group by topic),
tops as (select topic, list(term order by rank) as terms from ranked where rank <= 10 group by topic)
select topic, n as count, topic || '_' || array_to_string(terms[1:4], '_') as name, array_to_string(terms, ', ') as representation, doc_md5s
from (select topic, count(*) as n from docs group by topic) join tops using (topic) left join reps using (topic)""")
def topic_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, name, terms and representative documents per topic."""
    docs = topic_docs(spark, sf_dir)
    weights = cut_lineage(topic_weights(spark, sf_dir))
    reps = T.with_text(T.representative_docs(docs, weights), docs, "text")
    info = T.topic_info(docs, weights, reps)
    return info.select("topic", "count", "name", F.array_join("representation", ", ").alias("representation"),
                       F.array_join(F.transform("representative_docs", lambda d: F.md5(d)), ",").alias("doc_md5s"))


SQL_TIMES = f"""{SQL_WEIGHTS}, times as (select doc_id, topic, epoch_us(ts)::double as t from docs join events on event_id = doc_id),
span as (select min(t) as lo, max(t) as hi from times),
binned as (select doc_id, topic, least(greatest(ceil((t - lo) / ((hi - lo) / 5)) - 1, 0), 4)::int as bin from times, span),
frequency as (select topic, bin, count(*) as frequency from binned group by topic, bin),
raw as (select topic, bin, term, count(*) * any_value(idf) as w from (select b.topic, b.bin, t.term from binned b join terms t using (doc_id))
    join weights using (topic, term) group by topic, bin, term),
local as (select topic, bin, term, w / sum(w) over (partition by topic, bin) as w from raw),
cells as (select distinct topic, bin from local),
follows as (select topic, bin, exists (select 1 from cells c where c.topic = cells.topic and c.bin = cells.bin - 1) as follows from cells),
overall as (select topic, term, weight / sum(weight) over (partition by topic) as w from weights),
blended as (select topic, bin, term, sum(w) as w from (
    select topic, bin, term, w * case when follows then 0.5 else 1.0 end * 0.5 as w from local join follows using (topic, bin)
    union all select l.topic, l.bin + 1, term, w * 0.25 from local l join follows f on f.topic = l.topic and f.bin = l.bin + 1 and follows
    union all select topic, bin, term, w * 0.5 from overall join cells using (topic)) group by topic, bin, term),
words as (select topic, bin, string_agg(term, ' | ' order by r) as words from (select *, row_number() over
    (partition by topic, bin order by round(w, 9) desc, term) as r from blended) where r <= 5 group by topic, bin)"""


@query("topics_over_time", f"""with {SQL_TIMES} select topic, bin, frequency, words,
floor(case when bin = 0 then lo - (hi - lo) * 0.001 else lo + bin * (hi - lo) / 5 end)::bigint as micros
from frequency left join words using (topic, bin), span""")
def topics_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, the five top words and the start of each topic's time bins, blended with the bin before and with all time."""
    times = load(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts")
    weights = cut_lineage(topic_weights(spark, sf_dir))
    # Terms are cut after the join, which moves only texts.
    docs = T.tokenise_ngrams(labelled_docs(spark, sf_dir).join(times, "doc_id"), "text", STOP_WORDS)
    lines = T.topics_over_time(docs, weights)
    return lines.select("topic", "bin", "frequency", F.array_join("words", " | ").alias("words"), F.unix_micros("timestamp").alias("micros"))


@query("prepare_corpus", f"""
with dated as (select doc_id, text, lower(lang) as lang, ts, coalesce(toxic, 0) as toxic, coalesce(quality, 1) as quality
from documents left join events on event_id = doc_id left join labels using (doc_id)),
clean as (select doc_id, {sql_clean()} as c from dated where lang in ('en', 'fr') and text is not null and ts is not null
and quality <> 0 and not (text like 'RT %' or toxic > 0))
select doc_id, length(c) as clean_chars from (select *, row_number() over (partition by c order by doc_id) as r from clean where length(c) >= 5)
where r = 1""")
def prepare_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All corpus filters in order, then the first document per cleaned text."""
    return flows.prepare_corpus(corpus(spark, sf_dir), ("en", "fr")).select("doc_id", F.length("clean_text").cast("long").alias("clean_chars"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts: events give the time, labels the repost count and the duplicate flag."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("language"), "source")
    times = load(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("tweetcreatedts"))
    labels = load(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("retweetcount"), (1 - F.col("quality")).alias("is_duplicate"))
    return docs.join(times, "doc_id", "left").join(labels, "doc_id", "left")


@query("density_cluster")
def density_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of the embeddings after reduction; -1 for outliers."""
    points = load(spark, sf_dir, "embeddings")
    reduced = C.reduce_dimensions(points, 3).select(F.col("vec_id").alias("doc_id"), "reduced")
    found = C.density_cluster(reduced, dims=3, levels=7)
    return found.select("doc_id", "topic", F.round("prob", 6).alias("prob"))


@query("membership_strength", """
with c as (select label, list(m order by i) as centroid from (select label, i, avg(embedding[i]::double) as m
    from embeddings, range(1, 65) r(i) group by label, i) group by label),
s as (select vec_id, label, list_cosine_similarity(embedding::double[], centroid) as s from embeddings join c using (label))
select vec_id, round(greatest(s / max(s) over (partition by label), 0), 6) as prob from s""")
def membership_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity to the topic centroid over the highest in the topic; labels stand in for topics."""
    points = load(spark, sf_dir, "embeddings")
    return C.membership_strength(points, "embedding", "label").select("vec_id", F.round("prob", 6).alias("prob"))


@query("assign_by_terms", f"""with {SQL_WEIGHTS}, tf as (select doc_id, term, count(*) as tf from terms group by all),
unit as (select topic, term, idf * weight / sqrt(sum(weight * weight) over (partition by topic)) as w from weights where topic <> -1),
dots as (select doc_id, topic, sum(tf * w) as dot from tf join unit using (term) group by doc_id, topic),
best as (select doc_id, max(dot) as dot from dots group by doc_id),
idfs as (select term, max(idf) as idf from weights group by term),
lengths as (select doc_id, sqrt(sum((tf * idf) * (tf * idf))) as len from tf join idfs using (term) group by doc_id)
select doc_id, round(coalesce(dot / len, 0), 6) as similarity from documents left join best using (doc_id) left join lengths using (doc_id)""")
def assign_by_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of every document to the fitted topic nearest to it."""
    docs = topic_docs(spark, sf_dir)
    weights = cut_lineage(topic_weights(spark, sf_dir))
    return T.assign_by_terms(docs, weights).select("doc_id", F.round("similarity", 6).alias("similarity"))


@query("save_topic_model", f"with {SQL_WEIGHTS} select topic, count(*) as terms, round(sum(weight), 6) as weight from weights group by topic")
def save_topic_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic weights saved as a model and loaded again."""
    path = scratch_path(spark, "model")
    flows.save_topic_model(topic_weights(spark, sf_dir), path)
    weights = flows.load_topic_weights(spark, path)
    return weights.groupBy("topic").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 6).alias("weight"))


@query("reuse_topic_model", "select vec_id, true as same from embeddings where embedding is not null")
def reuse_topic_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cluster model saved, loaded and applied to the vectors it was fitted on: topic and strength are as fitted."""
    path = scratch_path(spark, "model")
    points = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    reduction = C.fit_reduction(points, 3)
    reduced = C.apply_reduction(points, reduction)
    density = C.fit_density(reduced, id_column="vec_id", dims=3, levels=6)
    flows.save_topic_model(topic_weights(spark, sf_dir), path, reduction=reduction, density=density)
    fitted = C.assign_density(reduced, *density).select("vec_id", "topic", "prob")
    again = flows.assign_saved_topics(points, path).select("vec_id", F.col("topic").alias("t"), F.col("prob").alias("p"))
    return fitted.join(again, "vec_id").select("vec_id", ((F.col("topic") == F.col("t")) & (F.col("prob") == F.col("p"))).alias("same"))


@query("reduce_dimensions")
def reduce_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first principal components of every vector."""
    reduced = C.reduce_dimensions(load(spark, sf_dir, "embeddings"), 3)
    return reduced.select("vec_id", *[F.round(F.abs(F.col("reduced")[i]), 6).alias(f"pc{i}") for i in range(3)])


@query("embed_text", f"with {SQL_TERMS} select doc_id, 256 as dims, case when len(toks) > 0 then 1.0 else 0.0 end::double as square from docs")
def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed TF-IDF vectors of unit length: size and squared length."""
    docs = topic_docs(spark, sf_dir)
    vectors = M.embed_text(docs, M.fit_embedding(docs))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return vectors.select("doc_id", F.size("embedding").alias("dims"), F.round(square, 4).alias("square"))


@query("sentiment_model")
def sentiment_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label shares per topic of a classifier fitted on the labelled documents and applied to all."""
    docs = topic_docs(spark, sf_dir)
    label = F.when(F.col("toxic") == 1, "LABEL_0").when(F.col("quality") == 0, "LABEL_1").otherwise("LABEL_2")
    labelled = docs.join(load(spark, sf_dir, "labels").select("doc_id", label.alias("sentiment")), "doc_id")
    scored = M.score_sentiment(docs, M.fit_sentiment(labelled))
    return A.label_shares(scored, "topic", "sentiment", ["LABEL_0", "LABEL_1", "LABEL_2"])


@query("narrative_analysis")
def narrative_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole narrative flow, from corpus filters to topic information."""
    docs = flows.prepare_corpus(corpus(spark, sf_dir), ("en", "fr", "de", "es"))
    docs = docs.select("doc_id", "clean_text", "tweetcreatedts")
    tables = flows.narrative_tables(docs, stop_words=STOP_WORDS, levels=6)
    return tables["topic_info"].select("topic", "count", "name", F.array_join("representation", ", ").alias("representation"))
