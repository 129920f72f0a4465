"""Join, aggregate, window and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.operators import aggregates as A
from narrascope.operators import joins as J
from narrascope.operators import sets as S
from narrascope.operators import topics as T
from narrascope.operators import windows as W
from narrascope.plans import queries_text as QT
from narrascope.plans.registry import load, query
from narrascope.session import cut_lineage

SQL_STATUS = """status as (select event_id as id, case event_type when 'click' then 200 when 'error' then 404
when 'view' then 403 when 'purchase' then 500 end as status_code,
case when event_type = 'signup' then 'timeout' end as status_text, event_type from events)"""


def status_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    code = F.when(kind == "click", 200).when(kind == "error", 404).when(kind == "view", 403).when(kind == "purchase", 500)
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), code.alias("status_code"),
                                                F.when(kind == "signup", "timeout").alias("status_text"), "event_type")


@query("source_value_counts", "select source, count(*) as n from documents where source <> '' group by source")
def source_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count per value, largest first."""
    return A.value_counts(load(spark, sf_dir, "documents"), "source")


@query("failure_value_counts", f"""
select fail_reason, count(*) as n from (select {QT.sql_failure("lower(text)", QT.sql_score("text"))} as fail_reason from documents)
where fail_reason <> '' group by fail_reason""")
def failure_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count per failure status, blanks left out."""
    return A.value_counts(QT.classify_failure(spark, sf_dir), "fail_reason")


@query("counts_as_map", """
select 'Languages: {' || string_agg('''' || lang || ''': ' || n, ', ' order by lang) || '}' as summary, sum(n)::bigint as total
from (select lang, count(*) as n from documents where lang <> '' group by lang)""")
def counts_as_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts as one map, and as one line of text."""
    row = A.counts_as_map(A.value_counts(load(spark, sf_dir, "documents"), "lang"), "lang")
    total = F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, b: a + b)
    return row.select(A.summary_text(F.col("counts"), "Languages").alias("summary"), total.alias("total"))


@query("status_buckets", f"""with {SQL_STATUS}
select count(*) as total, count(*) filter (status_code = 200) as ok_200, count(*) filter (status_code = 404) as gone_404,
count(*) filter (status_code = 403) as blocked_403, count(*) filter (status_text = 'timeout') as timeout,
count(*) filter (status_code not in (200, 404, 403)) as other from status""")
def status_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status counts in one pass."""
    return A.status_buckets(status_table(spark, sf_dir))


SQL_TALLY = f"""with {QT.SQL_TAGGED}, tally as (select source as file, count(*) as total,
count(*) filter (len(categories) > 0) as matched, 0::bigint as duplicates,
count(*) filter (len(categories) > 1) as multi_category from tagged group by source)"""


@query("file_tally", f"{SQL_TALLY} select * from tally")
def file_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, matched rows and rows of several categories per file."""
    return A.file_tally(QT.tagged(spark, sf_dir), "source")


@query("running_tally", f"""{SQL_TALLY} select file, total, (sum(total) over w)::bigint as running_total,
(sum(matched) over w)::bigint as running_matched, round((sum(matched) over w) / (sum(total) over w), 6)::double as match_rate
from tally window w as (order by file)""")
def running_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tallies added up in file order, with the match rate so far."""
    tally = cut_lineage(file_tally(spark, sf_dir))
    running = W.running_totals(tally, "file", ["total", "matched"])
    rated = A.with_match_rate(running, "running_matched", "running_total")
    return rated.select("file", "total", "running_total", "running_matched", F.round("match_rate", 6).alias("match_rate"))


@query("run_tally", f"""{SQL_TALLY} select sum(total)::bigint as total, sum(matched)::bigint as matched,
sum(multi_category)::bigint as multi_category, format('{{:.2f}}%', 100.0 * sum(matched) / sum(total)) as match_rate_text from tally""")
def run_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all files and the match rate as text."""
    return A.run_tally(file_tally(spark, sf_dir)).select("total", "matched", "multi_category", "match_rate_text")


@query("anti_seen", "select doc_id as id from documents where doc_id not in (select doc_id from labels)")
def anti_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids not seen before."""
    ids = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return J.anti_seen(ids, load(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query("status_lookup", f"""with {SQL_STATUS}
select doc_id as id, status_code, status_text, coalesce(status_code = 404, false) as gone
from documents left join status on doc_id = id""")
def status_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with their status, null where unknown."""
    ids = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    found = J.status_lookup(ids, status_table(spark, sf_dir).drop("event_type"))
    return found.withColumn("gone", F.coalesce(F.col("status_code") == 404, F.lit(False)))


@query("skip_unavailable", f"""with {SQL_STATUS}
select d.doc_id as id, case when status_code = 404 then 'unavailable' when l.doc_id is not null then 'seen' end as skip_reason
from documents d left join status s on d.doc_id = s.id left join labels l on l.doc_id = d.doc_id""")
def skip_unavailable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an id is skipped: gone, or seen before; null for ids to fetch."""
    ids = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    seen = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return J.split_skipped(ids, seen, status_table(spark, sf_dir)).select("id", "skip_reason")


@query("anti_processed_files", """
select source as file, count(*) as n from documents where source not in (select source from documents join labels using (doc_id)
where quality = 0) group by source""")
def anti_processed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without a ledger row."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file"))
    ledger = docs.join(load(spark, sf_dir, "labels").where("quality = 0"), "doc_id", "left_semi").select("file").distinct()
    files = docs.groupBy("file").agg(F.count("*").alias("n"))
    return J.anti_processed_files(files, ledger)


@query("attach_columns", """
select d.doc_id, lang, quality, toxic, n_rows from documents d join labels l using (doc_id)
join (select source, count(*) as n_rows from documents group by source) using (source)""")
def attach_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of other tables by id, and of a summary table."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    sizes = docs.groupBy("source").agg(F.count("*").alias("n_rows"))
    return J.attach(docs, load(spark, sf_dir, "labels")).join(sizes, "source").drop("source")


@query("attach_summary", """
select lang, n, (select count(distinct text) from documents) as all_texts,
(select max(n_chars) from documents) as longest from (select lang, count(*) as n from documents group by lang)""")
def attach_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-row summary on every row, as scalar subqueries."""
    docs = load(spark, sf_dir, "documents")
    texts = docs.select("text").distinct().agg(F.count("*")).scalar()
    return docs.groupBy("lang").agg(F.count("*").alias("n")).select(
        "lang", "n", texts.alias("all_texts"), docs.agg(F.max("n_chars")).scalar().alias("longest"))


@query("union_ids", "select text from documents union select text from benchmark")
def union_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of two tables."""
    return S.union_ids(load(spark, sf_dir, "documents").select("text"), load(spark, sf_dir, "benchmark").select("text"))


@query("concat_tables", """
select source_table, lang, count(*) as n, count(distinct text) as texts from (select 'documents' as source_table, lang, text from documents
union all select 'benchmark', null, text from benchmark union all select role, null, text from conversations) group by all""")
def concat_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of different columns, one after the other."""
    both = S.concat_tables(load(spark, sf_dir, "documents").select(F.lit("documents").alias("source_table"), "lang", "text"),
                           load(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("source_table"), "text"),
                           load(spark, sf_dir, "conversations").select(F.col("role").alias("source_table"), "text"))
    per_text = both.groupBy("source_table", "lang", "text").agg(F.count("*").alias("n"))
    return per_text.groupBy("source_table", "lang").agg(F.sum("n").alias("n"), F.count("text").alias("texts"))


@query("difference_ids", "select doc_id from documents where not exists (select 1 from labels l where l.doc_id = documents.doc_id and toxic = 1)")
def difference_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one table that are not in another."""
    return S.difference_ids(load(spark, sf_dir, "documents").select("doc_id"),
                            load(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"))


@query("distinct_ids", "select distinct user_id as id from events")
def distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.distinct_ids(load(spark, sf_dir, "events").select(F.col("user_id").alias("id")))


@query("order_ids", "select distinct cast(user_id as varchar) as id from events order by id")
def order_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ids, sorted as text."""
    return A.distinct_ids(load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"))).orderBy("id")


@query("dedup_report", """
select lang, source, count(*) as before, count(distinct text) as after from documents group by lang, source""")
def dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows before and after dedup per output."""
    return A.dedup_report(load(spark, sf_dir, "documents"), ["lang", "source"], "text")


@query("keep_first_turn", """
select conv_id, role, turn, md5(text) as text_md5 from (select *, row_number() over (partition by conv_id, role order by turn) as r
from conversations) where r = 1""")
def keep_first_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row per composite key."""
    firsts = W.keep_first(load(spark, sf_dir, "conversations"), ["conv_id", "role"], ["turn"])
    return firsts.select("conv_id", "role", "turn", F.md5("text").alias("text_md5"))


@query("share_within_group", """
select lang, source, n, round(n / (sum(n) over (partition by lang)), 6)::double as share
from (select lang, source, count(*) as n from documents group by lang, source)""")
def share_within_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each source within its language."""
    counts = load(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return W.share_within_group(counts, "lang").withColumn("share", F.round("share", 6))


SQL_FAILED = "event_type = 'error'"


def streaks(events: DataFrame, limit: int = 3) -> DataFrame:
    """Streaks of errors per user, one piece of the time line per day."""
    return W.failure_streak(events, "user_id", ["ts", "event_id"], F.col("event_type") == "error",
                            F.date_trunc("day", "ts"), limit)


@query("failure_streak", f"""
with islands as (select *, sum(case when {SQL_FAILED} then 0 else 1 end) over (partition by user_id order by ts, event_id) as island
from events)
select event_id, user_id, streak, streak >= 3 as tripped from (select event_id, user_id,
(sum(case when {SQL_FAILED} then 1 else 0 end) over (partition by user_id, island order by ts, event_id))::bigint as streak from islands)""")
def failure_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors in a row per user, reset by any other event."""
    return streaks(load(spark, sf_dir, "events")).select("event_id", "user_id", "streak", "tripped")


@query("label_share_by_topic", """
select source as topic, round(count(*) filter (toxic = 1) / count(*), 6) as "LABEL_0",
round(count(*) filter (toxic = 0 and quality = 0) / count(*), 6) as "LABEL_1",
round(count(*) filter (toxic = 0 and quality = 1) / count(*), 6) as "LABEL_2"
from documents join labels using (doc_id) group by source""")
def label_share_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each label per topic; the label columns stand in for sentiment."""
    label = F.when(F.col("toxic") == 1, "LABEL_0").when(F.col("quality") == 0, "LABEL_1").otherwise("LABEL_2")
    labels = load(spark, sf_dir, "labels").select("doc_id", label.alias("label"))
    docs = load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("topic")).join(labels, "doc_id")
    names = ["LABEL_0", "LABEL_1", "LABEL_2"]
    shares = A.label_shares(docs, "topic", "label", names)
    return shares.select("topic", *[F.round(n, 6).alias(n) for n in names])


@query("renumber_topics_by_size", """
with sizes as (select user_id % 40 - 1 as cluster, count(*) as n, min(event_id) as min_id from events group by 1)
select cluster, n, case when cluster = -1 then -1 else (row_number() over (partition by cluster = -1 order by n desc, min_id))::int - 1 end as topic
from sizes""")
def renumber_topics_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic 0 is the largest; outliers keep -1."""
    sizes = load(spark, sf_dir, "events").groupBy((F.col("user_id") % 40 - 1).alias("cluster")).agg(
        F.count("*").alias("n"), F.min("event_id").alias("min_id"))
    return W.renumber_by_size(cut_lineage(sizes)).select("cluster", "n", "topic")


@query("topic_frequency_over_time", """
with span as (select min(epoch_us(ts))::double as lo, max(epoch_us(ts))::double as hi from events),
binned as (select event_type as topic, least(greatest(ceil((epoch_us(ts)::double - lo) / ((hi - lo) / 5)) - 1, 0), 4)::int as bin, lo, hi
from events, span)
select topic, bin, count(*) as frequency,
floor(case when bin = 0 then any_value(lo) - (any_value(hi) - any_value(lo)) * 0.001
else any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 5 end)::bigint as start_micros
from binned group by topic, bin""")
def topic_frequency_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per topic and equal-width time bin."""
    events = load(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), "ts")
    return T.topic_frequency_over_time(T.add_time_bin(events, "ts", 5)).select("topic", "bin", "frequency",
                                                           F.unix_micros("bin_start").alias("start_micros"))
