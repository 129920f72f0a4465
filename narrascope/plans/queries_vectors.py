"""Queries over vectors and their clusters, dense embeddings, languages within a text, and state that expires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.operators import cluster as C
from narrascope.operators import lsa as L
from narrascope.operators import models as M
from narrascope.operators import neighbours as N
from narrascope.operators import reachability as R
from narrascope.operators import segments as G
from narrascope.plans.queries_io import feed_events
from narrascope.plans.queries_topics import SQL_TERMS, topic_docs
from narrascope.plans.registry import load, query
from narrascope.session import cut_lineage, scratch_path
from narrascope.streaming import jobs as J


@query("near_pairs", """
with v as (select min(vec_id) as id, embedding::double[] as x from embeddings group by embedding)
select a.id as a, b.id as b, round(list_cosine_similarity(a.x, b.x), 6) as cosine from v a join v b on a.id < b.id
where list_cosine_similarity(a.x, b.x) >= 0.35""")
def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of vectors of a cosine of at least 0.35, by cells along principal directions."""
    found = N.near_pairs_exact(load(spark, sf_dir, "embeddings"), 0.35)
    return found.select("a", "b", F.round("cosine", 6).alias("cosine"))


@query("near_pairs_projected")
def near_pairs_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs by random projections, each with a probability of 0.95 or more."""
    return N.near_pairs(load(spark, sf_dir, "embeddings"), 0.35, bits=5)


def thirds(points: DataFrame) -> DataFrame:
    """Three coordinates from all components: the sums of every third one."""
    def total(k: int) -> Column:
        own = F.filter("embedding", lambda v, i: i % 3 == k)
        return F.round(F.aggregate(own, F.lit(0.0), lambda s, v: s + v.cast("double")), 9)

    return points.select("vec_id", F.array(*map(total, range(3))).alias("x"))


SQL_THIRDS = "thirds as (select vec_id, " + ", ".join(
    f"round(list_sum([embedding[i]::double for i in range({k + 1}, 65, 3)]), 9) as x{k}" for k in range(3)) + " from embeddings)"


SQL_CELLS = f"""{SQL_THIRDS},
box as (select min(x0) as l0, min(x1) as l1, min(x2) as l2, greatest(max(x0) - min(x0), max(x1) - min(x1), max(x2) - min(x2)) as s from thirds),
placed as (select vec_id, """ + ", ".join(f"least(floor((x{k} - l{k}) / s * 8), 7)::int as c{k}" for k in range(3)) + """ from thirds, box),
cells as (select c0, c1, c2, count(*) as n from placed group by all),
dense as (select c.c0, c.c1, c.c2, any_value(c.n) as n from cells c join cells d on abs(c.c0 - d.c0) <= 1 and abs(c.c1 - d.c1) <= 1 and abs(c.c2 - d.c2) <= 1
    group by c.c0, c.c1, c.c2 having sum(d.n) >= 40),
reach as (select c0, c1, c2, c0 as r0, c1 as r1, c2 as r2 from dense union select r.c0, r.c1, r.c2, d.c0, d.c1, d.c2 from reach r join dense d
    on abs(r.r0 - d.c0) <= 1 and abs(r.r1 - d.c1) <= 1 and abs(r.r2 - d.c2) <= 1),
regions as (select c0, c1, c2, min(r0 * 10000 + r1 * 100 + r2) as region from reach group by all)"""


@query("density_regions", f"""with recursive {SQL_CELLS}
select count(*) as cells, sum(n)::bigint as points from regions join dense using (c0, c1, c2) group by region""")
def density_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected dense regions of one grid level, over three coordinates made of all components: cells and points of each."""
    regions = C.level_regions(thirds(load(spark, sf_dir, "embeddings")), "x", dims=3, level=3, min_points=40)
    return regions.groupBy("region").agg(F.count("*").alias("cells"), F.sum("n").alias("points")).drop("region")


@query("reachability_cut", f"""with recursive {SQL_THIRDS},
far as (select a.vec_id as u, b.vec_id as v, sqrt((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2) as d from thirds a, thirds b),
cores as (select u, d as core from far qualify row_number() over (partition by u order by d) = 5),
edges as (select u, v from far join cores a using (u) join cores b on b.u = v where greatest(d, a.core, b.core) <= 0.45),
reach as (select u, u as v from cores where core <= 0.45 union select r.u, e.v from reach r join edges e on r.v = e.u)
select c.u as vec_id, round(core, 6) as core, min(r.v) as component from cores c left join reach r on r.u = c.u group by c.u, core""")
def reachability_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core distances of all vectors, and what hangs together up to a distance in their mutual-reachability tree."""
    members, cells, box = R.collapse(thirds(load(spark, sf_dir, "embeddings")), "x", "vec_id", 3, 20)
    cores = R.core_distances(cells, box, 5)
    parts = R.cut_tree(cores, R.reachability_tree(cores, box), 0.45)
    found = members.join(cores.select("rep", "core"), "rep").join(parts, "rep", "left")
    return found.select(F.col("id").alias("vec_id"), F.round("core", 6).alias("core"), "component")


@query("reachability_clusters")
def reachability_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the mutual-reachability tree of the reduced vectors; -1 for outliers."""
    reduced = C.reduce_dimensions(load(spark, sf_dir, "embeddings"), 3).select(F.col("vec_id").alias("doc_id"), "reduced")
    return R.reachability_clusters(reduced, dims=3, levels=7)


@query("embed_svd", f"""with {SQL_TERMS}, dfs as (select term, count(distinct doc_id) as df from terms group by term),
vocabulary as (select term, ln((1.0 + (select count(*) from documents)) / (1.0 + df)) + 1.0 as idf from dfs order by df desc, term limit 48),
w as (select doc_id, term, count(*) * any_value(idf) as w from terms join vocabulary using (term) group by doc_id, term),
sizes as (select doc_id, sqrt(sum(w * w)) as size from w group by doc_id),
dots as (select a.doc_id, sum(a.w * b.w) as dot from w a join w b on b.doc_id = a.doc_id + 1 and a.term = b.term group by a.doc_id)
select s.doc_id, round(coalesce(dot, 0) / (s.size * n.size), 6) as cosine
from sizes s join sizes n on n.doc_id = s.doc_id + 1 left join dots d on d.doc_id = s.doc_id""")
def embed_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of the dense vectors of each document and the next: with as many directions as terms, that of their TF-IDF rows."""
    docs = topic_docs(spark, sf_dir)
    rows = cut_lineage(L.term_rows(docs, L.fit_vocabulary(docs, features=48)))
    vectors = L.embed_rows(rows, L.fit_directions(rows, 48, k=48)).select("doc_id", "embedding")
    following = vectors.select((F.col("doc_id") - 1).alias("doc_id"), F.col("embedding").alias("next"))
    cosine = F.aggregate(F.zip_with("embedding", "next", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    # Rounded sums close to 0 have no sign.
    return vectors.join(following, "doc_id").select("doc_id", (F.round(cosine, 6) + 0.0).alias("cosine"))


@query("language_segments")
def language_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages found in each document joined to the next one, by profiles counted on other documents."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.col("doc_id") % 5 < 2
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    mixed = docs.where("doc_id % 5 = 0").join(following, "doc_id").select("doc_id", F.concat_ws(" ", "text", "next").alias("text"))
    segments = G.language_segments(mixed, M.fit_language_profile(docs.where(~held)), "doc_id")
    return G.languages_within(segments, "doc_id").select("doc_id", F.array_join("languages", ",").alias("languages"))


@query("stream_dedup_expiry", "select user_id, event_type, count(*) as n from (select distinct user_id, event_type from events) group by all")
def stream_dedup_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per key over all batches, each key in a state that expires (here later than the data ends)."""
    path = scratch_path(spark, "dedup")

    def run(stream: DataFrame) -> None:
        keyed = stream.withColumn("key", F.concat_ws(":", "user_id", "event_type"))
        J.run_to_table(J.dedup_with_expiry(keyed, "key", "ts", "3650 days"), f"{path}/out", f"{path}/checkpoint")

    feed_events(spark, sf_dir, f"{path}/in", run)
    return spark.read.parquet(f"{path}/out").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
