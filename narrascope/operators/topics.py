"""Topic tables from (doc, topic, terms): class-based TF-IDF, names, representative docs, time lines.

The weights follow Grootendorst (2022), arXiv:2203.05794: the docs of a topic count as one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from narrascope import fixed_values as fixed
from narrascope.functions import text as X
from narrascope.functions import time as TM
from narrascope.operators.aggregates import topic_counts
from narrascope.operators.packed import chunks, map_packed, packed, places
from narrascope.operators.rows import compute_once, explode_rows
from narrascope.operators.windows import first_k
from narrascope.session import cut_lineage

#: Occurrences of terms that a task counts at once, rows of a batch it reads (texts can be long) and of one it gives.
CHUNK, READ_ROWS, GIVEN_ROWS = 1 << 22, 512, 1 << 16
#: Rows of many small groups that a task works on at once.
SORTED_ROWS = 1 << 20
#: Sums by doc and topic that a task keeps, and products of docs and weights that it makes at once.
SUMS, PRODUCTS = 1 << 24, 1 << 22


@lru_cache(maxsize=1)
def english_stop_words() -> tuple[str, ...]:
    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


def terms_of(value: Column, stop_words: Iterable[str], max_n: int = 2) -> Column:
    """Words without stop words, followed by their n-grams up to max_n."""
    stop = list(stop_words)
    tokens = X.words(value)
    if stop:
        tokens = F.filter(tokens, lambda t: ~t.isin(stop))
    return tokens if max_n == 1 else F.flatten(F.array(*[X.ngrams(tokens, n) for n in range(1, max_n + 1)]))


def tokenise_ngrams(df: DataFrame, text: str = "clean_text", stop_words: Iterable[str] | None = None,
                    max_n: int = 2, to: str = "terms") -> DataFrame:
    """Add the array of terms. Tokens are cut once, in their own projection."""
    stop = english_stop_words() if stop_words is None else stop_words
    df = df.withColumn(to, terms_of(F.col(text), stop, 1))
    if max_n > 1:
        grams = [X.ngrams(F.col(to), n) for n in range(2, max_n + 1)]
        df = df.withColumn(to, F.concat(F.col(to), *grams))
    return df


def _counted(keys: Sequence[str], held: list[pa.RecordBatch]) -> pa.Table:
    """(keys, term, n) of some batches (keys, terms): each occurrence is one number made of the places of its keys and term."""
    table = pa.Table.from_batches(held).combine_chunks()
    lists = pa.concat_arrays(table.column(len(keys)).chunks)
    terms = lists.flatten().dictionary_encode(null_encoding="encode")
    group, columns = np.zeros(len(lists), np.int64), []
    for key in keys:
        places, values = _places(table, key)
        columns.append(values)
        group = group * max(1, len(values)) + places
    # Numbers of the groups that are there, so that no product of many keys outgrows 64 bits.
    groups, group = np.unique(group, return_inverse=True)
    size = max(1, len(terms.dictionary))
    lengths = lists.value_lengths().fill_null(0).to_numpy()
    found, n = np.unique(np.repeat(group, lengths) * size + terms.indices.to_numpy(), return_counts=True)
    group, arrays = groups[found // size], []
    for values in reversed(columns):
        arrays.append(values.take(pa.array(group % max(1, len(values)))))
        group = group // max(1, len(values))
    term = pa.DictionaryArray.from_arrays(pa.array(found % size, pa.int32()), terms.dictionary)
    out = pa.Table.from_arrays([*reversed(arrays), term, pa.array(n.astype(np.int64))], names=[*keys, "term", "n"])
    return out.filter(pa.array(terms.dictionary.is_valid().to_numpy(zero_copy_only=False)[found % size]))


def _occurrences(batch: pa.RecordBatch) -> int:
    return len(batch.column(batch.num_columns - 1).flatten())


def partial_counts(df: DataFrame, keys: Sequence[str] = ("topic",), terms: str = "terms") -> DataFrame:
    """(keys, term, n), counted in chunks of bounded size: rows of different chunks are still to be added up.

    The counts carry how to make them as packed blocks, for those who deal them by term: so they are packed where they are counted.
    """
    keys, most = list(keys), CHUNK
    schema = StructType([df.schema[k] for k in keys]).add("term", StringType()).add("n", LongType())
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(READ_ROWS))
    rows, make = df.select(*keys, F.col(terms).alias("terms")), partial(_counted, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in chunks(batches, most, _occurrences):
            table = make(held)
            yield from table.set_column(len(keys), "term", table.column("term").cast(pa.string())).to_batches(GIVEN_ROWS)

    counts = rows.mapInArrow(run, schema)
    counts.as_blocks = lambda: packed(rows, make, rows=most, size=_occurrences)
    return counts


def class_term_frequency(df: DataFrame, keys: Sequence[str] = ("topic",), terms: str = "terms") -> DataFrame:
    """(keys, term, n). Counted map side, so common terms and large topics shuffle one row per chunk."""
    return partial_counts(df, keys, terms).groupBy(*keys, "term").agg(F.sum("n").alias("n"))


def map_terms(blocks: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str | StructType) -> DataFrame:
    """What `run` makes of tables of all rows of some terms, given in blocks. For many terms of a few rows, which cost windows and
    aggregates much more than their rows, and shuffles much more than their letters."""
    blocks.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(READ_ROWS))
    return map_packed(blocks, lambda tables: (run(table[0]) for table in tables), schema, SORTED_ROWS)


def _blocks(counts: DataFrame, *columns: str) -> DataFrame:
    """Counts as blocks, which those of `partial_counts` can be made as."""
    made = getattr(counts, "as_blocks", None)
    return made() if made else packed(counts.select(*columns))


def _places(table: pa.Table, name: str) -> tuple[np.ndarray, pa.Array]:
    """Each row's place among the distinct values of a column, nulls being one of them, and these."""
    at, values = places([table], name)
    return at[0], values


def document_frequency(term_counts: DataFrame) -> DataFrame:
    """(term, df, f): number of topics with the term, and its count over all topics."""
    return term_counts.groupBy("term").agg(F.count("topic").alias("df"), F.sum("n").alias("f"))


def topic_number(term_counts: DataFrame) -> Column:
    """Number of topics, as a scalar subquery."""
    return term_counts.select("topic").distinct().agg(F.count("*")).scalar()


def _with_spread(table: pa.Table, min_df: int) -> pa.Table:
    """(topic, term, n, df, f, first) of all rows of some terms (topic, term, n); rarer terms are one row for each topic, without term."""
    topic, topics = _places(table, "topic")
    term, terms = _places(table, "term")
    size = max(1, len(topics))
    found, at = np.unique(term * size + topic, return_inverse=True)
    n = np.zeros(len(found), np.int64)
    np.add.at(n, at, table.column("n").to_numpy())
    term, topic = found // size, found % size
    begins = np.flatnonzero(np.diff(term, prepend=-1))
    lengths = np.diff(begins, append=len(term))
    known = topics.is_valid().to_numpy(zero_copy_only=False)[topic].astype(np.int64)
    df, f = np.repeat(np.add.reduceat(known, begins), lengths), np.repeat(np.add.reduceat(n, begins), lengths)
    first = np.zeros(len(term), bool)
    first[begins] = True
    kept = df >= min_df
    rest, at = np.unique(topic[~kept], return_inverse=True)
    of_rest = np.zeros(len(rest), np.int64)
    np.add.at(of_rest, at, n[~kept])
    none = np.zeros(len(rest), np.int64)
    rare = np.concatenate((np.zeros(int(kept.sum()), bool), np.ones(len(rest), bool)))
    return pa.table({"topic": topics.take(pa.array(np.concatenate((topic[kept], rest)))),
                     "term": terms.take(pa.array(np.concatenate((term[kept], none)), mask=rare)),
                     "n": np.concatenate((n[kept], of_rest)), "df": np.concatenate((df[kept], none)),
                     "f": np.concatenate((f[kept], none)), "_first": np.concatenate((first[kept], none.astype(bool)))})


def spread_of_terms(term_counts: DataFrame, min_df: int = fixed.MIN_DF) -> DataFrame:
    """Counts, those of the same topic and term added up, with (df, f) of their term; written out. Rows without term stand for the
    terms of fewer than `min_df` topics, so that topics without any other are still told."""
    schema = StructType([StructField(c, term_counts.schema[c].dataType) for c in ("topic", "term")])
    for name in ("n", "df", "f"):
        schema = schema.add(name, LongType())
    return cut_lineage(map_terms(_blocks(term_counts, "topic", "term", "n"), partial(_with_spread, min_df=min_df), schema.add("_first", "boolean")))


def _in_vocabulary(topics: Column, min_df: int = fixed.MIN_DF, max_df: float = fixed.MAX_DF) -> Column:
    return (F.col("df") >= min_df) & (F.col("df") <= topics * F.lit(max_df))


def prune_vocabulary(term_counts: DataFrame, min_df: int = fixed.MIN_DF, max_df: float = fixed.MAX_DF,
                     topics: Column | None = None) -> DataFrame:
    """(term, df, f) of terms in at least min_df topics and at most a share max_df of them. Without `topics` counts of the same
    topic and term are added up, so those of `partial_counts` will do."""
    if topics is not None:
        return document_frequency(term_counts).where(_in_vocabulary(topics, min_df, max_df))
    # The number of topics and the terms read the same written counts, so that these are made once.
    spread = spread_of_terms(term_counts, min_df)
    return spread.where("_first").where("term is not null").where(_in_vocabulary(topic_number(spread), min_df, max_df)).select("term", "df", "f")


def ctfidf(term_counts: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(topic, term, n, idf, weight): weight = n / words of the topic * ln(1 + A / f).

    f is the count of the term over all topics and A the mean number of words per topic, rounded down.
    The counts are written out with the spread of their terms, as the weights, the topic sizes and A all read them. Sizes are
    written too, so that the planner knows how few they are. Without a vocabulary counts of the same topic and term
    are added up, so those of `partial_counts` will do.
    """
    if vocabulary is None:
        spread = spread_of_terms(term_counts)
        kept = spread.where("term is not null").where(_in_vocabulary(topic_number(spread))).select("topic", "term", "n", "f")
    else:
        kept = cut_lineage(term_counts.repartition("term").join(vocabulary.select("term", "f"), "term"))
    sizes = cut_lineage(kept.groupBy("topic").agg(F.sum("n").alias("_words")))
    mean = sizes.agg(F.floor(F.avg("_words")).cast("double")).scalar()
    return (kept.join(sizes, "topic")
            .withColumn("idf", F.log(F.lit(1.0) + mean / F.col("f")))
            .select("topic", "term", "n", "idf", (F.col("n") / F.col("_words") * F.col("idf")).alias("weight")))


def top_terms(weights: DataFrame, k: int = fixed.TOP_TERMS, keys: Sequence[str] = ("topic",)) -> DataFrame:
    """The k heaviest terms per topic with their rank, ties by the term."""
    return first_k(weights, list(keys), [F.desc("weight"), F.col("term")], k, rank="rank")


def terms_array(ranked: DataFrame, keys: Sequence[str] = ("topic",), to: str = "representation") -> DataFrame:
    """Ranked terms as one array per topic; there are k of them at most."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return ranked.groupBy(*keys).agg(F.transform(pairs, lambda p: p["term"]).alias(to))


def topic_name(topic: Column, terms: Column, n: int = fixed.NAME_TERMS) -> Column:
    return F.concat_ws("_", topic.cast("string"), F.slice(terms, 1, n))


def count_in_row(docs: DataFrame, terms: str, *keep: str) -> DataFrame:
    """(keep, term, tf) of each row: its terms are sorted, and a run of equal ones is counted by where the next begins."""
    # `array_sort` would call a comparator for each two terms.
    docs = compute_once(docs, _sorted=F.sort_array(F.array_compact(terms)))
    begins = F.filter(F.sequence(F.lit(1), F.size("_sorted")), lambda i: (i == 1) | (
        F.get("_sorted", i - 1) != F.get("_sorted", i - 2)))
    docs = compute_once(docs.where(F.size("_sorted") > 0), _begins=begins)
    runs = F.transform("_begins", lambda at, k: F.struct(
        F.get("_sorted", at - 1).alias("term"),
        (F.coalesce(F.get("_begins", k + 1), F.size("_sorted") + 1) - at).cast("long").alias("tf")))
    return explode_rows(docs, runs, "_run", *keep).select(*keep, "_run.term", "_run.tf")


def _row_terms(keys: Sequence[str], held: list[pa.RecordBatch]) -> pa.Table:
    """(keys, term, n) of each row of some batches (keys, terms)."""
    table = pa.Table.from_batches(held).combine_chunks()
    lists = pa.concat_arrays(table.column(len(keys)).chunks)
    terms = lists.flatten().dictionary_encode(null_encoding="encode")
    size, lengths = max(1, len(terms.dictionary)), lists.value_lengths().fill_null(0).to_numpy()
    found, n = np.unique(np.repeat(np.arange(len(lists)), lengths) * size + terms.indices.to_numpy(), return_counts=True)
    found, n = (x[terms.dictionary.is_valid().to_numpy(zero_copy_only=False)[found % size]] for x in (found, n))
    rows = pa.array(found // size)
    term = pa.DictionaryArray.from_arrays(pa.array(found % size, pa.int32()), terms.dictionary)
    return pa.table({**{k: table.column(k).take(rows) for k in keys}, "term": term, "n": n})


def _with_weights(docs: DataFrame, keys: Sequence[str], terms: str, weights: DataFrame,
                  run: Callable[[Iterator[tuple[pa.Table, pa.Table]]], Iterator[pa.Table]], schema: StructType) -> DataFrame:
    """What `run` makes of tables (keys, term, n) of the terms in each doc and of the weights of the same terms.

    There are as many tasks as the cluster runs in two rounds, since a task's sums take a row for each doc: more tasks would give more of
    them. None holds more than a bounded number of rows.
    """
    spark, most = docs.sparkSession, SORTED_ROWS
    rows = docs.select(*keys, F.col(terms).alias("terms"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(READ_ROWS))
    blocks = packed(weights).unionByName(packed(rows, partial(_row_terms, list(keys)), 1, CHUNK, _occurrences))

    def both(tables: Iterator[dict[int, pa.Table]]) -> Iterator[pa.Table]:
        yield from run((t[1], t[0]) for t in tables if len(t) == 2)

    return map_packed(blocks, both, schema, most, max(2 * spark.sparkContext.defaultParallelism, 1))


def _parts_of_cosine(doc_id: str, found: Iterator[tuple[pa.Table, pa.Table]]) -> Iterator[pa.Table]:
    """(doc_id, topic, _dot, _doc2) summed over some terms: the products with the weights of the doc's topic, and its own squares."""
    for docs, weights in found:
        (term, own_term), terms = places([docs, weights], "term")
        (topic, own_topic), topics = places([docs, weights], "topic")
        size = max(1, len(topics))
        known, at = np.unique(own_term * size + own_topic, return_inverse=True)
        idf, weight = weights.column("idf").to_numpy(), weights.column("weight").to_numpy()
        product, square = np.bincount(at, idf * weight), np.bincount(at, idf * idf)
        wanted = term * size + topic
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        hit = np.flatnonzero(known[at] == wanted)
        if not len(hit):
            continue
        at, tf = at[hit], docs.column("n").to_numpy()[hit]
        (doc,), ids = places([docs], doc_id)
        groups, group = np.unique(doc[hit] * size + topic[hit], return_inverse=True)
        yield pa.table({doc_id: ids.take(pa.array(groups // size)), "topic": topics.take(pa.array(groups % size)),
                        "_dot": np.bincount(group, tf * product[at]), "_doc2": np.bincount(group, tf * tf * square[at])})


def doc_similarity(docs: DataFrame, weights: DataFrame, doc_id: str = "doc_id", terms: str = "terms") -> DataFrame:
    """(doc_id, topic, similarity): cosine of a doc's term vector with the weights of its own topic.

    The terms of a doc are counted in its row; packed by term they meet the weights, and sums by doc are all that moves on.
    """
    kind = docs.schema["topic"].dataType
    schema = StructType([docs.schema[doc_id], docs.schema["topic"]]).add("_dot", "double").add("_doc2", "double")
    known = weights.where("topic is not null").select(F.col("topic").cast(kind).alias("topic"), "term", "idf", "weight")
    parts = _with_weights(docs.where("topic is not null"), [doc_id, "topic"], terms, known, partial(_parts_of_cosine, doc_id), schema)
    sums = parts.groupBy(doc_id, "topic").agg(F.sum("_dot").alias("_dot"), F.sum("_doc2").alias("_doc2"))
    norms = cut_lineage(weights.groupBy("topic").agg(F.sum(F.col("weight") * F.col("weight")).alias("_topic2")))
    return sums.join(norms, "topic").select(
        doc_id, "topic", F.round(F.col("_dot") / F.sqrt(F.col("_doc2") * F.col("_topic2")), 9).alias("similarity"))


def representative_docs(docs: DataFrame, weights: DataFrame, doc_id: str = "doc_id", k: int = fixed.REPRESENTATIVE_DOCS,
                        similarity: DataFrame | None = None) -> DataFrame:
    """(topic, rank, doc_id, similarity) of the k docs nearest to each topic, over all docs."""
    similarity = doc_similarity(docs, weights, doc_id) if similarity is None else similarity
    return first_k(similarity, "topic", [F.desc("similarity"), F.col(doc_id)], k, rank="rank")


def with_text(ranked: DataFrame, docs: DataFrame, text: str = "clean_text", doc_id: str = "doc_id") -> DataFrame:
    """Texts of the few chosen docs. These are written, so that the planner sends them to the texts instead of moving all of them."""
    return cut_lineage(ranked).join(docs.select(doc_id, F.col(text).alias("doc")), doc_id).select("topic", "rank", doc_id, "doc")


def topic_info(docs: DataFrame, weights: DataFrame, representative: DataFrame | None = None) -> DataFrame:
    """(topic, count, name, representation, representative_docs), outliers first."""
    info = topic_counts(docs).join(terms_array(top_terms(weights)), "topic", "left")
    info = info.withColumn("representation", F.coalesce("representation", F.array().cast("array<string>")))
    info = info.withColumn("name", topic_name(F.col("topic"), F.col("representation")))
    columns = ["topic", "count", "name", "representation"]
    if representative is not None:
        pairs = F.array_sort(F.collect_list(F.struct("rank", "doc")))
        texts = representative.groupBy("topic").agg(F.transform(pairs, lambda p: p["doc"]).alias("representative_docs"))
        info = info.join(texts, "topic", "left")
        columns.append("representative_docs")
    return info.select(*columns).orderBy("topic")


def add_time_bin(df: DataFrame, time: str, bins: int = fixed.TIME_BINS) -> DataFrame:
    """Add `bin` and its left edge `bin_start`; rows without time are left out. The time range is one scalar subquery."""
    micros = F.unix_micros(F.col(time)).cast("double")
    span = df.select(micros.alias("_t")).agg(F.struct(F.min("_t").alias("low"), F.max("_t").alias("high")).alias("span")).scalar()
    df = df.where(F.col(time).isNotNull()).withColumn("_span", span)
    low, high = F.col("_span.low"), F.col("_span.high")
    df = df.withColumn("bin", TM.equal_width_bin(micros, low, high, bins))
    edge = TM.bin_left_edge(F.col("bin"), low, high, bins)
    return df.withColumn("bin_start", F.timestamp_micros(F.floor(edge).cast("long"))).drop("_span")


def topic_frequency_over_time(binned: DataFrame) -> DataFrame:
    """Docs per topic and bin; empty cells are absent."""
    return binned.groupBy("topic", "bin", "bin_start").agg(F.count("*").alias("frequency"))


def _local_weights(table: pa.Table) -> pa.Table:
    """(topic, bin, term, _all, _own, _before, _again) of rows of counts and of rows of weights, which have no bin.

    _own is n * idf, _before that of the bin before, if the term is in it, and _again whether the term is in the next bin.
    """
    topic, topics = _places(table, "topic")
    term, terms = _places(table, "term")
    size = max(1, len(topics))
    groups, group = np.unique(term * size + topic, return_inverse=True)
    counted = table.column("bin").is_valid().to_numpy()
    idf, overall = np.full(len(groups), np.nan), np.zeros(len(groups))
    idf[group[~counted]] = table.column("idf").to_numpy()[~counted]
    overall[group[~counted]] = table.column("weight").to_numpy()[~counted]
    kept = counted & ~np.isnan(idf[group])
    rows, at = table.filter(pa.array(kept)), group[kept]
    bins = rows.column("bin").to_numpy().astype(np.int64)
    order = np.lexsort((bins, at))
    at, bins, n = at[order], bins[order], rows.column("n").to_numpy()[order]
    begins = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(bins, prepend=-1) != 0))
    n = np.add.reduceat(n, begins) if len(begins) else n
    at, bins = at[begins], bins[begins]
    own = n * idf[at]
    follows = np.zeros(len(at) + 1, bool)
    follows[1:-1] = (at[1:] == at[:-1]) & (bins[1:] == bins[:-1] + 1)
    before = np.concatenate((np.zeros(1), own))[:-1]
    return pa.table({"topic": topics.take(pa.array(groups[at] % size)), "bin": pa.array(bins, table.schema.field("bin").type),
                     "term": terms.take(pa.array(groups[at] // size)), "_all": overall[at], "_own": own,
                     "_before": pa.array(before, mask=~follows[:-1]), "_again": follows[1:]})


def bin_weights(binned: DataFrame, weights: DataFrame, blend_previous: bool = True, blend_global: bool = True,
                terms: str = "terms", k: int = fixed.BIN_TERMS) -> DataFrame:
    """(topic, bin, term, weight): c-TF-IDF within each bin on the vocabulary and idf of all bins, blended.

    `blend_previous` averages with the topic's own weights one bin earlier, `blend_global` with its weights over all
    time (both on, as in the method's usual settings). Both are sums of shares, so a term missing on one side counts
    as 0 there. Of the terms that a bin and the one before lack, only the topic's k heaviest are listed: no other
    can be among the bin's k heaviest.

    Counts are dealt once, by topic and term; there they meet their weights and the bin before and after. Sums of bins and
    topics are written, as small tables that the planner sends to the counts.
    """
    keys = ["topic", "bin"]
    counts = partial_counts(binned, keys, terms)
    # The idf of a term is the same in all topics; the topic's own row carries it, without a bin.
    none = F.lit(None)
    both = counts.select(*keys, "term", "n", none.cast("double").alias("idf"), none.cast("double").alias("weight")).unionByName(
        weights.select("topic", none.cast(counts.schema["bin"].dataType).alias("bin"), "term", none.cast("long").alias("n"), "idf", "weight"))
    schema = StructType([counts.schema[c] for c in (*keys, "term")])
    for name in ("_all", "_own", "_before"):
        schema = schema.add(name, "double")
    local = cut_lineage(map_terms(packed(both.where("topic is not null")), _local_weights, schema.add("_again", "boolean")))

    cells = local.groupBy(*keys).agg(F.sum("_own").alias("_sum"))
    bins = Window.partitionBy("topic").orderBy("bin")
    cells = cut_lineage(cells.select(
        *keys, "_sum", F.when(F.lag("bin").over(bins) == F.col("bin") - 1, F.lag("_sum").over(bins)).alias("_sum_before"),
        F.coalesce(F.lead("bin").over(bins) == F.col("bin") + 1, F.lit(False)).alias("_goes_on")))
    outer, overall = (0.5, F.col("_all") / F.col("_total") * 0.5) if blend_global else (1.0, F.lit(0.0))
    rows, share = local.join(cells, keys), F.col("_own") / F.col("_sum")
    totals = cut_lineage(weights.groupBy("topic").agg(F.sum("weight").alias("_total")))
    rows = rows.join(totals, "topic")
    here = share * outer
    if blend_previous:
        before = F.coalesce(F.col("_before") / F.col("_sum_before"), F.lit(0.0))
        here = F.when(F.col("_sum_before").isNotNull(), (share + before) * (0.5 * outer)).otherwise(here)
    found = [F.struct("bin", (here + overall).alias("weight"))]
    if blend_previous:
        # A term that the next bin lacks still has half of its share there.
        found.append(F.when(F.col("_goes_on") & ~F.col("_again"), F.struct(
            (F.col("bin") + 1).alias("bin"), (share * (0.5 * outer) + overall).alias("weight"))))
    rows = explode_rows(rows, F.array(*found), "_found", "topic", "term").select("topic", "_found.bin", "term", "_found.weight")
    if not blend_global:
        return rows
    shares = weights.join(totals, "topic").select("topic", "term", F.round(_overall_share(), 9).alias("_all"))
    heaviest = cut_lineage(first_k(shares, ["topic"], [F.desc("_all"), F.col("term")], k).select("topic", "term"))
    listed = cells.select(*keys).join(heaviest, "topic")
    absent = listed.join(rows.select(*keys, "term").join(heaviest, ["topic", "term"]), [*keys, "term"], "left_anti")
    heavy = weights.join(heaviest, ["topic", "term"]).join(totals, "topic").select("topic", "term", _overall_share().alias("weight"))
    return rows.unionByName(absent.join(heavy, ["topic", "term"]).select(*rows.columns))


def _overall_share() -> Column:
    """Half of a term's share of its topic's weight over all time."""
    return F.col("weight") / F.col("_total") * 0.5


def topics_over_time(docs: DataFrame, weights: DataFrame, time: str = "ts", bins: int = fixed.TIME_BINS,
                     blend_previous: bool = True, blend_global: bool = True, k: int = fixed.BIN_TERMS) -> DataFrame:
    """(topic, bin, words, frequency, timestamp) per topic and non-empty bin. Rows without time are left out."""
    # The frequencies read no terms, so nothing is gained by writing these, the largest of all columns.
    binned = add_time_bin(docs, time, bins).select("topic", "bin", "bin_start", "terms")
    # Sums in changing order differ in their last places: rounded, equal weights rank by their term.
    weighted = bin_weights(binned, weights, blend_previous, blend_global, k=k).withColumn("weight", F.round("weight", 9))
    words = terms_array(top_terms(weighted, k, ["topic", "bin"]), ["topic", "bin"], "words")
    return (topic_frequency_over_time(binned).join(words, ["topic", "bin"], "left")
            .select("topic", "bin", "words", "frequency", F.col("bin_start").alias("timestamp")))


def _dots(doc_id: str, topics: list[int], found: Iterator[tuple[pa.Table, pa.Table]]) -> Iterator[pa.Table]:
    """(doc_id, _dots, _length2) summed over some terms: for each topic, null where it has none of the terms, and the doc's own squares.

    Sums of the docs met so far are kept from table to table, as long as they are no more than SUMS.
    """
    numbers = np.array(topics, np.int64)
    width, ids, sums, held = len(topics), None, None, None

    def given() -> pa.Table:
        values = pa.array(sums[:, :width].ravel(), mask=~held.ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(ids) + 1) * width, width) if width else np.zeros(len(ids) + 1), pa.int32()), values)
        return pa.table({doc_id: ids, "_dots": lists, "_length2": sums[:, width]})

    for docs, weights in found:
        (term, own_term), terms = places([docs, weights], "term")
        (doc,), own_ids = places([docs], doc_id)
        size = max(1, len(terms))
        # Rows of one doc count together.
        pairs, at = np.unique(doc * size + term, return_inverse=True)
        tf, doc, term = np.bincount(at, docs.column("n").to_numpy()), pairs // size, pairs % size
        idf = np.full(size, -np.inf)
        np.maximum.at(idf, own_term, weights.column("idf").to_numpy())
        known = np.isfinite(idf[term])
        tf, doc, term = tf[known], doc[known], term[known]
        real = weights.column("_w").is_valid().to_numpy()
        topic, own_term = weights.column("topic").filter(pa.array(real)).to_numpy(), own_term[real]
        w, order = weights.column("_w").filter(pa.array(real)).to_numpy(), np.argsort(own_term, kind="stable")
        topic, w = np.searchsorted(numbers, topic[order]), w[order]
        first = np.searchsorted(own_term[order], np.arange(size + 1))
        many = np.diff(first)[term]
        for low, high in _slices(many, PRODUCTS):
            d, t, n = doc[low:high], term[low:high], many[low:high]
            some, d = np.unique(d, return_inverse=True)
            row = np.repeat(first[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            cell = np.repeat(d, n) * width + topic[row]
            part = np.zeros((len(some), width + 1))
            part[:, :width] = np.bincount(cell, np.repeat(tf[low:high], n) * w[row], len(some) * width).reshape(len(some), width)
            part[:, width] = np.bincount(d, np.square(tf[low:high] * idf[t]), len(some))
            met = np.zeros(len(some) * width, bool)
            met[cell] = True
            if ids is not None and sums.size + part.size > SUMS:
                yield given()
                ids = None
            mine = own_ids.take(pa.array(some))
            if ids is None:
                ids, sums, held = mine, part, met.reshape(len(some), width)
                continue
            place = pc.index_in(mine, value_set=ids)
            new = place.is_null().to_numpy(zero_copy_only=False)
            place = place.fill_null(0).to_numpy()
            sums[place[~new]] += part[~new]
            held[place[~new]] |= met.reshape(len(some), width)[~new]
            if new.any():
                ids = pa.concat_arrays([ids, mine.filter(pa.array(new))])
                sums, held = np.concatenate((sums, part[new])), np.concatenate((held, met.reshape(len(some), width)[new]))
    if ids is not None:
        yield given()


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes together are about `most`."""
    ends = np.searchsorted(np.cumsum(sizes), np.arange(most, int(sizes.sum()) + most, most), "right")
    edges = np.unique(np.concatenate(([0], ends, [len(sizes)])))
    return zip(edges[:-1].tolist(), edges[1:].tolist())


def assign_by_terms(docs: DataFrame, weights: DataFrame, doc_id: str = "doc_id", terms: str = "terms",
                    noise: int = -1) -> DataFrame:
    """(doc_id, topic, similarity) of new docs: the topic with the nearest weights, or noise.

    Packed by term the docs meet the weights; a task gives one row of sums over all topics for each doc.
    """
    kind = weights.schema["topic"].dataType
    norms = cut_lineage(weights.where(F.col("topic") != noise).groupBy("topic").agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm")))
    topics = sorted(r["topic"] for r in norms.select("topic").collect())
    # Weights of noise and of no topic count for the length of a doc only.
    unit = weights.join(norms, "topic", "left").select("topic", "term", "idf", (F.col("idf") * F.col("weight") / F.col("_norm")).alias("_w"))
    schema = StructType([docs.schema[doc_id]]).add("_dots", ArrayType(DoubleType())).add("_length2", "double")
    parts = _with_weights(docs.where(F.col(doc_id).isNotNull()), [doc_id], terms, unit, partial(_dots, doc_id, topics), schema)
    added = F.aggregate("_parts", F.array_repeat(F.lit(None).cast("double"), len(topics)), lambda a, b: F.zip_with(
        a, b, lambda x, y: F.coalesce(x + y, x, y)))
    sums = parts.groupBy(doc_id).agg(F.collect_list("_dots").alias("_parts"), F.sqrt(F.sum("_length2")).alias("_length"))
    numbers = F.array(*[F.lit(t) for t in topics]).cast(f"array<{kind.simpleString()}>")
    # The largest; of equal ones the first topic.
    best = F.array_max(F.zip_with(added, numbers, lambda d, t: F.when(d.isNotNull(), F.struct(d.alias("_dot"), (-t).alias("t")))))
    scored = sums.select(doc_id, "_length", best.alias("b")).where("b is not null").select(
        doc_id, (-F.col("b.t")).cast(kind).alias("topic"), (F.col("b._dot") / F.col("_length")).alias("similarity"))
    return (docs.select(doc_id).join(scored, doc_id, "left")
            .select(doc_id, F.coalesce("topic", F.lit(noise)).alias("topic"),
                    F.coalesce("similarity", F.lit(0.0)).alias("similarity")))
