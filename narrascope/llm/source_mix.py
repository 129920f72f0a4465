"""Mixing sources to target weights by a low-discrepancy schedule, with SQL functions only.

A slot of the mix is a block of words. Multiples of the golden ratio modulo 1, mapped through the cumulative
weights, name the source of each slot, so every stretch of the schedule holds the sources near their shares. The
slots of a source are ranked, and rank r takes the r-th block of the source: its documents in hashed order, cut into
equal blocks, which every pass over the source visits in another order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrascope.llm.spark import write_table

#: 2^32 over the golden ratio, and a prime that steps through the blocks of a pass.
GOLDEN, STEP = 2654435769, 2654435761
WEIGHTS = (5, 2, 1)
#: Slots and documents that one window sorts together.
CHUNK = 8192


def words(text: str = "text"):
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = 3) -> DataFrame:
    """Add sid (number by code point, null last), weight and target to sources (source, source_size).

    Shares of all words by weight; a target stops at `passes` times its source, and what is over goes to the others
    by weight. In order of the level at which they fill up, the sources before the first that stays below its level are
    full. One row per source, so one task orders them.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sources.withColumn("sid", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    filled = numbered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * passes).withColumn(
        "full_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full_at", "sid")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(order.rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    leveled = filled.withColumn("level", level)
    opened = F.min(F.when(F.col("full_at") > F.col("level"), F.struct("full_at", "sid", "level"))).over(everything)
    is_open = F.col("opened").isNotNull() & (F.struct("full_at", "sid") >= F.struct("opened.full_at", "opened.sid"))
    return leveled.withColumn("opened", opened).withColumn("target", F.when(
        is_open, F.col("weight") * F.col("opened.level")).otherwise(F.col("cap").cast("double"))).drop(
        "opened", "level", "full_at", "cap")


def schedule(sources: DataFrame, block_words: int) -> DataFrame:
    """The slots of the mix: (slot, sid, rank), sources having sid, source_size, target, goal, slots.

    A source stops once it has its slots. Where the points gave it fewer, the last ones follow at the end.
    """
    spark = sources.sparkSession
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    count = -(-total // block_words)
    ends = Window.orderBy("sid")
    unit = float(1 << 32)
    upper = F.floor(F.sum("target").over(ends.rowsBetween(Window.unboundedPreceding, 0)) / float(max(total, 1)) * unit)
    spans = sources.withColumn("upper", upper).withColumn("lower", F.lag("upper", 1, 0).over(ends)).where("upper > lower")
    spans = spans.select("sid", "slots", "lower", "upper", F.explode(F.expr(
        "sequence(shiftright(lower, 22), shiftright(upper - 1, 22))")).alias("bucket"))
    point = f"pmod(shiftleft(pmod(pmod(shiftright(slot, 16), 65536) * {GOLDEN}, 65536), 16) + pmod(slot, 65536) * {GOLDEN}, {1 << 32})"
    drawn = spark.range(count).withColumnRenamed("id", "slot").withColumn("point", F.expr(point)).withColumn(
        "bucket", F.shiftright("point", 22)).join(spans, "bucket").where("point >= lower and point < upper").select(
        "slot", "sid", "slots", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    # Ranks in two steps: within bounded chunks of the schedule, and of the chunks' counts.
    before = drawn.groupBy("sid", "chunk").count().withColumn("before", F.sum("count").over(
        Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = drawn.withColumn("own", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1).join(
        before, ["sid", "chunk"]).withColumn("rank", F.col("own") + F.coalesce("before", F.lit(0)))
    kept = ranked.where("rank < slots").select("slot", "sid", "rank")
    given = drawn.groupBy("sid").agg(F.count("*").alias("given"))
    late = sources.join(given, "sid", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < slots").select(
        "sid", F.explode(F.expr("sequence(given, slots - 1)")).alias("rank")).select(
        (F.col("rank") + count).alias("slot"), "sid", "rank")
    return kept.union(late)


def blocks_taken(sources: DataFrame, slots: DataFrame, block_words: int) -> DataFrame:
    """What each slot takes: (slot, sid, pass, block, words), the first `words` words of the block.

    A pass visits the full blocks by a step that is prime to their number, from another start each time, and the
    short block at the end of the source last. The last slot of a source stops where its goal is met.
    """
    size = F.col("source_size")
    place = slots.join(sources.select("sid", "source_size", "goal"), "sid").withColumn(
        "full", F.floor(size / block_words)).withColumn("blocks", F.ceil(size / block_words)).withColumn(
        "pass", F.floor(F.col("rank") / F.col("blocks"))).withColumn("at", F.col("rank") % F.col("blocks"))
    block = F.when(F.col("at") >= F.col("full"), F.col("full")).otherwise(
        F.expr(f"pmod(at * {STEP} + pass * 7919, greatest(full, 1))"))
    start = F.col("pass") * size + F.col("at") * block_words
    taken = F.least(F.lit(block_words), size - F.col("at") * block_words, F.col("goal") - start)
    return place.select("slot", "sid", "pass", block.alias("block"), taken.alias("words"))


def _placed(docs: DataFrame, weights: tuple[int, ...], passes: int, block_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sources (sid, source, source_size, docs, weight, target, goal, slots), the sized rows of docs with their sid, and
    these with the offset of their first word in the source's hashed order."""
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    sized, _ = write_table(docs.select("doc_id", "source", words().alias("size"), key.alias("key"),
                                       F.xxhash64("text").alias("row_hash")), "sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    goal = F.floor(F.col("target") + 0.5)
    per_pass = F.ceil(F.col("source_size") / block_words)
    # Slots up to the goal: whole passes, then blocks up to the rest.
    slots = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size")) * per_pass + F.ceil(
        (F.col("goal") % F.col("source_size")) / block_words)).otherwise(0)
    sources, _ = write_table(targets(totals, weights, passes).withColumn("goal", goal).withColumn("slots", slots), "sources")

    # Places of the documents in their source's words: a running sum in two steps, over bounded chunks of hashed order.
    placed = sized.join(sources.select("source", "sid", "docs"), sized["source"].eqNullSafe(sources["source"])).select(
        sized["source"], "sid", "doc_id", "size", "key", "row_hash",
        F.shiftright(F.shiftright("key", 30) * F.ceil(F.col("docs") / CHUNK), 30).alias("chunk"))
    before = placed.groupBy("sid", "chunk").agg(F.sum("size").alias("words")).withColumn("before", F.sum("words").over(
        Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)))
    running = F.sum("size").over(Window.partitionBy("sid", "chunk").orderBy("key", "doc_id", "size", "row_hash").rowsBetween(
        Window.unboundedPreceding, -1))
    offset = placed.withColumn("own", F.coalesce(running, F.lit(0))).join(
        before.select("sid", "chunk", "before"), ["sid", "chunk"]).withColumn(
        "offset", F.col("own") + F.coalesce("before", F.lit(0)))
    return sources, placed, offset


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = 3, block_words: int = 1024) -> DataFrame:
    """One row (doc_id, source, size, source_size, target, taken, row_hash) for each row of docs (doc_id, text, source).

    `taken` is the number of words that the mix takes from a document, repeats counted. A source's words add up to its
    target, rounded; no document gives more than `passes` times its size. Null and empty texts have size 0 and
    give nothing; null sources form one source; a null doc_id has an order of its own. Equal rows come back as
    often as they stand in docs. Reruns agree. A source may have up to 2 ** 31 blocks.
    """
    sources, placed, offset = _placed(docs, weights, passes, block_words)
    taken = blocks_taken(sources, schedule(sources, block_words), block_words)
    pieces = offset.where("size > 0").withColumn("block", F.explode(F.expr(
        f"sequence(offset div {block_words}, (offset + size - 1) div {block_words})")))
    first = F.greatest("offset", F.col("block") * block_words)
    last = F.least(F.col("offset") + F.col("size"), F.col("block") * block_words + F.col("words"))
    given = pieces.join(taken.select("sid", "block", "words"), ["sid", "block"], "left").groupBy(
        "source", "sid", "offset", "doc_id", "size", "row_hash").agg(
        F.sum(F.when(F.col("words").isNotNull(), F.greatest(last - first, F.lit(0))).otherwise(0)).alias("taken"))
    empty = placed.where("size = 0").select("source", "sid", F.lit(0).cast("long").alias("offset"), "doc_id", "size", "row_hash",
                                            F.lit(0).cast("long").alias("taken"))
    return given.unionByName(empty).join(sources.select("sid", "source_size", "target"), "sid").select(
        "doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "row_hash")


def mixed_blocks(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = 3, block_words: int = 1024) -> DataFrame:
    """The mix itself: (slot, source, pass, block, doc_id, row_hash, start, words), a row for each stretch of a document in a slot's block.

    Sorted by slot, any stretch of the mix holds the sources near their shares. `start` counts the document's words before
    the stretch. The words of a document add up to its `taken` in `mix_sources`.
    """
    sources, _, offset = _placed(docs, weights, passes, block_words)
    taken = blocks_taken(sources, schedule(sources, block_words), block_words)
    pieces = offset.where("size > 0").withColumn("block", F.explode(F.expr(
        f"sequence(offset div {block_words}, (offset + size - 1) div {block_words})")))
    first = F.greatest("offset", F.col("block") * block_words)
    last = F.least(F.col("offset") + F.col("size"), F.col("block") * block_words + F.col("words"))
    return pieces.join(taken, ["sid", "block"]).where(last > first).select(
        "slot", "source", "pass", "block", "doc_id", "row_hash", (first - F.col("offset")).alias("start"), (last - first).alias("words"))


def mixed_documents(docs: DataFrame, block_words: int = 1024) -> DataFrame:
    """Whole rows of docs, all columns kept, in the order of the mix, so that the words of each source come to the goal of `mix_sources`.

    A row comes with the slot of the block in which it begins, once for each pass. The schedule lists the last pass in full; of its rows, in slot
    order, those up to the one in whose middle or after which the goal ends are kept, so a source misses its goal by at most half
    of one document. Rows without words are left out.
    """
    same = F.struct("doc_id", "source", "row_hash").alias("__same")
    sources, _, offset = _placed(docs.select("doc_id", "text", "source"), WEIGHTS, 3, block_words)
    per_pass, whole = F.ceil(F.col("source_size") / block_words), F.floor(F.col("goal") / F.col("source_size"))
    passes = sources.withColumn("slots", F.when(F.col("source_size") > 0, F.ceil(F.col("goal") / F.col("source_size")) * per_pass).otherwise(0))
    slots = blocks_taken(passes, schedule(passes, block_words), block_words).select("slot", "sid", "pass", "block")
    begun = offset.where("size > 0").select("sid", same, "size", "offset", F.expr(f"offset div {block_words}").alias("block"))
    goals = F.broadcast(sources.where("source_size > 0").select("sid", whole.alias("whole"), (F.col("goal") % F.col("source_size")).alias("rest")))
    placed, _ = write_table(begun.join(slots, ["sid", "block"]).join(goals, "sid").select(
        "sid", "__same", "size", "offset", "slot", F.expr("slot div 512").alias("chunk"), (F.col("pass") < F.col("whole")).alias("full"), "rest"), "placed")

    # Words of the last pass before a row: a running sum in two steps, over bounded chunks of the schedule.
    last = placed.where("not full")
    before = last.groupBy("sid", "chunk").agg(F.sum("size").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(
        Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("words")
    own = F.coalesce(F.sum("size").over(Window.partitionBy("sid", "chunk").orderBy("slot", "offset").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    kept = last.withColumn("own", own).join(before, ["sid", "chunk"]).where("2 * (own + before) + size <= 2 * rest")
    columns = ["__same", F.col("slot").alias("__slot"), F.col("offset").alias("__offset")]
    taken, _ = write_table(placed.where("full").select(*columns).unionByName(kept.select(*columns)), "copies")
    size = taken.agg(F.count("*").alias("rows"), F.max("__slot").alias("last")).first()

    # Repeated rows share their places.
    once = Window.partitionBy("__same").orderBy(F.lit(1))
    single = docs.withColumn("__same", F.struct(F.col("doc_id"), F.col("source"), F.xxhash64("text").alias("row_hash"))).withColumn(
        "__row", F.row_number().over(once)).where("__row = 1")
    parts = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + size.rows // 512)
    part = F.expr(f"cast(__slot * {parts} div {(size.last or 0) + 1} as int)")
    return single.join(taken, "__same").repartitionById(parts, part).sortWithinPartitions("__slot", "__offset").select(*docs.columns)


def mix_query(docs: DataFrame) -> DataFrame:
    """The contract of op8."""
    return mix_sources(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


MIX_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || left(md5(coalesce(doc_id::VARCHAR, '')), 15))::BIGINT AS key FROM documents),
named AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid
          FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(sid % 3 + 1)::INT] AS weight, 3 * source_size AS cap FROM named),
leveled AS (
  SELECT *, cap / weight AS full_at,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
opened AS (SELECT full_at, sid, level FROM leveled WHERE full_at > level ORDER BY full_at, sid LIMIT 1),
aimed AS (
  SELECT l.*, CASE WHEN l.full_at > o.full_at OR (l.full_at = o.full_at AND l.sid >= o.sid) THEN l.weight * o.level
                   ELSE l.cap::DOUBLE END AS target FROM leveled l LEFT JOIN opened o ON true),
goals AS (SELECT sid, source, source_size, target, floor(target + 0.5)::BIGINT AS goal, source_size // 1024 AS full_blocks,
                 (source_size + 1023) // 1024 AS blocks FROM aimed),
slots AS (
  SELECT sid, CASE WHEN nth >= full_blocks THEN full_blocks ELSE (nth * {STEP} + pass * 7919) % greatest(full_blocks, 1) END AS block,
         least(1024, source_size - nth * 1024, goal - pass * source_size - nth * 1024) AS words
  FROM (SELECT *, unnest(range(blocks)) AS nth FROM (SELECT *, unnest(range(3)) AS pass FROM goals))
  WHERE pass * source_size + nth * 1024 < goal),
placed AS (
  SELECT s.*, g.sid, coalesce(sum(s.size) OVER (PARTITION BY g.sid ORDER BY s.key, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
pieces AS (SELECT *, unnest(range(start // 1024, (start + size - 1) // 1024 + 1)) AS block FROM placed WHERE size > 0),
given AS (
  SELECT p.sid, p.start, p.doc_id,
         sum(greatest(0, least(p.start + p.size, p.block * 1024 + s.words) - greatest(p.start, p.block * 1024))) AS taken
  FROM pieces p JOIN slots s ON s.sid = p.sid AND s.block = p.block GROUP BY ALL)
SELECT p.doc_id, p.size, g.source_size, g.target, coalesce(v.taken, 0)::BIGINT AS taken
FROM placed p JOIN goals g ON g.sid = p.sid
LEFT JOIN given v ON p.size > 0 AND v.sid = p.sid AND v.start = p.start AND v.doc_id IS NOT DISTINCT FROM p.doc_id
"""
