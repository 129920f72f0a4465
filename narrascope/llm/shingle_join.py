"""Near-duplicate documents by an exact Jaccard join of their word n-gram sets over prefix trees.

Sets are ordered by one global order of their n-grams: by hash, with n-grams that are frequent in a sample last. Two linked
sets of similarity t have one of the first n - ceil(t n) + 1 n-grams of each in common, so both run through that node;
the nodes spread the work over the cluster. Sets that meet are first compared by parity bitmaps, a 32nd of their size, whose
difference is never larger than that of the sets, so that a shared passage alone moves no set. The rest are stored in prefix trees
and looked up by a walk that shares partial overlaps and leaves a subtree once the remaining lengths cannot reach the required
overlap.

Only distinct sets take part; copies follow by their set's key. Components need no more links than those between sets that
are not yet connected: first each set is looked up against one center that it meets, a few times over, then the sets that
still meet another component are compared in groups, where a task gives at most one link for each set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrascope.llm.spark import drop_table, small_batches, write_table
from narrascope.llm.texts import gram_hashes, mix, word_hashes
from narrascope.operators.components import connected_components

#: Sets of one tree. Larger groups are cut into blocks of this size.
BLOCK = 256
#: Words of bitmaps that are compared at once.
CHUNK = 1 << 21
#: Groups of up to so many sets are compared pair by pair, without arrays.
FEW = 6
#: How often each set is looked up against a center before all that still meet are compared.
CENTERS = 1
#: Texts of the sample that tells which n-grams are frequent, how often such a one stands in it, and how many are kept. They
#: only shape the global order; the result is the same for any order.
SAMPLE, FREQUENT, ORDERED = 8_000, 3, 1 << 16
_SALT = np.uint64(0xD6E8FEB86659FD93)
_LAST = np.uint64((1 << 64) - ORDERED)
KEY = ["hi", "lo"]


class GramOrder:
    """The global order: frequent n-grams, given by rising frequency, take the largest numbers, others their hash."""

    def __init__(self, frequent: np.ndarray = np.empty(0, np.uint64)):
        rank = np.argsort(frequent, kind="stable")
        self.known, self.place = frequent[rank], _LAST + rank.astype(np.uint64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """The n-grams as sorted numbers."""
        if not len(self.known) or not len(grams):
            return grams
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        return np.sort(np.where(self.known[at] == grams, self.place[at], grams))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct word n-grams; a shorter text is one n-gram of all its words; none without words."""
    found = word_hashes(text) if text else np.empty(0, np.uint64)
    if not len(found):
        return found
    return np.unique(gram_hashes(found, min(words, len(found))))


def set_key(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        hi = mix(np.array([mix(grams + _SALT).sum() + np.uint64(len(grams))]))
        lo = mix(np.array([mix(grams * _SALT).sum() ^ _SALT]))
    return int(hi.view(np.int64)[0]), int(lo.view(np.int64)[0])


def allowed(total: int, percent: int) -> int:
    """Largest number of n-grams that only one of two linked sets holds, given the sum of their sizes."""
    return total * (100 - percent) // (100 + percent)


def nodes(grams: np.ndarray, percent: int) -> np.ndarray:
    """The first n-grams of an ordered set, of which every linked set has one among its own first ones."""
    return grams[:len(grams) + percent * len(grams) // -100 + 1]


def signature(grams: np.ndarray) -> np.ndarray:
    """Parity bitmap in 64-bit words: a bit is set if an odd number of n-grams falls on it. At least two bits for each n-gram."""
    bits = max(64, 1 << (2 * len(grams) - 1).bit_length())
    odd = np.bincount((mix(grams ^ _SALT) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def may_link(sizes: np.ndarray, maps: list[np.ndarray], other_sizes: np.ndarray, other_maps: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets (a row for each of the first) may be linked by their sizes and parity bitmaps.

    Sets that differ in d n-grams have bitmaps that differ in at most d bits, and so have bitmaps folded to half their length.
    """
    found = np.zeros((len(sizes), len(other_sizes)), bool)
    levels = [np.array([len(m) for m in side]) for side in (maps, other_maps)]
    for a in np.unique(levels[0]):
        rows = np.flatnonzero(levels[0] == a)
        for b in np.unique(levels[1]):
            # Linked sets are of similar size: their bitmaps are at most two foldings apart.
            if max(a, b) > 4 * min(a, b) * 100 // percent:
                continue
            columns, words = np.flatnonzero(levels[1] == b), int(min(a, b))
            left, right = np.stack([maps[i] for i in rows]), np.stack([other_maps[i] for i in columns])
            while left.shape[1] > words:
                left = left[:, :left.shape[1] // 2] ^ left[:, left.shape[1] // 2:]
            while right.shape[1] > words:
                right = right[:, :right.shape[1] // 2] ^ right[:, right.shape[1] // 2:]
            step = max(1, CHUNK // (len(columns) * words))
            for i in range(0, len(rows), step):
                apart = np.bitwise_count(left[i:i + step, None, :] ^ right[None]).sum(2, dtype=np.int64)
                own, other = sizes[rows[i:i + step], None], other_sizes[None, columns]
                near = (apart <= (own + other) * (100 - percent) // (100 + percent)) & (100 * np.minimum(own, other) >= percent * np.maximum(own, other))
                found[np.ix_(rows[i:i + step], columns)] = near
    return found


def chained(near: np.ndarray, names: np.ndarray, other_names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least name that each side's sets reach over near pairs; -1 for sets without any."""
    own, other, none = names.copy(), other_names.copy(), np.iinfo(np.int64).max
    while True:
        new_own = np.minimum(own, np.where(near, other[None, :], none).min(1, initial=none))
        new_other = np.minimum(other, np.where(near, new_own[:, None], none).min(0, initial=none))
        if (new_own == own).all() and (new_other == other).all():
            return np.where(near.any(1), own, -1), np.where(near.any(0), other, -1)
        own, other = new_own, new_other


def chained_few(sizes: list[int], maps: list[bytes], names: list[int], percent: int) -> tuple[list[int], list[int]]:
    """(chain, name) of the sets of a small group that are near another: what `may_link` and `chained` find, pair by pair."""
    bits, together, near = [int.from_bytes(m, "little") for m in maps], Union(), set()
    for a in range(len(names)):
        for b in range(a):
            own, other = sizes[a], sizes[b]
            if 100 * min(own, other) < percent * max(own, other):
                continue
            width = 8 * min(len(maps[a]), len(maps[b]))
            if (_folded(bits[a], 8 * len(maps[a]), width) ^ _folded(bits[b], 8 * len(maps[b]), width)).bit_count() <= allowed(own + other, percent):
                together.join(names[a], names[b])
                near.update((a, b))
    return [together.find(names[a]) for a in near], [names[a] for a in near]


def _folded(bits: int, length: int, width: int) -> int:
    """A bitmap of some length folded to a width."""
    while length > width:
        length //= 2
        bits = (bits >> length) ^ (bits & ((1 << length) - 1))
    return bits


class PrefixTree:
    """Sets as a prefix tree: in lexicographic order, each with the depth it shares with the one before."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.shared = [0]
        for a, b in zip(self.sets, self.sets[1:]):
            n = min(len(a), len(b))
            apart = np.flatnonzero(a[:n] != b[:n])
            self.shared.append(int(apart[0]) if len(apart) else n)

    def walk(self, query: np.ndarray, percent: int, among: Callable[[int], bool] | None = None) -> Iterator[int]:
        """Numbers of the stored sets whose Jaccard similarity with the query is at least percent / 100, as the walk meets them.

        The overlap of a path is carried on to all sets below it. With o of the first d n-grams of a path found
        among the p query n-grams passed, the overlap can reach no more than what the remaining lengths leave:
        once d - o + p - o exceeds what any linked set may differ by, the subtree is left. Sets that `among` refuses,
        asked when they are met, are passed by.
        """
        size = len(query)
        most = allowed(size + size * 100 // percent, percent)
        # `carry` is how much of the last path looked at still leads to the set at hand.
        overlap, passed, dead, carry = np.zeros(1, np.int64), np.zeros(1, np.int64), 1 << 60, 1 << 60
        for i, own in enumerate(self.sets):
            carry = min(carry, self.shared[i])
            if carry >= dead or (among is not None and not among(self.order[i])):
                continue
            tail = own[carry:]
            at = np.searchsorted(query, tail)
            hit = query[np.minimum(at, size - 1)] == tail if size else np.zeros(len(tail), bool)
            overlap = np.concatenate((overlap[:carry + 1], overlap[carry] + np.cumsum(hit)))
            passed = np.concatenate((passed[:carry + 1], at + hit))
            over = np.flatnonzero(np.arange(len(own) + 1) + passed - 2 * overlap > most)
            dead, carry = int(over[0]) if len(over) else 1 << 60, 1 << 60
            both = int(overlap[-1])
            if dead > len(own) and 100 * both >= percent * (len(own) + size - both):
                yield self.order[i]

    def linked(self, query: np.ndarray, percent: int) -> list[int]:
        return list(self.walk(query, percent))


def _frequent(docs: DataFrame, words: int) -> np.ndarray:
    """N-grams that are frequent among about SAMPLE distinct texts, at most ORDERED, by rising frequency."""
    share = SAMPLE / max(1, docs.count())
    drawn = docs.where(F.pmod(F.xxhash64("text", F.lit(23)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grams = [shingles(t, words) for t in batch.iloc[:, 0]]
            found, n = np.unique(np.concatenate(grams) if grams else np.empty(0, np.uint64), return_counts=True)
            yield pd.DataFrame({"gram": found.view(np.int64), "n": n})

    counted = drawn.select("text").distinct().mapInPandas(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "gram").limit(ORDERED).collect()
    return np.array([r.gram for r in reversed(rows)], np.int64).view(np.uint64)


def _describe(words: int, percent: int, order: GramOrder):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            rows = []
            for doc, name, text in batch.itertuples(index=False):
                grams = order(shingles(text, words))
                key, at, bits = set_key(grams), None, None
                if len(grams) and key not in seen:
                    seen.add(key)
                    at, bits = nodes(grams, percent).view(np.int64), signature(grams).tobytes()
                rows.append((doc, name, len(grams), *key, at, bits))
            yield pd.DataFrame(rows, columns=["doc_id", "text_hash", "n", "hi", "lo", "nodes", "bits"]).astype({"doc_id": "Int64"})

    return run


def _sets(words: int, order: GramOrder):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*set_key(g), g.tobytes()) for g in (order(shingles(t, words)) for t in batch.iloc[:, 0])]
            yield pd.DataFrame(rows, columns=["hi", "lo", "grams"])

    return run


def _sets_of(docs: DataFrame, described: DataFrame, numbers: DataFrame, words: int, order: GramOrder) -> tuple[DataFrame, str]:
    """(id, grams): the n-gram sets of the numbered keys, made again from one text for each key."""
    # A key's text is told by its hash and its own key, so that texts of equal hash do not hide each other.
    # They are written, so that the planner knows how few they are and sends them to the texts instead of moving these.
    chosen, chosen_at = write_table(described.where("nodes is not null").join(numbers, KEY).groupBy(*KEY).agg(
        F.min("text_hash").alias("text_hash")).select("text_hash").distinct(), "chosen")
    # One text for each hash and its length before anything moves, so that copies do not meet in one task.
    texts = docs.select("text", F.xxhash64("text").alias("text_hash")).join(chosen, "text_hash", "left_semi").groupBy(
        "text_hash", F.xxhash64("text", F.lit(5)).alias("other_hash")).agg(F.first("text").alias("text")).select("text")
    sets = write_table(texts.mapInPandas(_sets(words, order), "hi long, lo long, grams binary").join(numbers, KEY)
                       .groupBy("id").agg(F.first("grams").alias("grams")), "sets")
    drop_table(docs.sparkSession, chosen_at)
    return sets


def _check_centers(candidates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) among candidate pairs (id, center): a center is looked up in trees of its sets.

    A center's sets are dealt over blocks, each with a copy of the center, so none grows with the group.
    """
    sizes = candidates.groupBy("center").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = candidates.join(sizes, "center").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    members = members.join(sets, "id").select("center", "block", "id", "grams")
    centers = sizes.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(
        sets.withColumnRenamed("id", "center"), "center").select("center", "block", "grams").toDF("c", "b", "grams")

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        tree = PrefixTree([np.frombuffer(g, np.uint64) for g in left["grams"]])
        linked = tree.linked(np.frombuffer(right["grams"].iloc[0], np.uint64), percent)
        return pd.DataFrame({"u": left["id"].iloc[linked], "v": right["c"].iloc[0]})

    return members.groupBy("center", "block").cogroup(centers.groupBy("c", "b")).applyInPandas(probe, "u long, v long")


class Union:
    """Components that grow together by union and find."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        top = x
        while (up := self.root.get(top, top)) != top:
            top = up
        while (up := self.root.get(x, x)) != top:
            self.root[x], x = top, up
        return top

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart until now."""
        x, y = self.find(x), self.find(y)
        self.root[max(x, y)] = min(x, y)
        return x != y


def _by_group(df: DataFrame, keys: list[str], run: Callable[[dict[str, np.ndarray]], tuple[list, list]], schema: str) -> DataFrame:
    """Rows of two long columns that `run` makes of the columns of each key. Most groups are of a few rows, so that a call from the JVM or
    a frame for each would cost more than the work."""
    names = [f.split()[0] for f in schema.split(", ")]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def found(rows: pd.DataFrame, edges: list[int]) -> pd.DataFrame:
            columns = {c: rows[c].to_numpy() for c in rows.columns}
            out: tuple[list, list] = ([], [])
            for a, b in zip(edges, edges[1:]):
                for side, values in zip(out, run({c: v[a:b] for c, v in columns.items()})):
                    side.extend(values)
            return pd.DataFrame({n: np.array(v, np.int64) for n, v in zip(names, out)})

        for batch in batches:
            rows = batch if rest is None else pd.concat((rest, batch), ignore_index=True)
            values = rows[keys].to_numpy()
            edges = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist()]
            yield found(rows, edges)
            rest = rows.iloc[edges[-1]:]
        if rest is not None and len(rest):
            yield found(rest, [0, len(rest)])

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(stream, schema)


def _blocks(groups: DataFrame, number: int = 0, pairs: bool = True) -> DataFrame:
    """Rows (node, id, ...) dealt to the pairs of blocks (i, j) of their node, or to their own blocks only; `own` is a row's block."""
    sizes = groups.groupBy("node").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = groups.join(sizes, "node").withColumn("own", F.pmod(F.xxhash64("id", F.lit(number)), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)) if pairs else F.col("own")
    paired = dealt.withColumn("other", other)
    return paired.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks")


def _narrow(members: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """(node, id): sets that may be linked, by their bitmaps, share a node again, and hardly any others do.

    Nodes with the same least set are one group: near copies share most of their nodes and so lie in few groups. Within a group
    sets are chained by near bitmaps, and the least set of a chain names the new node.
    """
    least = members.groupBy("node").agg(F.min("id").alias("least"))
    groups, _ = write_table(members.join(least, "node").select(F.col("least").alias("node"), "id").distinct(), "groups")
    rows = _blocks(groups).join(bitmaps, "id").select("node", "i", "j", "own", "id", "n", "bits")

    def probe(rows: dict[str, np.ndarray]) -> tuple[list, list]:
        i, j, ids = rows["i"][0], rows["j"][0], rows["id"]
        if len(ids) <= FEW and i == j:
            return chained_few(rows["n"].tolist(), rows["bits"], ids.tolist(), percent)
        sides = [(rows["n"][at], [np.frombuffer(b, np.uint64) for b in rows["bits"][at]], ids[at]) for at in (rows["own"] == i, rows["own"] == j)]
        near = may_link(*sides[0][:2], *sides[1][:2], percent)
        if i == j:
            np.fill_diagonal(near, False)
        names = np.concatenate(chained(near, sides[0][2], sides[1][2]))
        both = np.concatenate((sides[0][2], sides[1][2]))
        return names[names >= 0].tolist(), both[names >= 0].tolist()

    found, _ = write_table(_by_group(rows, ["node", "i", "j"], probe, "node long, id long").distinct(), "chains")
    # The chains of a large group come from many pairs of blocks: those that share a set take the least name around.
    around = found.join(found.groupBy("id").agg(F.min("node").alias("own")), "id").groupBy("node").agg(F.min("own").alias("name"))
    return found.join(around, "node").select(F.col("name").alias("node"), "id").distinct()


def _check_groups(opened: DataFrame, sets: DataFrame, percent: int, pairs: bool) -> DataFrame:
    """Links (u, v) between linked sets of different components that meet at a node, for all of them (`pairs`) or within its blocks.

    Each pair of blocks of a node is a task's tree and queries. A task joins components as it goes and gives only links that join
    two; sets that are already joined are not compared.
    """
    rows = _blocks(opened, 1, pairs).join(sets, "id").select("node", "i", "j", "own", "component", "id", "grams")

    def probe(rows: dict[str, np.ndarray]) -> tuple[list, list]:
        component, ids, left, right = rows["component"], rows["id"], [], []
        if (component == component[0]).all():
            return left, right
        at = [np.flatnonzero(rows["own"] == rows[side][0]) for side in ("i", "j")]
        sides = [[np.frombuffer(g, np.uint64) for g in rows["grams"][x]] for x in at]
        near = may_link(*(x for side in sides for x in (np.array([len(g) for g in side]), [signature(g) for g in side])), percent)
        tree, together, group, names = PrefixTree(sides[0]), Union(), component[at[0]].tolist(), ids[at[0]].tolist()
        for q, (g, c, u) in enumerate(zip(sides[1], component[at[1]].tolist(), ids[at[1]].tolist(), strict=True)):
            for k in tree.walk(g, percent, lambda k: near[k, q] and together.find(group[k]) != together.find(c)):
                together.join(group[k], c)
                left.append(u)
                right.append(names[k])
        return left, right

    return _by_group(rows, ["node", "i", "j"], probe, "u long, v long")


def _opened(members: DataFrame, component: DataFrame | None) -> DataFrame:
    """(node, id, component) of the nodes where sets of several components meet."""
    if component is None:
        labelled = members.withColumn("component", F.col("id"))
    else:
        labelled = members.join(component.withColumnRenamed("node", "id"), "id", "left").select(
            "node", "id", F.coalesce("component", "id").alias("component"))
    several = labelled.groupBy("node").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a != b").select("node")
    return labelled.join(several, "node", "left_semi")


def _centers(opened: DataFrame, number: int) -> DataFrame:
    """(id, center): for each set the first set of another component, in an order that changes by round, among the firsts of its nodes."""
    order = F.struct(F.xxhash64("id", F.lit(number)).alias("o"), F.col("id"), F.col("component"))
    first = opened.groupBy("node").agg(F.min(order).alias("c"))
    met = opened.join(first, "node").where("component != c.component")
    return met.groupBy("id").agg(F.min("c").alias("c")).select("id", F.col("c.id").alias("center"))


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """One row (doc_id, text_hash, n_shingles, component_id, component) for each row of docs (doc_id, text).

    Texts link when 100 * |A and B| >= percent * |A or B| over their sets of distinct word n-grams, words being
    `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. component_id is the smallest doc_id that links reach, component a
    name of the component. Null and empty texts and texts without words have no n-grams: each row is a component
    of its own and has no name. Repeated rows come back as often as they stand in docs. A null doc_id is never
    the smallest; where all are null component_id is null.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = GramOrder(_frequent(docs, words))
    described, _ = write_table(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInPandas(
        _describe(words, percent, order), "doc_id long, text_hash long, n long, hi long, lo long, nodes array<long>, bits binary"), "described")
    at = described.where("nodes is not null").select(F.explode("nodes").alias("node"), *KEY)
    met = at.groupBy("node").agg(F.min("hi").alias("a"), F.max("hi").alias("b")).where("a != b").select("node")
    named, named_at = write_table(at.join(met, "node", "left_semi"), "named")
    numbers, _ = write_table(named.select(*KEY).distinct().withColumn("id", F.monotonically_increasing_id()), "numbers")
    bitmaps = described.where("nodes is not null").join(numbers, KEY).groupBy("id").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    members, members_at = write_table(_narrow(named.join(numbers, KEY).select("node", "id").distinct(), bitmaps, percent), "members")
    drop_table(spark, named_at)
    near = members.select("id").distinct().join(numbers, "id")
    sets, sets_at = _sets_of(docs, described, near, words, order)

    # Against one center of each node, then within blocks, then all that still meet: most sets are joined before many are compared.
    steps = [*[lambda rows, n=n: _check_centers(_centers(rows, n), sets, percent) for n in range(CENTERS)],
             lambda rows: _check_groups(rows, sets, percent, False), lambda rows: _check_groups(rows, sets, percent, True)]
    links, component, parts = None, None, [members_at, sets_at]
    for step in steps:
        opened, opened_at = write_table(_opened(members, component), "opened")
        parts.append(opened_at)
        if opened.isEmpty():
            break
        new, _ = write_table(step(opened), "links")
        if not new.isEmpty():
            links = new if links is None else links.union(new)
            component = connected_components(links)
    for path in parts:
        drop_table(spark, path)
    return _label(described, numbers, component)


def _label(described: DataFrame, numbers: DataFrame, component: DataFrame | None) -> DataFrame:
    """Documents with the smallest id of their component, which is named by a set of it."""
    first = described.where("n > 0").groupBy(*KEY).agg(F.min("doc_id").alias("first"))
    if component is None:
        rooted = numbers.select(*KEY, F.col("id").alias("component"))
    else:
        rooted = numbers.join(component.withColumnRenamed("node", "id"), "id", "left").select(
            *KEY, F.coalesce("component", "id").alias("component"))
    named = first.join(rooted, KEY, "left").select(*KEY, "first", F.coalesce(
        F.concat(F.lit("c"), F.col("component")), F.concat_ws("-", "hi", "lo")).alias("component"))
    root = named.groupBy("component").agg(F.min("first").alias("component_id"))
    table = named.join(root, "component").select(*KEY, "component", "component_id")
    return described.select("doc_id", "text_hash", "n", *KEY).join(table, KEY, "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("component")).alias("component"))


def near_duplicate_query(docs: DataFrame) -> DataFrame:
    """The contract of op2."""
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns kept, with one row of each component: the one of the smallest doc_id.

    Of equal ids the smallest hash of the text stays, of rows equal in both the smallest hash of all columns. Rows without words all stay.
    """
    found = near_duplicates(docs, words, percent)
    first = found.where("component is not null").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")).alias("f"))
    kept, _ = write_table(first.select("f.doc_id", "f.text_hash", F.lit(False).alias("wordless"))
                          .union(found.where("component is null").select("doc_id", "text_hash", F.lit(True))).distinct(), "kept")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"),
                      F.xxhash64("text").alias("hash"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("full"))
    joined = own.join(kept, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")))
    # The limit of the window is taken before the shuffle too, so that repeated rows do not meet in one task.
    once = Window.partitionBy("id", "hash").orderBy("full")
    worded = joined.where("not wordless").withColumn("place", F.row_number().over(once)).where("place = 1")
    return worded.select("row.*").unionByName(joined.where("wordless").select("row.*"))
