"""Language-model scores by prediction by partial matching (Cleary and Witten 1984; Moffat's escape method C).

A trie of byte contexts up to five bytes long holds how often each byte followed. A byte is coded in the longest known
context that has seen it; each context that has not costs an escape, and the bytes it has seen are excluded from the
shorter ones. Counts come from all training texts, and every gram counts. As a context's bytes are always in its
suffixes too, what is excluded at a level depends on one longer context only and is worked out once for each.

What a byte costs depends on its gram alone. The costs of the most frequent grams go to all tasks; the other grams of
each text are looked up by a join. Their costs are worked out where all counts with the same last LOW context bytes
lie together; grams of up to LOW + 1 bytes, which the alphabet bounds, go to all of these tasks.
"""

from __future__ import annotations

import collections
import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.llm.spark import bounded_rows, remainder, small_batches, write_table
from narrascope.llm.texts import word_hashes

ORDER = 5
#: Bytes that UTF-8 never holds: before the start of a text, and its end.
START, END = 0xFE, 0xFF
SYMBOLS = 256
#: Bytes of the longest context whose grams are sent to all tasks that work out costs.
LOW = 2
#: Bounds on the grams whose costs, and on the words whose counts are sent to all tasks. All others are joined.
NODES, HEAD = 1 << 20, 1 << 20
#: Values that a task gathers before it hands them on, and bytes of a text worked on at once.
GATHER, PIECE = 1 << 20, 1 << 18


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Places of 64-bit keys, looked up for whole arrays at once (open addressing)."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys.astype(np.uint64), np.uint64(0))
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        at = self._home(self.keys[:-1])
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(29))) * _SPREAD >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it is missing."""
        at = self._home(keys)
        found = self.slots[at]
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found[open_] = self.slots[at[open_]]
            open_ = open_[(found[open_] >= 0) & (self.keys[found[open_]] != keys[open_])]
        return found


def lowered(text: str | None) -> bytes:
    """The bytes of a text, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _pack(raw: np.ndarray) -> np.ndarray:
    """All runs of ORDER + 1 bytes as numbers."""
    wide = raw.astype(np.uint64)
    packed = wide[:len(wide) - ORDER].copy()
    for i in range(1, ORDER + 1):
        packed <<= np.uint64(8)
        packed |= wide[i:len(wide) - ORDER + i]
    return packed


def grams(text: str | None) -> Iterator[np.ndarray]:
    """For each byte of the lower-cased text and its end, the five bytes before it and itself, packed; in pieces."""
    for packed, _ in packed_texts([lowered(text)]):
        yield packed


def packed_texts(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, numbers of their texts) of lower-cased texts, in pieces: short texts are packed together, long ones cut."""
    start, end = bytes([START]) * ORDER, bytes([END])
    first = 0
    while first < len(raws):
        last, size = first, 0
        while last < len(raws) and (last == first or size + len(raws[last]) <= PIECE):
            size += len(raws[last])
            last += 1
        raw = np.frombuffer(start + (end + start).join(raws[first:last]) + end, np.uint8)
        lengths = np.array([len(r) + 1 for r in raws[first:last]])
        if last - first == 1:
            for at in range(0, len(raw) - ORDER, PIECE):
                packed = _pack(raw[at:at + PIECE + ORDER])
                yield packed, np.full(len(packed), first)
        else:
            # Runs that end in the bytes before a text belong to none.
            keep = np.ones(len(raw) - ORDER, bool)
            edges = np.cumsum(lengths[:-1] + ORDER) - ORDER
            keep[(edges[:, None] + np.arange(ORDER)).ravel()] = False
            yield _pack(raw)[keep], np.repeat(np.arange(first, last), lengths)
        first = last


def summed(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, with the sums of their numbers."""
    order = np.argsort(values, kind="stable")
    values, n = values[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)
    return values[first], np.add.reduceat(n, first) if len(first) else n


class Counter:
    """Counts of 64-bit values that stay within a bounded size: full ones are handed on for Spark to add up."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, values: np.ndarray) -> None:
        found, n = np.unique(values, return_counts=True)
        self.parts.append((found, n))
        self.size += len(found)

    def _merge(self) -> None:
        self.parts = [summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
        self.size = len(self.parts[0][0])

    def overflow(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.size > 2 * GATHER:
            self._merge()
            if self.size > GATHER:
                yield from self.rest()

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.size:
            self._merge()
            yield self.parts[0]
        self.parts, self.size = [], 0


def _hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of lower-cased words."""
    return word_hashes(b" ".join(words).decode("utf-8", "surrogatepass")) if words else np.empty(0, np.uint64)


def _gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (kind, value, n): words by hash as kind 0, packed byte grams as kind 1."""
    words, packed = collections.Counter(), Counter()

    def rows(kind: int, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
        for values, n in found:
            yield pd.DataFrame({"kind": kind, "value": values.view(np.int64), "n": n})

    def told() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield _hashes(list(words)), np.fromiter(words.values(), np.int64, len(words))
        words.clear()

    for batch in batches:
        own: list[np.ndarray] = []
        raws = [lowered(text) for text in batch.iloc[:, 0]]
        for raw in raws:
            # Bytes are split at the same blanks as words are.
            words.update(raw.split())
        for part, _ in packed_texts(raws):
            own.append(part)
            if sum(map(len, own)) > GATHER:
                packed.add(np.concatenate(own))
                own = []
        if own:
            packed.add(np.concatenate(own))
        if len(words) > GATHER:
            yield from rows(0, told())
        yield from rows(1, packed.overflow())
    yield from rows(0, told())
    yield from rows(1, packed.rest())


@dataclasses.dataclass
class Level:
    """Contexts of one length: their followers' counts, and per context the sums that its escapes need."""

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    #: Total and escapes of the next shorter context without the bytes that this one has seen.
    rest_total: np.ndarray
    rest_escapes: np.ndarray
    #: log10 probability of each gram's last byte where no longer context is known.
    logs: np.ndarray


class Ppm:
    """The trie, from all packed grams of each order with their counts. Gives log10 probabilities of texts."""

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray]]):
        self.levels: list[Level] = []
        self._tables: list[tuple[Table, Table]] = []
        for packed, counts in orders:
            self._add(packed, counts)

    def _add(self, packed: np.ndarray, counts: np.ndarray) -> None:
        k, order = len(self.levels), np.argsort(packed)
        packed, counts = packed[order].astype(np.uint64), counts[order].astype(np.float64)
        above = packed >> np.uint64(8)
        first = np.flatnonzero(np.concatenate(([True], above[1:] != above[:-1]))) if len(packed) else np.empty(0, np.int64)
        total = np.add.reduceat(counts, first) if len(first) else np.empty(0)
        distinct = np.diff(np.append(first, len(packed))).astype(np.float64)
        zero = np.zeros(len(first))
        level = Level(packed, counts, above[first], total, distinct, zero, zero, np.empty(0))
        if k and len(first):
            shorter = self.levels[-1]
            mask = np.uint64((1 << (8 * (k - 1))) - 1)
            parent = np.searchsorted(shorter.contexts, level.contexts & mask)
            inner = np.searchsorted(shorter.grams, packed & np.uint64((1 << (8 * k)) - 1))
            level.rest_total = np.maximum(0, shorter.total[parent] - np.add.reduceat(shorter.counts[inner], first))
            level.rest_escapes = shorter.distinct[parent] - distinct
        level.logs = np.log10(counts / np.repeat(total + distinct, distinct.astype(np.int64)))
        self.levels.append(level)

    def deeper(self, orders: list[tuple[np.ndarray, np.ndarray]]) -> Ppm:
        """This trie with further orders below it; grams may be left out of them by whole contexts of this trie's grams."""
        added = Ppm([])
        added.levels, added._tables = list(self.levels), list(self.tables)
        for packed, counts in orders:
            added._add(packed, counts)
        return added

    def __getstate__(self) -> dict:
        return {"levels": self.levels, "_tables": []}

    @property
    def tables(self) -> list[tuple[Table, Table]]:
        """Lookups of grams and contexts, made once in each worker."""
        for x in self.levels[len(self._tables):]:
            self._tables.append((Table(x.grams), Table(x.contexts)))
        return self._tables

    def log10(self, packed: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each packed gram after the bytes before it."""
        result = np.zeros(len(packed))
        left = np.arange(len(packed))
        # Sums of the context at hand, where a longer one has excluded its bytes from it; nan where none has.
        total, escapes = np.full(len(packed), np.nan), np.full(len(packed), np.nan)
        for k in range(len(self.levels) - 1, -1, -1):
            if not len(left):
                return result
            level, (by_gram, by_context) = self.levels[k], self.tables[k]
            part = packed[left] & np.uint64((1 << (8 * (k + 1))) - 1)
            gram = by_gram.find(part)
            hit = gram >= 0
            rows, gram = left[hit], gram[hit]
            t = total[rows]
            late = np.flatnonzero(~np.isnan(t))
            logs = level.logs[gram]
            logs[late] = np.log10(level.counts[gram[late]] / (t[late] + escapes[rows[late]]))
            result[rows] += logs
            left = left[~hit]
            context = by_context.find(part[~hit] >> np.uint64(8))
            known = context >= 0
            rows, context = left[known], context[known]
            t, e = total[rows], escapes[rows]
            fresh = np.isnan(t)
            t[fresh] = level.total[context[fresh]]
            e[fresh] = level.distinct[context[fresh]]
            out = e > 0
            result[rows[out]] += np.log10(e[out] / (t[out] + e[out]))
            total[rows], escapes[rows] = level.rest_total[context], level.rest_escapes[context]
        seen = self.levels[0].distinct[0] if self.levels and len(self.levels[0].distinct) else 0
        result[left] -= np.log10(max(1, SYMBOLS - seen))
        return result

    def score(self, text: str | None) -> float:
        return self.score_all([text])[0]

    def score_all(self, texts: list[str | None]) -> np.ndarray:
        """log10 probability of each text; short texts are worked on together."""
        result = np.zeros(len(texts))
        for packed, owners in packed_texts([lowered(t) for t in texts]):
            result += np.bincount(owners, self.log10(packed), len(texts))
        return result


def train_counts(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """A table (kind, value, n) of all word hashes (kind 0) and byte grams (kind 1) of all texts.

    Words are told apart by a 64-bit hash. Null counts as the empty text.
    """
    small_batches(docs.sparkSession)
    return write_table(docs.select(text).mapInPandas(_gather, "kind int, value long, n long").groupBy("kind", "value").agg(
        F.sum("n").alias("n")), "counts")


def _shortened(packed: DataFrame, order: int) -> DataFrame:
    """Counts (value, n) of the grams' last order + 1 bytes."""
    return packed.groupBy(F.col("value").bitwiseAND(F.lit((1 << (8 * (order + 1))) - 1)).alias("value")).agg(F.sum("n").alias("n"))


def fit_ppm(counts: DataFrame, order: int = ORDER) -> Ppm:
    """The trie of all grams with contexts up to `order` bytes, on the driver. For low orders, or small corpora."""
    packed, orders = counts.where("kind = 1").select("value", "n"), []
    for k in range(order + 1):
        found = bounded_rows(_shortened(packed, k))
        orders.append((found["value"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)))
    return Ppm(orders)


def frequent_costs(counts: DataFrame, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent of the longest grams, at most `nodes`, and their log10 probabilities.

    Where to cut is told by the number of grams in steps of an eighth of a doubling; grams of one step are taken or left together.
    """
    packed = counts.where("kind = 1").select("value", "n", F.shiftright("value", 8).alias("context"), F.floor(F.log2("n") * 8).alias("step"))
    steps = sorted(packed.groupBy("step").agg(F.count("*").alias("grams")).collect(), reverse=True)
    least, held = 1 << 20, 0
    for row in steps:
        held += row.grams
        if held > nodes:
            break
        least = row.step
    contexts = packed.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"))
    found = bounded_rows(packed.where(F.col("step") >= least).join(contexts, "context").select(
        "value", (F.col("n") / (F.col("total") + F.col("distinct"))).alias("p")))
    return found["value"].to_numpy(np.int64).view(np.uint64), np.log10(found["p"].to_numpy(np.float64))


def _cost_rows(low: Ppm):
    """From rows (value, n) ordered by the last context bytes, the costs of the grams of n = 0."""
    def near(values: np.ndarray) -> np.ndarray:
        return (values >> np.uint64(8)) & np.uint64((1 << (8 * (LOW + 1))) - 1)

    def costs(values: np.ndarray, n: np.ndarray) -> Iterator[pd.DataFrame]:
        seen, asked = n > 0, values[n == 0]
        if len(asked):
            ppm = low.deeper([summed(values[seen] & np.uint64((1 << (8 * (k + 1))) - 1), n[seen]) for k in range(LOW + 1, ORDER + 1)])
            for at in range(0, len(asked), PIECE):
                part = asked[at:at + PIECE]
                yield pd.DataFrame({"value": part.view(np.int64), "log": ppm.log10(part)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, limit = 0, GATHER
        for batch in batches:
            held.append((batch["value"].to_numpy(np.int64).view(np.uint64), batch["n"].to_numpy(np.int64)))
            size += len(batch)
            if size > limit:
                values, n = (np.concatenate(x) for x in zip(*held, strict=True))
                # The last context may go on in the next batch.
                at = near(values)
                done = int(np.flatnonzero(at != at[-1])[-1]) + 1 if (at != at[-1]).any() else 0
                yield from costs(values[:done], n[:done])
                held, size = [(values[done:], n[done:])], len(values) - done
                limit = max(GATHER, 2 * size)
        if held:
            yield from costs(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def gram_costs(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """log10 probabilities (value, log) of distinct packed grams (value), from all counts."""
    packed = counts.where("kind = 1").select("value", "n")
    near = F.shiftright("value", 8).bitwiseAND(F.lit((1 << (8 * (LOW + 1))) - 1))
    dealt = packed.union(asked.select("value", F.lit(0).cast("long").alias("n"))).withColumn("near", near).repartition(
        "near").sortWithinPartitions("near")
    return dealt.select("value", "n").mapInPandas(_cost_rows(fit_ppm(packed.withColumn("kind", F.lit(1)), LOW)), "value long, log double")


def _score_rows(frequent: np.ndarray, costs: np.ndarray, head: np.ndarray, head_logs: np.ndarray, end_log: float, end_known: int):
    """Rows with what the most frequent grams and words give, and the other words' (kind 0) and grams' (kind 1) values and numbers."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, gram_table = Table(head), Table(frequent)
        logs, gram_logs = np.append(head_logs, 0.0), np.append(costs, 0.0)
        known_words: dict[bytes, tuple[float, int]] = {}

        def learn(words: list[bytes]) -> None:
            """Remember for each word its log10 probability and no hash, or 1 and the hash to look up."""
            hashes = _hashes(words)
            at = table.find(hashes)
            for word, value, place in zip(words, hashes.view(np.int64).tolist(), at.tolist()):
                known_words[word] = (float(logs[place]), 0) if place >= 0 else (1.0, value)

        for batch in batches:
            raws = [lowered(t) for t in batch.iloc[:, 1]]
            score, others = np.zeros(len(raws)), [[] for _ in raws]
            for part, owners in packed_texts(raws):
                place = gram_table.find(part)
                score += np.bincount(owners, gram_logs[place], len(raws))
                missing = np.flatnonzero(place < 0)
                if len(missing):
                    of = owners[missing]
                    edges = np.flatnonzero(np.diff(of)) + 1
                    for own, values in zip(of[np.concatenate(([0], edges))], np.split(part[missing], edges)):
                        others[own].append(values)
            rows = []
            for doc, raw, own_score, more in zip(batch.iloc[:, 0], raws, score, others):
                counts = collections.Counter(raw.split())
                if len(known_words) > GATHER:
                    known_words.clear()
                learn([w for w in counts if w not in known_words])
                base, known, rare, times = end_log, end_known, [], []
                for word, n in counts.items():
                    log, value = known_words[word]
                    if log <= 0:
                        base += n * log
                        known += n
                    else:
                        rare.append(value)
                        times.append(n)
                values = np.concatenate((np.array(rare, np.int64), *(m.view(np.int64) for m in more)))
                rows.append((doc, counts.total() + 1, known, base, own_score, np.repeat((0, 1), (len(rare), len(values) - len(rare))), values,
                             np.concatenate((np.array(times, np.int64), np.ones(len(values) - len(rare), np.int64)))))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "known", "base", "score", "kinds", "values", "times"]).astype(
                {"doc_id": "Int64"})

    return run


def score_documents(docs: DataFrame, train: Column, text: str = "text") -> DataFrame:
    """One row (doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text).

    `train` chooses the rows to learn from. base_score is the smoothed unigram score over the words and one end; what
    frequent words and grams give goes to all tasks (at most HEAD words can hold a 1 / HEAD share of the corpus), the
    others are joined; no score depends on how they are dealt out. Null and empty texts consist of an end alone. Without training rows every count is 0.
    Repeated rows come back as often as they stand in docs.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    learned = docs.where(F.coalesce(train, F.lit(False)))
    counts, _ = train_counts(learned, text)
    ends = learned.count()
    words = counts.where("kind = 0").select("value", "n")
    sums = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = (sums.n or 0) + ends, sums.v + (ends > 0)
    below = total + 0.5 * (distinct + 1)
    head = bounded_rows(words.where(F.col("n") >= max(1, -(-total // HEAD))))
    logs = np.log10((head["n"].to_numpy(np.float64) + 0.5) / below)
    end_log = float(np.log10((ends + 0.5) / below))
    run = _score_rows(*frequent_costs(counts, NODES), head["value"].to_numpy(np.int64).view(np.uint64), logs, end_log, int(ends > 0))
    rows, _ = write_table(docs.select("doc_id", text).mapInPandas(
        run, "doc_id long, n_tokens long, known long, base double, score double, kinds array<int>, values array<long>, "
        "times array<long>").withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = rows.select("row", F.explode(F.arrays_zip("kinds", "values", "times")).alias("r")).select(
        "row", F.col("r.kinds").alias("kind"), F.col("r.values").alias("value"), "r.times")
    costs = gram_costs(counts, rest.where("kind = 1").select("value").distinct())
    known = words.select(F.lit(0).alias("kind"), "value", F.log10((F.col("n") + 0.5) / below).alias("log")).union(
        costs.select(F.lit(1).alias("kind"), "value", "log"))
    cost = F.col("times") * F.coalesce("log", F.lit(float(np.log10(0.5 / below))))
    found = rest.join(known, ["kind", "value"], "left").groupBy("row").agg(
        F.sum(F.when(F.col("kind") == 0, cost).otherwise(0.0)).alias("more"),
        F.sum(F.when((F.col("kind") == 0) & F.col("log").isNotNull(), F.col("times")).otherwise(0)).alias("also"),
        F.sum(F.when(F.col("kind") == 1, F.col("times") * F.col("log")).otherwise(0.0)).alias("rest"))
    return rows.join(found, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"))


def ppm_query(docs: DataFrame) -> DataFrame:
    """The contract of op9: learn from documents whose id leaves a remainder other than 1, score all."""
    scored = score_documents(docs.select("doc_id", "text"), remainder(F.col("doc_id"), 5) != 1)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")
