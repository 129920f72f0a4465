"""Document fingerprints by winnowing (Schleimer, Wilkerson and Aiken 2003), with SQL functions only.

The hashes of all runs of k units are cut into windows of w; each window keeps its least hash, the rightmost where
several are equal, with its position. Any run of w + k - 1 units that two texts share leaves a common hash
at matching positions in both. A unit is a word, or a character where no blanks show where words end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A selected hash is kept as (hash << 31) | (2 ** 31 - 1 - position): the least value of a window is its least hash at
#: its rightmost position.
PLACE = (1 << 31) - 1
#: Scripts without blanks: Thai, Lao, Tibetan, Burmese, Khmer, Han, kana.
_DENSE = (r"฀-࿿က-႟ក-៿⺀-⿟々-〇ぁ-ヿㇰ-ㇿ㐀-䶿一-鿿"
          r"豈-﫿ｦ-ﾟ\x{20000}-\x{3FFFF}")
_LOOSE = rf"[^\x20\x09-\x0D{_DENSE}]"
#: A run of up to 64 other characters is a word; every character of a longer one, and of those scripts, is a unit of its
#: own. The first choice within the brackets is the same as the second for the letters below them, and quicker.
UNITS = rf"(?<!{_LOOSE})(?:[\x00-\x08\x0E-\x1F\x21-෿]{{1,64}}+(?!{_LOOSE})|{_LOOSE}{{1,64}}+(?!{_LOOSE}))|[^\x20\x09-\x0D]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _ahead(values: Column, step: int, join: Callable[[Column, Column], Column]) -> Column:
    """join(x[i], x[i + step]) for all i that have both."""
    left = F.greatest(F.size(values) - step, F.lit(0))
    return F.zip_with(F.slice(values, 1, left), F.slice(values, step + 1, left), join)


def _doubled(values: Column, size: int, join: Callable[[Column, Column], Column]) -> Column:
    """All runs of `size` (a power of two) values joined, by joining ever longer runs in pairs."""
    def grow(x: Column, step: int) -> Column:
        return x if step == size else _let(_ahead(x, step, join), lambda y: grow(y, step * 2))

    return grow(values, 1)


def fingerprint(text: Column, k: int = 4, w: int = 8) -> Column:
    """Array of the selected (hash, position) pairs of a text in order, packed in longs.

    Units are what lies between white space, but single characters in scripts without blanks and in anything longer
    than 64 characters; a text with fewer than k units is one run, and one with fewer than w runs one window. k and w are powers of two, so both the run hashes and the window minima are doubled up
    from one step to the next. Null, empty and wordless texts have no pairs.
    """
    none = F.array().cast("array<long>")
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNITS), F.lit(0)),
                        lambda word: F.xxhash64(word))

    def runs(found: Column) -> Column:
        whole = F.array(F.xxhash64(F.array_join(F.transform(found, lambda h: h.cast("string")), " ")))
        return F.when(F.size(found) >= k, _doubled(found, k, lambda a, b: F.xxhash64(a, b))).when(
            F.size(found) > 0, whole).otherwise(none)

    def windows(packed: Column) -> Column:
        return F.when(F.size(packed) >= w, F.array_distinct(_doubled(packed, w, lambda a, b: F.least(a, b)))).when(
            F.size(packed) > 0, F.array(F.array_min(packed))).otherwise(none)

    def pack(found: Column) -> Column:
        return F.transform(found, lambda h, i: F.shiftleft(h.bitwiseAND(F.lit((1 << 32) - 1)), 31).bitwiseOR(F.lit(PLACE) - i))

    return _let(_let(words, lambda x: pack(runs(x))), windows)


def hashes(print_: Column) -> Column:
    """Distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(print_, lambda x: F.shiftright(x, 31)))


def as_text(print_: Column) -> Column:
    """A fingerprint as text: hash:position, in hexadecimal, separated by spaces."""
    return F.array_join(F.transform(print_, lambda x: F.concat(
        F.lower(F.hex(F.shiftright(x, 31))), F.lit(":"), F.lower(F.hex(F.lit(PLACE) - x.bitwiseAND(F.lit(PLACE)))))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def with_next(docs: DataFrame, order: str, columns: list[str], rows_per_piece: int = 4096) -> DataFrame:
    """Add next_<column> of the row that follows by descending `order`; after the last comes the first.

    The order is cut into pieces by quantiles of `order`, so no task sees more than a piece (there are at most 2 ** 16);
    what follows a piece's last row is the first row of the next piece. Rows of equal order follow by their
    columns, descending. Null comes last.
    """
    pieces = min(1 << 16, max(1, -(-docs.count() // rows_per_piece)))
    found = docs.agg(F.percentile_approx(order, [i / pieces for i in range(1, pieces)], 10 * pieces)).first()[0] if pieces > 1 else None
    bounds, fan = sorted(set(found or [])), 256
    # Two steps to a row's piece: which group of bounds, then which of the group.
    groups = [bounds[i:i + fan] for i in range(0, len(bounds), fan)] or [[]]
    tops = F.array(*(F.lit(g[0]) for g in groups if g)).cast("array<long>")
    fine = F.array(*(F.array(*map(F.lit, g)).cast("array<long>") for g in groups))
    group = F.greatest(F.size(F.filter(tops, lambda e: e < F.col(order))), F.lit(1))
    place = (group - 1) * fan + F.size(F.filter(F.element_at(fine, group), lambda e: e < F.col(order)))
    piece = F.when(F.col(order).isNull(), F.lit(len(bounds) + 1)).otherwise(F.lit(len(bounds)) - place).cast("int")
    numbered, record = docs.withColumn("piece", piece), F.struct(order, *columns)
    inside = Window.partitionBy("piece").orderBy(F.col(order).desc_nulls_last(), *(F.col(c).desc() for c in columns))
    followed = numbered.withColumn("following", F.lead(record).over(inside))
    # One row for each piece: the first row of the piece after it.
    ends = Window.orderBy("piece")
    after = numbered.groupBy("piece").agg(F.max(record).alias("own")).withColumn(
        "after", F.coalesce(F.lead("own").over(ends), F.first("own").over(ends.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)))).select("piece", "after")
    return followed.join(after, "piece").withColumn("following", F.coalesce("following", "after")).select(
        *docs.columns, *(F.col("following")[c].alias(f"next_{c}") for c in columns))


def fingerprint_neighbours(docs: DataFrame, k: int = 4, w: int = 8) -> DataFrame:
    """One row (doc_id, n_chars, edited_sha256, own, edited, next) for each row of docs (doc_id, text): the fingerprints of
    its text, of its edited text and of the next document.

    The edited text has the last half of the code points replaced by the first as many (or all) of the next document by
    descending doc_id. Null counts as the empty text. Equal doc_ids follow by text, null ids come last. A single
    document is its own next.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - char_length(text) div 2)"),
                      F.expr("substring(next_text, 1, char_length(text) div 2)"))
    paired = with_next(own, "doc_id", ["text"]).withColumn("edited_text", edited)
    return paired.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited_text"), 256).alias("edited_sha256"),
                         fingerprint(F.col("text"), k, w).alias("own"), fingerprint(F.col("edited_text"), k, w).alias("edited"),
                         fingerprint(F.col("next_text"), k, w).alias("next"))


def fingerprint_query(docs: DataFrame) -> DataFrame:
    """The contract of op4."""
    made = fingerprint_neighbours(docs)
    return made.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"),
                       as_text(F.col("edited")).alias("edited_fingerprint"),
                       likeness(hashes(F.col("own")), hashes(F.col("edited"))).alias("near_edited"),
                       likeness(hashes(F.col("own")), hashes(F.col("next"))).alias("near_next"))
