"""Keyword categories: lexicon as data, matched by regex (small) or by n-gram join (large)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope import fixed_values as fixed
from narrascope.functions import text as X
from narrascope.operators.rows import compute_once, explode_rows

LEXICON_SCHEMA = "category string, priority int, keyword string, match_mode string"
# Keywords of one pattern; a longer list becomes several.
PATTERN_KEYWORDS = 500
_NO_SPACES_SCRIPT = re.compile("[぀-ヿ㐀-䶿一-鿿]")


@dataclass(frozen=True)
class Entry:
    """One keyword. `match_mode` is word, substring or case_sensitive."""

    category: str
    priority: int
    keyword: str
    match_mode: str = "word"


def match_mode(keyword: str) -> str:
    """Scripts written without spaces have no word edges to match at."""
    return "substring" if _NO_SPACES_SCRIPT.search(keyword) else "word"


def parse_blocks(layout: str, separator: str | None = ", ") -> list[Entry]:
    """Category line, then keywords on one line (or one per line when `separator` is None), then a blank."""
    entries = []
    for priority, block in enumerate(re.split(r"\n\s*\n", layout.strip())):
        category, *lines = (line.strip() for line in block.splitlines())
        keywords = lines if separator is None else [k.strip() for line in lines for k in line.split(separator.strip())]
        entries += [Entry(category, priority, k, match_mode(k)) for k in keywords if k]
    return entries


def organisation_lexicon() -> list[Entry]:
    """The built-in organisation lexicon with its case-sensitive terms."""
    entries = parse_blocks(fixed.ORGANISATION_LEXICON)
    order = {e.category: e.priority for e in entries}
    return entries + [Entry(c, order[c], t, "case_sensitive")
                      for c, terms in fixed.CASE_SENSITIVE_TERMS.items() for t in terms]


def failure_phrases() -> list[Entry]:
    return [Entry(e.category, e.priority, e.keyword, "substring")
            for e in parse_blocks(fixed.FAILURE_PHRASES, separator=None)]


def lexicon_frame(spark: SparkSession, entries: Iterable[Entry]) -> DataFrame:
    return spark.createDataFrame([(e.category, e.priority, e.keyword, e.match_mode) for e in entries], LEXICON_SCHEMA)


def lexicon_entries(lexicon: DataFrame) -> list[Entry]:
    """Lexicon rows on the driver, for pattern building."""
    return [Entry(*row) for row in lexicon.select("category", "priority", "keyword", "match_mode").collect()]


def categories_of(entries: Iterable[Entry]) -> list[str]:
    """Categories in declaration order."""
    entries = list(entries)
    return sorted({e.category for e in entries}, key=lambda c: min(e.priority for e in entries if e.category == c))


def word_pattern(terms: Sequence[str], compat: bool = False) -> str:
    """One alternation of literals between word edges.

    Edges are look-arounds, so that terms starting or ending in a sign (`U.N.`) match too; `compat`
    takes plain word boundaries, at which such terms need a word character next to them.
    """
    either = "|".join(X.quote_literal(t) for t in terms)
    return rf"(?U)\b(?:{either})\b" if compat else f"{X.BEFORE_WORD}(?:{either}){X.AFTER_WORD}"


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def any_match(value: Column, terms: Sequence[str], pattern: Callable[[Sequence[str]], str]) -> Column:
    """Whether a text matches any of the terms: long lists are cut into several patterns."""
    return any_of([value.rlike(pattern(terms[i:i + PATTERN_KEYWORDS])) for i in range(0, len(terms), PATTERN_KEYWORDS)])


def literals(terms: Sequence[str]) -> str:
    return "|".join(X.quote_literal(t) for t in terms)


def category_conditions(entries: Sequence[Entry], normalised: Column, raw: Column,
                        compat: bool = False) -> dict[str, Column]:
    """Per category, whether a text belongs to it.

    `compat` matches keywords as declared (accents and marks kept), at plain word boundaries.
    """
    form = str.lower if compat else X.normalise_keyword
    conditions = {}
    for category in categories_of(entries):
        own = [e for e in entries if e.category == category]
        strict = [e.keyword for e in own if e.match_mode == "case_sensitive"]
        inside = [form(e.keyword) for e in own if e.match_mode == "substring" and not compat]
        # A marked keyword such as `@UN` would turn into a plain word once its mark is gone.
        marked = [e.keyword for e in own if e.match_mode == "word" and not compat and re.match("[#@]", e.keyword)]
        whole = [form(e.keyword) for e in own
                 if (e.match_mode == "word" or compat and e.match_mode == "substring") and e.keyword not in marked]
        parts = []
        if whole:
            parts.append(any_match(normalised, whole, lambda t: word_pattern(t, compat)))
        if inside:
            parts.append(any_match(normalised, inside, literals))
        if strict:
            parts.append(any_match(raw, strict, lambda t: word_pattern(t, compat)))
        if marked:
            parts.append(any_match(raw, marked, lambda t: "(?iu)" + word_pattern(t)))
        conditions[category] = any_of(parts)
    return conditions


def with_normalised(df: DataFrame, text: str = "text", to: str = "normalised", compat: bool = False) -> DataFrame:
    """Add the form in which keywords are searched."""
    lowered = X.strip_tag_marks(F.lower(X.split_glued_acronyms(X.text_or_empty(F.col(text)), compat=compat)))
    return compute_once(compute_once(df, _lowered=lowered), **{to: X.fold(F.col("_lowered"))}).drop("_lowered")


def categorise(df: DataFrame, entries: Sequence[Entry] | None = None, text: str = "text",
               normalised: str | None = None, compat: bool = False) -> DataFrame:
    """Add `categories`, the sorted array of matching categories, and `multi_category_match`.

    One pass over each row, no shuffle. Pass the name of an already normalised column to reuse it.
    """
    entries = organisation_lexicon() if entries is None else list(entries)
    added = normalised is None
    if added:
        normalised = "_normalised"
        df = with_normalised(df, text, normalised, compat)
    conditions = category_conditions(entries, F.col(normalised), X.text_or_empty(F.col(text)), compat)
    hits = F.array(*[F.when(condition, F.lit(category)) for category, condition in sorted(conditions.items())])
    df = compute_once(df, categories=F.array_compact(hits))
    df = df.withColumn("multi_category_match", F.size("categories") > 1)
    return df.drop(normalised) if added else df


def in_category(categories: Column, category: str) -> Column:
    return F.array_contains(categories, category)


def _word_runs(value: Column) -> tuple[Column, Column]:
    """Words of a text, and words with the signs that follow them."""
    run = f"({X.WORD_CHAR}+)({X.NOT_WORD_CHAR}*)"
    return (F.regexp_extract_all(value, F.lit(run), F.lit(1)),
            F.regexp_extract_all(value, F.lit(f"({run})"), F.lit(1)))


def categorise_ngram(df: DataFrame, lexicon: DataFrame, id_column: str, text: str = "text",
                     max_words: int | None = None, normalised: str | None = None) -> DataFrame:
    """(id, categories) of categorised texts, by equi-join of word n-grams with a lexicon of any size.

    An n-gram is cut from the text as it stands, signs between its words included, so the result is
    that of `categorise`. Substring keywords (those of scripts without spaces) are joined by character
    n-grams of their lengths, case-sensitive keywords and those that start or end in a sign are matched by
    regex on the way. The lexicon is broadcast only if the planner finds it under the
    broadcast threshold. N-grams are made distinct per text before the join, and only matches are
    shuffled. `max_words` defaults to the longest keyword.
    """
    if normalised is None:
        normalised = "_normalised"
        df = with_normalised(df, text, normalised)
    edge = f"^{X.NOT_WORD_CHAR}|{X.NOT_WORD_CHAR}$"
    is_gram = (F.col("match_mode") == "word") & ~F.col("keyword").rlike(edge)
    keys = lexicon.where(is_gram).select("category", X.fold(X.strip_tag_marks(F.lower("keyword"))).alias("gram")).distinct()
    inside = lexicon.where("match_mode = 'substring'").select(
        "category", F.concat(F.lit("~"), X.fold(X.strip_tag_marks(F.lower("keyword")))).alias("gram")).where("gram != '~'").distinct()
    lengths = sorted(r[0] for r in inside.select((F.char_length("gram") - 1).alias("n")).distinct().collect())
    others = lexicon_entries(lexicon.where(~is_gram & (F.col("match_mode") != "substring")))
    if max_words is None:
        max_words = keys.agg(F.max(F.size(_word_runs(F.col("gram"))[0]))).first()[0] or 1
    words, units = _word_runs(F.col(normalised))
    # Categories matched by regex join the n-grams as marks, which no n-gram can equal.
    marks = F.array().cast("array<string>")
    if others:
        conditions = category_conditions(others, F.col(normalised), X.text_or_empty(F.col(text)))
        marks = F.array_compact(F.array(*[F.when(c, F.lit("=" + k)) for k, c in conditions.items()]))
        keys = keys.union(keys.sparkSession.createDataFrame([(k, "=" + k) for k in conditions], "category string, gram string"))
    # Character n-grams are told from words by a sign in front; where no keyword starts, none is cut.
    pieces = F.array().cast("array<string>")
    if lengths:
        keys = keys.union(inside)
        heads = [r[0] for r in inside.select(F.substring("gram", 2, 1)).distinct().collect()]
        chars = F.col("_chars")
        df = df.withColumn("_chars", F.when(any_match(F.col(normalised), heads, literals), F.split(normalised, "")).otherwise(pieces))
        pieces = F.flatten(F.transform(F.filter(
            F.transform(chars, lambda c, i: F.when(c.isin(heads), i + 1)), lambda i: i.isNotNull()), lambda i: F.array(*[
                F.concat(F.lit("~"), F.array_join(F.slice(chars, i, F.lit(n)), "")) for n in lengths])))
    cut = df.select(id_column, words.alias("words"), units.alias("units"), F.concat(marks, F.array_distinct(pieces)).alias("marks"))
    grams, heads = [F.array_distinct("words")], F.col("units")
    for n in range(2, max_words + 1):
        length = F.greatest(F.size("words") - (n - 1), F.lit(0))
        grams.append(F.array_distinct(F.zip_with(F.slice(heads, 1, length), F.slice("words", n, length), lambda a, b: F.concat(a, b))))
        heads = F.zip_with(F.slice(heads, 1, length), F.slice("units", n, length), lambda a, b: F.concat(a, b))
    exploded = explode_rows(cut, F.flatten(F.array("marks", *grams)), "gram", id_column)
    hits = exploded.join(keys, "gram").select(id_column, "category").distinct()
    return hits.groupBy(id_column).agg(F.array_sort(F.collect_list("category")).alias("categories"))


def mentions_any(normalised: Column, terms: Sequence[str] = fixed.GENERAL_TERMS, compat: bool = False) -> Column:
    """Whether a normalised text holds one of the terms, as words (`compat`: anywhere)."""
    if compat:
        return normalised.rlike("|".join(X.quote_literal(t.lower()) for t in terms))
    return normalised.rlike(word_pattern([X.normalise_keyword(t) for t in terms]))


def assign_fallback(df: DataFrame, normalised: str, terms: Sequence[str] = fixed.GENERAL_TERMS,
                    fallback: str = fixed.FALLBACK_CATEGORY, compat: bool = False) -> DataFrame:
    """Rows without category that mention a general term get the fallback category; no join needed."""
    rest = (F.size("categories") == 0) & mentions_any(F.col(normalised), terms, compat)
    return df.withColumn("categories", F.when(rest, F.array(F.lit(fallback))).otherwise(F.col("categories")))


def classify_failure(search_text: Column, score: Column, phrases: Sequence[Entry] | None = None,
                     low_score: int = fixed.LOW_SCORE) -> Column:
    """First failure status, in declared order, with a phrase inside the text; empty above the score."""
    phrases = failure_phrases() if phrases is None else list(phrases)
    choice = [F.when(search_text.rlike("|".join(X.quote_literal(e.keyword.lower())
                                                for e in phrases if e.category == status)), status)
              for status in categories_of(phrases)]
    return F.when(score <= low_score, F.coalesce(*choice, F.lit(""))).otherwise("")
