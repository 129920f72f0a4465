"""Text expressions. All but the rare part of `fold` stay in the JVM.

Character classes are spelled out so that words and white space mean the same for every script:
Java's `\\w` and `\\s` know ASCII only unless told otherwise.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from narrascope import fixed_values as fixed

WORD_CHAR = r"[\p{L}\p{N}_]"
NOT_WORD_CHAR = r"[^\p{L}\p{N}_]"
SPACE = r"[\t-\r\x1c-\x1f \x{85}\p{Z}]"
NOT_SPACE = r"[^\t-\r\x1c-\x1f \x{85}\p{Z}]"
# White space other than the blank. The look-ahead turns down printable ASCII with one comparison.
_ODD_SPACE = r"(?![ -~])[\t-\r\x1c-\x1f\x{85}\p{Z}]"
BEFORE_WORD = r"(?<![\p{L}\p{N}_])"
AFTER_WORD = r"(?![\p{L}\p{N}_])"


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def strip(value: Column) -> Column:
    return F.regexp_replace(value, f"^{SPACE}+|{SPACE}+$", "")


def collapse_spaces(value: Column) -> Column:
    """Every run of white space becomes one blank. Single blanks are not matched, so not rewritten."""
    return F.trim(F.regexp_replace(value, f"(?:{_ODD_SPACE}| (?={SPACE})){SPACE}*", " "))


def clean_text(value: Column) -> Column:
    """Drop web addresses and mentions, collapse white space. Null gives the empty text."""
    value = text_or_empty(value)
    # Plain substring tests keep the regexes off texts they cannot change.
    bare = F.when(value.contains("http") | value.contains("www."),
                  F.regexp_replace(value, rf"http{NOT_SPACE}+|www\.{NOT_SPACE}+", " ")).otherwise(value)
    bare = F.when(value.contains("@"), F.regexp_replace(bare, f"@{WORD_CHAR}+", " ")).otherwise(bare)
    return collapse_spaces(bare)


def quote_literal(literal: str) -> str:
    """Java regex for a literal."""
    return re.sub(r"([^\w\s]|_)", lambda m: "\\" + m.group() if m.group().isascii() else m.group(), literal)


def split_glued_acronyms(value: Column, acronyms: Iterable[str] | None = None, compat: bool = False) -> Column:
    """Put a blank between an acronym and a letter glued to it: `msfteam` -> `msf team`.

    By default an acronym must start a word and `hi` is left out, so that `children` stays whole.
    `compat` splits anywhere in a word, for all the given acronyms in turn.
    """
    if acronyms is None:
        acronyms = [a for a in fixed.GLUED_ACRONYMS if compat or a != "hi"]
    if compat:
        for acronym in acronyms:
            value = F.regexp_replace(value, f"(?i)({quote_literal(acronym)})(?=[a-z])", "$1 ")
        return value
    either = "|".join(quote_literal(a) for a in acronyms)
    return F.regexp_replace(value, f"(?i){BEFORE_WORD}({either})(?=[a-z])", "$1 ")


def strip_tag_marks(value: Column) -> Column:
    # Translating takes each letter through a map; searching for a sign that is not there does not.
    return F.replace(F.replace(value, F.lit("#"), F.lit("")), F.lit("@"), F.lit(""))


def fold_python(text: str) -> str:
    """Decompose, drop combining marks, compose."""
    marks_gone = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return unicodedata.normalize("NFKC", marks_gone)


def _ranges(codes: Iterable[int], gap: int = 0) -> str:
    """Code points as the inside of a regex class; neighbours, or all within a gap, are joined."""
    spans: list[list[int]] = []
    for code in sorted(codes):
        if spans and code - spans[-1][1] <= gap + 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in spans)


_LAST_LETTER = 0x2FFFF


def _is_jamo(code: int) -> bool:
    return 0x1100 <= code <= 0x11FF


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str, str, str]:
    """(letters to replace, replacements then deletions, coarse and exact class of letters left to Python).

    Folding works letter by letter except for letters that become several, and for those that can
    join the letter before them: Hangul jamo, and vowel signs that are the second part of another.
    """
    single, gone, hard = [], [], set(range(0x1100, 0x1200))
    for code in range(0x80, _LAST_LETTER + 1):
        char = chr(code)
        parts = unicodedata.decomposition(char)
        if parts and "<" not in parts and len(pair := parts.split()) == 2 and not unicodedata.combining(chr(int(pair[1], 16))):
            hard.add(int(pair[1], 16))
        if not parts and not unicodedata.combining(char):
            continue
        folded = fold_python(char)
        if len(folded) > 1 or folded and _is_jamo(ord(folded)):
            hard.add(code)
        elif not folded:
            gone.append(char)
        elif folded != char:
            single.append((char, folded))
    # Letters of the first 256 are told apart exactly, by bit set; others by a few wide ranges at first.
    coarse = _ranges(c for c in hard if c <= 0xFF) + _ranges((c for c in hard if c > 0xFF), gap=64)
    replaced = [(a, b) for a, b in single if ord(a) not in hard]
    removed = [c for c in gone if ord(c) not in hard]
    return ("".join(a for a, _ in replaced) + "".join(removed), "".join(b for _, b in replaced),
            f"[{coarse}]", f"[{_ranges(hard)}]")


@lru_cache(maxsize=1)
def _fold_batch():
    # Nested, so that it travels by value: executors need no copy of this package.
    def fold_text(text):
        if text is None:
            return None
        marks_gone = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        return unicodedata.normalize("NFKC", marks_gone)

    def fold_batch(texts: pd.Series) -> pd.Series:
        return texts.map(fold_text)

    return F.pandas_udf(fold_batch, StringType())


def fold(value: Column) -> Column:
    """Accent- and width-insensitive form of a text.

    ASCII text is kept, text whose letters fold one by one goes through a translation table, and only
    what is left is sent to Python (the others go there as nulls).
    """
    source, target, coarse, exact = _fold_table()
    is_hard = (F.octet_length(value) != F.length(value)) & value.rlike(coarse) & value.rlike(exact)
    easy = F.when(F.octet_length(value) == F.length(value), value).otherwise(F.translate(value, source, target))
    return F.coalesce(_fold_batch()(F.when(is_hard, value)), easy)


def fold_letterwise(value: Column) -> Column:
    """Like `fold`, without the Python part; for text known to hold no ligatures or rare scripts."""
    source, target, *_ = _fold_table()
    return F.when(F.octet_length(value) == F.length(value), value).otherwise(F.translate(value, source, target))


def normalise_text(value: Column, acronyms: Iterable[str] | None = None, compat: bool = False) -> Column:
    """Form in which keywords are searched."""
    value = split_glued_acronyms(text_or_empty(value), acronyms, compat)
    return fold(strip_tag_marks(F.lower(value)))


def normalise_keyword(keyword: str) -> str:
    """The form a keyword takes in normalised text."""
    return fold_python(re.sub("[#@]", "", keyword.lower()))


def extract_hashtags(value: Column) -> Column:
    return F.array_join(F.regexp_extract_all(value, F.lit(f"(#{WORD_CHAR}+)"), F.lit(1)), ", ")


def has_link(value: Column) -> Column:
    found = value.contains("http://") | value.contains("https://") | value.contains("t.co/")
    return F.when(found, "yes").otherwise("no")


def word_char_count(value: Column) -> Column:
    return F.length(F.regexp_replace(value, f"{NOT_WORD_CHAR}+", ""))


def quoted_part(value: Column) -> Column:
    """Text between quotation marks on one line, else the stripped input."""
    found = F.regexp_extract(value, "[“\"]([^\\n]+?)[”\"]", 1)
    return F.coalesce(F.nullif(found, F.lit("")), strip(value))


def after_marker(value: Column, marker: str = fixed.TITLE_MARKER) -> Column:
    """Part between the first and second marker; the input where there is none."""
    part = strip(F.get(F.split(value, quote_literal(marker)), F.lit(1)))
    return F.when(value.contains(marker), part).otherwise(value)


def first_non_blank(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def join_fragments(fragments: Column) -> Column:
    return F.array_join(fragments, " ")


def drop_junk(fragments: Column, junk: Iterable[str] = fixed.JUNK_PHRASES) -> Column:
    junk = list(junk)
    return F.filter(fragments, lambda s: ~F.lower(strip(s)).isin(junk))


def starts_as_repost(value: Column) -> Column:
    return F.coalesce(value.startswith("RT "), F.lit(False))


def permalink(post_id: Column) -> Column:
    return F.format_string(fixed.PERMALINK, post_id)


def guard_id(post_id: Column) -> Column:
    """Keep a spreadsheet from reading an id as a number."""
    return F.concat(F.lit("'"), post_id)


def sheet_link(post_id: Column) -> Column:
    return F.format_string(fixed.SHEET_LINK, post_id)


def strip_guard(value: Column) -> Column:
    return F.translate(strip(value.cast("string")), "'", "")


def is_digits(value: Column) -> Column:
    return value.rlike(r"^\p{Nd}+$")


def truthy_text(value: Column) -> Column:
    return F.coalesce(F.lower(value.cast("string")).isin("true", "1"), F.lit(False))


def int_or_zero(value: Column) -> Column:
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(0.0)).cast("int")


def int_or_text(value: Column) -> tuple[Column, Column]:
    """(number when the text is all digits, the text otherwise)."""
    digits = is_digits(value)
    return F.when(digits, value.try_cast("int")), F.when(~digits, value)


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def percent_text(share: Column) -> Column:
    return F.format_string("%.2f%%", share * 100)


def lang_bucket(language: Column, kept: Iterable[str] = fixed.LANGUAGES, other: str = fixed.OTHER_LANGUAGE) -> Column:
    code = F.lower(language.cast("string"))
    return F.when(code.isin(list(kept)), code).otherwise(other)


def primary_language(candidates: Column) -> Column:
    return F.coalesce(F.get(candidates, F.lit(0)), F.lit("unknown"))


def is_multi_language(candidates: Column) -> Column:
    return F.coalesce(F.size(candidates) > 1, F.lit(False))


def words(value: Column) -> Column:
    """Lower-case words of two letters or more."""
    return F.regexp_extract_all(F.lower(value), F.lit(f"({WORD_CHAR}{{2,}})"), F.lit(1))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n neighbouring tokens, joined by blanks; linear in the number of tokens."""
    if n == 1:
        return tokens
    grams = tokens
    for step in range(1, n):
        grams = F.zip_with(F.slice(grams, 1, F.greatest(F.size(tokens) - step, F.lit(0))),
                           F.slice(tokens, step + 1, F.greatest(F.size(tokens) - step, F.lit(0))),
                           lambda a, b: F.concat(a, F.lit(" "), b))
    return grams
