"""Expressions over a stored page (its HTML text): fields, text cascade, media, metrics, score."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrascope import fixed_values as fixed
from narrascope.functions import text as X

# Entities written out in stored pages.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape(value: Column) -> Column:
    for entity, char in ENTITIES:
        value = F.replace(value, F.lit(entity), F.lit(char))
    return value


def inner_text(html: Column) -> Column:
    """Visible text of a piece of HTML: scripts, styles, comments and tags go, entities are written out."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>", " ")
    return X.collapse_spaces(unescape(bare))


def _closing(parts: Column, name: Column) -> Column:
    """Of the parts of an element's rest, each of which but the first starts at a tag of its name: how many there are up
    to the tag that closes the element, all if none does."""
    def step(state: Column, part: Column) -> Column:
        closes = F.startswith(part, F.lit("</"))
        # A tag that closes itself opens nothing.
        opens = F.startswith(F.lower(part), F.concat(F.lit("<"), name)) & ~part.rlike(r"^<[^>]*/>")
        depth = state["depth"] + F.when(closes, -1).when(opens, 1).otherwise(0)
        return F.when(state["depth"] <= 0, state).otherwise(F.struct(
            depth.alias("depth"), (state["n"] + F.when(depth > 0, 1).otherwise(0)).alias("n")))

    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))
    return F.aggregate(parts, start, step, lambda s: s["n"])


def _until_closed(rest: Column, name: Column) -> Column:
    """Content of an element from what follows its opening tag: up to the close tag at its own depth."""
    parts = F.split(rest, F.concat(F.lit(r"(?i)(?=</?"), name, F.lit(r"(?![\w-]))")))
    return F.element_at(F.transform(F.array(parts), lambda p: F.array_join(F.slice(p, 1, _closing(p, name)), "")), 1)


def element_html(html: Column, tag: str = r"\w+", attribute: str = "") -> Column:
    """Content of the first element with this tag and attribute text, nested elements of its name included; null where
    there is none. An element that is never closed reaches to the end."""
    inside = rf"[^>]*{X.quote_literal(attribute)}[^>]*" if attribute else r"(?:\s[^>]*)?"
    opening = rf"(?is)<({tag}){inside}(?<!/)>"
    name = F.lower(F.regexp_extract(html, opening, 1))
    rest = F.regexp_replace(html, rf"(?is)^.*?<(?:{tag}){inside}(?<!/)>", "")
    return F.when(html.rlike(opening), _until_closed(rest, name))


def attribute_of(html: Column, tag: str, marker: str, attribute: str) -> Column:
    """Attribute of the first such tag that carries the marker, in either order; empty if none."""
    mark = X.quote_literal(marker)
    ahead = F.regexp_extract(html, rf'(?is)<{tag}\b[^>]*{mark}[^>]*\b{attribute}="([^"]*)"', 1)
    behind = F.regexp_extract(html, rf'(?is)<{tag}\b[^>]*\b{attribute}="([^"]*)"[^>]*{mark}', 1)
    return unescape(X.first_non_blank(ahead, behind))


def spans(html: Column) -> Column:
    """Visible texts of all span elements in the order of their opening tags, nested ones with and within the outer."""
    def of(parts: Column) -> Column:
        places = F.filter(F.transform(parts, lambda p, i: F.when(p.rlike(r"(?i)^<span(?![\w-])[^>]*(?<!/)>"), i + 1)), lambda i: i.isNotNull())

        def content(i: Column) -> Column:
            after = F.concat(F.array(F.regexp_replace(F.element_at(parts, i), "^<[^>]*>", "")),
                             F.slice(parts, i + 1, F.size(parts)))
            return F.element_at(F.transform(F.array(after), lambda a: inner_text(
                F.array_join(F.slice(a, 1, _closing(a, F.lit("span"))), ""))), 1)

        return F.transform(places, content)

    return F.element_at(F.transform(F.array(F.split(html, r"(?i)(?=</?span(?![\w-]))")), of), 1)


def page_fields(html: Column, text_tag: str = r"\w+", text_attribute: str = f'data-testid="{fixed.TEXT_TESTID}"') -> Column:
    """The parts the text cascade draws on."""
    return F.struct(
        inner_text(element_html(html, text_tag, text_attribute)).alias("element"),
        attribute_of(html, "meta", 'property="og:title"', "content").alias("og_title"),
        attribute_of(html, "meta", 'name="twitter:title"', "content").alias("card_title"),
        attribute_of(html, "link", 'rel="alternate"', "title").alias("embed_title"),
        F.coalesce(inner_text(element_html(html, "title")), F.lit("")).alias("page_title"),
        spans(html).alias("spans"),
    )


def title_text(fields: Column) -> Column:
    raw = X.first_non_blank(fields["og_title"], fields["card_title"], fields["embed_title"], fields["page_title"])
    return X.after_marker(X.quoted_part(raw))


def span_text(fields: Column, junk: Iterable[str] = fixed.JUNK_PHRASES) -> Column:
    joined = X.strip(X.join_fragments(X.drop_junk(fields["spans"], junk)))
    return F.when(X.word_char_count(joined) >= fixed.MIN_WORD_CHARS, joined).otherwise("")


def extraction_cascade(fields: Column, junk: Iterable[str] = fixed.JUNK_PHRASES, compat: bool = False) -> Column:
    """struct(text, points): element 3, else title 2, else fragments 1.

    `compat` grants the 3 points to an element that is present but blank, on top of a later stage.
    """
    element = F.coalesce(fields["element"], F.lit(""))
    title = title_text(fields)
    fragments = span_text(fields, junk)
    extra = F.when(fields["element"].isNotNull(), 3).otherwise(0) if compat else F.lit(0)
    return (F.when(X.strip(element) != "", F.struct(element.alias("text"), F.lit(3).alias("points")))
            .when(X.strip(title) != "", F.struct(title.alias("text"), (extra + 2).alias("points")))
            .when(fragments != "", F.struct(fragments.alias("text"), (extra + 1).alias("points")))
            .otherwise(F.struct(F.lit("").alias("text"), extra.alias("points"))))


def quality_score(value: Column, points: Column | int = 0) -> Column:
    """Cascade points plus one each for a tag, a link, a mention and enough word characters."""
    points = F.lit(points) if isinstance(points, int) else points
    signs = (value.contains("#"), value.contains("http") | value.contains("t.co/"), value.contains("@"),
             X.word_char_count(value) >= fixed.MIN_WORD_CHARS)
    for sign in signs:
        points = points + F.coalesce(sign, F.lit(False)).cast("int")
    return points


def page_search_text(html: Column) -> Column:
    """Where failure phrases are looked for: markup, visible text and fragments, in lower case."""
    return F.lower(F.concat_ws(" ", html, inner_text(html)))


def testid(name: str) -> str:
    return f'data-testid="{name}"'


def media_flag(html: Column, markers: Iterable[str] = tuple(testid(t) for t in fixed.MEDIA_TESTIDS),
               container: str = "article") -> Column:
    """`yes` if the container element holds one of the markers."""
    either = "|".join(X.quote_literal(m) for m in markers)
    inside = element_html(html, container)
    return F.when(F.coalesce(inside.rlike(either), F.lit(False)), "yes").otherwise("no")


def metrics(html: Column, elements: dict[str, tuple[str, str]] | None = None) -> list[Column]:
    """Engagement texts, null where absent; exports write them with `metric_or_na`.

    `elements` gives tag pattern and attribute text per metric.
    """
    if elements is None:
        elements = {name: (r"\w+", testid(t)) for name, t in fixed.METRIC_TESTIDS.items()}
    return [inner_text(element_html(html, tag, mark)).alias(name) for name, (tag, mark) in elements.items()]


def metric_or_na(value: Column) -> Column:
    return F.coalesce(value, F.lit("N/A"))
