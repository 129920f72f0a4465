"""Text, lexicon, predicate and page queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope import fixed_values as fixed
from narrascope.functions import page as P
from narrascope.functions import text as X
from narrascope.functions.time import file_date, to_utc_timestamp
from narrascope.operators import aggregates as A
from narrascope.operators import lexicon as L
from narrascope.operators import models as M
from narrascope.operators import predicates as R
from narrascope.operators import windows as W
from narrascope.operators.rows import compute_once, explode_rows
from narrascope.plans.registry import load, query

# Pieces of SQL that mirror the expressions of `functions.text`.
SPACE = r"[\t-\r\x1c-\x1f \x{85}\p{Z}]"
NOT_SPACE = r"[^\t-\r\x1c-\x1f \x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
EDGE = r"[^\p{L}\p{N}_]"


def sql_strip(value: str) -> str:
    return rf"regexp_replace({value}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_collapse(value: str) -> str:
    return rf"trim(regexp_replace({value}, '{SPACE}+', ' ', 'g'))"


def sql_clean(value: str = "text") -> str:
    links = rf"regexp_replace(coalesce({value}, ''), 'http{NOT_SPACE}+|www\.{NOT_SPACE}+', ' ', 'g')"
    return sql_collapse(rf"regexp_replace({links}, '@{WORD}+', ' ', 'g')")


def sql_fold(value: str = "text") -> str:
    return f"strip_accents(translate(lower({value}), '#@', ''))"


def sql_words(value: str, terms: list[str]) -> str:
    return f"regexp_matches({value}, '(^|{EDGE})({'|'.join(terms)})($|{EDGE})')"


# Query parameters: a lexicon of words that occur in the documents, with accents, phrases and a sign.
LEXICON = L.parse_blocks("""
english
the, and, of the, with, which is, that the, was

german
der, die, und, für, über, in der, nicht

romance
que, des, de la, él, qué, où, le

institutions
für die, the of, la de, tion-un
""")
GENERAL = ("by", "y las", "auf", "aux", "in")


def sql_category(category: str) -> str:
    return sql_words("t", [X.normalise_keyword(e.keyword) for e in LEXICON if e.category == category])


CATEGORY_ORDER = sorted(L.categories_of(LEXICON))
SQL_TAGGED = f"""folded as (select doc_id, lang, source, {sql_fold(
    "regexp_replace(text, '(?i)(^|" + EDGE + ")(msf|acf|nrc|crs|pui|mdm)([a-z])', '\\1\\2 \\3', 'g')")} as t from documents),
tagged as (select *, list_filter([{', '.join(f"case when {sql_category(c)} then '{c}' end" for c in CATEGORY_ORDER)}],
    lambda x: x is not null) as categories,
    case when lower(lang) in ('en', 'ru') then lower(lang) else 'other' end as lang_bucket from folded)"""


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    docs = L.with_normalised(R.add_lang_bucket(docs, "lang"))
    return L.categorise(docs, LEXICON, normalised="normalised")


@query("clean_text_min_length", f"""
select doc_id, length(c) as clean_chars, md5(c) as clean_md5 from (select doc_id, {sql_clean()} as c from documents)
where length(c) >= 5""")
def clean_text_min_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning and minimum length."""
    docs = compute_once(load(spark, sf_dir, "documents"), clean_text=X.clean_text(F.col("text")))
    return R.min_length(docs).select("doc_id", F.length("clean_text").cast("long").alias("clean_chars"), F.md5("clean_text").alias("clean_md5"))


@query("keep_first_by_clean_text", f"""
select doc_id, lang from (select doc_id, lang, row_number() over (partition by {sql_clean()} order by doc_id) as r
from documents where length({sql_clean()}) >= 5) where r = 1""")
def keep_first_by_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First document per cleaned text."""
    docs = load(spark, sf_dir, "documents")
    docs = R.min_length(compute_once(docs.select("doc_id", "lang", "text"), clean_text=X.clean_text(F.col("text"))))
    return W.keep_first(docs, "clean_text", ["doc_id"], by_digest=True).select("doc_id", "lang")


@query("flag_duplicates", """
select doc_id, row_number() over (partition by text order by doc_id) > 1 as is_duplicate from documents""")
def flag_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text was seen before."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return W.flag_duplicates(docs, "text", "doc_id", by_digest=True).select("doc_id", "is_duplicate")


@query("fold_text", f"select doc_id, md5({sql_fold()}) as folded_md5 from documents")
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks off, lower case, accents folded."""
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(X.fold(X.strip_tag_marks(F.lower("text")))).alias("folded_md5"))


@query("split_acronyms", f"""
select doc_id, length(s) - length(text) as splits, md5(s) as split_md5 from (select doc_id, text, regexp_replace(text,
'(?i)(^|{EDGE})(the|der|que)([a-z])', '\\1\\2 \\3', 'g') as s from documents)""")
def split_acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank after an acronym glued to a word, for acronyms that occur in the documents."""
    docs = load(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", X.split_glued_acronyms(F.col("text"), ("the", "der", "que")).alias("s"))
    return docs.select("doc_id", (F.length("s") - F.length("text")).cast("long").alias("splits"), F.md5("s").alias("split_md5"))


@query("categorise_counts", f"""with {SQL_TAGGED}
select category, lang_bucket, count(*) as n from (select unnest(categories) as category, lang_bucket from tagged)
group by all""")
def categorise_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per category and language bucket: clean, bucket, match, explode, count."""
    routed = explode_rows(tagged(spark, sf_dir), "categories", "category", "lang_bucket")
    return routed.groupBy("category", "lang_bucket").agg(F.count("*").alias("n"))


@query("multi_category", f"""with {SQL_TAGGED}
select doc_id, array_to_string(categories, ',') as categories, len(categories) > 1 as multi_category_match,
list_contains(categories, 'german') as in_german from tagged""")
def multi_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category set of each document, its multi flag and a membership test."""
    return tagged(spark, sf_dir).select("doc_id", F.array_join("categories", ",").alias("categories"), "multi_category_match",
                                        L.in_category(F.col("categories"), "german").alias("in_german"))


@query("categorise_ngram", f"""with {SQL_TAGGED}
select doc_id, array_to_string(categories, ',') as categories from tagged where len(categories) > 0""")
def categorise_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sets by n-gram join."""
    docs = load(spark, sf_dir, "documents")
    found = L.categorise_ngram(docs, L.lexicon_frame(spark, LEXICON), "doc_id")
    return found.select("doc_id", F.array_join("categories", ",").alias("categories"))


@query("uncategorised_fallback", f"""with {SQL_TAGGED}
select doc_id, lang_bucket from tagged where len(categories) = 0
and {sql_words("t", [X.normalise_keyword(t) for t in GENERAL])}""")
def uncategorised_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of no category that mention a general term."""
    docs = L.assign_fallback(tagged(spark, sf_dir), "normalised", GENERAL)
    return explode_rows(docs, "categories", "category").where("category = 'uncategorized'").select("doc_id", "lang_bucket")


@query("category_language_grid", f"""with {SQL_TAGGED}, counted as (select category, lang_bucket, count(*) as n
from (select unnest(categories) as category, lang_bucket from tagged) group by all)
select c.category, b.lang_bucket, coalesce(n, 0) as n from (select unnest({CATEGORY_ORDER!r}) as category) c
cross join (select unnest(['en', 'ru', 'other']) as lang_bucket) b left join counted using (category, lang_bucket)""")
def category_language_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every category and language bucket, zeros included."""
    return A.category_grid(categorise_counts(spark, sf_dir), CATEGORY_ORDER, ["en", "ru", "other"])


# Query parameters: phrases that occur in the documents, in matching order.
PHRASES = [L.Entry(status, i, phrase, "substring") for i, (status, phrases) in enumerate({
    "contact": ("@mail", "phone"), "secret": ("token =", "key ="), "listing": (" | ",),
    "noise": ("%%%", "###", "$$$"), "licensed": ("license", "licensed under")}.items()) for phrase in phrases]


def sql_score(value: str, points: str = "0") -> str:
    return f"""({points} + cast(contains({value}, '#') as int) + cast(contains({value}, 'http') or contains({value}, 't.co/') as int)
    + cast(contains({value}, '@') as int) + cast(length(regexp_replace({value}, '{EDGE}+', '', 'g')) >= 15 as int))"""


def sql_failure(value: str, score: str) -> str:
    cases = " ".join(f"when {' or '.join(f'''contains({value}, '{e.keyword.lower()}')''' for e in PHRASES if e.category == s)} then '{s}'"
                     for s in L.categories_of(PHRASES))
    return f"case when {score} > 2 then '' {cases} else '' end"


@query("quality_score", f"select doc_id, {sql_score('text')} as score from documents")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", P.quality_score(F.col("text")).alias("score"))


@query("classify_failure", f"""
select doc_id, {sql_failure("lower(text)", sql_score("text"))} as fail_reason from documents""")
def classify_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First failure status whose phrase a low-score text holds."""
    docs = load(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", P.quality_score(F.col("text")).alias("score"))
    return docs.select("doc_id", L.classify_failure(F.lower("text"), F.col("score"), PHRASES).alias("fail_reason"))


@query("declutter", f"""
with scored as (select doc_id, text, {sql_score('text', 'doc_id % 3')} as score,
    {sql_failure("lower(text)", sql_score('text', 'doc_id % 3'))} as reason from documents)
select doc_id, score, length(case when trim(reason) <> '' or score <= 2 then '' else text end) as kept_chars from scored""")
def declutter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of failed and low-score records are blanked."""
    docs = load(spark, sf_dir, "documents")
    score = P.quality_score(F.col("text"), (F.col("doc_id") % 3).cast("int"))
    docs = docs.select("doc_id", "text", score.alias("hydration_score"))
    docs = docs.withColumn("fail_reason", L.classify_failure(F.lower("text"), F.col("hydration_score"), PHRASES))
    return R.declutter(docs).select("doc_id", F.col("hydration_score").cast("long").alias("score"),
                                    F.length("text").cast("long").alias("kept_chars"))


@query("filter_language", "select doc_id, lang from documents where lower(lang) in ('fr', 'es')")
def filter_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept languages; the filter reaches the scan."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    return R.filter_language(docs, ("fr", "ES"), ("lang",))


@query("drop_reposts", """
select d.doc_id from documents d left join labels l using (doc_id)
where not (d.text like 'RT %' or coalesce(l.toxic, 0) > 0) and coalesce(l.quality, 1) not in (0)""")
def drop_reposts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reposts by prefix or count and flagged duplicates; the label columns stand in for both."""
    labels = load(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("retweetcount"),
                                                  (1 - F.col("quality")).alias("is_duplicate"))
    docs = load(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id", "left")
    return R.drop_reposts(R.drop_flagged_duplicates(docs)).select("doc_id")


@query("mentions_any", f"""
select doc_id, {sql_words(sql_fold(), [X.normalise_keyword(t) for t in GENERAL])} as mentioned,
{" or ".join(f"contains({sql_fold()}, '{t}')" for t in GENERAL)} as contained from documents""")
def mentions_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """General terms as words, and anywhere."""
    docs = load(spark, sf_dir, "documents")
    docs = docs.select("doc_id", X.fold(X.strip_tag_marks(F.lower("text"))).alias("t"))
    return docs.select("doc_id", L.mentions_any(F.col("t"), GENERAL).alias("mentioned"),
                       L.mentions_any(F.col("t"), GENERAL, compat=True).alias("contained"))


@query("tags_and_links", f"""
select page_id, array_to_string(regexp_extract_all(v, '#{WORD}+'), ', ') as hashtags,
case when contains(v, 'http://') or contains(v, 'https://') or contains(v, 't.co/') then 'yes' else 'no' end as has_link,
length(regexp_replace(v, '{EDGE}+', '', 'g')) as word_chars from (select page_id, url || ' ' || html as v from pages)""")
def tags_and_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags, link flag and word characters of address and markup."""
    pages = load(spark, sf_dir, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("v"))
    return pages.select("page_id", X.extract_hashtags(F.col("v")).alias("hashtags"), X.has_link(F.col("v")).alias("has_link"),
                        X.word_char_count(F.col("v")).cast("long").alias("word_chars"))


def sql_inner(value: str) -> str:
    out = rf"regexp_replace({value}, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g')"
    for entity, char in P.ENTITIES:
        out = f"replace({out}, '{entity}', '{char}')" if char != "'" else f"replace({out}, '{entity}', '''')"
    return sql_collapse(out)


def sql_element(tag: str, inside: str = r"(?:\s[^>]*)?") -> str:
    return rf"nullif(regexp_extract(html, '(?is)<(?:{tag}){inside}>(.*?)</(?:{tag})\s*>', 1), '')"


SQL_TITLE = f"""(select page_id, case when q <> '' then q else {sql_strip('raw')} end as title from (select page_id, raw,
regexp_extract(raw, '[“"]([^\\n]+?)[”"]', 1) as q from (select page_id, {sql_inner(sql_element('title'))} as raw from pages)))"""


@query("page_extract", f"""
select p.page_id, md5(coalesce(nullif(a, ''), title, '')) as text_md5,
case when coalesce(a, '') <> '' then 3 when coalesce(title, '') <> '' then 2 else 0 end as points
from (select page_id, {sql_inner(sql_element('article'))} as a from pages) p join {SQL_TITLE} t using (page_id)""")
def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text cascade with the article as the text element."""
    pages = load(spark, sf_dir, "pages")
    fields = pages.select("page_id", P.page_fields(F.col("html"), "article", "").alias("f"))
    found = fields.select("page_id", P.extraction_cascade(F.col("f")).alias("x"))
    return found.select("page_id", F.md5("x.text").alias("text_md5"), F.col("x.points").alias("points"))


@query("page_title_text", f"select page_id, title from {SQL_TITLE}")
def page_title_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title stage of the cascade: first title there is, quoted part, part after the marker."""
    pages = load(spark, sf_dir, "pages")
    fields = pages.select("page_id", P.page_fields(F.col("html")).alias("f"))
    return fields.select("page_id", P.title_text(F.col("f")).alias("title"))


@query("page_fragments", f"""
with items as (select page_id, [x for x in [{sql_inner('y')} for y in regexp_extract_all(html, '(?is)<li>(.*?)</li>', 1)]
    if lower({sql_strip('x')}) not in ('the', 'and', 'de', 'la', 'der', 'die')] as kept from pages)
select page_id, len(kept) as fragments, array_to_string(kept, ' ') as joined from items""")
def page_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of a page without junk phrases, joined; list items stand in for spans."""
    pages = load(spark, sf_dir, "pages")
    items = F.transform(F.regexp_extract_all("html", F.lit("(?is)<li>(.*?)</li>"), F.lit(1)), P.inner_text)
    kept = X.drop_junk(items, ("the", "and", "de", "la", "der", "die"))
    pages = pages.select("page_id", kept.alias("kept"))
    return pages.select("page_id", F.size("kept").cast("long").alias("fragments"), X.join_fragments(F.col("kept")).alias("joined"))


@query("page_media_metrics", rf"""
select page_id, case when contains({sql_element('article')}, '<b>') then 'yes' else 'no' end as media,
coalesce({sql_inner(sql_element('div', '[^>]*class="ad"[^>]*'))}, 'N/A') as views,
coalesce({sql_inner(sql_element('aside', '[^>]*class="ad"[^>]*'))}, 'N/A') as likes from pages""")
def page_media_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media flag and metric texts, with markers that occur in the pages."""
    pages = load(spark, sf_dir, "pages")
    elements = {"views": ("div", 'class="ad"'), "likes": ("aside", 'class="ad"')}
    found = pages.select("page_id", P.media_flag(F.col("html"), ["<b>"]).alias("media"), *P.metrics(F.col("html"), elements))
    return found.select("page_id", "media", *[P.metric_or_na(F.col(c)).alias(c) for c in elements])


@query("links_and_ids", """
select doc_id, 'https://twitter.com/i/web/status/' || doc_id as permalink,
'=HYPERLINK("https://twitter.com/i/web/status/' || doc_id || '", "View Tweet")' as sheet_link,
'''' || doc_id as guarded, cast(doc_id as varchar) as plain, '2024-3-' || (doc_id % 28 + 1) as file_date,
cast(doc_id as int) as code from documents""")
def links_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permalinks, spreadsheet guards and back, dates in file names, numbers in texts."""
    ids = load(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"))
    name = F.concat(F.lit("tweet_ids_2024-3-"), (F.col("doc_id") % 28 + 1).cast("string"), F.lit(".txt"))
    guarded = X.guard_id(F.col("id"))
    return ids.select("doc_id", X.permalink(F.col("id")).alias("permalink"), X.sheet_link(F.col("id")).alias("sheet_link"),
                      guarded.alias("guarded"), X.strip_guard(guarded).alias("plain"), file_date(name).alias("file_date"),
                      X.int_or_text(F.col("id"))[0].alias("code"))


@query("to_utc_timestamp", """
select event_id, case when event_id % 7 = 0 then null when event_id % 3 < 2 then epoch_us(date_trunc('second', ts))
else epoch_us(date_trunc('day', ts)) end as micros from events""")
def to_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in several layouts, unreadable ones as null."""
    ts = F.col("ts")
    written = (F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("soon "), F.col("event_id").cast("string")))
               .when(F.col("event_id") % 3 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX"))
               .when(F.col("event_id") % 3 == 1, F.date_format(ts, "EEE MMM dd HH:mm:ss Z yyyy"))
               .otherwise(F.date_format(ts, "yyyy/MM/dd")))
    events = load(spark, sf_dir, "events").select("event_id", to_utc_timestamp(written).alias("t"))
    return events.select("event_id", F.unix_micros("t").alias("micros"))


@query("language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of a fifth of the documents by a model fitted on the others; counts of right and wrong."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.col("doc_id") % 5 == 0
    found = M.identify_language(docs.where(held), M.fit_language_model(docs.where(~held)))
    return found.groupBy("lang", "detected_language").agg(F.count("*").alias("n"))


@query("language_profile", """
with spaced as (select doc_id, lang, ' ' || trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) || ' ' as s from documents),
grams as (select doc_id, lang, unnest(list_transform(range(1, len(s) - 1), lambda i: substr(s, i, 3))) as gram from spaced),
counts as (select lang, gram, count(*) as n from grams where doc_id % 5 <> 0 group by lang, gram),
sums as (select lang, ln(sum(n) + (select count(distinct gram) from counts)) as base from counts group by lang),
tf as (select doc_id, gram, count(*) as tf from grams where doc_id % 5 = 0 group by doc_id, gram),
lengths as (select doc_id, sum(tf) as size from tf group by doc_id),
scored as (select doc_id, lang, round(sum(tf * ln(n + 1)) - any_value(size) * any_value(base), 6) as score
    from tf join counts using (gram) join sums using (lang) join lengths using (doc_id) group by doc_id, lang)
select doc_id, lang as detected from scored qualify row_number() over (partition by doc_id order by score desc, lang) = 1""")
def language_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of a fifth of the documents by character profiles counted on the others."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.col("doc_id") % 5 == 0
    found = M.identify_by_profile(docs.where(held), M.fit_language_profile(docs.where(~held)), "doc_id")
    return found.select("doc_id", F.col("lang").alias("detected"))


# Query parameters: word lists that occur in the documents.
POSITIVE, NEGATIVE = ("the", "la", "und", "que"), ("of", "de", "die", "le")


@query("lexicon_sentiment", f"""
with scored as (select doc_id, len([x for x in w if x in {POSITIVE!r}]) - len([x for x in w if x in {NEGATIVE!r}]) as s
from (select doc_id, regexp_extract_all(lower(text), '{WORD}{{2,}}') as w from documents))
select doc_id, case when s < 0 then 'LABEL_0' when s > 0 then 'LABEL_2' else 'LABEL_1' end as sentiment from scored""")
def lexicon_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-class label from the balance of two word lists."""
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", M.lexicon_sentiment(F.col("text"), POSITIVE, NEGATIVE).alias("sentiment"))


@query("case_sensitive_rule", f"""
select doc_id, regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_])The($|[^\\p{{L}}\\p{{N}}_])') as found from documents""")
def case_sensitive_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyword that counts only as written."""
    docs = L.categorise(load(spark, sf_dir, "documents"), [L.Entry("strict", 0, "The", "case_sensitive")])
    return docs.select("doc_id", (F.size("categories") > 0).alias("found"))


@query("after_marker", """
select doc_id, case when doc_id % 2 = 0 then trim(source) else source || ' / ' || lang end as title from documents""")
def after_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows the marker of a page title, the whole title where there is none."""
    docs = load(spark, sf_dir, "documents")
    marked = F.concat(F.lit("Name"), F.lit(fixed.TITLE_MARKER), F.lit(" "), F.col("source"), F.lit(" "))
    title = F.when(F.col("doc_id") % 2 == 0, marked).otherwise(F.concat("source", F.lit(" / "), "lang"))
    return docs.select("doc_id", X.after_marker(title).alias("title"))


@query("language_is_multi", """
select doc_id, doc_id % 3 = 0 as multi, case when doc_id % 3 = 2 then 'unknown' else lang end as first from documents""")
def language_is_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether several languages are candidates, and the likeliest."""
    kind = F.col("doc_id") % 3
    found = F.when(kind == 0, F.array("lang", F.lit("xx"))).when(kind == 1, F.array("lang")).otherwise(F.array().cast("array<string>"))
    return load(spark, sf_dir, "documents").select("doc_id", X.is_multi_language(found).alias("multi"), X.primary_language(found).alias("first"))
