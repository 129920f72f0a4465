import random

from pyspark.sql import functions as F

from narrascope import fixed_values as fixed
from narrascope.operators import lexicon as L
from narrascope.plans.flows import categorise_posts
from narrascope.sources.lexicons import read_lexicon


def categories(spark, texts, **options):
    posts = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.categories for r in L.categorise(posts, **options).orderBy("i").collect()]


def test_lexicon_size():
    entries = [e for e in L.organisation_lexicon() if e.match_mode != "case_sensitive"]
    assert len(L.categories_of(entries)) == 7 and len(entries) == 162
    assert len(L.categories_of(L.failure_phrases())) == 6 and len(L.failure_phrases()) == 37


def test_categories(spark):
    texts = ["Médecins Sans Frontières in Kyiv", "Красный крест помог", "我爱红十字会的人", "الصليب الأحمر هنا", "the U.N. said", "thanks @UN!",
             "who knows", "WHO knows", "ACTED is here", "he acted", "caritas and icrc", "redcross", "#RedCross", "mango", "", None]
    got = categories(spark, texts)
    assert got == [["msf_solidarist"], ["red_cross"], ["red_cross"], ["red_cross"], ["un_agencies"], ["un_agencies"], [], ["un_agencies"],
                   ["msf_solidarist"], [], ["faith_based", "red_cross"], [], [], [], [], []]


def test_compat_keeps_the_original_rules(spark):
    texts = ["Médecins Sans Frontières", "save the children", "crsv report", "doctors without borders"]
    assert categories(spark, texts, compat=True) == [[], [], ["faith_based"], ["msf_solidarist"]]
    assert categories(spark, texts) == [["msf_solidarist"], ["msf_solidarist"], ["faith_based"], ["msf_solidarist"]]


def test_ngram_join_equals_regex(spark):
    rng = random.Random(5)
    words = ["red", "cross", "croix", "rouge", "aid", "agency", "us", "the", "é", "world", "vision"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "-", ", ", ". "]) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    entries = L.parse_blocks("a\nred cross, croix-rouge, the\n\nb\nus aid agency, world vision, é\n\nc\nrouge, red cross aid")
    posts = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    regex = {r.i: r.categories for r in L.categorise(posts, entries).collect() if r.categories}
    joined = {r.i: r.categories for r in L.categorise_ngram(posts, L.lexicon_frame(spark, entries), "i").collect()}
    assert regex == joined and len(regex) > 50


def test_ngram_join_equals_regex_on_the_whole_lexicon(spark):
    texts = ["Médecins Sans Frontières, the U.N. and @UN", "WHO knows", "who knows", "我爱红十字会的人", "croix-rouge; samaritan's purse", "ACTED", "acted",
             "UN-led aid", "un-led", "the dt  global", "dt global!", "u.n", "nothing at all", "الصليب الأحمر"]
    posts = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    entries = L.organisation_lexicon()
    regex = {r.i: r.categories for r in L.categorise(posts, entries).collect() if r.categories}
    joined = {r.i: r.categories for r in L.categorise_ngram(posts, L.lexicon_frame(spark, entries), "i").collect()}
    assert regex == joined


def test_large_lexicons_give_equal_results_in_both_matchers(spark):
    r = random.Random(9)
    signs = [chr(0x4E00 + i) for i in range(60)]
    words = list({"".join(r.choice(signs) for _ in range(r.choice([2, 3, 3, 4, 5]))) for _ in range(3200)})[:3000]
    entries = [L.Entry(f"c{i % 4}", i % 4, w, "substring") for i, w in enumerate(words)]
    entries += [L.Entry("c1", 1, f"Name{i}", "case_sensitive") for i in range(1200)] + [L.Entry("c5", 5, f"@tag{i}", "word") for i in range(600)]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 12))) + r.choice(["", " Name7 x", " name7", " @tag599 y", " tag599"]) for _ in range(300)]
    posts = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    plain = {r.i: r.categories for r in L.categorise(posts, entries).collect() if r.categories}
    joined = {r.i: r.categories for r in L.categorise_ngram(posts, L.lexicon_frame(spark, entries), "i").collect()}
    assert plain == joined and len(plain) > 150
    want = {i: {e.category for e in entries[:3000] if e.keyword in t} for i, t in enumerate(texts)}
    assert all(want[i] <= set(plain.get(i, [])) for i in want)


def test_fallback(spark):
    posts = spark.createDataFrame([(1, "an NGO came", "EN"), (2, "a mango", "en"), (3, "red cross ngo", None), (4, "aid groups", "ru")],
                                  "tweetid int, Content string, language string")
    out = {r.tweetid: (r.categories, r.lang_bucket) for r in categorise_posts(posts).collect()}
    assert out == {1: (["uncategorized"], "en"), 2: ([], "en"), 3: (["red_cross"], "other"), 4: (["uncategorized"], "ru")}
    compat = {r.tweetid: r.categories for r in categorise_posts(posts, compat=True).collect()}
    assert compat[2] == ["uncategorized"]


def test_failures(spark):
    rows = [("this tweet is unavailable. account suspended", 1), ("account suspended", 2), ("account suspended", 3), ("此推文不可用", 0), ("fine", 0)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, s int").coalesce(1).select(L.classify_failure(F.col("t"), F.col("s"))).collect()]
    assert got == ["tweet_unavailable", "account_suspended", "", "tweet_unavailable", ""]


def test_read_lexicon(spark, tmp_path):
    file = tmp_path / "words.txt"
    file.write_text("one\nred cross, 红十字会, @hi_fr\n\ntwo\nu.s aid, r2p\n", encoding="utf-8")
    frame = read_lexicon(spark, str(file))
    assert {tuple(r) for r in frame.collect()} == {("one", 0, "red cross", "word"), ("one", 0, "红十字会", "substring"), ("one", 0, "@hi_fr", "word"),
                                                   ("two", 1, "u.s aid", "word"), ("two", 1, "r2p", "word")}
    entries = L.lexicon_entries(frame)
    assert categories(spark, ["follow @HI_fr", "hi_fr", "more U.S aid"], entries=entries) == [["one"], [], ["two"]]


def test_values_are_stated():
    assert len(fixed.GENERAL_TERMS) == 18 and len(fixed.POST_COLUMNS + fixed.LINEAGE_COLUMNS) == 21 and len(fixed.RECORD_COLUMNS) == 15
