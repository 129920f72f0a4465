import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from narrascope.functions import text as X
from narrascope.functions.time import equal_width_bin, file_date, to_utc_timestamp


def column(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").coalesce(1)
    return [r[1] for r in rows.select("i", fn(F.col("v"))).orderBy("i").collect()]


def test_clean_text(spark):
    cases = {"  see https://t.co/x?y=1 now ": "see now", "hi @Müller_1!": "hi !", "a  b\n\tc": "a b c", "www.example.org": "",
             "mail a@b.org": "mail a .org", "шум @ник ок": "шум ок", "a  b": "a b", " x\x1fy　": "x y"}
    assert column(spark, list(cases), X.clean_text) == list(cases.values())
    assert column(spark, [None], X.clean_text) == [""]


def test_clean_text_is_idempotent(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(" \n\t @#aй链.htpwxyz/:_1") for _ in range(40)) for _ in range(200)]
    once = column(spark, texts, X.collapse_spaces)
    assert column(spark, once, X.collapse_spaces) == once
    assert once == [" ".join(t.split()) for t in texts]


def test_fold(spark):
    cases = {"médecins": "medecins", "красный": "красныи", "أطباء": "اطباء", "ﬁn ½ ™": "fin 1⁄2 TM", "ＡＢＣ": "ABC", "한국어": "한국어",
             "ガギ": "カキ", "𝐛𝐨𝐥𝐝": "bold", "plain": "plain", "ñandú ß": "nandu ß", "ো": "ো", "한": "한"}
    assert column(spark, list(cases), X.fold) == list(cases.values())


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x10FFF, exclude_categories=("Cs",)), max_size=30), min_size=60, max_size=80))
def test_fold_equals_unicode_rules(spark, texts):
    texts = [t.replace("\x00", "") for t in texts]
    assert column(spark, texts, X.fold) == [X.fold_python(t) for t in texts]


def test_letter_table_equals_unicode_rules(spark):
    # Every letter, between plain ones so that none can join another.
    letters = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c <= 0xDFFF and c not in (10, 13)]
    texts = ["".join(f"a{c}b" for c in letters[i:i + 400]) for i in range(0, len(letters), 400)]
    assert column(spark, texts, X.fold) == [X.fold_python(t) for t in texts]


def test_letter_table_alone(spark):
    """Texts without the letters left to Python come out right from the table."""
    import re
    exact = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", X._fold_table()[3]))
    letters = [c for c in map(chr, range(1, 0x30000)) if not 0xD800 <= ord(c) <= 0xDFFF and not exact.match(c)]
    rng = random.Random(9)
    texts = ["".join(letters[i:i + 300]) for i in range(0, len(letters), 300)]
    texts += ["".join(rng.choice(letters[:12000]) for _ in range(60)) for _ in range(400)]
    assert column(spark, texts, X.fold_letterwise) == [X.fold_python(t) for t in texts]


def test_common_scripts_stay_in_the_jvm():
    import re
    exact = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", X._fold_table()[3]))
    assert not exact.search("médecins красный крест الصليب الأحمر 红十字会 מגן דוד 😀🇺🇦❤️ カキ ２０２２ हिन्दी")


def test_split_acronyms(spark):
    def plain(c):
        return X.split_glued_acronyms(c)

    def compat(c):
        return X.split_glued_acronyms(c, compat=True)

    assert column(spark, ["MSFteam crsv children", "xmsfa"], plain) == ["MSF team crs v children", "xmsfa"]
    assert column(spark, ["children", "xmsfa"], compat) == ["chi ldren", "xmsf a"]


def test_normalise_text(spark):
    assert column(spark, ["#MSFcrew @Médecins ЙОД"], X.normalise_text) == ["msf crew medecins иод"]


def test_tags_links_and_counts(spark):
    assert column(spark, ["#a b #чай #السلام_1 ##x"], X.extract_hashtags) == ["#a, #чай, #السلام_1, #x"]
    assert column(spark, ["x t.co/a", "http", "https://x"], X.has_link) == ["yes", "no", "yes"]
    assert column(spark, ["a_b-1 ж", ""], X.word_char_count) == [5, 0]


def test_titles(spark):
    cases = {'Ann on X: "hello there"': "hello there", "Ann on X: bare on X: tail": "Ann on X: bare on X: tail", " plain ": "plain", "“curly” rest": "curly"}
    assert column(spark, list(cases), X.quoted_part) == list(cases.values())
    assert column(spark, ["Ann on X: bare on X: tail", "none"], X.after_marker) == ["bare", "none"]


def test_ids_and_numbers(spark):
    assert column(spark, ["12", "१२", "1a", ""], X.is_digits) == [True, True, False, False]
    assert column(spark, ["3", "3.0", "x", None, "-2.7"], X.int_or_zero) == [3, 3, 0, 0, -2]
    assert column(spark, [" '12 "], X.strip_guard) == ["12"]
    assert column(spark, ["7"], X.sheet_link) == ['=HYPERLINK("https://twitter.com/i/web/status/7", "View Tweet")']
    assert column(spark, ["True", "1", "false", None, "0"], X.truthy_text) == [True, True, False, False, False]
    assert column(spark, ["EN", "ru", "fr", None], X.lang_bucket) == ["en", "ru", "other", "other"]


def test_fragments_and_candidates(spark):
    row = spark.createDataFrame([(["Log in", " JOIN now ", "real text"], [], ["en", "fr"])], "f array<string>, n array<string>, l array<string>")
    out = row.select(X.join_fragments(X.drop_junk(F.col("f"))), X.primary_language(F.col("n")), X.primary_language(F.col("l")),
                     X.is_multi_language(F.col("l"))).first()
    assert tuple(out) == ("real text", "unknown", "en", True)


def test_words_and_ngrams(spark):
    tokens = [w for w in "a bc def-gh 12 ij".split()]
    row = spark.createDataFrame([(tokens, " ".join(tokens))], "t array<string>, s string")
    out = row.select(X.ngrams(F.col("t"), 2), X.ngrams(F.col("t"), 9), X.words(F.col("s"))).first()
    assert out[0] == [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]
    assert out[1] == [] and out[2] == ["bc", "def", "gh", "12", "ij"]


def test_times(spark):
    values = ["2022-01-02 03:04:05", "2022-01-02T03:04:05+02:00", "Wed Jan 05 10:00:00 +0000 2022", "2022/01/02", "later", None]
    got = [t and t.strftime("%F %T") for t in column(spark, values, lambda c: F.date_format(to_utc_timestamp(c), "yyyy-MM-dd HH:mm:ss").cast("timestamp"))]
    assert got == ["2022-01-02 03:04:05", "2022-01-02 01:04:05", "2022-01-05 10:00:00", "2022-01-02 00:00:00", None, None]
    assert column(spark, ["tweet_ids_2022-3-1.txt"], file_date) == ["2022-3-1"]


@pytest.mark.parametrize("n, expected", [(11, [3, 2, 2, 2, 2]), (1, [1])])
def test_equal_width_bins(spark, n, expected):
    bins = column(spark, [float(i) for i in range(n)], lambda c: equal_width_bin(c, F.lit(0.0), F.lit(float(n - 1)), 5), "double")
    assert [bins.count(b) for b in sorted(set(bins))] == expected


def test_values_without_time_fall_in_no_bin(spark):
    assert column(spark, [None, 3.0], lambda c: equal_width_bin(c, F.lit(3.0), F.lit(3.0), 5), "double") == [None, 0]


def test_marks_are_searched_for_and_not_translated(spark):
    df = spark.createDataFrame([("#a@b##c",), ("plain",), ("",), (None,)], "t string").select(X.strip_tag_marks(F.col("t")).alias("t"))
    assert [r.t for r in df.collect()] == ["abc", "plain", "", None]
    assert "translate(" not in spark.range(1).select(X.strip_tag_marks(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
