"""Tables with nulls, empty and very long texts, ties, repeated rows and columns with clashing names."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string"


def rows():
    r = random.Random(5)
    syllables = {"en": "the th er on an re he in ed nd".split(), "de": "ung der sch ein ich ver ch keit".split(),
                 "fr": "eau oux les que éa ré ment è".split()}
    out = []
    for i in range(120):
        lang = ("en", "de", "fr")[i % 3]
        words = ["".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 60))]
        if i % 10 == 0:
            words[2:2] = ["moron", "idiot", "scum"] * 2
        out.append((i, " ".join(words), lang, f"s{i % 4}", 1, 0.5, "x"))
    out += [(200, None, "en", "s0", 0, None, None), (201, "", "de", None, 0, None, None), (202, " \t\n", None, "s1", 3, None, None),
            (203, "12 34 !!", "fr", "s2", 8, None, None), (None, out[7][1], None, None, None, None, None),
            (204, "the " * 40_000 + "end", "en", "s3", 1, 1.0, "y"), (205, "x" * 150_000, "en", "s3", 1, 1.0, "y"),
            (206, out[3][1], "en", "s0", 1, 1.0, "y"), (207, out[3][1] + " more", "en", "s0", 1, 1.0, "y"),
            (208, "Two words", "en", "s0", 9, 1.0, "y"), (209, "two  WORDS", "en", "s0", 10, 1.0, "y"), (210, "ÄÖ two", None, "s0", 6, 1.0, "y")]
    out += [out[5], out[5]]
    long = out[11][1].split() * 6
    out += [(300 + i, " ".join(w if j != 7 * i + 3 else f"other{i}" for j, w in enumerate(long)), "de", "s1", 1, 0.0, "z") for i in range(6)]
    return out


@pytest.fixture(scope="session")
def table():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, table):
    return spark.createDataFrame(table, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    marks = [(i, 0 if i % 7 == 0 else 1, int(i % 10 == 0), 0.1) for i in range(0, 120)]
    return spark.createDataFrame([*marks, (5, 0, 0, 0.0), (None, 1, 1, 0.0), (7, None, None, 0.0)],
                                 "doc_id long, quality int, toxic int, score double")
