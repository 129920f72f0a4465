import itertools
import random

import numpy as np

from narrascope.operators import models as M
from narrascope.operators import segments as G

WORDS = {"de": "ung der sch ein ich ver keit über nicht auch".split(), "en": "the that with have this from they which would there".split(),
         "fr": "les des une est pour dans que vous avec tout".split()}


def test_paths_are_the_best_of_all():
    r = np.random.default_rng(0)
    for _ in range(40):
        scores, cost = r.normal(size=(6, 3)) * 3, float(r.choice([0, 0.5, 2, 50]))
        value = lambda p: sum(scores[i, c] for i, c in enumerate(p)) - cost * sum(a != b for a, b in zip(p, p[1:]))
        best = max(value(p) for p in itertools.product(range(3), repeat=6))
        assert abs(value(G.likeliest_path(scores, cost)) - best) < 1e-9


def sentence(r, lang, n):
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


def test_mixed_posts_give_both_languages(spark):
    r = random.Random(1)
    profile = M.fit_language_profile(spark.createDataFrame([(lang, sentence(r, lang, 60)) for lang in WORDS for _ in range(5)], "lang string, text string"))
    rows = [(i, f"{sentence(r, a, 12)} {sentence(r, b, 15)}", a, b) for i, (a, b) in enumerate(itertools.product(WORDS, WORDS))]
    rows += [(20, "the", "en", "en"), (21, "", None, None), (22, None, None, None), (23, "zzz qqq", None, None),
             (24, sentence(r, "en", 20) + " keit " + sentence(r, "en", 20), "en", "en")]
    table = spark.createDataFrame(rows, "id long, text string, a string, b string")
    segments = G.language_segments(table, profile, "id")
    found = {x.id: [tuple(s) for s in x.segments] for x in segments.collect()}
    assert set(found) == set(range(9)) | {20, 23, 24}
    for i, _, a, b in rows[:9]:
        assert [s[0] for s in found[i]] == ([a] if a == b else [a, b])
        assert found[i][0][1] == 0 and found[i][-1][2] == 26 and (a == b or abs(found[i][0][2] - 11) <= 1)
    assert found[20] == [("en", 0, 0)] and found[24] == [("en", 0, 40)]
    within = {x.id: (x.languages, x.language) for x in G.languages_within(segments, "id").collect()}
    assert within[1] == (["de", "en"], "en") and within[0] == (["de"], "de") and within[20] == ([], "en")


def test_paths_found_together_are_those_of_each_table():
    def plain(scores, cost):
        total, came = scores[0].copy(), []
        for row in scores[1:]:
            top = int(total.argmax())
            came.append([top if total[top] - cost > t else k for k, t in enumerate(total)])
            total = np.array([max(t, total[top] - cost) for t in total]) + row
        path = [int(total.argmax())]
        for back in reversed(came):
            path.append(back[path[-1]])
        return path[::-1]

    rng = np.random.default_rng(4)
    tables = [rng.integers(-9, 9, (n, 3)).astype(float) for n in (5, 1, 40, 40, 2, 17, 1)]
    for some in (tables, tables[:1], tables[1:2], tables[2:4]):
        assert [p.tolist() for p in G.likeliest_paths(some, 6.0)] == [plain(t, 6.0) for t in some]
