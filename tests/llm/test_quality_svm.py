import math
from collections import Counter

import numpy as np

import narrascope.llm.quality_svm as module
from narrascope.llm.quality_svm import coordinate_descent, fit_model, fit_quality, indicators, quality_query, score_quality


def test_coordinate_descent_reaches_the_optimum():
    r = np.random.default_rng(2)
    rows = [np.flatnonzero(r.random(30) < 0.4) for _ in range(80)]
    signs = np.where([(3 in x) ^ (r.random() < 0.1) for x in rows], 1.0, -1.0)
    scale, penalty = r.normal(1, 0.3, 30), 0.5
    weights, bias = coordinate_descent(rows, scale, signs, penalty, 2000)
    dense = np.zeros((80, 31))
    for i, x in enumerate(rows):
        dense[i, x], dense[i, 30] = scale[x] / max(1.0, len(x)) ** 0.5, 1.0

    def loss(w):
        return 0.5 * w @ w + penalty * np.maximum(0, 1 - signs * (dense @ w)).sum()

    best = np.append(weights, bias)
    steps = [best + r.normal(0, s, 31) for s in (0.001, 0.01, 0.1) for _ in range(200)]
    assert min(map(loss, steps)) >= loss(best) - 1e-3


def test_repeats_and_shapes_are_seen():
    plain, repeated = indicators("One two three four five."), indicators("One One One One One.")
    assert len(np.setdiff1d(repeated, plain)) and not len(indicators(None)) and not len(indicators(" \n"))
    assert set(indicators("aB c! " * 30_000)) == set(indicators("aB c! " * 3 + "aB c! "))


def test_model_on_one_class_and_none():
    assert fit_model([np.array([1])], np.array([1]), {1: 1.0}).score("text")[0] > 0.9
    assert abs(fit_model([], np.empty(0), {}).score(None)[0] - 0.5) < 1e-6


def test_noisy_texts_score_low(spark):
    rows = [(i, "The cat sat on the mat and looked at the moon. " * (1 + i % 3) if i % 2 else "BUY!! NOW!! $$$ " * (2 + i % 4)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    found = {r.doc_id: r.quality.score for r in score_quality(docs, fit_quality(docs, labels)).collect()}
    assert all((found[i] >= 0.5) == bool(i % 2) for i in range(200, 300))


def test_odd_rows(docs, labels, no_docs, table):
    rows = quality_query(docs, labels).collect()
    assert len(rows) == len(table) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (200, 201, 202)}) == 1
    assert quality_query(no_docs, labels).count() == 0 and quality_query(docs, labels.limit(0)).count() == len(table)


def test_ratios_and_calibration_against_loops():
    r = np.random.default_rng(2)
    size = 1 << module.BITS
    labels = r.integers(0, 2, 150)
    slots = [np.unique(r.choice(60, int(r.integers(1, 20))) * 17 + 400 * int(r.random() < 0.3 + 0.4 * y)) % size for y in labels]
    share = {0: 0.8, 1: 0.2}
    model = module.fit_model(slots, labels, share)

    train = [i for i in range(150) if i % 5 != 4]
    held = [i for i in range(150) if i % 5 == 4]
    count = {1: Counter(), 0: Counter()}
    for i in train:
        count[int(labels[i])].update(slots[i].tolist())
    total = {y: size + sum(count[y].values()) for y in count}
    ratio = np.array([math.log((1 + count[1][s]) / total[1]) - math.log((1 + count[0][s]) / total[0]) for s in range(size)])
    raw, bias = module.coordinate_descent([slots[i] for i in train], ratio, np.where(labels[train] == 1, 1.0, -1.0), 1.0, 30)
    assert np.allclose(model.weights, raw * ratio, atol=1e-5) and abs(model.bias - bias) < 1e-9

    # The calibration is where the slopes of the weighted loss, with smoothed targets and a light pull to 1 and 0, vanish.
    own = {y: sum(int(labels[i]) == y for i in held) for y in (0, 1)}
    goal = {1: (own[1] + 1) / (own[1] + 2), 0: 1 / (own[0] + 2)}
    by_slope, by_intercept = 1e-3 * (model.slope - 1), 1e-3 * model.intercept
    for i in held:
        y = int(labels[i])
        value = sum(float(model.weights[s]) for s in slots[i]) / math.sqrt(len(slots[i])) + model.bias
        error = share[y] / own[y] * len(held) * (1 / (1 + math.exp(-model.slope * value - model.intercept)) - goal[y])
        by_slope, by_intercept = by_slope + error * value, by_intercept + error
    assert model.slope > 0.05 and abs(by_slope) < 1e-3 and abs(by_intercept) < 1e-3
