import random
import re
from collections import Counter

import numpy as np

from narrascope.llm.shingle_join import PrefixTree, Union, chained, chained_few, drop_near_duplicates, may_link, near_duplicate_query, nodes, signature

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))) if words else frozenset()


def plain_components(sets, percent=90):
    """Component numbers by comparing all pairs."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def check(docs, rows):
    sets = [plain_set(r[1]) for r in rows]
    component = plain_components(sets)
    least = {}
    for c, r in zip(component, rows):
        if r[0] is not None:
            least[c] = min(r[0], least.get(c, r[0]))
    want = Counter((r[0], len(s), least.get(c) if s else r[0]) for r, s, c in zip(rows, sets, component))
    assert Counter(tuple(r) for r in near_duplicate_query(docs).collect()) == want


def test_against_all_pairs(docs, table):
    check(docs, table)


def test_near_the_threshold_and_chains(spark):
    r = random.Random(2)
    rows = []
    for f in range(12):
        words = [f"w{f}x{i}" for i in range(r.choice([2, 3, 8, 12, 40, 90, 200]))]
        for c in range(9):
            # Every copy changes the one before, so that ends of a chain are far apart.
            for _ in range(r.choice([0, 1, 1, 2])):
                words = list(words)
                words[r.randrange(len(words))] = f"y{r.randrange(10_000)}"
            rows.append((len(rows), " ".join(words)))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_large_group_in_several_blocks(spark, monkeypatch):
    import narrascope.llm.shingle_join as module

    monkeypatch.setattr(module, "BLOCK", 8)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if j not in (i % 60, (7 * i) % 60) else f"z{i}" for j, w in enumerate(base))) for i in range(90)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def test_linked_sets_share_a_node():
    r = np.random.default_rng(1)
    for size in [1, 2, 5, 9, 10, 11, 19, 20, 37, 100, 333, 1000]:
        for _ in range(30):
            a = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
            keep = a[r.random(len(a)) > r.choice([0, 0.02, 0.05])]
            b = np.unique(np.concatenate((keep, r.integers(0, 2**63, int(r.integers(0, 1 + size // 20)), dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= 90 * (len(a) + len(b) - both):
                assert np.isin(nodes(a, 90), nodes(b, 90)).any()


def test_prefix_tree_finds_what_all_pairs_find():
    r = np.random.default_rng(3)
    base = np.sort(r.integers(0, 2**60, 80, dtype=np.uint64))
    sets = [np.unique(np.concatenate((base[r.random(80) > p], r.integers(0, 2**60, int(80 * p), dtype=np.uint64))))
            for p in r.choice([0.0, 0.02, 0.04, 0.08, 0.3], 120)]
    tree = PrefixTree(sets)
    for q in sets[:60]:
        want = {i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 90 * len(np.union1d(q, s))}
        assert set(tree.linked(q, 90)) == want


def test_one_row_of_each_group_stays(docs, table, no_docs):
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    sets = [plain_set(r[1]) for r in table]
    groups = len({c for c, s in zip(plain_components(sets), sets) if s}) + sum(not s for s in sets)
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == groups and {200, 201, 202} <= set(ids) and 206 not in ids and 3 in ids
    assert drop_near_duplicates(no_docs).count() == 0


def test_stage_takes_five_words_and_four_fifths(spark):
    import corpus_pipeline

    r = random.Random(4)
    rows = []
    for f in range(20):
        words = [f"w{f}x{i}" for i in range(r.choice([3, 50, 54, 57, 150]))]
        for c in range(4):
            changed = list(words)
            for at in r.sample(range(len(words)), min(c, len(words))):
                changed[at] = f"y{c}"
            rows.append((len(rows), " ".join(changed)))

    def sets(n):
        found = [r[1].split() for r in rows]
        return [frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) for w in found]

    component = plain_components(sets(5), 80)
    assert len(set(component)) < len(set(plain_components(sets(3), 90)))
    want = {min(i for i, c in enumerate(component) if c == x) for x in component}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_bitmaps_never_part_linked_sets():
    r = np.random.default_rng(5)
    sets = []
    for size in [1, 2, 5, 30, 64, 130, 500, 3000]:
        base = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
        for share in (0, 0.01, 0.05, 0.1, 0.2, 0.5):
            new = r.integers(0, 2**63, int(r.integers(0, 1 + size // 10)), dtype=np.uint64)
            sets.append(np.unique(np.concatenate((base[r.random(len(base)) >= share], new))))
    sets = [s for s in sets if len(s)]
    sizes, maps = np.array([len(s) for s in sets]), [signature(s) for s in sets]
    for percent in (60, 80, 90):
        near = may_link(sizes, maps, sizes, maps, percent)
        linked = np.array([[100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)) for b in sets] for a in sets])
        assert not (linked & ~near).any() and near.sum() < 1.5 * linked.sum()
        for at in (list(range(0, len(sets), 9)), [0, 1], [len(sets) - 1, len(sets) - 2, 3], [4]):
            part = near[np.ix_(at, at)] & ~np.eye(len(at), dtype=bool)
            names = np.array(at) + 100
            own, _ = chained(part, names, names)
            few = chained_few(sizes[at].tolist(), [maps[i].tobytes() for i in at], names.tolist(), percent)
            assert sorted(zip(*few)) == sorted((c, n) for c, n in zip(own.tolist(), names.tolist()) if c >= 0)


def test_chains_over_near_pairs():
    near = np.array([[True, False, False], [True, True, False], [False, False, False]])
    own, other = chained(near, np.array([7, 5, 1]), np.array([9, 3, 2]))
    assert own.tolist() == [3, 3, -1] and other.tolist() == [3, 3, -1]
    together = Union()
    assert [together.join(1, 2), together.join(3, 2), together.join(1, 3), together.find(3)] == [True, True, False, 1]


def test_links_of_a_drifting_group_grow_with_its_sets(spark, monkeypatch):
    import narrascope.llm.shingle_join as module

    written = {}

    def keep(df, name="table", inner=module.write_table):
        out = inner(df, name)
        if name == "links":
            written[name] = written.get(name, 0) + out[0].count()
        return out

    monkeypatch.setattr(module, "write_table", keep)
    for size in (150, 300):
        words, rows = [f"w{i}" for i in range(80)], []
        r = random.Random(size)
        for i in range(size):
            words = list(words)
            words[r.randrange(80)] = f"y{i}"
            rows.append((i, " ".join(words)))
        written.clear()
        check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)
        assert written["links"] <= 4 * size
