import re
from collections import Counter

import pytest
from .test_shingle_join import plain_components, plain_set

import corpus_pipeline
from narrascope.llm.bpe_transducer import codec_of, read_file
from narrascope.llm.source_mix import mix_sources


@pytest.fixture(scope="module")
def folder(docs, labels, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_and_their_operators():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "mixing", "tokens"]


def test_each_stage_on_its_own_input(spark, docs, table, folder):
    stages = dict(corpus_pipeline.STAGES)
    first = stages["toxicity"](spark, docs, folder)
    assert first.columns == docs.columns
    ids = Counter(r.doc_id for r in first.collect())
    assert not {i for i in range(0, 120, 10)} & set(ids) and ids[5] == 3 and ids[200] == 1
    assert len(set(range(120)) - set(ids)) == 12

    known = stages["language"](spark, docs, folder)
    assert known.columns == docs.columns
    kept = Counter(r.doc_id for r in known.collect())
    assert set(range(120)) <= set(kept) and not {200, 201, 202, 203} & set(kept) and kept[5] == 3

    one = stages["near_duplicates"](spark, docs, folder)
    sets = [plain_set(r[1]) for r in table]
    assert one.count() == len({c for c, s in zip(plain_components(sets), sets) if s}) + sum(not s for s in sets)

    mixed = stages["mixing"](spark, one, folder)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in mix_sources(one).collect():
        want[r.doc_id] += -(-r.taken // r.size) if r.size else 0
    assert Counter(r.doc_id for r in mixed.collect()) == +want

    codec = codec_of(read_file())
    texts = {r[0]: r[1] for r in table}
    for r in stages["tokens"](spark, one, folder).collect():
        assert r.n_tokens == len(codec.encode(texts[r.doc_id]))


def test_whole_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in rows}
    assert rows and not ids & {0, 10, 20, 200, 201, 202, 203, 206}
    assert all(re.fullmatch("[0-9a-f]{64}", r.ids_sha256) for r in rows)


def test_empty_tables(spark, no_docs, labels, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
