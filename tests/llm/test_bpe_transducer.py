import hashlib
import random

import pytest

from narrascope.llm.bpe_transducer import Decoder, Encoder, bpe_query, codec_of, decode_ids, encode_texts, read_file

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def codec():
    return codec_of(read_file())


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_str(read_file())


TEXTS = ["Hello  wörld's <|endoftext|>thing 12 İx Ω ＡΣ ΣΑΣ. é é I'LL \x1c x\x85y 中文字 \U0001F600!!",
         "<|startoftext|><|ENDOFTEXT|>", "", " ", "a" * 3000, "ab" * 2000, "$$$###" * 99, "\x00\x7f", "ǅ ﬁ ß ẞ ŉ", "x</w> y"]


def test_same_ids_and_text_as_the_library(codec, library):
    r = random.Random(4)
    alphabets = ["etaoinshrdlu", "ab", "éèüñß中文🙂 '!<>/w", "̧́ aΣ  ​ "]
    made = ["".join(r.choice(r.choice(alphabets)) for _ in range(r.choice([1, 4, 30, 200]))) for _ in range(500)]
    for text in TEXTS + made:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids
        assert codec.decode(ids, joined=True) == library.decode(ids, skip_special_tokens=False)


def test_memory_stays_within_the_lookahead(codec):
    r = random.Random(1)
    encoder, symbols = Encoder(codec.merges), [r.choice("etaoinshr") for _ in range(30_000)]
    tokens = [t for s in symbols for t in encoder.feed(s)]
    assert 0 < encoder.peak <= codec.merges.lookahead and sum(map(len, tokens)) > 29_000
    assert "".join(tokens + encoder.finish()) == "".join(symbols)


def test_decoder_keeps_unfinished_characters(codec):
    text = "naïve 中文 \U0001F600 end"
    ids = codec.encode(text)
    decoder = Decoder(codec)
    pieces = [decoder.feed([i]) for i in ids]
    assert "".join(pieces) + decoder.finish() == codec.decode(ids)
    # Words come back with a space behind each.
    assert codec.decode(ids).replace(" ", "") == text.replace(" ", "")
    assert codec.decode(ids[:-3] + [codec.encode("中")[0]]).endswith("�")


def test_digests_of_batches_are_those_of_the_whole(spark, library):
    texts = [*TEXTS, "one two " * 3000, "it's," * 9000, "it's two " * 5000 + "x,y" * 20_000 + " it's", "\u4e2d" * 5000]
    for row, text in zip(sorted(bpe_query(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()), texts, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_columns(spark, docs, table, no_docs, codec):
    found = encode_texts(docs)
    assert found.columns == [*docs.columns, "tokens"]
    back = decode_ids(found.select("doc_id", "text", "tokens.ids"), "ids", joined=True)
    for r in back.where("doc_id < 20 or doc_id > 199").collect():
        assert r.ids == codec.encode(r.text) and r.decoded.text == codec.decode(r.ids, joined=True)
    rows = bpe_query(docs).collect()
    assert len(rows) == len(table)
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows if r.doc_id in (200, 201, 202)} == {(0, empty, empty)}
    assert bpe_query(no_docs).count() == 0
