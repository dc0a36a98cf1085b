import hashlib

import pytest
from geoloom.llm import bpe
from geoloom.llm.queries import vocabulary

TEXTS = ["Hello world, it's 2024!", "", "  two  spaces\n\n\ttab ", "naïve Ünïcödé — 漢字 🙂", "a<|endoftext|>b <|endoftext|>", "x" * 3000, "ab" * 500 + " " * 700, "don't we'll I'd they've 'sx", "\r\n \x0b\x0c\x00 end ", "1234567890" * 60]


@pytest.fixture(scope="module")
def path():
    return vocabulary("byte_bpe_50k.json")


def test_same_ids_as_the_library(path):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(path), bpe.ByteBpe(path)
    for text in TEXTS:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text[:30]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_words_take_the_same_merges(path):
    own = bpe.ByteBpe(path)
    word = ("thandationly" * 20).encode()
    assert own._encode_long(word) == own.encode_word(word)


def test_digests_of_odd_rows(spark, path):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, None, None, None), (3, TEXTS[3], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_tokens int")
    out = {(r.doc_id, r.decoded_sha256, r.n_tokens) for r in bpe.encode_digests(df, path).collect()}
    assert (None, hashlib.sha256(b"").hexdigest(), 0) in out
    assert len(out) == len(TEXTS) + 1
    assert {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(TEXTS)} <= {x[:2] for x in out}
    assert bpe.encode_digests(df.limit(0), path).count() == 0
    back = bpe.encode(df.where("doc_id is not null"), path)
    assert all(r.text == r.decoded for r in back.collect())
