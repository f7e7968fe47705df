"""The transducer against the plain merges and a public implementation; decoding of any bytes."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave.llm.tokens import DEFAULT_DIRECTORY, Encoder, Utf8Stream, decode, decode_column, encode_documents, encoder

JSON, RANKS = f"{DEFAULT_DIRECTORY}/byte_bpe_50k.json", f"{DEFAULT_DIRECTORY}/byte_bpe_50k.tiktoken"
HARD = ["", " ", "\n\n  x", "don't we'll I'M", "a" * 3000, "і" * 700 + "́x", "<|endoftext|>", "\x1c\x1d \x85 ​", "中文字😀👩‍👩‍👧", "1234567890" * 40, "xyzzy" * 500, "᠎ 　q"]


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [JSON, RANKS])
def test_hard_texts(public, path):
    e = Encoder(path)
    for text in HARD:
        assert e.encode(text) == public(text)
        assert "".join(decode(path, e.encode(text))) == text
    assert e.encode(None) == []


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_random_texts(public, text):
    text = text.encode("utf-8", "ignore").decode()
    assert encoder(JSON).encode(text) == public(text)


def test_transducer_is_the_merge_algorithm():
    e = encoder(JSON)
    random.seed(2)
    for _ in range(400):
        piece = bytes(random.choice(b"abcdeinorst \xd0\xd1\xb0\xb5\xb8") for _ in range(random.randrange(1, 40)))
        assert list(e.transducer.feed(piece)) == e.transducer.v.merge(piece)


def test_forgetting_states_changes_nothing(monkeypatch):
    import kinweave.llm.tokens as tokens

    monkeypatch.setattr(tokens, "STATES", 5)
    monkeypatch.setattr(tokens, "WORDS", 3)
    few = Encoder(JSON)
    for text in ("the quick brown fox, the slow green turtle " * 3, *HARD):
        assert few.encode(text) == encoder(JSON).encode(text)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40))
def test_utf8_stream(data):
    for cut in (1, 3):
        s = Utf8Stream()
        out = "".join(s.feed(data[k : k + cut]) for k in range(0, len(data), cut)) + s.end()
        assert out == data.decode("utf-8", "replace")


def test_documents(spark):
    docs = spark.createDataFrame([(1, "Hello", "x"), (2, None, "y"), (3, "", None), (1, "Hello", "x")], "doc_id long, text string, ids string")
    out = encode_documents(docs, JSON)
    rows = out.collect()
    assert [list(r.ids) for r in rows if r.doc_id != 1] == [[], []] and len(rows) == 4
    assert {r[0] for r in out.select(decode_column(F.col("ids"), JSON)).collect()} == {"Hello", ""}
    assert encode_documents(docs.limit(0), JSON).count() == 0
