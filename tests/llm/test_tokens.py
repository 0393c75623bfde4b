import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomspan.llm.tokens import BytePairs, Encoder, PrefixEncoder, encoded, token_counts

TEXTS = [None, "", " ", "Hello world", "<|endoftext|> is text", " " * 5000, "a" * 3000, "ab" * 2000, "索引の更新は 7676 ミリ秒", "🙂👩‍💻 é é", "\r\n\t\x00", "don't DON'T 12345678901234567890", "it's\n\n  x" * 3000]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def mine():
    return Encoder()


def test_texts(spark, reference):
    df = spark.createDataFrame([(i, t, "en", [1]) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, ids array<int>")
    got = {r["doc_id"]: list(r["ids"]) for r in encoded(df).collect()}
    assert got == {i: reference(t or "") for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(df).collect()} == {i: len(x) for i, x in got.items()}
    assert encoded(df.limit(0)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    e, t = test_any_text.pair
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert e.encode(text) == t(text)


@pytest.fixture(autouse=True)
def _pair(mine, reference):
    test_any_text.pair = (mine, reference)


def test_appends_and_edits():
    pairs, r = BytePairs(), random.Random(2)
    whole = lambda b: PrefixEncoder(pairs, b).ids()
    e = PrefixEncoder(pairs)
    for _ in range(40):
        e.append(bytes(r.choice(b"abcdeth ing") for _ in range(r.randint(0, 4))))
        assert e.ids() == whole(e.text)
    for k in range(len(e.text)):
        assert e.ids(k) == whole(e.text[:k])
    for _ in range(20):
        a = r.randint(0, len(e.text))
        e.replace(a, min(len(e.text), a + r.randint(0, 5)), b"then")
        assert e.ids() == whole(e.text) and b"".join(pairs.bytes[i] for i in e.ids()) == e.text
