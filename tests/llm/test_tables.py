"""Token and window queries over the smallest tables, against the public tokenizer and plain sums."""

import os
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from loomspan.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def encoded(spark):
    return {r["doc_id"]: r["ids"] for r in queries.p8_ids(spark, SF).collect()}


def test_p8_ids(encoded):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert len(docs) == len(encoded)
    for d in docs:
        assert encoded[d["doc_id"]] == (t.encode(d["text"], add_special_tokens=False).ids if d["text"] else [])


def test_p9_windows(spark, encoded):
    capacity = {r["budget_id"]: r["capacity"] for r in pq.read_table(f"{SF}/token_budgets.parquet").to_pylist()}
    fills, pieces = Counter(), defaultdict(list)
    for r in queries.p9_windows(spark, SF).collect():
        fills[r["budget_id"], r["window_id"]] += r["n_tokens"]
        pieces[r["budget_id"], r["doc_id"]].append((r["piece_no"], r["first_token"], r["n_tokens"]))
    assert set(pieces) == {(b, d) for b in capacity for d in encoded}
    for (b, d), own in pieces.items():
        at = 0
        for k, (no, first, n) in enumerate(sorted(own)):
            assert (no, first) == (k, at) and (n == capacity[b] or k == len(own) - 1)
            at += n
        assert at == len(encoded[d]) and (len(own) == 1 or at > capacity[b])
    assert all(n <= capacity[b] for (b, _), n in fills.items())
    for b, c in capacity.items():
        windows, total = sum(x == b for x, _ in fills), sum(n for (x, _), n in fills.items() if x == b)
        assert windows <= -(-total // c) + 1 + windows // 20
