"""Encoding with a public byte-level BPE, by dynamic programming over prefixes.

Each prefix of a piece has exactly one token that can stand last in its encoding:
the one before which the rest of the prefix ends in a token it doesn't merge with.
Storing it for every prefix gives the encoding by walking back, lets text be
appended without touching what is stored, and limits an edit's cost to what comes
after the edited piece.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class BytePairs:
    """The vocabulary: bytes -> id, in the order in which pairs merge, and which neighbours a merge would not join."""

    def __init__(self, path: str = TOKENIZER):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = {v: k for k, v in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}

    def merged(self, text: bytes, below: int) -> list[int]:
        """The encoding of text by merges of ids under ``below`` alone, lowest first."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = min((self.ids.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes token; None for single bytes."""
        if token not in self._halves:
            text = self.bytes[token]
            two = self.merged(text, token) if len(text) > 1 else []
            self._halves[token] = (two[0], two[1]) if len(two) == 2 else None
        return self._halves[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging would leave left and right side by side: no merge across their border comes before those that make them."""
        key = (left, right)
        if key not in self._fits:
            self._fits[key] = self._holds(left, right)
        return self._fits[key]

    def _holds(self, left: int, right: int) -> bool:
        # Undo the later of the merges that made the two neighbours of the border, again and again. Whenever both stood there, a
        # merge of them must not have come before the one that was just undone; on the left, merges of equal rank come first.
        until = len(self.ids) + 1
        while True:
            joined = self.ids.get(self.bytes[left] + self.bytes[right])
            if joined is not None and joined < until:
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                until, left = left, a[1]
            else:
                until, right = right + 1, b[0]


class PrefixEncoder:
    """One piece of text that can grow: ``last[i]`` is the last token of the encoding of its first i bytes."""

    def __init__(self, pairs: BytePairs, text: bytes = b""):
        self.pairs, self.text, self.last = pairs, b"", [-1]
        self.append(text)

    def append(self, more: bytes) -> None:
        """Grow the piece; what is stored for its prefixes stays as it is."""
        self.text += more
        ids, fits, last, text = self.pairs.ids, self.pairs.fits, self.last, self.text
        for end in range(len(last), len(text) + 1):
            for start in range(max(0, end - self.pairs.longest), end):
                token = ids.get(text[start:end])
                if token is not None and (start == 0 or fits(last[start], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte of the text")

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Edit the piece: prefixes up to start keep what is stored for them, the rest is encoded again."""
        rest = self.text[end:]
        self.text, self.last = self.text[:start], self.last[: start + 1]
        self.append(new + rest)

    def ids(self, upto: int | None = None) -> list[int]:
        """The encoding of the piece, or of its first ``upto`` bytes."""
        out, at = [], len(self.text) if upto is None else upto
        while at:
            out.append(self.last[at])
            at -= len(self.pairs.bytes[self.last[at]])
        return out[::-1]


class Encoder:
    """Whole texts: pieces by the public split pattern, each encoded once while it is remembered."""

    def __init__(self, path: str = TOKENIZER, remembered: int = 200_000):
        import public_tokenizers

        self.pairs, self.split, self.remembered = BytePairs(path), regex.compile(public_tokenizers.PATTERN), remembered
        self.known: dict[str, list[int]] = {}

    def piece(self, text: str) -> list[int]:
        got = self.known.get(text)
        if got is None:
            raw = text.encode("utf-8", "replace")
            whole = self.pairs.ids.get(raw)
            got = [whole] if whole is not None else PrefixEncoder(self.pairs, raw).ids()
            if len(self.known) >= self.remembered:
                self.known.clear()
            if len(raw) <= 200:
                self.known[text] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for m in self.split.finditer(text or ""):
            out += self.piece(m.group())
        return out


@lru_cache(maxsize=4)
def encoder(path: str = TOKENIZER) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(path)


def _encode(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            for part in range(0, b.num_rows, 500):
                p = b.slice(part, 500)
                ids = pa.array([e.encode(t) for t in p["text"].to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([p["doc_id"], ids], names=["doc_id", "ids"])

    return run


def encoded(documents: DataFrame, path: str = TOKENIZER, text: Column | None = None) -> DataFrame:
    """(doc_id, ids) of every document, without special tokens; empty and null texts give an empty list.

    Strings that look like special tokens are ordinary text. Repeated rows stay
    repeated, an empty table gives an empty result, other columns don't matter.
    """
    text = F.col("text") if text is None else text
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).mapInArrow(_encode(path), "doc_id long, ids array<int>")


def _count(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            counts = [sum(len(e.piece(m.group())) for m in e.split.finditer(t or "")) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return run


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every document; null and empty texts have 0."""
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_count(path), "doc_id long, n_tokens long")
