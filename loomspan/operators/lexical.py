"""Keyword search over text: tokens, postings, BM25, required and excluded terms, phrases.

These searches read all texts: statistics of the whole corpus come back as one
row; scoring then is a narrow pass in which only documents with a term survive.
``index.Index`` answers the same questions from written postings.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import regex
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from loomspan.functions.stem import stem, stems

K1, B = 1.2, 0.75


WORDS = r"[\p{L}\p{M}\p{N}]+"


def tokens(text: Column) -> Column:
    """The words of a text in small letters: letters, marks and digits of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def _count_of(word: str) -> Column:
    return F.size(F.filter("_tokens", lambda x: x == word))


@dataclass(frozen=True)
class Query:
    """terms: any of them scores; must, must_not and phrases decide; boosts weigh terms. Nothing given matches everything."""

    terms: tuple[str, ...] = ()
    must: tuple[str, ...] = ()
    must_not: tuple[str, ...] = ()
    phrases: tuple[tuple[str, ...], ...] = ()
    boosts: dict[str, float] = field(default_factory=dict)

    @property
    def scored(self) -> list[str]:
        return list(dict.fromkeys([*self.terms, *self.must, *(w for p in self.phrases for w in p)]))


def parse(text: str) -> Query:
    """Words, +must, -must_not, "a phrase", word^2, ``AND`` between words, and a ``text:`` prefix that changes nothing."""
    terms, must, must_not, phrases, boosts, both = [], [], [], [], {}, False
    found = re.findall(r'([+-]?)(?:text:)?(?:"([^"]*)"|([^\s"]+))', text)
    for i, (sign, phrase, word) in enumerate(found):
        if word in ("AND", "OR"):
            continue
        boost = re.fullmatch(r"(.+)\^(\d+(?:\.\d+)?)", word)
        words = regex.findall(WORDS, (phrase or (boost[1] if boost else word)).lower())
        if not words:
            continue
        if boost:
            boosts.update(dict.fromkeys(words, float(boost[2])))
        joined = any(0 <= j < len(found) and found[j][2] == "AND" for j in (i - 1, i + 1))
        both = both or joined
        if sign == "-":
            must_not += words
        elif phrase and len(words) > 1:
            phrases.append(tuple(words))
        elif sign == "+" or joined:
            must += words
        else:
            terms += words
    return Query(tuple(terms), tuple(must), tuple(must_not), tuple(phrases), boosts)


def stemmed_query(q: Query) -> Query:
    each = lambda words: tuple(map(stem, words))
    return Query(each(q.terms), each(q.must), each(q.must_not), tuple(map(each, q.phrases)), {stem(w): b for w, b in q.boosts.items()})


def _counted(docs: DataFrame, text: str, words: list[str], stemmed: bool) -> DataFrame:
    """docs with _tokens, _len and the count of each word."""
    t = docs.withColumn("_tokens", F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")))
    t = (t.withColumn("_tokens", stems(F.col("_tokens"))) if stemmed else t).withColumn("_len", F.size("_tokens"))
    return t.withColumns({f"_tf{i}": _count_of(w) for i, w in enumerate(words)})


def _statistics(counted: DataFrame, words: list[str]) -> Row:
    return counted.agg(F.count("*").alias("n"), F.avg("_len").alias("avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(words))]).first()


def _judged(q: Query, words: list[str], stats: Row) -> tuple[Column, Column]:
    """Whether a counted row matches, and its score."""
    at = {w: i for i, w in enumerate(words)}
    has = lambda w: F.col(f"_tf{at[w]}") > 0
    n, avg = stats["n"], stats["avg"] or 1.0
    score = F.lit(0.0)
    for w in q.scored:
        df, tf = stats[f"df{at[w]}"], F.col(f"_tf{at[w]}").cast("double")
        idf = math.log(1 + (n - df + 0.5) / (df + 0.5)) * q.boosts.get(w, 1.0)
        score = score + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.lit(avg)))
    hit = F.lit(True)
    if q.terms and not (q.must or q.phrases):
        hit = F.lit(False)
        for w in q.terms:
            hit = hit | has(w)
    for w in q.must:
        hit = hit & has(w)
    line = F.concat(F.lit(" "), F.array_join("_tokens", " "), F.lit(" "))
    for p in q.phrases:
        hit = hit & line.contains(f" {' '.join(p)} ")
    for w in q.must_not:
        hit = hit & ~F.array_contains("_tokens", w)
    return hit, score


def bm25(docs: DataFrame, text: str, query: Query | str, stemmed: bool = False) -> DataFrame:
    """docs that match, with ``score``; without any words every row matches with score 1. Null texts have no tokens.

    The statistics are those of all rows of docs, so filter afterwards, as an index does.
    stemmed: words match by their English stems, in Arrow batches; the plain form stays in the JVM.
    """
    q = parse(query) if isinstance(query, str) else query
    q = stemmed_query(q) if stemmed else q
    words = q.scored
    if not words and not q.must_not:
        return docs.withColumn("score", F.lit(1.0))
    t = _counted(docs, text, words, stemmed)
    hit, score = _judged(q, words, _statistics(t, words))
    return t.where(hit).withColumn("score", score).select(*docs.columns, "score")


def bm25_each(docs: DataFrame, text: str, queries: dict[int, Query | str], stemmed: bool = False) -> DataFrame:
    """docs that match, with ``case`` and ``score``, for many queries in one pass over the texts; each query must have words."""
    parsed = {k: parse(q) if isinstance(q, str) else q for k, q in queries.items()}
    parsed = {k: stemmed_query(q) for k, q in parsed.items()} if stemmed else parsed
    if not all(q.scored for q in parsed.values()):
        raise ValueError("each of several queries needs words that score")
    words = list(dict.fromkeys(w for q in parsed.values() for w in q.scored))
    t = _counted(docs, text, words, stemmed)
    stats = _statistics(t, words)
    judged = [_judged(q, words, stats) for q in parsed.values()]
    each = F.array(*[F.when(hit, F.struct(F.lit(k).alias("case"), score.alias("score"))) for k, (hit, score) in zip(parsed, judged, strict=True)])
    return t.select(*docs.columns, F.inline(F.filter(each, lambda x: x.isNotNull())))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, positions, length): the inverted index as a table; ``index.Index`` keeps it written."""
    t = docs.select(key, tokens(F.col(text)).alias("t"))
    each = t.select(key, F.size("t").alias("length"), F.posexplode("t").alias("pos", "term"))
    return each.groupBy("term", key, "length").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def top(hits: DataFrame, limit: int, *ties: str) -> DataFrame:
    """The best hits by score, then by the tie columns."""
    return hits.orderBy(F.desc("score"), *ties).limit(limit)
