"""Fusion, recency, caps and vector similarity over ranked hits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
DAY_MS = 86_400_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; null where one is null, has another length or no length at all."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def nearest(vectors: DataFrame, query: list[float], k: int, tie: str = "doc_id") -> DataFrame:
    """The k nearest vectors by cosine distance, with distance and semantic score 1 / (1 + distance)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = F.lit(1.0) - cosine(F.col("embedding"), q)
    return vectors.withColumn("distance", d).where("distance is not null").withColumn("score", 1 / (1 + F.col("distance"))).orderBy("distance", tie).limit(k)


def _best_of_block(block: list[tuple[int, list[float]]], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = {}
        for size in {len(v) for _, v in block}:
            own = [(i, v) for i, v in block if len(v) == size]
            q = np.array([v for _, v in own], dtype=float)
            sides[size] = ([i for i, _ in own], q, np.sqrt((q * q).sum(axis=1)))
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for part in range(0, b.num_rows, 1000):
                p = b.slice(part, 1000)
                rows = [(i, v) for i, v in zip(p["doc_id"].to_pylist(), p["embedding"].to_pylist(), strict=True) if v and None not in v]
                for size in {len(v) for _, v in rows} & set(sides):
                    ids, v = np.array([i for i, x in rows if len(x) == size]), np.array([x for _, x in rows if len(x) == size], dtype=float)
                    _, q, norms = sides[size]
                    n = np.sqrt((v * v).sum(axis=1))
                    ids, v, n = ids[n > 0], v[n > 0], n[n > 0]
                    for at in range(len(q)):
                        if norms[at] > 0:
                            d = np.round(1 - (v * q[at]).sum(axis=1) / (n * norms[at]), 12)
                            d0, i0 = best.get((size, at), (np.empty(0), np.empty(0, dtype=np.int64)))
                            d, i = np.concatenate([d0, d]), np.concatenate([i0, ids])
                            keep = np.lexsort((i, d))[:k]
                            best[size, at] = d[keep], i[keep]
        out = [(sides[size][0][at], int(i), float(d)) for (size, at), (ds, js) in best.items() for d, i in zip(ds, js, strict=True)]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "doc_id", "distance"])

    return run


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1000) -> DataFrame:
    """(query_id, doc_id, distance, score): ``nearest`` for every row of queries (doc_id, embedding).

    A block of queries goes to the workers at a time, each partition keeps its best
    k for each, and those are merged. Distances that agree in 12 digits are ties.
    """
    parts, own = [], []

    def flush() -> None:
        parts.append(vectors.select(F.col("doc_id").cast("bigint").alias("doc_id"), "embedding").mapInArrow(_best_of_block(list(own), k), "query_id long, doc_id long, distance double"))
        own.clear()

    for r in queries.where("embedding is not null").select("doc_id", "embedding").toLocalIterator():
        if None not in r["embedding"]:
            own.append((r["doc_id"], list(r["embedding"])))
        if len(own) == block:
            flush()
    if own or not parts:
        flush()
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.unionByName(x)
    return capped(whole, ["query_id"], k, "distance", "doc_id").withColumn("score", 1 / (1 + F.col("distance")))


def ranked(hits: DataFrame, *order: Column | str, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    return hits.withColumn(name, F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)))


def rrf(views: list[DataFrame], keys: list[str], rank: str = "rank") -> DataFrame:
    """(keys, score): the sum of 1 / (60 + rank) over all views; repeats within a view add up too."""
    parts = [v.select(*keys, (F.lit(1.0) / (RRF_K + F.col(rank))).alias("part")) for v in views]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*keys).agg(F.sum("part").alias("score"))


def candidates(limit: int) -> int:
    """How many hits each side of a hybrid search brings."""
    return max(50, min(500, 5 * limit))


def with_recency(hits: DataFrame, now_ms: int, weight: float = 1.0, half_life_days: float = 30.0) -> DataFrame:
    """score * (1 + weight * 2^(-age / half life)); unchanged where score, weight, half life or ts is not positive. Future times have age 0."""
    if weight <= 0 or half_life_days <= 0:
        return hits
    age = F.greatest(F.lit(0), F.lit(now_ms) - F.col("ts")) / DAY_MS
    boosted = F.col("score") * (1 + weight * F.exp(-F.log(F.lit(2.0)) * age / half_life_days))
    return hits.withColumn("score", F.when((F.col("score") > 0) & (F.col("ts") > 0), boosted).otherwise(F.col("score")))


def capped(hits: DataFrame, by: list[str], most: int, *order: Column | str) -> DataFrame:
    """The first ``most`` hits of each group in the given order."""
    return ranked(hits, *order, by=by, name="_n").where(F.col("_n") <= most).drop("_n")


def rrf_cases(hits: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """``rrf`` of the views that the column ``case`` tells apart, of each its best ``depth`` hits."""
    own = ranked(hits, F.desc("score"), *keys, by=["case"]).where(F.col("rank") <= depth)
    return own.groupBy(*keys).agg(F.sum(F.lit(1.0) / (RRF_K + F.col("rank"))).alias("score"))


def federated(lists: DataFrame, machines: int) -> DataFrame:
    """Ranked lists of several machines in one; with more than one machine each score becomes 1 / (60 + rank in its machine)."""
    if machines < 2:
        return lists
    own = ranked(lists, F.desc("score"), F.desc("ts"), "doc_id", by=["machine"])
    return own.withColumn("score", F.lit(1.0) / (RRF_K + F.col("rank"))).drop("rank")


def session_groups(hits: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each session of a hit list: hit_count, last_ts, the best score with its document, and its kind, preferring main."""
    best = F.max(F.struct("score", "ts", "doc_id"))
    kind = F.when(F.bool_or(F.coalesce(F.col("conversation_kind") == "main", F.lit(False))), "main").otherwise(F.min_by("conversation_kind", F.when(F.col("conversation_kind").isNotNull(), F.col("doc_id"))))
    return hits.groupBy(*keys).agg(F.count("*").alias("hit_count"), F.max("ts").alias("last_ts"), best.alias("b"), kind.alias("kind")).select(*keys, "hit_count", "last_ts", F.col("b.score").alias("score"), F.col("b.doc_id").alias("doc_id"), "kind")
