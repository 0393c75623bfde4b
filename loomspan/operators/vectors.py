"""A written index of vectors by cells, for searches that look at the cells near a query alone.

The cells are the centres of a k-means over a bounded sample; every vector is
filed under its nearest centre, in a folder of its cell. A search reads the
folders of the cells nearest to its query and is exact within them; reading all cells is
the exact search. Cosine distance is the measure throughout.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators.ranking import capped
from loomspan.session import delete_path, list_names, read_text, write_text

STORED = "doc_id long, embedding array<float>"


def unit(rows: list) -> np.ndarray:
    if not len(rows):
        return np.zeros((0, 1))
    v = np.asarray(rows, dtype=np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def centres(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centres of a k-means on unit vectors; an empty cell takes the vector that lies worst."""
    rng = np.random.default_rng(seed)
    c = sample[rng.permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        near = sample @ c.T
        own = near.argmax(axis=1)
        for k in range(len(c)):
            held = sample[own == k]
            c[k] = held.sum(axis=0) if len(held) else sample[near.max(axis=1).argmin()]
        c = unit(c)
    return c


def probes_for(sample: np.ndarray, c: np.ndarray, recall: float, k: int = 25, questions: int = 200) -> int:
    """The fewest cells to look at that find a share of ``recall`` of the k nearest, as measured within the sample."""
    q = sample[:questions]
    own = (sample @ c.T).argmax(axis=1)
    order = np.argsort(-(q @ c.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(c))[None, :].repeat(len(q), axis=0), axis=1)
    near = np.argsort(-(q @ sample.T), axis=1, kind="stable")[:, : min(k, len(sample))]
    depth = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)]) + 1


def _cells(c: np.ndarray, dims: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.flatnonzero([v is not None and len(v) == dims and None not in v and any(v) for v in b["embedding"].to_pylist()])
            b = b.take(pa.array(ids))
            own = (unit(b["embedding"].to_pylist()) @ c.T).argmax(axis=1) if len(ids) else ids
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["embedding"], pa.array(own, pa.int32())], names=["doc_id", "embedding", "cell"])

    return run


def _probe(queries: list[tuple[int, list[float]]], probed: np.ndarray, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = unit([v for _, v in queries])
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            cells, ids = b["cell"].to_numpy(), b["doc_id"].to_numpy()
            v = unit(b["embedding"].to_pylist())
            for cell in np.unique(cells):
                here, asked = np.flatnonzero(cells == cell), np.flatnonzero((probed == cell).any(axis=1))
                d = np.round(1 - v[here] @ q[asked].T, 12)
                for j, a in enumerate(asked):
                    d0, i0 = best.get(int(a), (np.empty(0), np.empty(0, np.int64)))
                    dist, doc = np.concatenate([d0, d[:, j]]), np.concatenate([i0, ids[here]])
                    keep = np.lexsort((doc, dist))[:k]
                    best[int(a)] = dist[keep], doc[keep]
        out = [(queries[a][0], int(i), float(x)) for a, (ds, js) in best.items() for x, i in zip(ds, js, strict=True)]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "doc_id", "distance"])

    return run


class VectorIndex:
    """cells: how many there are, some thousand vectors each; sample: how many vectors at most the centres are learned from. Vectors that are null, zero or of other dimensions aren't filed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @property
    def manifest(self) -> dict | None:
        text = read_text(self.spark, f"{self.path}/MANIFEST")
        return json.loads(text) if text else None

    def create(self, vectors: DataFrame, cells: int = 16, sample: int = 50_000, model: str | None = None, recall: float = 0.97, seed: int = 7) -> VectorIndex:
        """Learn the centres and file all vectors (doc_id, embedding); model names what made them, recall is what a search is to find of the exact answer. The index before stays in use until this one is whole."""
        filled = vectors.where("embedding is not null and size(embedding) > 0")
        taken = filled.orderBy(F.xxhash64("doc_id", F.lit(seed))).limit(sample).select("embedding").collect()
        rows = [list(r[0]) for r in taken if None not in r[0]]
        dims = len(rows[0]) if rows else 0
        own = unit([r for r in rows if len(r) == dims])
        c = centres(own, min(cells, len(own))) if rows else np.zeros((1, 1))
        return self._file(vectors, {"dims": dims, "model": model, "centres": c.tolist(), "probes": probes_for(own, c, recall) if rows else 1, "segments": []})

    def add(self, vectors: DataFrame) -> VectorIndex:
        """File more vectors under the centres there are; ids that are there already aren't filed again."""
        m = self.manifest
        new = vectors.dropDuplicates(["doc_id"]).join(self.stored().select("doc_id"), "doc_id", "left_anti")
        return self._file(new, m)

    def retain(self, ids: DataFrame) -> VectorIndex:
        """Write the index anew with the vectors of some ids alone."""
        m = self.manifest
        return self._file(self.stored().join(ids.select("doc_id").distinct(), "doc_id", "left_semi"), m | {"segments": []})

    def _file(self, vectors: DataFrame, m: dict) -> VectorIndex:
        name = f"seg-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        c = np.asarray(m["centres"])
        rows = vectors.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(_cells(c, m["dims"]), f"{STORED}, cell int")
        rows.repartition("cell").write.partitionBy("cell").parquet(f"{self.path}/{name}")
        cells = [int(x.split("=")[1]) for x in list_names(self.spark, f"{self.path}/{name}") if x.startswith("cell=")]
        old = {s["name"] for s in (self.manifest or {"segments": []})["segments"]}
        m["segments"] = [*m["segments"], {"name": name, "cells": cells}]
        write_text(self.spark, f"{self.path}/MANIFEST", json.dumps(m))
        for gone in old - {s["name"] for s in m["segments"]}:
            delete_path(self.spark, f"{self.path}/{gone}")
        return self

    def stored(self, cells: Iterable[int] | None = None) -> DataFrame:
        """(doc_id, embedding, cell) of some cells, or of all."""
        wanted = None if cells is None else {int(x) for x in cells}
        parts = []
        for s in self.manifest["segments"]:
            paths = [f"{self.path}/{s['name']}/cell={k}" for k in s["cells"] if wanted is None or k in wanted]
            if paths:
                parts.append(self.spark.read.schema(f"{STORED}, cell int").option("basePath", f"{self.path}/{s['name']}").parquet(*paths))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{STORED}, cell int")

    def nearest_each(self, queries: DataFrame, k: int, probes: int | None = None, inside: DataFrame | None = None, block: int = 1000) -> DataFrame:
        """(query_id, doc_id, distance, score): the k nearest of each query (doc_id, embedding) in the ``probes`` cells nearest to it; by default as many as the recall takes that was asked for.

        inside: (doc_id) that may be found; the filter comes before the limit.
        With as many probes as cells the answer is that of ``ranking.nearest_each``.
        """
        m = self.manifest
        c, parts, own, probes = np.asarray(m["centres"]), [], [], probes or m["probes"]

        def flush() -> None:
            probed = np.argsort(-(unit([v for _, v in own]) @ c.T), axis=1, kind="stable")[:, :probes] if own else np.zeros((0, 1))
            rows = self.stored(np.unique(probed))
            rows = rows if inside is None else rows.join(inside.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "embedding", "cell")
            parts.append(rows.mapInArrow(_probe(list(own), probed, k), "query_id long, doc_id long, distance double"))
            own.clear()

        for r in queries.where("embedding is not null").select("doc_id", "embedding").toLocalIterator():
            if None not in r["embedding"] and len(r["embedding"]) == m["dims"] and any(r["embedding"]):
                own.append((r["doc_id"], list(r["embedding"])))
            if len(own) == block:
                flush()
        if own or not parts:
            flush()
        return capped(reduce(DataFrame.unionByName, parts), ["query_id"], k, "distance", "doc_id").withColumn("score", 1 / (1 + F.col("distance")))
