import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators.hierarchy import _double, descendants, hierarchy

SCHEMA = "node string, parent string, place long, loc long, w long"


def brute(parents):
    out = {}
    for n in parents:
        seen, c = [n], n
        while parents.get(c) in parents and parents[c] not in seen:
            c = parents[c]
            seen.append(c)
        if parents[c] is None or parents[c] not in parents:
            out[n] = (c, len(seen) - 1, "/" + "/".join(reversed(seen)))
        else:
            out[n] = (min(seen[seen.index(parents[c]) :]), -1, None)
    return out


def forest(r, n):
    names = [f"n{i:03d}" for i in range(n)]
    r.shuffle(names)
    kind = {}
    for i, x in enumerate(names):
        p = r.random()
        kind[x] = None if p < 0.04 else "missing" if p < 0.07 else x if p < 0.08 else r.choice(names) if p < 0.14 else names[max(0, i - r.randint(1, 3))] if i else None
    return kind


@pytest.mark.parametrize("rows", [1000, 25, 6])
def test_against_brute_force(spark, rows):
    parents = forest(random.Random(rows), 150)
    df = spark.createDataFrame([(k, v, i, i, i) for i, (k, v) in enumerate(parents.items())], SCHEMA)
    got = {r["node"]: (r["root"], r["depth"], r["path"]) for r in hierarchy(df, "node", "parent", F.lit("f"), F.col("place") * 900, paths=True, partition_rows=rows).collect()}
    assert got == brute(parents)


def test_long_chain_over_partitions(spark):
    parents = {f"n{i:04d}": f"n{i - 1:04d}" if i else None for i in range(400)}
    df = spark.createDataFrame([(k, v, i, i, i) for i, (k, v) in enumerate(parents.items())], SCHEMA)
    got = {r["node"]: r["depth"] for r in hierarchy(df, "node", "parent", F.lit("f"), F.col("place") * 400, partition_rows=50).collect()}
    assert got == {k: int(k[1:]) for k in parents}


def test_hot_group_without_positions(spark):
    """All nodes share one locality and position, far more than a partition is meant to hold."""
    parents = forest(random.Random(11), 120)
    df = spark.createDataFrame([(k, v, i, i, i) for i, (k, v) in enumerate(parents.items())], SCHEMA)
    got = {r["node"]: (r["root"], r["depth"], r["path"]) for r in hierarchy(df, "node", "parent", F.lit("f"), paths=True, partition_rows=20).collect()}
    assert got == brute(parents)


def test_doubling_alone(spark):
    parents = forest(random.Random(3), 80)
    parents = {k: v if v in parents else None for k, v in parents.items()}
    q = spark.createDataFrame([(k, v, 1 if v else 0, k, k, 0, f"/{k}") for k, v in parents.items()], "node string, parent string, w long, low string, root string, rdepth long, seg string")
    got = {r["node"]: (r["cyc"] or r["root"], r["depth"], r["path"]) for r in _double(q).collect()}
    assert got == brute(parents)


def test_edges_and_nulls(spark):
    assert hierarchy(spark.createDataFrame([], SCHEMA), "node", "parent").collect() == []
    df = spark.createDataFrame([("a", None, 1, 1, 1), ("a", "b", 1, 1, 1), ("b", None, 1, 1, 1), (None, "a", 1, 1, 1), ("c", "c", 1, 1, 1), ("", "b", 1, 1, 1)], SCHEMA)
    got = {r["node"]: (r["root"], r["depth"]) for r in hierarchy(df, "node", "parent").collect()}
    assert got == {"a": ("b", 1), "b": ("b", 0), "c": ("c", -1), "": ("b", 1)}


def test_descendants(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a")], "node string, parent string")
    got = {(r[0], r[1], r[2]) for r in descendants(hierarchy(df, "node", "parent", paths=True)).collect()}
    assert got == {("a", "b", 1), ("b", "c", 1), ("a", "c", 2), ("a", "d", 1)}


def test_ids_with_slashes(spark):
    df = spark.createDataFrame([("a/b", None), ("~1", "a/b"), ("c", "~1")], "node string, parent string")
    got = hierarchy(df, "node", "parent", paths=True)
    assert {r["node"]: r["path"] for r in got.collect()} == {"a/b": "/a~1b", "~1": "/a~1b/~01", "c": "/a~1b/~01/c"}
    assert {tuple(r) for r in descendants(got).collect()} == {("a/b", "~1", 1), ("a/b", "c", 2), ("~1", "c", 1)}
