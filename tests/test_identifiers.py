import random
from collections import defaultdict

from pyspark.sql import functions as F

from loomspan.operators.identifiers import IdentifierIndex, components, kept_rows, redundant_rows
from loomspan.session import Scratch
from tests.conftest import item, omp_row


def brute(rows):
    """The rows to drop, by union-find; rows are (rec_id, id, message id, call ids, output)."""
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for rec, id_, mid, calls, _ in rows:
        find(("row", rec))
        keys = [("r", id_)] * (id_ is not None) + [("m", mid)] * bool(mid and mid.strip()) + [("c", c) for c in calls if c and c.strip()]
        for k in keys:
            up[find(k)] = find(("row", rec))
    groups = defaultdict(list)
    for rec, _, _, _, out in rows:
        groups[find(("row", rec))].append((-1 if out is None else out, -rec))
    return {-r for g in groups.values() for o, r in g if (o, r) != max(g)}


def frame(omp, rows):
    return omp([omp_row(rec, id=i, mid=m, items=[item("toolCall", id=c) for c in calls] or None, output=o, batch=rec % 7) for rec, i, m, calls, o in rows])


def test_against_brute_force(spark, omp):
    r = random.Random(7)
    for trial in range(2):
        pick = lambda p, n, k: r.choice([None, "", " ", f"{k}{r.randint(0, n)}"]) if r.random() < p else f"{k}{r.randint(0, n)}"  # noqa: E731, B023
        rows = [(i, None if r.random() < 0.2 else f"a{r.randint(0, 90)}", pick(0.5, 60, "m"), [f"c{r.randint(0, 400)}" for _ in range(r.randint(0, 2))] + ([None, ""] if r.random() < 0.1 else []), r.choice([None, 0, 5, 9])) for i in range(1, 121)]
        got = {x[0] for x in redundant_rows(frame(omp, rows), per_prefix=30, load=3 + 60 * trial).collect()}
        assert got == brute(rows)


def test_chain_through_many_rows(spark, omp):
    """A long chain of rows, each sharing something with the next alone, is one message."""
    rows = [(i, f"a{i // 2}" if i % 2 else f"a{i // 2}", f"m{(i + 1) // 2}", [], i) for i in range(1, 61)]
    assert {x[0] for x in redundant_rows(frame(omp, rows)).collect()} == set(range(1, 60))


def test_hot_identifier_and_ties(spark, omp):
    rows = [(i, "same" if i % 3 == 0 else f"own{i}", None, [], 4) for i in range(1, 301)]
    got = {x[0] for x in redundant_rows(frame(omp, rows)).collect()}
    assert got == {i for i in range(6, 301, 3)}


def test_nulls_empty_and_repeats(spark, omp):
    assert redundant_rows(omp([])).collect() == []
    rows = [omp_row(1, message=False), omp_row(2, items=None), omp_row(3, id="a", items=[None]), omp_row(3, id="a", items=[None]), omp_row(4, id="a", output=1, batch=None)]
    assert [x[0] for x in redundant_rows(omp(rows)).collect()] == [3]
    assert sorted(x["rec_id"] for x in kept_rows(omp(rows)).collect()) == [1, 2, 4]


def numbered(spark, low, high):
    return spark.range(low, high).select(F.col("id").alias("rec_id"), F.lit(1).cast("bigint").alias("output"), F.concat(F.lit("i"), (F.col("id") % 100)).alias("ident"))


def test_runs_hold_each_identifier_once(spark):
    scratch = Scratch(spark, "test")
    index = IdentifierIndex(spark, scratch.path, per_prefix=30, merge_every=3)
    brought = [{(r["ident"], r["first_row"]) for r in index.add(numbered(spark, k * 40, k * 40 + 80), k).collect()} for k in range(3)]
    assert [len(b) for b in brought] == [80, 20, 0] and ("i5", 5) in brought[0] and ("i99", 99) in brought[1]
    assert [r[2] for r in index.runs()] == [4, 1, 1]
    again = IdentifierIndex(spark, scratch.path, per_prefix=30, merge_every=3)
    assert again.add(numbered(spark, 0, 300), 3).collect() == []
    assert [r[:3] for r in again.runs()] == [(0, 2, 4), (3, 3, 1)]
    for r in spark.read.parquet(again.runs()[0][3]).collect():
        assert r["h"] == sorted(r["h"])
    scratch.close()


def test_a_batch_taken_in_again_gives_the_same(spark):
    scratch = Scratch(spark, "test")
    index = IdentifierIndex(spark, scratch.path)
    index.add(numbered(spark, 0, 10), 0)
    first = sorted(index.add(numbered(spark, 5, 20), 1).collect())
    assert sorted(IdentifierIndex(spark, scratch.path).add(numbered(spark, 5, 20), 1).collect()) == first and len(first) == 10
    scratch.close()


def test_many_small_batches_merge_within_a_prefix(spark, omp):
    rows = [omp_row(k, id=f"a{k % 40}", batch=k) for k in range(1, 121)]
    assert {r[0] for r in redundant_rows(omp(rows), per_prefix=1000, load=1).collect()} == set(range(41, 121))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["comp"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
