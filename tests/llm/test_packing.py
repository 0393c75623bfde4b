import random

from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm.packing import best_fit, fill_rates, packed, pieces, windows

ITEM = "budget_id int, capacity int, item long, size int, bin long"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60))
def test_best_fit_against_search(sizes):
    bins, fills = best_fit(sizes, 30)
    want, rooms = [], []
    for s in sizes:
        fitting = [(room, k) for k, room in enumerate(rooms) if room >= s]
        if not fitting:
            rooms.append(30 - s)
            want.append(30 - s)
        else:
            room, k = min(fitting)
            rooms[k] -= s
            want.append(rooms[k])
    assert sorted(30 - f for f in fills) == sorted(rooms) and len(bins) == len(sizes)
    for b in set(bins):
        assert sum(s for s, x in zip(sizes, bins, strict=True) if x == b) == fills[b] <= 30


def test_rounds_keep_every_item(spark):
    r = random.Random(4)
    rows = [(1 + i % 2, (100, 250)[i % 2], i, r.choice([0, 3, 60, 99, 100, r.randint(1, 100)]), 7) for i in range(1500)]
    for options in ({}, {"partition_items": 60}, {"partition_items": 60, "fan_in": 2}):
        got = packed(spark.createDataFrame(rows, ITEM), **options).collect()
        assert sorted((x["budget_id"], x["item"], x["size"]) for x in got) == sorted((b, i, s) for b, _, i, s, _ in rows)
        fills, budget = {}, {}
        for x in got:
            fills[x["bin"]] = fills.get(x["bin"], 0) + x["size"]
            budget.setdefault(x["bin"], set()).add((x["budget_id"], x["capacity"]))
        assert all(len(b) == 1 and fills[k] <= next(iter(b))[1] for k, b in budget.items())
        for b, c in ((1, 100), (2, 250)):
            mine = [k for k, v in budget.items() if (b, c) in v]
            assert len(mine) * c <= 1.25 * sum(fills[k] for k in mine)


def test_pieces(spark):
    counts = spark.createDataFrame([(1, 0), (2, 10), (3, 11), (4, 35)], "doc_id long, n_tokens long")
    budgets = spark.createDataFrame([(1, 10), (2, None), (3, 0), (None, 5), (1, 10)], "budget_id int, capacity int")
    got = sorted((r["doc_id"], r["piece_no"], r["first_token"], r["size"]) for r in pieces(counts, budgets).collect())
    assert got == [(1, 0, 0, 0), (2, 0, 0, 10), (3, 0, 0, 10), (3, 1, 10, 1), (4, 0, 0, 10), (4, 1, 10, 10), (4, 2, 20, 10), (4, 3, 30, 5)]


def test_windows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "word " * 5000, 1), (4, "short", 1), (5, "short", 1)], "doc_id long, text string, size int")
    budgets = spark.createDataFrame([(1, "x", 100), (2, "y", 4000)], "budget_id int, label string, capacity int")
    w = windows(docs, budgets)
    got = w.collect()
    assert {r["doc_id"] for r in got if r["budget_id"] == 1} == {1, 2, 3, 4, 5}
    assert [r["piece_no"] for r in sorted(got, key=lambda r: r["piece_no"]) if r["budget_id"] == 2 and r["doc_id"] == 3] == [0, 1]
    assert all(r["fill"] > 0.6 for r in fill_rates(w, budgets).collect())
    assert windows(docs.limit(0), budgets).collect() == [] and windows(docs, budgets.limit(0)).collect() == []
