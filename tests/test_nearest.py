import random

from loomspan.operators import ranking


def test_every_query_has_its_own_list(spark):
    r = random.Random(3)
    vec = {i: [r.uniform(-1, 1) for _ in range(4)] for i in range(60)}
    vec |= {60: vec[7], 61: None, 62: [], 63: [0.0] * 4, 64: [1.0, 2.0]}
    v = spark.createDataFrame(list(vec.items()), "doc_id long, embedding array<double>").repartition(3)
    got = {}
    for x in ranking.nearest_each(v, v.where("doc_id % 10 = 0 or doc_id in (7, 64)"), 5, 3).orderBy("query_id", "distance", "doc_id").collect():
        got.setdefault(x["query_id"], []).append(x["doc_id"])
    one = {q: [x["doc_id"] for x in ranking.nearest(v, vec[q], 5).collect()] for q in (0, 7, 10, 50, 64)}
    assert set(got) == {0, 7, 10, 20, 30, 40, 50, 60, 64} and all(got[q] == one[q] for q in one)
