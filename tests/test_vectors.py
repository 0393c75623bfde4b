import os

import numpy as np
import pytest

from loomspan.operators.ranking import nearest_each
from loomspan.operators.vectors import VectorIndex

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def pairs(df):
    return {(r["query_id"], r["doc_id"]) for r in df.collect()}


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * 0.4 + np.eye(8)[i % 8] * 2).tolist()) for i in range(400)]
    return spark.createDataFrame([*rows, (900, None), (901, [0.0] * 8), (902, [1.0]), (903, [])], "doc_id long, embedding array<float>")


def test_all_cells_are_the_exact_search(spark, made, tmp_path):
    q = made.where("doc_id % 50 = 0")
    index = VectorIndex(spark, str(tmp_path / "ix")).create(made, cells=8)
    whole = [[(r["query_id"], r["doc_id"], round(r["distance"], 6)) for r in x.orderBy("query_id", "distance", "doc_id").collect()] for x in (index.nearest_each(q, 5, probes=8), nearest_each(made.where("doc_id < 900"), q.where("doc_id < 900"), 5))]
    assert whole[0] == whole[1]
    want = pairs(nearest_each(made.where("doc_id < 900"), q.where("doc_id < 900"), 5))
    near = pairs(index.nearest_each(q, 5, probes=2))
    assert len(near & want) >= 0.9 * len(want)
    few = pairs(index.nearest_each(q, 5, probes=8, inside=made.where("doc_id % 3 = 0")))
    assert few == pairs(nearest_each(made.where("doc_id % 3 = 0 and doc_id < 900"), q.where("doc_id < 900"), 5))


def test_growth_and_edges(spark, made, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "ix")).create(made.where("doc_id < 300"), cells=4, model="m")
    index.add(made)
    index.add(made)
    assert index.stored().count() == 400 and index.manifest["model"] == "m"
    index.retain(made.where("doc_id < 10"))
    assert index.stored().count() == 10 and len(index.manifest["segments"]) == 1
    empty = VectorIndex(spark, str(tmp_path / "empty")).create(made.limit(0))
    assert empty.nearest_each(made, 3).collect() == [] and index.nearest_each(made.limit(0), 3).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_recall_on_the_tables(spark):
    from loomspan.plans import retrieval

    assert all(r["recall"] >= 0.9 for r in retrieval.vector_index_recall(spark, SF).collect())
