"""Recall of the registered approximate queries on a table without clusters, larger than the smallest index."""

import numpy as np
import pytest

from rankloom.plans import retrieval_queries


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    x = np.random.default_rng(8).standard_normal((2400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    at = str(tmp_path_factory.mktemp("recall"))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3).write.parquet(f"{at}/embeddings.parquet")
    return at, x


def found(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, set()).add(r.doc_id)
    return got


def recall(got, exact):
    return np.mean([len(got.get(i, set()) & want) / len(want) for i, want in exact.items()])


@pytest.mark.parametrize("name", ["ah_topk", "ivfpq_topk", "rabitq_topk"])
def test_registered_codes_reach_their_recall(spark, table, name):
    at, x = table
    exact = {i: set(np.argsort(-(x @ x[i]), kind="stable")[:10].tolist()) for i in range(0, len(x), 20)}
    assert recall(found(retrieval_queries.QUERIES[name](spark, at)), exact) >= 0.9


def test_registered_encodings_reach_their_recall(spark, table):
    at, _ = table
    assert recall(found(retrieval_queries.muvera_topk(spark, at)), found(retrieval_queries.maxsim_topk(spark, at))) >= 0.9
