"""The dense part of the fusions by model: every model and every vector of a document takes part."""

from datetime import datetime

import pytest

from rankloom.plans import retrieval_queries


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    at, unit = str(tmp_path_factory.mktemp("models")), lambda a, b: [float(a), float(b), *[0.0] * 62]
    for name, key, rows in (
        ("dense_index", "doc_id", [(1, "m", "far", unit(0.6, 0.8)), (2, "m", "near", unit(0, 1)), (3, "m", "near", unit(1, 0)), (4, "n", "other", unit(1, 0))]),
        ("dense_queries", "query_id", [(1, "m", "q", unit(1, 0)), (2, "n", "q", unit(1, 0))]),
    ):
        spark.createDataFrame([(*r, datetime(2026, 1, 1)) for r in rows], f"vec_id long, model_id string, {key} string, embedding array<float>, encoded_at timestamp").write.parquet(f"{at}/{name}.parquet")
    return at


def test_every_model_and_vector_takes_part(spark, table):
    got = retrieval_queries.QUERIES["rrf_dense_li_by_model"]  # registered
    assert callable(got)
    rows = {(r.model_id, r.query_id, r.rank, r.doc_id) for r in retrieval_queries._dense_by_model(spark, table).collect()}
    assert rows == {("m", "q", 1, "near"), ("m", "q", 2, "far"), ("n", "q", 1, "other")}


def test_only_vectors_of_the_model_move(spark, tmp_path):
    """The first vector of each key: the other model's rows give keys, but their vectors are not shuffled."""
    unit = lambda a, b: [float(a), float(b), *[0.0] * 62]
    rows = [(1, "larkspur-small", "a", unit(1, 2)), (1, "other", "b", unit(3, 4)), (2, "other", "c", unit(5, 6)), (3, "larkspur-small", "a", unit(7, 8)), (4, None, "d", unit(1, 1)), (4, "larkspur-small", None, unit(9, 9)), (5, "larkspur-small", "e", None)]
    spark.createDataFrame(rows, "vec_id long, model_id string, doc_id string, embedding array<float>").write.parquet(str(tmp_path / "dense_index.parquet"))
    got = {r.doc_id: r.v[:2] for r in retrieval_queries._first_vectors(spark, str(tmp_path), "dense_index", "doc_id").collect()}
    assert got == {"a": [1, 2], "b": [1, 2], "d": [9, 9]}
    own = retrieval_queries._keyed(spark, str(tmp_path), "dense_index", "doc_id", "larkspur-small")
    assert "= larkspur-small)) THEN" in own._jdf.queryExecution().optimizedPlan().toString()
