"""Fusion of lists where they arrive, and BM25 that scores equal documents and equal queries once."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.operators import bm25, fusion, scan
from rankloom.operators.topk import ranked


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def parts(spark):
    r = random.Random(3)
    some = lambda n: r.sample([f"d{i}" for i in range(40)], n)
    plain = [(f"q{q}", some(r.randint(1, 30))) for q in range(12)] + [("q1", some(20))]  # q1 has two lists, as from two datasets
    dense = [(m, f"q{q}", some(r.randint(1, 30))) for q in range(3, 14) for m in "ab" if (q, m) != (5, "b")]
    li = [(f"q{q}", some(25)) for q in range(6)]
    frame = lambda rows, *by: spark.createDataFrame(rows, ", ".join([f"{b} string" for b in (*by, "query_id")]) + ", docs array<string>")
    return frame(plain), frame(dense, "model_id"), frame(li)


def by_rows(parts, group, k, models=None):
    """The same by rows, groups and a window."""
    rows = []
    for p in parts:
        if models is not None and "model_id" not in p.columns:
            p = p.crossJoin(models)
        rows.append(p.select(*group, F.posexplode("docs").alias("p", "doc_id")))
    every = rows[0]
    for x in rows[1:]:
        every = every.unionByName(x)
    total = every.groupBy(*group, "doc_id").agg(F.sum(1.0 / (F.lit(61) + F.col("p"))).alias("score"))
    return ranked(total, group, "score", ["doc_id"], k)


def listed(df, group):
    return sorted((*[r[g] for g in group], r["rank"], r["doc_id"], round(r["score"], 12)) for r in df.collect())


@pytest.mark.parametrize("pieces", [3, 200, 262_144])
def test_lists_by_model(spark, parts, monkeypatch, pieces):
    monkeypatch.setattr(fusion, "FUSED", pieces)
    models, group = spark.createDataFrame([("a",), ("b",), ("c",)], "model_id string"), ["model_id", "query_id"]
    got = fusion.rrf_lists(list(parts), group, 15, all_of=models)
    assert listed(got, group) == listed(by_rows(parts, group, 15, models), group)


def test_lists_without_model(parts):
    two = [parts[0], parts[2]]
    assert listed(fusion.rrf_lists(two, ["query_id"], 15), ["query_id"]) == listed(by_rows(two, ["query_id"], 15), ["query_id"])


def test_no_row_of_a_document_is_sorted_or_shuffled(spark, parts):
    plan = shuffles(fusion.rrf_lists(list(parts), ["model_id", "query_id"], all_of=spark.createDataFrame([("a",), ("b",)], "model_id string")))
    assert "Window" not in plan and "Generate" not in plan and "Aggregate" not in plan and plan.count("Exchange") == 1


def test_columns_are_in_the_order_shown(spark, parts):
    """A select in the order shown is no copy of each row."""
    models = spark.createDataFrame([("a",), ("b",)], "model_id string")
    got = fusion.rrf_lists(list(parts), ["model_id", "query_id"], all_of=models)
    assert got.columns == ["model_id", "query_id", "rank", "doc_id", "score"]
    assert shuffles(got.select("model_id", "query_id", "rank", "doc_id", "score")).index("MapInArrow") < 60
    two = fusion.rrf_lists([parts[0], parts[2]], ["query_id"])
    assert two.columns == ["query_id", "rank", "doc_id", "score"]


def test_scores_are_rounded_as_spark_does(spark):
    parts = 1 / (60 + np.arange(1, 101))
    s = np.unique(np.r_[parts, (parts[:, None] + parts).ravel(), (parts[:, None] + parts + 1 / 128).ravel()])
    want = [r.x for r in spark.createDataFrame([(i, float(x)) for i, x in enumerate(s)], "i int, x double").select("i", F.round("x", 6).alias("x")).orderBy("i").collect()]
    assert fusion._rounded(s, 6).tolist() == want


def documents(spark):
    text = {"x y": [1, 5, 9, 12, 14], "y x": [2, 13], "x y y": [3], "z": [4, 6], "": [7, 8]}
    return spark.createDataFrame([(f"d{i:02}", "", t) for t, ids in text.items() for i in ids], "doc_id string, title string, text string")


@pytest.mark.parametrize("k", [1, 3, 6, 50])
def test_equal_documents_are_scored_once(spark, k):
    index = bm25.build(documents(spark))
    stored = spark.read.parquet(bm25._store(index.texts(), [], k))
    assert stored.agg(F.sum("n")).first()[0] == 4  # of 12 documents; those without a token are one
    q = spark.createDataFrame([("q1", "x"), ("q2", "y x"), ("q3", "x y"), ("q4", "z")], "query_id string, text string")
    pairs = index.weights().join(q.select("query_id", F.explode(F.array_distinct(F.split("text", " "))).alias("term")), "term").groupBy("query_id", "doc_id").agg(F.sum("w").alias("score"))
    assert listed(bm25.search(index, q, k), ["query_id"]) == listed(ranked(pairs, ["query_id"], "score", ["doc_id"], k), ["query_id"])


def test_queries_of_equal_terms_are_in_one_task(spark):
    folder = bm25._store(bm25.build(documents(spark)).texts(), [], 10)
    q = spark.createDataFrame([("", f"q{i}", [["x"], ["x", "y"], ["z"]][i % 3]) for i in range(90)], "g string, query_id string, terms array<string>")
    placed = scan.spread(q, folder, [], 16_384, "n", "terms").withColumn("p", F.spark_partition_id())
    assert placed.count() == 90
    assert [r.n for r in placed.groupBy("terms").agg(F.count_distinct("p").alias("n")).collect()] == [1, 1, 1]


@pytest.mark.parametrize("rows", [1_024, 2])
def test_what_neighbours_begin_with_is_added_up_once(spark, monkeypatch, rows):
    """Queries of many common terms that differ in a rare one; with and without room for rows of all terms."""
    monkeypatch.setattr(bm25, "ROWS", rows)
    text = lambda i: " ".join([w for j, w in enumerate("abcde") if i % (j + 2)] + [f"n{i % 40}"] * (i % 3 + 1))
    index = bm25.build(spark.createDataFrame([(f"d{i:03d}", "", text(i)) for i in range(400)], "doc_id string, title string, text string"))
    q = spark.createDataFrame([(f"q{i:02d}", f"n{i} e d c b a") for i in range(40)], "query_id string, text string")
    pairs = index.weights().join(q.select("query_id", F.explode(F.split("text", " ")).alias("term")), "term").groupBy("query_id", "doc_id").agg(F.sum("w").alias("score"))
    assert listed(bm25.search(index, q, 9), ["query_id"]) == listed(ranked(pairs, ["query_id"], "score", ["doc_id"], 9), ["query_id"])
    calls, add, run = [], np.add, {}
    monkeypatch.setattr(scan, "mapped", lambda *a: run.update(f=a[5]))
    bm25.lists(index, q, 9)
    monkeypatch.setattr(np, "add", lambda *a, **b: calls.append(1) or add(*a, **b))
    terms = pa.array([["a", "b", "c", "d", "e", f"n{i}"] for i in range(40)])
    assert sum(b.num_rows for b in run["f"](pa.table({"query_id": [f"q{i:02d}" for i in range(40)], "terms": terms}), "")) == 40
    assert len(calls) <= 4 + 40  # not 5 for each of the 40
