"""Scans: the same hits as by double precision, ties by id, nothing gathered on the driver, blocks of any size."""

import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from pyspark.sql import functions as F

from rankloom.functions.text import tokens
from rankloom.operators import bm25, dense, late, scan
from rankloom.operators.topk import ranked
from rankloom.plans import retrieval_queries


@pytest.fixture
def nothing_gathered(monkeypatch):
    def refused(self):
        raise AssertionError("rows gathered on the driver")

    monkeypatch.setattr(DataFrame, "toPandas", refused)


def table(spark, key, x, kind="float"):
    return spark.createDataFrame([(f"{key}{i:04d}", v.tolist()) for i, v in enumerate(x)], f"{key} string, v array<{kind}>").repartition(3)


def listed(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 6)))
    return got


def test_scan_in_small_blocks_without_gathering(spark, monkeypatch, nothing_gathered):
    monkeypatch.setattr(scan, "BLOCK_VALUES", 40 * 8)
    rng = np.random.default_rng(3)
    # scores that single precision cannot tell apart, and equal ones
    x = np.repeat(rng.standard_normal((150, 8)), 4, axis=0) + np.tile([0, 1e-8, 2e-8, 0], 150)[:, None]
    q = rng.standard_normal((300, 8))
    got = listed(dense.flat(table(spark, "doc_id", x, "double"), table(spark, "query_id", q, "double"), 7, []))
    s = np.round(q @ x.T, 9)
    for i in range(len(q)):
        want = np.lexsort((np.arange(len(x)), -s[i]))[:7]
        assert [d for d, _ in got[f"query_id{i:04d}"]] == [f"doc_id{j:04d}" for j in want]


@pytest.mark.parametrize("total", [True, False])
def test_long_vectors_first(spark, monkeypatch, total):
    """Short vectors are not scored where the lists are full of better ones; equal scores of short and long ones stay in order of id."""
    monkeypatch.setattr(scan, "BLOCK_VALUES", 40 * 8)
    rng = np.random.default_rng(5)
    nd, nq, lengths = rng.integers(1, 3, 600), rng.integers(1, 3, 300), rng.permutation(np.repeat([8, 1, 0.5], 200))
    x, q = rng.integers(-2, 3, (600, 2, 8)) * lengths[:, None, None] / 8, rng.integers(-2, 3, (300, 2, 8)).astype(float)
    kind = "tokens array<array<double>>"
    folder = scan.store(spark.createDataFrame([(f"d{i:04d}", v[:n].tolist()) for i, (v, n) in enumerate(zip(x, nd))], f"doc_id string, {kind}"), [])
    scored, limits = [], scan.limits
    monkeypatch.setattr(scan, "limits", lambda s, *a: scored.append(s.size) or limits(s, *a))
    for k, most in ((5, 0.6), (150, 1)):
        scored.clear()
        r, i, s = scan.search(folder, "", nq, np.concatenate([v[:n] for v, n in zip(q, nq)]), k, total)
        assert sum(scored) < most * 300 * 600 + 1
        for j in range(300):
            want = np.array([(m.sum() if total else m.max()) for m in ((q[j, : nq[j]] @ v[:n].T).max(1) for v, n in zip(x, nd))])
            order = np.lexsort((np.arange(600), -np.round(want, 9)))[:k]
            assert i[r == j].tolist() == order.tolist() and np.allclose(s[r == j], want[order])


@pytest.mark.parametrize("held, read", [(4_000_000, 1), (60 * 8, 2), (0, 3)])
def test_few_long_vectors_of_many_blocks_are_searched_together(spark, monkeypatch, held, read):
    """Two long classes with four documents in a block each: scored blocks at a time, and read in one pass if there is room."""
    monkeypatch.setattr(scan, "BLOCK_VALUES", 40 * 8)
    monkeypatch.setattr(scan, "HELD_VALUES", held)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((600, 8))
    x *= (np.where(np.arange(600) % 10 == 0, 9, np.where(np.arange(600) % 10 == 1, 3, 1)) / np.linalg.norm(x, axis=1))[:, None]
    q = rng.standard_normal((200, 8))
    folder = scan.store(spark.createDataFrame([(f"d{i:04d}", [v.tolist()]) for i, v in enumerate(x)], "doc_id string, tokens array<array<double>>"), [])
    calls, passes, limits, blocks = [], [], scan.limits, scan.blocks
    monkeypatch.setattr(scan, "limits", lambda s, *a: calls.append(s.shape[1]) or limits(s, *a))
    monkeypatch.setattr(scan, "blocks", lambda f, g, columns: passes.append("m" in columns) or blocks(f, g, columns))
    r, i, s = scan.search(folder, "", np.ones(200, np.int64), q, 30, True)
    assert min(calls[:6]) >= 20  # of 60 long ones; four are in a block
    assert sum(passes) == read
    for j in range(200):
        want = np.lexsort((np.arange(600), -np.round(q[j] @ x.T, 9)))[:30]
        assert i[r == j].tolist() == want.tolist() and np.allclose(s[r == j], q[j] @ x[want].T)


def test_all_equal_documents_stay_at_k(spark, nothing_gathered):
    x = np.ones((500, 4))
    got = listed(dense.flat(table(spark, "doc_id", x), table(spark, "query_id", x[:2]), 5, []))
    assert [d for d, _ in got["query_id0001"]] == [f"doc_id{i:04d}" for i in range(5)]


def test_own_ids_are_no_hits(spark, nothing_gathered):
    x = np.eye(6)
    got = listed(dense.flat(table(spark, "doc_id", x), table(spark, "doc_id", x).withColumnRenamed("doc_id", "query_id"), 6, [], exclude_self=True))
    assert all(len(v) == 5 and k not in [d for d, _ in v] for k, v in got.items()) and len(got) == 6


def test_vectors_that_are_not_finite_take_no_part(spark):
    x = np.array([[1, 0], [np.nan, 1], [0.5, 0], [np.inf, 1]])
    got = listed(dense.flat(table(spark, "doc_id", x), table(spark, "query_id", np.array([[1, 0], [np.nan, 0]])), 4, []))
    assert got == {"query_id0000": [("doc_id0000", 1.0), ("doc_id0002", 0.5)]}


@pytest.mark.parametrize("name", ["dense_flat_topk", "dense_truncated_topk", "binary_rerank_topk"])
def test_registered_dense_queries_gather_nothing(spark, data, name, nothing_gathered):
    assert retrieval_queries.QUERIES[name](spark, data).count() > 0


def test_bm25_in_small_blocks(spark, monkeypatch, tmp_path):
    """Against the weights of the index, joined and added up; terms of one document and of all, repeated queries, k cut."""
    monkeypatch.setattr(bm25, "BLOCK_DOCS", 48)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(200)]
    text = lambda n: " ".join(words[int(i)] for i in rng.zipf(1.4, n) if i < 200)
    docs = spark.createDataFrame([(f"s{i % 2}", f"d{i:03d}", "", text(int(rng.integers(0, 30)))) for i in range(400)], "s string, doc_id string, title string, text string")
    q = spark.createDataFrame([(f"s{i % 2}", f"q{i:02d}", text(6) if i % 5 else "w1 w2") for i in range(40)], "s string, query_id string, text string")
    index = bm25.build(docs, ("s",))
    terms = q.select("s", "query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    want = ranked(index.weights().join(terms, ["s", "term"]).groupBy("s", "query_id", "doc_id").agg(F.sum("w").alias("score")), ["s", "query_id"], "score", ["doc_id"], 9)
    plan = bm25.search(index, q, 9)
    assert listed(plan) == listed(want)
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString().replace("BroadcastHashJoin", "")
    index.save(str(tmp_path / "i"))
    assert listed(bm25.search(bm25.Bm25Index.open(spark, str(tmp_path / "i"), ("s",)), q, 9)) == listed(want)


@pytest.mark.parametrize("name", sorted(n for n in retrieval_queries.QUERIES if n.startswith("rrf_")))
def test_fusions_move_lists_and_gather_nothing(spark, data, name, nothing_gathered):
    """No row per pair of query and document is shuffled: after the one exchange of lists they are taken apart."""
    df = retrieval_queries.QUERIES[name](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() > 0 and plan.count("Exchange hashpartitioning") == 1


def test_codes_in_small_blocks(spark, monkeypatch, nothing_gathered):
    monkeypatch.setattr(scan, "BLOCK_VALUES", 40 * 8)
    rng = np.random.default_rng(7)
    x, q = rng.standard_normal((500, 8)), rng.standard_normal((150, 8))
    for candidates in (30, 60):  # fewer and more than a block has
        got = listed(dense.binary_rerank(table(spark, "doc_id", x, "double"), table(spark, "query_id", q, "double"), 5, [], 8, candidates))
        for i, v in enumerate(q):
            near = np.lexsort((np.arange(500), ((x >= 0) != (v >= 0)).sum(1)))[:candidates]
            want = near[np.lexsort((near, -np.round(x[near] @ v, 9)))][:5]
            assert [d for d, _ in got[f"query_id{i:04d}"]] == [f"doc_id{j:04d}" for j in want]


def test_bm25_metrics_moves_lists(spark, data):
    plan = retrieval_queries.bm25_metrics(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_position" in plan and "row_number() windowspecdefinition(dataset" in plan and "posexplode" not in plan
