import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import vectors as V
from rankloom.operators import bm25, dense, fusion, late, measures, metrics, quantised
from rankloom.operators.topk import ranked
from rankloom.sources import datasets


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_bm25_counts_a_repeated_query_term_once(spark):
    docs = spark.createDataFrame([("d1", "", "cat sat"), ("d2", "", "cat cat dog"), ("d3", "", "bird")], "doc_id string, title string, text string")
    q = spark.createDataFrame([("q", "Cat cat")], "query_id string, text string")
    got = {r.doc_id: round(r.score, 6) for r in bm25.search(bm25.build(docs), q).collect()}
    assert got == {"d2": 0.579875, "d1": 0.470004}


def test_bm25_of_nothing(spark):
    docs = spark.createDataFrame([("d1", "", ""), ("d2", None, None)], "doc_id string, title string, text string")
    index = bm25.build(docs)
    assert {r.dl for r in index.doc_stats.collect()} == {0}
    assert bm25.search(index, spark.createDataFrame([("q", "x"), ("r", None)], "query_id string, text string")).count() == 0


def test_bm25_saved_and_opened(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "", "cat sat"), ("d2", "", "cat cat dog")], "doc_id string, title string, text string")
    q = spark.createDataFrame([("q", "cat dog")], "query_id string, text string")
    index = bm25.build(docs)
    index.save(str(tmp_path / "i"))
    assert rows(bm25.search(bm25.Bm25Index.open(spark, str(tmp_path / "i")), q), "rank") == rows(bm25.search(index, q), "rank")


def _scores(spark, hits, qrels):
    r = spark.createDataFrame(hits, "query_id string, doc_id string, rank int")
    q = spark.createDataFrame(qrels, "query_id string, doc_id string, rel double")
    return metrics.per_query(r, q, ["query_id"])


def test_metrics_by_hand(spark):
    got = _scores(spark, [("q", "x", 1), ("q", "a", 2), ("q", "b", 3), ("z", "a", 1)], [("q", "a", 2.0), ("q", "b", 1.0), ("n", "c", 1.0)])
    by = {r.query_id: r for r in got.collect()}
    assert set(by) == {"q", "n"}  # z has no judgements, n has no hits and counts 0
    assert (round(by["q"].ndcg_at_10, 6), by["q"].recall_at_100, by["q"].mrr_at_10, round(by["q"].map_at_100, 6)) == (0.659002, 1.0, 0.5, 0.583333)
    assert (by["n"].ndcg_at_10, by["n"].recall_at_100, by["n"].mrr_at_10, by["n"].map_at_100) == (0, 0, 0, 0)
    m = metrics.means(got).first()
    assert m.queries == 2 and m.mrr_at_10 == 0.25


def test_means_of_no_query(spark):
    m = metrics.means(_scores(spark, [("q", "a", 1)], [])).first()
    assert (m.queries, m.ndcg_at_10) == (0, 0.0)


def test_rrf_by_hand(spark):
    part = lambda ds: spark.createDataFrame([("q", d, i + 1) for i, d in enumerate(ds)], "query_id string, doc_id string, rank int")
    got = {r.doc_id: round(r.score, 6) for r in fusion.rrf([part("ab"), part("bc")], ["query_id"]).collect()}
    assert got == {"b": 0.032522, "a": 0.016393, "c": 0.016129}


def test_ties_go_to_the_lower_id(spark):
    df = spark.createDataFrame([("q", 7, 0.5), ("q", 3, 0.5), ("q", 9, 0.9)], "query_id string, doc_id int, score double")
    assert [r.doc_id for r in ranked(df, ["query_id"], "score", ["doc_id"]).orderBy("rank").collect()] == [9, 3, 7]


def test_truncate_and_sanitise(spark):
    df = spark.createDataFrame([([3.0, 4.0, 12.0],)], "v array<double>")
    assert df.select(V.truncate(F.col("v"), 2)).first()[0] == pytest.approx([0.6, 0.8])
    with pytest.raises(Exception):
        df.select(V.truncate(F.col("v"), 4)).collect()
    bad = spark.createDataFrame([(1, [float("nan"), 1.0]), (2, [3.0, 4.0]), (3, [0.0, 0.0])], "i int, v array<double>")
    got = {r.i: r.v for r in V.sanitise(bad, "v").collect()}
    assert got[1] == [0.0, 1.0] and got[2] == pytest.approx([0.6, 0.8]) and got[3] == [0.0, 0.0]
    fine = bad.where("i > 1")
    assert {r.i: r.v for r in V.sanitise(fine, "v").collect()}[2] == [3.0, 4.0]


def test_sign_bits(spark):
    df = spark.createDataFrame([([0.1, -0.2, 0.0],)], "v array<double>")
    assert df.select(V.sign_string(F.col("v"))).first()[0] == "101"


def test_list_and_part_rules():
    assert [dense.nlist(n) for n in (0, 1, 2, 10, 20, 100, 10_000)] == [1, 1, 2, 10, 17, 40, 256]
    assert dense.pq_parts(100_000, 64) == 32 and dense.pq_parts(300, 64) == 2 and dense.pq_parts(10, 64) == 32 and dense.pq_parts(10, 7, 7) == 7


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 32)) * 2
    x = centres[rng.integers(0, 12, 600)] + rng.standard_normal((600, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, v array<double>").repartition(3)
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 600, 20)], "query_id long, v array<double>")
    exact = {r.query_id: set() for r in q.select("query_id").collect()}
    for i in exact:
        exact[i] = set(np.argsort(-(x @ x[i]), kind="stable")[:10].tolist())
    return c, q, exact


def recall(df, exact):
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, set()).add(r.doc_id)
    return np.mean([len(got.get(i, set()) & want) / len(want) for i, want in exact.items()])


def test_flat_is_exact_in_both_forms(cloud):
    c, q, exact = cloud
    a, b = dense.flat(c, q, 10, []), dense.flat_expression(c, q, 10, [])
    assert recall(a, exact) == 1.0
    key = lambda df: [(r.query_id, r.doc_id, r.rank) for r in df.orderBy("query_id", "rank").collect()]
    assert key(a) == key(b)


@pytest.mark.parametrize("quantiser", [quantised.ProductCodes(parts=16), quantised.OneBitCodes(), quantised.PairCodes()])
def test_codes_reach_their_recall(cloud, quantiser):
    c, q, exact = cloud
    assert recall(quantised.search(quantised.build(c, quantiser), q, 10, 100), exact) >= 0.9


def test_graph_reaches_its_recall(cloud):
    c, q, exact = cloud
    assert recall(quantised.graph_topk(c, q, 10), exact) >= 0.9


def test_binary_rerank_reaches_its_recall(cloud):
    c, q, exact = cloud
    assert recall(dense.binary_rerank(c, q, 10, [], 32, 200), exact) >= 0.9


def test_empty_index(spark):
    none = spark.createDataFrame([], "doc_id long, v array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, v array<double>")
    assert dense.flat(none, q, 5, []).count() == 0
    assert quantised.search(quantised.build(none, quantised.OneBitCodes()), q, 5).count() == 0


@pytest.fixture(scope="module")
def matrices(spark):
    rng = np.random.default_rng(6)
    topics = rng.standard_normal((8, 16)) * 2
    m = [(lambda t: (t / np.linalg.norm(t, axis=1)[:, None]))(topics[i % 8] + rng.standard_normal((int(rng.integers(2, 6)), 16))) for i in range(120)]
    c = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "doc_id long, tokens array<array<double>>")
    q = c.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    exact = {i: set(np.argsort([-(m[i] @ d.T).max(1).sum() for d in m], kind="stable")[:10].tolist()) for i in range(0, 120, 20)}
    return c, q, exact


def test_maxsim_is_exact(matrices):
    c, q, exact = matrices
    assert recall(late.exact(c, q, 10), exact) == 1.0


def test_candidate_systems_reach_their_recall(matrices):
    c, q, exact = matrices
    assert recall(late.plaid(c, q, 10, centroids=32, probes=8), exact) >= 0.9
    assert recall(late.muvera(c, q, 10, 16, candidates=40), exact) >= 0.9


def test_dataset_rules(spark):
    corpus = spark.createDataFrame([("1", " T ", "\nx\t"), ("2", None, "y"), ("3", "z", " ")], "_id string, title string, text string")
    queries = spark.createDataFrame([("b", "two"), ("a", "one"), ("c", "three")], "_id string, text string")
    qrels = spark.createDataFrame([("a", "1", 1), ("a", "1", 2), ("b", "2", 0), ("c", "3", None)], "`query-id` string, `corpus-id` string, score int")
    d = datasets.load(corpus, queries, qrels)
    assert {r.doc_id: r.text for r in d.documents.collect()} == {"1": "T\nx", "2": "y", "3": "z"}
    assert sorted(r.query_id for r in d.queries.collect()) == ["a", "c"]
    assert rows(d.qrels, "query_id") == [("a", "1", 2.0), ("c", "3", 1.0)]
    assert d.qrels_rows.first()[0] == 3
    assert rows(datasets.load(corpus, queries, qrels, limit=1).queries, "query_id") == [("a", "one")]
    with pytest.raises(KeyError):
        datasets.load(corpus.withColumnRenamed("_id", "key"), queries, qrels)
    with pytest.raises(ValueError):
        datasets.benchmark_of("nowhere")


def test_gold_lists(spark):
    ex = spark.createDataFrame([("q1", " how ", ["d1", "d2"]), ("q2", "why", None)], "id string, query string, gold_ids array<string>")
    docs = spark.createDataFrame([("d1", None)], "id string, content string")
    d = datasets.load_gold(ex, docs)
    assert d.queries.count() == 2 and rows(d.qrels, "doc_id") == [("q1", "d1", 1.0), ("q1", "d2", 1.0)]
    assert d.documents.first().text == ""


def test_measures(spark):
    s = measures.latency_summary(spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)], "k string, v double"), ["k"], "v").first()
    assert (s.p50, round(s.p99, 6), s.mean) == (2.5, 3.97, 2.5)
    one = spark.range(1)
    assert one.select(F.round(measures.query_cost(F.lit(36.0)), 6)).first()[0] == 19.9
    assert one.select(measures.indexing_cost(F.lit(0.0))).first()[0] is None
    assert one.select(*measures.storage_summary(F.lit(7), F.lit(2))).first() == (7, 3, None, 3.5)
    assert one.select(*measures.storage_summary(F.lit(7), F.lit(0))).first()[3] == 0.0
    assert measures.parse_batches(" 32, 1,32") == [1, 32] and measures.parse_batches("") == [1]
    assert measures.sample_positions(3) == [0, 1, 2] and len(measures.sample_positions(1000)) == 200
    assert len(measures.timed(lambda: None, 3, 1)) == 3
    assert math.isclose(one.select(measures.docs_per_second(F.lit(10), F.lit(500.0))).first()[0], 20.0)
