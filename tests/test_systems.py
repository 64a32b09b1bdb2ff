import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import dense, measures, quantised, systems
from rankloom.plans import leaderboard as lb
from rankloom.sources import results, sinks


def cloud(n, seed=3, dims=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((8, dims))[rng.integers(0, 8, n)] * 2 + rng.standard_normal((n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cloud(400))], "doc_id long, v array<double>")


def hits(df):
    return sorted((r.query_id, r.rank, r.doc_id) for r in df.collect())


def test_names_and_parameters():
    assert systems.resolve("dense") == "dense-flat" and systems.resolve("late_interaction", "li-muvera") == "li-muvera"
    for family, name in (("dense", "li-exact"), ("dense", "none"), ("sparse", None)):
        with pytest.raises(ValueError):
            systems.resolve(family, name)
    assert systems.parameters("dense-hnsw", m=8, candidates=5) == {"m": 8, "ef_construction": 200, "ef_search": 128}
    assert systems.family_of("x/ColBERT-v2") == "late_interaction" and systems.family_of("x", "dense") == "dense" == systems.family_of("bge")


@pytest.mark.parametrize("name", ["dense-opq-ivfpq", "dense-hnsw"])
def test_saved_indexes_are_opened_only_for_the_same_documents_and_parameters(spark, corpus, tmp_path, name):
    queries, folder = corpus.where("doc_id < 20").withColumnRenamed("doc_id", "query_id"), f"file://{tmp_path}"
    first = systems.prepare(name, corpus, 16, folder)
    again = systems.prepare(name, corpus, 16, folder)
    assert (first.status, again.status) == ("built", "loaded")
    assert hits(systems.search(first, queries, 5, 16)) == hits(systems.search(again, queries, 5, 16))
    assert systems.prepare(name, corpus.where("doc_id <> 7"), 16, folder).status == "built"
    assert systems.prepare("dense-flat", corpus, 16, folder).status == "not_applicable"


def test_blocks_of_queries_give_the_same(spark, corpus, monkeypatch):
    queries = corpus.where("doc_id < 30").withColumnRenamed("doc_id", "query_id")
    index = quantised.build(corpus, quantised.OneBitCodes())
    one = hits(quantised.search(index, queries, 5)), hits(dense.binary_rerank(corpus, queries, 5, [], 16, 50))
    monkeypatch.setattr(dense, "QUERY_BLOCK", 7)
    assert (hits(quantised.search(index, queries, 5)), hits(dense.binary_rerank(corpus, queries, 5, [], 16, 50))) == one


def test_encoder_and_saved_vectors(spark, tmp_path):
    texts = spark.createDataFrame([(1, "ab"), (2, None), (3, "c")], "doc_id long, text string")
    v = systems.encoded(texts, lambda batch: np.array([[len(t), 1.0] for t in batch]), "doc_id")
    got = {r.doc_id: r.v for r in v.collect()}
    assert got[1] == pytest.approx([2 / 5**0.5, 1 / 5**0.5]) and got[2] == [0.0, 1.0]
    path = f"file://{tmp_path}/v"
    assert [systems.saved_vectors(v, path, {"model": m})[1] for m in ("a", "a", "b")] == [False, True, False]


def run_row(i, family, model, name, e2e, **more):
    return {"schema_version": "0.3", "model": {"id": model, "family": family}, "dataset": {"benchmark": "beir", "name": "d"}, "quality": {"ndcg_at_10": 0.5}, "retrieval_system": {"name": name, "family": family} | more.pop("system", {}), "latency": {"e2e_query_ms_p50": e2e, "latency_sample_size": 200}, "storage": {"index_bytes_fp16": 100 * i}} | more


def test_parts_of_hybrids_come_from_their_parameters(spark):
    params = {"components": ["sparse", "dense", "li", "dense"], "dense_model": "a", "li_model": "b", "li_system": "li-muvera"}
    bodies = [run_row(1, "sparse", "bm25-py", "sparse-bm25", 1.0), run_row(2, "dense", "a", "dense-hnsw", 2.0), run_row(3, "late_interaction", "b", "li-muvera", 4.0), run_row(4, "hybrid", "rrf:a+b", "hybrid-rrf-bm25-dense-li", None, system={"params": params})]
    files = spark.createDataFrame([(i, f"p{i}", json.dumps(b)) for i, b in enumerate(bodies)], "file_id long, file_path string, body string").withColumn("created_at", F.current_timestamp())
    facts = results.facts(files)
    parts = lb.part_sources(facts)
    assert {(r.part, r.part_model, r.part_system) for r in parts.collect()} == {("sparse", "bm25-py", "sparse-bm25"), ("dense", "a", "dense-hnsw"), ("li", "b", "li-muvera")}
    assert lb.composed_model(parts).first().model_id == "rrf:bm25-py+a+b"
    r = lb.backfill(lb.runs(facts), parts).first()
    assert (r.parts, r.e2e_ms_p50, r.sample_size, r.component_bytes, r.status) == (3, 7.0, 200, 600.0, "completed")
    assert lb.backfill(lb.runs(facts)).first().e2e_ms_p50 is None  # the run's own model has no parts


def test_labels(spark):
    ids = ["x/bge-small-en", "gtembed-v1", "NV-e5", "a/b/nv-gte", "plain"]
    df = spark.createDataFrame([(i,) for i in ids], "m string")
    got = [tuple(r) for r in df.select(lb.model_label(F.col("m"), F.lit(None).cast("long")), lb.model_label(F.col("m"), F.lit(64)), lb.model_label_site(F.col("m"))).collect()]
    assert [g[0] for g in got] == ["BGE Small En", "GTEmbed V1", "NV E5", "NV GTE", "Plain"] and got[0][1] == "BGE Small En @64d"
    assert [g[2] for g in got] == ["BGE Small En", "Gtembed V1", "NV E5", "NV GTE", "Plain"]
    row = spark.createDataFrame([(1234.5678, None)], "storage_gb double, e2e_ms_p50 double").select(lb.axis_text("storage_gb"), lb.axis_text("e2e_ms_p50")).first()
    assert tuple(row) == ("1,234.568 GB", "-- ms")


def test_cache_key_is_the_hash_of_sorted_json(spark):
    fields = {"b": 'x"y', "a": None, "c": "z"}
    want = hashlib.sha256(json.dumps(fields, sort_keys=True).encode()).hexdigest()[:24]
    df = spark.createDataFrame([tuple(fields.values())], "b string, a string, c string")
    assert df.select(sinks.cache_key(**{k: F.col(k) for k in fields})).first()[0] == want


def test_latency_rows():
    one = measures.serving_batch(lambda rows: rows, lambda q: None, 10, 1, 5)
    assert one["status"] == "ok" and one["samples"] == 5 and one["e2e_ms_p50"] == pytest.approx(one["query_encode_ms_p50"] + one["retrieval_ms_p50"])

    def full(q):
        raise MemoryError

    row = measures.latency_row([one, measures.serving_batch(lambda rows: rows, full, 10, 32)], 10)
    assert row["status"] == "partial" and row["serving_batch_32_status"] == "oom" and row["e2e_query_ms_p50"] == one["e2e_ms_p50"]
    assert measures.latency_row([], 0)["status"] == "skipped"
    with pytest.raises(ZeroDivisionError):
        measures.timed_status(lambda: 1 / 0)


def test_hybrids_need_result_and_sidecar(spark):
    f = lambda *p: spark.createDataFrame([(x,) for x in p], "result_path string")
    assert [r[0] for r in lb.hybrid_done(f("a.json", "b.json", "c.json"), f("a.json", "b.json"), f("b.rankings.json", "c.rankings.json")).collect()] == ["b.json"]


def test_first_source_that_can_be_read(spark, tmp_path):
    back = spark.createDataFrame([(0,)], "x long")
    spark.createDataFrame([(1,)], "x long").write.json(f"{tmp_path}/b")
    assert results.first_source(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], back).first().x == 1
    assert results.first_source(spark, [f"{tmp_path}/a"], back).first().x == 0


def test_strict_coverage(spark):
    files = spark.createDataFrame([(1, "p", json.dumps(run_row(1, "dense", "a", "dense-flat", 2.0)))], "file_id long, file_path string, body string").withColumn("created_at", F.current_timestamp())
    r = lb.runs(results.facts(files))
    req = spark.createDataFrame([("beir", "d", "dense-flat", "a", True), ("beir", "e", "dense-flat", None, True)], "benchmark string, dataset string, system string, model_id string, require_latency boolean")
    assert {tuple(x) for x in lb.coverage_report(req, r).collect()} == {("beir / e / dense-flat / any model", "missing")}
    with pytest.raises(ValueError):
        lb.coverage_report(req, r, strict=True)
