import json

import pytest

from rankloom.plans import leaderboard as lb
from rankloom.sources import results, sinks


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([("g", i, x, q) for i, (x, q) in enumerate([(1.0, 0.5), (2.0, 0.4), (3.0, 0.7), (4.0, 0.72), (10.0, 0.9)])], "g string, i int, x double, q double")


def test_frontier_and_knee(points):
    f = lb.frontier(points, ["g"], "x", "q", "i")
    assert [r.x for r in f.orderBy("position").collect()] == [1, 3, 4, 10]
    k = lb.knees(f, ["g"], "x", "q").collect()
    assert [(r.x, round(r.distance, 4)) for r in k] == [(3.0, 0.2778)]
    assert {r["pick"]: r.x for r in lb.picks(f, ["g"], "x", "q").collect()} == {"first": 1, "knee": 3, "last": 10}


def test_frontier_of_equal_x_nulls_and_nothing(spark):
    df = spark.createDataFrame([("g", 1, 1.0, 0.5), ("g", 2, 1.0, 0.6), ("g", 3, None, 0.9), ("g", 4, 2.0, float("nan")), ("g", 5, 1.0, 0.6)], "g string, i int, x double, q double")
    assert [r.i for r in lb.frontier(df, ["g"], "x", "q", "i").collect()] == [2]
    assert lb.knees(lb.frontier(df, ["g"], "x", "q", "i"), ["g"], "x", "q").count() == 0
    assert lb.frontier(df.limit(0), ["g"], "x", "q", "i").count() == 0


FACT = {"schema_version": "0.3", "model": {"id": "acme/bge-nv-small", "family": "dense", "truncate_dim": 128}, "retrieval_system": {"name": "dense-flat", "family": "dense", "exact": True}, "dataset": {"benchmark": "bright", "name": "two_words", "query_rows": 50},
        "quality": {"ndcg_at_10": 0.5, "map_at_100": None}, "latency": {"e2e_query_ms_p50": 36, "latency_sample_size": 50}, "storage": {"index_bytes_fp16": 2_000_000_000, "index_bytes_int8": 1}, "run": {"precision": "fp16"}, "status": "completed"}


def facts_of(spark, *bodies):
    rows = [(i, f"p/{i}.json", None, b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return results.facts(spark.createDataFrame(rows, "file_id long, file_path string, created_at timestamp, body string"))


def test_normalised_run(spark):
    r = lb.runs(facts_of(spark, FACT)).first()
    assert (r.model_label, r.dataset_label, r.system_label) == ("BGE NV Small @128d", "BRIGHT Two Words", "Flat exact")
    assert (r.status, r.compression, r.precision, r.storage_gb, r.exact) == ("completed", "int8", "fp16", 2.0, True)


def test_facts_skip_what_is_no_fact(spark):
    assert facts_of(spark, None, "", "[]", "{", "not json", {**FACT, "schema_version": "0.2"}, {k: v for k, v in FACT.items() if k != "quality"}, {**FACT, "schema_version": 0.3}).count() == 0


def test_numbers_are_json_numbers(spark):
    odd = {**FACT, "latency": {"e2e_query_ms_p50": "36", "latency_sample_size": True}, "quality": {"ndcg_at_10": False}}
    f = facts_of(spark, odd).first()
    assert (f.e2e_ms_p50, f.sample_size, f.ndcg_at_10) == (None, None, None)


@pytest.mark.parametrize(("change", "want"), [
    ({"status": "failed"}, "failed"), ({"status": None, "latency": {"status": "skipped"}}, "quality_only"), ({"status": "odd"}, "odd"), ({"latency": {}}, "quality_only"), ({"latency": {}, "quality": {}}, "completed"), ({"status": None}, "completed")])
def test_status(spark, change, want):
    assert lb.runs(facts_of(spark, {**FACT, **change})).first().status == want


def test_backfill_sums_its_parts(spark):
    part = lambda system, family, ms, n: {**FACT, "retrieval_system": {"name": system, "family": family}, "latency": {"e2e_query_ms_p50": ms, "latency_sample_size": n}}
    hybrid = {**FACT, "retrieval_system": {"name": "hybrid-rrf-bm25-dense", "family": "hybrid"}, "latency": {}, "status": "quality_only"}
    r = lb.runs(facts_of(spark, part("sparse-bm25", "sparse", 10, 40), part("dense-hnsw", "dense", 5, 30), hybrid))
    b = lb.backfill(r).first()
    assert (b.parts, b.e2e_ms_p50, b.retrieval_ms_p50, b.sample_size, b.status) == (2, 15.0, 15.0, 30, "completed")
    alone = lb.backfill(r.where("system <> 'dense-hnsw'")).first()
    assert (alone.e2e_ms_p50, alone.status) == (None, "quality_only")


def test_coverage(spark):
    r = lb.runs(facts_of(spark, FACT, {**FACT, "dataset": {"benchmark": "bright", "name": "other", "query_rows": 500}}))
    data = spark.createDataFrame([("bright", "two_words"), ("bright", "other"), ("bright", "third")], "benchmark string, dataset string")
    req = lb.requirements(data, spark.createDataFrame([("dense-flat", "acme/bge-nv-small")], "system string, model_id string"), spark.createDataFrame([("dense-flat",), ("sparse-bm25",)], "system string"))
    assert {x.dataset for x in lb.missing(req, r).where("system = 'dense-flat'").collect()} == {"third"}
    got = {x.dataset: x[1] for x in r.select("dataset", lb.latency_problem().alias("p")).collect()}
    assert got == {"two_words": None, "other": "stale sample size 50, expected 200"}


def test_complete_configs(spark):
    df = spark.createDataFrame([("b", "d1", "m", 1.0, "completed"), ("b", "d2", "m", float("nan"), "completed"), ("b", "d1", "n", 3.0, "completed")], "benchmark string, dataset string, model string, v double, status string")
    got = lb.complete_configs(df, ["benchmark"], ["model"], measures=("v",)).collect()
    assert [(r.model, r.datasets, r.v, r.status) for r in got] == [("m", 2, 1.0, "completed")]


def test_leaderboard_has_nulls_last(spark):
    r = lb.runs(facts_of(spark, FACT, {**FACT, "retrieval_system": {"name": "dense-hnsw", "family": "dense"}, "latency": {}, "quality": {"ndcg_at_10": 0.9}}))
    for down in (True, False):
        v = lb.leaderboard(r, sort="e2e_ms_p50", descending=down).orderBy("rank").collect()
        assert [x.system for x in v] == ["dense-flat", "dense-hnsw"]


def test_files_sidecars_and_exports(spark, tmp_path):
    for name in ("a/x.json", "smoke/y.json", "sweeps/z.json", "a/x.rankings.json"):
        p = tmp_path / "in" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(json.dumps({"queries": [{"query_id": "q", "qrels": {"d": 1.0}, "hits": [{"rank": 1, "doc_id": "d", "score": 2.0}]}]} if "rankings" in name else FACT, indent=2))
    assert results.read_folder(spark, str(tmp_path / "in")).count() == 1
    side = spark.read.text(str(tmp_path / "in/a/x.rankings.json"), wholetext=True).withColumnRenamed("value", "body")
    hits = results.read_sidecar(side)
    assert [tuple(r) for r in hits.collect()] == [("q", 1, "d", 2.0)]
    back = sinks.sidecar(hits, spark.createDataFrame([("q", "d", 1.0)], "query_id string, doc_id string, rel double"), ["query_id"]).first()
    assert back.qrels == {"d": 1.0} and back.hits[0].doc_id == "d"
    r = lb.runs(facts_of(spark, FACT))
    sinks.write_export(r, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/summary")).first().runs == 1
    sinks.write_manifest(r.select("file_id", "file_path"), str(tmp_path / "m"))
    assert results.read_manifest(spark, str(tmp_path / "m")).first().file_id == "0"
    new = spark.createDataFrame([(0, 9.0)], "file_id long, e2e_ms_p50 double")
    assert sinks.merge_measurements(r, new, ["file_id"], ["e2e_ms_p50"]).first().e2e_ms_p50 == 9.0
    assert sinks.skip_rows(spark, [("b", "d", "s", "m")], "failed", "why").first().status == "failed"
    assert sinks.suffix(512, 128, kind="hnsw", m=32) == ".dim128.seq512.hnsw.m32"
