import json

import pandas as pd

import pytest

from rankloom.operators import schema_drift as sd

CATALOGUE = [("schema_version", "string", True), ("status", "string", False), ("benchmark_protocol.max_seq_length", "integer", True), ("benchmark_protocol.gpu_hourly_usd", "number", True), ("benchmark_protocol.note", "string", False)]


def frames(spark, bodies, extra=False):
    rows = [(i, f"b{i % 3}" if i else None, None, None, b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in bodies]
    files = spark.createDataFrame(rows, "file_id long, build string, created_at timestamp, ingested_at timestamp, body string")
    if extra:
        files = files.selectExpr("*", "1 as items", "'x' as month", "2 as path", "3 as field_path")
    return files, spark.createDataFrame(CATALOGUE, "field_path string, json_type string, required boolean")


def good(i, **protocol):
    p = {"max_seq_length": (256, 512)[i % 2], "gpu_hourly_usd": (1.5, 2.25)[i % 2]} | protocol
    return {"schema_version": "0.3", "status": "completed", "benchmark_protocol": {k: v for k, v in p.items() if v is not ...}, "model": {"ignored": 1}}


def found(spark, bodies, **kw):
    d = sd.detect(*frames(spark, bodies, **kw))
    return {(r.file_id, r.field_path, r.change) for r in d.changes().collect()}, d


def test_changes_of_every_kind(spark):
    bodies = [(i, good(i)) for i in range(40)]
    bodies += [(40 + i, good(i, max_seq_length=..., maxSeqLength=(256, 512)[i % 2])) for i in range(10)]  # renamed
    bodies += [(50 + i, good(i, gpu_hourly_usd=..., gpu={"usd_per_hour": "1.5"})) for i in range(10)]  # moved and retyped
    bodies += [(60, good(0, tenant="x")), (61, good(0, max_seq_length=...)), (62, good(0, max_seq_length=256.0)), (63, good(0, gpu_hourly_usd=2)), (64, good(0, max_seq_length=None)), (65, good(0, note=[1]))]
    bodies += [(66, good(0, max_seq_length=256, maxSeqLength=512))]  # both: the second is added
    got, d = found(spark, bodies)
    seq, usd = "benchmark_protocol.max_seq_length", "benchmark_protocol.gpu_hourly_usd"
    want = {(i, seq, "renamed") for i in range(40, 50)} | {(i, usd, c) for i in range(50, 60) for c in ("renamed", "retyped")}
    want |= {(60, "benchmark_protocol.tenant", "added"), (61, seq, "removed"), (62, seq, "retyped"), (65, "benchmark_protocol.note", "retyped"), (66, "benchmark_protocol.maxSeqLength", "added")}
    assert got == want
    table = {r.file_id: r for r in d.table().collect()}
    assert table[41].benchmark_protocol__max_seq_length == 512 and table[50].benchmark_protocol__gpu_hourly_usd == 1.5 and table[61].benchmark_protocol__max_seq_length is None
    assert d.report().where("change = 'renamed'").groupBy().sum("files").first()[0] == 20


def test_bodies_that_give_nothing(spark):
    got, d = found(spark, [(0, None), (1, ""), (2, "[]"), (3, '{"schema_version": '), (4, '{"a": NaN}'), (5, "{} {}"), (6, " {\"schema_version\": \"x\"} ")], extra=True)
    assert {i for i, _, _ in got} == {6} and d.table().count() == 1


def test_no_files(spark):
    files, cat = frames(spark, [(0, good(0))])
    d = sd.detect(files.limit(0), cat)
    assert d.changes().count() == 0 and d.table().count() == 0 and d.report().count() == 0


def test_redelivered_files_count_once(spark):
    got, d = found(spark, [(7, good(0, x=1)), (7, good(0, x=1))])
    assert got == {(7, "benchmark_protocol.x", "added")} and d.table().count() == 1


@pytest.mark.parametrize(("a", "b", "least"), [("seq", "seq", 1.0), ("sample", "samples", 1.0), ("warm", "warmup", 0.8), ("cat", "dog", 0.0)])
def test_words(a, b, least):
    assert sd.token_similarity(a, b) == least


def test_name_words():
    assert sd.name_tokens("benchmark_protocol.gpuHourly.usd_perHour2") == ["gpu", "hourly", "usd", "per", "hour", "2"]


def statistics(*rows):
    """(path, field_path, shared values, same type) of pairs whose catalogue field is always absent."""
    return pd.DataFrame([{"path": a, "field_path": b, "n": 20, "absent": 20, "files": 100, "field_absent": 20, "shared": v, "rare": v, "types": t} for a, b, v, t in rows])


def chosen(stats, rounds):
    p = sd.FloodParameters(rounds=rounds)
    got = sd.select_pairs(sd.flood(stats, p), p).sort_values("score", ascending=False).drop_duplicates("field_path")
    return dict(zip(got.field_path, got.path))


def test_flow_from_values_overturns_a_misleading_name():
    stats = statistics(("p.trial_queries", "p.warmup_queries", 1.0, 1.0), ("p.warmup_queries_note", "p.warmup_queries", 0.0, 0.0))
    assert chosen(stats, 0) == {"p.warmup_queries": "p.warmup_queries_note"}  # names alone are wrong
    assert chosen(stats, 100) == {"p.warmup_queries": "p.trial_queries"}


def test_siblings_identify_a_leaf_of_a_moved_object():
    moved = [(f"p.rig.{x}", f"p.{x}", 1.0, 1.0) for x in ("seed", "size", "mode")]
    stats = statistics(*moved, ("p.rig.zeta", "p.label", 0.0, 1.0), ("p.other.omega", "p.label", 0.0, 1.0))
    want = {f"p.{x}": f"p.rig.{x}" for x in ("seed", "size", "mode")}
    assert chosen(stats, 0) == want and chosen(stats, 100) == want | {"p.label": "p.rig.zeta"}


def test_scores_do_not_depend_on_unrelated_paths():
    stats = statistics(("p.maxLen", "p.max_len", 0.4, 1.0), ("p.dtype", "p.precision", 1.0, 1.0))
    more = statistics(*[(f"q.u{i}", "q.other", 0.1, 1.0) for i in range(50)])
    a, b = sd.flood(stats), sd.flood(pd.concat([stats, more]))
    assert abs(a.score.to_numpy() - b.score.to_numpy()[:2]).max() < 1e-3


def test_long_values_and_huge_numbers_are_told_apart():
    a, b = sd.value_tokens("x" * 90 + "1"), sd.value_tokens("x" * 90 + "2")
    assert a != b and a == sd.value_tokens("X" * 90 + "1 ")
    assert sd.value_tokens(10**400) != sd.value_tokens(10**400 + 1) and sd.value_tokens(1e305) != sd.value_tokens(1e306)


def test_any_depth(spark):
    deep = '{"a":' * 50_000 + "1" + "}" * 50_000
    got, _ = found(spark, [(1, json.dumps(good(0))[:-1] + f', "deep": {deep}}}'), (2, json.dumps(good(0))[:-1] + ', "list": ' + "[" * 50_000 + "]" * 50_000 + "}")])
    assert {(i, c, len(f)) for i, f, c in got} == {(1, "added", 4 + 2 * 50_000), (2, "added", 4)}
