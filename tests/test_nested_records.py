import json

import pytest

from rankloom.operators import json_walk
from rankloom.operators import nested_records as nr

BODY = {"latency": {"p50": 1.5, "a": [{"x": 1, "b": {"c": [{"y": 1}, None, {"y": "two"}]}}, None, {"x": 2.5}], "s": [1, 2], "m": [[{"z": 1}]]}, "storage": json.dumps({"t": [{"k": "v"}]}), "quality": [{"q": 1}], "other": {"a": [{}]}}


def frame(spark, *bodies):
    return spark.createDataFrame([(i, b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "file_id long, body string").selectExpr("*", "0 as kind", "1 as nodes", "2 as ordinal")


def paths(df, file=0):
    return {(r.parent_path, r.node_path) for r in df.where("ordinal is not null").collect() if r.file_id == file}


def test_nodes_by_hand(spark):
    df = nr.explode_records(frame(spark, BODY))
    assert paths(df) == {
        ("latency", "latency.a[0]"), ("latency.a[0]", "latency.a[0].b.c[0]"), ("latency.a[0]", "latency.a[0].b.c[2]"), ("latency", "latency.a[2]"), ("latency", "latency.m[0][0]"), ("storage", "storage.t[0]"), ("quality", "quality[0]")}
    by = {r.node_path: r for r in df.collect()}
    for r in by.values():  # parent numbers lead to parent paths
        assert r.parent_no is None or by[r.parent_path].node_no == r.parent_no
    assert {f.name: f.text for f in by["latency"].fields} == {"p50": "1.5", "s": "[1, 2]"}


def test_texts_and_lone_objects(spark):
    other = {"latency": {"a": {"x": 9, "b": {"c": json.dumps([{"y": 3}])}}, "lone": {"v": 1}}, "storage": {"t": [json.dumps({"k": 1}), "plain", 5]}}
    df = nr.explode_records(frame(spark, BODY, other), with_fields=False)
    assert paths(df, 1) == {("latency", "latency.a[0]"), ("latency.a[0]", "latency.a[0].b.c[0]"), ("storage", "storage.t[0]")}


def test_mixed_paths_by_join(spark, monkeypatch):
    other = {"latency": {"a": {"x": 9}}}
    want = paths(nr.explode_records(frame(spark, BODY, other)), 1)
    monkeypatch.setattr(nr, "LIST_LIMIT", 0)
    assert paths(nr.explode_records(frame(spark, BODY, other)), 1) == want == {("latency", "latency.a[0]")}


def test_useless_bodies_and_repeats(spark):
    f = frame(spark, None, "", "{", "[1]", {"latency": None, "storage": 5, "quality": "text"}, {})
    assert nr.explode_records(f).count() == 0
    assert nr.explode_records(f.limit(0)).count() == 0
    twice = frame(spark, BODY).unionByName(frame(spark, BODY))
    assert nr.explode_records(twice).count() == nr.explode_records(frame(spark, BODY)).count()


def test_flat_tables(spark):
    t = nr.flat_tables(nr.explode_records(frame(spark, BODY)))
    assert set(t) == {"latency", "latency.a", "latency.a.b.c", "latency.m", "storage", "storage.t", "quality"}
    assert [(r.ordinal, r.f_x) for r in t["latency.a"].orderBy("ordinal").collect()] == [(0, 1.0), (2, 2.5)]
    assert dict(t["latency.a.b.c"].dtypes)["f_y"] == "string"
    joined = t["latency.a.b.c"].alias("c").join(t["latency.a"].alias("p"), ["file_id"]).where("c.parent_no = p.node_no")
    assert joined.count() == 2


def test_any_depth(spark):
    objects = '{"latency": ' + '{"k": ' * 50_000 + '[{"x": 1}]' + "}" * 50_000 + "}"
    lists = '{"latency": ' + '{"m": [' * 1_500 + "[]" + "]}" * 1_500 + "}"
    got = nr.explode_records(frame(spark, BODY, objects, lists, objects[:-1])).where("ordinal is not null")
    assert {r.file_id: r.n for r in got.groupBy("file_id").agg({"*": "count"}).toDF("file_id", "n").collect()}.keys() >= {1, 2}
    rows = got.where("file_id = 1").collect()
    assert [(len(r.node_path), r.parent_path, [tuple(f) for f in r.fields]) for r in rows] == [(7 + 2 * 50_000 + 3, "latency", [("x", "integer", "1")])]
    assert got.where("file_id = 2").count() == 1_499 and got.where("file_id = 3").count() == 0


def test_deep_reader_and_writer_agree_with_the_standard_ones():
    for text in ('{"a": [1, -2.5e3, true, null, {"b": "\\u00e9\\n", "c": {}, "a": []}], "d": "x"}', "[]", '{"a":{"a":1},"a":2}', " 7 "):
        assert json_walk._load_deep(text) == json.loads(text)
    for text in ("{", "[1,]", '{"a" 1}', "[1] 2", "nul", '{"a":1,}', "01", '"\n"'):
        with pytest.raises(ValueError):
            json_walk._load_deep(text)
    deep = json_walk._load_deep("[" * 30_000 + '{"a": 1}' + "]" * 30_000)
    assert json_walk.dump(deep) == "[" * 30_000 + '{"a": 1}' + "]" * 30_000
