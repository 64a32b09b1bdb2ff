import random

import numpy as np
import pytest

from rankloom.llm import packing


def packed(spark, sizes, caps, **kw):
    items = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, size long").selectExpr("*", "1 as cap", "2 as block", "3 as model_id")
    limits = spark.createDataFrame(caps, "model_id string, capacity int")
    return packing.pack(items, limits, **kw), limits


def check(rows, sizes, caps):
    caps = {m: c for m, c in caps if m and c and c > 0}
    load, cover = {}, {}
    for r in rows:
        load[r.model_id, r.sequence] = load.get((r.model_id, r.sequence), 0) + r.length
        cover.setdefault((r.model_id, r.doc_id), []).append((r.start, r.length))
    assert all(v <= caps[m] for (m, _), v in load.items())
    assert set(cover) == {(m, i) for m in caps for i, s in enumerate(sizes) if s and s > 0}
    for (m, i), parts in cover.items():  # every token once; a text is cut only if it exceeds the capacity
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == sizes[i] and (len(parts) == 1) == (sizes[i] <= caps[m])
    return load


@pytest.mark.parametrize("seed", range(2))
def test_every_token_once_within_capacity(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, None, 1, 1024, 1025, 5000, rng.randrange(1, 900), rng.randrange(1, 300)]) for _ in range(800)]
    caps = [("a", 1024), ("a", 1024), ("b", 300), ("none", None), ("zero", 0), (None, 5)]
    df, limits = packed(spark, sizes, caps, block_sequences=64)
    load = check(df.collect(), sizes, caps)
    rep = {r.model_id: r for r in packing.fill_report(df).collect()}
    for m, c in (("a", 1024), ("b", 300)):
        total = sum(min(s, 10**9) for s in sizes if s)
        assert rep[m].tokens == total and rep[m].sequences == sum(1 for k in load if k[0] == m) and rep[m].unused == rep[m].sequences * c - total


def test_few_tokens_are_unused(spark):
    rng = random.Random(9)
    sizes = [max(1, int(rng.lognormvariate(6, 0.8))) for _ in range(3000)]
    df, limits = packed(spark, sizes, [("m", 4096)])
    assert packing.fill_report(df).first().fill >= 0.98


def test_cost_is_balanced():
    sizes = np.array(sorted([900] * 10 + [100] * 90, reverse=True))
    seq = packing.pack_block(sizes, 2000)
    costs = np.bincount(seq, weights=packing.cost(sizes, 1 / 2048))
    assert len(costs) == 9 and costs.max() / costs.min() < 1.6


def test_blocks_by_item_count(spark):
    df, _ = packed(spark, [1] * 500, [("m", 10_000)], block_items=100)
    assert df.count() == 500 and df.select("sequence").distinct().count() >= 4


def test_empty(spark):
    df, limits = packed(spark, [0, None], [("m", 10)])
    assert df.count() == 0 and packing.fill_report(df).count() == 0
    assert packed(spark, [5], [("m", None)])[0].count() == 0


def test_two_capacities_of_a_model(spark):
    df, _ = packed(spark, [300] * 50, [("m", 1000), ("m", 2000)])
    rows = df.collect()
    assert len(rows) == 100 and {r.capacity for r in rows} == {1000, 2000}
    rep = {r.capacity: r for r in packing.fill_report(df).collect()}
    assert [(rep[c].items, rep[c].tokens) for c in (1000, 2000)] == [(50, 15_000)] * 2
    kept = packing.packing_kept(df, 0.9).collect()
    assert all(r.fits and r.pieces == 50 for r in kept)
