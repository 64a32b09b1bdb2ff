import numpy as np
import pytest

from rankloom.llm import neighbours as nn


def cloud(n, seed=1, dims=64, topics=15):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((topics, dims)) * 1.5
    return (c[rng.integers(0, topics, n)] + rng.standard_normal((n, dims))).astype(np.float32)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, model_id string, embedding array<float>").selectExpr("*", "1 as h1", "2 as ids", "3 as grp", "4 as qid").repartition(3)


def exact(x, ids, q, qid, k=10):
    unit = lambda a: a.astype(float) / np.linalg.norm(a.astype(float), axis=1)[:, None]
    s = np.round(unit(q) @ unit(x).T, 6)
    return {i: [ids[j] for j in np.lexsort((ids, -s[r])) if ids[j] != i][:k] for r, i in enumerate(qid)}


def test_recall_against_brute_force(spark):
    x = cloud(4000)
    rows = [(i, "m", v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: [h.id for h in r.hits] for r in nn.nearest(frame(spark, rows), frame(spark, rows)).collect()}
    want = exact(x, np.arange(4000), x, range(4000))
    assert len(got) == 4000 and all(len(v) == 10 for v in got.values())
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want]) >= 0.95


def test_exact_copies_blocks_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(nn, "GROUP_ROWS", 64)
    monkeypatch.setattr(nn, "WORK_PAIRS", 4_000)
    x = cloud(300, 2)
    x[100:200] = x[7]  # a third are copies of one vector
    rows = [(i, "m", v.tolist()) for i, v in enumerate(x)]
    odd = [(900, "m", None), (901, "m", [0.0] * 64), (902, "m", [float("nan")] + [1.0] * 63), (903, "m", [1.0] * 32), (904, None, x[0].tolist()), (None, "m", x[0].tolist()), (905, "m", [None] + [1.0] * 63), (906, "m", [float("inf")] * 64), (5, "m", x[5].tolist())]
    df = frame(spark, rows + odd)
    got = {r.vec_id: [h.id for h in r.hits] for r in nn.nearest(df, df, 10, nn.SearchParameters(risk=0.0)).collect()}
    assert got == exact(x, np.arange(300), x, range(300))


def test_models_are_apart_and_lists_may_be_short(spark):
    x = cloud(30, 3)
    df = frame(spark, [(i, "a" if i < 5 else "b", v.tolist()) for i, v in enumerate(x)])
    lists = nn.nearest(df, df)
    got = {r.vec_id: [h.id for h in r.hits] for r in lists.collect()}
    assert all(len(got[i]) == 4 and max(got[i]) < 5 for i in range(5)) and all(len(got[i]) == 10 and min(got[i]) >= 5 for i in range(5, 30))
    assert nn.neighbour_rows(lists).count() == 5 * 4 + 25 * 10


def test_mutual_pairs(spark):
    x = cloud(200, 4)
    q = x[:20] + 0.01
    index, ask = frame(spark, [(i, "m", v.tolist()) for i, v in enumerate(x)]), frame(spark, [(1000 + i, "m", v.tolist()) for i, v in enumerate(q)])
    got = {(r.vec_a, r.vec_b) for r in nn.mutual_pairs(index, ask).collect()}
    assert {(i, 1000 + i) for i in range(20)} <= got and not any(a >= 1000 for a, _ in got)


def test_empty(spark):
    df = frame(spark, [(1, "m", cloud(1)[0].tolist())])
    assert nn.nearest(df.limit(0), df).count() == 0 and nn.nearest(df, df.limit(0)).count() == 0
    assert nn.mutual_pairs(df, df.limit(0)).count() == 0
    assert [r.hits for r in nn.nearest(df, df).collect()] in ([], [[]])


def fitted(n, k=10, **kw):
    p = nn.SearchParameters(**kw)
    x = nn.unit(cloud(n, 5), p.dims)
    cells = nn.fit_cells(x, n, n, k, p)
    turned = (x @ cells.rotation).astype(np.float32)
    return p, cells, turned, nn.nearest_cells(turned, cells.centres, p.probes)


def test_test_acts_and_keeps_the_best():
    p, cells, x, near = fitted(6000)
    told = []
    i, s, j = nn.best_of_cells(x, near.astype(np.int64), np.full(len(x), -np.inf), x, near[:, 0], 11, cells, p, told)
    alive = np.sum(told, axis=0) / np.sum(told, axis=0)[0]
    assert alive[1] < 0.3 and alive[-1] < 0.02  # most candidates are gone after 16 of 64 columns
    want = np.argsort(-(x @ x.T), axis=1)[:, :11]
    got = [set() for _ in x]
    for a, b in zip(i.tolist(), j.tolist()):
        got[a].add(b)
    assert np.mean([len(g & set(w)) / 11 for g, w in zip(got, want.tolist())]) >= 0.95


@pytest.mark.parametrize("threshold", [0.2, 0.9])
def test_picking_survivors_does_not_change_them(threshold):
    p, cells, x, _ = fitted(800)
    limit = np.full(300, threshold)
    i, s, j = nn.adaptive_scan(x[:300], x, limit, cells.share, p)
    one = [nn.adaptive_scan(x[a : a + 1], x[b : b + 1], limit[:1], cells.share, p) for a in range(0, 300, 29) for b in range(0, 800, 7)]
    pairs = set(zip(i.tolist(), j.tolist()))
    alone = {(a, b) for (a, b), r in zip(((a, b) for a in range(0, 300, 29) for b in range(0, 800, 7)), one) if len(r[0])}
    assert alone == {(a, b) for a, b in pairs if a % 29 == 0 and b % 7 == 0}
    assert np.allclose(s, (x[i] * x[j]).sum(axis=1), atol=1e-5)


def test_no_neighbours_known_gives_the_exact_bound():
    p, cells, x, near = fitted(12)
    assert (cells.share == 1).all()
    i, _, _ = nn.best_of_cells(x, near.astype(np.int64), np.full(12, -np.inf), x, near[:, 0], 5, cells, p)
    assert (np.bincount(i) == 5).all()


def test_several_groups_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(nn, "GROUP_ROWS", 500)
    monkeypatch.setattr(nn, "WORK_PAIRS", 100_000)
    x = cloud(3000, 8)
    rows = [(i, "m", v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: [h.id for h in r.hits] for r in nn.lists(frame(spark, rows[:2500]), frame(spark, rows[2500:]), frozenset({"ii", "qi"}), 10, nn.SearchParameters()).collect()}
    want = exact(x[:2500], np.arange(2500), x, range(3000))
    assert len(got) == 3000 and np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want]) >= 0.93
