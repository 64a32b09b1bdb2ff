import random

import numpy as np
import pytest

from rankloom.llm import mixing


def by_seat(w, seats, cap):
    q = [0] * len(w)
    for _ in range(seats):
        able = [(w[i] / (2 * q[i] + 1), -i) for i in range(len(w)) if q[i] < cap[i] and w[i] > 0]
        if not able:
            break
        q[-max(able)[1]] += 1
    return q


@pytest.mark.parametrize("seed", range(4))
def test_apportionment_equals_seat_by_seat(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        w = rng.integers(0, 40, rng.integers(1, 12)).astype(float)
        seats, cap = int(rng.integers(0, 80)), rng.integers(0, 25, len(w))
        assert list(mixing.sainte_lague(w, seats, cap)) == by_seat(w, seats, cap)
        assert list(mixing.sainte_lague(w, seats)) == by_seat(w, seats, [10**6] * len(w))


def test_apportionment_of_odd_weights():
    assert list(mixing.sainte_lague(np.array([]), 5)) == []
    assert list(mixing.sainte_lague(np.array([np.nan, 0.0, -1.0]), 5)) == [0, 0, 0]
    assert mixing.sainte_lague(np.array([1.0, 1e12]), 10**9).sum() == 10**9


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as size", "2 as shard", "3 as block", "4 as copies", "5 as available")


def targets(spark, rows):
    return spark.createDataFrame(rows, "recipe string, source string, weight double, max_repeats int, size_factor double")


@pytest.fixture(scope="module")
def mixture(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([" A", "a\t", "a", "b", "B ", None, " "]) if i % 3 else "a", "x" * rng.randrange(0, 400) if i % 17 else None) for i in range(3000)]
    rows += [(5000, "c", "y" * 900), (5001, "c", "")]
    want = [("r", "A ", 1.0, 3, 0.5), ("r", "A ", 1.0, 3, 0.5), ("r", "b", 1.0, 1, 0.5), ("r", "c", 1.0, 2, 0.5), ("r", "nowhere", 1.0, 9, 0.5), ("r", "b", None, 1, 0.5), ("s", "b", 2.0, 4, 1.0), (None, "b", 1.0, 1, 1.0), ("z", "a", 0.0, 1, 1.0)]
    m = mixing.mix(docs(spark, rows), targets(spark, want), shard_tokens=40_000, block_tokens=2_000)
    sizes = {}
    for i, s, t in rows:
        if s and s.strip() and t:
            sizes.setdefault(s.strip().lower(), {})[i] = len(t)
    return m, sizes


def test_shares_and_caps(mixture):
    m, sizes = mixture
    rep = {(r.recipe, r.source): r for r in m.report(m.selection()).collect()}
    have = {s: sum(v.values()) for s, v in sizes.items()}
    wanted = 0.5 * sum(have[s] for s in "abc")
    for s, cap in (("a", 3), ("b", 1), ("c", 2), ("nowhere", 9)):
        r = rep["r", s]
        assert r.available == have.get(s, 0) and r.target == pytest.approx(wanted / 4) and r.short == (have.get(s, 0) * cap < wanted / 4)
        if r.short:
            assert r.reached <= cap * have.get(s, 0)
        else:
            assert abs(r.reached - r.target) <= max(200, 0.01 * r.target)
    assert rep["r", "c"].short and rep["r", "c"].reached == 2 * have["c"]
    assert rep["s", "b"].reached == have["b"]
    assert rep["z", "a"].reached == 0 and (None, "b") not in rep


def test_selection_adds_up(mixture):
    m, sizes = mixture
    caps = {("r", "a"): 3, ("r", "b"): 1, ("r", "c"): 2, ("s", "b"): 4}
    total = {}
    for r in m.selection().collect():
        assert r.size == sizes[r.source][r.doc_id] and 1 <= r.copies <= caps[r.recipe, r.source]
        total[r.recipe, r.source] = total.get((r.recipe, r.source), 0) + r.size * r.copies
    assert total == {(r.recipe, r.source): r.reached for r in m.report(m.selection()).collect() if r.reached}


def test_empty(spark):
    d, t = docs(spark, [(1, "a", "x")]), targets(spark, [("r", "a", 1.0, 1, 1.0)])
    assert mixing.mix(d, t.limit(0)).sources.count() == 0
    m = mixing.mix(d.limit(0), t)
    assert [(r.available, r.reached, r.short) for r in m.report(m.selection()).collect()] == [(0, 0, False)] and m.selection().count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_choice_of_a_shard_ends_near_its_quota(seed):
    rng = np.random.default_rng(seed)
    size = np.maximum(1, rng.lognormal(6, 1.5, rng.integers(1, 400)).astype(np.int64))
    for share in (0.001, 0.2, 0.999, 1.0, 2.7):
        wanted = int(size.sum() * share)
        copies = mixing.choose(size, wanted, 3, 2_000, seed)
        assert copies.max() <= 3 and copies.max() - copies.min() <= 1
        bound = size[copies == copies.min()].min() if copies.max() > copies.min() else size.max()
        assert abs(int((copies * size).sum()) - wanted) <= bound / 2


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_shares_of_the_given_tables(spark, folder):
    from rankloom.llm import queries

    rows = queries.p7_shares_kept(spark, folder).collect()
    assert len(rows) > 50 and all(r.share_kept and r.cap_kept for r in rows)


def test_shards_in_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_GROUP", 3)
    d = docs(spark, [(i, "a" if i % 4 else "b", "x" * (50 + i % 200)) for i in range(2000)])
    m = mixing.mix(d, targets(spark, [("r", "a", 3.0, 2, 0.7), ("r", "b", 1.0, 2, 0.7)]), shard_tokens=10_000, block_tokens=1_000)
    for r in m.report(m.selection()).collect():
        assert abs(r.reached - r.target) <= 0.01 * r.target
