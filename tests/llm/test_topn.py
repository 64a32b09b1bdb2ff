import random

import pytest

from rankloom.llm import topn


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, "s string, q string, d string, score double").selectExpr("*", "1 as g0", "2 as item", "3 as nth", "4 as place").repartition(parts)


def brute(rows, n):
    best = {}
    for s, q, d, x in rows:
        if None in (s, q, d, x) or x != x or abs(x) == float("inf"):
            continue
        best[s, q, d] = max(best.get((s, q, d), -1e300), x + 0.0)
    out = set()
    for g in {k[:2] for k in best}:
        own = sorted(((-x, k[2].encode()) for k, x in best.items() if k[:2] == g))
        out |= {(*g, d.decode(), i + 1) for i, (_, d) in enumerate(own[:n])}
    return out


def found(df, n=3):
    return {(r.s, r.q, r.d, r.place) for r in topn.top_n(df, ["s", "q"], "d", "score", n).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_against_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(topn, "CHUNK_ROWS", 50)
    pick = lambda xs: rng.choice(xs)
    rows = [(pick(["a", "b", None]), "hot" if rng.random() < 0.4 else pick(["q1", "q2", "q3", None]), pick([f"d{i}" for i in range(40)] + ["é", "Z", None]), pick([0.5, 0.25, 0.0, -0.0, rng.random(), None, float("nan"), float("inf"), -float("inf")])) for _ in range(1500)]
    assert found(frame(spark, rows)) == brute(rows, 3)


def test_all_rows_tie(spark):
    rows = [("a", "q", f"d{i:03}", 1.0) for i in range(300)] * 3
    assert found(frame(spark, rows)) == {("a", "q", "d000", 1), ("a", "q", "d001", 2), ("a", "q", "d002", 3)}


def test_bounds_drop_what_is_below(spark):
    rows = [("a", "q", f"d{i}", float(i)) for i in range(1000)]
    assert found(frame(spark, rows, 8)) == brute(rows, 3)


def test_empty(spark):
    df = frame(spark, [("a", "q", "d", 1.0)])
    assert found(df.limit(0)) == set() and found(df.where("s = 'none'")) == set()
