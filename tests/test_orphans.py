import datetime as dt
import random

import pytest

from rankloom.operators import orphans as o


def day(n):
    return None if n is None else dt.datetime(2026, 1, 1) + dt.timedelta(days=n)


def refs(spark, rows):
    df = spark.createDataFrame([(i, ns, k, day(a)) for i, ns, k, a in rows], "id long, ns0 string, k0 string, t timestamp").selectExpr("*", "1 as side", "2 as at", "3 as key", "4 as ref_id")
    return o.references(df, "id", "ns0", {"doc": "k0"}, "t")


def owners(spark, rows):
    df = spark.createDataFrame([(ns, k, day(a), day(b)) for ns, k, a, b in rows], "ns0 string, k0 string, a timestamp, b timestamp").selectExpr("*", "1 as side", "2 as start", "3 as end", "4 as key")
    return o.parents(df, "doc", "ns0", "k0", "a", "b")


def brute(rs, ps):
    tidy = lambda s: None if s is None else s.strip().lower()
    out = set()
    for i, ns, k, at in rs:
        k = tidy(k)
        if not k:
            continue
        own = [(a, b) for n, q, a, b in ps if tidy(q) == k and (tidy(n) or "") == (tidy(ns) or "")]
        if not own:
            out.add((i, "missing"))
        elif at is not None and not any((a is None or a <= at) and (b is None or at < b) for a, b in own):
            out.add((i, "deleted" if any(a is None or a <= at for a, _ in own) else "late"))
    return out


def found(r, p, hot=None):
    return {(x.ref_id, x.reason) for x in o.find_orphans(r, p, hot).collect()}


CASES = [(1, "d", " K\t", 5), (2, "d", "gone", 5), (3, "d", "k", 15), (4, "d", "k", 20), (5, "d", "new", 5), (6, "d", None, 5), (7, "d", "  ", 5), (8, "e", "k", 5), (9, None, "k", 5), (10, "d", "none", None), (11, "d", "new", None), (12, "d", "never", 5), (13, "d", "ever", 0), (1, "d", " K\t", 5)]
OWN = [("d", "k", 0, 10), ("D ", "K", 18, None), ("d", "gone", None, 5), ("d", "new", 6, None), ("d", "never", 3, 3), ("d", "ever", None, None), ("d", "ever", None, None), ("d", None, 0, None), (None, "k", 5, 6)]


def test_cases_by_hand(spark):
    assert found(refs(spark, CASES), owners(spark, OWN)) == brute(CASES, OWN) == {(2, "deleted"), (3, "deleted"), (5, "late"), (8, "missing"), (10, "missing"), (12, "deleted")}


def test_empty_tables(spark):
    assert found(refs(spark, CASES), owners(spark, [("x", "y", 0, 1)]).limit(0)) == {(i, "missing") for i, _, k, _ in CASES if k and k.strip()}
    assert found(refs(spark, CASES).limit(0), owners(spark, OWN)) == set()


@pytest.mark.parametrize("hot", [None, 40])
def test_random_against_brute_force(spark, hot):
    rng = random.Random(3)
    key = lambda: "hot" if rng.random() < 0.4 else f"k{rng.randrange(12)}"
    rs = [(i, "d", key(), None if rng.random() < 0.05 else rng.randrange(100)) for i in range(500)]
    ps = [("d", key(), None if rng.random() < 0.1 else (a := rng.randrange(100)), None if rng.random() < 0.1 else rng.randrange(100)) for _ in range(160)]
    assert found(refs(spark, rs), owners(spark, ps), hot) == brute(rs, ps)


def test_report(spark):
    r = refs(spark, CASES)
    rep = o.orphan_report(r, o.find_orphans(r, owners(spark, OWN))).collect()
    assert sum(x.refs for x in rep) == 11 and sum(x.missing for x in rep) == 2 and {x.month for x in rep} == {"2026-01", None}
