from __future__ import annotations

import datetime as dt
import random

from lorespark.operators.sessions import resolve_roots, sessionize

T0 = dt.datetime(2020, 1, 1)


def brute(rows, gap):
    once = {}
    for p, i, t in rows:
        if None not in (p, i, t):
            once[p, i] = min(once.get((p, i), t), t)
    out, by = set(), {}
    for (p, i), t in once.items():
        by.setdefault(p, []).append((t, i))
    for p, es in by.items():
        es.sort()
        start = n = 0
        for k, (t, _) in enumerate(es):
            if k and (t - es[k - 1][0]).total_seconds() > gap:
                out.add((p, es[start][1], es[k - 1][1], n))
                start, n = k, 0
            n += 1
        out.add((p, es[start][1], es[-1][1], n))
    return out


def run(spark, rows, gap=10800):
    df = spark.createDataFrame(rows, "peer long, id long, at timestamp, first_id string, ent long, node string")
    return {(r.peer, r.first_id, r.last_id, r.n_events) for r in sessionize(df, "peer", "at", "id", gap).collect()}


def test_against_brute_force_with_a_hot_peer(spark):
    rng = random.Random(1)
    rows = [(7 if rng.random() < 0.5 else rng.randint(1, 20), rng.randint(1, 300), T0 + dt.timedelta(seconds=rng.randint(0, 3_000_000))) for _ in range(1500)]
    rows += rows[:50] + [(None, 1, T0), (1, None, T0), (1, 2, None)]
    assert run(spark, [(*r, "x", 1, "y") for r in rows]) == brute(rows, 10800)


def test_gap_is_exclusive_and_long_chains_join(spark):
    h = dt.timedelta(hours=3)
    rows = [(1, k, T0 + k * h) for k in range(70)] + [(1, 99, T0 + 69 * h + h + dt.timedelta(microseconds=1))]
    assert run(spark, [(*r, None, None, None) for r in rows]) == {(1, 0, 69, 70), (1, 99, 99, 1)}


def test_ties_and_empty(spark):
    assert run(spark, [(1, 2, T0, None, None, None), (1, 1, T0, None, None, None)]) == {(1, 1, 2, 2)}
    assert run(spark, []) == set()


def test_resolve_roots(spark):
    df = spark.createDataFrame([("a", i, i - 1) for i in range(1, 40)] + [("b", 5, 4)], "k string, node long, ptr long")
    got = {(r.k, r.node): r.ptr for r in resolve_roots(df, ["k"]).collect()}
    assert all(got["a", i] == 0 for i in range(1, 40)) and got["b", 5] == 4
