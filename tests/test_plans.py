"""Ordered scans, as-of look-ups and order statistics against plain loops."""

import random

from pyspark.sql import functions as F

from colloquy.plans.intervals import as_of, overlap_join, point_join
from colloquy.plans.order_statistic import value_at_rank
from colloquy.plans.scan import ordinal, position_chunk, running


def skewed_rows(n, rng):
    """Two thirds of all rows under one key, gaps in the positions."""
    rows = []
    for key, count in (("hot", 2 * n // 3), ("b", n // 4), ("c", n // 12)):
        at = 0
        for _ in range(count):
            at += rng.choice([1, 1, 1, 2, 9])
            rows.append((key, at, rng.choice([None, rng.randint(-5, 5)])))
    rng.shuffle(rows)
    return rows


def test_running_scans_cross_chunks(spark):
    rows = skewed_rows(300, random.Random(1))
    df = spark.createDataFrame(rows, "k string, i long, v long")
    scans = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}
    for inclusive in (True, False):
        got = {
            (r.k, r.i): (r.s, r.m, r.l)
            for r in running(
                df, ["k"], position_chunk("i", 16), [F.col("i")], scans, inclusive
            ).collect()
        }
        for key in ("hot", "b", "c"):
            seen = []
            for k, i, v in sorted(r for r in rows if r[0] == key):
                if inclusive and v is not None:
                    seen.append(v)
                assert got[(k, i)] == (
                    sum(seen), max(seen, default=None), seen[-1] if seen else None
                )
                if not inclusive and v is not None:
                    seen.append(v)


def test_backward_scan(spark):
    rows = skewed_rows(200, random.Random(2))
    df = spark.createDataFrame(rows, "k string, i long, v long")
    back = running(
        df, ["k"], position_chunk(-F.col("i"), 8), [-F.col("i")], {"m": ("min", F.col("v"))}
    )
    for r in back.collect():
        later = [v for k, i, v in rows if k == r.k and i >= r.i and v is not None]
        assert r.m == min(later, default=None)


def test_ordinal(spark):
    rows = skewed_rows(200, random.Random(3))
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = ordinal(df, ["k"], position_chunk("i", 10), [F.col("i")], "p").collect()
    for r in got:
        assert r.p == sum(1 for k, i, _ in rows if k == r.k and i < r.i)


def test_as_of_both_ways(spark):
    rng = random.Random(4)
    events = [("a", round(rng.uniform(0, 300), 1), j) for j in range(80)]
    probes = [("a", round(rng.uniform(-10, 310), 1)) for _ in range(60)] + [("none", 1.0)] * 3
    ev = spark.createDataFrame(events, "k string, at double, j long")
    pr = spark.createDataFrame(probes, "k string, t double")
    for forward in (False, True):
        kind = "min" if forward else "max"
        found = as_of(
            pr, ev, ["k"], "t", "at", {"x": (kind, F.col("j"))}, forward=forward, seconds=20.0
        )
        rows = found.collect()
        assert len(rows) == len(set(probes))
        for r in rows:
            hits = [
                j for k, at, j in events if k == r.k and (at >= r.t if forward else at <= r.t)
            ]
            assert r.x == ((min if forward else max)(hits) if hits else None)


def test_interval_joins_give_each_pair_once(spark):
    rng = random.Random(5)
    left = [("a", i, s := rng.uniform(0, 200), s + rng.uniform(0, 70)) for i in range(40)]
    right = [("a", i, s := rng.uniform(0, 200), s + rng.uniform(0, 70)) for i in range(40)]
    a = spark.createDataFrame(left, "k string, i long, s double, e double")
    b = spark.createDataFrame(right, "k string, j long, s2 double, e2 double")
    pairs = [
        (r.i, r.j)
        for r in overlap_join(a, b, ["k"], ("s", "e"), ("s2", "e2"), seconds=15.0).collect()
    ]
    want = [
        (i, j) for _, i, s, e in left for _, j, s2, e2 in right if min(e, e2) - max(s, s2) > 0
    ]
    assert sorted(pairs) == sorted(want)
    hits = point_join(a, b, ["k"], "s", ("s2", "e2"), seconds=15.0)
    got = sorted((r.i, r.j) for r in hits.collect())
    assert got == sorted((i, j) for _, i, s, _ in left for _, j, s2, e2 in right if s2 <= s < e2)


def test_value_at_rank_is_exact(spark):
    rng = random.Random(6)
    rows = [("hot", 1.25)] * 200 + [("hot", rng.gauss(0, 3)) for _ in range(150)]
    rows += [("b", float(i)) for i in range(1, 11)]
    df = spark.createDataFrame(rows, "k string, v double")
    tenth = F.floor(F.col("_n") / 10).cast("long")
    got = {r.k: (r["_n"], r.x) for r in value_at_rank(df, ["k"], "v", tenth, "x").collect()}
    for key in ("hot", "b"):
        values = sorted(v for k, v in rows if k == key)
        assert got[key] == (len(values), values[len(values) // 10])
    assert got["b"] == (10, 2.0)
