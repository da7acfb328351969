"""Running values in a global order, and medians, against plain Python."""

import itertools
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallymark.operators import ordered


def test_running_sums_and_neighbours(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "b", None]), k, rng.randint(0, 3)) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(7)
    ranges = ordered.in_ranges(df, ["k"], 5)
    assert ranges.select("_part").distinct().count() > 1
    got = {r.k: r for r in ordered.running_sums(ranges, ["g"], {"s": F.col("v"), "n": F.lit(1)}).collect()}
    near = {r.k: r for r in ordered.neighbours(ranges, ["g"], "v", "p", "x").collect()}
    assert len(got) == len(near) == 500
    for g in ("a", "b", None):
        own = [(k, v) for x, k, v in rows if x == g]
        for i, (k, _) in enumerate(own):
            assert (got[k].s, got[k].n) == (sum(v for _, v in own[:i]), i)
            assert (near[k].p, near[k].x) == (own[i - 1][1] if i else None, own[i + 1][1] if i + 1 < len(own) else None)
    whole = {r.k: r.n for r in ordered.running_sums(ranges, [], {"n": F.lit(1)}).collect()}
    assert whole == {k: k for k in range(500)}


def values(kind, n, rng):
    if kind == "ties":
        return [float(rng.choice([0, 0, 0, 1, -1, 7])) for _ in range(n)]
    if kind == "magnitudes":
        return [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(n)]
    if kind == "odd":
        return [rng.choice([math.nan, math.inf, -math.inf, 0.0, -0.0, 1.5, None, 1e308, -1e308]) for _ in range(n)]
    return [rng.gauss(0, 1) for _ in range(n)]


def brute(vs):
    vs = sorted((v for v in vs if v is not None), key=lambda v: (math.isnan(v), v))
    if not vs:
        return None
    a, b = vs[(len(vs) - 1) // 2], vs[len(vs) // 2]
    return a if a == b else a * 0.5 + b * 0.5


@pytest.mark.parametrize(("pieces", "rounds"), [(4096, 3), (3, 2), (8, 0)])
def test_medians(spark, pieces, rounds):
    rng = random.Random(4)
    groups = {(kind, n): values(kind, n, rng) for kind, n in itertools.product(["ties", "magnitudes", "odd", "plain"], [1, 2, 3, 200, 501])}
    groups["none", 0] = [None, None]
    groups[None, None] = [3.0, 1.0, 2.0, 10.0]
    rows = [(k, n, v) for (k, n), vs in groups.items() for v in vs]
    got = {(r["kind.of"], r["size"]): r for r in ordered.medians(spark.createDataFrame(rows, "`kind.of` string, size long, v double"), ["kind.of", "size"], "v", pieces, rounds).collect()}
    assert len(got) == len(groups)
    for key, vs in groups.items():
        want, r = brute(vs), got[key]
        assert r["n"] == sum(v is not None for v in vs)
        assert (r["median"] is None) == (want is None) and (want is None or r["median"] == want or math.isnan(r["median"]) and math.isnan(want)), key


def test_medians_of_nothing_and_of_all(spark):
    assert ordered.medians(spark.createDataFrame([], "g long, v double"), ["g"], "v").count() == 0
    (row,) = ordered.medians(spark.range(1, 10_001).select(F.col("id").alias("v")), [], "v", 16, 2).collect()
    assert (row["n"], row["median"]) == (10_000, statistics.median(range(1, 10_001)))
