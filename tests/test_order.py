"""Numbers, running values and order statistics over many ranges against sorted lists."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelight.operators import order as O
from pagelight.plans import report as P


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbers(spark, many_ranges):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(300)]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    got = sorted((r.n, r.a, r.b) for r in O.numbered(df, ["a", "b"], "n").collect())
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [g[1:] for g in got] == want and [g[0] for g in got] == list(range(1, 501))
    assert O.numbered(df.limit(0), ["a"], "n").collect() == []


def test_no_window_without_partition(spark):
    df = spark.range(100).withColumn("v", F.rand(1))
    for out in (O.numbered(df, ["v"], "n"), P.pareto(df.withColumn("c", F.col("v")), "v", "c", "id"), P.latency_summary(df.withColumn("g", F.lit("x")), "g", "v")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan or "WindowGroup" in plan or "latency" in plan
        for line in plan.splitlines():
            if "Window [" in line:
                assert "place" in line or "lo#" in line or "of" in line


def test_best_so_far(spark, many_ranges):
    rng = random.Random(2)
    rows = [(k, rng.randint(0, 200)) for k in range(300)]
    rng.shuffle(rows)
    got = {r.k: r.best for r in O.best_so_far(spark.createDataFrame(rows, "k int, v int"), "k", "v", "best").collect()}
    best = None
    for k, v in sorted(rows):
        assert got[k] == best
        best = v if best is None else max(best, v)


GROUPS = {
    "ties": [1.0] * 500 + [2.0] * 3,
    "spread": [math.exp(x / 7) * (-1) ** x for x in range(300)],
    "one": [4.5],
    "ends": [float("inf")] * 3 + [-float("inf")] * 2 + [0.0, -0.0, 1e308, -1e308, 5e-324],
    "near": list(np.nextafter(np.full(40, 1.0), 2.0)) + [1.0] * 40,
    None: [3.0, 1.0, 2.0],
}


@pytest.mark.parametrize("few", [O.FEW, 4])
def test_order_statistics(spark, few):
    rows = [(g, float(v)) for g, vs in GROUPS.items() for v in vs] + [("ties", None), ("ties", float("nan")), ("nothing", None)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    n = F.col("n")
    places = {"first": F.lit(0), "median": F.floor((n - 1) / 2), "late": F.floor((n - 1) * 0.9), "last": n - 1, "beyond": n}
    got = {r.g: r for r in O.order_statistics(df, "g", "v", places, few).collect()}
    assert set(got) == set(GROUPS)
    for g, vs in GROUPS.items():
        s, r = sorted(vs), got[g]
        assert (r.n, r.first, r.median, r.late, r.last, r.beyond) == (len(s), s[0], s[(len(s) - 1) // 2], s[math.floor((len(s) - 1) * 0.9)], s[-1], None)


@pytest.mark.parametrize("few", [O.FEW, 4])
def test_linear_percentiles(spark, few):
    df = spark.createDataFrame([(g, float(v)) for g, vs in GROUPS.items() if g != "ends" for v in vs], "g string, v double")
    for r in O.linear_percentiles(df, "g", "v", {"p25": 0.25, "p50": 0.5, "p99": 0.99}, few).collect():
        assert [r.p25, r.p50, r.p99] == pytest.approx(list(np.quantile(GROUPS[r.g], [0.25, 0.5, 0.99])), rel=1e-12)
