"""Exact quantiles against numpy, in groups, of many different values, and the shape of their plan."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arpent.operators import quantiles
from arpent.operators.quantiles import exact

AT = {"least": 0.0, "p01": 0.001, "q1": 0.25, "half": 0.5, "third": 1 / 3, "q3": 0.75, "p999": 0.999, "most": 1.0}


def plain(values):
    kept = [float(v) for v in values if v is not None and v == v]
    return {n: float(np.quantile(kept, q)) if kept else None for n, q in AT.items()}, len(kept)


def same(row, values):
    want, n = plain(values)
    assert row.n_x == n
    for k, w in want.items():
        assert (row[k] is None) if w is None else row[k] == pytest.approx(w, rel=1e-12, abs=1e-12), k


@pytest.mark.parametrize("seed", range(4))
def test_quantiles_against_numpy(spark, seed):
    r = random.Random(seed)
    kinds = [lambda: r.uniform(-5, 5), lambda: round(r.gauss(5000, 900), 2), lambda: float(r.randint(-2, 2)), lambda: r.choice([1e-300, -1e300, 1e300, 0.0, -0.0, 7.0])]
    values = [r.choice([kinds[seed](), kinds[seed](), None, float("nan")]) if r.random() < 0.2 else kinds[seed]() for _ in range(997)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    same(exact(df, {"x": F.col("v")}, {n: ("x", q) for n, q in AT.items()}).first(), values)


def test_quantiles_of_groups_and_measures(spark):
    r = random.Random(9)
    rows = [(r.choice([1, 2, 3, None]), r.choice(["a", None]), r.random() * 100, r.randint(0, 9) if r.random() < 0.8 else None) for _ in range(1500)]
    df = spark.createDataFrame(rows, "g int, h string, v double, w int")
    asked = {f"{m}_{n}": (m, q) for m in ("x", "y") for n, q in AT.items()}
    found = {(x.g, x.h): x for x in exact(df, {"x": F.col("v"), "y": F.col("w")}, asked, ("g", "h")).collect()}
    assert set(found) == {(g, h) for g, h, _, _ in rows}
    for (g, h), row in found.items():
        for m, place in (("x", 2), ("y", 3)):
            want, n = plain([x[place] for x in rows if x[:2] == (g, h)])
            assert row[f"n_{m}"] == n and all(row[f"{m}_{k}"] == pytest.approx(w, rel=1e-12) for k, w in want.items())


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    for rows in (df, df.limit(0)):
        same(exact(rows, {"x": F.col("v")}, {n: ("x", q) for n, q in AT.items()}).first(), [])
    assert exact(df, {"x": F.col("v")}, {"half": ("x", 0.5)}, ("v",)).count() == 0


def test_slots_follow_the_order(spark):
    values = sorted({float(s * 10.0**e * (1 + k / 7)) for s in (-1, 1) for e in range(-20, 300, 5) for k in range(7)} | {0.0})
    got = [x.s for x in spark.createDataFrame([(v,) for v in values], "v double").select("v", F.expr(quantiles.SLOT.replace("x)", "v)")).alias("s")).orderBy("v").collect()]
    assert got == sorted(got)


def test_ten_million_different_values(spark):
    """No task gets more than a part of them: no aggregate without a key but of counts, and slots stay small."""
    n = 10_000_000
    df = spark.range(0, n, 1, 8).select(((F.col("id") * 7_919_993) % n / 100).alias("v"))  # a permutation
    found = exact(df, {"x": F.col("v")}, {"q1": ("x", 0.25), "half": ("x", 0.5), "p999": ("x", 0.999)})
    row = found.first()
    assert row.n_x == n and row.half == pytest.approx((n - 1) / 200) and row.q1 == pytest.approx((n - 1) / 400) and row.p999 == pytest.approx((n - 1) * 0.999 / 100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "ObjectHashAggregate" not in plan
    most = df.groupBy(F.expr(quantiles.SLOT.replace("x)", "v)")).alias("s")).count().agg(F.max("count")).first()[0]
    assert most < n / 900
