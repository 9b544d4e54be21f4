import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assaylake.llm.heavy_hitters import frequent_values, merge_summaries


def exact(values, share):
    return {(v, n) for v, n in Counter(v for v in values if v is not None).items() if n >= share * len(values)}


def found(df, share, **kw):
    return {(r.value, r.n_rows) for r in frequent_values(df, F.col("v"), share=share, **kw).collect()}


@pytest.mark.parametrize("capacity,fan_in", [(40, 2), (400, 32)])
def test_counts(spark, capacity, fan_in):
    rng = random.Random(capacity)
    values = [rng.choice(["hot", "warm", None, ""]) if rng.random() < 0.4 else f"x{rng.randrange(5000)}" for _ in range(20_000)]
    df = spark.createDataFrame([(v, 1) for v in values], "v string, value int").repartition(7)
    assert found(df, 0.05, capacity=capacity, fan_in=fan_in) == exact(values, 0.05)
    for r in frequent_values(df, F.col("v"), share=0.05, capacity=capacity).collect():
        assert r.lower <= r.n_rows <= r.upper and r.total == 20_000 and r.upper - r.lower <= 20_000 / (capacity + 1)


def test_edges(spark):
    empty = spark.createDataFrame([], "v string")
    assert found(empty, 0.1) == set()
    assert found(spark.createDataFrame([(None,)] * 3, "v string"), 0.1) == set()
    assert found(spark.createDataFrame([("a",), ("b",)], "v string"), 0.5) == {("a", 1), ("b", 1)}
    long = "z" * 300_000
    assert found(spark.createDataFrame([(long,), (long,), (None,)], "v string"), 0.6) == {(long, 2)}
    with pytest.raises(ValueError):
        frequent_values(empty, F.col("v"), share=0.001, capacity=10)


def test_error_bound_of_merges():
    rng, parts, truth = random.Random(1), [], Counter()
    for _ in range(30):
        c = Counter(f"k{int(rng.paretovariate(0.7))}" for _ in range(500))
        truth += c
        parts.append(merge_summaries([(500, 0, pd.Series(c))], 20))
    n, error, counters = merge_summaries([merge_summaries(parts[:15], 20), merge_summaries(parts[15:], 20)], 20)
    assert n == 15_000 and error <= n / 21
    for k, v in truth.items():
        assert counters.get(k, 0) <= v <= counters.get(k, 0) + error
